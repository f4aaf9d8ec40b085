"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities of a learned lexicon (plain and after undoing look-alike characters),
proximity of its words to second-person words, capitals, shouting, punctuation, digits, obfuscation and
stretching rates, and size.  The lexicon is learned from the training sample only: at most ``MAX_LEXICON`` words
whose support among toxic documents (copies that begin or end alike count once) is beyond chance.  Trees minimise
the logistic loss on histogram bins; out-of-fold scores are calibrated by pool-adjacent-violators.  The sample is bounded: about ``docs_per_class`` toxic and twice
as many other documents, of at most ``MAX_SAMPLE_CHARS`` characters (documented bounds of the classifier's training only).

Defined results: null or empty texts are scored like any other (their features are zero); null ids and
repeated rows are kept; without labels of both classes the score is the positive share (0 if none is known);
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship_package
from .langid import _parts
from .token_counts import Shared

MAX_SAMPLE_CHARS = 10_000
LEAST_SUPPORT = 4
LEAST_EVIDENCE = 13.0
MAX_LEXICON = 400
#: Characters on either side of a lexicon word in which second-person words are looked for.
REACH = 80

# Second-person words (English, German, French, Spanish): fixed values.
SECOND_PERSON = "you your yours yourself ur du dich dir dein deine euch euer ihr tu te toi ton ta tes vous votre vos tú ti tu tus usted ustedes vosotros vuestro".split()
# Look-alike characters and the letters that they stand for: fixed values.
LOOK_ALIKE = str.maketrans("013457@$!|", "oieastasii")

_WORD = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[a-z][013457@$!|*]+[a-z]")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_UPPER, _DIGIT = np.arange(65, 91), np.arange(48, 58)
_MARKS = np.array([c for c in range(33, 127) if not chr(c).isalnum()])

FEATURES = "density weighted hits top proximity near_second obfuscated_density mixed capitals shouting marks exclamations questions digits stretched log_words word_length repeated".split()


class Lexicon:
    """Weighted words; finds whole-word occurrences with one automaton."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self._automaton = None

    def __getstate__(self):
        return {"weights": self.weights, "_automaton": None}

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, word) of the lexicon's words in lower-case text."""
        if not self.weights:
            return []
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for word in self.weights:
                self._automaton.add_word(word, word)
            self._automaton.make_automaton()
        out = []
        for last, word in self._automaton.iter(text):
            start = last + 1 - len(word)
            if (start == 0 or not text[start - 1].isalnum()) and (last + 1 == len(text) or not text[last + 1].isalnum()):
                out.append((start, last + 1, word))
        return out


class Words:
    """The distinct words of texts and two marks, of beginning and end, that copies share."""

    def __init__(self, texts: list[str]):
        split = [_WORD.findall(t.lower()) for t in texts]
        self.sets = [set(w) for w in split]
        self.ends = [(tuple(w[:4]), tuple(w[-4:])) for w in split]


def learn_lexicon(words: Words, toxic: np.ndarray, rows: np.ndarray) -> Lexicon:
    """Words that mark the toxic ones of ``rows``, with their smoothed log odds.

    A word's support is the number of toxic documents that hold it and neither begin nor end alike.  It is
    taken if, against the share of toxic documents, the likelihood ratio of its support is beyond chance
    among all words (``LEAST_EVIDENCE``)."""
    holders: dict[str, list[int]] = {}
    clean: dict[str, int] = {}
    for i in rows.tolist():
        for x in words.sets[i]:
            if toxic[i]:
                holders.setdefault(x, []).append(i)
            else:
                clean[x] = clean.get(x, 0) + 1
    n_toxic = int(toxic[rows].sum())
    n_clean = len(rows) - n_toxic
    prior = n_toxic / max(1, len(rows))
    found = []
    for x, held in holders.items():
        if len(held) < LEAST_SUPPORT or len(x) < 2:
            continue
        support = min(len({words.ends[i][0] for i in held}), len({words.ends[i][1] for i in held}))
        n = support + clean.get(x, 0)
        share = support / n
        if support < LEAST_SUPPORT or share <= prior:
            continue
        evidence = support * np.log(share / prior) + ((n - support) * np.log((1 - share) / (1 - prior)) if n > support else 0.0)
        odds = np.log((support + 0.5) / (n_toxic + 1)) - np.log((n - support + 0.5) / (n_clean + 1))
        if evidence >= LEAST_EVIDENCE and odds > 2.0:
            found.append((evidence, x, float(odds)))
    return Lexicon({x: odds for _, x, odds in sorted(found, reverse=True)[:MAX_LEXICON]})


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    if not text:
        return [0.0] * len(FEATURES)
    low = text.lower()
    counts = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n_chars = int(counts.sum())
    n_words = int(counts[32] + counts[10]) + 1
    hits = lexicon.find(low)
    weights = [lexicon.weights[w] for _, _, w in hits]
    near, beside = REACH + 1, 0
    for start, end, _ in hits:
        around = _second_person_distances(low, start, end)
        if around:
            near = min(near, *around)
            beside += 1
    mixed = len(_MIXED.findall(low))
    hidden = 0
    if mixed:
        hidden = max(0, len(lexicon.find(low.translate(LOOK_ALIKE))) - len(hits))
    return [
        len(hits) / n_words,
        sum(weights) / n_words,
        np.log1p(len(hits)),
        max(weights, default=0.0),
        1 / (1 + near) if hits else 0.0,
        beside / n_words,
        hidden / n_words,
        mixed / n_words,
        counts[_UPPER].sum() / n_chars,
        len(_SHOUT.findall(text)) / n_words,
        counts[_MARKS].sum() / n_chars,
        counts[33] / n_chars,
        counts[63] / n_chars,
        counts[_DIGIT].sum() / n_chars,
        len(_STRETCH.findall(low)) / n_words,
        np.log1p(n_words),
        n_chars / n_words,
        counts.max() / n_chars,
    ]


_SECOND = frozenset(SECOND_PERSON)


def _second_person_distances(low: str, start: int, end: int) -> list[int]:
    """Characters between [start, end) and each second-person word within REACH."""
    return [start - m.end() if m.end() <= start else m.start() - end for m in _WORD.finditer(low, max(0, start - REACH), min(len(low), end + REACH)) if m.group() in _SECOND]


class BoostedTrees:
    """Trees of fixed depth fitted to the logistic loss by Newton steps on quantile bins."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 4.0):
        self.n_trees, self.depth, self.rate, self.bins, self.ridge, self.least = trees, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        # A cut above zero for features that are zero in most rows.
        self.cuts = [np.unique(np.append(c, [v[v > v.min()].min() - 1e-12] if (v > v.min()).any() else [])) for c, v in zip(self.cuts, x.T, strict=True)]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1)
        width = max(len(c) for c in self.cuts) + 1
        inner = (1 << self.depth) - 1
        self.feature = np.zeros((self.n_trees, inner), dtype=int)
        self.threshold = np.full((self.n_trees, inner), np.inf)
        self.value = np.zeros((self.n_trees, inner + 1))
        raw = np.full(len(y), self.base)
        for t in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            node = np.zeros(len(y), dtype=int)
            for level in range(self.depth):
                for local in range(1 << level):
                    rows = np.flatnonzero(node == local)
                    at = (1 << level) - 1 + local
                    split = self._split(binned[rows], g[rows], h[rows], width) if len(rows) else None
                    if split is not None:
                        j, b = split
                        self.feature[t, at], self.threshold[t, at] = j, self.cuts[j][b]
                right = x[np.arange(len(y)), self.feature[t, (1 << level) - 1 + node]] > self.threshold[t, (1 << level) - 1 + node]
                node = 2 * node + right
            for leaf in range(inner + 1):
                rows = node == leaf
                self.value[t, leaf] = -self.rate * g[rows].sum() / (h[rows].sum() + self.ridge)
            raw += self.value[t, node]
        return self

    def _split(self, binned, g, h, width):
        best, gain = None, 1e-6
        total_g, total_h = g.sum(), h.sum()
        root = total_g**2 / (total_h + self.ridge)
        for j, cuts in enumerate(self.cuts):
            gs = np.cumsum(np.bincount(binned[:, j], g, width))[: len(cuts)]
            hs = np.cumsum(np.bincount(binned[:, j], h, width))[: len(cuts)]
            gr, hr = total_g - gs, total_h - hs
            score = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - root
            score[(hs < self.least / 10) | (hr < self.least / 10)] = -1
            if len(score) and score.max() > gain:
                gain, best = score.max(), (j, int(score.argmax()))
        return best

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in range(self.n_trees):
            node = np.zeros(len(x), dtype=int)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (x[np.arange(len(x)), self.feature[t, at]] > self.threshold[t, at])
            out += self.value[t, node]
        return out


def pool_adjacent_violators(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit of y on score (equal scores count together)."""
    xs, index = np.unique(score, return_inverse=True)
    weight = np.bincount(index).astype(float)
    mean = np.bincount(index, y) / weight
    blocks: list[list[float]] = []  # mean, weight, first, last
    for x, m, w in zip(xs, mean, weight, strict=True):
        blocks.append([m, w, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, last = blocks.pop()
            m1, w1, first, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, first, last])
    knots = [(x, b[0]) for b in blocks for x in ((b[2], b[3]) if b[2] < b[3] else (b[2],))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class ToxicityModel:
    def __init__(self, texts: list[str], y: np.ndarray, folds: int = 2):
        self.prior = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if not 0 < self.prior < 1:
            return
        words = Words(texts)
        every = np.arange(len(y))
        # Out-of-fold scores, lexicon included; folds go by the first words, so most copies stay together.
        fold = np.array([sum("".join(e[0]).encode()) % folds for e in words.ends])
        out = np.full(len(y), np.nan)
        for f in range(folds):
            a, b = every[fold != f], every[fold == f]
            if len(a) and len(b) and 0 < y[a].mean() < 1:
                x = self._matrix(texts, learn_lexicon(words, y, a))
                out[b] = BoostedTrees().fit(x[a], y[a]).raw(x[b])
        self.lexicon = learn_lexicon(words, y, every)
        self.trees = BoostedTrees().fit(self._matrix(texts, self.lexicon), y)
        known = ~np.isnan(out)
        self.knots = pool_adjacent_violators(out[known], y[known]) if known.any() else (np.array([0.0]), np.array([self.prior]))

    @staticmethod
    def _matrix(texts, lexicon: Lexicon) -> np.ndarray:
        return np.array([features(t, lexicon) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probabilities; a hundredth of the uncalibrated one keeps the order inside its steps."""
        if self.trees is None:
            return np.full(len(texts), self.prior)
        raw = self.trees.raw(self._matrix(texts, self.lexicon))
        return np.clip(0.99 * np.interp(raw, *self.knots) + 0.01 / (1 + np.exp(-raw)), 0.0, 1.0)


def train(docs: DataFrame, labels: DataFrame, may_learn: Column, docs_per_class: int = 2000) -> ToxicityModel:
    """A model from the labelled rows where ``may_learn`` (over doc_id) holds."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    unit = F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("toxic") == 1, min(1.0, docs_per_class / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * docs_per_class / max(1, counts.get(0, 0))))
    picked = known.where(unit < share).orderBy("doc_id").limit(4 * docs_per_class).collect()
    ids = {r["doc_id"]: r["toxic"] for r in picked}
    if not ids:
        return ToxicityModel([], np.array([]))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(ids.items()), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic int"))
    rows = docs.select("doc_id", "text").where(F.length("text").between(1, MAX_SAMPLE_CHARS)).join(table, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return ToxicityModel([r["text"] for r in rows], np.array([r["toxic"] for r in rows], dtype=float))


def _score(shared):
    def run(batches):
        for batch in batches:
            for part in _parts(batch, 1):
                scores = shared.value.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of docs."""
    ship_package(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_score(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
