"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads windows of ``WINDOW`` bytes, both ways, labels every byte position and pools the positions'
probabilities over the whole document.  It is trained here, in numpy, by backpropagation through time on a
bounded sample: at most ``docs_per_language`` documents of each language, ``windows_per_doc`` windows each
(documented bounds; the classifier's only use of sampling).  The weights (some thousand numbers) are
broadcast; prediction is one pass over the texts.

Beside the languages the network has one further label, no language: it learns that from windows made by rule
(``foreign_windows``: random letters, codes, symbols, and letters of scripts that the learned texts don't use).
Numbers, addresses and keys are put into a third of the languages' windows, so that what stands beside them keeps
its language.  A document is identified if the pooled probability of no language over its letters is below one half;
this doesn't depend on the number of languages, and a text in two of them stays.

Defined results: ``und`` with score 0 if the text is null or has no letter (Unicode category L), or if nothing
could be learned; else the likeliest of the learned values and its pooled probability.  Null ids and null languages are allowed, repeated
rows are kept, an empty table gives an empty result, other columns are ignored.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import ship_package
from .token_counts import Shared

WINDOW = 64
HIDDEN = 8
#: Windows that go through the network together.
GROUP = 2048
UNKNOWN = "und"

_LETTER_BYTE = np.array([b >= 128 or chr(b).isalpha() for b in range(256)], dtype=np.float32)
_LETTER = regex.compile(r"\p{L}")
# First letters of scripts, and how many follow: fixed values of Unicode.
SCRIPTS = ((0x0391, 56), (0x0410, 64), (0x0561, 38), (0x05D0, 27), (0x0627, 36), (0x0905, 53), (0x0985, 45), (0x0E01, 46), (0x10D0, 33), (0x3041, 86), (0x30A1, 90), (0x4E00, 20000), (0xAC00, 11000))


class ByteGRU:
    """Parameters of both directions (first axis) in feature-major form, and the position classifier.

    Gates use sigmoid(a) = (1 + tanh(a / 2)) / 2; the halves are folded into the parameters when predicting.
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.labels, self.hidden = labels, hidden
        self.p = {
            "x": rng.normal(0, 0.3, (2, 3 * hidden, 256)),
            "u": rng.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)),
            "o": rng.normal(0, 0.3, (2, len(labels), hidden)),
            "b": np.zeros((len(labels), 1)),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    # --- training -----------------------------------------------------------------------------------

    def _step_all(self, x: np.ndarray):
        """Forward pass that keeps what the backward pass needs; x is (time, windows)."""
        t_max, n = x.shape
        h = self.hidden
        kept = []
        for d in range(2):
            state = np.zeros((h, n), np.float32)
            rows = []
            for s in range(t_max):
                t = s if d == 0 else t_max - 1 - s
                u = self.p["u"][d] @ state
                g = self.p["x"][d][:, x[t]]
                zr = 1 / (1 + np.exp(-(g[: 2 * h] + u[: 2 * h])))
                z, r = zr[:h], zr[h:]
                c = np.tanh(g[2 * h :] + r * u[2 * h :])
                new = c + z * (state - c)
                rows.append((t, state, z, r, u[2 * h :], c, new))
                state = new
            kept.append(rows)
        return kept

    def gradients(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray):
        """Mean cross-entropy over the unmasked positions and its gradients."""
        t_max, n = x.shape
        h, k = self.hidden, len(self.labels)
        kept = self._step_all(x)
        logits = np.zeros((t_max, k, n), np.float32) + self.p["b"]
        for d in range(2):
            for t, *_, new in kept[d]:
                logits[t] += self.p["o"][d] @ new
        logits -= logits.max(axis=1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=1, keepdims=True)
        total = mask.sum()
        loss = -(np.log(prob[:, y, np.arange(n)] + 1e-9) * mask).sum() / total
        delta = prob
        delta[:, y, np.arange(n)] -= 1
        delta *= mask[:, None, :] / total
        grad = {name: np.zeros_like(v) for name, v in self.p.items()}
        grad["b"] = delta.sum(axis=(0, 2))[:, None]
        for d in range(2):
            back = np.zeros((h, n), np.float32)
            gates = np.empty((t_max, 3 * h, n), np.float32)
            for t, state, z, r, uc, c, new in reversed(kept[d]):
                grad["o"][d] += delta[t] @ new.T
                back = back + self.p["o"][d].T @ delta[t]
                dc = back * (1 - z) * (1 - c * c)
                dz = back * (state - c) * z * (1 - z)
                dr = dc * uc * r * (1 - r)
                through = np.concatenate([dz, dr, dc * r])
                grad["u"][d] += through @ state.T
                gates[t] = np.concatenate([dz, dr, dc])
                back = back * z + self.p["u"][d].T @ through
            flat = np.ascontiguousarray(gates.transpose(0, 2, 1)).reshape(-1, 3 * h)
            order = np.argsort(x.ravel(), kind="stable")
            seen, first = np.unique(x.ravel()[order], return_index=True)
            grad["x"][d][:, seen] = np.add.reduceat(flat[order], first, axis=0).T
        return loss, grad

    def fit(self, windows: np.ndarray, weights: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 5):
        """Adam with a decaying rate on class-balanced batches; windows is (n, WINDOW) bytes, weights of each."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        members = [np.flatnonzero(y == c) for c in range(len(self.labels))]
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(m, -(-batch // len(members))) for m in members if len(m)])
            mask = np.ascontiguousarray(weights[pick].T)
            _, grad = self.gradients(np.ascontiguousarray(windows[pick].T), y[pick], mask)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            lr = rate * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = (self.p[k] - lr * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)
        return self

    # --- prediction ---------------------------------------------------------------------------------

    def folded(self) -> list[tuple]:
        """Per direction: input table, recurrent and output weights with the gates' halves folded in."""
        h = self.hidden
        out = []
        for d in range(2):
            x, u = self.p["x"][d].copy(), self.p["u"][d].copy()
            x[: 2 * h] *= 0.5
            u[: 2 * h] *= 0.5
            u[2 * h :] *= 0.5  # r * u becomes (1 + tanh) * u / 2
            out.append((np.ascontiguousarray(x), np.ascontiguousarray(u), np.ascontiguousarray(self.p["o"][d])))
        return out

    def position_probabilities(self, x: np.ndarray) -> np.ndarray:
        """(time, labels, windows) for bytes x of (time, windows)."""
        t_max, n = x.shape
        h = self.hidden
        logits = np.empty((t_max, len(self.labels), n), np.float32)
        logits[:] = self.p["b"]
        g, u = np.empty((3 * h, n), np.float32), np.empty((3 * h, n), np.float32)
        o = np.empty((len(self.labels), n), np.float32)
        for d, (table, weights, output) in enumerate(self.folded()):
            state = np.zeros((h, n), np.float32)
            for s in range(t_max):
                t = s if d == 0 else t_max - 1 - s
                np.take(table, x[t], axis=1, out=g, mode="clip")
                np.matmul(weights, state, out=u)
                a = u[: 2 * h]
                a += g[: 2 * h]
                np.tanh(a, out=a)
                a += 1.0
                c = u[2 * h :]
                c *= a[h:]
                c += g[2 * h :]
                np.tanh(c, out=c)
                state -= c
                state *= a[:h]
                state *= 0.5
                state += c
                np.matmul(output, state, out=o)
                logits[t] += o
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def document_probabilities(self, texts: list[bytes], letters: bool = False) -> np.ndarray:
        """(texts, labels): positions' probabilities pooled over each whole text (zeros if empty), or over the
        positions of its letters (ASCII ones and all bytes of longer characters)."""
        pooled = np.zeros((len(texts), len(self.labels)))
        sizes = np.array([len(t) for t in texts])
        n_windows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), n_windows)
        if not len(owner):
            return pooled
        raw = b"".join([t + bytes(-len(t) % WINDOW) for t in texts])
        windows = np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)
        last = np.cumsum(n_windows)[n_windows > 0] - 1
        fill = np.full(len(windows), WINDOW)
        fill[last] = sizes[n_windows > 0] - (n_windows[n_windows > 0] - 1) * WINDOW
        for at in range(0, len(windows), GROUP):
            x = np.ascontiguousarray(windows[at : at + GROUP].T)
            prob = self.position_probabilities(x)
            if letters:
                prob *= _LETTER_BYTE[x][:, None, :]
            short = np.flatnonzero(fill[at : at + GROUP] < WINDOW)
            if len(short):
                prob[:, :, short] *= (np.arange(WINDOW)[:, None] < fill[at + short])[:, None, :]
            np.add.at(pooled, owner[at : at + GROUP], prob.sum(axis=0).T)
        if letters:
            sizes = np.add.reduceat(_LETTER_BYTE[windows].sum(1), np.cumsum(n_windows) - n_windows) if (n_windows > 0).all() else np.array([int(_LETTER_BYTE[np.frombuffer(t, np.uint8)].sum()) for t in texts])
        return pooled / np.maximum(sizes, 1)[:, None]


def crc_residue(ident: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null ids count as empty text."""
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def foreign_windows(n: int, texts: list[str], seed: int = 9) -> list[bytes]:
    """``n`` windows of no learned language; scripts that ``texts`` use are left out."""
    rng = random.Random(seed)
    used = set("".join(texts))
    scripts = [(a, k) for a, k in SCRIPTS if not any(a <= ord(c) < a + k for c in used)]
    lower, alnum = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    symbols = "!#$%&()*+,-./:;<=>?@[]^_{|}~ 0123456789" * 6 + lower
    out = []
    for i in range(n):
        kind = i % 4
        if kind == 0 or (kind == 3 and not scripts):  # random letters in words
            words = ["".join(rng.choices(lower, k=rng.randint(2, 11))) for _ in range(WINDOW // 3)]
            text = " ".join(w.upper() if rng.random() < 0.1 else w for w in words)
        elif kind == 1:  # codes
            text = "".join(rng.choices(alnum, k=WINDOW))
        elif kind == 2:  # symbols and digits around single letters
            text = "".join(rng.choices(symbols, k=WINDOW))
        else:
            first, size = rng.choice(scripts)
            text = " ".join("".join(chr(first + rng.randrange(size)) for _ in range(rng.randint(1, 8))) for _ in range(WINDOW // 8))
        out.append(text.encode()[:WINDOW])
    return out


def with_foreign_token(rng: random.Random, text: str) -> tuple[bytes, list[float]]:
    """The text with a number, address or key put in at some place, and 1 for each byte that was there before."""
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    token = (
        lambda: ".".join(digits(rng.randint(1, 3)) for _ in range(4)),
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: digits(rng.randint(8, 20)),
        lambda: "".join(rng.choices(alnum, k=rng.randint(10, 30))),
        lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 8))) + f".{digits(2)}@" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) + ".com",
        lambda: f"x{digits(2)} = \"{''.join(rng.choices('0123456789abcdef', k=rng.randint(16, 40)))}\"",
    )
    spaces = [i for i, c in enumerate(text) if c == " "] or [0]
    at = rng.choice(spaces)
    raw, weight = b"", []
    for part, w in ((text[:at], 1.0), (" " + " ".join(rng.choice(token)() for _ in range(rng.randint(1, 3))) + " ", 0.0), (text[at:], 1.0)):
        raw += part.encode()
        weight += [w] * (len(raw) - len(weight))
    first = rng.randint(0, max(0, len(raw) - WINDOW))
    return raw[first : first + WINDOW], weight[first : first + WINDOW]


def train(docs: DataFrame, may_learn: Column, docs_per_language: int = 1500, windows_per_doc: int = 3, seed: int = 3) -> ByteGRU | None:
    """A network for the languages of the rows where ``may_learn`` holds and lang isn't null."""
    rows = docs.select("doc_id", "text", "lang", may_learn.alias("ok")).where("ok and lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    labels = sorted(counts)
    # Each language keeps the rows of smallest hash, about twice the bound at most.
    share = F.lit(0.0)
    for label, n in counts.items():
        share = F.when(F.col("lang") == label, F.lit(min(1.0, 1.2 * docs_per_language / n + 20 / n))).otherwise(share)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    span = F.greatest(F.length("text") - WINDOW, F.lit(0)) + 1
    cuts = [F.substring("text", 1 + F.pmod(F.xxhash64("doc_id", F.lit(w)), span).cast("int"), F.lit(WINDOW)) for w in range(windows_per_doc)]
    sample = rows.where(unit < share).select("lang", F.array(*cuts).alias("cuts"), unit.alias("unit"), "doc_id").orderBy("unit", "doc_id").limit(2 * docs_per_language * len(labels)).collect()
    at = {label: i for i, label in enumerate(labels)}
    windows, weights, y, cut_texts = [], [], [], []
    taken = dict.fromkeys(labels, 0)
    rng = random.Random(seed)

    def add(raw: bytes, weight: list[float], label: int):
        windows.append(raw + bytes(WINDOW - len(raw)))
        weights.append(weight + [0.0] * (WINDOW - len(raw)))
        y.append(label)

    for r in sample:
        if taken[r["lang"]] >= docs_per_language:
            continue
        taken[r["lang"]] += 1
        for n, cut in enumerate(r["cuts"]):
            raw = (cut or "").encode()[:WINDOW]
            if raw:
                # One of a document's windows has something foreign put in, on which nothing is learned.
                add(*(with_foreign_token(rng, cut) if n == 0 else (raw, [1.0] * len(raw))), at[r["lang"]])
                cut_texts.append(cut)
    if not windows:
        return None
    for raw in foreign_windows(max(400, len(windows) // len(labels)), cut_texts):
        add(raw, [1.0] * len(raw), len(labels))
    data = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW)
    return ByteGRU([*labels, UNKNOWN], seed=seed).fit(data, np.array(weights, dtype=np.float32), np.array(y))


def _predict_texts(model: ByteGRU | None, texts: list[str | None], letters: bool = False) -> tuple[list[str], list[float], list[float]]:
    """Likeliest language, its pooled probability, and the pooled probability of no language, per text; pooled over
    all positions or those of letters."""
    has = [model is not None and t is not None and _LETTER.search(t) is not None for t in texts]
    names, scores, none = [UNKNOWN] * len(texts), [0.0] * len(texts), [1.0] * len(texts)
    index = [i for i, ok in enumerate(has) if ok]
    if index:
        prob = model.document_probabilities([texts[i].encode() for i in index], letters)
        for i, p in zip(index, prob, strict=True):
            best = int(p[:-1].argmax())
            names[i], scores[i], none[i] = model.labels[best], min(1.0, float(p[best])), float(p[-1])
    return names, scores, none


def _parts(batch, at: int, chars: int = 4 << 20):
    """Slices of a batch of about so many characters of column ``at``."""
    size = first = 0
    lengths = batch.column(at).to_pylist()
    for i, text in enumerate(lengths):
        size += len(text or "")
        if size >= chars:
            yield batch.slice(first, i + 1 - first)
            first, size = i + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def _predict(shared):
    def run(batches):
        for batch in batches:
            for part in _parts(batch, 1):
                names, scores, _ = _predict_texts(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: ByteGRU | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    ship_package(docs.sparkSession)
    shared = Shared(docs.sparkSession, model)
    return docs.select("doc_id", "text").mapInArrow(_predict(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def _keep(shared, at: int, most: float, languages):
    def run(batches):
        for batch in batches:
            for part in _parts(batch, at):
                names, _, none = _predict_texts(shared.value, part.column(at).to_pylist(), True)
                yield part.filter(pa.array([n != UNKNOWN and p < most and (languages is None or n in languages) for n, p in zip(names, none, strict=True)], pa.bool_()))

    return run


def keep_identified(docs: DataFrame, model: ByteGRU | None, languages: list[str] | None = None, most_none: float = 0.5) -> DataFrame:
    """Rows, with all their columns, whose letters are mostly in a language: pooled probability of none below
    ``most_none`` over the positions of letters, so that numbers and symbols don't count; if ``languages`` are given, the likeliest must be one of them."""
    ship_package(docs.sparkSession)
    return docs.mapInArrow(_keep(Shared(docs.sparkSession, model), docs.columns.index("text"), most_none, languages), docs.schema)
