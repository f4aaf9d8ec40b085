"""Sequence packing: non-negative least squares over shallow length combinations.

1. Every text is tokenised once; its ids and a closing separator id form the document's tokens.  Whole
   windows of a document become sequences of their own; the rest (the tail, shorter than a window) is
   kept, with its ids, in a table in the shared folder.
2. The histogram of tail lengths has fewer than ``window`` bins whatever the input's size.  On the driver
   every pair and triple of present lengths that fills a window exactly is a column; non-negative least
   squares finds how often each is repeated, the counts of the ``keep`` most repeated columns are rounded within
   what is there (a bound on the plan, not on documents), and what is left is packed greedily: tails of one length after another, cut where a window ends.
3. The plan (ranges of ranks for each length) is broadcast; a tail's rank within its length follows from
   its task's counts, so neither a window over the rows nor a shuffle of tokens is needed.

Only the last sequence can be padded.  Defined results: null text counts as empty and still has the
separator; null ids and repeated rows are documents of their own; an empty table gives an empty result;
other columns are ignored; a document longer than a window is cut freely, each id in one piece.
"""

from __future__ import annotations

import base64
import re
import zlib
from itertools import combinations_with_replacement

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, ship_package
from .token_counts import Shared

CACHE_ENTRIES = 250_000
MAX_KEY = 48
CALL_CHARS = 1 << 16
#: Rows of the rank table up to which it is broadcast (about 24 bytes each); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 500_000

_ODD_SPACE = re.compile(r" \s|^ | $")
_WORKER: dict = {}


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; words are looked up in a bounded cache.

    The fast vocabulary file holds the same vocabulary as the tokenizer file.  A space before a character
    that isn't white space always opens a pre-token, so texts are cut there and each part encoded once.
    Texts with a special token's string, which the library looks for first, go to the library whole.
    """

    def __init__(self, tokenizer: bytes, ranks: bytes):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_buffer(tokenizer)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        self.opens = np.zeros(max(table.values()) + 2, dtype=bool)
        self.opens[[i for b, i in table.items() if b[:1] == b" "]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts, missing = [], set()
        for text in texts:
            if not text or _ODD_SPACE.search(text) or any(s in text for s in self.special):
                parts.append(None)
                continue
            words = text.split(" ")
            parts.append(words)
            missing.update(set(words[1:]).difference(self.known))
        if len(self.known) + len(missing) > CACHE_ENTRIES:
            self.known = {}
            missing = {w for words in parts if words for w in words[1:]}
        self._learn(missing)
        get = self.known.__getitem__
        out = [self._slow(t) if p is None else self._bytes(self.fast.encode_ordinary(p[0])) + b"".join(map(get, p[1:])) for t, p in zip(texts, parts, strict=True)]
        for w in missing:
            if len(w) > MAX_KEY:
                del self.known[w]
        return out

    def _slow(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return self._bytes(self.whole.encode(text, add_special_tokens=False).ids)
        return self._bytes(self.fast.encode_ordinary(text))

    @staticmethod
    def _bytes(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    def _learn(self, words: set[str]) -> None:
        group, size = [], 0
        for word in words:
            group.append(word)
            size += len(word) + 1
            if size > CALL_CHARS:
                self._together(group)
                group, size = [], 0
        if group:
            self._together(group)

    def _together(self, words: list[str]) -> None:
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(words)), dtype="<u4")
        cuts = (np.append(np.flatnonzero(self.opens[ids]), len(ids)) * 4).tolist()
        raw = ids.tobytes()
        if len(cuts) == len(words) + 1:
            self.known.update(zip(words, (raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        else:
            self.known.update((w, self._bytes(self.fast.encode_ordinary(" " + w))) for w in words)


def _tokenise(shared, window: int, separator: int):
    def run(batches):
        if _WORKER.get("of") != shared.id:
            _WORKER.update(of=shared.id, encoder=Encoder(*shared.value))
        encoder, pid = _WORKER["encoder"], TaskContext.get().partitionId()
        end, size = separator.to_bytes(4, "little"), 4 * window
        seen: dict[int, int] = {}
        full = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows: list[list] = [[] for _ in range(8)]
                for ids in encoder.encode(part.column(1).to_pylist()):
                    raw = ids + end
                    n = len(raw) // 4
                    whole = n // window
                    tail = raw[whole * size :]
                    k = n % window
                    place = seen.get(k, 0)
                    seen[k] = place + 1
                    for column, value in zip(rows, (pid, n, full, [zlib.crc32(raw[i * size : (i + 1) * size]) for i in range(whole)], k, place, zlib.crc32(tail), np.frombuffer(tail, "<u4").astype("<u2").tobytes() if separator < 65536 and len(encoder.opens) <= 65536 else tail), strict=True):
                        column.append(value)
                    full += whole
                types = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(rows, types, strict=True))], names=["doc_id", "pid", "doc_tokens", "full_at", "full_crc", "tail_len", "place", "tail_crc", "tail"])

    return run


def solve_nnls(columns: np.ndarray, target: np.ndarray, iterations: int = 400) -> np.ndarray:
    """min |A x - target| over x >= 0 by accelerated projected gradient; column j of A counts columns[j]
    (indices into target, -1 for none)."""
    n, m = len(columns), len(target)
    used = columns >= 0
    index = np.where(used, columns, m)

    def times(x):
        return np.bincount(index.ravel(), np.repeat(x, columns.shape[1]), minlength=m + 1)[:m]

    def transposed(r):
        return np.append(r, 0.0)[index].sum(axis=1)

    v = np.ones(n)
    for _ in range(30):
        v = transposed(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(iterations):
        new = np.maximum(0.0, y - step * transposed(times(y) - target))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_windows(histogram: dict[int, int], window: int, keep: int = 4096) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Combinations with their repeat counts, and how many tails of each length are left over."""
    lengths = sorted(histogram)
    left = dict(histogram)
    at = {v: i for i, v in enumerate(lengths)}
    combos = [(a, window - a) for a in lengths if a <= window - a and window - a in at]
    combos += [(a, b, window - a - b) for a, b in combinations_with_replacement(lengths, 2) if b <= window - a - b and window - a - b in at]
    if not combos:
        return [], left
    columns = np.array([[at[v] for v in c] + [-1] * (3 - len(c)) for c in combos])
    target = np.array([histogram[v] for v in lengths], dtype=float)
    x = solve_nnls(columns, target)
    order = np.argsort(-x, kind="stable")
    chosen = order[:keep]
    if len(order) > keep:  # a sparser solution on the best columns loses less to rounding
        x_kept = solve_nnls(columns[chosen], target)
        x = np.zeros(len(combos))
        x[chosen] = x_kept
        order = np.concatenate([chosen[np.argsort(-x_kept, kind="stable")], order[keep:]])
    repeats: dict[tuple[int, ...], int] = {}

    def take(j: int, most: int | None) -> None:
        combo = combos[j]
        n = min(left[v] // combo.count(v) for v in set(combo))
        n = n if most is None else min(n, most)
        if n > 0:
            repeats[combo] = repeats.get(combo, 0) + n
            for v in combo:
                left[v] -= n

    for j in order.tolist():
        take(j, int(round(x[j])))
    for j in order.tolist():
        take(j, None)
    return list(repeats.items()), left


class Layout:
    """Where the tail of a length and rank goes: arrays of bounded size."""

    def __init__(self, histogram: dict[int, int], window: int, first: int):
        patterns, left = plan_windows(histogram, window)
        rows, used, seq = [], dict.fromkeys(histogram, 0), first
        for combo, n in patterns:
            offset = 0
            for v in combo:
                rows.append((v, used[v], seq, offset))
                used[v] += n
                offset += v
            seq += n
        self.window, self.left_from = window, seq
        position = 0
        for v in sorted(left, reverse=True):
            rows.append((v, used[v], -1, position))  # the rest of a length
            position += v * left[v]
        rows.sort()
        self.key = np.array([(v << 44) + lo for v, lo, _, _ in rows], dtype=np.int64)
        self.lo, self.seq, self.offset = (np.array([r[i] for r in rows], dtype=np.int64) for i in (1, 2, 3))

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of each tail; one that doesn't fit its window goes on in the next."""
        j = np.searchsorted(self.key, (lengths.astype(np.int64) << 44) + ranks, side="right") - 1
        inside = ranks - self.lo[j]
        rest = self.seq[j] < 0
        position = self.offset[j] + inside * lengths
        return np.where(rest, self.left_from + position // self.window, self.seq[j] + inside), np.where(rest, position % self.window, self.offset[j])


def _place(layout, window: int):
    def run(batches):
        plan = layout.value
        for batch in batches:
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            ints = {n: np.asarray(col[n].to_numpy(zero_copy_only=False), dtype=np.int64) for n in ("doc_tokens", "full_seq", "tail_len", "rank", "tail_crc")}
            seq, offset = plan.place(ints["tail_len"], ints["rank"]) if len(plan.key) else (ints["rank"], ints["rank"])
            crcs, tails = col["full_crc"].to_pylist(), col["tail"]
            out: list[list] = [[] for _ in range(6)]
            source = []
            for i, (n, f, k, c, s, o) in enumerate(zip(*(ints[x].tolist() for x in ("doc_tokens", "full_seq", "tail_len", "tail_crc")), seq.tolist(), offset.tolist(), strict=True)):
                pieces = [(w * window, window, crc, f + w, 0) for w, crc in enumerate(crcs[i])]
                if k:
                    start, fits = n - k, window - o
                    if k <= fits:
                        pieces.append((start, k, c, s, o))
                    else:
                        raw = tails[i].as_py()
                        ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * k else "<u4").astype("<u4").tobytes()
                        pieces.append((start, fits, zlib.crc32(ids[: 4 * fits]), s, o))
                        pieces.append((start + fits, k - fits, zlib.crc32(ids[4 * fits :]), s + 1, 0))
                for p in pieces:
                    source.append(i)
                    for column, value in zip(out, (p[0], p[1], p[2], n, p[3], p[4]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([col["doc_id"].take(pa.array(source, pa.int64())), *(pa.array(c, pa.int64()) for c in out)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_path: str | None = None, ranks_path: str | None = None, window: int = 1024, separator: int = 0) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    spark = docs.sparkSession
    ship_package(spark)
    files = [open(p, "rb").read() for p in (tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))]
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, pid int, doc_tokens long, full_at long, full_crc array<long>, tail_len int, place long, tail_crc long, tail binary"
    tokens = materialize(docs.select("doc_id", "text").mapInArrow(_tokenise(Shared(spark, files), window, separator), schema), "tails")

    # How many tails of each length, and whole windows (as length 0), come before a task's own.
    counts = tokens.groupBy("pid", "tail_len").agg(F.count("*").alias("n"), F.sum(F.size("full_crc")).alias("n_full"))
    whole = counts.groupBy("pid").agg(F.sum("n_full").alias("n")).select("pid", F.lit(-1).alias("tail_len"), "n")
    each = materialize(counts.select("pid", "tail_len", "n").unionByName(whole), "counts")
    histogram = {r["tail_len"]: r["n"] for r in each.groupBy("tail_len").agg(F.sum("n").alias("n")).collect()}
    n_full = histogram.pop(-1, 0)
    histogram.pop(0, None)
    layout = Shared(spark, Layout(histogram, window, n_full))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("tail_len").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    based = each.withColumn("base", before)
    few = each.count() <= BROADCAST_ROWS
    bases = based.where("tail_len >= 0").select("pid", "tail_len", "base")
    fulls = based.where("tail_len = -1").select("pid", F.col("base").alias("full_base"))
    if few:
        bases, fulls = F.broadcast(bases), F.broadcast(fulls)
    placed = tokens.join(bases, ["pid", "tail_len"]).join(fulls, "pid").select("doc_id", "doc_tokens", (F.col("full_base") + F.col("full_at")).alias("full_seq"), "full_crc", "tail_len", (F.col("base") + F.col("place")).alias("rank"), "tail_crc", "tail")
    return placed.mapInArrow(_place(layout, window), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
