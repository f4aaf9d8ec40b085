"""Benchmark decontamination by the q-gram lemma with banded verification.

Texts and items are lower-cased and their white space made single spaces.  An item of m characters may be
found with k = ``rate`` * m edits.  An alignment with k edits keeps at least m - q + 1 - k * q of the item's
q-grams, on diagonals (text position minus item position) that span at most k + 1: so shared q-grams are
counted in overlapping bands of 2 (k + 1) diagonals at steps of k + 1, bands that reach the bound are
retained, and each retained region is verified by an edit-distance alignment inside its band.

Items too short for the lemma with their whole budget at q = 8 are sought with q = 4, which bears it from 4
characters on (below 10 the budget is no edit); shorter ones by plain containment.

The items are broadcast in blocks of about ``block_chars`` characters, whatever their number, one block after
the other on the driver; all rows are searched against every block.  Shared grams are counted in portions of
``PAIRS`` (position, posting) pairs, so that runs of one character take time but no memory.  Defined results:
null or blank texts and items match nothing; every id of equal items (after normalising) is reported, whatever
block it is in, and an id with one text twice once; ids may have any type; null ids and repeated rows are
searched like others; an empty table gives an empty result; extra columns stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..storage import ship_package
from .token_counts import Shared

Q, SHORT_Q = 8, 4
RATE = 0.1
LEAST_GRAMS = 3
BLOCK_CHARS = 8 << 20
#: Characters of text searched at once.
PART_CHARS = 1 << 20
#: Pairs of a text position and an item posting held at once, and candidate regions verified at once.
PAIRS, REGIONS = 1 << 20, 1 << 10
BITS = 22
# Odd multipliers of the rolling and the bucket hash.
BASE, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def normalise(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(points: np.ndarray, q: int = Q) -> np.ndarray:
    """Hashes of all windows of q characters (q a power of two), by doubling."""
    h, base, width = points.astype(np.uint64), BASE, 1
    while width < q:
        if len(h) <= width:
            return np.empty(0, np.uint64)
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        width *= 2
    return h * np.uint64(MIX)


def budgets(m: np.ndarray, rate: float, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Edits allowed for items of m characters, and whether the lemma at q bears them."""
    k = (rate * m).astype(np.int64)
    return k, (m >= q) & ((k == 0) | (m - q + 1 - k * q >= LEAST_GRAMS))


class ItemIndex:
    """The items by length: long ones at q = 8, short ones at q = 4, tiny ones for containment."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        found: dict[str, list] = {}
        for ident, text in items:
            text = normalise(text)
            if text and ident not in found.setdefault(text, []):
                found[text].append(ident)
        self.ids, texts = list(found.values()), list(found)
        m = np.array([len(t) for t in texts], dtype=np.int64)
        self.k, long = budgets(m, rate, Q)
        short = budgets(m, rate, SHORT_Q)[1] & ~long
        self.parts = [GramIndex([(i, texts[i]) for i in np.flatnonzero(of)], self.k[of], q) for q, of in ((Q, long), (SHORT_Q, short)) if of.any()]
        self.tiny = [(i, texts[i]) for i in np.flatnonzero(~long & ~short)]

    def search(self, texts: list[str | None]) -> list[list[tuple]]:
        """Per text: (item id, edits, item's length, region's start, end), the best region of each item."""
        out: list[list[tuple]] = [[] for _ in texts]
        part, index, size = [], [], 0

        def flush():
            for grams_of in self.parts:
                grams_of.search(part, index, out)

        for i, text in enumerate(texts):
            text = normalise(text)
            for item, tiny in self.tiny:
                at = text.find(tiny)
                if at >= 0:
                    out[i].append((item, 0, len(tiny), at, at + len(tiny)))
            part.append(text)
            index.append(i)
            size += len(text) + 1
            if size >= PART_CHARS:
                flush()
                part, index, size = [], [], 0
        flush()
        return [[(ident, *rest) for item, *rest in found for ident in self.ids[item]] for found in out]


class GramIndex:
    """Postings of (number, text) items' q-grams."""

    def __init__(self, items: list[tuple], k: np.ndarray, q: int):
        self.q, self.k = q, k
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.m = m = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.bound = np.maximum(1, m - q + 1 - k * q)
        each = [grams(codes(t), q) for t in self.texts]
        code = np.concatenate(each)
        item = np.repeat(np.arange(len(each)), [len(e) for e in each])
        place = np.concatenate([np.arange(len(e)) for e in each])
        order = np.argsort(code, kind="stable")
        self.item, self.place = item[order], place[order]
        self.code, self.first, self.count = np.unique(code[order], return_index=True, return_counts=True)
        self.present = np.zeros(1 << BITS, dtype=bool)
        self.present[self.code >> np.uint64(64 - BITS)] = True

    def search(self, texts: list[str], index: list[int], out: list[list[tuple]]) -> None:
        points = codes("\n".join(texts))  # the joint is in no item, so no gram spans two texts
        h = grams(points, self.q)
        at = np.flatnonzero(self.present[h >> np.uint64(64 - BITS)])
        if not len(at):
            return
        j = np.searchsorted(self.code, h[at])
        j[j == len(self.code)] = 0
        same = self.code[j] == h[at]
        at, j = at[same], j[same]
        if not len(at):
            return
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        few, many = len(self.ids), len(texts)
        keys, hits = np.empty(0, np.int64), np.empty(0, np.int64)
        for block, hit in self._bands(at, j, starts, many):
            key, where = np.unique(np.concatenate([keys, block]), return_inverse=True)
            hits = np.bincount(where, np.concatenate([hits, hit]), len(key)).astype(np.int64)
            keys = key
        doc, item = keys % many, keys // many % few
        kept = hits >= self.bound[item]
        doc, item, band = doc[kept], item[kept], keys[kept] // many // few
        for i in np.unique(item):
            mine = np.flatnonzero(item == i)
            m, k = int(self.m[i]), int(self.k[i])
            best: dict[int, tuple] = {}
            for chosen in np.split(mine, range(REGIONS, len(mine), REGIONS)):
                low = band[chosen] * (k + 1) - (1 << 20)
                edits, end = align(codes(self.texts[i]), points, low - k, 4 * k + 2, starts[doc[chosen]], starts[doc[chosen] + 1] - 1, k)
                for d, e, stop in zip(doc[chosen].tolist(), edits.tolist(), end.tolist(), strict=True):
                    if e <= k and (d not in best or (e, stop) < best[d]):
                        best[d] = (e, stop)
            for d, (e, stop) in best.items():
                stop -= int(starts[d])
                out[index[d]].append((self.ids[i], e, m, max(0, stop - m - e), stop))

    def _bands(self, at: np.ndarray, j: np.ndarray, starts: np.ndarray, many: int):
        """Distinct keys (band, item, text) and their shared grams, a bounded portion of the pairs at a time."""
        n, few = self.count[j], len(self.ids)
        ends = np.cumsum(n)
        first, done = 0, 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, done + PAIRS, side="right")))
            c, where = n[first:last], j[first:last]
            posting = np.repeat(self.first[where] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
            item, position = self.item[posting], np.repeat(at[first:last], c)
            doc = np.searchsorted(starts, position, side="right") - 1
            band = (position - self.place[posting] + (1 << 20)) // (self.k[item] + 1)
            key = (band * few + item) * many + doc
            yield np.unique(np.concatenate([key, key - few * many]), return_counts=True)  # the band and the one before
            first, done = last, int(ends[last - 1])


def align(item: np.ndarray, points: np.ndarray, low: np.ndarray, width: int, start: np.ndarray, stop: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of the whole item against a part of the text, over the diagonals low .. low + width - 1,
    and where that part ends; one row per candidate, stopped where all are beyond k."""
    n, far = len(low), 1 << 20
    columns = np.arange(width)
    at = low[:, None] + columns  # text position before which i item characters end, for i = 0
    cost = np.where((at >= start[:, None]) & (at <= stop[:, None]), 0, far)
    for i, c in enumerate(item):
        here = at + i
        inside = (here >= start[:, None]) & (here < stop[:, None])
        differs = points[np.clip(here, 0, len(points) - 1)] != c
        same = np.where(inside, cost + differs, far)  # text position here, on the same diagonal
        skip = np.full((n, width), far)
        skip[:, :-1] = cost[:, 1:] + 1  # the item's character left out
        best = np.minimum(same, skip)
        valid = (here + 1 >= start[:, None]) & (here + 1 <= stop[:, None])
        best = np.where(valid, best, far)
        best = np.minimum.accumulate(best - columns, axis=1) + columns  # the text's characters left out
        cost = np.where(valid, best, far)
        if cost.min() > k:
            return np.full(n, far), np.zeros(n, dtype=np.int64)
    j = cost.argmin(axis=1)
    return cost[np.arange(n), j], at[np.arange(n), j] + len(item)


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """Yields the items in blocks of about so many characters; one block where all fit."""
    items = benchmark.select("item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r[0], r[1]) for r in part.collect()]


def _hits(index, kind):
    def run(batches):
        for batch in batches:
            rows = [(i, *h) for i, found in enumerate(index.value.search(batch.column(1).to_pylist())) for h in found]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([r[1] for r in rows], kind), *(pa.array([r[c] for r in rows], pa.int64()) for c in range(2, 6))], names=["doc_id", "item_id", "edits", "item_chars", "region_start", "region_end"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """(doc_id, item_id, edits, item_chars, region_start, region_end) for each row and item that it holds;
    the region is in characters of the normalised text."""
    spark = docs.sparkSession
    ship_package(spark)
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    out = None
    for items in item_blocks(benchmark):
        index = Shared(spark, ItemIndex(items, rate))
        found = docs.select("doc_id", "text").mapInArrow(_hits(index, to_arrow_type(item)), f"doc_id {kind}, item_id {item.simpleString()}, edits long, item_chars long, region_start long, region_end long")
        out = found if out is None else out.unionByName(found)
    return out


def _clean(index, at: int):
    def run(batches):
        for batch in batches:
            found = index.value.search(batch.column(at).to_pylist())
            yield batch.filter(pa.array([not f for f in found], pa.bool_()))

    return run


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item (map-only: ids needn't be unique)."""
    ship_package(docs.sparkSession)
    out = docs
    for items in item_blocks(benchmark):
        index = Shared(docs.sparkSession, ItemIndex(items, rate))
        out = out.mapInArrow(_clean(index, docs.columns.index("text")), docs.schema)
    return out
