"""SimHash near-duplicates through vantage-point trees over Hamming space.

Fingerprints are made per document; equal ones are merged before anything else.  Two fingerprints that differ
in at most ``RADIUS`` = 3 bits differ in at most one bit of their upper or of their lower half, so two trees,
one per half, find every link.  A tree's inner node holds a vantage point, a mask, a threshold and a radius;
the distance under a mask is a metric that never exceeds the full one, so the triangle inequality prunes:
points within the threshold go inside, and a query at distance d must visit the inside if d - radius <=
threshold and the outside if d + radius > threshold.  Masks are the tree's half (radius 1), the other half
and all bits (radius 3): full-width nodes go on splitting cells whose halves are equal (large groups of near
copies).  Of the candidates at a node the one that sends the fewest sample points to both sides is taken.

The trees are fitted on a bounded sample (``sample_size`` fingerprints of smallest hash; the bound is 512 KB);
every fingerprint is then dealt to its home cell and, as a query, to the cells its ball overlaps.  Cells that got
more than ``cell_rows`` are refitted on about ``REFIT`` of their own fingerprints each and dealt again, for as long
as that splits them.  There are as many tasks as the dealt rows ask for; a task holds one cell at a time, searches
it with a further, local tree down to leaves compared in full, and gives only a spanning star of each local
component: never all pairs.  Components are then joined across cells without the driver.

Defined results: null or blank text has fingerprint zero, linked like any other; null ids stay in the result
and never name a component that has another id; repeated rows are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..storage import materialize, ship_package
from .token_counts import Shared

RADIUS = 3
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
#: Fingerprints in a cell aimed at, and in a leaf of the local search.
CELL, LEAF = 2048, 512
#: Rows beyond which a cell is refitted, sample of a refit, refits in a row, and dealt rows of a task.
CELL_ROWS, REFIT, LEVELS, TASK_ROWS = 1 << 18, 512, 6, 1 << 19


def fingerprint(text: str | None) -> int:
    """64 bits, unsigned: bit b is set if over half of the hashes of all 3-word shingles have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= 3:
        return xxhash.xxh64_intdigest(line, 42)
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    starts = [0, *(gaps[:-2] + 1).tolist()]
    ends = [*gaps[2:].tolist(), len(line)]
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)])
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
    set_in = np.add.reduce(bits, axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(set_in * 2 > len(starts)).tobytes(), "big")


def _fingerprints(batches):
    for batch in batches:
        made = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint's bits as a signed long."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def distance(points: np.ndarray, vantage, mask) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & mask)


class VantageTree:
    """Nodes (vantage, mask, radius, threshold, inside, outside); a negative child ~c is cell c."""

    def __init__(self, sample: np.ndarray, own: np.uint64, leaf: int, seed: int = 7):
        self.nodes: list[tuple] = []
        self.cells = 0
        self.leaf, self.own, self.rng = max(1, leaf), own, np.random.default_rng(seed)
        self.root = self._grow(sample, 0)

    def _grow(self, points: np.ndarray, depth: int) -> int:
        best = self._best(points) if len(points) > self.leaf and depth < 48 else None
        if best is None:
            self.cells += 1
            return ~(self.cells - 1)
        _, vantage, mask, radius, threshold = best
        inside = distance(points, vantage, mask) <= threshold
        at = len(self.nodes)
        self.nodes.append(())
        self.nodes[at] = (vantage, mask, radius, threshold, self._grow(points[inside], depth + 1), self._grow(points[~inside], depth + 1))
        return at

    def _best(self, points: np.ndarray):
        best, tried = None, points[:: max(1, len(points) // 2048)]
        other = HALVES[1] if self.own == HALVES[0] else HALVES[0]
        for vantage in self.rng.choice(points, size=min(4, len(points)), replace=False):
            for mask, radius in ((self.own, 1), (ALL, RADIUS), (other, RADIUS)):
                d = distance(tried, vantage, mask).astype(int)
                threshold = int(np.median(d))
                for t in (threshold - 1, threshold):
                    share = np.mean(d <= t)
                    if not 0.1 <= share <= 0.9:
                        continue
                    # Cost of a level: rows that both sides get, over what the split is worth.
                    both = np.mean((d - radius <= t) & (d + radius > t))
                    cost = np.log1p(both) / -(share * np.log(share) + (1 - share) * np.log(1 - share))
                    if both < 0.8 and (best is None or cost < best[0]):
                        best = (cost, vantage, mask, radius, t)
        return best

    def deal(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, cell, whether it is the point's home) for all cells that balls overlap."""
        out = []
        stack = [(self.root, np.arange(len(points)), np.ones(len(points), dtype=bool))]
        while stack:
            at, index, home = stack.pop()
            if not len(index):
                continue
            if at < 0:
                out.append((index, np.full(len(index), ~at, dtype=np.int32), home))
                continue
            vantage, mask, radius, threshold, inside, outside = self.nodes[at]
            d = distance(points[index], vantage, mask).astype(int)
            near, far, own = d - radius <= threshold, d + radius > threshold, d <= threshold
            stack.append((inside, index[near], home[near] & own[near]))
            stack.append((outside, index[far], home[far] & ~own[far]))
        return tuple(np.concatenate([o[i] for o in out]) for i in range(3)) if out else (np.empty(0, int), np.empty(0, np.int32), np.empty(0, bool))


def _deal(trees):
    def run(batches):
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for half, tree in enumerate(trees.value):
                index, cell, home = tree.deal(points)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64) * 2 + half), pa.array(points[index].view(np.int64)), pa.array(home)], names=["cell", "fp", "home"])

    return run


def components_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of n nodes, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        low = np.minimum(la, lb)
        np.minimum.at(label, np.maximum(la, lb), low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def links(points: np.ndarray, queries: np.ndarray, rng) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of fingerprints (a, b) that span, for all queries and points within RADIUS, the same components."""
    found_a, found_b = [], []
    stack = [(points, queries, 0)]
    while stack:
        p, q, depth = stack.pop()
        if not len(p) or not len(q):
            continue
        if len(p) > LEAF and depth < 40:
            vantage = p[rng.integers(len(p))]
            d = distance(p, vantage, ALL).astype(int)
            t = int(np.median(d))
            t = t - 1 if t == d.max() else t
            if d.min() <= t < d.max():
                dq = distance(q, vantage, ALL).astype(int)
                stack.append((p[d <= t], q[dq - RADIUS <= t], depth + 1))
                stack.append((p[d > t], q[dq + RADIUS > t], depth + 1))
                continue
        for at in range(0, len(p), LEAF):
            block = p[at : at + LEAF]
            for qat in range(0, len(q), 4096):
                part = q[qat : qat + 4096]
                near = np.bitwise_count(part[:, None] ^ block[None, :]) <= RADIUS
                hit = near.any(axis=1)
                if not hit.any():
                    continue
                near, part_hit = near[hit], part[hit]
                first = near.argmax(axis=1)
                found_a.append(part_hit)
                found_b.append(block[first])
                for f in np.unique(first):  # points that share a query hang together
                    shared = np.flatnonzero(near[first == f].any(axis=0))
                    found_a.append(block[shared])
                    found_b.append(np.full(len(shared), block[f]))
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    return a[a != b], b[a != b]


def _search(batches):
    """Cells one after the other; the rows are sorted by cell."""
    rng = np.random.default_rng(11)

    def found():
        mine, home = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        a, b = links(mine[home], mine, rng)
        if len(a):
            nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
            label = components_of(len(nodes), index[: len(a)], index[len(a) :])
            apart = label != np.arange(len(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[apart].view(np.int64)), pa.array(nodes[label[apart]].view(np.int64))], names=["src", "dst"])

    held: list[tuple] = []
    for batch in batches:
        cell, fp, home = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
        for at in np.split(np.arange(len(cell)), np.flatnonzero(np.diff(cell)) + 1):
            if not len(at):
                continue
            if held and held[0][0] != cell[at[0]]:
                yield from found()
                held = []
            held.append((cell[at[0]], fp[at], home[at]))
    if held:
        yield from found()


def _deal_again(shared):
    def run(batches):
        trees = shared.value
        for batch in batches:
            cell, points, home = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1):
                if not len(at):
                    continue
                tree, base = trees[int(cell[at[0]])]
                index, inner, own = tree.deal(points[at])
                yield pa.RecordBatch.from_arrays([pa.array(base + 2 * inner.astype(np.int64)), pa.array(points[at][index].view(np.int64)), pa.array(own & home[at][index])], names=["cell", "fp", "home"])

    return run


_DEALT = "cell long, fp long, home boolean"


def _refitted(dealt: DataFrame, cell_rows: int) -> DataFrame:
    """Dealt rows in which cells over ``cell_rows`` are split further where a tree can; no row is lost."""
    spark, done, base = dealt.sparkSession, [], 1 << 32
    for _ in range(LEVELS):
        sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows).collect()}
        if not sizes:
            break
        large = spark.createDataFrame([(c, max(1, n // REFIT)) for c, n in sizes.items()], "cell long, every long")
        rows = dealt.join(F.broadcast(large), "cell")  # at most one row per cell of the trees
        picked: dict[int, list] = {}
        for r in rows.where("pmod(xxhash64(fp), every) = 0").select("cell", "fp").collect():
            picked.setdefault(r["cell"], []).append(r["fp"])
        trees = {}
        for cell, fps in sorted(picked.items()):
            tree = VantageTree(np.array(sorted(set(fps)), dtype=np.int64).view(np.uint64), HALVES[cell % 2], max(4, len(fps) * cell_rows // (4 * sizes[cell])))
            if tree.cells > 1:
                trees[cell] = (tree, base + cell % 2)
                base += 2 * tree.cells
        if not trees:
            break
        split = spark.createDataFrame([(c,) for c in trees], "cell long")
        done.append(dealt.join(F.broadcast(split), "cell", "left_anti").select("cell", "fp", "home"))
        again = dealt.join(F.broadcast(split), "cell", "left_semi").select("cell", "fp", "home")
        dealt = materialize(again.mapInArrow(_deal_again(Shared(spark, trees)), _DEALT), "dealt_again")
    for rows in done:
        dealt = dealt.unionByName(rows)
    return dealt


def near_edges(distinct: DataFrame, sample_size: int = 65_536, cell_rows: int | None = None) -> DataFrame:
    """Spanning edges (src, dst) of the links among the distinct fingerprints of column fp."""
    spark = distinct.sparkSession
    ship_package(spark)
    total = distinct.count()
    picked = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample_size, max(1024, 16 * total // CELL))).collect()
    sample = np.array([r["fp"] for r in picked], dtype=np.int64).view(np.uint64)
    leaf = max(4, CELL * len(sample) // max(1, total))
    trees = Shared(spark, [VantageTree(sample, half, leaf) for half in HALVES])
    dealt = materialize(distinct.select("fp").mapInArrow(_deal(trees), _DEALT), "dealt")
    dealt = _refitted(dealt, cell_rows or CELL_ROWS)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-dealt.count() // TASK_ROWS))
    return dealt.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(_search, "src long, dst long")


def near_duplicates(docs: DataFrame, sample_size: int = 65_536) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text, ...)."""
    made = materialize(fingerprints(docs), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    edges = materialize(near_edges(distinct, sample_size), "links")
    member = connected_components(edges)
    # Only linked fingerprints need a look beyond their own documents.
    linked = distinct.join(member, distinct["fp"] == member["node"]).select("fp", "component", "least")
    smallest = linked.groupBy("component").agg(F.min("least").alias("smallest"))
    over = materialize(linked.join(smallest, "component").select("fp", "smallest"), "components")
    of_fp = distinct.join(over, "fp", "left").select("fp", F.coalesce("smallest", "least").alias("component_id"))
    return made.join(of_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Removed ids up to which they are broadcast (8 bytes each).
BROADCAST_IDS = 500_000


def keep_one(docs: DataFrame, sample_size: int = 65_536) -> DataFrame:
    """docs, with all its columns, with one row of each component: that of the smallest doc_id.

    Rows without an id cannot be told apart and stay; rows that repeat a kept id are one document."""
    found = near_duplicates(docs, sample_size).select("doc_id", "component_id")
    ids = materialize(found.groupBy("doc_id").agg(F.first("component_id").alias("component_id"), F.count("*").alias("n")), "members")
    gone = ids.where("doc_id <> component_id").select("doc_id")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = ids.where("doc_id = component_id and n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
