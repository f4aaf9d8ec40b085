import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ionfield.llm import simhash
from tests.llm.conftest import clashing, docs_frame


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def check(spark, rows, frame=None):
    out = simhash.near_duplicates(frame if frame is not None else docs_frame(spark, rows)).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    roots = slow_components(prints)
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    expected = sorted(((-1 if i is None else i), f"{p:016x}", least.get(r)) for (i, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted(((-1 if r["doc_id"] is None else r["doc_id"]), r["fingerprint"], r["component_id"]) for r in out) == expected


def test_odd_documents(spark, odd_docs):
    check(spark, odd_docs, clashing(spark, odd_docs))


def test_near_copies_and_chains(spark, words):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(words) for _ in range(250)]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            n += 1
            rows.append((n, " ".join(copy)))
    rng.shuffle(rows)
    check(spark, rows)


@pytest.mark.parametrize("cell_rows", [None, 200])
def test_tree_finds_every_link(spark, monkeypatch, cell_rows):
    """Random points, tight clusters and chains; small cells, so that trees are deep, or cells that are refitted."""
    rng = np.random.default_rng(5)
    points = set(rng.integers(0, 2**63, 3000, dtype=np.uint64).tolist())
    for c in rng.integers(0, 2**63, 12, dtype=np.uint64).tolist():
        for _ in range(250):
            p = c
            for b in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                p ^= 1 << b
            points.add(p)
    fps = np.array(sorted(points), dtype=np.uint64)
    monkeypatch.setattr(simhash, "CELL", 100 if cell_rows is None else 4000)
    monkeypatch.setattr(simhash, "TASK_ROWS", 3000)
    refits, refit = [], simhash._deal_again
    monkeypatch.setattr(simhash, "_deal_again", lambda shared: refits.append(shared) or refit(shared))
    edges = simhash.near_edges(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), cell_rows=cell_rows)
    assert bool(refits) == (cell_rows is not None)
    index = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    pairs = [(index[r["src"]], index[r["dst"]]) for r in edges.collect()]
    got = simhash.components_of(len(fps), np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    a, b = [], []
    for i in range(len(fps)):
        j = np.flatnonzero(np.bitwise_count(fps[i] ^ fps[i + 1 :]) <= 3) + i + 1
        a += [i] * len(j)
        b += j.tolist()
    assert np.array_equal(got, simhash.components_of(len(fps), np.array(a), np.array(b)))
    assert len(pairs) < 60 * len(fps)


def test_triangle_bounds():
    rng = np.random.default_rng(6)
    points = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for half in simhash.HALVES:
        tree = simhash.VantageTree(points, half, 50)
        index, cell, home = tree.deal(points)
        assert np.bincount(index[home], minlength=len(points)).tolist() == [1] * len(points)
        where = dict(zip(index[home].tolist(), cell[home].tolist(), strict=True))
        visits = set(zip(index.tolist(), cell.tolist(), strict=True))
        for i in range(0, 300):
            bit = int(rng.integers(0, 64))
            q = points[i] ^ np.uint64(1 << bit)
            if (int(q) ^ int(points[i])) & int(half):
                qi, qc, _ = tree.deal(np.array([q]))
                assert where[i] in set(qc.tolist()) and (i, where[i]) in visits


def test_keep_one(spark, odd_docs):
    frame = clashing(spark, odd_docs)
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert ids.count(7) == 1 and 8 not in ids and ids.count(13) == 1 and None in ids and 1 in ids and 2 not in ids
    assert simhash.keep_one(frame.where(F.lit(False))).collect() == []


def test_empty(spark):
    assert simhash.near_duplicates(docs_frame(spark, [])).collect() == []
