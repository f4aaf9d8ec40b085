import random

import numpy as np
import pytest

from ionfield.llm import decontaminate as d
from tests.llm.conftest import clashing, docs_frame


def best_edits(item, text):
    """Least edits of item against any part of text (the full dynamic programme, a row at a time)."""
    t, at = np.array([ord(c) for c in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=int)
    for a in item:
        new = np.concatenate([row[:1] + 1, np.minimum(row[:-1] + (t != ord(a)), row[1:] + 1)])
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def edit(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(1, len(chars) - 1)
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = rng.choice("abcxyz")
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, rng.choice("abcxyz"))
    return "".join(chars)


@pytest.fixture(scope="module")
def case(words):
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(rng.randint(10, 40)).capitalize() + ".") for i in range(15)]
    docs = []
    for i in range(120):
        text = prose(rng.randint(30, 120))
        if i % 3 == 0:
            item = items[i // 3 % 15][1]
            text = text + " " + edit(rng, item, rng.randint(0, len(item) // 8)).replace(" ", "\n  ", 1).upper() + " " + prose(20)
        docs.append((i, text))
    return items, docs


def test_against_brute_force(spark, case):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in d.find_leaks(docs_frame(spark, docs), bench).collect()}
    budget = {j: int(0.1 * len(d.normalise(item))) for j, item in items}
    expected = {}
    for i, text in docs:
        for j, item in items:
            e = best_edits(d.normalise(item), d.normalise(text))
            if e <= budget[j]:
                expected[i, j] = e
    assert {k: r["edits"] for k, r in got.items()} == expected and len(expected) > 20
    texts = dict(docs)
    for (i, j), r in got.items():
        region = d.normalise(texts[i])[r["region_start"] : r["region_end"]]
        assert best_edits(d.normalise(dict(items)[j]), region) == r["edits"]


def test_blocks_of_items_give_the_same(spark, case, monkeypatch):
    items, docs = case
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), docs_frame(spark, docs)
    rows = lambda: sorted(map(tuple, d.find_leaks(frame, bench).collect()))
    one = rows()
    monkeypatch.setattr(d.item_blocks, "__defaults__", (500,))
    assert len(list(d.item_blocks(bench))) > 3 and rows() == one


def test_drop_keeps_clean_rows(spark, case, odd_docs):
    items, docs = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    odd_docs = [(None if i is None else 1000 + i, t) for i, t in odd_docs]
    frame = clashing(spark, docs + odd_docs)
    leaks = {r["doc_id"] for r in d.find_leaks(frame, bench).collect()}
    kept = d.drop_leaks(frame, bench)
    assert kept.columns == frame.columns
    assert sorted(str(r[0]) for r in kept.select("doc_id").collect()) == sorted(str(i) for i, _ in docs + odd_docs if i not in leaks)


def test_odd_items(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "tiny"), (4, "exactly sixteen."), (5, "é日本語 long enough to have some edits in it, yes"), (6, "TINY"), (None, "a passage whose item has no id at all, though it is long")], "item_id long, text string")
    docs = [(1, "so tiny"), (2, "EXACTLY  sixteen. x"), (3, None), (4, "x É日本語 long enough to have sone edits in it, yes."), (None, "a passage whose item has no id at all, though it is long"), (6, "clean")]
    got = {(r["doc_id"], r["item_id"], r["edits"]) for r in d.find_leaks(docs_frame(spark, docs), bench).collect()}
    assert got == {(1, 3, 0), (1, 6, 0), (2, 4, 0), (4, 5, 1), (None, None, 0)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.find_leaks(docs_frame(spark, docs), none).collect() == [] and d.drop_leaks(docs_frame(spark, docs), none).count() == 6
    assert d.find_leaks(docs_frame(spark, []), bench).collect() == []


def test_long_text_over_parts(monkeypatch, words):
    rng = random.Random(9)
    item = " ".join(rng.choice(words) for _ in range(30))
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    index = d.ItemIndex([(1, item)])
    texts = [filler(40_000) + " " + item + " " + filler(40_000), filler(50), item, None, filler(200_000)]
    assert [len(x) for x in index.search(texts)] == [1, 0, 1, 0, 0]
    monkeypatch.setattr(d, "PART_CHARS", 100)
    assert [len(x) for x in index.search(texts)] == [1, 0, 1, 0, 0]


def test_grams_are_of_eight_characters():
    a, b = d.codes("xxabcdefghyy"), d.codes("abcdefgh")
    assert d.grams(b)[0] in d.grams(a).tolist() and len(d.grams(a)) == 5 and len(d.grams(d.codes("short"))) == 0
    assert np.unique(d.grams(d.codes("aaaaaaaaaaaa"))).size == 1


def test_short_items_have_their_whole_budget(words):
    rng = random.Random(21)
    for m in (4, 9, 10, 12, 19, 20, 25, 30, 35, 41, 60):
        item = " ".join(rng.choice(words) for _ in range(30))[:m].strip() + "q" * 9
        item = item[:m]
        k = int(0.1 * m)
        for n in range(k + 2):
            text = " ".join(rng.choice(words) for _ in range(20)) + " " + (edit(rng, item, n) if n else item) + " " + " ".join(rng.choice(words) for _ in range(20))
            least = best_edits(item, d.normalise(text))
            assert [x[1] for x in d.ItemIndex([(1, item)]).search([text])[0]] == ([least] if least <= k else [])


def test_every_id_of_equal_items_is_found_whatever_the_blocks_and_types(spark, monkeypatch):
    text = "one passage that several benchmarks hold, in one wording"
    items = [("a", text), ("b", text.upper()), ("c", "  " + text.replace(" ", "  ")), ("a", text), (None, text)] + [(f"x{i}", f"another item of some length, number {i}") for i in range(20)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    frame = clashing(spark, [(1, "so: " + text + "."), (2, "clean")])
    rows = lambda: sorted((str(r["item_id"]), r["doc_id"], r["edits"]) for r in d.find_leaks(frame, bench).collect())
    one = rows()
    assert one == [("None", 1, 0), ("a", 1, 0), ("b", 1, 0), ("c", 1, 0)]
    monkeypatch.setattr(d.item_blocks, "__defaults__", (100,))
    assert rows() == one


def test_runs_of_one_character_are_counted_in_portions(monkeypatch):
    import tracemalloc

    index = d.ItemIndex([(1, "a" * 500), (2, "the" * 30)])
    few = index.search(["x" + "a" * 3000 + "y"])
    monkeypatch.setattr(d, "PAIRS", 1 << 12)
    assert index.search(["x" + "a" * 3000 + "y"]) == few and few[0][0][:3] == (1, 0, 500)
    monkeypatch.undo()
    tracemalloc.start()
    assert [h[0][1] for h in index.search(["a" * 60_000])] == [0]
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()
