import collections
import hashlib
import os
import random

import pytest

from ionfield.llm import warc
from ionfield.llm.queries import oracle_sql, queries
from tests.oracle import connect, duck_rows, spark_rows

SCHEMA = "page_id long, url string, html string, digest string, response long, archive string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, "a") for r in rows], SCHEMA)


def test_loser_tree_against_sorted():
    rng = random.Random(0)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randint(0, 30) for _ in range(rng.randint(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert warc.url_key("https://www.Example.com:443/A?b=1#f") == "com,example)/A?b=1"
    assert warc.url_key("http://u@x.org:8080") == "org,x:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("http://a.b?q") == "b,a)?q"


def test_revisits_and_order(spark):
    big, small = "é" * 700, "s" * 10
    rows = [(1, "http://b.org/x", big), (2, "http://a.org/y", big), (3, None, big), (4, "http://a.org/\r\nz", small), (5, "http://c.org", small), (None, "http://d.org", big), (6, "http://e.org", None), (7, "http://e.org", ""), (7, "http://e.org", "")]
    out = warc.capture_histories(pages(spark, rows)).orderBy("position").collect()
    assert len(out) == len(rows)
    assert [(r["url_key"], r["captured_at"]) for r in out] == sorted((r["url_key"], r["captured_at"]) for r in out)
    html = {i: (h or "").encode() for i, _, h in rows}
    for r in out:
        raw = html[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha1(raw).hexdigest())
        revisit = raw == big.encode() and r["page_id"] != 3
        assert (r["record_type"], r["refers_to"]) == (("revisit", 3) if revisit else ("response", None))


def test_payload_without_any_id(spark):
    out = warc.capture_histories(pages(spark, [(None, "u", "x" * 2000)] * 2)).collect()
    assert [r["record_type"] for r in out] == ["response"] * 2


def test_small_archives_and_many_ranges(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randint(0, 5)}.org/{rng.randint(0, 3)}", "p" * rng.randint(0, 3000)) for i in range(300)]
    archives = warc.write_archives(pages(spark, rows).repartition(7))
    assert archives.count() >= 4
    out = warc.merge_runs(warc.read_archives(archives), 5).collect()
    assert [warc._order(tuple(r)) for r in out] == sorted(warc._order(tuple(r)) for r in out) and len(out) == 300
    again = warc.capture_histories(pages(spark, rows), partitions=23).orderBy("position").collect()
    assert [r["position"] for r in again] == list(range(300))
    order = sorted(rows, key=lambda r: (warc.url_key(r[1]), r[0]))
    assert [r["page_id"] for r in again] == [r[0] for r in order]
    ranks = collections.Counter()
    for r in again:
        ranks[r["url_key"]] += 1
        assert r["capture_rank"] == ranks[r["url_key"]]


def test_one_url_may_hold_every_capture(spark):
    rows = [(i, "http://one.org/", "x") for i in range(200)] + [(None, "http://one.org/", "x"), (7, "http://one.org/", "x"), (10**18, "http://two.org/", "x"), (-(10**18), "http://two.org/", "x")]
    out = warc.capture_histories(pages(spark, rows), partitions=9).orderBy("position").collect()
    assert [r["capture_rank"] for r in out] == [*range(1, 203), 1, 2]
    assert [r["page_id"] for r in out[-2:]] == [-(10**18), 10**18] and out[-1]["captured_at"] == "9999-12-31T23:59:59Z" and out[-2]["captured_at"] == "0001-01-01T00:00:00Z"


def test_pieces_ascend_whatever_the_order_of_blocks():
    import pyarrow as pa

    rng = random.Random(3)
    entries = [[(i, 1, "d", "response", None, f"k{rng.randint(0, 9)}", "t", f"a{a}", i, 1) for i in range(40)] for a in range(4)]
    runs = [[(*e, j) for j, e in enumerate(sorted(x, key=warc._order))] for x in entries]
    blocks = [r[at : at + rng.randint(1, 9)] for r in runs for at in range(0, 40, 9)]
    rng.shuffle(blocks)
    batches = [warc._rows(b) for b in blocks]
    found = warc.pieces(batches)
    total = sum(len(b) for b in blocks)
    assert sum(p.num_rows for r in found for p in r) == total and isinstance(batches[0], pa.RecordBatch)
    merged = list(warc.LoserTree([warc._unpacked(r) for r in found], warc._order))
    assert merged == sorted((e for b in blocks for e in b), key=warc._order)


def test_damage_is_seen(spark):
    data = bytearray(warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), None, False))
    at = data.rindex(b"payload")
    data[at] ^= 1
    with pytest.raises(ValueError):
        warc.captures("a", warc._member(bytes(data)))


def test_empty(spark):
    assert warc.capture_histories(pages(spark, [])).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_query_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(queries()["op3_warc"](spark, sf)) == duck_rows(connect(sf), oracle_sql()["op3_warc"])
