"""WARC archives with payload-identical revisits and an externally merged capture index.

``write_archives`` puts a gzip member per capture into archives of bounded size (a table of binary rows in
the shared folder, committed by Spark).  ``read_archives`` parses them again; the captures of one archive,
sorted by (URL key, timestamp), are one run.  ``merge_runs`` deals the runs' entries to key ranges, as many as
the number of entries asks for, and merges the runs' pieces of a range with a loser tree.  A piece stays in its
Arrow batches, and only the front of each is unpacked.  Ranges may cut a URL's history (the timestamp is part of
the range key), so that one URL may hold any share of the rows; the ranks of a cut history are joined by a
summary of one row per range.

Revisits: of records with equal payloads of at least ``min_revisit`` bytes the one with the largest page_id
is the response.  Defined results: null html counts as empty; null page_ids are smaller than any other, and
are responses where a payload's page_ids are all null; every record with the largest page_id is a response
(repeated rows); null urls have the empty key; ties of key, time and page_id keep the order of archives and
offsets; an empty table gives an empty result; other columns are ignored.  A page is captured ``EPOCH`` plus
page_id seconds, held within the years 1 to 9999 (beyond them captures share a time and are ordered by page_id).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from datetime import datetime, timedelta, timezone

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, ship_package

EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
ARCHIVE_BYTES = 4 << 20
#: Duplicated payloads up to which their table is broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
#: Entries of a key range aimed at (some 200 bytes each).
RANGE_ENTRIES = 200_000
FIRST, LAST = datetime(1, 1, 1, tzinfo=timezone.utc), datetime(9999, 12, 31, 23, 59, 59, tzinfo=timezone.utc)

ENTRY = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, captured_at string, archive string, offset long, size long, run_row long"
#: What the merge adds: place in the range, and in the part of the URL's history that lies in it.
MERGED = ENTRY + ", part int, row long, rank long"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, scheme, ``www``, default port and fragment dropped."""
    if not url:
        return ""
    rest = url.split("#", 1)[0]
    rest = rest.split("://", 1)[-1]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host, _, port = host.partition(":")
    labels = host.split(".")
    if labels[0] == "www":
        labels = labels[1:]
    return ",".join(reversed(labels)) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path


def _clean(url: str) -> str:
    return "".join(c if 32 < ord(c) != 127 else f"%{ord(c) % 256:02X}" for c in url)


def captured(page_id: int | None) -> str:
    """The page's capture time."""
    seconds = min(max(page_id or 0, int((FIRST - EPOCH).total_seconds())), int((LAST - EPOCH).total_seconds()))
    return (EPOCH + timedelta(seconds=seconds)).isoformat()[:19] + "Z"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    when = captured(page_id)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {when}", "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append("WARC-Target-URI: " + _clean(url))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches):
    pid, made, parts, size = TaskContext.get().partitionId(), 0, [], 0

    def archive():
        return pa.RecordBatch.from_arrays([pa.array([f"{pid:07d}-{made:06d}"]), pa.array([b"".join(parts)], pa.binary())], names=["archive", "content"])

    for batch in batches:
        rows = zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)
        for page_id, url, html, digest, response in rows:
            revisit = response is not None and response != page_id
            parts.append(_member(record(page_id, url, (html or "").encode(), digest, response, revisit)))
            size += len(parts[-1])
            if size >= ARCHIVE_BYTES:
                yield archive()
                made, parts, size = made + 1, [], 0
    if parts:
        yield archive()


def write_archives(pages: DataFrame, min_revisit: int = 1000) -> DataFrame:
    """(archive, content) of pages (page_id, url, html), in the shared folder."""
    ship_package(pages.sparkSession)
    raw = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    pages = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(raw).alias("digest"), F.length(raw).alias("n"))
    copies = pages.where(F.col("n") >= min_revisit).groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("copies")).where("copies > 1").select("digest", "response")
    copies = materialize(copies, "copies")
    if copies.count() <= BROADCAST_ROWS:
        copies = F.broadcast(copies)
    joined = pages.join(copies, "digest", "left").select("page_id", "url", "html", "digest", "response")
    return materialize(joined.mapInArrow(_write, "archive string, content binary"), "archives")


def parse(content: bytes):
    """Yields (offset, size, headers, block) of an archive's records."""
    at = 0
    while at < len(content):
        z = zlib.decompressobj(31)
        data = z.decompress(memoryview(content)[at:])
        size = len(content) - at - len(z.unused_data)
        split = data.index(b"\r\n\r\n")
        lines = data[:split].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        yield at, size, headers, data[split + 4 : split + 4 + int(headers["Content-Length"])]
        at += size


def _page(value: str | None) -> int | None:
    return int(value[len("<urn:page:") : -1]) if value and value != "<urn:page:None>" else None


def captures(archive: str, content: bytes) -> list[tuple]:
    """The archive's run: its index entries, sorted by URL key, timestamp and page_id."""
    found = []
    for offset, size, headers, block in parse(content):
        stated = base64.b32decode(headers["WARC-Payload-Digest"].split(":", 1)[1]).hex()
        kind = headers["WARC-Type"]
        if kind == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            digest, n = hashlib.sha1(payload).hexdigest(), len(payload)
            if digest != stated:
                raise ValueError(f"{archive} at {offset}: the payload doesn't have its digest")
        else:
            digest, n = stated, int(headers["X-Payload-Length"])
        found.append((_page(headers.get("WARC-Record-ID")), n, digest, kind, _page(headers.get("WARC-Refers-To")), url_key(headers.get("WARC-Target-URI")), headers["WARC-Date"], archive, offset, size))
    found.sort(key=_order)
    return [(*e, i) for i, e in enumerate(found)]


def _order(entry: tuple) -> tuple:
    return entry[5], entry[6], -1 if entry[0] is None else entry[0], entry[7], entry[8]


_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
_NAMES = [x.split()[0] for x in ENTRY.split(", ")]


def _rows(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in entries], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def _runs(batches):
    for batch in batches:
        for archive, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield _rows(captures(archive, content))


def read_archives(archives: DataFrame) -> DataFrame:
    """Index entries of (archive, content): one locally sorted run per archive."""
    ship_package(archives.sparkSession)
    return archives.select("archive", "content").mapInArrow(_runs, ENTRY)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, the root's winner goes
    out, and only the winner's path to the root is replayed (log2 k comparisons an entry)."""

    def __init__(self, runs, key):
        self.runs, self.key = [iter(r) for r in runs], key
        self.heads = [self._next(i) for i in range(len(self.runs))]
        k = max(1, len(self.runs))
        self.tree = [-1] * k
        for i in range(len(self.runs)):
            self._replay(i)

    def _next(self, i):
        entry = next(self.runs[i], None)
        return None if entry is None else (self.key(entry), i, entry)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or x[:2] < y[:2])

    def _replay(self, i: int) -> None:
        node = (i + len(self.tree)) // 2
        while node > 0:
            if self.tree[node] < 0:  # while the tree is built: wait here for the opponent
                self.tree[node] = i
                return
            if self._before(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs:
            i = self.tree[0]
            if self.heads[i] is None:
                return
            yield self.heads[i][2]
            self.heads[i] = self._next(i)
            self._replay(i)


def pieces(batches: list) -> list[list]:
    """Slices of the batches, grouped by run: (archive, run_row) ascend along each group.  A shuffle may hand over
    a run's blocks in any order; each ascending stretch is then a run of its own."""
    open_runs: dict[str, tuple[int, list]] = {}
    out = []
    for batch in batches:
        archive, row = batch.column(7).dictionary_encode(), batch.column(10).to_numpy()
        code = archive.indices.to_numpy()
        cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(row) <= 0)) + 1
        for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if stop == start:
                continue
            name = archive.dictionary[int(code[start])].as_py()
            last, run = open_runs.get(name, (-1, None))
            if run is None or row[start] <= last:
                run = []
                out.append(run)
            run.append(batch.slice(start, stop - start))
            open_runs[name] = (int(row[stop - 1]), run)
    return out


def _unpacked(run: list):
    for batch in run:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _merge(batches):
    part = TaskContext.get().partitionId()
    row, rank, key = 0, 0, None
    out: list[tuple] = []

    def packed():
        columns = [pa.array([e[i] for e in out], t) for i, t in enumerate((*_TYPES, pa.int32(), pa.int64(), pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, names=[*_NAMES, "part", "row", "rank"])

    for entry in LoserTree([_unpacked(r) for r in pieces(list(batches))], _order):
        rank = rank + 1 if entry[5] == key else 1
        key = entry[5]
        out.append((*entry, part, row, rank))
        row += 1
        if len(out) == 8192:
            yield packed()
            out = []
    if out:
        yield packed()


def merge_runs(entries: DataFrame, partitions: int | None = None) -> DataFrame:
    """All entries in order of (url_key, captured_at, page_id): ranges in order, each merged from its runs, with
    the place in its range and in the part of its URL's history that lies there."""
    n = partitions or max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-entries.count() // RANGE_ENTRIES))
    return entries.select(*_NAMES).repartitionByRange(n, "url_key", "captured_at", "page_id", "archive", "offset").mapInArrow(_merge, MERGED)


def _offsets(merged: DataFrame) -> list[tuple[int, int, str, int]]:
    """(part, entries before it, its first key, that key's entries before it), a row per range."""
    summary = merged.groupBy("part").agg(F.count("*").alias("n"), F.min_by("url_key", "row").alias("first"), F.max_by(F.struct("url_key", "rank"), "row").alias("last")).orderBy("part").collect()
    out, before, key, seen = [], 0, None, 0
    for r in summary:
        out.append((r["part"], before, r["first"], seen if r["first"] == key else 0))
        # rank starts again at each range, so a range of one key only adds to it
        seen = r["last"]["rank"] + (seen if r["first"] == key == r["last"]["url_key"] else 0)
        before, key = before + r["n"], r["last"]["url_key"]
    return out


def capture_histories(pages: DataFrame, min_revisit: int = 1000, partitions: int | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back, merge the runs: the globally ordered index, with each capture's
    ``position`` in it (from 0) and ``capture_rank`` in its URL's history (from 1)."""
    entries = materialize(read_archives(write_archives(pages, min_revisit)), "runs")
    merged = materialize(merge_runs(entries, partitions), "merged")
    offsets = merged.sparkSession.createDataFrame(_offsets(merged), "part int, before long, first string, seen long")
    placed = merged.join(F.broadcast(offsets), "part")  # one row per range
    rank = F.col("rank") + F.when(F.col("url_key") == F.col("first"), F.col("seen")).otherwise(0)
    return placed.select(*_NAMES[:-1], (F.col("row") + F.col("before")).alias("position"), rank.alias("capture_rank"))
