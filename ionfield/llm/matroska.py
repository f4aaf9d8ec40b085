"""Media columns: a Matroska writer and reader.

``encode`` stores bytes losslessly as the samples of an 8-bit mono PCM track: EBML header, Info, Tracks,
Clusters of SimpleBlocks with laced frames, and Cues.  ``packets`` parses variable-length EBML elements,
Clusters, BlockGroups, all four kinds of lacing and Cues into a packet table with tracks, timestamps and
byte ranges.  Elements of unknown size, Void and CRC-32 elements and elements of unknown id are handled.

The query appends zero bytes up to a positive multiple of 64, writes the media column to a table in the shared
folder, reads the payload back through the packet table's byte ranges and computes its features from what it read.

Defined results: null text counts as empty (64 zero bytes are stored); null ids and repeated rows are kept;
an empty table gives an empty result; other columns are ignored; texts of any length are stored whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..storage import materialize, ship_package

# Element ids of the format: fixed values.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, CLUSTER_TIMESTAMP = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0xE7
SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_CLUSTER, REFERENCE = 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF1, 0xFB
SAMPLING, BIT_DEPTH, CHANNELS, AUDIO, CODEC_ID, TRACK_TYPE, TRACK_UID = 0xB5, 0x6264, 0x9F, 0xE1, 0x86, 0x83, 0x73C5
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

RATE, FRAME, LACED, BLOCKS = 8000, 1024, 8, 32


class Packet(NamedTuple):
    track: int
    timestamp: int
    frame: int
    start: int
    size: int
    lacing: str
    keyframe: bool


def vint(value: int, width: int = 0) -> bytes:
    """A size of the least or the given width."""
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag bits and the block's body after them: fixed lacing for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return 0x00, frames[0]
    sizes = [len(f) for f in frames]
    if len(set(sizes)) == 1:
        return 0x04, bytes([len(frames) - 1]) + b"".join(frames)
    heads = [vint(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
        heads.append((b - a + (1 << 7 * n - 1) - 1 | 1 << 7 * n).to_bytes(n, "big"))
    return 0x06, bytes([len(frames) - 1]) + b"".join(heads) + b"".join(frames)


_HEAD = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
_TRACK = element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))))


def encode(payload: bytes) -> bytes:
    """``payload`` as a Matroska file: one track, ``RATE`` samples a second, ``FRAME`` bytes a frame."""
    per_frame = FRAME * 1000 // RATE
    body = [element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"ionfield") + element(0x5741, b"ionfield")) + _TRACK]
    at, cues = len(body[0]), []
    for first in range(0, len(payload), FRAME * LACED * BLOCKS):
        time = first // FRAME * per_frame
        blocks = [unsigned(CLUSTER_TIMESTAMP, time)]
        for start in range(first, min(len(payload), first + FRAME * LACED * BLOCKS), FRAME * LACED):
            stop = min(len(payload), start + FRAME * LACED)
            flags, data = _laced([payload[i : min(i + FRAME, stop)] for i in range(start, stop, FRAME)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", start // FRAME * per_frame - time, 0x80 | flags) + data))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, time) + element(CUE_POSITIONS, unsigned(0xF7, 1) + unsigned(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(body))


def _ident(data: bytes, at: int) -> tuple[int, int]:
    n = 9 - data[at].bit_length()
    return int.from_bytes(data[at : at + n], "big"), at + n


def _size(data: bytes, at: int) -> tuple[int, int]:
    """The size, -1 if unknown, and where it ends."""
    n = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + n], "big") & (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def _block(data: bytes, start: int, end: int, base: int, keyframe: bool | None) -> list[Packet]:
    track, at = _size(data, start)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    kind = flags >> 1 & 3
    key = bool(flags & 0x80) if keyframe is None else keyframe
    if not kind:
        return [Packet(track, base + relative, 0, at, end - at, "none", key)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:  # Xiph: sums of bytes, each list ended by one below 255
        for _ in range(n - 1):
            total = 0
            while data[at] == 255:
                total, at = total + 255, at + 1
            sizes.append(total + data[at])
            at += 1
    elif kind == 3 and n > 1:  # EBML: a size, then signed differences
        size, at = _size(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            step, at = _size(data, at)
            step = (1 << 7 * width) - 1 if step < 0 else step
            sizes.append(sizes[-1] + step - ((1 << 7 * width - 1) - 1))
    elif kind == 2:
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing runs past its block")
    out = []
    for i, size in enumerate(sizes):
        out.append(Packet(track, base + relative, i, at, size, ("", "xiph", "fixed", "ebml")[kind], key))
        at += size
    return out


def packets(data: bytes) -> tuple[list[Packet], list[tuple[int, int]], dict[int, bytes]]:
    """The packet table, cues as (time, absolute position of the cluster), and the tracks' and info's leaves."""
    out: list[Packet] = []
    cues: list[tuple[int, int]] = []
    leaves: dict[int, bytes] = {}
    segment = base = 0
    cue = [0, 0]
    first, referring = 0, False  # the open block group: its first packet, whether it refers to another block
    stack = [(0, len(data), 0)]
    while stack:
        at, end, parent = stack.pop()
        while at < end:
            ident, after = _ident(data, at)
            if parent == CLUSTER and ident in TOP_LEVEL:  # ends a cluster of unknown size
                break
            size, body = _size(data, after)
            stop = end if size < 0 else min(end, body + size)
            if ident in MASTERS:
                if ident == SEGMENT:
                    segment = body
                if ident == CLUSTER and size < 0:
                    stop = _cluster_end(data, body, end)
                stack.append((stop, end, parent))
                if ident == BLOCK_GROUP:
                    first, referring = len(out), False
                at, end, parent = body, stop, ident
                continue
            if ident == CLUSTER_TIMESTAMP:
                base = int.from_bytes(data[body:stop], "big")
            elif ident == SIMPLE_BLOCK:
                out += _block(data, body, stop, base, None)
            elif ident == BLOCK:
                out += _block(data, body, stop, base, not referring)
            elif ident == REFERENCE and parent == BLOCK_GROUP:  # before or after the group's block: not a key frame
                out[first:] = [p._replace(keyframe=False) for p in out[first:]]
                referring = True
            elif ident == CUE_TIME:
                cue[0] = int.from_bytes(data[body:stop], "big")
            elif ident == CUE_CLUSTER:
                cues.append((cue[0], segment + int.from_bytes(data[body:stop], "big")))
            elif parent in (INFO, TRACK_ENTRY, AUDIO):
                leaves[ident] = data[body:stop]
            at = stop
    return out, cues, leaves


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, after = _ident(data, at)
        if ident in TOP_LEVEL:
            return at
        size, body = _size(data, after)
        at = body + max(size, 0)
    return end


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes(64 * max(1, -(-len(raw) // 64)) - len(raw))


def features(payload: bytes, table: list[Packet]) -> str:
    x = np.frombuffer(payload, np.uint8)
    n = len(x)
    total = int(x.sum(dtype=np.int64))
    square = int(np.dot(x.astype(np.int64), x.astype(np.int64)))
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    return f"packets={len(table)};ms={n * 1000 // RATE};last={table[-1].timestamp};mean={total / n:.6f};rms={(square / n) ** 0.5:.6f};crossings={crossings}"


def _encode(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            made = [padded(t) for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for n, _ in made], pa.int64()), pa.array([encode(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"])


def encode_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded payload as a Matroska file."""
    ship_package(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_encode, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def _packet_rows(batches):
    for batch in batches:
        for ident, media in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            table = packets(media)[0] if media else []
            yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(table), batch.schema.types[0]), *(pa.array([p[i] for p in table], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", *Packet._fields])


def packet_table(media: DataFrame) -> DataFrame:
    """A row per packet of (doc_id, media): track, timestamp, frame, start, size, lacing, keyframe."""
    ship_package(media.sparkSession)
    return media.select("doc_id", "media").mapInArrow(_packet_rows, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, track int, timestamp long, frame int, start long, size long, lacing string, keyframe boolean")


def _read(batches):
    for batch in batches:
        rows = []
        for media in batch.column(2).to_pylist():
            table, cues, _ = packets(media)
            payload = b"".join([media[p.start : p.start + p.size] for p in table])
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(payload, table), len(table), len(cues)))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "n_cues"])


def store_media(media: DataFrame) -> DataFrame:
    """The media column as a table in the shared folder, read again."""
    return materialize(media, "media", "zstd")


def read_media(media: DataFrame) -> DataFrame:
    """Digests and features of the payloads of (doc_id, n_bytes, media), read through their packet tables."""
    ship_package(media.sparkSession)
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, n_cues long")
