"""Token counts by a map-side two-tier lookup (no pre-token is ever shuffled).

A pre-token is a run of word-boundary marks with the characters up to the next mark.  No piece of the
vocabulary spans the start of such a run, so a text's token count is the sum of its pre-tokens' counts.

* Tier 1: a broadcast table ``pre-token -> number of tokens`` of the most frequent pre-tokens.  Every
  task summarises *all* its texts in a bounded counter (lossy counting: rare entries are dropped when it
  fills up) and emits its top ``per_task`` entries; only those bounded summaries are shuffled.  The table
  has at most ``table_size`` entries of at most ``MAX_KEY`` characters, which bounds the broadcast.
* Tier 2: each Python worker encodes the pre-tokens it misses, many in one call of the library, and keeps
  them in a bounded cache that is shared by all tasks of the worker.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows are kept as
they are; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import ship_package

MARK = "▁"
MAX_KEY = 48
CACHE_ENTRIES = 300_000
COUNTER_ENTRIES = 200_000
#: Characters encoded in one call of the library.
CALL_CHARS = 1 << 16

_RUNS = re.compile(r" +[^ ]*")
_WORKER: dict = {}


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens without their first mark, after the mark that the library puts before a text."""
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " in text or text[0] == " ":
        return [x[1:] for x in _RUNS.findall(" " + text)]
    return text.split(" ")


class PieceCounter:
    """Counts the tokens of pre-tokens; encodes all plain ones of a call together."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece of this vocabulary spans pre-tokens")
        self.opens = np.array([p.startswith(MARK) for p in pieces])

    def lengths(self, keys: list[str]) -> dict[str, int]:
        found: dict[str, int] = {}
        plain: list[str] = []
        size = 0
        for key in keys:
            if not key:
                found[key] = 1  # a lone mark, which encode("") wouldn't show
            elif " " in key:
                found[key] = len(self.sp.encode(key))
            else:
                plain.append(key)
                size += len(key) + 1
                if size > CALL_CHARS:
                    self._together(plain, found)
                    plain, size = [], 0
        if plain:
            self._together(plain, found)
        return found

    def _together(self, keys: list[str], found: dict[str, int]) -> None:
        ids = np.asarray(self.sp.encode(" ".join(keys)))
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(keys):
            found.update(zip(keys, np.diff(np.append(starts, len(ids))).tolist(), strict=True))
        else:
            found.update((k, len(self.sp.encode(k))) for k in keys)


def _frequent(per_task: int):
    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update(pre_tokens(text))
                if len(counts) > COUNTER_ENTRIES:
                    least = 1
                    while len(counts) > COUNTER_ENTRIES // 2:
                        least += 1
                        counts = Counter({k: n for k, n in counts.items() if n >= least})
        top = [(k, n) for k, n in counts.most_common(2 * per_task) if len(k) <= MAX_KEY][:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["key", "n"])

    return run


def frequent_lengths(texts: DataFrame, model: bytes, table_size: int, per_task: int) -> dict[str, int]:
    """Tier 1: at most ``table_size`` pre-tokens with their token counts (bounded, collected)."""
    rows = (
        texts.select("text").mapInArrow(_frequent(per_task), "key string, n long")
        .groupBy("key").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "key").limit(table_size).collect()
    )
    return PieceCounter(model).lengths([r["key"] for r in rows])


def _count(shared):
    def run(batches):
        model, table = shared.value
        if _WORKER.get("of") != shared.id:
            _WORKER.update(of=shared.id, counter=PieceCounter(model), table=dict(table))
        counter, known = _WORKER["counter"], _WORKER["table"]
        for batch in batches:
            sizes = []
            for text in batch.column(1).to_pylist():
                if not text:
                    sizes.append(0)
                    continue
                keys = pre_tokens(text)
                missing = set(keys).difference(known)
                extra = {}
                if missing:
                    fresh = counter.lengths(list(missing))
                    if len(known) + len(fresh) > CACHE_ENTRIES:
                        known = _WORKER["table"] = dict(table)
                        fresh = counter.lengths(list(set(keys).difference(known)))
                    extra = {k: n for k, n in fresh.items() if len(k) > MAX_KEY}
                    known.update(fresh)
                sizes.append(sum(map(known.__getitem__, keys)))
                for k in extra:
                    del known[k]
            n_bytes = pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(sizes, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return run


class Shared:
    """A broadcast value and an id under which workers cache what they build from it."""

    def __init__(self, spark, value):
        import uuid

        self.held, self.id = spark.sparkContext.broadcast(value), uuid.uuid4().hex

    @property
    def value(self):
        return self.held.value


def count_tokens(docs: DataFrame, model_path: str | None = None, table_size: int = 32_768, per_task: int = 8_192) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    ship_package(spark)
    with open(model_path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    docs = docs.select("doc_id", "text")
    shared = Shared(spark, (model, frequent_lengths(docs, model, table_size, per_task)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_count(shared), f"doc_id {kind}, n_bytes long, n_tokens long")
