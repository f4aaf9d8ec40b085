"""CSV sources and sinks of pixel tables, manifests."""

from __future__ import annotations

import os
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import quote
from ..operators.pixels import META, feature_columns, normalize_mz_column_names, required_columns


def _stem(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0]


def import_pixel_csv(spark: SparkSession, path: str, section_id: str | None = None, section_order: int = 1, sample_id: str | None = None) -> DataFrame:
    """A pixel table from CSV with x and y: names normalised, metadata first, ids in the file's row order.

    Row ids come from the position of rows in the file's splits, without a global sort."""
    raw = spark.read.csv(path, header=True, inferSchema=True)
    df = raw.toDF(*normalize_mz_column_names(raw.columns))
    required_columns(df, ("x", "y"), path)
    section = section_id or _stem(path)
    keep = [c for c in df.columns if c not in META]
    numbered = with_ordinal(df, "pixel_id")
    return numbered.select(
        "pixel_id", F.col("pixel_id").alias("local_pixel_id"), F.lit(section).alias("section_id"), F.lit(section_order).alias("section_order"),
        F.lit(sample_id or section).alias("sample_id_source"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *(quote(c) for c in keep),
    )


def with_ordinal(df: DataFrame, name: str, start: int = 1) -> DataFrame:
    """Adds consecutive numbers in row order: counts per partition (a row per partition on the driver's side of a
    broadcast), then positions within each."""
    marked = df.withColumn("_m", F.monotonically_increasing_id())
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    sizes = marked.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    base = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.withColumn("_b", base).select("_p", "_b"))  # a row per partition
    return marked.withColumn("_p", part).join(offsets, "_p").withColumn(name, F.col("_b") + place + start).drop("_m", "_p", "_b")


def load_series(spark: SparkSession, paths: list[str], section_ids: list[str] | None = None, section_order: list[int] | None = None, sample_ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """One table of several sections: shared features, all metadata (missing ones NULL), ids renumbered over the
    sections; and the section table."""
    ids = section_ids or [_stem(p) for p in paths]
    if len(set(ids)) != len(ids):
        raise ValueError("section ids repeat")
    orders, samples = section_order or list(range(1, len(paths) + 1)), sample_ids or ids
    frames = [import_pixel_csv(spark, *args) for args in zip(paths, ids, orders, samples, strict=True)]
    shared = [c for c in feature_columns(frames[0]) if all(c in f.columns for f in frames)]
    if not shared:
        raise ValueError("the sections share no feature")
    out, offset = None, 0
    for frame in frames:
        meta = [c for c in frame.columns if not c.startswith("mz_")]
        frame = frame.select(*(quote(c) for c in [*meta, *shared])).withColumn("pixel_id", F.col("pixel_id") + offset)
        offset += frame.count()
        out = frame if out is None else out.unionByName(frame, allowMissingColumns=True)
    meta = [c for c in out.columns if not c.startswith("mz_")]
    sections = spark.createDataFrame(list(zip(ids, orders, samples, paths, strict=True)), "section_id string, section_order int, sample_id_source string, path string")
    return out.select(*(quote(c) for c in [*meta, *shared])), sections


def flatten(values: dict, prefix: str = "") -> list[tuple[str, str]]:
    """Nested settings as dotted key/value rows."""
    out = []
    for key, value in values.items():
        name = f"{prefix}.{key}" if prefix else str(key)
        out += flatten(value, name) if isinstance(value, dict) else [(name, str(value))]
    return out


def write_outputs(tables: dict[str, DataFrame | dict | None], directory: str, form: str = "csv") -> list[str]:
    """A folder per table; dictionaries become key/value tables.  CSV for exchange, Parquet for reuse."""
    written = []
    for name, value in tables.items():
        if value is None:
            continue
        if isinstance(value, dict):
            value = SparkSession.getActiveSession().createDataFrame(flatten(value), "key string, value string")
        path = f"{directory}/{name}"
        writer = value.write.mode("overwrite")
        writer.option("header", True).csv(path) if form == "csv" else writer.parquet(path)
        written.append(path)
    return written


def manifest(spark: SparkSession, files: list[str], metadata: dict, parameters: dict) -> DataFrame:
    """Rows (record_type, key, value, size_bytes, md5): input files, run metadata, parameters."""
    schema = "record_type string, key string, value string, size_bytes long, md5 string"
    run = metadata | {"spark_version": pyspark.__version__, "python_version": platform.python_version()}
    rows = [("run_metadata", k, v, None, None) for k, v in flatten(run)] + [("processing_parameter", k, v, None, None) for k, v in flatten(parameters)]
    out = spark.createDataFrame(rows, schema)
    if files:
        content = spark.read.format("binaryFile").load(files).select(F.lit("input_file").alias("record_type"), F.element_at(F.split("path", "/"), -1).alias("key"), F.col("path").alias("value"), F.col("length").alias("size_bytes"), F.md5("content").alias("md5"))
        out = content.unionByName(out)
    return out
