"""A stream of section files: new pixel CSVs are normalised and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def stream_sections(spark: SparkSession, directory: str, schema: StructType | str) -> DataFrame:
    """Pixel rows of every CSV that appears in ``directory``, with the file's name as section."""
    rows = spark.readStream.schema(schema).option("header", True).csv(directory)
    return rows.withColumn("section_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1))


def section_totals(rows: DataFrame, features: list[str]) -> DataFrame:
    """Running pixels and total ion current per section (bounded state: a row per section)."""
    tic = sum((F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features), F.lit(0.0))
    return rows.groupBy("section_id").agg(F.count("*").alias("n_pixels"), F.sum(tic).alias("tic"))


def append_sections(rows: DataFrame, path: str, checkpoint: str):
    """Write the stream to Parquet by section; exactly once by its checkpoint."""
    return rows.writeStream.format("parquet").partitionBy("section_id").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
