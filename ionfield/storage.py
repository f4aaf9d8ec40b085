"""Shared-storage and packaging helpers.

Lineage is cut with tables written to the folder named by ``spark.checkpoint.dir``: every executor
sees it, Spark's commit protocol makes a retried task harmless, and losing an executor never loses
the table.  A folder of our own is used only where the session names none (tests, notebooks).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of the session; a new temporary one only where none is configured and all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="ionfield-checkpoint-")
        spark.sparkContext.setCheckpointDir(f"file://{root}")
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again; removed when the JVM ends."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/ionfield-{uuid.uuid4().hex}/{label}"
    df.write.parquet(path, compression=compression)
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a table of unknown size is broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted no further than that)."""
    most = SMALL_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ionfield-ship-"), "ionfield_ship.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("ionfield", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
