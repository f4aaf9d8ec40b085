"""The pixel table: metadata columns plus one DOUBLE column per feature, and its long and array forms."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import finite, quantile, quote, safe_divide

PREFIX = "mz_"
#: Metadata columns that come first, in this order: fixed values.
META = ("pixel_id", "local_pixel_id", "section_id", "section_order", "sample_id_source", "x", "y")


def required_columns(df: DataFrame, names, label: str = "table") -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{label} lacks columns: {', '.join(missing)}")


def first_existing_column(df: DataFrame, names, label: str = "table") -> str:
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"{label} has none of: {', '.join(names)}")


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(PREFIX)]


def feature_mass(name: str) -> float | None:
    m = re.match(rf"^{PREFIX}([0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)", name)
    return float(m[1]) if m else None


def infer_feature_mapping(df: DataFrame) -> list[tuple[int, float | None, str]]:
    """(feature id, m/z, column) of every feature column."""
    return [(i + 1, feature_mass(c), c) for i, c in enumerate(feature_columns(df))]


def make_feature_mapping(features: DataFrame) -> DataFrame:
    """(feature_id, mz, column_name) from (id, mz); names hold 15 significant digits and must differ."""
    required_columns(features, ("id", "mz"), "features")
    out = features.select(F.col("id").alias("feature_id"), F.col("mz").cast("double").alias("mz"), F.concat(F.lit(PREFIX), F.col("mz").cast("double").cast("string")).alias("column_name"))
    if not out.groupBy("column_name").count().where("count > 1").isEmpty():
        raise ValueError("two features have the same m/z")
    return out


def normalize_mz_column_names(names: list[str]) -> list[str]:
    """``mz_`` before purely numeric names; every ``-`` becomes ``_``."""
    return [(PREFIX + n if re.fullmatch(r"[0-9]+(\.[0-9]+)?", n) else n).replace("-", "_") for n in names]


def stable_mz_column_names(masses: list[float]) -> list[str]:
    seen, out = set(), []
    for i, m in enumerate(masses):
        name = PREFIX + format(m, ".17g")
        out.append(f"{name}_feature_{i + 1}" if name in seen else name)
        seen.add(name)
    return out


def resolve_feature_column(df: DataFrame, feature) -> str:
    """The named column, else the one of nearest m/z."""
    names = feature_columns(df)
    if str(feature) in names:
        return str(feature)
    target = float(str(feature).removeprefix(PREFIX))
    known = [(abs(m - target), i, n) for i, n in enumerate(names) if (m := feature_mass(n)) is not None]
    if not known:
        raise ValueError("no feature has an m/z")
    return min(known)[2]


def reduce_features(df: DataFrame, features) -> DataFrame:
    """All metadata and only the given features (column pruning reaches the scan)."""
    keep = set(features)
    return df.select(*(quote(c) for c in df.columns if not c.startswith(PREFIX) or c in keep))


def to_long(df: DataFrame, features=None) -> DataFrame:
    """A row per pixel and feature: metadata, feature, value (NaN and infinities become NULL)."""
    features = list(features or feature_columns(df))
    meta = [c for c in df.columns if not c.startswith(PREFIX)]
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), finite(quote(c)).alias("value")) for c in features))).alias("_f")
    return df.select(*(quote(c) for c in meta), each).select(*(quote(c) for c in meta), "_f.feature", "_f.value")


class Packed(NamedTuple):
    """The packed form: a row per pixel, its values in the array ``v`` in the order of ``features``.  Operators that take
    it need no shuffle to see a pixel whole."""

    rows: DataFrame
    features: list[str]

    def long(self) -> DataFrame:
        """The rows' other columns, feature, value."""
        rest = [quote(c) for c in self.rows.columns if c != "v"]
        names = F.array(*map(F.lit, self.features))
        return self.rows.select(*rest, F.posexplode("v").alias("_i", "value")).select(*rest, F.get(names, F.col("_i")).alias("feature"), "value")


def as_long(df: DataFrame | Packed) -> DataFrame:
    return df.long() if isinstance(df, Packed) else df


def to_wide(long: DataFrame, meta, features: list[str], fill: float | None = 0.0) -> DataFrame:
    wide = long.groupBy(*meta).pivot("feature", features).agg(F.first("value"))
    return wide.fillna(fill, subset=features) if fill is not None else wide


def feature_stats(long: DataFrame, by=()) -> DataFrame:
    """mean, sd, cv (0 where the mean is 0) and share of positive values per feature (and group)."""
    v = F.col("value")
    out = long.groupBy(*by, "feature").agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.avg((v > 0).cast("double")).alias("nonzero_rate"))
    return out.withColumn("cv", F.coalesce(safe_divide(F.col("sd"), F.col("mean")), F.lit(0.0)))


def select_features(long: DataFrame, cv_top_percent: float = 70, mean_min: float = 0, nonzero_min: float = 0.3, manual: list[str] | None = None, combine: str = "union", by=()) -> DataFrame:
    """Features whose cv reaches the group's quantile, with mean above and rate at least the minima;
    united or intersected with manually chosen ones; ``method`` says which rule chose a feature."""
    stats = feature_stats(long, by)
    cut = stats.groupBy(*by).agg(quantile(F.col("cv"), 1 - cv_top_percent / 100).alias("cutoff")) if by else stats.agg(quantile(F.col("cv"), 1 - cv_top_percent / 100).alias("cutoff"))
    joined = stats.join(F.broadcast(cut), list(by)) if by else stats.crossJoin(F.broadcast(cut))  # a row per group
    rule = (F.col("cv") >= F.col("cutoff")) & (F.col("mean") > mean_min) & (F.col("nonzero_rate") >= nonzero_min)
    chosen = F.col("feature").isin(manual or [])
    keep = (rule | chosen) if combine == "union" or not manual else (rule & chosen)
    method = F.when(rule & chosen, "both").when(rule, "rule").otherwise("manual")
    return joined.where(keep).withColumn("method", method)


def select_shared_features(long: DataFrame, section: str = "section_id", min_section_fraction: float = 1.0, **rule) -> DataFrame:
    """Features chosen in at least the given share of sections, with how many chose them."""
    chosen = select_features(long, by=(section,), **rule)
    total = long.select(section).distinct().agg(F.count("*").alias("n_sections"))
    per = chosen.groupBy("feature").agg(F.count_distinct(section).alias("n_selected"))
    return per.crossJoin(F.broadcast(total)).where(F.col("n_selected") / F.col("n_sections") >= min_section_fraction)  # one row


def first_occurrence(df: DataFrame, keys, order) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
