"""Label contracts and lookups, result-table conventions, name exports."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pixels import first_existing_column, required_columns

# Columns that name a region, and aliases of result columns: fixed values.
LABEL_COLUMNS = ("domain_id", "roi_id", "label", "domain_label", "roi_label")
RESULT_ALIASES = {
    "Sample": ("sample", "samples", "sampleid", "name"),
    "Feature": ("feature", "features", "compound", "metabolite", "mz", "id"),
    "VIP": ("vip", "vipscore", "comp1"),
    "p.value": ("pvalue", "p", "pval", "rawp"),
    "FDR": ("fdr", "adjp", "qvalue", "padj"),
}
#: Domain codes of an embedding map: fixed values.
DOMAIN_TYPES = {-1: "background", 0: "domain_0", 1: "domain_1", 2: "domain_2"}


def apply_matched_region_labels(pixels: DataFrame, labels: DataFrame, region: str = "matched_region") -> DataFrame:
    """Left join of region labels by the first key both tables have: pixel_id, (section, local id), or
    (section, x, y); of rows that share a key the first by label counts."""
    for keys in (("pixel_id",), ("section_id", "local_pixel_id"), ("section_id", "x", "y")):
        if all(k in labels.columns and k in pixels.columns for k in keys):
            break
    else:
        raise ValueError("labels share no key with the pixels")
    w = Window.partitionBy(*keys).orderBy(region)
    one = labels.select(*keys, region).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    base = pixels.drop(region) if region in pixels.columns else pixels
    return base.join(one, list(keys), "left")


def apply_roi_labels(pixels: DataFrame, selected: DataFrame, roi: str = "roi_id", section: str = "section_id") -> DataFrame:
    """Left join of selected pixels by [section,] pixel_id or [section,] x, y; raises where a pixel has two
    regions.  An older region column is replaced."""
    place = ["pixel_id"] if "pixel_id" in selected.columns and "pixel_id" in pixels.columns else ["x", "y"]
    keys = ([section] if section in selected.columns and section in pixels.columns else []) + place
    one = selected.select(*keys, roi).distinct()
    if not one.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a pixel has more than one region")
    return (pixels.drop(roi) if roi in pixels.columns else pixels).join(one, keys, "left")


def resolve_labels(pixels: DataFrame, labels: DataFrame, background: str = "-1") -> DataFrame:
    """Adds ``label`` by (x, y), the first of equal keys; pixels without one are background."""
    name = first_existing_column(labels, LABEL_COLUMNS, "labels")
    w = Window.partitionBy("x", "y").orderBy("label")
    one = labels.select("x", "y", F.col(name).cast("string").alias("label")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return pixels.join(one, ["x", "y"], "left").withColumn("label", F.coalesce("label", F.lit(background)))


def validate_labels(labels: DataFrame) -> str:
    """The label column; raises where a (sample, section, x, y) repeats."""
    name = first_existing_column(labels, LABEL_COLUMNS, "labels")
    required_columns(labels, ("x", "y"), "labels")
    keys = [c for c in ("sample_id", "section_id", "x", "y") if c in labels.columns]
    if not labels.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a coordinate has two labels")
    return name


def map_domain_labels(pixels: DataFrame, domains: DataFrame, sample: str = "sample_id_source", label: str = "label") -> DataFrame:
    """Exact one-to-one join on (sample, x, y) of domain codes; raises for unknown codes, repeated keys or
    pixels and labels without a partner."""
    d = domains.select(F.col("sample").alias(sample), "x", "y", F.col(label).cast("int").alias("domain_id"))
    if not d.where(~F.col("domain_id").isin(list(DOMAIN_TYPES)) | F.col("domain_id").isNull()).isEmpty():
        raise ValueError("unknown domain code")
    keys = [sample, "x", "y"]
    if not d.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("a coordinate has two domains")
    if not pixels.join(d, keys, "left_anti").isEmpty() or not d.join(pixels, keys, "left_anti").isEmpty():
        raise ValueError("pixels and domains don't match one to one")
    kind = F.create_map(*(x for k, v in DOMAIN_TYPES.items() for x in (F.lit(k), F.lit(v))))
    return pixels.join(d, keys).withColumn("domain_label", kind[F.col("domain_id")]).withColumn("domain_type", F.when(F.col("domain_id") == -1, "background").otherwise("tissue"))


def prepare_cell_type_labels(labels: DataFrame, entity_type: str = "cell", label_mode: str = "hard", coordinate_system: str = "unspecified") -> DataFrame:
    """Labels with the contract's columns, defaults filled in; raises for missing types, repeated objects, or
    confidences outside [0, 1]."""
    required_columns(labels, ("object_id", "x", "y", "cell_type"), "labels")
    defaults = {"confidence": F.lit(1.0), "source_method": F.lit("provided"), "region_id": F.lit("all"), "entity_type": F.lit(entity_type), "label_mode": F.lit(label_mode), "coordinate_system": F.lit(coordinate_system)}
    for name, value in defaults.items():
        labels = labels.withColumn(name, F.coalesce(F.col(name), value) if name in labels.columns else value)
    if not labels.where("cell_type is null or cell_type = '' or confidence < 0 or confidence > 1").isEmpty():
        raise ValueError("a label is missing or a confidence is out of range")
    if not labels.groupBy("object_id").count().where("count > 1").isEmpty():
        raise ValueError("an object has two labels")
    return labels.select("object_id", "x", "y", "cell_type", *defaults)


def statistic_concordance(statistics: DataFrame, moran: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Joins test results with spatial statistics on the six-decimal m/z and says which are coherent."""
    key = F.format_string("%.6f", F.col("mz").cast("double")).alias("mz_key")
    a = statistics.select(key, "p_value", "adj_p_value")
    b = moran.select(key, F.col("statistic").alias("morans_i"), F.col("adj_p_value").alias("moran_fdr"))
    sig, spatial = F.col("adj_p_value") <= alpha, (F.col("moran_fdr") <= alpha) & (F.col("morans_i") > 0)
    cls = F.when(F.col("moran_fdr").isNull(), "not_tested").when(sig & spatial, "coherent").when(spatial, "spatial_only").when(sig, "differential_only").otherwise("neither")
    return a.join(b, "mz_key", "left").withColumn("coherence", cls)


def lipid_names(mapped: DataFrame, statistics: DataFrame, p_cutoff: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """Audit rows (a name per row, with its feature's p) and the distinct names of significant features.
    mapped: annotation_id, name, feature_id, matched; several names are parted by ; or |."""
    names = mapped.where("matched").select("annotation_id", "feature_id", F.explode(F.split("name", "[;|]")).alias("name")).select("annotation_id", "feature_id", F.trim("name").alias("name")).where("name <> ''")
    audit = names.join(statistics.select("feature_id", "p_value"), "feature_id", "left")
    return audit, audit.where(F.col("p_value") <= p_cutoff).select("name").distinct()


def compound_rollup(rows: DataFrame) -> DataFrame:
    """Per compound: least p and FDR, the effect of largest size with its sign, joined distinct names."""
    return rows.groupBy("compound_id").agg(F.min("p_value").alias("p_value"), F.min("fdr").alias("fdr"), F.max_by("effect", F.abs("effect")).alias("effect"), F.array_join(F.array_sort(F.array_distinct(F.collect_list("name"))), "; ").alias("names"))


def scenario_union(rows: DataFrame, scenarios: dict[str, list[str]], key: str = "feature") -> DataFrame:
    """A tagged copy of the table per scenario, with a flag on what it excludes."""
    out = None
    for name, excluded in scenarios.items():
        part = rows.withColumns({"scenario": F.lit(name), "excluded": F.col(key).isin(excluded) if excluded else F.lit(False)})
        out = part if out is None else out.unionByName(part)
    return out


def detect_result(columns: list[str]) -> str:
    """Kind of an external result table by its columns."""
    low = {re.sub(r"[^a-z0-9]+", "", c.lower()) for c in columns}
    if low & {"vip", "vipscore"}:
        return "vip"
    if low & {"pvalue", "pval", "fdr"}:
        return "differential"
    if any(re.fullmatch(r"pc[0-9]+", c) for c in low):
        return "pca_scores"
    if any(re.fullmatch(r"comp[0-9]+", c) for c in low):
        return "plsda_scores"
    return "unknown"


def normalize_result(df: DataFrame, source: str) -> DataFrame:
    """Columns renamed to the standard names (compared in lower case, letters and digits only)."""
    out, used = df, set()
    for column in df.columns:
        low = re.sub(r"[^a-z0-9]+", "", column.lower())
        for name, aliases in RESULT_ALIASES.items():
            if low in aliases and name not in used:
                out, _ = out.withColumnRenamed(column, name), used.add(name)
                break
    return out.withColumn("source", F.lit(source))


def rank_features(df: DataFrame, metric: str | None = None, n: int = 20) -> DataFrame:
    """The n best features by VIP, else FDR, else p, else the first numeric column; p-like metrics ascend."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint")]
    metric = metric or next((m for m in ("VIP", "FDR", "p.value") if m in df.columns), numeric[0])
    c = F.col(f"`{metric}`")
    order = c.asc() if metric in ("FDR", "p.value") else c.desc()
    return df.where(c.isNotNull() & ~F.isnan(c.cast("double"))).orderBy(order, "Feature").limit(n)
