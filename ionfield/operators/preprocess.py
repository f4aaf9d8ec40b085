"""Background masks, normalisation and scaling on the long pixel table (pixel_id, feature, value, ...)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import EPS, quantile_table, safe_divide
from ..storage import materialize
from .pixels import Packed, as_long, feature_stats


def _kept(packed: Packed, excluded: list[str] | None) -> Column:
    """The array of values without the excluded features'."""
    if not excluded:
        return F.col("v")
    return F.array(*(F.get("v", F.lit(i)) for i, f in enumerate(packed.features) if f not in excluded)).cast("array<double>")


def packed_total(packed: Packed, method: str = "raw", excluded: list[str] | None = None, trim: float = 0.1) -> Column:
    """A packed pixel's total (see ``foreground_tic``): NULL where it has no value."""
    v = _kept(packed, excluded if method == "exclude_features" else None)
    if method in ("raw", "exclude_features"):
        return F.aggregate(v, F.lit(None).cast("double"), lambda s, x: F.coalesce(s + x, x, s))
    known = F.array_sort(F.filter(v, lambda x: x.isNotNull()))
    if method == "median":
        return _middle(known) * F.size(v)
    cut = F.floor(F.size(known) * trim).cast("int")
    middle = F.slice(known, cut + 1, F.size(known) - 2 * cut)
    return F.when(F.size(known) > 0, F.aggregate(middle, F.lit(0.0), lambda s, x: s + x) / F.size(middle) * F.size(known))


def _middle(ordered: Column) -> Column:
    """The median of an ordered array; NULL of an empty one."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2


def packed_nonzero(packed: Packed, excluded: list[str] | None = None) -> Column:
    return F.aggregate(_kept(packed, excluded), F.lit(0).cast("long"), lambda s, x: s + F.when(x > 0, 1).otherwise(0))


def total_ion_current(long: DataFrame | Packed, keys=("pixel_id",)) -> DataFrame:
    if isinstance(long, Packed):
        return long.rows.select(*keys, packed_total(long).alias("tic"), packed_nonzero(long).alias("n_nonzero"))
    return long.groupBy(*keys).agg(F.sum("value").alias("tic"), F.sum((F.col("value") > 0).cast("long")).alias("n_nonzero"))


def tic_normalize(long: DataFrame, rescale: str = "median", by=(), eps: float = EPS) -> DataFrame:
    """value / row total; ``median`` rescales by the median positive total of the group (zero rows give 0),
    ``total`` divides by max(total, eps) and doesn't rescale."""
    w = Window.partitionBy("pixel_id")
    rows = long.withColumn("tic", F.sum("value").over(w))
    if rescale == "total":
        return rows.withColumn("value", F.col("value") / F.greatest(F.col("tic"), F.lit(eps))).drop("tic")
    tics = total_ion_current(long, (*by, "pixel_id")).where("tic > 0")
    median = tics.groupBy(*by).agg(F.median("tic").alias("scale")) if by else tics.agg(F.median("tic").alias("scale"))
    rows = rows.join(F.broadcast(median), list(by)) if by else rows.crossJoin(F.broadcast(median))  # a row per group
    return rows.withColumn("value", F.when(F.col("tic") > 0, F.col("value") / F.col("tic") * F.col("scale")).otherwise(0.0)).drop("tic", "scale")


def log10_transform(long: DataFrame) -> DataFrame:
    return long.withColumn("value", F.log10(F.col("value") + 1))


def scale_features(long: DataFrame, by=()) -> DataFrame:
    """z-scores per feature (and group); 0 where they aren't finite."""
    stats = long.groupBy(*by, "feature").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    z = safe_divide(F.col("value") - F.col("_m"), F.col("_s"))
    return long.join(F.broadcast(stats), [*by, "feature"]).withColumn("value", F.coalesce(F.when(F.isnan(z), None).otherwise(z), F.lit(0.0))).drop("_m", "_s")  # a row per feature (and group)


def foreground_tic(long: DataFrame | Packed, method: str = "raw", excluded: list[str] | None = None, trim: float = 0.1) -> DataFrame:
    """(pixel_id, tic, n_nonzero) with a robust total: raw, without excluded features, or a trimmed mean or
    median times the number of features."""
    if isinstance(long, Packed):
        left_out = excluded if method == "exclude_features" else None
        return long.rows.select("pixel_id", packed_total(long, method, excluded, trim).alias("tic"), packed_nonzero(long, left_out).alias("n_nonzero"))
    kept = long.where(~F.col("feature").isin(excluded)) if method == "exclude_features" and excluded else long
    nz = F.sum((F.col("value") > 0).cast("long")).alias("n_nonzero")
    if method in ("raw", "exclude_features"):
        return kept.groupBy("pixel_id").agg(F.sum("value").alias("tic"), nz)
    values = F.array_sort(F.collect_list("value"))  # as many as there are features
    n = F.size(values)
    if method == "median":
        return kept.groupBy("pixel_id").agg((F.median("value") * F.count("*")).alias("tic"), nz)
    cut = F.floor(n * trim).cast("int")
    middle = F.slice(values, cut + 1, n - 2 * cut)
    return kept.groupBy("pixel_id").agg((F.aggregate(middle, F.lit(0.0), lambda a, v: a + v) / F.size(middle) * n).alias("tic"), nz)


def pretty_breaks(low: float, high: float, n: int) -> list[float]:
    """Round break points that cover [low, high] in about n intervals (1, 2, 5 steps)."""
    if high <= low:
        return [low, high]
    cell = (high - low) / n
    base = 10.0 ** math.floor(math.log10(cell))
    unit = base
    for k in (2.0, 5.0, 10.0):
        if k * base - cell < (1.5 if k != 5.0 else 2.75) * (cell - unit):
            unit = k * base
    first, last = math.floor(low / unit + 1e-7), math.ceil(high / unit - 1e-7)
    return [unit * i for i in range(int(first), int(last) + 1)]


def otsu(df: DataFrame, value: str, breaks: list[float] | None = None, bins: int = 256) -> DataFrame:
    """One row (threshold, between): the middle of the bin that maximises the between-class variance.

    Bins are right-closed (the lowest break included).  Only the histogram, whose size is fixed, meets the
    windows without a key."""
    rows = df.select(F.col(value).cast("double").alias("v")).where("v is not null")
    if breaks is None:
        low, high = rows.agg(F.min("v"), F.max("v")).first()
        if low is None or low == high:
            return df.sparkSession.createDataFrame([(low, 0.0)], "threshold double, between double")
        breaks = pretty_breaks(low, high, bins)
    edges = F.array(*(F.lit(float(b)) for b in breaks))
    step = breaks[1] - breaks[0]
    k = F.greatest(F.lit(1), F.least(F.lit(len(breaks) - 1), F.ceil((F.col("v") - breaks[0]) / step - 1e-9))).cast("int")
    hist = rows.groupBy(k.alias("k")).agg(F.count("*").alias("n")).withColumn("mid", (F.element_at(edges, F.col("k")) + F.element_at(edges, F.col("k") + 1)) / 2)
    every, upto = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy("k")
    hist = hist.select("k", "mid", F.sum("n").over(upto).alias("n0"), F.sum("n").over(every).alias("N"), F.sum(F.col("n") * F.col("mid")).over(upto).alias("s0"), F.sum(F.col("n") * F.col("mid")).over(every).alias("S"))
    n0, n1 = F.col("n0"), F.col("N") - F.col("n0")
    gap = safe_divide(F.col("s0"), n0) - safe_divide(F.col("S") - F.col("s0"), n1)
    hist = hist.withColumn("between", F.coalesce(n0 / F.col("N") * n1 / F.col("N") * gap * gap, F.lit(0.0)))
    return hist.orderBy(F.desc(F.round("between", 9)), "k").limit(1).select(F.col("mid").alias("threshold"), "between")


def background_mask(long: DataFrame | Packed, method: str = "tic_percentile", percentile: float = 0.1, median_percent: float = 20, min_nonzero: int = 1, excluded: list[str] | None = None, trim: float = 0.1, otsu_breaks: list[float] | None = None, by=(), keep_values: bool = False) -> DataFrame:
    """(by, pixel_id, tic, n_nonzero, keep): tissue pixels by a threshold on a (robust) total; quantile thresholds
    may be each group's own.  The totals are written once: thresholds are searched in a table with a row per pixel.
    ``keep_values`` adds them to the columns of packed rows instead."""
    source = {"gap_otsu_log_tic": "exclude_features", "trimmed_otsu_log_tic": "trimmed", "median_otsu_log_tic": "median"}.get(method, "raw")
    if by and method not in ("tic_percentile", "median_fraction", "none"):
        raise ValueError(f"{method!r} has one threshold for all groups")
    if isinstance(long, Packed):
        left_out = excluded if source == "exclude_features" else None
        kept = long.rows.columns if keep_values else (*by, "pixel_id")
        rows = long.rows.select(*kept, packed_total(long, source, excluded, trim).alias("tic"), packed_nonzero(long, left_out).alias("n_nonzero"))
    else:
        rows = foreground_tic(long, source, excluded, trim)
        if by:
            rows = rows.join(long.select("pixel_id", *by).distinct(), "pixel_id")
    rows = materialize(rows, "totals")
    totals = rows.select(*by, "tic", "n_nonzero")
    positive = F.when(F.col("tic") > 0, F.col("tic"))
    if method == "none":
        return rows.withColumn("keep", F.lit(True))
    if method == "tic_percentile":
        cut = quantile_table(totals, positive, percentile, by)
        score: Column = F.col("tic")
    elif method == "median_fraction":
        cut = quantile_table(totals, positive, 0.5, by).withColumn("cut", F.col("cut") * median_percent / 100)
        score = F.col("tic")
    elif method.endswith("otsu_log_tic"):
        logged = totals.select(F.log10(F.col("tic") + 1).alias("s"))
        cut, score = otsu(logged, "s", otsu_breaks).select(F.col("threshold").alias("cut")), F.log10(F.col("tic") + 1)
    elif method == "log_tic_kmeans":
        cut, score = two_means(totals.select(F.log10(F.col("tic") + 1).alias("s")), "s"), F.log10(F.col("tic") + 1)
    else:
        raise ValueError(f"unknown method {method!r}")
    rows = rows.join(F.broadcast(cut), list(by)) if by else rows.crossJoin(F.broadcast(cut))  # a row per group
    return rows.withColumn("keep", (score >= F.col("cut")) & (F.col("n_nonzero") >= min_nonzero)).drop("cut")


def two_means(df: DataFrame, value: str, iterations: int = 50) -> DataFrame:
    """One row (cut): the middle of two one-dimensional Lloyd centres, started at the quartiles.  Every iteration
    reads the values, so they are written once."""
    rows = materialize(df.select(F.col(value).alias("v")).where("v is not null"), "scores")
    a, b = (quantile_table(rows, F.col("v"), p).first()[0] for p in (0.25, 0.75))
    for _ in range(iterations):
        if a is None or a == b:
            break
        cut = (a + b) / 2
        low, high = rows.agg(F.avg(F.when(F.col("v") < cut, F.col("v"))), F.avg(F.when(F.col("v") >= cut, F.col("v")))).first()
        low, high = a if low is None else low, b if high is None else high
        if (low, high) == (a, b):
            break
        a, b = low, high
    return df.sparkSession.createDataFrame([((a + b) / 2 if a is not None else None,)], "cut double")


# --- features that are everywhere ------------------------------------------------------------------


def _median_mad(df: DataFrame, value: str) -> DataFrame:
    med = df.agg(F.median(value).alias("med"))
    return df.crossJoin(F.broadcast(med)).agg(F.first("med").alias("med"), F.median(F.abs(F.col(value) - F.col("med"))).alias("mad"), F.stddev_samp(value).alias("sd"))  # one row


def ubiquitous_by_gap(rates: DataFrame, multiplier: float = 6) -> DataFrame:
    """Adds ``threshold``, ``excluded``: the middle of the first unusually wide gap between the distinct
    rates from the highest down (more than median + multiplier * MAD; the sd where the MAD is 0)."""
    distinct = rates.select("nonzero_rate").where("nonzero_rate > 0").distinct()
    gaps = distinct.withColumn("next", F.lead("nonzero_rate").over(Window.orderBy(F.desc("nonzero_rate")))).where("next is not null").withColumn("gap", F.col("nonzero_rate") - F.col("next"))
    spread = _median_mad(gaps, "gap")
    width = F.when(F.col("mad") > 0, F.col("mad")).when(F.col("sd") > 0, F.col("sd"))
    wide = gaps.crossJoin(F.broadcast(spread)).where(F.col("gap") > F.col("med") + multiplier * width)  # one row
    cut = wide.agg(F.max_by((F.col("nonzero_rate") + F.col("next")) / 2, F.col("nonzero_rate")).alias("threshold"))
    return rates.crossJoin(F.broadcast(cut)).withColumn("excluded", F.coalesce(F.col("nonzero_rate") >= F.col("threshold"), F.lit(False)))  # one row


def ubiquitous_by_mad(rates: DataFrame, cutoff: float = 3.5) -> DataFrame:
    """Adds ``modified_z``, ``excluded``: 0.6745 (rate - median) / MAD above the cutoff."""
    spread = _median_mad(rates, "nonzero_rate")
    z = 0.6745 * safe_divide(F.col("nonzero_rate") - F.col("med"), F.col("mad"))
    out = rates.crossJoin(F.broadcast(spread)).withColumn("modified_z", z)  # one row
    return out.withColumn("excluded", F.coalesce(F.col("modified_z") > cutoff, F.lit(False))).drop("med", "mad", "sd")


def detect_ubiquitous_features(long: DataFrame, method: str = "gap", multiplier: float = 6, cutoff: float = 3.5, min_agreement: int = 2) -> DataFrame:
    """(feature, nonzero_rate, gap, mad, excluded)."""
    rates = feature_stats(long).select("feature", "nonzero_rate")
    gap = ubiquitous_by_gap(rates, multiplier).select("feature", F.col("excluded").alias("gap"))
    mad = ubiquitous_by_mad(rates, cutoff).select("feature", F.col("excluded").alias("mad"))
    votes = F.col("gap").cast("int") + F.col("mad").cast("int")
    rule = {"gap": F.col("gap"), "mad": F.col("mad"), "consensus": votes >= min_agreement, "none": F.lit(False)}[method]
    return rates.join(gap, "feature").join(mad, "feature").withColumn("excluded", rule)


def contamination_agreement(long: DataFrame | Packed, mask: DataFrame, exclude_if: float = 1.0, eps: float = EPS) -> DataFrame:
    """Per feature the background/tissue ratio and how many of gap, MAD and enrichment call it contamination."""
    if isinstance(long, Packed) and "v" in mask.columns:  # the mask's rows have the values
        long = v = Packed(mask, long.features).long()
    else:
        long = as_long(long)
        v = long.join(mask.select("pixel_id", "keep"), "pixel_id")
    means = v.groupBy("feature").agg(F.avg(F.when(~F.col("keep"), F.col("value"))).alias("background_mean"), F.avg(F.when(F.col("keep"), F.col("value"))).alias("tissue_mean"))
    votes = detect_ubiquitous_features(long, "consensus").select("feature", "nonzero_rate", "gap", "mad")
    out = means.join(votes, "feature").withColumn("ratio", F.col("background_mean") / F.greatest(F.col("tissue_mean"), F.lit(eps)))
    out = out.withColumn("enrichment", F.coalesce(F.col("ratio") > exclude_if, F.lit(False)))
    return out.withColumn("agreement", F.col("gap").cast("long") + F.col("mad").cast("long") + F.col("enrichment").cast("long"))


def preprocess(long: DataFrame | Packed, background: str = "none", tic: bool = True, log: bool = True, scale: bool = False, by=(), **options) -> DataFrame:
    """Background filter, then median-rescaled TIC, log10(x + 1) and z-scores; per group where ``by`` is given
    (thresholds and rescaling are the group's own).  Packed rows are filtered and rescaled as they are."""
    if isinstance(long, Packed):
        return _preprocess_packed(long, background, tic, log, scale, by, **options)
    if background != "none":
        if by and background in ("tic_percentile", "median_fraction"):
            long = long.join(background_mask(long, background, by=by, **options).where("keep").select("pixel_id"), "pixel_id", "left_semi")
        elif by:  # a threshold search for each of the sections
            parts = [long.where(F.col(by[0]) == r[0]) for r in long.select(by[0]).distinct().collect()]
            kept = [p.join(background_mask(p, background, **options).where("keep").select("pixel_id"), "pixel_id", "left_semi") for p in parts]
            long = kept[0]
            for k in kept[1:]:
                long = long.unionByName(k)
        else:
            long = long.join(background_mask(long, background, **options).where("keep").select("pixel_id"), "pixel_id", "left_semi")
    if tic:
        long = tic_normalize(long, by=by)
    if log:
        long = log10_transform(long)
    return scale_features(long, by) if scale else long


def _preprocess_packed(packed: Packed, background: str, tic: bool, log: bool, scale: bool, by, **options) -> DataFrame:
    mask = background_mask(packed, background, by=by, keep_values=True, **options).where("keep")
    rows = mask.drop("tic", "n_nonzero", "keep").withColumn("tic", packed_total(packed))
    if tic:
        positive = F.when(F.col("tic") > 0, F.col("tic"))
        scales = quantile_table(rows, positive, 0.5, by, "scale")
        rows = rows.join(F.broadcast(scales), list(by)) if by else rows.crossJoin(F.broadcast(scales))  # a row per group
        rows = rows.withColumn("v", F.when(F.col("tic") > 0, F.transform("v", lambda x: x / F.col("tic") * F.col("scale"))).otherwise(F.transform("v", lambda x: F.lit(0.0)))).drop("scale")
    long = Packed(rows.drop("tic"), packed.features).long()
    long = log10_transform(long) if log else long
    return scale_features(long, by) if scale else long


def nonzero_filter(long: DataFrame, least: int = 1) -> DataFrame:
    """Pixels with at least so many positive values."""
    w = Window.partitionBy("pixel_id")
    return long.withColumn("_n", F.sum((F.col("value") > 0).cast("int")).over(w)).where(F.col("_n") >= least).drop("_n")
