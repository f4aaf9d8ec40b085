"""Column expressions and window rewrites shared by the operators (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Machine epsilon and its root, as tolerances: fixed values.
EPS = 2.220446049250313e-16
ROOT_EPS = 1.4901161193847656e-8


def finite(c: Column) -> Column:
    """The value, or NULL where it is NaN or infinite."""
    c = c.cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def quote(name: str) -> Column:
    """A column by its literal name (feature names hold dots)."""
    return F.col("`" + name.replace("`", "``") + "`")


def quantile(c: Column, p: float) -> Column:
    """Linear-interpolation quantile (type 7)."""
    return F.percentile(c, F.lit(p))


def quantile_table(df: DataFrame, value: Column, p: float, by: tuple[str, ...] = (), name: str = "cut") -> DataFrame:
    """(by, name): the same quantile of each group's known values, for groups of any size.  A sketch of fixed size
    gives a bracket that holds the two order statistics (its error is a tenth of the bracket's width; small groups are
    taken whole); only what lies in the bracket, about 1/500 of the rows, is counted by value and meets a window."""
    margin, accuracy = 1e-3, 10_000
    rows = df.select(*by, value.cast("double").alias("v")).where("v is not null")
    sketch = rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(F.lit(max(0.0, p - margin)), F.lit(min(1.0, p + margin))), F.lit(accuracy)).alias("b"), F.array(F.min("v"), F.max("v")).alias("whole"))
    sketch = sketch.select(*by, "n", F.when(F.col("n") <= 4 * accuracy, F.col("whole")).otherwise(F.col("b")).alias("b"))
    near = rows.join(F.broadcast(sketch), list(by)) if by else rows.crossJoin(F.broadcast(sketch))  # a row per group
    near = near.where(F.col("v") <= F.col("b")[1]).groupBy(*by, F.when(F.col("v") >= F.col("b")[0], F.col("v")).alias("v")).agg(F.count("*").alias("k"), F.first("n").alias("n"))
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0)
    at = (F.col("n") - 1) * p
    cum = near.withColumns({"cum": F.sum("k").over(upto), "at": at, "low": F.floor(at)}).withColumn("top", F.least(F.col("low") + 1, F.col("n") - 1))
    inside = F.col("v").isNotNull()
    found = cum.groupBy(*by).agg(
        F.min(F.when(inside & (F.col("cum") > F.col("low")), F.col("v"))).alias("lower"), F.min(F.when(inside & (F.col("cum") > F.col("top")), F.col("v"))).alias("upper"),
        F.coalesce(F.max(F.when(~inside, F.col("cum"))), F.lit(0)).alias("below"), F.first("at").alias("at"), F.first("low").alias("low"), F.count("*").alias("rows"),
    )
    exact = F.when(F.col("at") == F.col("low"), F.col("lower")).otherwise((F.col("low") + 1 - F.col("at")) * F.col("lower") + (F.col("at") - F.col("low")) * F.col("upper"))
    missed = (F.col("rows") > 0) & ((F.col("below") > F.col("low")) | F.col("upper").isNull())
    return found.select(*by, F.when(missed, F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")).otherwise(exact).alias(name))


def average_rank(value: Column, *by: Column) -> Column:
    """Ranks from 1; ties share their mean rank."""
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (ties - 1) / 2


def equal_width_bin(c: Column, low: Column, high: Column, n: int) -> Column:
    """1..n, right-closed, the lowest value in the first bin."""
    return F.when(high > low, F.greatest(F.lit(1), F.ceil((c - low) * n / (high - low)))).otherwise(F.lit(1)).cast("long")


def normalized_logistic(c: Column, midpoint: float = 0.1, steepness: float = 12.0) -> Column:
    """Logistic curve rescaled so that 0 maps to 0 and 1 to 1, clipped to [0, 1]."""
    at = lambda x: 1 / (1 + F.exp(-F.lit(steepness) * (x - F.lit(midpoint))))
    low, high = at(F.lit(0.0)), at(F.lit(1.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (at(c) - low) / (high - low)))


def url_encode_reserved(c: Column) -> Column:
    """Percent-encoding of everything but unreserved characters (space as %20)."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def collapse_unique(c: Column, separator: str = "; ") -> Column:
    """Distinct non-empty strings of an array, joined."""
    return F.array_join(F.array_distinct(F.filter(c, lambda x: x.isNotNull() & (x != ""))), separator)


def adjust_p(df: DataFrame, p: str, out: str = "adj_p_value", by: tuple[str, ...] = (), method: str = "BH") -> DataFrame:
    """Adds adjusted p-values over the non-null ones of each group.

    The windows run over result tables (a row per tested feature), partitioned by ``by`` where given."""
    if method == "none":
        return df.withColumn(out, F.col(p))
    keys = [*by, F.col(p).isNull()]
    n = F.count(F.col(p)).over(Window.partitionBy(*keys))
    if method == "bonferroni":
        return df.withColumn(out, F.least(F.lit(1.0), F.col(p) * n))
    up, down = Window.partitionBy(*keys).orderBy(F.col(p).asc()), Window.partitionBy(*keys).orderBy(F.col(p).desc())
    rank_up = F.row_number().over(up)
    if method == "holm":
        return _running(df, p, out, F.col(p) * (n - rank_up + 1), up, F.max)
    left = n - F.row_number().over(down) + 1
    if method == "hochberg":
        return _running(df, p, out, F.col(p) * (n - left + 1), down, F.min)
    if method == "BH":
        return _running(df, p, out, F.col(p) * n / left, down, F.min)
    if method == "BY":
        harmonic = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / i)
        return _running(df, p, out, F.col(p) * n * harmonic / left, down, F.min)
    raise ValueError(f"unknown method {method!r}")


def _running(df, p, out, raw, window, extreme):
    scored = df.withColumn("_raw", raw)
    value = F.least(F.lit(1.0), extreme("_raw").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    return scored.withColumn(out, F.when(F.col(p).isNotNull(), value)).drop("_raw")


# --- chemical formulas ------------------------------------------------------------------------------


def parse_formula(c: Column) -> Column:
    """Map element -> count; repeated elements add up; NULL for NULL or empty text."""
    tokens = F.regexp_extract_all(c, F.lit("([A-Z][a-z]?)([0-9]*)"), F.lit(0))
    pairs = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, "^[A-Za-z]+", 0).alias("e"), F.coalesce(F.regexp_extract(t, "[0-9]+$", 0).try_cast("int"), F.lit(1)).alias("n")))
    elements = F.array_distinct(F.transform(pairs, lambda s: s["e"]))
    total = lambda e: F.aggregate(F.filter(pairs, lambda s: s["e"] == e), F.lit(0), lambda a, s: a + s["n"])
    return F.when(F.length(c) > 0, F.map_from_arrays(elements, F.transform(elements, total)))


def format_formula(m: Column) -> Column:
    """C, H, then the other elements by name; a count of one is left out, zero counts are dropped."""
    kept = F.filter(F.map_entries(m), lambda e: e["value"] > 0)
    keyed = F.transform(kept, lambda e: F.struct(F.when(e["key"] == "C", 0).when(e["key"] == "H", 1).otherwise(2).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda e: F.concat(e["k"], F.when(e["v"] == 1, "").otherwise(e["v"].cast("string")))), "")


def add_hydrogen(c: Column, n: int = 1) -> Column:
    """The formula with n more hydrogens; NULL where that would be negative."""
    counts = parse_formula(c)
    h = F.coalesce(F.element_at(counts, F.lit("H")), F.lit(0)) + n
    rest = F.map_filter(counts, lambda k, v: k != "H")
    return F.when(h >= 0, format_formula(F.map_concat(rest, F.create_map(F.lit("H"), h))))


def formula_overlap(a: Column, b: Column) -> Column:
    """Class of two arrays of formulas, empty or NULL meaning missing."""
    x, y = F.coalesce(F.array_distinct(a), F.array().cast("array<string>")), F.coalesce(F.array_distinct(b), F.array().cast("array<string>"))
    return (
        F.when((F.size(x) == 0) & (F.size(y) == 0), "both_missing")
        .when((F.size(x) == 0) | (F.size(y) == 0), "unilateral_missing")
        .when(F.array_sort(x) == F.array_sort(y), "exact_match")
        .when(F.size(F.array_intersect(x, y)) > 0, "candidate_overlap")
        .otherwise("discordant")
    )


#: Classes from worst to best: fixed values.
OVERLAP_ORDER = ("both_missing", "unilateral_missing", "discordant", "candidate_overlap", "exact_match")


def best_overlap(*classes: Column) -> Column:
    order = F.array(*(F.lit(c) for c in OVERLAP_ORDER))
    return F.element_at(order, F.greatest(*(F.array_position(order, c) for c in classes)).cast("int"))
