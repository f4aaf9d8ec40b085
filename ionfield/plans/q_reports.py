"""Queries on result tables and on files written and read again, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expressions import collapse_unique
from ..operators import pixels, reports
from ..sources import tables
from ..storage import checkpoint_root
from .bindings import P1, P2, p1, p1_pixels, p2, p2_pixels, rounded, table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def _folder(spark) -> str:
    return f"{checkpoint_root(spark)}/ionfield-{uuid.uuid4().hex}"


def _annotations(long):
    return long.select("feature").distinct().where("cast(substring(feature, 4, 9) as int) % 3 = 0").select("feature", F.concat(F.lit("name of "), "feature").alias("name"))


_NAMED = "an AS (SELECT DISTINCT feature, 'name of ' || feature AS name FROM p1 WHERE CAST(substr(feature, 4) AS INTEGER) % 3 = 0)"


@query("annotation_split", f"WITH {P1}, {_NAMED}, f AS (SELECT feature, round(avg(value), 4) AS mean FROM p1 GROUP BY 1) SELECT feature, mean, CASE WHEN feature IN (SELECT feature FROM an) THEN 'A' ELSE 'B' END AS path FROM f", 4)
def _(spark, sf):
    long = p1(spark, sf)
    a, b = reports.split_by_annotation(long.groupBy("feature").agg(F.avg("value").alias("mean")), _annotations(long))
    return a.withColumn("path", F.lit("A")).unionByName(b.withColumn("path", F.lit("B")))


@query("enriched_features", f"WITH {P1}, {_NAMED} SELECT feature, round(avg(value), 4) AS mean, any_value(name) AS name, CASE WHEN CAST(substr(feature, 4) AS INTEGER) < 120 THEN CAST(substr(feature, 4) AS DOUBLE) END AS mz FROM p1 LEFT JOIN an USING (feature) GROUP BY feature", 4)
def _(spark, sf):
    long = p1(spark, sf)
    mapping = long.select("feature").distinct().withColumn("mz", F.substring("feature", 4, 9).cast("double")).where("mz < 120")
    return reports.enrich(long.groupBy("feature").agg(F.avg("value").alias("mean")), _annotations(long), mapping)


@query("listed_pixel_means", f"WITH {P1} SELECT section_id || '_' || CAST(x // 7 AS VARCHAR) AS sample_id, feature, round(avg(value), 6) AS value, count(*) AS n_pixels FROM p1 GROUP BY 1, 2")
def _(spark, sf):
    name = F.concat_ws("_", "section_id", F.floor(F.col("x") / 7).cast("string"))
    samples = p1_pixels(spark, sf).groupBy(name.alias("sample_id")).agg(F.concat_ws(",", F.collect_list(F.col("pixel_id").cast("string"))).alias("pixel_ids"))
    return reports.average_listed_pixels(samples, p1(spark, sf))


_PAIRS = """pr AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, ((least(a.n_nationkey, b.n_nationkey) * 37 + greatest(a.n_nationkey, b.n_nationkey) * 11) % 101 + 1) / 5000.0 AS p FROM nation a CROSS JOIN nation b)"""


@query("triangular_bh", f"""WITH {_PAIRS}, u AS (SELECT *, count(*) OVER () AS m, row_number() OVER (ORDER BY p DESC) AS rn FROM pr WHERE a <= b), r AS (SELECT a, b, least(1.0, min(p * m / (m - rn + 1)) OVER (ORDER BY p DESC, rn ROWS UNBOUNDED PRECEDING)) AS adj, p FROM u), q AS (SELECT a, b, min(adj) OVER (PARTITION BY p) AS adj FROM r)
SELECT pr.a, pr.b, round(CAST(pr.p AS DOUBLE), 6) AS p, round(CAST(q.adj AS DOUBLE), 6) AS adj_p_value FROM pr JOIN q ON q.a = least(pr.a, pr.b) AND q.b = greatest(pr.a, pr.b)""")
def _(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"))
    pairs = n.crossJoin(n.withColumnRenamed("a", "b"))  # nations, a fixed few
    p = ((F.least("a", "b") * 37 + F.greatest("a", "b") * 11) % 101 + 1) / 5000.0
    return reports.triangular_adjust(pairs.withColumn("p", p), "a", "b", "p")


_N = "CAST(substr(feature, 4) AS INTEGER)"


@query("functional_peaks", f"WITH {P2} SELECT CAST(substr(feature, 4) AS DOUBLE) AS mz, CASE WHEN {_N} % 5 = 0 THEN 1.0 ELSE round(avg(value), 6) END AS p, CASE WHEN {_N} % 7 = 0 THEN 0.0 ELSE round(avg(value) - 0.1, 6) END AS t FROM p2 GROUP BY feature")
def _(spark, sf):
    number = F.substring("feature", 4, 9).cast("int")
    means = p2(spark, sf).groupBy("feature").agg(F.avg("value").alias("m"))
    found = means.select("feature", F.when(number % 5 != 0, F.col("m")).alias("p_value"), F.when(number % 7 != 0, F.col("m") - 0.1).otherwise(float("nan")).alias("effect_size"))
    more = spark.createDataFrame([("total", 0.1, 0.2)], "feature string, p_value double, effect_size double")
    return reports.functional_peak_list(found.unionByName(more)).toDF("mz", "p", "t")


@query("score_plot_data", f"WITH {P2} SELECT CAST(pixel_id AS VARCHAR) AS \"Sample\", round(max(value) FILTER (feature = 'mz_101'), 6) AS x, round(max(value) FILTER (feature = 'mz_102'), 6) AS y, 'Region_' || any_value(domain) AS \"Group\" FROM p2 GROUP BY pixel_id")
def _(spark, sf):
    px = p2_pixels(spark, sf)
    scores = px.select(F.col("pixel_id").cast("string").alias("Sample"), F.col("intensity")[0].alias("PC1"), F.col("intensity")[1].alias("PC2"), F.col("intensity")[2].alias("PC3"))
    return reports.score_plot(scores, px.select(F.col("pixel_id").cast("string").alias("sample_id"), F.col("domain").alias("cluster")))


@query("feature_view", f"WITH {P2}, m AS (SELECT feature, round(avg(value), 9) AS v FROM p2 GROUP BY 1), r AS (SELECT feature FROM m ORDER BY v DESC, feature LIMIT 1 OFFSET 2) SELECT feature, x, y, round(value, 6) AS value FROM p2 JOIN r USING (feature)")
def _(spark, sf):
    means = p2(spark, sf).groupBy(F.col("feature").alias("Feature")).agg(F.round(F.avg("value"), 9).alias("VIP"))
    return reports.feature_view(means, p2(spark, sf), 3)[1]


@query("feature_names", f"WITH {P1} SELECT CAST(substr(feature, 4) AS BIGINT) AS feature_id, CAST(substr(feature, 4) AS DOUBLE) + 0.25 AS mz, 'mz_' || CAST(CAST(substr(feature, 4) AS DOUBLE) + 0.25 AS VARCHAR) AS column_name FROM (SELECT DISTINCT feature FROM p1)")
def _(spark, sf):
    number = F.substring("feature", 4, 9)
    return pixels.make_feature_mapping(p1(spark, sf).select("feature").distinct().select(number.cast("long").alias("id"), (number.cast("double") + 0.25).alias("mz")))


@query("collapsed_values", "SELECT n_regionkey AS region, string_agg(n_name, '; ' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def _(spark, sf):
    names = F.array_sort(F.collect_list("n_name"))
    grouped = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("region")).agg(names.alias("n"))
    twice = F.flatten(F.array("n", "n", F.array(F.lit(""), F.lit(None).cast("string"))))
    return grouped.select("region", collapse_unique(twice).alias("names"))


@query("first_orders", "SELECT customer, o_orderkey FROM (SELECT o_custkey AS customer, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), "o_orderdate", "o_orderkey")
    return pixels.first_occurrence(orders, ["customer"], ["o_orderdate", "o_orderkey"]).select("customer", "o_orderkey")


@query("csv_series", f"""WITH {P2}, w AS (SELECT pixel_id % 2 AS s, x, y, feature, value FROM p2 WHERE NOT (pixel_id % 2 = 1 AND feature = 'mz_164'))
SELECT CASE WHEN s = 0 THEN 'even' ELSE 'odd' END AS section_id, CAST(s + 1 AS INTEGER) AS section_order, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, feature, round(value, 6) AS value FROM w WHERE feature <> 'mz_164'""")
def _(spark, sf):
    """Two sections written as CSV, one of them without the last feature, and loaded as a series of shared features."""
    folder, px = _folder(spark), p2_pixels(spark, sf)
    for name, odd, n in (("even", 0, 64), ("odd", 1, 63)):
        rows = px.where(F.col("pixel_id") % 2 == odd).select("x", "y", *(F.col("intensity")[i].alias(str(101 + i)) for i in range(n)))
        tables.write_outputs({name: rows}, folder)
    series, _ = tables.load_series(spark, [f"{folder}/even", f"{folder}/odd"])
    return pixels.to_long(series).select("section_id", "section_order", "x", "y", "feature", "value")


@query("manifest_rows", "SELECT * FROM (VALUES ('processing_parameter', 'graph.method', 'rook'), ('processing_parameter', 'graph.radius', '1.5'), ('processing_parameter', 'seed', '1'), ('run_metadata', 'sample', 's1')) t(record_type, key, value)")
def _(spark, sf):
    rows = tables.manifest(spark, [], {"sample": "s1"}, {"graph": {"method": "rook", "radius": 1.5}, "seed": 1})
    return rows.where("key not like '%version'").select("record_type", "key", "value")
