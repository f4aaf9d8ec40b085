"""Queries on labels, result tables, workflows and images, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import images, labels, preprocess, workflows
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


@query("matched_region_labels", f"WITH {P1} SELECT pixel_id, CASE WHEN x % 4 = 1 THEN 'a' || CAST(least(y % 3, 9) AS VARCHAR) END AS matched_region FROM p1p")
def _(spark, sf):
    px = p1_pixels(spark, sf)
    lab = px.where("x % 4 = 1").select("section_id", "x", "y", F.concat(F.lit("a"), (F.col("y") % 3).cast("string")).alias("matched_region"))
    twice = lab.unionByName(lab.withColumn("matched_region", F.lit("z")))
    return labels.apply_matched_region_labels(px, twice).select("pixel_id", "matched_region")


@query("roi_labels", f"WITH {P1} SELECT pixel_id, CASE WHEN y < 9 THEN 'top' END AS roi_id FROM p1p")
def _(spark, sf):
    px = p1_pixels(spark, sf)
    return labels.apply_roi_labels(px, px.where("y < 9").select("pixel_id", F.lit("top").alias("roi_id"))).select("pixel_id", "roi_id")


@query("resolved_labels", f"WITH {P2} SELECT pixel_id, CASE WHEN pixel_id % 2 = 0 THEN domain ELSE '-1' END AS label FROM p2p")
def _(spark, sf):
    px = p2_pixels(spark, sf)
    return labels.resolve_labels(px.drop("domain"), px.where("pixel_id % 2 = 0").select("x", "y", F.col("domain").alias("domain_label"))).select("pixel_id", "label")


@query("domain_map", f"WITH {P2} SELECT pixel_id, CAST(pixel_id % 4 - 1 AS INTEGER) AS domain_id, CASE WHEN pixel_id % 4 = 0 THEN 'background' ELSE 'tissue' END AS domain_type FROM p2p")
def _(spark, sf):
    px = p2_pixels(spark, sf).withColumn("sample_id_source", F.lit("s"))
    d = px.select(F.lit("s").alias("sample"), "x", "y", (F.col("pixel_id") % 4 - 1).alias("label"))
    return labels.map_domain_labels(px, d).select("pixel_id", "domain_id", "domain_type")


@query("cell_type_contract", f"WITH {P2} SELECT pixel_id AS object_id, domain AS cell_type, 1.0 AS confidence, 'provided' AS source_method, 'all' AS region_id, 'pixel' AS entity_type FROM p2p")
def _(spark, sf):
    rows = p2_pixels(spark, sf).select(F.col("pixel_id").alias("object_id"), "x", "y", F.col("domain").alias("cell_type"))
    return labels.prepare_cell_type_labels(rows, "pixel").select("object_id", "cell_type", "confidence", "source_method", "region_id", "entity_type")


@query("statistic_concordance", """WITH a AS (SELECT p_partkey AS k, (p_partkey % 20) / 100.0 AS q FROM part), b AS (SELECT p_partkey AS k, (p_partkey % 7) / 50.0 AS m, p_partkey % 3 - 1 AS i FROM part WHERE p_partkey % 5 <> 0)
SELECT printf('%.6f', a.k + 0.25) AS mz_key, CASE WHEN m IS NULL THEN 'not_tested' WHEN q <= 0.05 AND m <= 0.05 AND i > 0 THEN 'coherent' WHEN m <= 0.05 AND i > 0 THEN 'spatial_only' WHEN q <= 0.05 THEN 'differential_only' ELSE 'neither' END AS coherence FROM a LEFT JOIN b USING (k)""")
def _(spark, sf):
    part = table(spark, sf, "part").select((F.col("p_partkey") + 0.25).alias("mz"), F.col("p_partkey").alias("k"))
    a = part.select("mz", F.lit(0.5).alias("p_value"), ((F.col("k") % 20) / 100).alias("adj_p_value"))
    b = part.where("k % 5 <> 0").select("mz", (F.col("k") % 3 - 1).alias("statistic"), ((F.col("k") % 7) / 50).alias("adj_p_value"))
    return labels.statistic_concordance(a, b).select("mz_key", "coherence")


@query("lipid_names", "SELECT * FROM (VALUES ('PC 1'), ('PE 2'), ('PG 3')) t(name)")
def _(spark, sf):
    mapped = spark.createDataFrame([(1, "PC 1; PE 2", 7, True), (2, "PG 3|PC 1", 7, True), (3, "no", 8, True), (4, "off", 7, False)], "annotation_id int, name string, feature_id int, matched boolean")
    return labels.lipid_names(mapped, spark.createDataFrame([(7, 0.01), (8, 0.9)], "feature_id int, p_value double"))[1]


@query("compound_rollup", "SELECT p_partkey % 10 AS compound_id, round(min(p_retailprice), 6) AS p_value, min(p_size) AS fdr, string_agg(DISTINCT p_brand, '; ' ORDER BY p_brand) AS names FROM part GROUP BY 1")
def _(spark, sf):
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 10).alias("compound_id"), F.col("p_retailprice").alias("p_value"), F.col("p_size").alias("fdr"), F.lit(1.0).alias("effect"), F.col("p_brand").alias("name"))
    return labels.compound_rollup(rows).drop("effect")


@query("scenario_union", "SELECT p_brand AS feature, s.scenario, s.scenario = 'strict' AND p_brand IN ('Brand#1','Brand#11') AS excluded, count(*) AS n FROM part, (VALUES ('all'), ('strict')) s(scenario) GROUP BY 1, 2, 3")
def _(spark, sf):
    rows = table(spark, sf, "part").select(F.col("p_brand").alias("feature"))
    return labels.scenario_union(rows, {"all": [], "strict": ["Brand#1", "Brand#11"]}).groupBy("feature", "scenario", "excluded").agg(F.count("*").alias("n"))


@query("normalized_result", 'SELECT s_name AS "Feature", round(s_acctbal, 6) AS "VIP", \'x\' AS source FROM supplier ORDER BY s_acctbal DESC, s_name LIMIT 10')
def _(spark, sf):
    raw = table(spark, sf, "supplier").select(F.col("s_name").alias("Metabolite"), F.col("s_acctbal").alias("V.I.P"))
    return labels.rank_features(labels.normalize_result(raw, "x"), n=10)


@query("screened_features", f"""WITH {P1}, t AS (SELECT pixel_id, sum(value) AS tic FROM p1 GROUP BY 1), m AS (SELECT median(tic) AS md FROM t WHERE tic > 0), n AS (SELECT feature, log10(CASE WHEN tic > 0 THEN value / tic * md ELSE 0 END + 1) AS v FROM p1 JOIN t USING (pixel_id), m),
s AS (SELECT feature, stddev_samp(v) / avg(v) AS cv, avg(v) AS mean, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0.0 END) AS nz FROM n GROUP BY 1), c AS (SELECT quantile_cont(cv, 0.3) AS q FROM s) SELECT feature, round(cv, 6) AS cv FROM s, c WHERE cv >= q AND mean > 0 AND nz >= 0.01""")
def _(spark, sf):
    return workflows.preprocess_select_features(p1(spark, sf), nonzero_min=0.01).tables["features"].select("feature", "cv")


@query("distance_gradient")
def _(spark, sf):
    long = p2(spark, sf).withColumn("subject_id", F.col("pixel_id") % 6)
    return workflows.analyze_distance_gradient(long, p2_pixels(spark, sf), "d3", 50, 25, "subject_id").tables["contrasts"]


@query("projected_mask", f"WITH {P2}, g AS (SELECT unnest(range(0, 60)) AS x) , h AS (SELECT unnest(range(0, 30)) AS y) SELECT g.x, h.y, EXISTS (SELECT 1 FROM p2p WHERE p2p.x = round(g.x / 2.0) AND p2p.y = round(h.y / 2.0)) AS measured FROM g CROSS JOIN h")
def _(spark, sf):
    return workflows.project_mask(p2_pixels(spark, sf), [[0.5, 0, 0], [0, 0.5, 0], [0, 0, 1]], 60, 30)


@query("segmented_nuclei")
def _(spark, sf):
    y, x = np.mgrid[0:40, 0:40]
    grey = np.full((40, 40), 200.0)
    for cy, cx, r in ((10, 10, 5), (10, 17, 5), (30, 28, 6)):
        grey[(y - cy) ** 2 + (x - cx) ** 2 <= r * r] = 40.0
    return images.segment_images(spark.createDataFrame([("i", 40, 40, grey.ravel().tolist())], "image_id string, width int, height int, grey array<double>"))


@query("positive_pixels", f"WITH {P1}, n AS (SELECT pixel_id, count(*) FILTER (value > 0) AS n FROM p1 GROUP BY 1) SELECT pixel_id, feature, round(value, 4) AS value FROM p1 JOIN n USING (pixel_id) WHERE n >= 6 AND value > 0", 4)
def _(spark, sf):
    return preprocess.nonzero_filter(p1(spark, sf), 6).where("value > 0").select("pixel_id", "feature", "value")
