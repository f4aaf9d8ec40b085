"""Queries on regions of interest, geometry and registration, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import regions, registration
from .bindings import P1, P2, p1, p1_pixels, p2_pixels, rounded

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


BOXES = [("left", 0, 20, 5, 30), ("right", 45, 18, 35, 10), ("none", float("nan"), 1, 2, 3)]
BOX_CASE = "CASE WHEN x BETWEEN 18 AND 45 AND y BETWEEN 10 AND 35 THEN 'right' WHEN x BETWEEN 0 AND 20 AND y BETWEEN 5 AND 30 THEN 'left' END"


@query("roi_boxes", f"WITH {P1} SELECT pixel_id, {BOX_CASE} AS roi_id FROM p1p")
def _(spark, sf):
    return regions.roi_boxes(p1_pixels(spark, sf), BOXES).select("pixel_id", "roi_id")


@query("roi_circle", f"WITH {P1} SELECT pixel_id, (x - 25) * (x - 25) + (y - 20) * (y - 20) <= 100 AS inside FROM p1p")
def _(spark, sf):
    return p1_pixels(spark, sf).select("pixel_id", regions.membership(F.col("x"), F.col("y"), 25, 20, 20, "circle").alias("inside"))


@query("roi_polygon_holes", f"""WITH {P1} SELECT pixel_id, (x BETWEEN 5 AND 40 AND y BETWEEN 5 AND 30 AND x + y <= 60) AND NOT (x BETWEEN 10 AND 20 AND y BETWEEN 10 AND 20) AS inside FROM p1p""")
def _(spark, sf):
    outer, hole = [(5, 5), (40, 5), (40, 20), (30, 30), (5, 30)], [(10, 10), (20, 10), (20, 20), (10, 20)]
    return p1_pixels(spark, sf).select("pixel_id", regions.point_in_polygon(F.col("x"), F.col("y"), outer, [hole]).alias("inside"))


@query("roi_overlap_policy", f"WITH {P1} SELECT pixel_id, CASE WHEN x <= 20 THEN 'a' WHEN x BETWEEN 15 AND 30 THEN 'b' END AS first_id, CASE WHEN x BETWEEN 15 AND 30 THEN 'b' WHEN x <= 20 THEN 'a' END AS last_id FROM p1p")
def _(spark, sf):
    masks = [("a", F.col("x") <= 20), ("b", F.col("x").between(15, 30))]
    first = regions.apply_overlap(p1_pixels(spark, sf), masks, "first").select("pixel_id", F.col("roi_id").alias("first_id"))
    return first.join(regions.apply_overlap(p1_pixels(spark, sf), masks, "last").select("pixel_id", F.col("roi_id").alias("last_id")), "pixel_id")


def _samples_sql(scope: str) -> str:
    keys = "roi" if scope == "roi" else "1"
    part = "PARTITION BY roi" if scope == "roi" else ""
    del keys
    return f"""WITH {P1}, a AS (SELECT pixel_id, section_id AS roi, x, y FROM p1p), b AS (SELECT *, min(x) OVER ({part}) AS x0, max(x) OVER ({part}) AS x1, min(y) OVER ({part}) AS y0, max(y) OVER ({part}) AS y1 FROM a),
g AS (SELECT pixel_id, roi, CAST(greatest(1, ceil((x - x0) * 5 / (x1 - x0))) AS BIGINT) AS gx, CAST(greatest(1, ceil((y - y0) * 5 / (y1 - y0))) AS BIGINT) AS gy FROM b),
t AS (SELECT roi, gx, gy, count(*) AS n_pixels FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 10)
SELECT roi || '_' || gx || '_' || gy AS sample_id, feature, round(avg(value), 8) AS value, any_value(n_pixels) AS n_pixels FROM p1 JOIN g USING (pixel_id) JOIN t USING (roi, gx, gy) GROUP BY 1, 2"""


def _subregions(spark, sf, scope):
    return regions.sample_subregions(p1(spark, sf), 5, 10, "section_id", scope).select("sample_id", "feature", "value", "n_pixels")


@query("sample_subregions_global", _samples_sql("global"), 8)
def _(spark, sf):
    return _subregions(spark, sf, "global")


@query("sample_subregions_roi", _samples_sql("roi"), 8)
def _(spark, sf):
    return _subregions(spark, sf, "roi")


@query("sample_matched_regions", f"""WITH {P1}, r AS (SELECT p1.*, CASE WHEN x < 25 THEN 'west side' ELSE 'east' END AS region FROM p1),
n AS (SELECT section_id, region, count(DISTINCT pixel_id) AS n_pixels FROM r GROUP BY 1, 2 HAVING count(DISTINCT pixel_id) >= 30)
SELECT section_id || '__' || replace(region, ' ', '%20') AS sample_id, feature, round(avg(value), 8) AS value, any_value(n_pixels) AS n_pixels FROM r JOIN n USING (section_id, region) GROUP BY 1, 2""", 8)
def _(spark, sf):
    long = p1(spark, sf).withColumn("region", F.when(F.col("x") < 25, "west side").otherwise("east"))
    return regions.sample_matched_regions(long, "region").select("sample_id", "feature", "value", "n_pixels")


@query("metaboanalyst_table", f"""WITH {P1} SELECT section_id AS "Sample", 'Region_' || section_id AS "Group", round(avg(value) FILTER (feature = 'mz_101'), 8) AS mz_101, round(avg(value) FILTER (feature = 'mz_102'), 8) AS mz_102 FROM p1 GROUP BY 1, 2""", 8)
def _(spark, sf):
    rows = p1(spark, sf).groupBy("section_id", "feature").agg(F.avg("value").alias("value")).withColumn("sample_id", F.col("section_id"))
    return regions.metaboanalyst_table(rows, "section_id", ["mz_101", "mz_102"], "Region_")


@query("backmap_scores", f"WITH {P1} SELECT pixel_id, section_id AS sample_id, round(length(section_id) + 0.5, 6) AS score FROM p1p")
def _(spark, sf):
    mapping = p1_pixels(spark, sf).groupBy(F.col("section_id").alias("sample_id")).agg(regions.pixel_ids_text().alias("pixel_ids"))
    scores = mapping.select("sample_id", (F.length("sample_id") + F.lit(0.5)).alias("score"))
    return regions.backmap_scores(scores, mapping, "score")


@query("domain_candidates", f"""WITH RECURSIVE {P2}, e0 AS (SELECT least(a.pixel_id, b.pixel_id) AS src, greatest(a.pixel_id, b.pixel_id) AS dst FROM p2p a JOIN p2p b ON a.domain = b.domain AND ((b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1))),
both_ AS (SELECT src AS a, dst AS b FROM e0 UNION SELECT dst, src FROM e0), reach AS (SELECT pixel_id AS a, pixel_id AS c FROM p2p UNION SELECT b.b, r.c FROM reach r JOIN both_ b ON b.a = r.a), comp AS (SELECT a AS pixel_id, min(c) AS component FROM reach GROUP BY 1)
SELECT component, domain, count(*) AS n_pixels, round(avg(x), 6) AS x_center, round(avg(y), 6) AS y_center FROM comp JOIN p2p USING (pixel_id) GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(spark, sf):
    return regions.domain_candidates(p2_pixels(spark, sf), 2).select("component", "domain", "n_pixels", "x_center", "y_center")


@query("corroborate_labels", f"""WITH {P2}, l AS (SELECT domain AS a, 'q' || CAST(x // 9 AS VARCHAR) AS b FROM p2p), n AS (SELECT a, b, count(*) AS n FROM l GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY n DESC, a) AS rb FROM n)
SELECT a, b, n, round(n / na, 6) AS a_fraction, round(n / nb, 6) AS b_fraction, round(n / (na + nb - n), 6) AS jaccard, ra = 1 AND rb = 1 AS mutual, ra = 1 AND n / na >= 0.3 AND ra = 1 AND rb = 1 AND n / nb >= 0.1 AND n / nb >= 0.3 AS accepted FROM w""")
def _(spark, sf):
    rows = p2_pixels(spark, sf).select(F.col("domain").alias("a0"), F.concat(F.lit("q"), F.floor(F.col("x") / 9).cast("string")).alias("b0"))
    return regions.corroborate_labels(rows, "a0", "b0", 0.3)


@query("roi_score", f"""WITH {P2}, m AS (SELECT CASE WHEN x < 8 THEN 1 WHEN x < 16 THEN 2 ELSE 3 END AS candidate, domain FROM p2p), c AS (SELECT candidate, count(*) AS n, count(*) FILTER (domain = 'd1') AS c0, count(*) FILTER (domain = 'd2') AS c1 FROM m GROUP BY 1), t AS (SELECT count(*) AS f FROM p2p),
s AS (SELECT candidate, n, 1.0 AS coverage, (0.5 * c0 + 0.5 * c1) / (sqrt(c0 * c0 + c1 * c1) * sqrt(0.5)) AS balance, (1 / (1 + exp(-12 * (n / f - 0.1))) - 1 / (1 + exp(1.2))) / (1 / (1 + exp(-10.8)) - 1 / (1 + exp(1.2))) AS size FROM c, t)
SELECT candidate, n, coverage, round(balance, 6) AS balance, round(least(1, size), 6) AS size, round(exp((ln(coverage) + ln(balance) + ln(least(1, size))) / 3), 6) AS score FROM s""")
def _(spark, sf):
    pixels = p2_pixels(spark, sf)
    members = pixels.select(F.when(F.col("x") < 8, 1).when(F.col("x") < 16, 2).otherwise(3).alias("candidate"), "pixel_id")
    return regions.score_candidates(members, pixels, {"d1": 0.5, "d2": 0.5})


@query("roi_beam_search")
def _(spark, sf):
    pixels = p2_pixels(spark, sf)
    _, members = regions.grid_candidates(pixels, 4, 30)
    rows = members.join(pixels.select("pixel_id", "domain"), "pixel_id").groupBy("candidate").agg(F.collect_list("pixel_id").alias("m"), F.collect_list("domain").alias("d")).collect()
    vectors = {r["candidate"]: (set(r["m"]), {k: r["d"].count(k) for k in set(r["d"])}) for r in rows}
    chosen, history = regions.optimize_rois(vectors, {f"d{i}": 0.1 for i in range(10)}, pixels.count(), 5)
    return spark.createDataFrame([(i + 1, c, h) for i, (c, h) in enumerate(zip(chosen, [history[-1]] * len(chosen), strict=True))], "rank int, candidate long, score double")


@query("slide_area", f"WITH {P1} SELECT round((max(x) - min(x) + 1.0) * (max(y) - min(y) + 1.0), 6) AS area FROM p1p")
def _(spark, sf):
    return regions.slide_area(p1_pixels(spark, sf))


@query("boundary_edges", f"""WITH {P1}, q AS (SELECT section_id, {BOX_CASE} AS roi_id, x, y FROM p1p), r AS (SELECT * FROM q WHERE roi_id IS NOT NULL),
s AS (SELECT section_id, roi_id, x AS x0, y AS y0, x + 1 AS x1, y AS y1 FROM r UNION ALL SELECT section_id, roi_id, x, y + 1, x + 1, y + 1 FROM r UNION ALL SELECT section_id, roi_id, x, y, x, y + 1 FROM r UNION ALL SELECT section_id, roi_id, x + 1, y, x + 1, y + 1 FROM r)
SELECT section_id, roi_id, x0, y0, x1, y1 FROM s GROUP BY ALL HAVING count(*) = 1""")
def _(spark, sf):
    return regions.boundary_edges(regions.roi_boxes(p1_pixels(spark, sf), BOXES).where("roi_id is not null"))


@query("region_polygons")
def _(spark, sf):
    return regions.region_polygons(regions.roi_boxes(p1_pixels(spark, sf), BOXES).where("roi_id is not null").select("section_id", "roi_id", "x", "y"))


SHAPES = [("s", "a", 1, 1, "outer", i + 1, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (4, 0), (4, 3), (0, 3), (0, 0)])] + [("s", "a", 1, 2, "hole", i + 1, float(x), float(y)) for i, (x, y) in enumerate([(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)])] + [("s", "b", 1, 1, "outer", i + 1, float(x), float(y)) for i, (x, y) in enumerate([(4.5, 0), (6.5, 0), (6.5, 2), (4.5, 2), (4.5, 0)])]
SHAPE_SCHEMA = "section_id string, roi_id string, polygon_part_id int, ring_id int, ring_role string, vertex_order int, x double, y double"


@query("shoelace_area", "SELECT * FROM (VALUES ('a', 1, 'outer', 12.0), ('a', 2, 'hole', 1.0), ('b', 1, 'outer', 4.0)) t(roi_id, ring_id, ring_role, area)")
def _(spark, sf):
    return regions.ring_areas(spark.createDataFrame(SHAPES, SHAPE_SCHEMA)).select("roi_id", "ring_id", "ring_role", "area")


@query("lmd_qc", "SELECT * FROM (VALUES ('a', 11.0, 0.5, 'area_above_maximum;spacing_below_minimum'), ('b', 4.0, 0.5, 'spacing_below_minimum')) t(roi_id, net_area, spacing, qc_reason)")
def _(spark, sf):
    return regions.validate_shapes(spark.createDataFrame(SHAPES, SHAPE_SCHEMA), 10, 1.0, 1.0).select("roi_id", "net_area", "spacing", "qc_reason")


# --- registration -----------------------------------------------------------------------------------


def _control(spark, sf):
    cols = {"msi_x": 2.0 * F.col("x") + 0.5 * F.col("y") + 7 + F.col("pixel_id") % 3 * 0.01, "msi_y": -0.25 * F.col("x") + 1.5 * F.col("y") - 3}
    return p1_pixels(spark, sf).select("section_id", F.col("x").cast("double").alias("histology_x"), F.col("y").cast("double").alias("histology_y"), *(v.alias(k) for k, v in cols.items()))


@query("affine_fit", f"""WITH {P1}, c AS (SELECT section_id, x, y, 2.0 * x + 0.5 * y + 7 + (pixel_id % 3) * 0.01 AS u, -0.25 * x + 1.5 * y - 3 AS v FROM p1p),
m AS (SELECT section_id, count(*) AS n_points, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, u) AS xu, covar_pop(y, u) AS yu, covar_pop(x, v) AS xv, covar_pop(y, v) AS yv, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM c GROUP BY 1),
f AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS ux, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS uy, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS vx, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS vy FROM m)
SELECT f.section_id, any_value(n_points) AS n_points, round(any_value(ux), 6) AS ux, round(any_value(uy), 6) AS uy, round(any_value(vx), 6) AS vx, round(any_value(vy), 6) AS vy, round(sqrt(avg((mu + ux * (x - mx) + uy * (y - my) - u) ** 2 + (mv + vx * (x - mx) + vy * (y - my) - v) ** 2)), 6) AS rmse FROM c JOIN f USING (section_id) GROUP BY 1""")
def _(spark, sf):
    return registration.fit_affine(_control(spark, sf)).select("section_id", "n_points", "ux", "uy", "vx", "vy", "rmse")


@query("affine_apply", f"WITH {P1} SELECT pixel_id, round(2.0 * x + 0.5 * y + 7, 6) AS msi_x, round(-0.25 * x + 1.5 * y - 3, 6) AS msi_y FROM p1p")
def _(spark, sf):
    control = _control(spark, sf).withColumn("msi_x", 2.0 * F.col("histology_x") + 0.5 * F.col("histology_y") + 7)
    return registration.apply_affine(p1_pixels(spark, sf), registration.fit_affine(control)).select("pixel_id", "msi_x", "msi_y")


@query("projective_apply", f"WITH {P1}, o AS (SELECT min(x) AS x0, min(y) AS y0 FROM p1p) SELECT pixel_id, round((4.0 * (x - x0) + 100) / (0.001 * (x - x0) + 1), 6) AS image_x, round((4.0 * (y - y0) + 200) / (0.001 * (x - x0) + 1), 6) AS image_y FROM p1p, o")
def _(spark, sf):
    return registration.apply_projective(p1_pixels(spark, sf), [[4.0, 0, 100], [0, 4.0, 200], [0.001, 0, 1]]).select("pixel_id", "image_x", "image_y")


@query("mask_dice", f"""WITH {P1}, u AS (SELECT DISTINCT x, y FROM p1p), a AS (SELECT * FROM u WHERE x BETWEEN 5 AND 30 AND y BETWEEN 5 AND 30), b AS (SELECT * FROM u WHERE x BETWEEN 8 AND 33 AND y BETWEEN 5 AND 30)
SELECT round((SELECT count(*) FROM a JOIN b USING (x, y)) / (SELECT count(*) FROM a), 6) AS overlap, round(2 * (SELECT count(*) FROM a JOIN b USING (x, y)) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS dice""")
def _(spark, sf):
    u = p1_pixels(spark, sf).select("x", "y").distinct()
    a, b = (u.where(F.col("x").between(lo, lo + 25) & F.col("y").between(5, 30)) for lo in (5, 8))
    return registration.mask_agreement(a, b).select("overlap", "dice")


