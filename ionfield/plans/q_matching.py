"""Queries on mass matching, evidence, formulas and pathways, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as ex
from ..operators import matching
from ..sources import formats
from .bindings import P1, p1, rounded, table

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def _msi(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("msi_id"), (F.lit(100) + F.col("p_partkey") * F.lit(0.0007)).alias("msi_mz"), F.when(F.col("p_partkey") % 2 == 0, "pos").otherwise("neg").alias("mode"), (F.col("p_partkey") % 5 - 2).cast("double").alias("log2fc"))


def _lc(spark, sf):
    mz = (F.lit(100) + F.col("s_suppkey") * F.lit(0.0049)) * (F.lit(1.0) + ((F.col("s_suppkey") % 7) - 3) * F.lit(0.0000011))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lc_id"), mz.alias("lc_mz"), F.when(F.col("s_suppkey") % 2 == 0, "pos").otherwise("neg").alias("mode"), (F.col("s_suppkey") % 3 - 1).cast("double").alias("log2fc"))


M = """
msi AS (SELECT p_partkey AS msi_id, CAST(100 AS DOUBLE) + p_partkey * CAST(0.0007 AS DOUBLE) AS msi_mz, p_partkey % 2 AS md, p_partkey % 5 - 2 AS fc FROM part),
lc AS (SELECT s_suppkey AS lc_id, (CAST(100 AS DOUBLE) + s_suppkey * CAST(0.0049 AS DOUBLE)) * (CAST(1 AS DOUBLE) + (s_suppkey % 7 - 3) * CAST(0.0000011 AS DOUBLE)) AS lc_mz, s_suppkey % 2 AS md, s_suppkey % 3 - 1 AS fc FROM supplier),
c AS (SELECT msi_id, lc_id, msi_mz, lc_mz, abs(lc_mz - msi_mz) / msi_mz * 1e6 AS e FROM msi JOIN lc ON msi.md = lc.md AND abs(lc_mz - msi_mz) / msi_mz * 1e6 <= 9.3 + 2.220446049250313e-16)
"""


@query("ppm_candidates", f"WITH {M} SELECT msi_id, lc_id, round(e, 4) AS ppm_error, row_number() OVER (PARTITION BY msi_id ORDER BY e, lc_id) AS candidate_rank, count(*) OVER (PARTITION BY msi_id) AS candidate_count FROM c", 4)
def _(spark, sf):
    return matching.find_candidates(_msi(spark, sf), _lc(spark, sf), 9.3).select("msi_id", "lc_id", "ppm_error", "candidate_rank", "candidate_count")


@query("match_rows_by_ppm", f"WITH {M} SELECT msi_id, lc_id FROM msi JOIN lc ON abs(msi_mz - lc_mz) / lc_mz * 1e6 <= 5.1")
def _(spark, sf):
    return matching.ppm_pairs(_msi(spark, sf).select("msi_id", "msi_mz"), _lc(spark, sf).select("lc_id", "lc_mz"), 5.1, "msi_mz", "lc_mz").select("msi_id", "lc_id")


@query("greedy_assignment")
def _(spark, sf):
    return matching.assign(matching.find_candidates(_msi(spark, sf), _lc(spark, sf), 9.3), 9.3, "greedy").select("msi_id", "lc_id", "ppm_error")


@query("optimal_assignment")
def _(spark, sf):
    return matching.assign(matching.find_candidates(_msi(spark, sf), _lc(spark, sf), 9.3), 9.3, "optimal").select("msi_id", "lc_id", "ppm_error")


@query("cross_validation", f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY msi_id ORDER BY e, lc_id) AS k, count(*) OVER (PARTITION BY msi_id) AS n FROM c)
SELECT count(*) AS n_matched, count(*) FILTER (n > 1) AS n_ambiguous, round(avg(CASE WHEN sign(msi.fc) = sign(lc.fc) THEN 1.0 ELSE 0.0 END), 6) AS agreement_rate FROM r JOIN msi USING (msi_id) JOIN lc USING (lc_id) WHERE k = 1""")
def _(spark, sf):
    best = matching.find_candidates(_msi(spark, sf), _lc(spark, sf), 9.3).where("candidate_rank = 1").select("msi_id", "lc_id", "candidate_count")
    return matching.cross_validate(best, _msi(spark, sf), _lc(spark, sf))[1]


@query("nearest_intensity", """WITH t(feature, target) AS (VALUES ('mz_5', 5.0), ('mz_20', 20.0), ('mz_45', 45.0)), e AS (SELECT user_id % 50 AS pixel_id, value AS mz, CAST(event_id % 1000 AS DOUBLE) AS i FROM events WHERE value > 0),
p AS (SELECT DISTINCT pixel_id FROM e), h AS (SELECT pixel_id, feature, i, row_number() OVER (PARTITION BY pixel_id, feature ORDER BY abs(mz - target), mz, i) AS r FROM e JOIN t ON abs(mz - target) / target * 1e6 <= 20000)
SELECT p.pixel_id, t.feature, coalesce(h.i, 0.0) AS value FROM p CROSS JOIN t LEFT JOIN h ON h.pixel_id = p.pixel_id AND h.feature = t.feature AND r = 1""")
def _(spark, sf):
    e = table(spark, sf, "events").where("value > 0").groupBy((F.col("user_id") % 50).alias("pixel_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("value").alias("mz"), (F.col("event_id") % 1000).cast("double").alias("i")))).alias("p"))
    targets = spark.createDataFrame([("mz_5", 5.0), ("mz_20", 20.0), ("mz_45", 45.0)], "feature string, target double")
    return matching.nearest_intensity(e.select("pixel_id", F.col("p.mz").alias("mz"), F.col("p.i").alias("intensity")), targets, 20000)


LEFT = [(200.0005, "C10H19O2", "a"), (200.0004, "C10H20O2", "b"), (300.0, "C6H12O6", "c"), (400.0, "CH4", "d")]
RIGHT = [(200.0001, "C10H20O2", "x"), (300.0002, "C6H12O6", "y"), (500.0, "H2O", "z")]
FEATURES = [(1, 200.0), (2, 300.0), (3, 400.0), (4, 500.0), (5, 600.0)]


@query("annotation_classes", "SELECT * FROM (VALUES (1, 'candidate_overlap', 'candidate_overlap', 'a; b', 'x'), (2, 'exact_match', 'exact_match', 'c', 'y'), (3, 'unilateral_missing', 'unilateral_missing', 'd', NULL), (4, 'unilateral_missing', 'unilateral_missing', NULL, 'z'), (5, 'both_missing', 'both_missing', NULL, NULL)) t(feature_id, raw_class, best_class, left_names, right_names)")
def _(spark, sf):
    frames = [spark.createDataFrame(x, "mz double, formula string, name string") for x in (LEFT, RIGHT)]
    out = matching.cross_validate_annotations(spark.createDataFrame(FEATURES, "feature_id int, mz double"), *frames, 5)
    return out.select("feature_id", "raw_class", "best_class", "left_names", "right_names")


@query("ccs_grades", """SELECT * FROM (VALUES (1, 'p', 'consistent_measured', true, 2, true), (1, 'q', 'consistent_predicted', true, 2, true), (2, 'p', 'inconsistent', false, 0, false), (3, 'r', 'not_available', false, 0, false)) t(observation_id, candidate_id, ccs_grade, supports_msi_identity, passing_candidates, ambiguous_candidate_set)""")
def _(spark, sf):
    obs = spark.createDataFrame([(1, "p", 200.0, "msi_empirical"), (1, "q", 200.0, "msi_empirical"), (2, "p", 250.0, "lcms"), (3, "r", 100.0, "lcms")], "observation_id int, candidate_id string, observed_ccs double, observed_source string")
    ref = spark.createDataFrame([("p", 202.0, "measured"), ("q", 198.5, "predicted")], "candidate_id string, reference_ccs double, reference_source string")
    return matching.ccs_evidence(obs, ref, 2.0, ("candidate_id",)).select("observation_id", "candidate_id", "ccs_grade", "supports_msi_identity", "passing_candidates", "ambiguous_candidate_set")


@query("roi_concordance", f"""WITH {P1}, m AS (SELECT section_id || CAST(x // 10 AS VARCHAR) AS roi, feature, avg(value) AS v FROM p1 GROUP BY 1, 2),
mp AS (SELECT 'mz_' || CAST(k AS VARCHAR) AS a, 'mz_' || CAST(k + 1 AS VARCHAR) AS b FROM (SELECT CAST(unnest(range(101, 150)) AS BIGINT) AS k)), x AS (SELECT mp.a, mp.b, m.v AS va, n.v AS vb FROM mp JOIN m ON m.feature = mp.a JOIN m n ON n.feature = mp.b AND n.roi = m.roi),
r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY va) + (count(*) OVER (PARTITION BY a, b, va) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY a, b ORDER BY vb) + (count(*) OVER (PARTITION BY a, b, vb) - 1) / 2.0 AS rb FROM x)
SELECT a AS msi_feature, b AS lcm_feature, count(*) AS n_pairs, round(corr(ra, rb), 6) AS correlation FROM r GROUP BY 1, 2""")
def _(spark, sf):
    rows = p1(spark, sf).groupBy(F.concat("section_id", F.floor(F.col("x") / 10).cast("string")).alias("roi_id"), "feature").agg(F.avg("value").alias("value"))
    mapping = spark.createDataFrame([(f"mz_{k}", f"mz_{k + 1}") for k in range(101, 150)], "msi_feature string, lcm_feature string")
    return matching.quantification_concordance(rows, rows, mapping, ("roi_id",))


@query("lipid_mapping", "SELECT * FROM (VALUES (1, 7, true, 2.0), (2, 7, true, -1.0), (3, NULL, false, NULL)) t(annotation_id, feature_id, matched, ppm_error)", 3)
def _(spark, sf):
    ann = spark.createDataFrame([(1, 499.999 + 0.0000000020), (2, 500.0005), (3, 700.0)], "annotation_id int, input_mass double")
    feats = spark.createDataFrame([(7, 500.0), (8, 800.0)], "feature_id int, mz double")
    return matching.lipid_mapping(ann, feats, 5).select("annotation_id", "feature_id", "matched", "ppm_error")


@query("msms_evidence", """WITH d(label, target_mz) AS (VALUES ('a', 10.0), ('b', 25.0), ('c', 49.9), ('d', 400.0)), core AS (SELECT DISTINCT user_id AS scan FROM events WHERE user_id % 4 = 0),
h AS (SELECT user_id AS scan, label, max(event_id % 1000) AS i FROM events JOIN core ON scan = user_id JOIN d ON abs(value - target_mz) <= 0.02 GROUP BY 1, 2),
n AS (SELECT label, count(*) FILTER (i / 1000.0 >= 0.3) AS q, count(*) AS m FROM h GROUP BY 1)
SELECT d.label, coalesce(q, 0) AS n_qualifying, coalesce(m, 0) AS n_matched, CASE WHEN q >= 2 THEN 'repeated_diagnostic_support' WHEN q = 1 THEN 'single_scan_support' WHEN m > 0 THEN 'trace_match' ELSE 'not_detected' END AS grade FROM d LEFT JOIN n USING (label)""")
def _(spark, sf):
    e = table(spark, sf, "events")
    scans = e.select(F.col("user_id").alias("scan_number")).distinct().select("scan_number", F.when(F.col("scan_number") % 4 == 0, 500.0).otherwise(600.0).alias("precursor_mz"), F.lit(500.0).alias("isolation_target_mz"), F.lit(0.5).alias("isolation_lower_offset"), F.lit(0.5).alias("isolation_upper_offset"), F.lit(1000.0).alias("base_peak_intensity"))
    peaks = e.select(F.col("user_id").alias("scan_number"), F.col("value").alias("fragment_mz"), (F.col("event_id") % 1000).cast("double").alias("fragment_intensity"))
    diagnostics = spark.createDataFrame([("a", 10.0), ("b", 25.0), ("c", 49.9), ("d", 400.0)], "label string, target_mz double")
    return matching.msms_evidence(scans, peaks, diagnostics, 500.0, min_relative=0.3)[0].select("label", "n_qualifying", "n_matched", "grade")


FORMULAS = ["C6H12O6", "CH3CH2OH", "NaCl", "C10H16N5O13P3", "H2O", ""]


@query("formula_parse", "SELECT * FROM (VALUES ('C6H12O6', 'C6H12O6', 'C6H13O6'), ('CH3CH2OH', 'C2H6O', 'C2H7O'), ('NaCl', 'ClNa', 'HClNa'), ('C10H16N5O13P3', 'C10H16N5O13P3', 'C10H17N5O13P3'), ('H2O', 'H2O', 'H3O'), ('', NULL, NULL)) t(formula, canonical, plus_h)")
def _(spark, sf):
    df = spark.createDataFrame([(f,) for f in FORMULAS], "formula string")
    return df.select("formula", ex.format_formula(ex.parse_formula(F.col("formula"))).alias("canonical"), ex.add_hydrogen(F.col("formula")).alias("plus_h"))


@query("formula_overlap", "SELECT * FROM (VALUES (1, 'both_missing'), (2, 'unilateral_missing'), (3, 'exact_match'), (4, 'candidate_overlap'), (5, 'discordant')) t(id, class)")
def _(spark, sf):
    df = spark.createDataFrame([(1, None, []), (2, ["a"], []), (3, ["a", "b"], ["b", "a"]), (4, ["a"], ["a", "c"]), (5, ["a"], ["b"])], "id int, x array<string>, y array<string>")
    return df.select("id", ex.formula_overlap(F.col("x"), F.col("y")).alias("class"))


@query("normalized_logistic", f"""WITH {P1}, u AS (SELECT DISTINCT x / 50.0 AS v FROM p1p) SELECT round(v, 6) AS v, round(greatest(0, least(1, (1 / (1 + exp(-12 * (v - 0.1))) - 1 / (1 + exp(1.2))) / (1 / (1 + exp(-10.8)) - 1 / (1 + exp(1.2))))), 6) AS s FROM u""")
def _(spark, sf):
    return p1(spark, sf).select((F.col("x") / 50).alias("v")).distinct().select("v", ex.normalized_logistic(F.col("v")).alias("s"))


@query("pathway_links", "SELECT * FROM (VALUES ('p1', 'C1', 'mz_101', 'compound_id'), ('p1', 'C2', 'mz_102', 'compound_name'), ('p2', 'C3', 'mz_103', 'mz')) t(pathway, compound_id, feature, link)")
def _(spark, sf):
    objects = spark.createDataFrame([('{"ora": {"p1": ["C1", "C2"], "p2": ["C3", "C9"]}}',)], "json string")
    names = spark.createDataFrame([("C1", "one", 1.0), ("C2", "two", 2.0), ("C3", "three", 103.5), ("C9", "nine", 9.0)], "compound_id string, compound_name string, mz double")
    meta = spark.createDataFrame([("mz_101", "C1", None, None), ("mz_102", None, "two", None), ("mz_103", None, None, 103.5)], "feature string, compound_id string, compound_name string, mz double")
    return matching.pathway_links(matching.pathway_hits(objects).join(names, "compound_id"), meta)


@query("pathway_pixel_score", f"WITH {P1} SELECT pixel_id, round(avg(log10(value + 1)), 6) AS score FROM p1 WHERE feature IN ('mz_101','mz_102','mz_103') GROUP BY 1")
def _(spark, sf):
    return matching.pathway_pixel_score(p1(spark, sf), spark.createDataFrame([("mz_101",), ("mz_102",), ("mz_103",)], "feature string"))


@query("pathway_sample_score", f"WITH {P1}, s AS (SELECT section_id AS sample_id, feature, avg(value) AS v FROM p1 GROUP BY 1, 2), w(feature, w) AS (VALUES ('mz_101', 2.0), ('mz_102', -1.0), ('mz_103', 1.0)) SELECT sample_id, round(sum(w * v) / sum(abs(w)), 4) AS score FROM s JOIN w USING (feature) GROUP BY 1", 4)
def _(spark, sf):
    samples = p1(spark, sf).groupBy(F.col("section_id").alias("sample_id"), "feature").agg(F.avg("value").alias("value"))
    return matching.pathway_sample_score(samples, spark.createDataFrame([("mz_101", 2.0), ("mz_102", -1.0), ("mz_103", None)], "feature string, weight double"))


_SPECTRA = "sp AS (SELECT l_orderkey % 997 AS pixel_id, 50 + l_extendedprice / 50.0 AS mz, CAST(l_quantity AS DOUBLE) AS intensity FROM lineitem)"


@query("aligned_peaks", f"""WITH {_SPECTRA}, k AS (SELECT DISTINCT CAST(round(ln(mz) / (10 * 1e-8)) AS BIGINT) AS k FROM sp),
b AS (SELECT k, sum(new) OVER (ORDER BY k) AS b FROM (SELECT k, CASE WHEN k - lag(k) OVER (ORDER BY k) > 100 OR lag(k) OVER (ORDER BY k) IS NULL THEN 1 ELSE 0 END AS new FROM k)),
j AS (SELECT sp.*, b FROM sp JOIN b ON b.k = CAST(round(ln(mz) / (10 * 1e-8)) AS BIGINT)),
c AS (SELECT b, printf('mz_%.6f', sum(mz * intensity) / sum(intensity)) AS feature, count(DISTINCT pixel_id) AS n, sum(intensity) AS total FROM j GROUP BY b)
SELECT round(CAST(substr(feature, 4) AS DOUBLE) + 0.00003, 3) AS mz, n AS n_pixels, round(n / (SELECT count(DISTINCT pixel_id) FROM sp), 6) AS detection_fraction, total FROM c""")
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 997).alias("pixel_id"), (50 + F.col("l_extendedprice") / 50.0).alias("mz"), F.col("l_quantity").cast("double").alias("intensity"))
    spectra = rows.groupBy("pixel_id").agg(F.collect_list("mz").alias("mz"), F.collect_list("intensity").alias("intensity"))
    aligned = formats.align_peaks(spectra, 10)
    out = aligned.groupBy("feature").agg(F.count("*").alias("n_pixels"), F.first("detection_fraction").alias("detection_fraction"), F.sum("value").alias("total"))
    # Centres are named with six digits; the offset keeps sums in another order from showing in the third.
    return out.select(F.round(F.substring("feature", 4, 20).cast("double") + 0.00003, 3).alias("mz"), "n_pixels", "detection_fraction", "total")
