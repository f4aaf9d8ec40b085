"""Queries on feature statistics, preprocessing, graphs and spatial statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, pixels, preprocess, svg
from .bindings import P1, P2, ROOK1, ROOK2, md5_slots, p1, p1_packed, p1_pixels, p2, p2_pixels, rounded

Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


STATS1 = """
st AS (SELECT feature, avg(value) AS mean, stddev_samp(value) AS sd, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS nonzero_rate FROM p1 GROUP BY feature),
stc AS (SELECT *, coalesce(sd / nullif(mean, 0), 0) AS cv FROM st)
"""


@query("feature_stats", f"WITH {P1}, {STATS1} SELECT feature, round(mean, 6) AS mean, round(sd, 6) AS sd, round(cv, 6) AS cv, round(nonzero_rate, 6) AS nonzero_rate FROM stc")
def _(spark, sf):
    return pixels.feature_stats(p1(spark, sf)).select("feature", "mean", "sd", "cv", "nonzero_rate")


@query("select_features", f"""WITH {P1}, {STATS1}, cut AS (SELECT quantile_cont(cv, 0.3) AS c FROM stc)
SELECT feature, round(cv, 6) AS cv, CASE WHEN cv >= c AND mean > 0 AND nonzero_rate >= 0.01 AND feature IN ('mz_101','mz_120') THEN 'both' WHEN cv >= c AND mean > 0 AND nonzero_rate >= 0.01 THEN 'rule' ELSE 'manual' END AS method
FROM stc, cut WHERE (cv >= c AND mean > 0 AND nonzero_rate >= 0.01) OR feature IN ('mz_101','mz_120')""")
def _(spark, sf):
    return pixels.select_features(p1(spark, sf), 70, 0, 0.01, ["mz_101", "mz_120"]).select("feature", "cv", "method")


@query("select_shared_features", f"""WITH {P1}, st AS (SELECT section_id, feature, avg(value) AS mean, stddev_samp(value) AS sd, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS nz FROM p1 GROUP BY 1, 2),
s AS (SELECT *, coalesce(sd / nullif(mean, 0), 0) AS cv FROM st), c AS (SELECT section_id, quantile_cont(cv, 0.3) AS c FROM s GROUP BY 1),
k AS (SELECT s.* FROM s JOIN c USING (section_id) WHERE cv >= c AND mean > 0 AND nz >= 0.01), t AS (SELECT count(DISTINCT section_id) AS n FROM p1p)
SELECT feature, count(DISTINCT section_id) AS n_selected, any_value(n) AS n_sections FROM k, t GROUP BY feature HAVING count(DISTINCT section_id) / any_value(n) >= 0.6""")
def _(spark, sf):
    return pixels.select_shared_features(p1(spark, sf), min_section_fraction=0.6, nonzero_min=0.01).select("feature", "n_selected", "n_sections")


@query("tic_normalize_median", f"""WITH {P1}, t AS (SELECT pixel_id, sum(value) AS tic FROM p1 GROUP BY 1), m AS (SELECT median(tic) AS md FROM t WHERE tic > 0)
SELECT p1.pixel_id, feature, round(CASE WHEN tic > 0 THEN value / tic * md ELSE 0 END, 4) AS value FROM p1 JOIN t USING (pixel_id), m WHERE value > 0""", 4)
def _(spark, sf):
    return preprocess.tic_normalize(p1(spark, sf)).where("value > 0").select("pixel_id", "feature", "value")


@query("tic_normalize_total", f"WITH {P1}, t AS (SELECT pixel_id, sum(value) AS tic FROM p1 GROUP BY 1) SELECT p1.pixel_id, feature, round(value / greatest(tic, 2.220446049250313e-16), 6) AS value FROM p1 JOIN t USING (pixel_id) WHERE value > 0")
def _(spark, sf):
    return preprocess.tic_normalize(p1(spark, sf), "total").where("value > 0").select("pixel_id", "feature", "value")


@query("log10_scale", f"""WITH {P1}, l AS (SELECT pixel_id, feature, log10(value + 1) AS v FROM p1), s AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1)
SELECT pixel_id, feature, round(coalesce((v - m) / nullif(s, 0), 0), 6) + 0.0 AS value FROM l JOIN s USING (feature) WHERE v > 0""")
def _(spark, sf):
    scaled = preprocess.scale_features(preprocess.log10_transform(p1(spark, sf)))
    return p1(spark, sf).where("value > 0").select("pixel_id", "feature").join(scaled, ["pixel_id", "feature"]).select("pixel_id", "feature", "value")


@query("pipeline_qc", f"""WITH {P1}, t AS (SELECT pixel_id, sum(value) AS tic, count(*) FILTER (value > 0) AS nz FROM p1 GROUP BY 1)
SELECT count(*) AS n_pixels, count(*) FILTER (nz >= 2) AS n_kept, round(avg(tic), 4) AS mean_tic, round(median(tic), 4) AS median_tic FROM t""", 4)
def _(spark, sf):
    return preprocess.total_ion_current(p1_packed(spark, sf)).agg(F.count("*").alias("n_pixels"), F.sum((F.col("n_nonzero") >= 2).cast("long")).alias("n_kept"), F.avg("tic").alias("mean_tic"), F.median("tic").alias("median_tic"))


TIC1 = "t AS (SELECT pixel_id, sum(value) AS tic, count(*) FILTER (value > 0) AS n_nonzero FROM p1 GROUP BY 1)"


@query("background_percentile", f"WITH {P1}, {TIC1}, c AS (SELECT quantile_cont(tic, 0.1) AS cut FROM t WHERE tic > 0) SELECT pixel_id, round(tic, 4) AS tic, n_nonzero, tic >= cut AND n_nonzero >= 1 AS keep FROM t, c", 4)
def _(spark, sf):
    return preprocess.background_mask(p1_packed(spark, sf), "tic_percentile", 0.1)


@query("background_median_fraction", f"WITH {P1}, {TIC1}, c AS (SELECT median(tic) * 0.2 AS cut FROM t WHERE tic > 0) SELECT pixel_id, round(tic, 4) AS tic, n_nonzero, tic >= cut AND n_nonzero >= 1 AS keep FROM t, c", 4)
def _(spark, sf):
    return preprocess.background_mask(p1_packed(spark, sf), "median_fraction", median_percent=20)


BREAKS = [2.5 + 0.05 * i for i in range(81)]


@query("background_otsu", f"""WITH {P1}, {TIC1}, s AS (SELECT log10(tic + 1) AS v FROM t),
h AS (SELECT CAST(greatest(1, least(80, ceil((v - 2.5) / {BREAKS[1] - BREAKS[0]!r} - 1e-9))) AS BIGINT) AS k, count(*) AS n FROM s GROUP BY 1),
m AS (SELECT k, n, 2.5 + 0.05 * (k - 0.5) AS mid FROM h),
w AS (SELECT k, mid, sum(n) OVER (ORDER BY k) AS n0, sum(n) OVER () AS nn, sum(n * mid) OVER (ORDER BY k) AS s0, sum(n * mid) OVER () AS ss FROM m),
b AS (SELECT k, mid, coalesce(n0 / nn * (nn - n0) / nn * (s0 / n0 - (ss - s0) / nullif(nn - n0, 0)) * (s0 / n0 - (ss - s0) / nullif(nn - n0, 0)), 0) AS bt FROM w)
SELECT round(mid, 6) AS threshold, round(bt, 6) AS between FROM b ORDER BY round(bt, 9) DESC, k LIMIT 1""")
def _(spark, sf):
    tic = preprocess.total_ion_current(p1_packed(spark, sf)).select(F.log10(F.col("tic") + 1).alias("s"))
    return preprocess.otsu(tic, "s", BREAKS)


@query("background_robust_totals", f"""WITH {P1}, o AS (SELECT pixel_id, value, row_number() OVER (PARTITION BY pixel_id ORDER BY value) AS r FROM p1)
SELECT pixel_id, round(median(value) * count(*), 4) AS median_total, round(avg(value) FILTER (r > 5 AND r <= 45) * count(*), 4) AS trimmed_total FROM o GROUP BY 1""", 4)
def _(spark, sf):
    packed = p1_packed(spark, sf)
    return packed.rows.select("pixel_id", *(preprocess.packed_total(packed, m).alias(f"{m}_total") for m in ("median", "trimmed")))


@query("background_kmeans")
def _(spark, sf):
    return preprocess.background_mask(p1_packed(spark, sf), "log_tic_kmeans")


@query("preprocess_sections", f"""WITH {P1}, t AS (SELECT section_id, pixel_id, sum(value) AS tic FROM p1 GROUP BY 1, 2), c AS (SELECT section_id, quantile_cont(tic, 0.1) AS cut FROM t WHERE tic > 0 GROUP BY 1),
k AS (SELECT t.* FROM t JOIN c USING (section_id) WHERE tic >= cut AND tic > 0), md AS (SELECT section_id, median(tic) AS scale FROM k GROUP BY 1),
l AS (SELECT k.section_id, feature, log10(value / tic * scale + 1) AS v FROM p1 JOIN k USING (pixel_id) JOIN md ON md.section_id = k.section_id), s AS (SELECT section_id, feature, avg(v) AS m, stddev_samp(v) AS s FROM l GROUP BY 1, 2)
SELECT section_id, feature, count(*) AS n, round(avg(coalesce((v - m) / nullif(s, 0), 0)), 6) + 0.0 AS mean, round(max(coalesce((v - m) / nullif(s, 0), 0)), 6) AS top FROM l JOIN s USING (section_id, feature) GROUP BY 1, 2""")
def _(spark, sf):
    out = preprocess.preprocess(p1_packed(spark, sf), "tic_percentile", scale=True, by=("section_id",))
    return out.groupBy("section_id", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top"))


GAP = """
g AS (SELECT r, lead(r) OVER (ORDER BY r DESC) AS nx FROM (SELECT DISTINCT nonzero_rate AS r FROM rates WHERE nonzero_rate > 0)),
gg AS (SELECT r, nx, r - nx AS gap FROM g WHERE nx IS NOT NULL),
md AS (SELECT median(gap) AS med, stddev_samp(gap) AS sd FROM gg), mm AS (SELECT med, sd, (SELECT median(abs(gap - med)) FROM gg) AS mad FROM md),
cut AS (SELECT arg_max((r + nx) / 2, r) AS threshold FROM gg, mm WHERE gap > med + 2 * CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd END)
"""
RATES = "rates AS (SELECT feature, avg(CASE WHEN value > 0.05 THEN 1.0 ELSE 0.0 END) AS nonzero_rate FROM p2 GROUP BY 1)"


def _rates(spark, sf):
    return p2(spark, sf).groupBy("feature").agg(F.avg((F.col("value") > 0.05).cast("double")).alias("nonzero_rate"))


@query("ubiquitous_gap", f"WITH {P2}, {RATES}, {GAP} SELECT feature, round(nonzero_rate, 6) AS nonzero_rate, round(threshold, 6) AS threshold, coalesce(nonzero_rate >= threshold, false) AS excluded FROM rates, cut")
def _(spark, sf):
    return preprocess.ubiquitous_by_gap(_rates(spark, sf), 2)


@query("ubiquitous_mad", f"""WITH {P2}, {RATES}, m AS (SELECT median(nonzero_rate) AS med FROM rates), d AS (SELECT median(abs(nonzero_rate - med)) AS mad FROM rates, m)
SELECT feature, round(nonzero_rate, 6) AS nonzero_rate, round(0.6745 * (nonzero_rate - med) / nullif(mad, 0), 6) + 0.0 AS modified_z, coalesce(0.6745 * (nonzero_rate - med) / nullif(mad, 0) > 1.5, false) AS excluded FROM rates, m, d""")
def _(spark, sf):
    return preprocess.ubiquitous_by_mad(_rates(spark, sf), 1.5)


@query("contamination_agreement", f"""WITH {P1}, {TIC1}, c AS (SELECT quantile_cont(tic, 0.5) AS cut FROM t WHERE tic > 0), k AS (SELECT pixel_id, tic >= cut AS keep FROM t, c)
SELECT feature, round(avg(value) FILTER (NOT keep), 4) AS background_mean, round(avg(value) FILTER (keep), 4) AS tissue_mean, round(avg(value) FILTER (NOT keep) / greatest(avg(value) FILTER (keep), 2.220446049250313e-16), 4) AS ratio,
 avg(value) FILTER (NOT keep) / greatest(avg(value) FILTER (keep), 2.220446049250313e-16) > 0.2 AS enrichment FROM p1 JOIN k USING (pixel_id) GROUP BY 1""", 4)
def _(spark, sf):
    packed = p1_packed(spark, sf)
    return preprocess.contamination_agreement(packed, preprocess.background_mask(packed, "tic_percentile", 0.5, keep_values=True), 0.2).select("feature", "background_mean", "tissue_mean", "ratio", "enrichment")


# --- graphs -----------------------------------------------------------------------------------------


@query("neighbors_rook", f"WITH {P1}, {ROOK1} SELECT section_id, src, dst FROM rook1")
def _(spark, sf):
    return graph.lattice_edges(p1_pixels(spark, sf), "rook").select("section_id", "src", "dst")


@query("neighbors_queen", f"""WITH {P1} SELECT a.section_id, least(a.pixel_id, b.pixel_id) AS src, greatest(a.pixel_id, b.pixel_id) AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
FROM p1p a JOIN p1p b ON a.section_id = b.section_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND a.pixel_id < b.pixel_id""")
def _(spark, sf):
    return graph.lattice_edges(p1_pixels(spark, sf), "queen").select("section_id", "src", "dst", "distance")


@query("neighbors_distance", f"""WITH {P2} SELECT a.pixel_id AS src, b.pixel_id AS dst, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 6) AS distance
FROM p2p a JOIN p2p b ON a.pixel_id < b.pixel_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 6.25""")
def _(spark, sf):
    return graph.distance_edges(p2_pixels(spark, sf), 2.5).select("src", "dst", "distance")


@query("neighbor_summary", f"""WITH {P1}, {ROOK1}, d AS (SELECT p.section_id, p.pixel_id, count(e.id) AS k FROM p1p p LEFT JOIN (SELECT src AS id FROM rook1 UNION ALL SELECT dst FROM rook1) e ON e.id = p.pixel_id GROUP BY 1, 2)
SELECT section_id, count(*) AS n_nodes, CAST(sum(k) / 2 AS BIGINT) AS n_edges, count(*) FILTER (k = 0) AS n_isolated, round(avg(k), 6) AS mean_degree FROM d GROUP BY 1""")
def _(spark, sf):
    nodes = p1_pixels(spark, sf)
    return graph.summary(nodes, graph.lattice_edges(nodes, "rook"))


COMPONENTS = """
both_ AS (SELECT src AS a, dst AS b FROM e0 UNION SELECT dst, src FROM e0),
reach AS (SELECT pixel_id AS a, pixel_id AS c FROM n0 UNION SELECT b.b, r.c FROM reach r JOIN both_ b ON b.a = r.a),
comp AS (SELECT a AS pixel_id, min(c) AS component FROM reach GROUP BY 1)
"""


@query("neighbor_diagnostics", f"""WITH RECURSIVE {P2}, n0 AS (SELECT * FROM p2p WHERE domain IN ('d1','d2','d3')), e0 AS (SELECT least(a.pixel_id, b.pixel_id) AS src, greatest(a.pixel_id, b.pixel_id) AS dst FROM n0 a JOIN n0 b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)), {COMPONENTS},
d AS (SELECT n0.pixel_id, count(e.id) AS k FROM n0 LEFT JOIN (SELECT src AS id FROM e0 UNION ALL SELECT dst FROM e0) e ON e.id = n0.pixel_id GROUP BY 1),
z AS (SELECT component, count(*) AS s FROM comp GROUP BY 1)
SELECT 'summary' AS record, 'n_nodes' AS key, count(*) AS value FROM d UNION ALL SELECT 'summary', 'n_edges', CAST(sum(k) / 2 AS BIGINT) FROM d UNION ALL SELECT 'summary', 'n_isolated', count(*) FILTER (k = 0) FROM d
UNION ALL SELECT 'degree_distribution', CAST(k AS VARCHAR), count(*) FROM d GROUP BY k UNION ALL SELECT 'component_size', CAST(s AS VARCHAR), count(*) FROM z GROUP BY s""")
def _(spark, sf):
    nodes = p2_pixels(spark, sf).where("domain in ('d1','d2','d3')")
    return graph.diagnostics(nodes, graph.lattice_edges(nodes, "rook"))


@query("foreground_components", f"""WITH RECURSIVE {P2}, n0 AS (SELECT * FROM p2p WHERE pixel_id % 3 <> 0), e0 AS (SELECT least(a.pixel_id, b.pixel_id) AS src, greatest(a.pixel_id, b.pixel_id) AS dst FROM n0 a JOIN n0 b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)), {COMPONENTS},
z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
SELECT pixel_id, component, size FROM comp JOIN z USING (component)""")
def _(spark, sf):
    nodes = p2_pixels(spark, sf).where("pixel_id % 3 <> 0")
    return graph.largest_components(nodes, graph.lattice_edges(nodes, "rook")).select("pixel_id", "component", "size")


@query("neighborhood_average", f"""WITH {P2}, {ROOK2}, b AS (SELECT src, dst FROM rook2 UNION ALL SELECT dst, src FROM rook2)
SELECT p.pixel_id, p.feature, round(p.value, 6) AS value, round(coalesce(avg(q.value), any_value(p.value)), 6) AS neighbor_mean FROM p2 p LEFT JOIN b ON b.src = p.pixel_id LEFT JOIN p2 q ON q.pixel_id = b.dst AND q.feature = p.feature
GROUP BY 1, 2, 3""")
def _(spark, sf):
    return graph.neighborhood_average(p2(spark, sf), graph.lattice_edges(p2_pixels(spark, sf), "rook"))


# --- spatially variable features --------------------------------------------------------------------

MORAN1 = """
eff AS (SELECT DISTINCT id FROM (SELECT src AS id FROM rook1 UNION ALL SELECT dst FROM rook1)),
ms AS (SELECT feature, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM p1 JOIN eff ON eff.id = p1.pixel_id GROUP BY 1),
tot AS (SELECT feature, count(*) AS n_total FROM p1 GROUP BY 1),
cr AS (SELECT a.feature, count(*) AS n_edges, sum((a.value - m) * (b.value - m)) AS cross_, sum((a.value - b.value) * (a.value - b.value)) AS diff_ FROM rook1 e JOIN p1 a ON a.pixel_id = e.src JOIN p1 b ON b.pixel_id = e.dst AND b.feature = a.feature JOIN ms ON ms.feature = a.feature GROUP BY 1)
"""


@query("moran_rank", f"WITH {P1}, {ROOK1}, {MORAN1} SELECT feature, round(n / n_edges * cross_ / nullif(ss, 0), 6) AS statistic, n AS n_effective, n_total - n AS n_isolated, n_edges FROM cr JOIN ms USING (feature) JOIN tot USING (feature)")
def _(spark, sf):
    edges = graph.lattice_edges(p1_pixels(spark, sf), "rook")
    return svg.autocorrelation(p1(spark, sf), edges).select("feature", "statistic", "n_effective", "n_isolated", "n_edges").orderBy(F.desc("statistic"))


@query("geary_rank", f"WITH {P1}, {ROOK1}, {MORAN1} SELECT feature, round((n - 1) / (2.0 * n_edges) * diff_ / nullif(ss, 0), 6) AS statistic, n AS n_effective, n_edges FROM cr JOIN ms USING (feature)")
def _(spark, sf):
    edges = graph.lattice_edges(p1_pixels(spark, sf), "rook")
    return svg.autocorrelation(p1(spark, sf), edges, "geary").select("feature", "statistic", "n_effective", "n_edges")


N_PERM = 199
PERM2 = f"""
f AS (SELECT * FROM p2),
nd AS (SELECT pixel_id AS id FROM p2p WHERE pixel_id IN (SELECT src FROM rook2 UNION SELECT dst FROM rook2)),
sl AS ({md5_slots('nd', N_PERM, 1)}),
rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY pixel_id) AS slot FROM f JOIN nd ON nd.id = f.pixel_id),
sh AS (SELECT feature, perm, id, value FROM sl JOIN rk USING (slot)),
ms AS (SELECT feature, count(*) AS n, avg(value) AS m, var_pop(value) * count(*) AS ss FROM f JOIN nd ON nd.id = f.pixel_id GROUP BY 1),
ob AS (SELECT a.feature, n / count(*) * sum((a.value - m) * (b.value - m)) / any_value(ss) AS i, (n - 1) / (2.0 * count(*)) * sum((a.value - b.value) * (a.value - b.value)) / any_value(ss) AS c FROM rook2 e JOIN f a ON a.pixel_id = e.src JOIN f b ON b.pixel_id = e.dst AND a.feature = b.feature JOIN ms ON ms.feature = a.feature GROUP BY a.feature, n),
nl AS (SELECT a.feature, a.perm, n / count(*) * sum((a.value - m) * (b.value - m)) / any_value(ss) AS i, (n - 1) / (2.0 * count(*)) * sum((a.value - b.value) * (a.value - b.value)) / any_value(ss) AS c FROM rook2 e JOIN sh a ON a.id = e.src JOIN sh b ON b.id = e.dst AND a.feature = b.feature AND a.perm = b.perm JOIN ms ON ms.feature = a.feature GROUP BY a.feature, a.perm, n),
pv AS (SELECT o.feature, any_value(o.i) AS i, any_value(o.c) AS c, (count(*) FILTER (x.i >= o.i - 1e-9) + 1) / (count(*) + 1) AS pi, (count(*) FILTER (x.c <= o.c + 1e-9) + 1) / (count(*) + 1) AS pc FROM nl x JOIN ob o USING (feature) GROUP BY 1)
"""


def _bh(col: str, source: str, out: str = "adj") -> str:
    return f"(SELECT feature, min(raw) OVER (ORDER BY {col} DESC, rn ROWS UNBOUNDED PRECEDING) AS {out} FROM (SELECT *, least(1.0, {col} * count(*) OVER () / (count(*) OVER () - rn + 1)) AS raw FROM (SELECT *, row_number() OVER (ORDER BY {col} DESC) AS rn FROM {source})))"


def _whole(spark, sf):
    return p2(spark, sf), graph.lattice_edges(p2_pixels(spark, sf), "rook")


@query("moran_perm", f"WITH {P2}, {ROOK2}, {PERM2} SELECT pv.feature, round(i, 6) AS statistic, round(pi, 6) AS p_value FROM pv")
def _(spark, sf):
    return svg.autocorrelation(*_whole(spark, sf), "moran", N_PERM).select("feature", "statistic", "p_value")


@query("geary_perm", f"WITH {P2}, {ROOK2}, {PERM2} SELECT pv.feature, round(c, 6) AS statistic, round(pc, 6) AS p_value FROM pv")
def _(spark, sf):
    return svg.autocorrelation(*_whole(spark, sf), "geary", N_PERM).select("feature", "statistic", "p_value")


@query("compare_svg", f"""WITH {P2}, {ROOK2}, {PERM2}, a AS {_bh('pi', 'pv', 'ai')}, b AS {_bh('pc', 'pv', 'ac')}
SELECT a.feature, round(ai, 6) AS moran_p, round(ac, 6) AS geary_p, CASE WHEN ai < 0.05 AND ac < 0.05 THEN 'both' WHEN ai < 0.05 THEN 'moran_only' WHEN ac < 0.05 THEN 'geary_only' ELSE 'neither' END AS agreement FROM a JOIN b USING (feature)""")
def _(spark, sf):
    a = svg.autocorrelation(*_whole(spark, sf), "moran", N_PERM)
    return svg.compare_methods(a, svg.autocorrelation(*_whole(spark, sf), "geary", N_PERM))


BIN = """
st AS (SELECT pixel_id, p2.feature, value, threshold, CAST(value >= cut AS DOUBLE) AS high FROM p2 JOIN ct USING (feature)),
eb AS (SELECT a.feature, src, dst, a.high AS hi, b.high AS hj FROM rook2 JOIN st a ON a.pixel_id = src JOIN st b ON b.pixel_id = dst AND a.feature = b.feature),
tb AS (SELECT feature, 2.0 * count(*) FILTER (hi + hj = 0) AS n00, 1.0 * count(*) FILTER (hi + hj = 1) AS n01, 2.0 * count(*) FILTER (hi + hj = 2) AS n11, sum(hi * hj) AS hh, count(*) AS n_edges FROM eb GROUP BY 1),
hb AS (SELECT feature, count(DISTINCT id) AS n_hubs FROM (SELECT feature, src AS id FROM eb WHERE hi * hj = 1 UNION ALL SELECT feature, dst FROM eb WHERE hi * hj = 1) GROUP BY 1),
mn AS (SELECT feature, any_value(threshold) AS threshold, count(*) FILTER (high = 1) AS n_high, avg(value) AS mean_value, avg(value) FILTER (high = 1) AS mean_high, count(*) AS n FROM st JOIN nd ON nd.id = st.pixel_id GROUP BY 1),
bo AS (SELECT feature, n00, n01, n11, n00 * n11 / nullif(n01 * n01, 0) AS odds_ratio, hh AS high_high_edge_weight, n_edges, coalesce(n_hubs, 0) AS n_hubs, threshold, n_high, n_high / n AS high_fraction, n AS n_effective, mean_value, mean_high FROM tb JOIN mn USING (feature) LEFT JOIN hb USING (feature)),
rh AS (SELECT feature, high, row_number() OVER (PARTITION BY feature ORDER BY pixel_id) AS slot FROM st JOIN nd ON nd.id = st.pixel_id),
sb AS (SELECT feature, perm, id, high FROM sl JOIN rh USING (slot)),
nb AS (SELECT a.feature, a.perm, sum(a.high * b.high) AS x FROM rook2 e JOIN sb a ON a.id = e.src JOIN sb b ON b.id = e.dst AND a.feature = b.feature AND a.perm = b.perm GROUP BY 1, 2),
pb AS (SELECT feature, (count(*) FILTER (x >= high_high_edge_weight - 1e-9) + 1) / (count(*) + 1) AS pb FROM nb JOIN bo USING (feature) GROUP BY 1)
"""
BY_RANK = "ct AS (SELECT feature, quantile_cont(value, 0.7) AS cut, quantile_cont(value, 0.7) AS threshold FROM p2 GROUP BY 1)"
BY_MEANS = """
u AS (SELECT feature, value, count(*) AS n FROM p2 GROUP BY 1, 2),
us AS (SELECT feature, value, sum(n) OVER up AS k, sum(n * value) OVER up AS s, sum(n) OVER (PARTITION BY feature) AS an, sum(n * value) OVER (PARTITION BY feature) AS al FROM u WINDOW up AS (PARTITION BY feature ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ct AS (SELECT feature, value AS cut, (s / k + (al - s) / (an - k)) / 2 AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY round(s * s / k + (al - s) * (al - s) / (an - k), 9) DESC, value) AS r FROM us WHERE k > 0) WHERE r = 1)
"""
BIN_COLUMNS = ["odds_ratio", "high_high_edge_weight", "high_fraction", "threshold", "mean_value", "mean_high"]
BIN_COUNTS = ["n00", "n01", "n11", "n_high", "n_effective", "n_edges", "n_hubs"]
_BIN_SELECT = ", ".join([f"round({c}, 6) AS {c}" for c in BIN_COLUMNS] + BIN_COUNTS)


def _binspect_sql(cut: str, p: str) -> str:
    return f"WITH {P2}, {ROOK2}, {PERM2}, {cut}, {BIN}, pp AS ({p}), aj AS {_bh('p', 'pp', 'adj_p_value')} SELECT feature, round(p, 6) AS p_value, round(adj_p_value, 6) AS adj_p_value, {_BIN_SELECT}, 'tested' AS status FROM bo JOIN pp USING (feature) JOIN aj USING (feature)"


_PERM_P = "SELECT feature, pb AS p FROM pb"
_FISHER_P = """SELECT feature, least(1.0, sum(exp(lgamma(n11 + n01 + 1) - lgamma(x + 1) - lgamma(n11 + n01 - x + 1) + lgamma(n01 + n00 + 1) - lgamma(n11 + n01 - x + 1) - lgamma(n01 + n00 - (n11 + n01 - x) + 1)
  - (lgamma(n11 + 2 * n01 + n00 + 1) - lgamma(n11 + n01 + 1) - lgamma(n01 + n00 + 1))))) AS p
FROM (SELECT *, unnest(range(CAST(greatest(n11, n11 - n00) AS BIGINT), CAST(n11 + n01 AS BIGINT) + 1)) AS x FROM bo) GROUP BY feature"""


@query("binspect_rank", _binspect_sql(BY_RANK, _PERM_P))
def _(spark, sf):
    return svg.binspect(*_whole(spark, sf), "rank")


@query("binspect_kmeans", _binspect_sql(BY_MEANS, _PERM_P))
def _(spark, sf):
    return svg.binspect(*_whole(spark, sf))


@query("binspect_fisher", _binspect_sql(BY_MEANS, _FISHER_P))
def _(spark, sf):
    return svg.binspect(*_whole(spark, sf), inference="fisher_approx")


@query("compare_svg_methods", f"""WITH {P2}, {ROOK2}, {PERM2}, {BY_MEANS}, {BIN}, a AS {_bh('pi', 'pv', 'ai')}, b AS {_bh('pc', 'pv', 'ac')}, c AS {_bh('pb', 'pb', 'ab')}
SELECT feature, round(i, 6) AS morans_i, round(ai, 6) AS moran_adj_p, round(c, 6) AS gearys_c, round(ac, 6) AS geary_adj_p, round(odds_ratio, 6) AS odds_ratio, round(ab, 6) AS binspect_adj_p,
  ai < 0.05 AS moran_significant, ac < 0.05 AS geary_significant, ab < 0.05 AS binspect_significant, 3 AS n_methods_tested, CAST(ai < 0.05 AS INTEGER) + CAST(ac < 0.05 AS INTEGER) + CAST(ab < 0.05 AS INTEGER) AS n_methods_significant, ai < 0.05 AND ac < 0.05 AND ab < 0.05 AS all_tested_methods_significant
FROM pv JOIN a USING (feature) JOIN b USING (feature) JOIN c USING (feature) JOIN bo USING (feature)""")
def _(spark, sf):
    data = _whole(spark, sf)
    return svg.compare_svg_methods(svg.autocorrelation(*data, "moran", N_PERM), svg.autocorrelation(*data, "geary", N_PERM), svg.binspect(*data))
