"""Queries on composition, enrichment, communication and distance gradients, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import distance, graph, niches, signaling
from .bindings import P2, ROOK2, md5_slots, p2, p2_pixels, rounded


Q: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    def add(f):
        Q[name] = lambda spark, sf: rounded(f(spark, sf), digits)
        if sql:
            SQL[name] = sql
        return f

    return add


def _rook(spark, sf):
    return graph.lattice_edges(p2_pixels(spark, sf), "rook")


@query("composition_radius", f"""WITH {P2}, c AS (SELECT a.pixel_id, b.domain AS type, count(*) AS n FROM p2p a JOIN p2p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25 GROUP BY 1, 2)
SELECT pixel_id, type, n, CAST(sum(n) OVER (PARTITION BY pixel_id) AS BIGINT) AS n_neighbors, round(CASE WHEN sum(n) OVER (PARTITION BY pixel_id) >= 6 THEN n / sum(n) OVER (PARTITION BY pixel_id) END, 6) AS proportion, sum(n) OVER (PARTITION BY pixel_id) >= 6 AS eligible FROM c""")
def _(spark, sf):
    return niches.composition(p2_pixels(spark, sf), "radius", 1.5, min_neighbors=6).select("pixel_id", "type", "n", "n_neighbors", "proportion", "eligible")


KNN = "kn AS (SELECT src, dst FROM (SELECT a.pixel_id AS src, b.pixel_id AS dst, row_number() OVER (PARTITION BY a.pixel_id ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.pixel_id) AS r FROM p2p a JOIN p2p b ON true) WHERE r <= 8)"


@query("composition_knn", f"WITH {P2}, {KNN} SELECT src AS pixel_id, domain AS type, count(*) AS n, round(count(*) / 8.0, 6) AS proportion FROM kn JOIN p2p ON p2p.pixel_id = dst GROUP BY 1, 2")
def _(spark, sf):
    return niches.composition(p2_pixels(spark, sf), "knn", k=8).select("pixel_id", "type", "n", "proportion")


@query("composition_soft", f"WITH {P2}, {KNN} SELECT src AS pixel_id, feature AS type, round(avg(value), 6) AS proportion FROM kn JOIN p2 ON p2.pixel_id = dst GROUP BY 1, 2")
def _(spark, sf):
    soft = p2(spark, sf).select("pixel_id", F.col("feature").alias("type"), F.col("value").alias("proportion"))
    return niches.soft_composition(p2_pixels(spark, sf), soft, 8)


@query("niche_distances_given_centers", f"""WITH {P2}, w AS (SELECT pixel_id, max(value) FILTER (feature = 'mz_101') AS a, max(value) FILTER (feature = 'mz_102') AS b FROM p2 WHERE feature IN ('mz_101','mz_102') GROUP BY 1),
c(niche, ca, cb) AS (VALUES (1, 0.05, 0.05), (2, 0.1, 0.2), (3, 0.2, 0.1)), d AS (SELECT pixel_id, niche, sqrt((a - ca) * (a - ca) + (b - cb) * (b - cb)) AS d FROM w CROSS JOIN c),
r AS (SELECT *, row_number() OVER (PARTITION BY pixel_id ORDER BY d, niche) AS k FROM d)
SELECT pixel_id, max(niche) FILTER (k = 1) AS niche, round(max(d) FILTER (k = 1), 6) AS nearest, round(max(d) FILTER (k = 2), 6) AS second, round(max(d) FILTER (k = 1) / max(d) FILTER (k = 2), 6) AS ambiguity_ratio FROM r GROUP BY 1""")
def _(spark, sf):
    profiles = niches.profile_matrix(p2(spark, sf, 2).select("pixel_id", F.col("feature").alias("type"), F.col("value").alias("proportion")), ["mz_101", "mz_102"])
    centers = spark.createDataFrame([(1, [0.05, 0.05]), (2, [0.1, 0.2]), (3, [0.2, 0.1])], "niche int, center array<double>")
    return niches.niche_distances(profiles, centers)


NP = 19
LABELS = f"""
nd AS (SELECT pixel_id AS id FROM p2p), sl AS ({md5_slots('nd', NP, 1)}),
rk AS (SELECT domain, row_number() OVER (ORDER BY pixel_id) AS slot FROM p2p),
lab AS (SELECT 0 AS perm, pixel_id AS id, domain FROM p2p UNION ALL SELECT perm, id, domain FROM sl JOIN rk USING (slot)),
pr AS (SELECT a.perm, a.domain AS ta, b.domain AS tb FROM rook2 JOIN lab a ON a.id = src JOIN lab b ON b.id = dst AND b.perm = a.perm)
"""


@query("enrichment_pairs", f"""WITH {P2}, {ROOK2}, {LABELS}, dr AS (SELECT * FROM pr UNION ALL SELECT perm, tb, ta FROM pr), c AS (SELECT perm, ta, tb, count(*) AS n FROM dr GROUP BY 1, 2, 3),
ty AS (SELECT DISTINCT domain FROM p2p), g AS (SELECT perm, a.domain AS ta, b.domain AS tb FROM ty a CROSS JOIN ty b CROSS JOIN (SELECT unnest(range(0, {NP + 1})) AS perm)),
z AS (SELECT g.perm, g.ta, g.tb, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.perm = g.perm AND c.ta = g.ta AND c.tb = g.tb),
o AS (SELECT ta, tb, n AS o FROM z WHERE perm = 0)
SELECT z.ta AS from_cell_type, z.tb AS to_cell_type, any_value(o) AS observed_count, round(avg(n), 6) AS permutation_mean, round(stddev_pop(n), 6) AS permutation_sd, round(CASE WHEN stddev_pop(n) > 1e-7 THEN (any_value(o) - avg(n)) / stddev_pop(n) END, 6) + 0.0 AS z_score,
 round((count(*) FILTER (n >= o) + 1) / {NP + 1}.0, 6) AS p_enriched, round((count(*) FILTER (n <= o) + 1) / {NP + 1}.0, 6) AS p_depleted FROM z JOIN o USING (ta, tb) WHERE perm > 0 GROUP BY 1, 2""")
def _(spark, sf):
    out = niches.label_pairs(p2_pixels(spark, sf), _rook(spark, sf), NP)
    return out.select("from_cell_type", "to_cell_type", "observed_count", "permutation_mean", "permutation_sd", "z_score", "p_enriched", "p_depleted")


@query("proximity_pairs", f"""WITH {P2}, {ROOK2}, {LABELS}, c AS (SELECT perm, least(ta, tb) AS a, greatest(ta, tb) AS b, count(*) AS n FROM pr GROUP BY 1, 2, 3),
ty AS (SELECT DISTINCT domain FROM p2p), g AS (SELECT perm, a.domain AS a, b.domain AS b FROM ty a JOIN ty b ON a.domain <= b.domain CROSS JOIN (SELECT unnest(range(0, {NP + 1})) AS perm)),
z AS (SELECT g.perm, g.a, g.b, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.perm = g.perm AND c.a = g.a AND c.b = g.b), o AS (SELECT a, b, n AS o FROM z WHERE perm = 0)
SELECT a AS cell_type_a, b AS cell_type_b, any_value(o) AS observed_count, round(avg(n), 6) AS expected_count, round(any_value(o) / nullif(avg(n), 0), 6) AS ratio,
 round(least(1, 2.0 * least((count(*) FILTER (n >= o) + 1) / {NP + 1}.0, (count(*) FILTER (n <= o) + 1) / {NP + 1}.0)), 6) AS p_two_sided FROM z JOIN o USING (a, b) WHERE perm > 0 GROUP BY 1, 2""")
def _(spark, sf):
    out = niches.label_pairs(p2_pixels(spark, sf), _rook(spark, sf), NP, directed=False)
    return out.select("cell_type_a", "cell_type_b", "observed_count", "expected_count", "ratio", "p_two_sided")


@query("ward_groups")
def _(spark, sf):
    rows = niches.label_pairs(p2_pixels(spark, sf), _rook(spark, sf), 9).collect()
    groups = niches.ward_groups({(r["from_cell_type"], r["to_cell_type"]): r["z_score"] for r in rows}, 3)
    return spark.createDataFrame(list(groups.items()), "cell_type string, cell_group long")


def _database(spark):
    raw = spark.createDataFrame([("mz_101", "mz_102"), ("mz_103|mz_104", "mz_101"), ("mz_101", "mz_102"), ("mz_101", "mz_999")], "ligand string, receptor string")
    return signaling.prepare_database(raw, [f"mz_{101 + i}" for i in range(4)])


LR = """
cx AS (SELECT pixel_id, feature AS complex, value FROM p2 WHERE feature IN ('mz_101','mz_102') UNION ALL SELECT pixel_id, 'mz_103|mz_104', min(value) FROM p2 WHERE feature IN ('mz_103','mz_104') GROUP BY 1),
db(pair, ligand, receptor) AS (VALUES ('mz_101_mz_102', 'mz_101', 'mz_102'), ('mz_103|mz_104_mz_101', 'mz_103|mz_104', 'mz_101'))
"""


@query("lr_expression", f"""WITH {P2}, {LR}, {LABELS.split('pr AS')[0].rstrip().rstrip(',')}, ct AS (SELECT domain FROM p2p GROUP BY 1 HAVING count(*) >= 5),
m AS (SELECT perm, domain, complex, avg(value) AS mean, avg(CASE WHEN value > 0.08 THEN 1.0 ELSE 0.0 END) AS fr FROM lab JOIN ct USING (domain) JOIN cx ON cx.pixel_id = lab.id GROUP BY 1, 2, 3),
s AS (SELECT l.perm, pair, l.domain AS sender, r.domain AS receiver, CASE WHEN l.fr >= 0.1 AND r.fr >= 0.1 THEN l.mean + r.mean ELSE 0 END AS score FROM db JOIN m l ON l.complex = ligand JOIN m r ON r.complex = receptor AND r.perm = l.perm),
o AS (SELECT pair, sender, receiver, score AS o FROM s WHERE perm = 0)
SELECT pair, sender, receiver, round(any_value(o), 6) AS score, round(avg(score), 6) AS random_mean, round(least(1, 2.0 * least((count(*) FILTER (score >= o - 1e-9) + 1) / {NP + 1}.0, (count(*) FILTER (score <= o + 1e-9) + 1) / {NP + 1}.0)), 6) AS p_value FROM s JOIN o USING (pair, sender, receiver) WHERE perm > 0 GROUP BY 1, 2, 3""")
def _(spark, sf):
    out = signaling.communication(p2(spark, sf, 4), p2_pixels(spark, sf), _database(spark), threshold=0.08, n_perm=NP)
    return out.select("pair", "sender", "receiver", "score", "random_mean", "p_value")


@query("lr_spatial", f"""WITH {P2}, {ROOK2}, {LR}, b AS (SELECT src, dst FROM rook2 UNION ALL SELECT dst, src FROM rook2),
tc AS (SELECT DISTINCT a.domain AS type, c.domain AS other, a.pixel_id FROM b JOIN p2p a ON a.pixel_id = src JOIN p2p c ON c.pixel_id = dst), ct AS (SELECT type, other, count(*) AS n FROM tc GROUP BY 1, 2 HAVING count(*) >= 5),
m AS (SELECT type, other, complex, avg(value) AS mean FROM tc JOIN ct USING (type, other) JOIN cx USING (pixel_id) GROUP BY 1, 2, 3)
SELECT pair, l.type AS sender, l.other AS receiver, round(l.mean + r.mean, 6) AS score FROM db JOIN m l ON l.complex = ligand JOIN m r ON r.complex = receptor AND r.type = l.other AND r.other = l.type""")
def _(spark, sf):
    out = signaling.spatial_communication(p2(spark, sf, 4), p2_pixels(spark, sf), _rook(spark, sf), _database(spark), n_perm=5)
    return out.select("pair", "sender", "receiver", "score")


# --- distance gradients -----------------------------------------------------------------------------

BOUNDARY = f"""
b2 AS (SELECT src, dst FROM rook2 UNION ALL SELECT dst, src FROM rook2),
bd AS (SELECT DISTINCT t.pixel_id, t.x, t.y FROM p2p t JOIN b2 ON b2.src = t.pixel_id JOIN p2p o ON o.pixel_id = b2.dst WHERE t.domain = 'd3' AND o.domain <> 'd3'),
nr AS (SELECT a.pixel_id, a.domain = 'd3' AS inside, sqrt(min((a.x - bd.x) * (a.x - bd.x) * 2500.0 + (a.y - bd.y) * (a.y - bd.y) * 625.0)) AS d FROM p2p a CROSS JOIN bd GROUP BY 1, 2),
ds AS (SELECT pixel_id, inside, CASE WHEN inside THEN -d ELSE d END AS distance FROM nr)
"""


def _distance(spark, sf):
    return distance.reference_distance(p2_pixels(spark, sf), "d3", 50, 25)


@query("reference_distance_boundary", f"WITH {P2}, {ROOK2}, {BOUNDARY} SELECT pixel_id, inside, round(distance, 6) + 0.0 AS distance, 'computed' AS status FROM ds")
def _(spark, sf):
    return _distance(spark, sf).select("pixel_id", "inside", "distance", "status")


@query("reference_distance_centroid", f"""WITH RECURSIVE {P2}, n0 AS (SELECT * FROM p2p WHERE domain = 'd3'), e0 AS (SELECT least(a.pixel_id, b.pixel_id) AS src, greatest(a.pixel_id, b.pixel_id) AS dst FROM n0 a JOIN n0 b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)),
both_ AS (SELECT src AS a, dst AS b FROM e0 UNION SELECT dst, src FROM e0), reach AS (SELECT pixel_id AS a, pixel_id AS c FROM n0 UNION SELECT b.b, r.c FROM reach r JOIN both_ b ON b.a = r.a), comp AS (SELECT a AS pixel_id, min(c) AS c FROM reach GROUP BY 1),
ce AS (SELECT c, avg(x * 50.0) AS x, avg(y * 25.0) AS y FROM comp JOIN p2p USING (pixel_id) GROUP BY 1)
SELECT a.pixel_id, round(sqrt(min((a.x * 50.0 - ce.x) * (a.x * 50.0 - ce.x) + (a.y * 25.0 - ce.y) * (a.y * 25.0 - ce.y))), 6) AS distance FROM p2p a CROSS JOIN ce GROUP BY 1""")
def _(spark, sf):
    return distance.reference_distance(p2_pixels(spark, sf), "d3", 50, 25, "centroid").select("pixel_id", "distance")


RINGS = "rg AS (SELECT pixel_id, distance, CASE WHEN distance = 0 THEN 'boundary' ELSE CASE WHEN distance < 0 THEN 'inner_' ELSE 'outer_' END || lpad(CAST(CAST(greatest(1, ceil(abs(distance) / 60.0)) AS BIGINT) AS VARCHAR), 2, '0') END AS ring FROM ds)"


@query("distance_rings", f"WITH {P2}, {ROOK2}, {BOUNDARY}, {RINGS} SELECT pixel_id, round(distance, 6) + 0.0 AS distance, ring FROM rg")
def _(spark, sf):
    return distance.bin_rings(_distance(spark, sf), "fixed_width", ring_width=60.0).select("pixel_id", "distance", "ring")


@query("distance_profiles", f"""WITH {P2}, {ROOK2}, {BOUNDARY}, {RINGS}, r AS (SELECT CAST(pixel_id % 4 AS BIGINT) AS subject_id, ring, feature, value, distance, pixel_id FROM p2 JOIN rg USING (pixel_id)),
p AS (SELECT subject_id, ring FROM r GROUP BY 1, 2 HAVING count(DISTINCT pixel_id) >= 3), s AS (SELECT subject_id, ring FROM (SELECT *, count(*) OVER (PARTITION BY ring) AS k FROM p) WHERE k >= 2)
SELECT r.subject_id, r.ring, feature, round(avg(value), 6) AS value, count(*) AS n_pixels, round(avg(distance), 6) + 0.0 AS mean_distance, any_value(s.ring) IS NOT NULL AS included FROM r LEFT JOIN s ON s.subject_id = r.subject_id AND s.ring = r.ring GROUP BY 1, 2, 3""")
def _(spark, sf):
    rings = distance.bin_rings(_distance(spark, sf), "fixed_width", ring_width=60.0)
    long = p2(spark, sf).withColumn("subject_id", F.col("pixel_id") % 4)
    return distance.distance_profiles(long, rings, min_pixels=3).drop("section_id")


