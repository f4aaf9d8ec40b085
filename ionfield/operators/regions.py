"""Regions of interest: definitions, geometry, tiling, candidates, scores, label corroboration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import ROOT_EPS, equal_width_bin, normalized_logistic, url_encode_reserved
from .graph import components, lattice_edges


def pixel_ids_text(order: str = "pixel_id") -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(F.collect_list(order)), lambda i: i.cast("string")))


def sample_subregions(long: DataFrame, grid_size: int = 5, min_pixels: int = 30, roi: str | None = None, scope: str = "global") -> DataFrame:
    """Means per tile of an equal-width grid over the whole field, or over each region; tiles with fewer than
    ``min_pixels`` pixels are left out.  (sample_id, roi, feature, value, n_pixels, bounds.)"""
    pixels = long.select("pixel_id", "x", "y", (F.col(roi) if roi else F.lit("all")).alias("roi")).distinct()
    keys = ["roi"] if scope == "roi" else []
    bounds = pixels.groupBy(*keys).agg(*(f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))))
    at = pixels.join(bounds, keys) if keys else pixels.crossJoin(F.broadcast(bounds))  # one row without keys
    at = at.select("pixel_id", "roi", "x", "y", equal_width_bin(F.col("x"), F.col("x_lo"), F.col("x_hi"), grid_size).alias("gx"), equal_width_bin(F.col("y"), F.col("y_lo"), F.col("y_hi"), grid_size).alias("gy"))
    tile = at.groupBy("roi", "gx", "gy").agg(F.count("*").alias("n_pixels"), F.avg("x").alias("x_center"), F.avg("y").alias("y_center"), (F.max("x") - F.min("x")).alias("x_span"), (F.max("y") - F.min("y")).alias("y_span")).where(F.col("n_pixels") >= min_pixels)
    means = long.select("pixel_id", "feature", "value").join(at.select("pixel_id", "roi", "gx", "gy"), "pixel_id").groupBy("roi", "gx", "gy", "feature").agg(F.avg("value").alias("value"))
    name = F.concat_ws("_", url_encode_reserved(F.col("roi").cast("string")), F.col("gx").cast("string"), F.col("gy").cast("string"))
    return tile.join(means, ["roi", "gx", "gy"]).withColumn("sample_id", name)


def sample_matched_regions(long: DataFrame, region: str, section: str = "section_id", min_pixels: int = 30) -> DataFrame:
    """Means per (section, region) with enough pixels; the id joins both, percent-encoded, by ``__``."""
    keys = [section, region]
    n = long.select("pixel_id", *keys).distinct().groupBy(*keys).agg(F.count("*").alias("n_pixels")).where(F.col("n_pixels") >= min_pixels)
    means = long.where(F.col(region).isNotNull()).groupBy(*keys, "feature").agg(F.avg("value").alias("value"))
    return means.join(n, keys).withColumn("sample_id", F.concat_ws("__", *(url_encode_reserved(F.col(k).cast("string")) for k in keys)))


def metaboanalyst_table(samples: DataFrame, group: str, features: list[str], prefix: str = "") -> DataFrame:
    """Sample, Group and a column per feature."""
    wide = samples.groupBy("sample_id", group).pivot("feature", features).agg(F.first("value"))
    return wide.select(F.col("sample_id").alias("Sample"), F.concat(F.lit(prefix), F.col(group).cast("string")).alias("Group"), *(F.col(f"`{f}`") for f in features))


def backmap_scores(scores: DataFrame, mapping: DataFrame, score: str) -> DataFrame:
    """(pixel_id, score) from sample scores and the samples' comma-joined pixel ids."""
    return scores.join(mapping.select("sample_id", F.explode(F.split("pixel_ids", ",")).alias("pixel_id")), "sample_id").select(F.col("pixel_id").cast("long").alias("pixel_id"), "sample_id", score)


def roi_boxes(pixels: DataFrame, boxes: list[tuple[str, float, float, float, float]]) -> DataFrame:
    """Adds ``roi_id``: the last box (name, x0, x1, y0, y1) that holds the pixel, borders included; reversed
    bounds are swapped and boxes without finite bounds are ignored."""
    rule = F.lit(None).cast("string")
    for name, *b in boxes:
        if all(math.isfinite(v) for v in b):
            x0, x1, y0, y1 = min(b[:2]), max(b[:2]), min(b[2:]), max(b[2:])
            rule = F.when(F.col("x").between(x0, x1) & F.col("y").between(y0, y1), name).otherwise(rule)
    return pixels.withColumn("roi_id", rule)


def membership(x: Column, y: Column, cx: float, cy: float, size: float, shape: str = "square") -> Column:
    """Chebyshev half-size for squares, diameter for circles; both borders included."""
    if shape == "square":
        return (F.abs(x - cx) <= size / 2) & (F.abs(y - cy) <= size / 2)
    return (x - cx) * (x - cx) + (y - cy) * (y - cy) <= (size / 2) ** 2


def point_in_ring(x: Column, y: Column, ring: list[tuple[float, float]], boundary_inside: bool = True) -> Column:
    """Even-odd rule, with points on the ring counted in or out by choice."""
    scale = max(1.0, *(abs(v) for p in ring for v in p))
    inside, on = F.lit(0), F.lit(False)
    for (xj, yj), (xi, yi) in zip([ring[-1], *ring[:-1]], ring, strict=True):
        if (xi, yi) == (xj, yj):
            continue
        crosses = (F.lit(yi) > y) != (F.lit(yj) > y)
        at = F.lit(xj) + (y - yj) * (xi - xj) / (yi - yj) if yi != yj else F.lit(xj)
        inside = inside + F.when(crosses & (x < at), 1).otherwise(0)
        cross = (x - xj) * (yi - yj) - (y - yj) * (xi - xj)
        tol = ROOT_EPS * scale
        on = on | ((F.abs(cross) <= tol) & x.between(min(xi, xj) - tol, max(xi, xj) + tol) & y.between(min(yi, yj) - tol, max(yi, yj) + tol))
    return F.when(on, F.lit(boundary_inside)).otherwise(inside % 2 == 1)


def point_in_polygon(x: Column, y: Column, outer: list, holes: list = ()) -> Column:
    """In the outer ring (border included) and in no hole (whose border is part of the hole)."""
    out = point_in_ring(x, y, outer)
    for hole in holes:
        out = out & ~point_in_ring(x, y, hole)
    return out


def apply_overlap(pixels: DataFrame, masks: list[tuple[str, Column]], policy: str = "error") -> DataFrame:
    """Adds ``roi_id`` by ``first``, ``last`` or ``error`` (raises where masks overlap)."""
    names = F.filter(F.array(*(F.when(m, n) for n, m in masks)), lambda n: n.isNotNull())
    rows = pixels.withColumn("_n", names)
    if policy == "error" and not rows.where(F.size("_n") > 1).isEmpty():
        raise ValueError("regions overlap")
    at = F.get("_n", F.lit(0)) if policy != "last" else F.get("_n", F.size("_n") - 1)
    return rows.withColumn("roi_id", at).drop("_n")


def slide_area(pixels: DataFrame) -> DataFrame:
    """One row: (x range + median step) * (y range + median step)."""
    def side(c):
        steps = pixels.select(c).distinct().withColumn("d", F.col(c) - F.lag(c).over(Window.orderBy(c)))
        return steps.agg((F.max(c) - F.min(c) + F.median("d")).alias("s_" + c))

    return side("x").crossJoin(side("y")).select((F.col("s_x") * F.col("s_y")).alias("area"))  # one row each


def grid_candidates(pixels: DataFrame, size: float, n: int, seed: int = 1, shape: str = "square") -> tuple[DataFrame, DataFrame]:
    """(candidate, cx, cy) at n pixels in hash order whose window lies inside the field, and their members."""
    lo_x, hi_x, lo_y, hi_y = pixels.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    h = size / 2
    inner = pixels.where(F.col("x").between(lo_x + h, hi_x - h) & F.col("y").between(lo_y + h, hi_y - h))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("pixel_id").cast("string")))
    chosen = inner.orderBy(key, "pixel_id").limit(n).select(F.col("pixel_id").alias("candidate"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    from .graph import radius_pairs

    a = chosen.select(F.lit(1).alias("k"), F.col("candidate").alias("id"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    b = pixels.select(F.lit(1).alias("k"), F.col("pixel_id").alias("id"), "x", "y")
    pairs = radius_pairs(a, b, h * (1 if shape == "circle" else math.sqrt(2)), ("k",), ROOT_EPS).select(F.col("src").alias("candidate"), F.col("dst").alias("pixel_id"))
    at = pairs.join(chosen, "candidate").join(pixels.select("pixel_id", "x", "y"), "pixel_id")
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    inside = (F.abs(dx) <= h) & (F.abs(dy) <= h) if shape == "square" else dx * dx + dy * dy <= h * h
    return chosen, at.where(inside).select("candidate", "pixel_id")


def domain_candidates(pixels: DataFrame, min_size: int = 20, method: str = "rook", label: str = "domain", keys=("section_id",)) -> DataFrame:
    """Connected parts of each label with at least ``min_size`` pixels: (component, label, n, centre)."""
    edges = lattice_edges(pixels, method, keys)
    lab = pixels.select(F.col("pixel_id").alias("_i"), F.col(label).alias("_l"))
    same = edges.join(lab.toDF("src", "la"), "src").join(lab.toDF("dst", "lb"), "dst").where("la = lb")
    parts = components(pixels, same, keys).select("pixel_id", "component")
    return pixels.join(parts, "pixel_id").groupBy(*keys, "component", label).agg(F.count("*").alias("n_pixels"), F.avg("x").alias("x_center"), F.avg("y").alias("y_center")).where(F.col("n_pixels") >= min_size)


def score_candidates(members: DataFrame, pixels: DataFrame, target: dict[str, float], weights: tuple[float, float, float] = (1, 1, 1), label: str = "domain", objective: str = "balanced", target_label: str | None = None) -> DataFrame:
    """(candidate, n, coverage, balance, size, score): root share of labelled members; cosine of label counts
    with the target proportions (or the target label's share); logistic of the covered fraction of the field;
    weighted geometric mean, 0 where an active part is not positive."""
    total = pixels.agg(F.count(label).alias("n_field"))
    rows = members.join(pixels.select("pixel_id", F.col(label).alias("l")), "pixel_id")
    counts = rows.groupBy("candidate").agg(F.count("*").alias("n"), F.count("l").alias("valid"), *(F.sum((F.col("l") == k).cast("long")).alias(f"c{i}") for i, k in enumerate(target)))
    t = list(target.values())
    dot = sum((F.col(f"c{i}") * w for i, w in enumerate(t)), F.lit(0.0))
    norm = F.sqrt(sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(len(t))), F.lit(0.0))) * math.sqrt(sum(w * w for w in t))
    part = F.coalesce(dot / F.nullif(norm, F.lit(0.0)), F.lit(0.0)) if objective == "balanced" else F.col(f"c{list(target).index(target_label)}") / F.col("n")
    out = counts.crossJoin(F.broadcast(total)).select("candidate", "n", F.sqrt(F.col("valid") / F.col("n")).alias("coverage"), part.alias("balance"), normalized_logistic(F.col("valid") / F.col("n_field")).alias("size"))  # one row
    w = [v / sum(weights) for v in weights]
    active = [(F.col(c), v) for c, v in zip(("coverage", "balance", "size"), w, strict=True) if v > 0]
    bad = F.lit(False)
    logs = F.lit(0.0)
    for c, v in active:
        bad, logs = bad | (c <= 0), logs + v * F.ln(F.when(c > 0, c))
    return out.withColumn("score", F.when(bad, 0.0).otherwise(F.exp(logs)))


def optimize_rois(vectors: dict[int, tuple[set, dict[str, int]]], target: dict[str, float], n_field: int, max_rois: int = 10, threshold: float = 0.03, beam: int = 25, pool: int = 250) -> tuple[list[int], list[float]]:
    """Beam search over disjoint candidates (members, label counts) that stops when a step gains less than
    ``threshold``; the compact vectors of the best ``pool`` candidates are all it needs (driver)."""
    def score(ids):
        counts: dict[str, int] = {}
        n = valid = 0
        for i in ids:
            members, c = vectors[i]
            n += len(members)
            for k, v in c.items():
                counts[k] = counts.get(k, 0) + v
                valid += v
        norm = math.sqrt(sum(v * v for v in counts.values())) * math.sqrt(sum(v * v for v in target.values()))
        balance = sum(counts.get(k, 0) * w for k, w in target.items()) / norm if norm else 0.0
        f = lambda x: 1 / (1 + math.exp(-12 * (x - 0.1)))
        size = min(1.0, max(0.0, (f(valid / n_field) - f(0)) / (f(1) - f(0))))
        parts = (math.sqrt(valid / n) if n else 0.0, balance, size)
        return 0.0 if min(parts) <= 0 else math.exp(sum(math.log(p) for p in parts) / 3)

    best_pool = sorted(vectors, key=lambda i: (-score([i]), i))[:pool]
    beams: list[tuple[float, list[int], set]] = [(0.0, [], set())]
    chosen, history = [], []
    last = 0.0
    for _ in range(max_rois):
        grown = {}
        for _, ids, members in beams:
            for i in best_pool:
                if i not in ids and not (members & vectors[i][0]):
                    key = tuple(sorted([*ids, i]))
                    grown.setdefault(key, (score(key), list(key), members | vectors[i][0]))
        beams = sorted(grown.values(), key=lambda b: (-b[0], b[1]))[:beam]
        if not beams or beams[0][0] - last < threshold:
            break
        last, chosen = beams[0][0], beams[0][1]
        history.append(last)
    return chosen, history


def corroborate_labels(df: DataFrame, a: str, b: str, min_fraction: float = 0.5, min_count: int = 1, mapping: str = "mutual_best") -> DataFrame:
    """Pairs of labels with counts, fractions of each side, Jaccard, best partners and acceptance."""
    pairs = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    wa, wb = Window.partitionBy("a"), Window.partitionBy("b")
    rows = pairs.withColumns({"na": F.sum("n").over(wa), "nb": F.sum("n").over(wb), "ra": F.row_number().over(wa.orderBy(F.desc("n"), "b")), "rb": F.row_number().over(wb.orderBy(F.desc("n"), "a"))})
    rows = rows.withColumns({"a_fraction": F.col("n") / F.col("na"), "b_fraction": F.col("n") / F.col("nb"), "jaccard": F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), "mutual": (F.col("ra") == 1) & (F.col("rb") == 1)})
    best = (F.col("ra") == 1) & (F.col("n") >= min_count) & (F.col("a_fraction") >= min_fraction)
    accepted = best if mapping == "one_way" else best & F.col("mutual") & (F.col("b_fraction") >= min_fraction)
    return rows.withColumn("accepted", accepted).select("a", "b", "n", "a_fraction", "b_fraction", "jaccard", "mutual", "accepted")


def boundary_edges(pixels: DataFrame, keys=("section_id", "roi_id")) -> DataFrame:
    """Unit cell sides that belong to one pixel of the region only: (keys, x0, y0, x1, y1) in half-open cells."""
    x, y = F.col("x"), F.col("y")
    side = lambda ax, ay, bx, by: F.struct(ax.cast("long").alias("x0"), ay.cast("long").alias("y0"), bx.cast("long").alias("x1"), by.cast("long").alias("y1"))
    sides = F.explode(F.array(side(x, y, x + 1, y), side(x, y + 1, x + 1, y + 1), side(x, y, x, y + 1), side(x + 1, y, x + 1, y + 1))).alias("e")
    return pixels.select(*keys, sides).select(*keys, "e.*").groupBy(*keys, "x0", "y0", "x1", "y1").agg(F.count("*").alias("n")).where("n = 1").drop("n")


def stitch_rings(edges: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int]]]:
    """Closed rings of one region's boundary sides."""
    near: dict[tuple[int, int], list] = {}
    for x0, y0, x1, y1 in edges:
        near.setdefault((x0, y0), []).append((x1, y1))
        near.setdefault((x1, y1), []).append((x0, y0))
    rings = []
    while any(near.values()):
        start = here = min(p for p, q in near.items() if q)
        ring, came = [start], None
        while True:
            # At a crossing of two corners, turn rather than go straight on.
            options = sorted(near[here], key=lambda q: came is not None and (q[0] - here[0], q[1] - here[1]) == (here[0] - came[0], here[1] - came[1]))
            nxt = options[0]
            near[here].remove(nxt)
            near[nxt].remove(here)
            ring.append(nxt)
            came, here = here, nxt
            if here == start:
                break
        rings.append(ring)
    return rings


def region_polygons(pixels: DataFrame, keys=("section_id", "roi_id")) -> DataFrame:
    """(keys, ring_id, ring_role, vertex_order, x, y): exteriors run counter-clockwise around their area; a
    ring inside another one is a hole.  A region's outline is stitched in one task."""
    import pandas as pd

    from ..storage import ship_package

    ship_package(pixels.sparkSession)
    names = list(keys)

    def stitch(key, pdf):
        rings = stitch_rings(list(pdf[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)))
        rows = []
        for i, ring in enumerate(rings):
            x0, y0 = ring[0]
            inside = sum(_contains(other, x0 + 0.25, y0 + 0.25) for j, other in enumerate(rings) if j != i)
            for v, (x, y) in enumerate(ring):
                rows.append((*key, i + 1, "hole" if inside % 2 else "outer", v + 1, float(x), float(y)))
        return pd.DataFrame(rows, columns=[*names, "ring_id", "ring_role", "vertex_order", "x", "y"])

    types = dict(pixels.dtypes)
    return boundary_edges(pixels, keys).groupBy(*keys).applyInPandas(stitch, ", ".join(f"{k} {types[k]}" for k in keys) + ", ring_id int, ring_role string, vertex_order int, x double, y double")


def _contains(ring, x, y) -> bool:
    inside = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            inside = not inside
    return inside


def ring_areas(vertices: DataFrame, keys=("roi_id", "polygon_part_id", "ring_id", "ring_role")) -> DataFrame:
    """(keys, area): shoelace area of each ring of (keys, vertex_order, x, y)."""
    w = Window.partitionBy(*keys).orderBy("vertex_order")
    first = Window.partitionBy(*keys).orderBy("vertex_order").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = vertices.withColumns({"nx": F.coalesce(F.lead("x").over(w), F.first("x").over(first)), "ny": F.coalesce(F.lead("y").over(w), F.first("y").over(first))})
    return rows.groupBy(*keys).agg((F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2).alias("area"))


def validate_shapes(vertices: DataFrame, max_area: float, min_spacing: float, min_area: float) -> DataFrame:
    """Per polygon part: net area, ring roles, self-intersection, spacing to other shapes of the section and the
    reasons it fails, in a fixed order; ``pass`` where there is none.

    Segments meet only within cells of ``min_spacing`` plus their own length, never all against all."""
    part = ["section_id", "roi_id", "polygon_part_id"]
    areas = ring_areas(vertices, (*part, "ring_id", "ring_role"))
    net = areas.groupBy(*part).agg((F.sum(F.when(F.col("ring_role") == "outer", F.col("area")).otherwise(0.0)) - F.sum(F.when(F.col("ring_role") == "hole", F.col("area")).otherwise(0.0))).alias("net_area"), F.sum((F.col("ring_role") == "outer").cast("int")).alias("outers"), F.sum((~F.col("ring_role").isin("outer", "hole")).cast("int")).alias("others"))
    w = Window.partitionBy(*part, "ring_id").orderBy("vertex_order")
    seg = vertices.withColumns({"bx": F.lead("x").over(w), "by": F.lead("y").over(w)}).where("bx is not null").select(*part, "ring_id", "ring_role", "vertex_order", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")
    a, b = seg.alias("a"), seg.alias("b")
    orient = lambda px, py, qx, qy, rx, ry: F.signum((F.col(qx) - F.col(px)) * (F.col(ry) - F.col(py)) - (F.col(qy) - F.col(py)) * (F.col(rx) - F.col(px)))
    proper = (orient("a.ax", "a.ay", "a.bx", "a.by", "b.ax", "b.ay") * orient("a.ax", "a.ay", "a.bx", "a.by", "b.bx", "b.by") < 0) & (orient("b.ax", "b.ay", "b.bx", "b.by", "a.ax", "a.ay") * orient("b.ax", "b.ay", "b.bx", "b.by", "a.bx", "a.by") < 0)
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in part]
    crossing = a.join(b, [*same, (F.col("a.ring_id") * 1000000 + F.col("a.vertex_order")) < (F.col("b.ring_id") * 1000000 + F.col("b.vertex_order"))]).where(proper).select(*(F.col(f"a.{k}") for k in part)).distinct().withColumn("self_intersection", F.lit(True))
    cell = F.max(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))
    width = (seg.agg(cell).first()[0] or 0.0) + min_spacing
    mid = seg.withColumns({"cx": F.floor((F.col("ax") + F.col("bx")) / 2 / width), "cy": F.floor((F.col("ay") + F.col("by")) / 2 / width)})
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("o")
    p = mid.select("*", offsets).withColumns({"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}).drop("o").alias("p")
    q = mid.alias("q")

    def to_segment(px, py, s):
        dx, dy = F.col(f"{s}.bx") - F.col(f"{s}.ax"), F.col(f"{s}.by") - F.col(f"{s}.ay")
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((F.col(px) - F.col(f"{s}.ax")) * dx + (F.col(py) - F.col(f"{s}.ay")) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        ex, ey = F.col(px) - F.col(f"{s}.ax") - t * dx, F.col(py) - F.col(f"{s}.ay") - t * dy
        return F.sqrt(ex * ex + ey * ey)

    gap = F.least(to_segment("p.ax", "p.ay", "q"), to_segment("p.bx", "p.by", "q"), to_segment("q.ax", "q.ay", "p"), to_segment("q.bx", "q.by", "p"))
    near = p.join(q, (F.col("p.section_id") == F.col("q.section_id")) & (F.col("p.cx") == F.col("q.cx")) & (F.col("p.cy") == F.col("q.cy")) & (F.col("p.roi_id") != F.col("q.roi_id"))).groupBy(*(F.col(f"p.{k}").alias(k) for k in part)).agg(F.min(gap).alias("spacing"))
    out = net.join(crossing, part, "left").join(near, part, "left")
    reasons = F.array(
        F.when((F.col("outers") != 1) | (F.col("others") > 0), "invalid_ring_roles"),
        F.when(F.coalesce("self_intersection", F.lit(False)), "self_intersection"),
        F.when(F.coalesce(F.col("net_area") <= 0, F.lit(True)), "invalid_area"),
        F.when(F.col("net_area") > max_area, "area_above_maximum"),
        F.when((F.col("net_area") > 0) & (F.col("net_area") < min_area), "area_below_collectable_minimum"),
        F.when(F.col("spacing") < min_spacing, "spacing_below_minimum"),
    )
    found = F.filter(reasons, lambda r: r.isNotNull())
    return out.select(*part, "net_area", F.coalesce("self_intersection", F.lit(False)).alias("self_intersection"), F.when(F.col("spacing") < min_spacing, F.col("spacing")).alias("spacing"), F.when(F.size(found) > 0, F.array_join(found, ";")).otherwise("pass").alias("qc_reason"))
