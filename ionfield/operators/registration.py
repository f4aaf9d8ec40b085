"""Affine and projective registration, and mask agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import knn_pairs


def fit_affine(points: DataFrame, keys=("section_id",), src=("histology_x", "histology_y"), dst=("msi_x", "msi_y")) -> DataFrame:
    """Per section the least-squares affine map of at least three points that aren't on a line: six
    coefficients, number of points, rmse and largest error (closed form of centred moments)."""
    x, y, u, v = (F.col(c) for c in (*src, *dst))
    rows = points.where(x.isNotNull() & y.isNotNull() & u.isNotNull() & v.isNotNull())
    means = rows.groupBy(*keys).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate((x, y, u, v))), F.count("*").alias("n_points"))
    c = rows.join(means, list(keys))
    d = [F.col(n) - F.col(f"m{i}") for i, n in enumerate((*src, *dst))]
    names = {"xx": (0, 0), "xy": (0, 1), "yy": (1, 1), "xu": (0, 2), "yu": (1, 2), "xv": (0, 3), "yv": (1, 3)}
    m = c.groupBy(*keys, "m0", "m1", "m2", "m3", "n_points").agg(*(F.sum(d[a] * d[b]).alias(n) for n, (a, b) in names.items()))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    m = m.where(F.col("n_points") >= 3).withColumn("det", det).where(F.col("det") > 1e-12 * F.col("xx") * F.col("yy"))
    for w in "uv":
        m = m.withColumns({f"{w}x": (F.col("x" + w) * F.col("yy") - F.col("y" + w) * F.col("xy")) / F.col("det"), f"{w}y": (F.col("y" + w) * F.col("xx") - F.col("x" + w) * F.col("xy")) / F.col("det")})
        m = m.withColumn(f"{w}0", F.col("m2" if w == "u" else "m3") - F.col(f"{w}x") * F.col("m0") - F.col(f"{w}y") * F.col("m1"))
    fit = m.select(*keys, "n_points", "u0", "ux", "uy", "v0", "vx", "vy")
    e = rows.join(fit, list(keys))
    du = F.col("u0") + F.col("ux") * x + F.col("uy") * y - u
    dv = F.col("v0") + F.col("vx") * x + F.col("vy") * y - v
    err = e.groupBy(*keys).agg(F.sqrt(F.avg(du * du + dv * dv)).alias("rmse"), F.sqrt(F.max(du * du + dv * dv)).alias("max_error"))
    return fit.join(err, list(keys))


def check_affine(points: DataFrame, fit: DataFrame, keys=("section_id",)) -> None:
    """Raises for sections with fewer than three points, or points on a line."""
    lost = points.select(*keys).distinct().join(fit.select(*keys), list(keys), "left_anti")
    if not lost.isEmpty():
        raise ValueError("a section has fewer than three control points, or they lie on a line")


def apply_affine(coordinates: DataFrame, fit: DataFrame, keys=("section_id",), src=("x", "y"), out=("msi_x", "msi_y")) -> DataFrame:
    """Adds the mapped coordinates; raises for sections without a map."""
    if not coordinates.select(*keys).distinct().join(fit, list(keys), "left_anti").isEmpty():
        raise ValueError("a section has no registration")
    x, y = F.col(src[0]), F.col(src[1])
    rows = coordinates.join(fit.select(*keys, "u0", "ux", "uy", "v0", "vx", "vy"), list(keys))
    return rows.withColumns({out[0]: F.col("u0") + F.col("ux") * x + F.col("uy") * y, out[1]: F.col("v0") + F.col("vx") * x + F.col("vy") * y}).drop("u0", "ux", "uy", "v0", "vx", "vy")


def apply_projective(coordinates: DataFrame, matrix: list[list[float]], out=("image_x", "image_y")) -> DataFrame:
    """Coordinates relative to the smallest ones, through a 3 x 3 matrix, divided by w."""
    origin = coordinates.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    rows = coordinates.crossJoin(F.broadcast(origin))  # one row
    x, y = F.col("x") - F.col("_x0"), F.col("y") - F.col("_y0")
    a, b, w = (r[0] * x + r[1] * y + r[2] for r in matrix)
    return rows.withColumns({out[0]: a / w, out[1]: b / w}).drop("_x0", "_y0")


def _boundary(mask: DataFrame) -> DataFrame:
    """Pixels of (x, y) with fewer than four lattice neighbours in the mask."""
    four = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))))).alias("o")
    near = mask.select("x", "y", four).select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("x") + F.col("o.a")).alias("x"), (F.col("y") + F.col("o.b")).alias("y")).join(mask, ["x", "y"], "left_semi")
    n = near.groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n"))
    return mask.join(n, ["x", "y"], "left").where(F.coalesce("n", F.lit(0)) < 4).select("x", "y")


def mask_agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row for two masks of (x, y): overlap (share of a in b), Dice, and the median and 95th percentile of
    both boundaries' distances to the other."""
    a, b = a.select("x", "y").distinct(), b.select("x", "y").distinct()
    n = a.agg(F.count("*").alias("na")).crossJoin(b.agg(F.count("*").alias("nb"))).crossJoin(a.join(b, ["x", "y"]).agg(F.count("*").alias("nab")))  # one row each
    rows = lambda m: _boundary(m).select(F.lit(1).alias("k"), F.monotonically_increasing_id().alias("id"), "x", "y")
    from ..storage import materialize

    ba, bb = materialize(rows(a), "boundary_a"), materialize(rows(b), "boundary_b")
    d = knn_pairs(ba, bb, 1, 4.0, ("k",)).unionByName(knn_pairs(bb, ba, 1, 4.0, ("k",)))
    q = d.agg(F.median(F.sqrt("d2")).alias("boundary_median"), F.percentile(F.sqrt("d2"), F.lit(0.95)).alias("boundary_p95"))
    return n.crossJoin(q).select((F.col("nab") / F.col("na")).alias("overlap"), (2 * F.col("nab") / (F.col("na") + F.col("nb"))).alias("dice"), "boundary_median", "boundary_p95")  # one row each
