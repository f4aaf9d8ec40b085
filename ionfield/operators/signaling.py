"""Ligand-receptor communication between cell types, with label permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import adjust_p


def prepare_database(pairs: DataFrame, genes: list[str], delimiter: str = "|") -> DataFrame:
    """(pair, ligand, receptor, ligand_genes, receptor_genes): complexes split and trimmed; pairs with an
    unknown gene and repeated pairs dropped."""
    split = lambda c: F.filter(F.array_distinct(F.transform(F.split(F.col(c), "\\" + delimiter), F.trim)), lambda g: g != "")
    known = F.array(*(F.lit(g) for g in genes))
    rows = pairs.select("ligand", "receptor", split("ligand").alias("ligand_genes"), split("receptor").alias("receptor_genes"))
    whole = lambda c: (F.size(c) > 0) & F.forall(c, lambda g: F.array_contains(known, g))
    return rows.where(whole("ligand_genes") & whole("receptor_genes")).dropDuplicates(["ligand", "receptor"]).withColumn("pair", F.concat_ws("_", "ligand", "receptor"))


def complex_expression(long: DataFrame, database: DataFrame) -> DataFrame:
    """(pixel_id, complex, value): the minimum over a complex's subunits."""
    each = database.select(F.explode(F.array(F.struct(F.col("ligand").alias("complex"), F.col("ligand_genes").alias("genes")), F.struct(F.col("receptor").alias("complex"), F.col("receptor_genes").alias("genes")))).alias("c")).select("c.*").distinct()
    genes = each.select("complex", F.explode("genes").alias("feature"))
    return long.join(genes, "feature").groupBy("pixel_id", "complex").agg(F.min("value").alias("value"))


def _type_means(values: DataFrame, labels: DataFrame, by=()) -> DataFrame:
    rows = values.join(labels, "pixel_id")
    return rows.groupBy(*by, "type", "complex").agg(F.avg("value").alias("mean"), F.avg(F.col("positive").cast("double")).alias("fraction"), F.count("*").alias("n"))


def _scores(database: DataFrame, means: DataFrame, types: DataFrame, least_fraction: float, by=()) -> DataFrame:
    l = means.select(*by, F.col("type").alias("sender"), F.col("complex").alias("ligand"), F.col("mean").alias("ml"), F.col("fraction").alias("fl"))  # noqa: E741
    r = means.select(*by, F.col("type").alias("receiver"), F.col("complex").alias("receptor"), F.col("mean").alias("mr"), F.col("fraction").alias("fr"))
    rows = database.select("pair", "ligand", "receptor").join(l, "ligand").join(r, [*by, "receptor"])
    gate = (F.col("fl") >= least_fraction) & (F.col("fr") >= least_fraction)
    return rows.withColumn("score", F.when(gate, F.col("ml") + F.col("mr")).otherwise(0.0))


def shuffled(pixels: DataFrame, label: str, strata, n_perm: int, seed: int) -> DataFrame:
    from .niches import _shuffled_labels

    return _shuffled_labels(pixels, label, strata, n_perm, seed)


def _finish(observed: DataFrame, null: DataFrame, n_perm: int, p_adjust: str) -> DataFrame:
    keys = ["pair", "sender", "receiver"]
    x = null.select(*keys, F.col("score").alias("s")).join(observed.select(*keys, "score"), keys)
    tiny = 1e-9
    p = x.groupBy(*keys).agg(((F.sum((F.col("s") >= F.col("score") - tiny).cast("long")) + 1) / (F.count("s") + 1)).alias("upper"), ((F.sum((F.col("s") <= F.col("score") + tiny).cast("long")) + 1) / (F.count("s") + 1)).alias("lower"), F.avg("s").alias("random_mean"))
    out = observed.join(p, keys).withColumn("p_value", F.least(F.lit(1.0), 2 * F.least("upper", "lower")))
    return adjust_p(out, "p_value", method=p_adjust)


def communication(long: DataFrame, pixels: DataFrame, database: DataFrame, label: str = "domain", threshold: float = 0.0, min_fraction: float = 0.1, min_cells: int = 5, n_perm: int = 100, seed: int = 1, strata=("section_id",), p_adjust: str = "BH") -> DataFrame:
    """Scores of each pair from each sender to each receiver type: mean ligand plus mean receptor expression,
    0 unless both are expressed above ``threshold`` in ``min_fraction`` of their type's pixels."""
    values = complex_expression(long, database).withColumn("positive", F.col("value") > threshold)
    labels = pixels.select("pixel_id", F.col(label).alias("type"))
    enough = labels.groupBy("type").agg(F.count("*").alias("c")).where(F.col("c") >= min_cells).select("type")
    observed = _scores(database, _type_means(values, labels.join(enough, "type")), enough, min_fraction)
    perms = shuffled(pixels, label, strata, n_perm, seed).join(enough, "type")
    null = _scores(database, _type_means(values, perms, ("perm",)), enough, min_fraction, ("perm",))
    return _finish(observed, null, n_perm, p_adjust)


def spatial_communication(long: DataFrame, pixels: DataFrame, edges: DataFrame, database: DataFrame, label: str = "domain", min_interacting: int = 5, n_perm: int = 100, seed: int = 1, p_adjust: str = "BH") -> DataFrame:
    """As ``communication``, over the pixels that touch the other type only; the null draws as many pixels of
    each type by hash order.  Adds log2 fold change and the interaction index log2fc * -log10(adjusted p)."""
    values = complex_expression(long, database)
    labels = pixels.select("pixel_id", F.col(label).alias("type"))
    a = labels.select(F.col("pixel_id").alias("src"), F.col("type").alias("ta"))
    b = labels.select(F.col("pixel_id").alias("dst"), F.col("type").alias("tb"))
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    touch = both.join(a, "src").join(b, "dst").select(F.col("ta").alias("type"), F.col("tb").alias("other"), F.col("src").alias("pixel_id")).distinct()
    counts = touch.groupBy("type", "other").agg(F.count("*").alias("n")).where(F.col("n") >= min_interacting)

    def means(members, by=()):
        return members.join(values, "pixel_id").groupBy(*by, "type", "other", "complex").agg(F.avg("value").alias("mean"))

    def score(m, by=()):
        l = m.select(*by, F.col("type").alias("sender"), F.col("other").alias("receiver"), F.col("complex").alias("ligand"), F.col("mean").alias("ml"))  # noqa: E741
        r = m.select(*by, F.col("type").alias("receiver"), F.col("other").alias("sender"), F.col("complex").alias("receptor"), F.col("mean").alias("mr"))
        rows = database.select("pair", "ligand", "receptor").join(l, "ligand").join(r, [*by, "receptor", "sender", "receiver"])
        return rows.withColumn("score", F.col("ml") + F.col("mr"))

    observed = score(means(touch.join(counts.select("type", "other"), ["type", "other"])))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col("pixel_id").cast("string")))
    drawn = labels.select("pixel_id", "type", F.explode(F.sequence(F.lit(1), F.lit(n_perm))).alias("perm")).withColumn("r", F.row_number().over(Window.partitionBy("perm", "type").orderBy(key, "pixel_id")))
    members = drawn.join(counts, "type").where(F.col("r") <= F.col("n")).select("perm", "type", "other", "pixel_id")
    out = _finish(observed, score(means(members, ("perm",)), ("perm",)), n_perm, p_adjust)
    fold = F.log2((F.col("score") + 0.1) / (F.col("random_mean") + 0.1))
    return out.withColumn("log2fc", fold).withColumn("interaction_index", F.col("log2fc") * -F.log10(F.greatest(F.col("adj_p_value"), F.lit(2.2250738585072014e-308))))
