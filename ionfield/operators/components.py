"""Connected components of an edge table by repeated contraction (no driver-side graph, any size)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 64) -> DataFrame:
    """(node, component) for every node with an edge; component is its component's smallest node.

    A round hooks each node to its smallest neighbour, jumps that pointer once and contracts the edges to
    the targets, so the number of edges falls geometrically.  Minima are pre-aggregated before the shuffle
    and joins only meet a unique key on one side, so hubs are split by adaptive execution.  Each round's
    tables are written to the shared folder, which cuts the lineage.
    """
    cur = edges.select(F.least(src, dst).alias("u"), F.greatest(src, dst).alias("v")).where("u < v").distinct()
    cur = materialize(cur, "edges")
    labels = None
    for k in range(max_rounds):
        if cur.isEmpty():
            break
        both = cur.select("u", "v").unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("up"))
        hook = materialize(hook, f"hook{k}")
        above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        jumped = materialize(hook.join(above, "up").select("node", F.col("top").alias("up")), f"jump{k}")
        to = jumped.select(F.col("node").alias("u"), F.col("up").alias("pu"))
        tv = jumped.select(F.col("node").alias("v"), F.col("up").alias("pv"))
        moved = cur.join(to, "u").join(tv, "v").where("pu <> pv")
        nxt = moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        cur = materialize(nxt, f"edges{k}")
        if labels is None:
            labels = jumped.select("node", F.col("up").alias("component"))
        else:
            step = jumped.select(F.col("node").alias("component"), F.col("up").alias("to"))
            labels = materialize(labels.join(step, "component", "left").select("node", F.coalesce("to", "component").alias("component")), f"labels{k}")
    else:
        raise RuntimeError("components didn't settle")
    if labels is None:
        return cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
