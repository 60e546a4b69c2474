"""Graph measures over edges (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracequarry.plans.shared import materialise


def degrees(edges: DataFrame) -> DataFrame:
    """node, n_in and n_out, in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.i").alias("n_in"), F.sum("e.o").alias("n_out"))


def pagerank(edges: DataFrame, rounds: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6, personal: DataFrame | None = None) -> DataFrame:
    """node and rank; the mass of nodes without out-edges is spread like the jumps.

    Ends when the ranks move by less than tolerance a node, summed over all nodes, or after `rounds`. personal (node,
    weight) directs the jumps; without it, or where no weight is above 0, they are even. A round is one join and one
    aggregation on the node; each is stored in the shared folder once, so none is computed again for the next, and
    two numbers of it come to the driver.
    """
    out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    links = materialise(edges.join(out, "src").select("src", "dst", (1.0 / F.col("n")).alias("share")), "links")
    nodes = degrees(edges).select("node", (F.col("n_out") == 0).alias("dangling"))
    if personal is not None:
        nodes = nodes.join(personal.select("node", F.greatest("weight", F.lit(0.0)).cast("double").alias("weight")), "node", "left").fillna(0.0, ["weight"])
    else:
        nodes = nodes.withColumn("weight", F.lit(1.0))
    nodes = materialise(nodes, "nodes")
    n, total = nodes.agg(F.count(F.lit(1)), F.sum("weight")).first()
    nodes = nodes.withColumn("jump", F.col("weight") / total if total else F.lit(1.0 / max(n, 1))).drop("weight")
    ranks = materialise(nodes.withColumns({"rank": F.lit(1.0 / max(n, 1)), "moved": F.lit(0.0)}), "ranks")
    for _ in range(rounds):
        lost = ranks.agg(F.sum(F.when(F.col("dangling"), F.col("rank")))).first()[0] or 0.0
        got = ranks.join(links, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("to")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = F.lit(1 - alpha + alpha * lost) * F.col("jump") + alpha * F.coalesce("got", F.lit(0.0))
        ranks = materialise(ranks.join(got, F.col("node") == F.col("to"), "left").select("node", "dangling", "jump", rank.alias("rank"), F.abs(rank - F.col("rank")).alias("moved")), "ranks")
        if tolerance is not None and (ranks.agg(F.sum("moved")).first()[0] or 0.0) < n * tolerance:
            break
    return ranks.select("node", "rank")


def betweenness(edges: DataFrame, most_nodes: int = 300) -> DataFrame:
    """Normalised betweenness of every node, exact, by breadth-first levels from all nodes side by side.

    For graphs of modules; refused above most_nodes, where paths from all to all grow with the square.
    """
    nodes = materialise(degrees(edges).select("node"), "bc_nodes")
    n = nodes.count()
    if n > most_nodes:
        raise ValueError(f"{n} nodes; betweenness is for at most {most_nodes}")
    links = edges.select("src", "dst").distinct()
    level = nodes.select(F.col("node").alias("s"), "node", F.lit(0).alias("d"), F.lit(1.0).alias("paths"))
    seen = level
    for depth in range(1, n + 1):  # the last level is empty: no shortest path has n edges
        ahead = level.join(links, F.col("node") == F.col("src")).groupBy("s", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        level = materialise(ahead.join(seen.select("s", "node"), ["s", "node"], "left_anti").select("s", "node", F.lit(depth).alias("d"), "paths"), "bc_level")
        if level.isEmpty():
            break
        seen = materialise(seen.unionByName(level), "bc_seen")
    deepest = seen.agg(F.max("d")).first()[0] or 0
    back = seen.select("s", "node", "d", "paths", F.lit(0.0).alias("dep"))
    for depth in range(deepest, 0, -1):
        far = back.where(F.col("d") == depth).select("s", F.col("node").alias("w"), F.col("paths").alias("pw"), F.col("dep").alias("dw"))
        gain = far.join(links, F.col("w") == F.col("dst")).join(back.where(F.col("d") == depth - 1).select("s", F.col("node").alias("src"), F.col("paths").alias("pv")), ["s", "src"])
        gain = gain.groupBy("s", F.col("src").alias("node")).agg(F.sum(F.col("pv") / F.col("pw") * (1 + F.col("dw"))).alias("more"))
        back = materialise(back.join(gain, ["s", "node"], "left").select("s", "node", "d", "paths", (F.col("dep") + F.coalesce("more", F.lit(0.0))).alias("dep")), "bc_back")
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    total = back.where("s <> node").groupBy("node").agg(F.sum("dep").alias("dep"))
    return nodes.join(total, "node", "left").select("node", (F.coalesce("dep", F.lit(0.0)) * scale).alias("betweenness"))
