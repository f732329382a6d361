"""Graph operators: connected components, PageRank, link semi-join, static document score."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftspark.session import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every node that has an edge to another node.

    ``component`` is the smallest id of the component. Alternating large-star
    and small-star steps contract long chains in O(log n) rounds; every step is
    a partially aggregated ``min`` and an equi-join, so a hub that touches a
    third of all rows is pre-aggregated and its join partition may be split by
    AQE. Nulls and self loops are ignored; an edge may be repeated in any
    direction. Each round is cut with a reliable checkpoint.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v").distinct()
    e = cut(e)
    state = None
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is tied to the smallest node around u
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: every smaller neighbour of u, and u, are tied to the smallest one
        down = large.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("connected components did not converge")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    roots = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.union(roots).distinct()


def known_links(docs: DataFrame, id_col: str = "doc_id", links_col: str = "links") -> DataFrame:
    """(src, dst): links to known ids, without self links and repeats; null lists have none."""
    e = docs.select(F.col(id_col).alias("src"), F.explode(links_col).alias("dst")).where("src <> dst").distinct()
    return e.join(docs.select(F.col(id_col).alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_rounds: int = 200, rounds: int | None = None, every: int = 5) -> DataFrame:
    """(id, pr): PageRank of ``nodes`` (id) over ``edges`` (src, dst); ranks add up to 1.

    The mass of nodes without links is spread evenly. Stops when the L1 change
    is at most ``tolerance``, or after exactly ``rounds``. Contributions are
    added up in each task before the shuffle, so a much linked node is no hot
    spot; the lineage is cut by a checkpoint every few rounds.
    """
    nodes = nodes.select("id").distinct()
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("pr", F.lit(0.0))
    edges = edges.where("src <> dst").select("src", "dst").distinct()
    edges = cut(edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi"))
    out = edges.groupBy("src").agg(F.count("*").alias("links")).withColumnRenamed("src", "id")
    base = cut(nodes.join(out, "id", "left"))
    pr = base.select("id", "links", F.lit(1.0 / n).alias("pr"))
    for i in range(rounds or max_rounds):
        flow = edges.join(pr.select(F.col("id").alias("src"), (F.col("pr") / F.col("links")).alias("part")), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("flow"))
        lost = pr.agg(F.coalesce(F.sum(F.when(F.col("links").isNull(), F.col("pr"))), F.lit(0.0)).alias("lost"))
        new = pr.withColumnRenamed("pr", "old").join(flow, "id", "left").join(F.broadcast(lost))
        new = new.select("id", "links", "old", ((1 - damping) / n + damping * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / n)).alias("pr"))
        if rounds is None or (i + 1) % every == 0 or i + 1 == rounds:
            new = cut(new)
        moved = None if rounds else new.agg(F.sum(F.abs(F.col("pr") - F.col("old")))).first()[0]
        pr = new.drop("old")
        if moved is not None and moved <= tolerance:
            break
    return pr.select("id", "pr")
