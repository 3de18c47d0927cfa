"""The association graph: expansion of a result, neighbours over several sources, bridge paths.

Edges are one table with both directions. A walk is a bounded number of equi joins; at each level a
vertex is kept once, by its smallest discoverer, so the frontier never outgrows the vertices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay


def touching(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """The edges that leave a seed ``src``; as the seeds are a semi join, Catalyst puts them below an aggregation of the edges."""
    return edges.join(seeds.select("src").distinct(), "src", "left_semi")


def live_edges(edges: DataFrame, now: int, least: float, cfg: Config = DEFAULT) -> DataFrame:
    """Edges whose decayed weight is at least ``least``."""
    w = decay.link_weight(F.col("weight"), now, F.col("used_us"), cfg)
    return edges.select("src", "dst", w.alias("w"), "created_us").where(F.col("w") >= least)


def first_discoverer(found: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key: the first in the given order."""
    return found.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_rn = 1").drop("_rn")


def expand(direct: DataFrame, edges: DataFrame, memories: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Associated rows of ``query, ingest_seq, rank``: ``query, ingest_seq, link`` by first discoverer.

    Targets must exist and be no stub; cold and superseded ones count.
    """
    seeds = direct.select("query", F.col("ingest_seq").alias("src"), "rank")
    found = live_edges(touching(edges, seeds), now, cfg.association_retrieval_threshold, cfg).join(seeds, "src")
    found = found.join(memories.where("NOT is_stub").select(F.col("ingest_seq").alias("dst")), "dst", "left_semi")
    found = found.join(direct.select("query", F.col("ingest_seq").alias("dst")), ["query", "dst"], "left_anti")
    found = first_discoverer(found, ["query", "dst"], ["rank", "created_us", "dst"])
    return found.select("query", F.col("dst").alias("ingest_seq"), F.col("w").alias("link"))


def discover(direct: DataFrame, seen: DataFrame, edges: DataFrame, memories: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Rows beyond those ``seen``, reached from the direct results in up to ``graph_expansion_hops``: ``query, ingest_seq, link``.

    The walk goes on only from rows it has discovered itself, over edges from ``min_bridge_edge_weight``; a row is
    found by its first discoverer, in the order in which those were found.
    """
    order = ["order", "created_us", "dst"]
    live = memories.where("NOT is_stub").select(F.col("ingest_seq").alias("dst"))
    at, out = direct.select("query", F.col("ingest_seq").alias("src"), F.col("rank").alias("order")), None
    seen = seen.select("query", F.col("ingest_seq").alias("dst"))
    for _ in range(cfg.graph_expansion_hops):
        step = live_edges(touching(edges, at), now, cfg.min_bridge_edge_weight, cfg).join(at, "src")
        step = step.join(live, "dst", "left_semi").join(seen, ["query", "dst"], "left_anti")
        step = first_discoverer(step, ["query", "dst"], order)
        step = step.withColumn("order", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        found = step.select("query", F.col("dst").alias("ingest_seq"), F.col("w").alias("link"))
        out = found if out is None else out.unionByName(found)
        at = step.select("query", F.col("dst").alias("src"), "order")
        seen = seen.unionByName(step.select("query", "dst"))
    return out


def frontier(anchors: DataFrame, edges: DataFrame, now: int, hops: int, least: float, cfg: Config = DEFAULT) -> DataFrame:
    """Vertices newly reached within ``hops`` of the anchors ``query, ingest_seq``: ``query, ingest_seq, hop, link`` (the last edge's weight)."""
    live = live_edges(edges, now, least, cfg)
    seen = anchors.select("query", "ingest_seq")
    at, out = seen, None
    for hop in range(1, hops + 1):
        step = live.join(at.select("query", F.col("ingest_seq").alias("src")), "src").select("query", F.col("dst").alias("ingest_seq"), "src", "w")
        step = step.join(seen, ["query", "ingest_seq"], "left_anti")
        step = first_discoverer(step, ["query", "ingest_seq"], ["src", F.desc("w")]).select("query", "ingest_seq", F.lit(hop).alias("hop"), F.col("w").alias("link"))
        out = step if out is None else out.unionByName(step)
        at = step.select("query", "ingest_seq")
        seen = seen.unionByName(at)
    return out


def bridges(pairs: DataFrame, edges: DataFrame, now: int, least: float, max_edges: int = 4, cfg: Config = DEFAULT) -> DataFrame:
    """Shortest paths of at most ``max_edges`` edges between the pairs ``pair, start, goal``: ``pair, path``.

    Paths between direct neighbours are no bridge. Of several shortest paths the smallest is kept.
    """
    live = live_edges(edges, now, least, cfg).select("src", "dst")
    level = pairs.select("pair", "goal", F.col("start").alias("at"), F.array("start").alias("path"))
    seen = level.select("pair", F.col("at").alias("dst"))
    found = None
    for _ in range(max_edges):
        step = level.join(live, F.col("at") == F.col("src")).select("pair", "goal", "dst", F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, ["pair", "dst"], "left_anti").groupBy("pair", "goal", "dst").agg(F.min("path").alias("path"))
        found = step if found is None else found.unionByName(step)
        level = step.where("dst <> goal").select("pair", "goal", F.col("dst").alias("at"), "path")
        seen = seen.unionByName(step.select("pair", "dst"))
    return found.where("dst = goal").where(F.size("path") > 2).select("pair", "path")


def strongest(seeds: DataFrame, edges: DataFrame, least: float) -> DataFrame:
    """Neighbours of all seeds over links in either direction, with the highest strength of each."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight").unionAll(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "weight"))
    near = both.join(seeds.select(F.col("ingest_seq").alias("a")).distinct(), "a", "left_semi").where(F.col("weight") >= least)
    near = near.groupBy(F.col("b").alias("ingest_seq")).agg(F.max("weight").alias("strength"))
    return near.join(seeds.select("ingest_seq"), "ingest_seq", "left_anti")
