"""Retrieval: a scan by similarity, scores by retention, validity, associations, and the deltas a search causes.

A search takes a batch of queries (``query, qvec``; the batch is stated by the caller and of a checked
size). Its direct results, k rows a query, are written once, since all later steps start from them. Reads
never mutate: ``SearchResult`` holds the results and the two deltas, and a commit is a separate step.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay, vector
from cinderbase.operators import graph, lexical, similarity
from cinderbase.session import cut, small_enough
from cinderbase.sources.store import cold, hot

#: Bytes of one query row when it is sent to the executors.
QUERY_BYTES = 1024
#: Most queries that are scanned by expressions; more are multiplied in blocks.
SCANNED = 64


def eligible(deep: bool = False, include_cold: bool = False) -> Column:
    """Rows a search may find: a vector, no stub, hot, and not superseded unless it is a deep recall."""
    tier = (hot() | cold()) if deep and include_cold else hot()
    out = F.col("vec").isNotNull() & tier
    return out if deep else out & ~F.col("is_superseded")


def top_by_query(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows per query with their rank; Spark limits them before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def similar(memories: DataFrame, queries: DataFrame, k: int, cond: Column) -> DataFrame:
    """The k most similar rows per query: ``query, ingest_seq, sim, rank``."""
    asking = queries.count()
    if not small_enough(asking, QUERY_BYTES):
        raise ValueError("too many queries for one scan; use operators.similarity.top_k, which works in blocks")
    if asking > SCANNED:
        found = similarity.top_k(queries.select(F.col("query").alias("id"), F.col("qvec").alias("vec")), memories.where(cond).select(F.col("ingest_seq").alias("id"), "vec"), k, itself=True)
        return found.select("query", F.col("id").alias("ingest_seq"), "sim", "rank")
    # each norm is taken once, below the join; a pair then costs one dot product
    base = memories.where(cond).select("ingest_seq", "vec", vector.norm(F.col("vec")).alias("n"))
    asked = queries.select("query", "qvec", vector.norm(F.col("qvec")).alias("qn"))
    n = F.col("n") * F.col("qn")
    sim = F.when(n == 0, F.lit(0.0)).otherwise(vector.dot(F.col("qvec"), F.col("vec")) / n)
    sims = base.crossJoin(F.broadcast(asked)).select("query", "ingest_seq", F.round(sim, 6).alias("sim"))
    return top_by_query(sims, [F.desc("sim"), "ingest_seq"], k)


def valid(scored: DataFrame, now: int, deep: bool, cfg: Config = DEFAULT) -> DataFrame:
    """Expired rows are dropped, or kept with a penalty and marked in a deep recall."""
    late = decay.expired(now)
    if not cfg.filter_expired_transients:
        return scored
    if deep and cfg.include_expired_in_deep_recall:
        return scored.withColumn("late", late).withColumns({"score": F.when(F.col("late"), F.col("score") * cfg.deep_recall_penalty).otherwise(F.col("score")), "deep": F.col("deep") | F.col("late")}).drop("late")
    return scored.where(~late)


def scored(candidates: DataFrame, memories: DataFrame, now: int, deep: bool, cfg: Config = DEFAULT) -> DataFrame:
    rows = candidates.select("query", "ingest_seq", "sim").join(memories, "ingest_seq")
    kept = decay.retention(now, cfg)
    rows = rows.withColumns({"retention": kept, "score": decay.score(F.col("sim"), kept, cfg), "deep": F.lit(False)})
    if deep:
        rows = rows.withColumns({"score": F.when(F.col("is_superseded"), F.col("score") * cfg.deep_recall_penalty).otherwise(F.col("score")), "deep": F.col("is_superseded")})
    return valid(rows, now, deep, cfg)


@dataclass
class SearchResult:
    results: DataFrame
    memory_delta: DataFrame
    edge_delta: DataFrame
    direct: DataFrame
    candidates: DataFrame
    #: Evidence chains between the first three direct results: ``query, pair, path``; none without ``bridge_discovery``.
    bridges: DataFrame | None = None
    scored: DataFrame | None = None

    def trace(self) -> DataFrame:
        """Rows of each stage per query: ``query, stage, n``."""
        c = self.candidates
        stages = [(c.where("rank IS NOT NULL"), "vector_search"), (c.where("rank IS NULL"), "lexical_search"), (self.scored, "scoring"), (self.direct, "direct"), (self.results, "results")]
        parts = [d.groupBy("query").agg(F.count("*").alias("n")).select("query", F.lit(name).alias("stage"), "n") for d, name in stages]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out


#: A ranker takes a query's text and contents, and gives their places in the wanted order.
Ranker = Callable[[str, list[str]], list[int]]


def search(memories: DataFrame, edges: DataFrame, queries: DataFrame, now: int, k: int = 10, deep: bool = False, include_cold: bool = False,
           text: str | None = None, cfg: Config = DEFAULT, ranker: Ranker | None = None, session: str | None = None) -> SearchResult:
    candidates = similar(memories, queries, 3 * k, eligible(deep, include_cold))
    if text is not None:
        words = lexical.bm25(memories.where(hot() & (F.lit(deep) | ~F.col("is_superseded"))), text, cfg.k_sparse)
        extra = words.select("ingest_seq").crossJoin(F.broadcast(queries)).join(candidates.select("query", "ingest_seq"), ["query", "ingest_seq"], "left_anti")
        extra = extra.join(memories.select("ingest_seq", "vec"), "ingest_seq")
        sim = F.coalesce(F.round(vector.cosine(F.col("qvec"), F.col("vec")), 6), F.lit(0.1))
        candidates = candidates.unionByName(extra.select("query", "ingest_seq", sim.alias("sim")), allowMissingColumns=True)
    rows = scored(candidates, memories, now, deep, cfg).withColumn("score", F.round("score", 6))
    order = [F.desc("score"), "ingest_seq"]
    if cfg.rerank_enabled and ranker is not None:
        rows = reranked(rows, order, ranker, text or "", cfg.k_rerank)
        order = ["place"]
    direct = cut(top_by_query(rows, order, k).select("query", "ingest_seq", "sim", "retention", "score", "deep", "rank"))
    linked = graph.expand(direct, edges, memories, now, cfg)
    if cfg.graph_expansion_hops > 0 and cfg.min_bridge_edge_weight < cfg.association_retrieval_threshold:
        # over heavier edges the expansion above has seen all that a walk could discover
        seen = direct.select("query", "ingest_seq").unionByName(linked.select("query", "ingest_seq"))
        linked = linked.unionByName(graph.discover(direct, seen, edges, memories, now, cfg))
    linked = linked.join(memories, "ingest_seq").join(F.broadcast(queries), "query")
    sim = F.coalesce(F.round(vector.cosine(F.col("qvec"), F.col("vec")), 6), F.lit(0.1))
    linked = linked.withColumns({"sim": sim, "retention": decay.retention(now, cfg)})
    linked = linked.withColumn("score", F.round(decay.score(F.col("sim"), F.col("retention"), cfg) * F.col("link"), 6))
    cols = ["query", "ingest_seq", "sim", "retention", "score"]
    every = direct.select(*cols, "deep", F.lit(False).alias("associative")).unionByName(linked.select(*cols, F.lit(False).alias("deep"), F.lit(True).alias("associative")))
    results = top_by_query(every, [F.desc("score"), "associative", "ingest_seq"], k)
    chains = evidence(direct, edges, now, cfg) if cfg.bridge_discovery else None
    return SearchResult(results, boosts(every, memories, now, cfg, session), co_retrieved(direct, edges, now, cfg), direct, candidates, chains, rows)


def reranked(rows: DataFrame, order: list, ranker: Ranker, text: str, k: int) -> DataFrame:
    """Rows with their ``place`` per query: the first k as the ranker puts them, places it leaves out after them, then the rest."""

    @F.pandas_udf("array<int>")
    def ask(contents: pd.Series) -> pd.Series:
        def one(found: list) -> list[int]:
            places = [i for i in dict.fromkeys(ranker(text, list(found))) if 0 <= i < len(found)]
            return [*places, *(i for i in range(len(found)) if i not in set(places))]

        return contents.map(lambda c: one([x or "" for x in c]))

    rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
    asked = rows.where(F.col("_rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_rank", "content"))).alias("c"))  # at most k of a query
    asked = asked.select("query", F.posexplode(ask(F.transform("c", lambda t: t["content"]))).alias("place", "at")).select("query", (F.col("at") + 1).alias("_rank"), "place")
    return rows.join(asked, ["query", "_rank"], "left").withColumn("place", F.coalesce("place", F.col("_rank"))).drop("_rank")


def evidence(direct: DataFrame, edges: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Short paths between the first three direct results of a query: ``query, start, goal, path``, at most ``max_bridge_paths``."""
    first = direct.where("rank <= 3")
    other = first.select("query", F.col("ingest_seq").alias("goal"), F.col("rank").alias("rank_b"))
    pairs = first.select("query", F.col("ingest_seq").alias("start"), "rank").join(other, "query").where("rank < rank_b")  # at most three a query
    found = graph.bridges(pairs.select(F.struct("query", "rank", "rank_b", "start").alias("pair"), "start", "goal"), edges, now, cfg.min_bridge_edge_weight, cfg=cfg)
    found = found.select("pair.query", "pair.rank", "pair.rank_b", "pair.start", F.element_at("path", -1).alias("goal"), "path")
    by = Window.partitionBy("query").orderBy("rank", "rank_b")
    return found.withColumn("n", F.row_number().over(by)).where(F.col("n") <= cfg.max_bridge_paths).select("query", "start", "goal", "path")


def boosts(found: DataFrame, memories: DataFrame, now: int, cfg: Config = DEFAULT, session: str | None = None) -> DataFrame:
    """What a search changes in the rows it found: stability, accesses, sessions, tier, promotion. One row per memory, by its direct find if any."""
    hits = found.groupBy("ingest_seq").agg(F.min("associative").alias("associative"))
    rows = hits.join(memories, "ingest_seq")
    up = F.when(F.col("associative"), decay.boosted(now, cfg.associative_boost, cfg)).otherwise(decay.boosted(now, cfg.direct_boost, cfg))
    rows = rows.withColumns({"stability": up, "access_count": F.col("access_count") + F.when(F.col("associative"), 0).otherwise(1), "accessed_us": F.lit(now), "is_cold": F.lit(False), "cold_us": F.lit(None).cast("long"), "days_at_floor": F.when(F.col("is_cold"), 0).otherwise(F.col("days_at_floor"))})
    kept = []
    if "sessions" in memories.columns:
        kept = ["sessions", "session_count"]
        known = F.coalesce("sessions", F.array().cast("array<string>"))
        rows = rows.withColumn("sessions", F.array_union(known, F.array(F.lit(session))) if session is not None else known)
        rows = rows.withColumn("session_count", F.size("sessions").cast("long"))
    return rows.select("ingest_seq", "stability", "access_count", "accessed_us", "is_cold", "cold_us", "days_at_floor", *kept, F.when(decay.promotable(cfg), "core").otherwise(F.col("category")).alias("category"))


def co_retrieved(direct: DataFrame, edges: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Links between the direct results of a query, strengthened; both directions are the caller's to store."""
    other = direct.select("query", F.col("ingest_seq").alias("b"), F.col("rank").alias("rank_b"))
    pairs = direct.select("query", F.col("ingest_seq").alias("a"), "rank").join(other, "query").where("rank < rank_b")  # at most k*k per query
    pairs = pairs.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("times"))
    edges = graph.touching(edges, direct.select(F.col("ingest_seq").alias("src")))  # both ends of a pair are direct results
    old = edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.max("weight").alias("old"))
    return pairs.join(old, ["a", "b"], "left").select("a", "b", F.least(F.lit(1.0), F.coalesce("old", F.lit(0.0)) + F.col("times") * cfg.association_strengthen_amount).alias("weight"))


def retrieve(memories: DataFrame, edges: DataFrame, queries: DataFrame, now: int, limit: int = 10, cfg: Config = DEFAULT) -> DataFrame:
    """Plain retrieval: similarity times retention, plus linked rows by the better of similarity and link strength."""
    hits = similar(memories.where(F.col("cached") >= cfg.min_retention), queries, 3 * limit, eligible())
    kept = decay.retention(now, cfg)
    rows = hits.select("query", "ingest_seq", "sim").join(memories, "ingest_seq").withColumn("retention", kept).where(F.col("retention") >= cfg.min_retention)
    rows = rows.withColumn("score", F.round(F.col("sim") * F.col("retention"), 6))
    direct = top_by_query(rows, [F.desc("score"), "ingest_seq"], limit).select("query", "ingest_seq", "sim", "score")
    direct = cut(direct)
    seeds = direct.select(F.col("ingest_seq").alias("src"))
    back = edges.join(seeds.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
    both = graph.touching(edges, seeds).select("src", "dst", "weight").unionAll(back.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    near = both.join(direct.select("query", F.col("ingest_seq").alias("src")), "src").where(F.col("weight") >= cfg.association_retrieval_threshold)
    near = near.groupBy("query", F.col("dst").alias("ingest_seq")).agg(F.max("weight").alias("strength")).join(direct.select("query", "ingest_seq"), ["query", "ingest_seq"], "left_anti")
    near = near.join(memories, "ingest_seq").join(F.broadcast(queries), "query").withColumn("retention", kept).where(F.col("retention") >= cfg.min_retention)
    near = near.withColumn("sim", F.greatest(F.coalesce(F.round(vector.cosine(F.col("qvec"), F.col("vec")), 6), F.lit(0.0)), F.col("strength")))
    near = near.select("query", "ingest_seq", "sim", F.round(F.col("sim") * F.col("retention"), 6).alias("score"))
    return top_by_query(direct.unionByName(near), [F.desc("score"), "ingest_seq"], limit)


def rerank(rows: DataFrame, order: list[int], k: int) -> DataFrame:
    """Put the first k ranks in the given order (zero-based places, repeats and places beyond k ignored); the rest keeps its order."""
    places = [i for i in dict.fromkeys(order) if 0 <= i < k]
    new = F.lit(None).cast("int")
    for at, place in enumerate(places):
        new = F.when(F.col("rank") == place + 1, at).otherwise(new)
    by = Window.partitionBy("query").orderBy(F.coalesce(new, F.when(F.col("rank") <= k, k).otherwise(k + 1)), "rank")
    return rows.withColumn("new_rank", F.row_number().over(by).cast("long"))
