"""Maintenance: conflicts, tier migration, expiry, consolidation, and the tick that chains them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config
from cinderbase.functions import decay, vector
from cinderbase.operators import mutate, similarity
from cinderbase.session import cut, ship
from cinderbase.sources.store import hot


def fading(m: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    kept = decay.retention(now, cfg)
    return m.where(hot() & ~F.col("is_superseded") & (F.col("category") != "core")).withColumn("retention", kept).where(F.col("retention") < cfg.consolidation_retention_threshold)


def fading_links(m: DataFrame, now: int, min_sim: float, cfg: Config = DEFAULT) -> DataFrame:
    """Per fading row the number of rows of its category that are similar, and the smallest of them and itself."""
    rows = fading(m, now, cfg).where("vec IS NOT NULL").select(F.col("category").alias("grp"), F.col("ingest_seq").alias("id"), "vec", F.col("ingest_seq").alias("label"))
    return similarity.links(rows, min_sim).select(F.col("grp").alias("category"), F.col("id").alias("ingest_seq"), "n_links", "least_label")


def components(rows: DataFrame, min_sim: float) -> DataFrame:
    """The connected component of each row of ``grp, id, vec`` within its group: ``grp, id, vec, label``.

    Rows are compared once; what is kept is a spanning forest of each pair of blocks, along which labels are propagated.
    """
    rows = cut(rows)
    one = similarity.spanning_edges(rows, min_sim)
    edges = cut(one.unionByName(one.select("grp", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(rows.select("grp", "id", F.col("id").alias("label")))
    while True:
        low = edges.join(labels.select("grp", F.col("id").alias("b"), F.col("label").alias("other")), ["grp", "b"]).groupBy("grp", F.col("a").alias("id")).agg(F.min("other").alias("other"))
        new = cut(labels.join(low, ["grp", "id"], "left").select("grp", "id", F.least("label", F.coalesce("other", "label")).alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return rows.join(labels, ["grp", "id"])


def _greedy(size: int, min_sim: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def one(pdf: pd.DataFrame) -> list[tuple]:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        x = np.stack([np.asarray(v, np.float64) for v in pdf["vec"]])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        ids, used, out = pdf["id"].to_numpy(), np.zeros(len(pdf), bool), []
        for i in range(len(ids)):
            if used[i]:
                continue
            near = np.flatnonzero((np.round(x @ x[i], 6) >= min_sim) & ~used)
            members = [i, *[j for j in near if j != i][: size - 1]]
            if len(members) == size:
                used[members] = True
                out.extend((pdf["grp"][0], int(ids[i]), int(ids[j]), k) for k, j in enumerate(members))
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [row for _, part in pdf.groupby(["grp", "label"], sort=False) for row in one(part)]
        return pd.DataFrame(rows, columns=["category", "seed", "ingest_seq", "place"])

    return run


#: Rows for each bucket of components that are solved in one call.
BUCKET_ROWS = 20_000


def greedy_groups(m: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """Groups of similar fading rows in insertion order: ``category, seed, ingest_seq, place``.

    A seed only ever takes rows similar to it, so connected components are independent: each is solved by
    itself, many small ones in one call, and categories as a whole never are. Components smaller than a group are passed over.
    """
    ship(m.sparkSession)
    rows = fading(m, now, cfg).where("vec IS NOT NULL").select(F.col("category").alias("grp"), F.col("ingest_seq").alias("id"), "vec")
    parts = components(rows, cfg.consolidation_similarity_threshold)
    large = cut(parts.groupBy("grp", "label").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.consolidation_group_size))
    buckets = max(8, (large.agg(F.sum("n")).first()[0] or 0) // BUCKET_ROWS)
    parts = parts.join(large.drop("n"), ["grp", "label"], "left_semi").withColumn("bucket", F.pmod(F.xxhash64("grp", "label"), F.lit(buckets)))
    return parts.groupBy("bucket").applyInPandas(_greedy(cfg.consolidation_group_size, cfg.consolidation_similarity_threshold), "category string, seed long, ingest_seq long, place int")


def consolidate(m: DataFrame, now: int, cfg: Config = DEFAULT, compress: Callable[[list[str]], str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summaries of the groups, the delta of their originals (superseded, cold) and the summaries' links.

    ``compress`` makes a summary's content from the contents of its group (of ``consolidation_group_size``); by default they are joined.
    """
    groups = cut(greedy_groups(m, now, cfg))
    rows = groups.join(m.drop("category"), "ingest_seq")
    summaries = rows.groupBy("category", "seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda t: F.coalesce(t["content"], F.lit(""))).alias("content"),
        F.max("importance").alias("importance"), F.avg("stability").alias("stability"), F.max("access_count").alias("access_count"),
    )
    if compress is None:
        joined = F.concat(F.lit("Summary: "), F.array_join("content", " | "))
    else:
        joined = F.pandas_udf(lambda groups: groups.map(lambda g: compress(list(g))), "string")(F.col("content"))
    summaries = cut(summaries.withColumn("content", joined))
    summaries = summaries.withColumns({"id": F.concat(F.lit("summary-"), F.md5(F.concat_ws(":", "category", "seed"))), "created_us": F.lit(now), "accessed_us": F.lit(now), "vec": vector.hash_embed(F.col("content"), 64).cast("array<float>")})
    delta = groups.select("ingest_seq", F.lit(True).alias("is_superseded"), F.lit(True).alias("is_cold"), F.lit(now).alias("cold_us"))
    links = groups.join(summaries.select("category", "seed", "id"), ["category", "seed"]).select(F.col("id").alias("src"), F.col("ingest_seq").alias("dst"), F.lit(0.8).alias("weight"))
    return summaries, delta, links


def report(m: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """One row per category: groups, compressed rows, rows to promote, very faded rows to delete."""
    groups = greedy_groups(m, now, cfg).groupBy("category").agg(F.countDistinct("seed").alias("n_groups"), F.count("*").alias("n_compressed"))
    kept = decay.retention(now, cfg)
    idle = decay.days_between(now, F.coalesce("accessed_us", "created_us"))
    other = m.groupBy("category").agg(F.count_if(decay.promotable(cfg)).alias("n_promotable"), F.count_if((kept < 0.05) & (idle > 30) & ~F.col("is_superseded") & ~F.col("is_stub")).alias("n_very_faded"))
    return other.join(groups, "category", "left").select("category", F.coalesce("n_groups", F.lit(0)).alias("n_groups"), F.coalesce("n_compressed", F.lit(0)).alias("n_compressed"), "n_promotable", "n_very_faded")


def report_rows(m: DataFrame, now: int, cfg: Config = DEFAULT) -> DataFrame:
    """The report with its lists: ``action, category, seed, ingest_seq`` for rows that are compressed (by their group's seed), promotable, or deleted as very faded."""
    compressed = greedy_groups(m, now, cfg).select(F.lit("compress").alias("action"), "category", "seed", "ingest_seq")
    kept, idle = decay.retention(now, cfg), decay.days_between(now, F.coalesce("accessed_us", "created_us"))
    none = F.lit(None).cast("long").alias("seed")
    promoted = m.where(decay.promotable(cfg)).select(F.lit("promote").alias("action"), "category", none, "ingest_seq")
    gone = m.where((kept < 0.05) & (idle > 30) & ~F.col("is_superseded") & ~F.col("is_stub")).select(F.lit("delete").alias("action"), "category", none, "ingest_seq")
    return compressed.unionByName(promoted).unionByName(gone)


def tag_conflicts(near: DataFrame, roots: DataFrame, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Of near pairs ``query, id, sim``: the conflict queue, and the rows reinforced with how often.

    ``roots`` holds the session roots of each row, one per line. A pair above the conflict threshold
    that shares one is neither queued nor reinforced.
    """
    high = near.where(F.col("sim") > cfg.conflict_threshold)
    mine = roots.select(F.col("ingest_seq").alias("query"), "root").distinct()
    theirs = roots.select(F.col("ingest_seq").alias("id"), "root").distinct()
    shared = high.select("query", "id").join(mine, "query").join(theirs, ["id", "root"], "left_semi").select("query", "id").distinct()
    queue = high.join(shared, ["query", "id"], "left_anti").select(F.col("query").alias("new_id"), F.col("id").alias("existing_id"), "sim")
    mild = near.where((F.col("sim") > cfg.reinforcement_threshold) & (F.col("sim") <= cfg.conflict_threshold))
    return queue, mild.groupBy("id").agg(F.count("*").alias("times"))


def judged(queue: DataFrame, m: DataFrame, verdict: Column, most: int = 50) -> DataFrame:
    """The most similar pairs whose rows exist and are not superseded, with their verdict over ``new_*`` and ``old_*``."""
    first = queue.orderBy(F.desc("sim"), "new_id", "existing_id").limit(most)
    side = lambda p, key: m.select(F.col("ingest_seq").alias(key), *[F.col(c).alias(f"{p}_{c}") for c in ("content", "category", "importance", "is_superseded")])
    rows = first.join(side("new", "new_id"), "new_id").join(side("old", "existing_id"), "existing_id")
    return rows.withColumn("verdict", verdict).where("NOT new_is_superseded AND NOT old_is_superseded")


def resolve_conflicts(queue: DataFrame, m: DataFrame, verdict: Column, most: int = 50) -> DataFrame:
    """Resolve the most similar pairs: ``ingest_seq, category, importance, contradicted_by`` of the rows that change.

    The verdict is a column over ``new_*`` and ``old_*``. Pairs of missing or superseded rows are
    passed over. At most ``most`` pairs are resolved, by a fold on the driver, because a later pair sees
    what an earlier one changed.
    """
    rows = judged(queue, m, verdict, most)
    state: dict[int, dict] = {}
    for r in rows.orderBy(F.desc("sim"), "new_id", "existing_id").collect():  # at most ``most`` rows
        if r["verdict"] not in ("CONTRADICTION", "UPDATE"):
            continue
        new = state.setdefault(r["new_id"], {"category": r["new_category"], "importance": r["new_importance"], "by": None})
        old = state.setdefault(r["existing_id"], {"category": r["old_category"], "importance": r["old_importance"], "by": None})
        was_core = old["category"] == "core"
        old["category"] = "semantic" if was_core else old["category"]
        old["by"] = r["new_id"]
        new["importance"] = max(new["importance"], old["importance"])
        if r["verdict"] == "CONTRADICTION" and was_core:
            new["category"] = "core"
    changed = [(k, v["category"], float(v["importance"]), v["by"]) for k, v in sorted(state.items())]
    return m.sparkSession.createDataFrame(changed, "ingest_seq long, category string, importance double, contradicted_by long")


def tick(m: DataFrame, now: int, cfg: Config = DEFAULT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cold migration, expiry, consolidation, in this order: the next snapshot, the summaries and their links."""
    moved = cut(mutate.expire_cold(mutate.migrate_cold(m, now, cfg), now, cfg))
    summaries, delta, links = consolidate(moved, now, cfg)
    return mutate.apply_delta(moved, delta), summaries, links


def replay_boosts(log: DataFrame, m: DataFrame, boost: float = 0.1, cap: float = 2.0, interval: float = 7.0) -> DataFrame:
    """Stability after all accesses of a log. Increments are never negative, so the capped sum equals the stepwise cap.

    Gaps need the order of one memory's accesses; AQE cannot split a window, so a hot memory's log is
    first cut into days and only the ends of the days are chained.
    """
    us = F.unix_micros("ts")
    log = log.where("memory_seq IS NOT NULL AND ts IS NOT NULL").select("memory_seq", us.alias("us")).distinct()
    log = log.withColumn("day", F.floor(F.col("us") / F.lit(decay.DAY_US)))
    gain = lambda a, b: F.lit(boost) * F.least(F.lit(cap), F.greatest(F.lit(0.0), (b - a) / F.lit(decay.DAY_US)) / interval)
    inside = log.withColumn("prev", F.lag("us").over(Window.partitionBy("memory_seq", "day").orderBy("us")))
    days = inside.groupBy("memory_seq", "day").agg(F.sum(F.coalesce(gain(F.col("prev"), F.col("us")), F.lit(0.0))).alias("gain"), F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"))
    chained = days.withColumn("before", F.lag("last").over(Window.partitionBy("memory_seq").orderBy("day")))
    total = chained.groupBy("memory_seq").agg(F.sum(F.col("gain") + F.coalesce(gain(F.col("before"), F.col("first")), F.lit(0.0))).alias("gain"), F.sum("n").alias("n_accesses"))
    return total.join(m.select(F.col("ingest_seq").alias("memory_seq"), "stability"), "memory_seq").select("memory_seq", "n_accesses", F.round(F.least(F.lit(1.0), F.col("stability") + F.col("gain")), 6).alias("stability"))
