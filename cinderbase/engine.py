"""The engine's public face: a store of versioned snapshots with the operations of an agent's memory.

Every operation takes ``now`` (microseconds since 1970). Reads return DataFrames and change nothing;
``commit`` of a search, and every write, makes the next snapshot version, so a transaction is the block
between two versions and a rollback is the version before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT, Config, require_count, require_non_empty
from cinderbase.functions import decay
from cinderbase.functions.text import session_root
from cinderbase.operators import mutate, similarity, statistics
from cinderbase.plans import ingest, maintain, search
from cinderbase.providers import Embedder, embed
from cinderbase.session import cut
from cinderbase.sources.store import Snapshots, filters

MEMORY_SCHEMA = (
    "ingest_seq long, id string, user_id string, content string, category string, importance double, stability double, cached double, access_count long, session_count long, "
    "created_us long, accessed_us long, vec array<float>, is_cold boolean, cold_us long, days_at_floor int, is_superseded boolean, is_stub boolean, memory_type string, until_us long, ttl_seconds int, sessions array<string>, contradicted_by long"
)
EDGE_SCHEMA = "src long, dst long, weight double, used_us long, created_us long"
QUEUE_SCHEMA = "new_id long, existing_id long, sim double"


@dataclass
class MemoryEngine:
    spark: SparkSession
    path: str
    embedder: Embedder
    config: Config = DEFAULT
    tick_every: int = 5
    #: Optional models: the order of a search's first results, and the content of a summary from its contents.
    ranker: search.Ranker | None = None
    compress: Callable[[list[str]], str] | None = None

    def __post_init__(self) -> None:
        self._memories, self._edges, self._queue = (Snapshots(self.spark, f"{self.path}/{n}") for n in ("memories", "edges", "conflicts"))
        for snap, schema in ((self._memories, MEMORY_SCHEMA), (self._edges, EDGE_SCHEMA), (self._queue, QUEUE_SCHEMA)):
            if snap.version() == 0:
                snap.commit(self.spark.createDataFrame([], schema))
        self._ingestions = 0

    # --- reads ---
    def memories(self) -> DataFrame:
        return self._memories.read()

    def edges(self) -> DataFrame:
        return self._edges.read()

    def conflicts(self) -> DataFrame:
        return self._queue.read()

    def get(self, ids: list[str]) -> DataFrame:
        return self.memories().where(F.col("id").isin(*ids))

    def query_memories(self, limit: int = 100, offset: int = 0, **where) -> DataFrame:
        require_count("limit", limit)
        require_count("offset", offset)
        return self.memories().where(filters(**where)).orderBy(F.desc("created_us"), "ingest_seq").offset(offset).limit(limit)

    def get_stats(self, now: int) -> DataFrame:
        return statistics.stats(self.memories(), now, self.config)

    def _query(self, text: str) -> DataFrame:
        require_non_empty("query", text)
        return self.spark.createDataFrame([(0, [float(x) for x in self.embedder.embed_batch([text])[0]])], "query long, qvec array<float>")

    def search(self, text: str, now: int, top_k: int = 10, deep_recall: bool = False, user: str | None = None, session: str | None = None) -> search.SearchResult:
        mem = self.memories() if user is None else self.memories().where(F.col("user_id") == user)
        return search.search(mem, self.edges(), self._query(text), now, top_k, deep=deep_recall, text=text if self.config.hybrid_search or self.config.rerank_enabled else None, cfg=self.config, ranker=self.ranker, session=session)

    def retrieve(self, text: str, now: int, limit: int = 10) -> DataFrame:
        return search.retrieve(self.memories(), self.edges(), self._query(text), now, limit, self.config)

    # --- writes ---
    def commit(self, found: search.SearchResult, now: int) -> None:
        """Apply what a search changes: boosts, revivals, promotions, links of what was found together."""
        self._memories.commit(mutate.apply_delta(self.memories(), found.memory_delta, nulls=("cold_us",)))
        both = found.edge_delta.select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        both = both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        self._put_edges(both, now)

    def _put_edges(self, new: DataFrame, now: int) -> None:
        new = new.groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumns({"used_us": F.lit(now), "created_us": F.lit(now)})
        old = self.edges()
        kept = old.join(new.select("src", "dst"), ["src", "dst"], "left_anti")
        born = old.select("src", "dst", F.col("created_us").alias("born"))
        new = new.join(born, ["src", "dst"], "left").select("src", "dst", "weight", "used_us", F.coalesce("born", "created_us").alias("created_us"))
        self._edges.commit(kept.unionByName(new))

    def add(self, rows: DataFrame, now: int) -> None:
        """Add memories of ``content`` and any further columns; what is missing gets its default.

        A ``session_id`` begins the row's set of sessions. Near rows that share no session root are queued as conflicts.
        """
        old = self.memories()
        first = (old.agg(F.max("ingest_seq")).first()[0] or 0) + 1
        have = set(rows.columns)
        col = lambda name, default: F.coalesce(F.col(name), default) if name in have else default
        importance = col("importance", F.lit(self.config.default_importance))
        # row numbers without one sorted partition: the partition's number and the place in it; written once, so that a retry gives the same
        new = cut(rows.withColumn("ingest_seq", F.lit(first) + F.monotonically_increasing_id()))
        new = new.select(
            "ingest_seq", col("id", F.concat(F.lit("m"), F.col("ingest_seq").cast("string"))).alias("id"), col("user_id", F.lit("default")).alias("user_id"), "content",
            col("category", F.lit("episodic")).alias("category"), importance.alias("importance"), col("stability", 0.1 + 0.3 * importance).alias("stability"), F.lit(1.0).alias("cached"),
            F.lit(0).cast("long").alias("access_count"), F.lit(0).cast("long").alias("session_count"), F.lit(now).alias("created_us"), F.lit(None).cast("long").alias("accessed_us"),
            (F.col("vec") if "vec" in have else embed(F.col("content"), self.embedder)).alias("vec"), F.lit(False).alias("is_cold"), F.lit(None).cast("long").alias("cold_us"), F.lit(0).alias("days_at_floor"),
            F.lit(False).alias("is_superseded"), F.lit(False).alias("is_stub"), col("memory_type", F.lit("other")).alias("memory_type"),
            col("until_us", F.lit(None).cast("long")).alias("until_us"), col("ttl_seconds", F.lit(None).cast("int")).alias("ttl_seconds"),
            (F.array_compact(F.array("session_id")) if "session_id" in have else F.array().cast("array<string>")).alias("sessions"), F.lit(None).cast("long").alias("contradicted_by"),
        ).withColumn("session_count", F.size("sessions").cast("long")).select(*old.columns)
        self._memories.commit(mutate.create(old, new))
        added = self.memories().where(F.col("ingest_seq") >= first)
        side = lambda d: d.where("vec IS NOT NULL AND NOT is_stub").select(F.col("ingest_seq").alias("id"), "vec")
        near = similarity.top_k(side(added), side(self.memories()), 5, strictly_earlier=True)
        roots = self.memories().select("ingest_seq", F.explode("sessions").alias("s")).select("ingest_seq", session_root(F.col("s")).alias("root"))
        queue, mild = maintain.tag_conflicts(near, roots, self.config)
        self._queue.commit(self.conflicts().unionByName(queue))
        mild = mild.select(F.col("id").alias("ingest_seq"), F.col("times").alias("n"))
        up = self.memories().join(mild, "ingest_seq").select("ingest_seq", F.least(F.lit(1.0), F.col("stability") + 0.05 * F.col("n")).alias("stability"))
        self._memories.commit(mutate.apply_delta(self.memories(), up))

    def extract_and_store(self, conversations: DataFrame, now: int, complete: Callable[[str], str] | None = None) -> None:
        """Store conversations ``conv_id, conversation_text`` raw, by an extraction model, or both; link each batch; tick now and then."""
        parts = []
        if self.config.extraction_mode in ("raw", "hybrid"):
            parts.append(ingest.raw_memories(conversations).select("conv_id", "content", "category", "importance", "stability"))
        if self.config.extraction_mode in ("semantic", "hybrid"):
            if complete is None:
                raise ValueError("semantic extraction needs a model")
            asked = conversations.select("conv_id", ingest.extraction_prompt(F.col("conversation_text"), self.config.custom_extraction_instructions).alias("prompt"))
            replies = ingest.extract(asked, complete, "prompt")
            built = ingest.build(replies.select("conv_id", "reply"), F.col("reply")).withColumn("until_us", F.unix_micros("valid_until"))
            parts.append(built.select("conv_id", "content", "category", "importance", "stability", "memory_type", "until_us", "ttl_seconds"))
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
        if "session_id" in conversations.columns:
            rows = rows.join(conversations.select("conv_id", "session_id").dropDuplicates(["conv_id"]), "conv_id", "left")
        rows = rows.withColumn("id", F.concat_ws("-", F.lit("c"), F.col("conv_id").cast("string"), F.md5("content")))
        self.add(rows.dropDuplicates(["id"]), now)
        stored = self.memories().where(F.col("id").startswith("c-")).select(F.col("ingest_seq").alias("id"), "vec", F.split("id", "-")[1].alias("conv")).where("vec IS NOT NULL")
        stored = stored.join(conversations.select(F.col("conv_id").cast("string").alias("conv")).distinct(), "conv", "left_semi")
        links = ingest.batch_links(stored, "conv", self.config).select(F.col("a").alias("src"), F.col("b").alias("dst"), "weight")
        self._put_edges(links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), now)
        self._ingestions += 1
        if self.config.run_maintenance_during_ingestion and self._ingestions % self.tick_every == 0:
            self.tick(now)

    def update(self, delta: DataFrame) -> None:
        """Change columns of rows by ``ingest_seq``; a new content is embedded anew; id and creation time stay."""
        if "content" in delta.columns and "vec" not in delta.columns:
            delta = delta.withColumn("vec", embed(F.col("content"), self.embedder))
        self._memories.commit(mutate.apply_delta(self.memories(), delta.drop("id", "created_us")))

    def delete(self, ids: DataFrame) -> None:
        self._memories.commit(mutate.delete(self.memories(), ids))

    def link(self, pairs: DataFrame, now: int) -> None:
        """Create or strengthen links ``a, b, strength`` in both directions."""
        old = self.edges().select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.col("weight").alias("strength"))
        old = old.join(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_semi")
        new = mutate.upsert_links(old, pairs).select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("strength").alias("weight"))
        self._put_edges(new.unionByName(new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")), now)

    def refresh_retention(self, now: int) -> None:
        self._memories.commit(self.memories().withColumn("cached", decay.retention(now, self.config)))

    def consolidate(self, now: int) -> DataFrame:
        """Summaries replace groups of fading rows; very faded rows go. Returns the report: ``action, category, seed, ingest_seq``."""
        self.refresh_retention(now)
        report = cut(maintain.report_rows(self.memories(), now, self.config))
        self._compress(now)
        idle = decay.days_between(now, F.coalesce("accessed_us", "created_us"))
        gone = (decay.retention(now, self.config) < 0.05) & (idle > 30) & ~F.col("is_superseded") & ~F.col("is_stub")
        self._memories.commit(self.memories().where(~gone))
        return report

    def _compress(self, now: int) -> None:
        m = self.memories()
        summaries, delta, links = maintain.consolidate(m, now, self.config, self.compress)
        first = (m.agg(F.max("ingest_seq")).first()[0] or 0) + 1
        made = summaries.select("id", "content", "category", "importance", "stability", "access_count", "created_us", "accessed_us", embed(F.col("content"), self.embedder).alias("vec"))
        made = cut(made.withColumn("ingest_seq", F.lit(first) + F.monotonically_increasing_id()))
        filled = {"user_id": F.lit("default"), "cached": F.lit(1.0), "session_count": F.lit(0).cast("long"), "is_cold": F.lit(False), "cold_us": F.lit(None).cast("long"), "days_at_floor": F.lit(0), "is_superseded": F.lit(False),
                  "is_stub": F.lit(False), "memory_type": F.lit("other"), "until_us": F.lit(None).cast("long"), "ttl_seconds": F.lit(None).cast("int"), "sessions": F.array().cast("array<string>"), "contradicted_by": F.lit(None).cast("long")}
        self._memories.commit(mutate.create(mutate.apply_delta(m, delta), made.withColumns(filled).select(*m.columns)))
        seqs = self.memories().select(F.col("id").alias("sid"), F.col("ingest_seq").alias("seq"))
        self._put_edges(links.join(seqs, F.col("src") == F.col("sid")).select(F.col("seq").alias("src"), "dst", "weight"), now)

    def tick(self, now: int, verdict: Column | None = None, most: int = 50) -> None:
        """Conflicts (if a verdict is given), cold migration, expiry, consolidation."""
        if verdict is not None:
            queue = self.conflicts().orderBy(F.desc("sim"), "new_id", "existing_id")
            changed = maintain.resolve_conflicts(queue, self.memories(), verdict, most)
            self._memories.commit(mutate.apply_delta(self.memories(), changed))
            self._queue.commit(self.conflicts().join(queue.limit(most), ["new_id", "existing_id", "sim"], "left_anti"))
        self._memories.commit(mutate.expire_cold(mutate.migrate_cold(self.memories(), now, self.config), now, self.config))
        self._compress(now)

    def clear(self) -> None:
        """Empty the memories and links; the conflict queue stays, and pairs of missing rows are passed over later."""
        self._memories.commit(self.memories().limit(0))
        self._edges.commit(self.edges().limit(0))
