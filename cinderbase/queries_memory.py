"""Queries of the memory engine over the store's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from dataclasses import replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cinderbase.config import DEFAULT
from cinderbase.functions import decay, text, vector
from cinderbase.operators import changefeed, graph, lexical, mutate, similarity, statistics
from cinderbase.plans import ingest, maintain, search
from cinderbase.providers import HashEmbedder, SeededEmbedder, embed, fixed_reply
from cinderbase.queries_general import P5_SQL
from cinderbase.session import scratch, table
from cinderbase.sources import store
from cinderbase.streaming import boosts

NOW = int(datetime(2025, 6, 1, tzinfo=UTC).timestamp()) * 1_000_000
LATE = int(datetime(2026, 4, 1, tzinfo=UTC).timestamp()) * 1_000_000
WORDS = "the printer runs best with tea"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)


# --- shared SQL ----------------------------------------------------------------------------------
STORE = """store AS (
  SELECT ingest_seq, id, user_id, content, coalesce(nullif(lower(trim(category)), ''), 'episodic') AS category,
    coalesce(importance, 5e-1) AS importance, coalesce(stability, 1e-1) AS stability, retention AS cached,
    coalesce(access_count, 0)::BIGINT AS access_count, coalesce(session_count, 0)::BIGINT AS session_count,
    epoch_us(created_at) AS created_us, epoch_us(last_accessed_at) AS accessed_us,
    CASE WHEN len(embedding) = 64 AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = 64 AND len([x FOR x IN embedding IF x <> 0]) > 0
      THEN embedding::DOUBLE[] END AS vec,
    coalesce(is_cold, false) AS is_cold, epoch_us(cold_since) AS cold_us, coalesce(days_at_floor, 0) AS days_at_floor,
    coalesce(is_superseded, false) AS is_superseded, coalesce(is_stub, false) AS is_stub, coalesce(memory_type, 'other') AS memory_type,
    CASE WHEN regexp_full_match(valid_until, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z') THEN epoch_us(try_cast(valid_until AS TIMESTAMPTZ)) END AS until_us,
    ttl_seconds
  FROM memories WHERE ingest_seq IS NOT NULL AND id IS NOT NULL)"""
EDGES = """edges AS (
  SELECT src, dst, max(weight) AS weight, max(epoch_us(coalesce(last_co_retrieval, created_at))) AS used_us, min(epoch_us(created_at)) AS created_us
  FROM associations WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst GROUP BY src, dst)"""
QV = "qv AS (SELECT ingest_seq AS query, vec AS qvec FROM store WHERE vec IS NOT NULL ORDER BY ingest_seq LIMIT 3)"
QV_BATCH = "qv AS (SELECT ingest_seq AS query, vec AS qvec FROM store WHERE vec IS NOT NULL AND ingest_seq % 100 = 0)"
WITH = f"WITH {STORE} "
WITH_E = f"WITH {STORE}, {EDGES} "
COS = "round(list_cosine_similarity(qvec, vec), 6)"
FLOOR = "(CASE WHEN category = 'core' THEN 6e-1 ELSE 2e-2 END)"
HOT, COLD = "(NOT is_cold AND NOT is_stub)", "(is_cold AND NOT is_stub)"


def ret_sql(now: int, power: bool = False) -> str:
    beta = "(CASE category WHEN 'episodic' THEN 45e0 WHEN 'semantic' THEN 120e0 WHEN 'core' THEN 120e0 ELSE 45e0 END)"
    x = f"(greatest(0e0, ({now} - coalesce(accessed_us, created_us)) / 864e8) / (greatest(stability, 1e-2) * least(3e0, 1 + importance * 2) * {beta}))"
    raw = f"pow(1 + {x}, -1.4427e0)" if power else f"exp(-{x})"
    return f"(CASE WHEN is_stub THEN 0e0 WHEN coalesce(accessed_us, created_us) IS NULL THEN {FLOOR} WHEN category = 'procedural' THEN 1e0 ELSE greatest({FLOOR}, {raw}) END)"


def spaced_sql(now: int) -> str:
    return f"coalesce(least(2e0, greatest(0e0, ({now} - coalesce(accessed_us, created_us)) / 864e8) / 7e0), 1e0)"


def expired_sql(now: int) -> str:
    return f"(memory_type IN ('plan', 'transient_state') AND (coalesce({now} > until_us, false) OR coalesce({now} > created_us + ttl_seconds::BIGINT * 1000000, false)))"


def promote_sql(access: int = 10, stability: str = "85e-2", sessions: int = 3) -> str:
    return f"(access_count >= {access} AND stability >= {stability} AND session_count >= {sessions} AND category <> 'core')"


def m(spark: SparkSession, d: str) -> DataFrame:
    return store.memories(spark, d)


def query_vectors(mem: DataFrame) -> DataFrame:
    """The query vectors: those of the first three rows that have one."""
    return mem.where("vec IS NOT NULL").orderBy("ingest_seq").limit(3).select(F.col("ingest_seq").alias("query"), F.col("vec").alias("qvec"))


def query_batch(mem: DataFrame) -> DataFrame:
    """The whole query batch: the vectors of all rows whose number is divisible by 100."""
    return mem.where("vec IS NOT NULL AND ingest_seq % 100 = 0").select(F.col("ingest_seq").alias("query"), F.col("vec").alias("qvec"))


LOOSE = replace(DEFAULT, core_access_threshold=5, core_stability_threshold=0.3, core_session_threshold=3)
R6 = lambda c: F.round(c, 6)

# --- scans and filters ---------------------------------------------------------------------------
for _name, _cond, _sql in (("scan_hot", store.hot, HOT), ("scan_cold", store.cold, COLD), ("scan_active", lambda: ~F.col("is_stub"), "NOT is_stub")):
    q(_name, f"{WITH} SELECT ingest_seq, id, category FROM store WHERE {_sql}")(lambda s, d, c=_cond: m(s, d).where(c()).select("ingest_seq", "id", "category"))


@q("get_batch", f"{WITH} SELECT ingest_seq, id, content FROM store WHERE ingest_seq IN (SELECT src FROM associations)")
def get_batch(s, d):
    ids = table(s, d, "associations").select(F.col("src").alias("ingest_seq")).distinct()
    return m(s, d).join(ids, "ingest_seq", "left_semi").select("ingest_seq", "id", "content")


@q("point_get", f"{WITH} SELECT ingest_seq, id, category, CASE WHEN is_stub THEN 'stub' WHEN is_cold THEN 'cold' ELSE 'hot' END AS tier FROM store WHERE ingest_seq = 7")
def point_get(s, d):
    tier = F.when(F.col("is_stub"), "stub").when(F.col("is_cold"), "cold").otherwise("hot")
    return m(s, d).where("ingest_seq = 7").select("ingest_seq", "id", "category", tier.alias("tier"))


@q("query_memories", f"""{WITH} SELECT ingest_seq, created_us, category FROM store WHERE NOT is_stub AND NOT is_superseded AND user_id = 'u1' AND category IN ('semantic', 'episodic')
  AND cached >= 1e-1 ORDER BY created_us DESC, ingest_seq LIMIT 20 OFFSET 5""")
def query_memories(s, d):
    cond = store.filters(user="u1", categories=("semantic", "episodic"), min_retention=0.1)
    return m(s, d).where(cond).select("ingest_seq", "created_us", "category").orderBy(F.desc("created_us"), "ingest_seq").offset(5).limit(20)


@q("filter_builder", f"""{WITH} SELECT ingest_seq FROM store WHERE NOT is_stub AND NOT is_superseded AND category IN ('semantic', 'core') AND cached >= 2e-1
  AND importance >= 3e-1 AND created_us >= {NOW - 500 * 86_400_000_000} AND created_us <= {NOW}""")
def filter_builder(s, d):
    cond = store.filters(categories=("semantic", "core"), min_retention=0.2, min_importance=0.3, created_after=NOW - 500 * 86_400_000_000, created_before=NOW)
    return m(s, d).where(cond).select("ingest_seq")


@q("search_eligible", f"{WITH} SELECT ingest_seq FROM store WHERE vec IS NOT NULL AND NOT is_superseded AND {HOT}")
def search_eligible(s, d):
    return m(s, d).where(search.eligible()).select("ingest_seq")


@q("search_eligible_deep", f"{WITH} SELECT ingest_seq, is_superseded FROM store WHERE vec IS NOT NULL AND NOT is_stub")
def search_eligible_deep(s, d):
    return m(s, d).where(search.eligible(deep=True, include_cold=True)).select("ingest_seq", "is_superseded")


@q("is_expired", f"{WITH} SELECT ingest_seq, {expired_sql(NOW)} AS expired FROM store")
def is_expired(s, d):
    return m(s, d).select("ingest_seq", decay.expired(NOW).alias("expired"))


@q("validity_filter", f"""{WITH} SELECT ingest_seq, round(importance * (CASE WHEN {expired_sql(NOW)} THEN 5e-1 ELSE 1e0 END), 6) AS score, {expired_sql(NOW)} AS deep FROM store""")
def validity_filter(s, d):
    rows = m(s, d).withColumns({"score": F.col("importance"), "deep": F.lit(False)})
    return search.valid(rows, NOW, deep=True).select("ingest_seq", R6("score").alias("score"), "deep")


@q("find_fading", f"{WITH} SELECT ingest_seq, category, round({ret_sql(LATE)}, 6) AS retention FROM store WHERE {HOT} AND NOT is_superseded AND category <> 'core' AND {ret_sql(LATE)} < 2e-1")
def find_fading(s, d):
    return maintain.fading(m(s, d), LATE).select("ingest_seq", "category", R6("retention").alias("retention"))


@q("find_stable", f"{WITH} SELECT ingest_seq, stability, access_count FROM store WHERE NOT is_stub AND stability >= 2e-1 AND access_count >= 5")
def find_stable(s, d):
    return m(s, d).where("NOT is_stub AND stability >= 0.2 AND access_count >= 5").select("ingest_seq", "stability", "access_count")


@q("faint", f"{WITH} SELECT ingest_seq, {ret_sql(NOW)} < 15e-2 AS faint_by_retention, stability < 3e-1 AND category <> 'core' AS faint_by_stability FROM store WHERE NOT is_stub")
def faint(s, d):
    return m(s, d).where("NOT is_stub").select("ingest_seq", (decay.retention(NOW) < 0.15).alias("faint_by_retention"), ((F.col("stability") < 0.3) & (F.col("category") != "core")).alias("faint_by_stability"))


@q("core_promotion", f"{WITH} SELECT ingest_seq, CASE WHEN {promote_sql(5, '3e-1', 3)} THEN 'core' ELSE category END AS category FROM store")
def core_promotion(s, d):
    return m(s, d).select("ingest_seq", F.when(decay.promotable(LOOSE), "core").otherwise(F.col("category")).alias("category"))


@q("at_floor", f"{WITH} SELECT ingest_seq FROM store WHERE abs({ret_sql(LATE)} - {FLOOR}) < 1e-3")
def at_floor(s, d):
    return m(s, d).where(decay.at_floor(LATE)).select("ingest_seq")


@q("very_faded", f"{WITH} SELECT ingest_seq FROM store WHERE NOT is_superseded AND {ret_sql(LATE)} < 5e-2 AND greatest(0e0, ({LATE} - coalesce(accessed_us, created_us)) / 864e8) > 30")
def very_faded(s, d):
    idle = decay.days_between(LATE, F.coalesce("accessed_us", "created_us"))
    return m(s, d).where(~F.col("is_superseded") & (decay.retention(LATE) < 0.05) & (idle > 30)).select("ingest_seq")


@q("linked_memories", f"""{WITH_E} SELECT e.src, e.dst, e.weight FROM edges e JOIN store t ON t.ingest_seq = e.dst WHERE e.weight >= 3e-1 AND NOT t.is_stub""")
def linked_memories(s, d):
    live = m(s, d).where("NOT is_stub").select(F.col("ingest_seq").alias("dst"))
    return store.edges(s, d).where("weight >= 0.3").join(live, "dst", "left_semi").select("src", "dst", "weight")


# --- sources -------------------------------------------------------------------------------------
@q("row_decode", f"{WITH} SELECT ingest_seq, category, importance, stability, is_cold, is_stub, days_at_floor, vec IS NOT NULL AS has_vector, until_us FROM store")
def row_decode(s, d):
    return m(s, d).select("ingest_seq", "category", "importance", "stability", "is_cold", "is_stub", "days_at_floor", F.col("vec").isNotNull().alias("has_vector"), "until_us")


@q("importance_scale10", f"{WITH} SELECT ingest_seq, round(importance * 10, 6) AS stored, round(round(importance * 10, 6) / 10, 6) AS read FROM store")
def importance_scale10(s, d):
    stored = R6(F.col("importance") * 10)
    return m(s, d).select("ingest_seq", stored.alias("stored"), R6(stored / 10).alias("read"))


@q("vec_literal", """SELECT ingest_seq, '[' || array_to_string([(CASE WHEN x IS NULL OR NOT isfinite(x) THEN 0 ELSE x END)::DOUBLE::DECIMAL(18,4)::VARCHAR FOR x IN embedding], ',') || ']' AS literal
  FROM memories WHERE embedding IS NOT NULL""")
def vec_literal(s, d):
    return table(s, d, "memories").where("embedding IS NOT NULL").select("ingest_seq", vector.literal(F.col("embedding")).alias("literal"))


@q("raw_turns", r"""WITH t AS (SELECT conv_id, unnest(string_split(conversation_text, E'\n')) AS l, generate_subscripts(string_split(conversation_text, E'\n'), 1) - 1 AS line FROM conversation_text),
  u AS (SELECT conv_id, line::BIGINT AS line, regexp_replace(regexp_replace(l, '^\s+', ''), '\s+$', '') AS content FROM t)
  SELECT conv_id, line, content FROM u WHERE content <> '' AND NOT (starts_with(content, '[') AND ends_with(content, ']'))""")
def raw_turns(s, d):
    return ingest.raw_memories(table(s, d, "conversation_text")).select("conv_id", "line", "content")


_LOG_KEY = """l AS (SELECT log_line, event_no, regexp_replace(lower(event_type), '[^a-z]', '', 'g') AS k, lower(trim(memory_id)) AS id FROM memory_log),
  e AS (SELECT * FROM l WHERE k IN ('memory', 'memorydelete') AND id IS NOT NULL)"""


@q("jsonl_replay", f"WITH {_LOG_KEY} SELECT id, max(log_line) AS log_line, arg_max(event_no, log_line) AS event_no FROM e GROUP BY id HAVING NOT arg_max(k = 'memorydelete', log_line)")
def jsonl_replay(s, d):
    log = table(s, d, "memory_log").select("log_line", "event_no", F.regexp_replace(F.lower("event_type"), "[^a-z]", "").alias("k"), F.lower(F.trim("memory_id")).alias("id"))
    log = log.where("k IN ('memory', 'memorydelete') AND id IS NOT NULL")
    return store.replay(log, ["id"], ["log_line"], F.col("k") == "memorydelete").select("id", "log_line", "event_no")


@q("jsonl_compact", f"WITH {_LOG_KEY}, w AS (SELECT id, arg_max(k, log_line) AS k FROM e GROUP BY id) SELECT count_if(k = 'memory')::BIGINT AS kept, ((SELECT count(*) FROM e) - count_if(k = 'memory'))::BIGINT AS dropped FROM w")
def jsonl_compact(s, d):
    """A snapshot of the live rows in place of the log: written as a run, then read for the counts."""
    log = changefeed.canonical_changes(table(s, d, "memory_log").withColumns({"at_ms": F.col("log_line"), "writer_seq": F.lit(0).cast("long")})).where("entity_kind = 'memory'")
    runs = changefeed.new_store(s)
    changefeed.append_run(log, runs, 0)
    kept = s.table(changefeed.compact(s, runs)).agg(F.count("*").alias("kept"))
    return kept.crossJoin(log.agg(F.count("*").alias("n"))).select("kept", (F.col("n") - F.col("kept")).alias("dropped"))


@q("jsonl_roundtrip", f"{WITH} SELECT id, arg_max(category, ingest_seq) AS category, arg_max(importance, ingest_seq) AS importance FROM store GROUP BY id")
def jsonl_roundtrip(s, d):
    path = scratch(s, "jsonl")
    rows = m(s, d).select(F.lit("memory").alias("type"), "id", "content", "category", "importance", "stability")
    store.append_log(rows, path)
    log = store.read_log(s, path)
    return store.replay(log, ["id"], ["file_ts", "file_seq", "block", "line"], F.col("type") == "memory_delete").select("id", "category", "importance")


# --- vectors and formulas ------------------------------------------------------------------------
def _every_pair(mem: DataFrame, ask, name: str, distance: bool = False) -> DataFrame:
    queries = ask(mem).select(F.col("query").alias("id"), F.col("qvec").alias("vec"))
    base = mem.where("vec IS NOT NULL").select(F.col("ingest_seq").alias("id"), "vec")
    return similarity.every_pair(queries, base, name, distance).withColumnRenamed("id", "ingest_seq")


@q("cosine", f"{WITH}, {QV} SELECT query, ingest_seq, {COS} AS sim FROM store, qv WHERE vec IS NOT NULL")
def cosine(s, d, ask=query_vectors):
    return _every_pair(m(s, d), ask, "sim")


@q("euclidean", f"{WITH}, {QV} SELECT query, ingest_seq, round(list_distance(qvec, vec), 6) AS distance FROM store, qv WHERE vec IS NOT NULL")
def euclidean(s, d, ask=query_vectors):
    return _every_pair(m(s, d), ask, "distance", distance=True)


@q("normalize", f"{WITH} SELECT ingest_seq, round(vec[1] / sqrt(list_sum([x * x FOR x IN vec])), 6) AS first, round(vec[64] / sqrt(list_sum([x * x FOR x IN vec])), 6) AS last, 1e0 AS length FROM store WHERE vec IS NOT NULL")
def normalize(s, d):
    rows = m(s, d).where("vec IS NOT NULL").select("ingest_seq", vector.normalize(F.col("vec")).alias("u"))
    return rows.select("ingest_seq", R6(F.get("u", F.lit(0))).alias("first"), R6(F.get("u", F.lit(63))).alias("last"), R6(vector.norm(F.col("u"))).alias("length"))


@q("retention_exp", f"{WITH} SELECT ingest_seq, round({ret_sql(NOW)}, 6) AS retention FROM store")
def retention_exp(s, d):
    return m(s, d).select("ingest_seq", R6(decay.retention(NOW)).alias("retention"))


@q("retention_power", f"{WITH} SELECT ingest_seq, round({ret_sql(NOW, power=True)}, 6) AS retention FROM store")
def retention_power(s, d):
    return m(s, d).select("ingest_seq", R6(decay.retention(NOW, replace(DEFAULT, decay_model="power"))).alias("retention"))


@q("refresh_retention", f"{WITH} SELECT ingest_seq, round({ret_sql(LATE)}, 6) AS retention, round({ret_sql(LATE)}, 6) < coalesce(cached, 1e0) AS lower_than_cached FROM store")
def refresh_retention(s, d):
    r = R6(decay.retention(LATE))
    return m(s, d).select("ingest_seq", r.alias("retention"), (r < F.coalesce("cached", F.lit(1.0))).alias("lower_than_cached"))


@q("score", f"{WITH} SELECT ingest_seq, round(importance * pow({ret_sql(NOW)}, 3e-1), 6) AS score FROM store")
def score(s, d):
    return m(s, d).select("ingest_seq", R6(decay.score(F.col("importance"), decay.retention(NOW))).alias("score"))


@q("spaced_rep", f"{WITH} SELECT ingest_seq, round({spaced_sql(NOW)}, 6) AS factor FROM store")
def spaced_rep(s, d):
    return m(s, d).select("ingest_seq", R6(decay.spaced_rep(NOW)).alias("factor"))


@q("update_stability", f"{WITH} SELECT ingest_seq, round(least(1e0, stability + 1e-1 * least(2e0, greatest(0e0, ({NOW} - created_us) / 864e8) / 7e0)), 6) AS stability FROM store WHERE created_us IS NOT NULL")
def update_stability(s, d):
    days = (F.lit(NOW) - F.col("created_us")) / F.lit(decay.DAY_US)
    return m(s, d).where("created_us IS NOT NULL").select("ingest_seq", R6(decay.update_stability(F.col("stability"), days)).alias("stability"))


@q("direct_boost", f"{WITH} SELECT ingest_seq, round(least(1e0, stability + 1e-1 * {spaced_sql(NOW)}), 6) AS stability, access_count + 1 AS access_count FROM store")
def direct_boost(s, d):
    return m(s, d).select("ingest_seq", R6(decay.boosted(NOW, DEFAULT.direct_boost)).alias("stability"), (F.col("access_count") + 1).alias("access_count"))


@q("assoc_boost", f"{WITH} SELECT ingest_seq, round(least(1e0, stability + 3e-2 * {spaced_sql(NOW)}), 6) AS stability FROM store")
def assoc_boost(s, d):
    return m(s, d).select("ingest_seq", R6(decay.boosted(NOW, DEFAULT.associative_boost)).alias("stability"))


@q("assoc_decay", f"WITH {EDGES} SELECT src, dst, round(coalesce(weight * exp(-greatest(0e0, ({NOW} - used_us) / 864e8) / 90e0), weight), 6) AS weight FROM edges")
def assoc_decay(s, d):
    return store.edges(s, d).select("src", "dst", R6(decay.link_weight(F.col("weight"), NOW, F.col("used_us"))).alias("weight"))


@q("clamp_unit", f"{WITH} SELECT ingest_seq, greatest(0e0, least(1e0, importance * 3 - 1)) AS clamped FROM store")
def clamp_unit(s, d):
    return m(s, d).select("ingest_seq", text.clamp_unit(F.col("importance") * 3 - 1).alias("clamped"))


@q("hash_embed", """SELECT ingest_seq, i AS dim, round(('0x' || substr(md5(content || ':' || i::VARCHAR), 1, 8))::BIGINT / 4294967296e0 * 2 - 1, 6) AS value
  FROM memories, (SELECT unnest(range(8))::BIGINT AS i) WHERE content IS NOT NULL""")
def hash_embed(s, d):
    rows = table(s, d, "memories").where("content IS NOT NULL").select("ingest_seq", F.posexplode(vector.hash_embed(F.col("content"), 8)).alias("dim", "value"))
    return rows.select("ingest_seq", F.col("dim").cast("long").alias("dim"), R6("value").alias("value"))


@q("hash_embed_numpy")
def hash_embed_numpy(s, d):
    rows = table(s, d, "memories").select("ingest_seq", embed(F.col("content"), SeededEmbedder(16)).alias("v"))
    return rows.select("ingest_seq", F.size("v").alias("dims"), R6(vector.norm(F.col("v"))).alias("length"))


@q("hash_embed_128")
def hash_embed_128(s, d):
    rows = table(s, d, "memories").where("content IS NOT NULL").select("ingest_seq", embed(F.col("content"), HashEmbedder()).alias("v"))
    return rows.select("ingest_seq", F.size("v").alias("dims"), R6(F.get("v", F.lit(0))).alias("first"), R6(vector.norm(F.col("v"))).alias("length"))


# --- text ----------------------------------------------------------------------------------------
@q("tokenize", r"SELECT ingest_seq, len(t)::INTEGER AS n_tokens, array_to_string(t, ' ') AS tokens FROM (SELECT ingest_seq, [x FOR x IN regexp_split_to_array(lower(content), '\s+') IF x <> ''] AS t FROM memories WHERE content IS NOT NULL)")
def tokenize(s, d):
    rows = table(s, d, "memories").where("content IS NOT NULL").select("ingest_seq", text.tokenize(F.col("content")).alias("t"))
    return rows.select("ingest_seq", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@q("session_root", "SELECT regexp_replace(session_id, '_perspective_.*$', '') AS root, count(*) AS n, count(DISTINCT memory_seq) AS n_memories FROM access_log WHERE session_id IS NOT NULL GROUP BY 1")
def session_root(s, d):
    rows = table(s, d, "access_log").where("session_id IS NOT NULL").select(text.session_root(F.col("session_id")).alias("root"), "memory_seq")
    return rows.groupBy("root").agg(F.count("*").alias("n"), F.countDistinct("memory_seq").alias("n_memories"))


@q("strip_fence", r"SELECT ingest_seq, regexp_replace(content, '\s+$', '') AS body FROM memories WHERE content IS NOT NULL AND NOT regexp_matches(content, '^\s')")
def strip_fence(s, d):
    rows = table(s, d, "memories").where(F.col("content").isNotNull() & ~F.col("content").rlike(r"^\s"))
    return rows.select("ingest_seq", text.strip_fence(F.concat(F.lit("```json\n"), F.col("content"), F.lit("\n```"))).alias("body"))


def _replies(s, d):
    """Model replies as they come: fenced JSON with untidy fields, or plain text where the content begins with a bracket."""
    rows = table(s, d, "memories").where("content IS NOT NULL")
    item = F.struct(F.concat(F.lit(" "), F.col("content"), F.lit(" ")).alias("content"), F.concat(F.lit(" "), F.upper("memory_type")).alias("category"), (F.col("ingest_seq") % 3).cast("string").alias("importance"), "memory_type")
    fenced = F.concat(F.lit("```json\n"), F.to_json(F.array(item)), F.lit("\n```"))
    return rows.select("ingest_seq", "content", F.when(F.col("content").startswith("["), F.col("content")).otherwise(fenced).alias("reply"))


@q("parse_extraction", """SELECT ingest_seq, CASE WHEN starts_with(content, '[') THEN substr(content, 1, 500) ELSE ' ' || content || ' ' END AS content,
  CASE WHEN starts_with(content, '[') THEN 'episodic' ELSE ' ' || upper(memory_type) END AS category FROM memories WHERE content IS NOT NULL""")
def parse_extraction(s, d):
    return _replies(s, d).select("ingest_seq", F.explode(text.parse_reply(F.col("reply"))).alias("i")).select("ingest_seq", "i.content", "i.category")


@q("build_memories", """SELECT ingest_seq, trim(CASE WHEN starts_with(content, '[') THEN substr(content, 1, 500) ELSE content END) AS content, 'episodic' AS category,
  CASE WHEN starts_with(content, '[') THEN 5e-1 ELSE least(1e0, (ingest_seq % 3)::DOUBLE) END AS importance,
  round(1e-1 + 3e-1 * (CASE WHEN starts_with(content, '[') THEN 5e-1 ELSE least(1e0, (ingest_seq % 3)::DOUBLE) END), 6) AS stability,
  CASE WHEN starts_with(content, '[') THEN 'other' ELSE coalesce(memory_type, 'other') END AS memory_type
  FROM memories WHERE content IS NOT NULL AND trim(content) <> ''""")
def build_memories(s, d):
    rows = ingest.build(_replies(s, d).select("ingest_seq", "reply"), F.col("reply"))
    return rows.select("ingest_seq", "content", "category", "importance", R6("stability").alias("stability"), "memory_type")


@q("parse_ts", f"{WITH} SELECT ingest_seq, until_us FROM store")
def parse_ts(s, d):
    return m(s, d).select("ingest_seq", "until_us")


@q("stub_text", "SELECT ingest_seq, '[archived] ' || substr(content, 1, 200) AS content FROM memories")
def stub_text(s, d):
    return table(s, d, "memories").select("ingest_seq", text.stub_text(F.col("content")).alias("content"))


@q("numbered_list", r"""WITH t AS (SELECT conv_id, unnest(string_split(conversation_text, E'\n')) AS l, generate_subscripts(string_split(conversation_text, E'\n'), 1) AS i FROM conversation_text)
  SELECT conv_id, string_agg(i::VARCHAR || '. ' || l, E'\n' ORDER BY i) AS prompt FROM t GROUP BY conv_id""")
def numbered_list(s, d):
    return table(s, d, "conversation_text").where("conversation_text IS NOT NULL").select("conv_id", text.numbered(F.split("conversation_text", "\n")).alias("prompt"))


@q("verdict_parse", """SELECT ingest_seq, CASE WHEN contains(upper(content), 'CONTRADICTION') THEN 'CONTRADICTION' WHEN contains(upper(content), 'UPDATE') THEN 'UPDATE'
  WHEN contains(upper(content), 'OVERLAP') THEN 'OVERLAP' ELSE 'NONE' END AS verdict FROM (SELECT ingest_seq, content || CASE memory_type WHEN 'fact' THEN ' it is an update' WHEN 'plan' THEN ' contradiction, no update' ELSE '' END AS content FROM memories)""")
def verdict_parse(s, d):
    tail = F.when(F.col("memory_type") == "fact", " it is an update").when(F.col("memory_type") == "plan", " contradiction, no update").otherwise("")
    return table(s, d, "memories").select("ingest_seq", text.verdict(F.concat("content", tail)).alias("verdict"))


def _has(words) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{w}')" for w in words) + ")"


@q("categorize", f"SELECT ingest_seq, CASE WHEN {_has(text.PROCEDURAL)} THEN 'procedural' WHEN {_has(text.EPISODIC)} THEN 'episodic' ELSE 'semantic' END AS category FROM memories")
def categorize(s, d):
    return table(s, d, "memories").select("ingest_seq", text.category(F.col("content")).alias("category"))


@q("score_importance", f"""SELECT ingest_seq, round(least(1e0, 3e-1 + least(2e-1, length(content) / 500e0) + CASE WHEN {_has(text.DECISION)} THEN 15e-2 ELSE 0 END + CASE WHEN {_has(text.PERSONAL)} THEN 1e-1 ELSE 0 END
  + CASE WHEN {_has(text.TEMPORAL)} THEN 1e-1 ELSE 0 END + CASE WHEN {_has(text.SENTIMENT)} THEN 15e-2 ELSE 0 END), 6) AS importance FROM memories WHERE content IS NOT NULL""")
def score_importance(s, d):
    return table(s, d, "memories").where("content IS NOT NULL").select("ingest_seq", R6(text.importance(F.col("content"))).alias("importance"))


@q("extract_topics", r"""WITH w AS (SELECT ingest_seq, unnest(regexp_split_to_array(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', '', 'g'), '\s+')) AS word,
    generate_subscripts(regexp_split_to_array(regexp_replace(lower(content), '[^A-Za-z0-9_\s]', '', 'g'), '\s+'), 1) AS pos FROM memories WHERE content IS NOT NULL),
  c AS (SELECT ingest_seq, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) > 3 AND word NOT IN (""" + ", ".join(f"'{w}'" for w in text.STOP_WORDS) + """) GROUP BY 1, 2),
  r AS (SELECT ingest_seq, word, n, row_number() OVER (PARTITION BY ingest_seq ORDER BY n DESC, pos) AS rank FROM c) SELECT * FROM r WHERE rank <= 5""")
def extract_topics(s, d):
    words = table(s, d, "memories").where("content IS NOT NULL").select("ingest_seq", F.explode(F.transform(text.topic_words(F.col("content")), lambda w, i: F.struct(w.alias("word"), i.alias("pos")))).alias("t"))
    counts = words.groupBy("ingest_seq", "t.word").agg(F.count("*").alias("n"), F.min("t.pos").alias("pos"))
    by = Window.partitionBy("ingest_seq").orderBy(F.desc("n"), "pos")
    return counts.withColumn("rank", F.row_number().over(by).cast("long")).where("rank <= 5").select("ingest_seq", "word", "n", "rank")


@q("canonical_pair", "SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*) AS n FROM associations GROUP BY 1, 2")
def canonical_pair(s, d):
    a, b = text.canonical_pair(F.col("src"), F.col("dst"))
    return table(s, d, "associations").groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("n"))


@q("summary_truncate", "SELECT conv_id, CASE WHEN length(conversation_text) > 500 THEN substr(conversation_text, 1, 497) || '...' ELSE conversation_text END AS summary FROM conversation_text")
def summary_truncate(s, d):
    return table(s, d, "conversation_text").select("conv_id", text.truncated(F.col("conversation_text")).alias("summary"))


# --- aggregates ----------------------------------------------------------------------------------
@q("tier_counts", f"{WITH} SELECT count_if({HOT})::BIGINT AS hot, count_if({COLD})::BIGINT AS cold, count_if(is_stub)::BIGINT AS stub, count(*) AS total FROM store")
def tier_counts(s, d):
    return statistics.tier_counts(m(s, d))


@q("stats", f"""{WITH} SELECT count_if({HOT})::BIGINT AS hot, count_if({COLD})::BIGINT AS cold, count_if(is_stub)::BIGINT AS stub, count(*) AS total, count_if(NOT is_stub AND category = 'core')::BIGINT AS core,
  count_if(NOT is_stub AND {ret_sql(NOW)} < 15e-2)::BIGINT AS faint, round(coalesce(avg(CASE WHEN NOT is_stub THEN {ret_sql(NOW)} END), 0e0), 6) AS avg_retention FROM store""")
def stats(s, d):
    return statistics.stats(m(s, d), NOW)


@q("fading_by_category", f"{WITH} SELECT category, count(*) AS n FROM store WHERE {HOT} AND NOT is_superseded AND category <> 'core' AND {ret_sql(LATE)} < 2e-1 GROUP BY category HAVING count(*) >= 5")
def fading_by_category(s, d):
    return maintain.fading(m(s, d), LATE).groupBy("category").agg(F.count("*").alias("n")).where(F.col("n") >= DEFAULT.consolidation_group_size)


@q("group_summary", f"{WITH} SELECT category, count(*) AS n, max(importance) AS importance, round(avg(stability), 6) AS stability, max(access_count) AS access_count FROM store GROUP BY category")
def group_summary(s, d):
    return statistics.group_summary(m(s, d))


# --- changes of state ----------------------------------------------------------------------------
@q("partial_update", f"""{WITH}, dl AS (SELECT memory_seq AS ingest_seq, count(*) AS n FROM access_log GROUP BY 1)
  SELECT s.ingest_seq, CASE WHEN dl.n IS NULL THEN s.importance ELSE least(1e0, 1e-2 * dl.n) END AS importance, s.category FROM store s LEFT JOIN dl USING (ingest_seq)""")
def partial_update(s, d):
    delta = table(s, d, "access_log").groupBy(F.col("memory_seq").alias("ingest_seq")).agg(F.least(F.lit(1.0), F.lit(0.01) * F.count("*")).alias("importance"))
    return mutate.apply_delta(m(s, d), delta).select("ingest_seq", "importance", "category")


@q("delete_batch", f"{WITH} SELECT ingest_seq FROM store WHERE ingest_seq NOT IN (SELECT src FROM associations WHERE src IS NOT NULL)")
def delete_batch(s, d):
    return mutate.delete(m(s, d), table(s, d, "associations").select(F.col("src").alias("ingest_seq"))).select("ingest_seq")


@q("retention_update", f"""{WITH} SELECT ingest_seq, round(CASE WHEN access_count > 3 THEN {ret_sql(NOW)} ELSE cached END, 6) AS retention FROM store""")
def retention_update(s, d):
    mem = m(s, d)
    delta = mem.where("access_count > 3").select("ingest_seq", decay.retention(NOW).alias("cached"))
    return mutate.apply_delta(mem, delta).select("ingest_seq", R6("cached").alias("retention"))


@q("to_cold", f"{WITH} SELECT ingest_seq, is_cold OR is_superseded AS is_cold, CASE WHEN is_superseded THEN {NOW} ELSE cold_us END AS cold_us FROM store")
def to_cold(s, d):
    return m(s, d).withColumns(mutate.to_cold(F.col("is_superseded"), NOW)).select("ingest_seq", "is_cold", "cold_us")


@q("to_hot", f"{WITH} SELECT ingest_seq, is_cold AND NOT access_count >= 3 AS is_cold, CASE WHEN access_count >= 3 THEN NULL ELSE cold_us END AS cold_us, CASE WHEN access_count >= 3 THEN 0 ELSE days_at_floor END AS days_at_floor FROM store")
def to_hot(s, d):
    return m(s, d).withColumns(mutate.to_hot(F.col("access_count") >= 3)).select("ingest_seq", "is_cold", "cold_us", "days_at_floor")


@q("to_stub", f"{WITH} SELECT ingest_seq, CASE WHEN is_cold THEN '[archived] ' || substr(content, 1, 200) ELSE content END AS content, CASE WHEN is_cold THEN 0e0 ELSE stability END AS stability, vec IS NOT NULL AND NOT is_cold AS has_vector, is_stub OR is_cold AS is_stub FROM store")
def to_stub(s, d):
    return m(s, d).withColumns(mutate.to_stub(F.col("is_cold"))).select("ingest_seq", "content", "stability", F.col("vec").isNotNull().alias("has_vector"), "is_stub")


@q("mark_superseded", f"{WITH}, x AS (SELECT dst, min(src) AS by FROM associations WHERE weight >= 8e-1 GROUP BY dst) SELECT ingest_seq, is_superseded OR x.by IS NOT NULL AS is_superseded, x.by AS superseded_by FROM store LEFT JOIN x ON x.dst = ingest_seq")
def mark_superseded(s, d):
    by = table(s, d, "associations").where("weight >= 0.8").groupBy(F.col("dst").alias("ingest_seq")).agg(F.min("src").alias("superseded_by"), F.lit(True).alias("is_superseded"))
    return mutate.apply_delta(m(s, d).withColumn("superseded_by", F.lit(None).cast("long")), by).select("ingest_seq", "is_superseded", "superseded_by")


_CANON = "SELECT least(src, dst) AS a, greatest(src, dst) AS b, weight FROM associations WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst"


@q("link_upsert", f"""WITH c AS ({_CANON}), o AS (SELECT a, b, max(weight) AS old FROM c WHERE weight >= 5e-1 GROUP BY 1, 2), n AS (SELECT a, b, count(*) * 1e-1 AS add FROM c GROUP BY 1, 2)
  SELECT coalesce(o.a, n.a) AS a, coalesce(o.b, n.b) AS b, round(least(1e0, coalesce(old, 0e0) + coalesce(add, 0e0)), 6) AS strength FROM o FULL JOIN n ON o.a = n.a AND o.b = n.b""")
def link_upsert(s, d):
    a = table(s, d, "associations").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("weight").alias("strength"))
    out = mutate.upsert_links(a.where("strength >= 0.5"), a.select("a", "b", F.lit(0.1).alias("strength")))
    return out.select("a", "b", R6("strength").alias("strength"))


@q("delete_link", f"WITH {EDGES}, w AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM edges WHERE weight < 3e-1) SELECT src, dst FROM edges e WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = least(e.src, e.dst) AND w.b = greatest(e.src, e.dst))")
def delete_link(s, d):
    e = store.edges(s, d).withColumns({"a": F.least("src", "dst"), "b": F.greatest("src", "dst")})
    return e.join(e.where("weight < 0.3").select("a", "b").distinct(), ["a", "b"], "left_anti").select("src", "dst")


@q("strengthen", f"""{WITH}, h AS (SELECT memory_seq AS ingest_seq FROM access_log GROUP BY 1) SELECT s.ingest_seq, round(CASE WHEN h.ingest_seq IS NULL THEN stability ELSE least(1e0, stability + 1e-1 * {spaced_sql(NOW)}) END, 6) AS stability,
  CASE WHEN h.ingest_seq IS NULL THEN access_count ELSE access_count + 1 END AS access_count FROM store s LEFT JOIN h USING (ingest_seq)""")
def strengthen(s, d):
    mem = m(s, d)
    read = table(s, d, "access_log").select(F.col("memory_seq").alias("ingest_seq")).distinct()
    delta = mem.join(read, "ingest_seq", "left_semi").select("ingest_seq", decay.boosted(NOW, 0.1).alias("stability"), (F.col("access_count") + 1).alias("access_count"))
    return mutate.apply_delta(mem, delta).select("ingest_seq", R6("stability").alias("stability"), "access_count")


@q("cold_migration", f"""{WITH}, f AS (SELECT *, {HOT} AND category <> 'core' AS cand, coalesce(abs({ret_sql(LATE)} - {FLOOR}) < 1e-3, false) AS fl FROM store),
  g AS (SELECT *, CASE WHEN cand AND NOT is_superseded THEN (CASE WHEN fl THEN days_at_floor + 1 ELSE 0 END) ELSE days_at_floor END AS days FROM f)
  SELECT ingest_seq, days AS days_at_floor, is_cold OR (cand AND (is_superseded OR days >= 7)) AS is_cold FROM g""")
def cold_migration(s, d):
    return mutate.migrate_cold(m(s, d), LATE).select("ingest_seq", "days_at_floor", "is_cold")


@q("cold_ttl", f"""{WITH}, f AS (SELECT *, coalesce({COLD} AND category <> 'core' AND greatest(0e0, ({LATE} - cold_us) / 864e8) >= 180, false) AS over FROM store)
  SELECT ingest_seq, is_stub OR over AS is_stub, CASE WHEN over THEN '[archived] ' || substr(content, 1, 200) ELSE content END AS content FROM f""")
def cold_ttl(s, d):
    return mutate.expire_cold(m(s, d), LATE).select("ingest_seq", "is_stub", "content")


@q("boost_replay", f"""{WITH}, a AS (SELECT DISTINCT memory_seq, epoch_us(ts) AS us FROM access_log WHERE memory_seq IS NOT NULL AND ts IS NOT NULL),
  g AS (SELECT memory_seq, us, lag(us) OVER (PARTITION BY memory_seq ORDER BY us) AS prev FROM a),
  t AS (SELECT memory_seq, count(*) AS n_accesses, sum(CASE WHEN prev IS NULL THEN 0e0 ELSE 1e-1 * least(2e0, (us - prev) / 864e8 / 7e0) END) AS gain FROM g GROUP BY 1)
  SELECT memory_seq, n_accesses, round(least(1e0, stability + gain), 6) AS stability FROM t JOIN store ON ingest_seq = memory_seq""")
def boost_replay(s, d):
    return maintain.replay_boosts(table(s, d, "access_log"), m(s, d))


# --- search --------------------------------------------------------------------------------------
def search_sql(deep: bool = False, words: str | None = None, tail: str = "", hops: int = 0, least: str = "5e-2", k_rerank: int = 0) -> str:
    elig = f"vec IS NOT NULL AND {HOT}" + ("" if deep else " AND NOT is_superseded")
    ctes = [STORE, EDGES, QV, f"sims AS (SELECT query, ingest_seq, {COS} AS sim FROM store, qv WHERE {elig})",
            "dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ingest_seq) AS rank FROM sims) WHERE rank <= 30)"]
    if words:
        ctes += [bm25_ctes(words, deep), f"""cand AS (SELECT query, ingest_seq, sim FROM dense UNION ALL
          SELECT qv.query, b.ingest_seq, coalesce({COS}, 1e-1) AS sim FROM lex b JOIN store USING (ingest_seq), qv WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.query = qv.query AND d.ingest_seq = b.ingest_seq))"""]
    else:
        ctes += ["cand AS (SELECT query, ingest_seq, sim FROM dense)"]
    penalty = "(CASE WHEN is_superseded THEN 5e-1 ELSE 1e0 END) * (CASE WHEN late THEN 5e-1 ELSE 1e0 END)" if deep else "1e0"
    ctes += [
        f"scored AS (SELECT query, ingest_seq, sim, {ret_sql(NOW)} AS r, {expired_sql(NOW)} AS late, is_superseded FROM cand JOIN store USING (ingest_seq))",
        f"okay AS (SELECT query, ingest_seq, sim, round(sim * pow(r, 3e-1) * {penalty}, 6) AS score, {'late OR is_superseded' if deep else 'false'} AS deep FROM scored {'' if deep else 'WHERE NOT late'})",
        "byscore AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ingest_seq) AS rank FROM okay)",
        f"""placed AS (SELECT b.* EXCLUDE (rank), row_number() OVER (PARTITION BY query ORDER BY CASE WHEN rank <= {k_rerank} THEN 0 ELSE 1 END,
          CASE WHEN rank <= {k_rerank} THEN -coalesce(length(content), 0) END, rank) AS rank FROM byscore b JOIN store USING (ingest_seq))""" if k_rerank else "placed AS (SELECT * FROM byscore)",
        "direct AS (SELECT * FROM placed WHERE rank <= 10)",
        f"live AS (SELECT src, dst, coalesce(weight * exp(-greatest(0e0, ({NOW} - used_us) / 864e8) / 90e0), weight) AS w, created_us FROM edges)",
        """hop AS (SELECT d.query, l.dst AS ingest_seq, l.w, row_number() OVER (PARTITION BY d.query, l.dst ORDER BY d.rank, l.created_us, l.dst) AS rn FROM direct d JOIN live l ON l.src = d.ingest_seq
          JOIN store t ON t.ingest_seq = l.dst WHERE l.w >= 3e-1 AND NOT t.is_stub AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.query = d.query AND x.ingest_seq = l.dst))""",
        "found0 AS (SELECT query, ingest_seq, w FROM hop WHERE rn = 1)",
    ]
    for n in range(1, hops + 1):
        source = "(SELECT query, ingest_seq, rank AS ord FROM direct)" if n == 1 else f"step{n - 1}"
        ctes += [
            f"""cand{n} AS (SELECT p.query, l.dst AS ingest_seq, l.w, p.ord AS parent, l.created_us, row_number() OVER (PARTITION BY p.query, l.dst ORDER BY p.ord, l.created_us, l.dst) AS rn
              FROM {source} p JOIN live l ON l.src = p.ingest_seq JOIN store t ON t.ingest_seq = l.dst WHERE l.w >= {least} AND NOT t.is_stub
              AND NOT EXISTS (SELECT 1 FROM direct x WHERE x.query = p.query AND x.ingest_seq = l.dst) AND NOT EXISTS (SELECT 1 FROM found{n - 1} x WHERE x.query = p.query AND x.ingest_seq = l.dst))""",
            f"step{n} AS (SELECT query, ingest_seq, w, row_number() OVER (PARTITION BY query ORDER BY parent, created_us, ingest_seq) AS ord FROM cand{n} WHERE rn = 1)",
            f"found{n} AS (SELECT query, ingest_seq, w FROM found{n - 1} UNION ALL SELECT query, ingest_seq, w FROM step{n})",
        ]
    ctes += [
        f"assoc AS (SELECT h.query, h.ingest_seq, coalesce({COS}, 1e-1) AS sim, {ret_sql(NOW)} AS r, h.w FROM found{hops} h JOIN store s USING (ingest_seq) JOIN qv ON qv.query = h.query)",
        "every AS (SELECT query, ingest_seq, sim, score, deep, false AS associative FROM direct UNION ALL SELECT query, ingest_seq, sim, round(sim * pow(r, 3e-1) * w, 6), false, true FROM assoc)",
        "final AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, associative, ingest_seq) AS rank FROM every)",
    ]
    return "WITH " + ",\n".join(ctes) + "\n" + (tail or "SELECT query, ingest_seq, sim, score, deep, associative, rank FROM final WHERE rank <= 10")


def bm25_ctes(words: str, deep: bool = False, k: int = 30) -> str:
    toks = words.lower().split()
    distinct = list(dict.fromkeys(toks))
    tf = ", ".join(f"len([x FOR x IN t IF x = '{w}'])::DOUBLE AS tf{i}" for i, w in enumerate(distinct))
    df = ", ".join(f"count_if(tf{i} > 0)::DOUBLE AS df{i}" for i in range(len(distinct)))
    total = " + ".join(f"{toks.count(w)} * ln((n - df{i} + 5e-1) / (df{i} + 5e-1) + 1) * tf{i} * 22e-1 / (tf{i} + 12e-1 * (25e-2 + 75e-2 * dl / adl))" for i, w in enumerate(distinct))
    some = " OR ".join(f"tf{i} > 0" for i in range(len(distinct)))
    sup = "" if deep else "AND NOT is_superseded"
    return f"""tk AS (SELECT ingest_seq, [x FOR x IN regexp_split_to_array(lower(content), '\\s+') IF x <> ''] AS t FROM store WHERE {HOT} {sup} AND content IS NOT NULL),
      bt AS (SELECT ingest_seq, len(t)::DOUBLE AS dl, {tf} FROM tk), bs AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS adl, {df} FROM bt),
      lex AS (SELECT ingest_seq, round({total}, 6) AS bm25 FROM bt, bs WHERE {some} ORDER BY bm25 DESC, ingest_seq LIMIT {k})"""


def _search(s, d, ask=query_vectors, **options):
    mem = m(s, d)
    return search.search(mem, store.edges(s, d), ask(mem), NOW, **options)


_OUT = ["query", "ingest_seq", "sim", "score", "deep", "associative", "rank"]


@q("vector_topk", f"{WITH}, {QV}, x AS (SELECT query, ingest_seq, {COS} AS sim FROM store, qv WHERE vec IS NOT NULL AND NOT is_superseded AND {HOT}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ingest_seq) AS rank FROM x) WHERE rank <= 30")
def vector_topk(s, d, ask=query_vectors):
    mem = m(s, d)
    return search.similar(mem, ask(mem), 30, search.eligible()).select("query", "ingest_seq", "sim", "rank")


@q("search_direct", search_sql(tail="SELECT query, ingest_seq, sim, score, rank FROM direct"))
def search_direct(s, d, ask=query_vectors):
    return _search(s, d, ask).direct.select("query", "ingest_seq", "sim", "score", "rank")


@q("search", search_sql())
def search_all(s, d, ask=query_vectors):
    return _search(s, d, ask).results.select(*_OUT)


@q("search_deep", search_sql(deep=True))
def search_deep(s, d, ask=query_vectors):
    return _search(s, d, ask, deep=True).results.select(*_OUT)


@q("search_hybrid", search_sql(words=WORDS))
def search_hybrid(s, d, ask=query_vectors):
    return _search(s, d, ask, text=WORDS).results.select(*_OUT)


@q("bm25", f"{WITH}, {bm25_ctes(WORDS)} SELECT ingest_seq, bm25 FROM lex")
def bm25(s, d):
    return lexical.bm25(m(s, d).where(store.hot() & ~F.col("is_superseded") & F.col("content").isNotNull()), WORDS, 30)


@q("hybrid_union", search_sql(words=WORDS, tail="SELECT query, ingest_seq, sim FROM cand"))
def hybrid_union(s, d, ask=query_vectors):
    return _search(s, d, ask, text=WORDS).candidates.select("query", "ingest_seq", "sim")


@q("assoc_expand", search_sql(tail="SELECT query, ingest_seq, round(w, 6) AS link FROM hop WHERE rn = 1"))
def assoc_expand(s, d, ask=query_vectors):
    mem = m(s, d)
    e = store.edges(s, d)
    found = search.search(mem, e, ask(mem), NOW)
    return graph.expand(found.direct, e, mem, NOW).select("query", "ingest_seq", R6("link").alias("link"))


@q("co_retrieval", search_sql(tail="""SELECT least(x.ingest_seq, y.ingest_seq) AS a, greatest(x.ingest_seq, y.ingest_seq) AS b,
  round(least(1e0, coalesce(max(o.w), 0e0) + count(DISTINCT x.query) * 1e-1), 6) AS weight FROM direct x JOIN direct y ON x.query = y.query AND x.rank < y.rank
  LEFT JOIN (SELECT least(src, dst) AS a, greatest(src, dst) AS b, max(weight) AS w FROM edges GROUP BY 1, 2) o ON o.a = least(x.ingest_seq, y.ingest_seq) AND o.b = greatest(x.ingest_seq, y.ingest_seq) GROUP BY 1, 2"""))
def co_retrieval(s, d, ask=query_vectors):
    return _search(s, d, ask).edge_delta.select("a", "b", R6("weight").alias("weight"))


@q("trace_counts", search_sql(words=WORDS, tail="SELECT query, count_if(dense)::BIGINT AS vector_search, count_if(NOT dense)::BIGINT AS lexical_search FROM (SELECT c.query, EXISTS (SELECT 1 FROM dense d WHERE d.query = c.query AND d.ingest_seq = c.ingest_seq) AS dense FROM cand c) GROUP BY query"))
def trace_counts(s, d, ask=query_vectors):
    return _search(s, d, ask, text=WORDS).candidates.groupBy("query").agg(F.count_if(F.col("rank").isNotNull()).alias("vector_search"), F.count_if(F.col("rank").isNull()).alias("lexical_search"))


@q("retrieve", f"""{WITH_E}, {QV}, sims AS (SELECT query, ingest_seq, {COS} AS sim FROM store, qv WHERE vec IS NOT NULL AND {HOT} AND NOT is_superseded AND cached >= 2e-1),
  d0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, ingest_seq) AS rk FROM sims) WHERE rk <= 30),
  d1 AS (SELECT query, ingest_seq, sim, round(sim * {ret_sql(NOW)}, 6) AS score FROM d0 JOIN store USING (ingest_seq) WHERE {ret_sql(NOW)} >= 2e-1),
  direct AS (SELECT query, ingest_seq, sim, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ingest_seq) AS rk FROM d1) WHERE rk <= 10),
  twoway AS (SELECT src, dst, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges),
  near AS (SELECT d.query, b.dst AS ingest_seq, max(weight) AS strength FROM direct d JOIN twoway b ON b.src = d.ingest_seq WHERE weight >= 3e-1 GROUP BY 1, 2),
  n2 AS (SELECT n.query, n.ingest_seq, greatest(coalesce({COS}, 0e0), strength) AS sim, {ret_sql(NOW)} AS r FROM near n JOIN store USING (ingest_seq) JOIN qv ON qv.query = n.query
    WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.query = n.query AND x.ingest_seq = n.ingest_seq)),
  every AS (SELECT * FROM direct UNION ALL SELECT query, ingest_seq, sim, round(sim * r, 6) FROM n2 WHERE r >= 2e-1)
  SELECT * FROM (SELECT query, ingest_seq, sim, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, ingest_seq) AS rank FROM every) WHERE rank <= 10""")
def retrieve(s, d, ask=query_vectors):
    mem = m(s, d)
    return search.retrieve(mem, store.edges(s, d), ask(mem), NOW).select("query", "ingest_seq", "sim", "score", "rank")


@q("rerank_permute", search_sql(tail="""SELECT query, ingest_seq, rank, row_number() OVER (PARTITION BY query ORDER BY coalesce(CASE rank WHEN 4 THEN 0 WHEN 1 THEN 1 WHEN 6 THEN 2 END, CASE WHEN rank <= 6 THEN 6 ELSE 7 END), rank) AS new_rank FROM direct"""))
def rerank_permute(s, d, ask=query_vectors):
    return search.rerank(_search(s, d, ask).direct, [3, 0, 3, 5, 11], 6).select("query", "ingest_seq", "rank", "new_rank")


@q("linked_multi", search_sql(tail="""SELECT ingest_seq, max(weight) AS strength FROM (SELECT src AS a, dst AS ingest_seq, weight FROM edges UNION ALL SELECT dst, src, weight FROM edges)
  WHERE weight >= 3e-1 AND a IN (SELECT ingest_seq FROM direct) AND ingest_seq NOT IN (SELECT ingest_seq FROM direct) GROUP BY ingest_seq"""))
def linked_multi(s, d, ask=query_vectors):
    return graph.strongest(_search(s, d, ask).direct.select("ingest_seq").distinct(), store.edges(s, d), 0.3)


GRAPH = replace(DEFAULT, graph_expansion_hops=2, min_bridge_edge_weight=0.05)
BRIDGE = replace(DEFAULT, bridge_discovery=True, min_bridge_edge_weight=0.001)
RERANK = replace(DEFAULT, rerank_enabled=True, k_rerank=20)


@q("search_graph", search_sql(hops=2))
def search_graph(s, d, ask=query_vectors):
    """A search whose walk goes on over weak links, two hops from the direct results."""
    return _search(s, d, ask, cfg=GRAPH).results.select(*_OUT)


def _search_bridge_sql() -> str:
    out = ["b0 AS (SELECT x.query, x.rank, y.rank AS rank_b, x.ingest_seq AS start, y.ingest_seq AS goal, x.ingest_seq AS v, [x.ingest_seq] AS path FROM direct x JOIN direct y ON x.query = y.query AND x.rank < y.rank AND y.rank <= 3)"]
    for k in range(1, 5):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM b{j} z WHERE z.query = a.query AND z.start = a.start AND z.goal = a.goal AND z.v = e.dst)" for j in range(k))
        out.append(f"b{k} AS (SELECT a.query, a.rank, a.rank_b, a.start, a.goal, e.dst AS v, min(list_append(a.path, e.dst)) AS path FROM b{k - 1} a JOIN live e ON e.src = a.v WHERE e.w >= 1e-3 AND a.v <> a.goal {seen} GROUP BY 1, 2, 3, 4, 5, 6)")
    found = " UNION ALL ".join(f"SELECT query, start, goal, path FROM b{k} WHERE v = goal" for k in range(1, 5))
    return search_sql(tail=f", {', '.join(out)} SELECT query, start, goal, array_to_string(path, '>') AS path FROM ({found}) WHERE len(path) > 2")


@q("search_bridge", _search_bridge_sql())
def search_bridge(s, d, ask=query_vectors):
    """Evidence chains between the first three results of each query."""
    found = _search(s, d, ask, cfg=BRIDGE).bridges
    return found.select("query", "start", "goal", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def _longest_first(text: str, contents: list[str]) -> list[int]:
    """A stand-in for a ranking model."""
    return sorted(range(len(contents)), key=lambda i: (-len(contents[i]), i))


@q("search_rerank", search_sql(k_rerank=20, tail="SELECT query, ingest_seq, score, rank FROM direct"))
def search_rerank(s, d, ask=query_vectors):
    """Direct results after a model has put the first twenty candidates in its order."""
    return _search(s, d, ask, cfg=RERANK, ranker=_longest_first).direct.select("query", "ingest_seq", "score", "rank")


@q("search_trace", search_sql(words=WORDS, tail="""SELECT query, 'vector_search' AS stage, count(*) AS n FROM dense GROUP BY query UNION ALL
  SELECT c.query, 'lexical_search', count(*) FROM cand c WHERE NOT EXISTS (SELECT 1 FROM dense d WHERE d.query = c.query AND d.ingest_seq = c.ingest_seq) GROUP BY c.query UNION ALL
  SELECT query, 'scoring', count(*) FROM okay GROUP BY query UNION ALL SELECT query, 'direct', count(*) FROM direct GROUP BY query UNION ALL SELECT query, 'results', count(*) FROM final WHERE rank <= 10 GROUP BY query"""))
def search_trace(s, d, ask=query_vectors):
    return _search(s, d, ask, text=WORDS).trace()


@q("token_usage", r"""SELECT user_id, sum(len(regexp_split_to_array(conversation_text, '\s+')))::BIGINT AS prompt_tokens, (2 * count(*))::BIGINT AS completion_tokens,
  (sum(len(regexp_split_to_array(conversation_text, '\s+'))) + 2 * count(*))::BIGINT AS total_tokens FROM conversation_text WHERE conversation_text IS NOT NULL GROUP BY user_id""")
def token_usage(s, d):
    """What a model's calls used per user; words stand for tokens and each reply has two."""
    calls = table(s, d, "conversation_text").where("conversation_text IS NOT NULL")
    return statistics.token_usage(calls.select("user_id", F.size(F.split("conversation_text", r"\s+")).alias("prompt_tokens"), F.lit(2).alias("completion_tokens")), "user_id")


#: The searches above ask for three vectors at every size; these ask for the whole batch.
BATCHED = ("cosine", "euclidean", "vector_topk", "search_direct", "search", "search_deep", "search_hybrid", "hybrid_union", "assoc_expand", "co_retrieval", "trace_counts", "retrieve", "rerank_permute", "linked_multi", "search_graph", "search_bridge", "search_rerank")
for _name in BATCHED:
    q(f"{_name}_batch", SQL[_name].replace(QV, QV_BATCH))(lambda s, d, f=QUERIES[_name]: f(s, d, query_batch))


_LIVE1 = f"live AS (SELECT src, dst, coalesce(weight * exp(-greatest(0e0, ({NOW} - used_us) / 864e8) / 90e0), weight) AS w FROM edges WHERE coalesce(weight * exp(-greatest(0e0, ({NOW} - used_us) / 864e8) / 90e0), weight) >= 1e-3)"
_ANCHOR = "a0 AS (SELECT src AS ingest_seq FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 8)"


def _anchors(s, d):
    """The eight vertices with most links; the caller of the library chooses its own."""
    return store.edges(s, d).groupBy(F.col("src").alias("ingest_seq")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ingest_seq").limit(8).select("ingest_seq")


@q("graph_expand", f"""WITH {EDGES}, {_LIVE1}, {_ANCHOR}, h1 AS (SELECT DISTINCT dst AS v FROM live JOIN a0 ON src = ingest_seq WHERE dst NOT IN (SELECT ingest_seq FROM a0)),
  h2 AS (SELECT DISTINCT dst AS v FROM live JOIN h1 ON src = v WHERE dst NOT IN (SELECT ingest_seq FROM a0) AND dst NOT IN (SELECT v FROM h1))
  SELECT v AS ingest_seq, 1 AS hop FROM h1 UNION ALL SELECT v, 2 FROM h2""")
def graph_expand(s, d):
    return graph.frontier(_anchors(s, d).withColumn("query", F.lit(0)), store.edges(s, d), NOW, 2, 0.001).select("ingest_seq", "hop")


def _bridge_sql() -> str:
    out = [EDGES, _LIVE1, _ANCHOR, "p AS (SELECT x.ingest_seq AS start, y.ingest_seq AS goal FROM a0 x JOIN a0 y ON x.ingest_seq < y.ingest_seq)",
           "l0 AS (SELECT start, goal, start AS v, [start] AS path FROM p)"]
    for k in range(1, 5):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM l{j} z WHERE z.start = a.start AND z.goal = a.goal AND z.v = e.dst)" for j in range(k))
        out.append(f"l{k} AS (SELECT a.start, a.goal, e.dst AS v, min(list_append(a.path, e.dst)) AS path FROM l{k - 1} a JOIN live e ON e.src = a.v WHERE a.v <> a.goal {seen} GROUP BY 1, 2, 3)")
    found = " UNION ALL ".join(f"SELECT start, goal, path FROM l{k} WHERE v = goal" for k in range(1, 5))
    return "WITH " + ", ".join(out) + f" SELECT start, goal, array_to_string(path, '>') AS path FROM ({found}) WHERE len(path) > 2"


@q("bridge_paths", _bridge_sql())
def bridge_paths(s, d):
    a = _anchors(s, d)
    pairs = a.select(F.col("ingest_seq").alias("start")).crossJoin(a.select(F.col("ingest_seq").alias("goal"))).where("start < goal")  # 28 pairs
    found = graph.bridges(pairs.withColumn("pair", F.struct("start", "goal")), store.edges(s, d), NOW, 0.001)
    return found.select("pair.start", "pair.goal", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


# --- similarity over sets ------------------------------------------------------------------------
def _knn(s, d):
    base = m(s, d).where("vec IS NOT NULL AND NOT is_stub").select(F.col("ingest_seq").alias("id"), "vec")
    return similarity.top_k(base.where("id % 100 = 0"), base, 5)


_NEAR = f"""{WITH}, b AS (SELECT ingest_seq, vec FROM store WHERE vec IS NOT NULL AND NOT is_stub), p AS (SELECT x.ingest_seq AS query, y.ingest_seq AS id, round(list_cosine_similarity(x.vec, y.vec), 6) AS sim
  FROM b x JOIN b y ON x.ingest_seq <> y.ingest_seq WHERE x.ingest_seq % 100 = 0), near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY sim DESC, id) AS rank FROM p) WHERE rank <= 5)"""
_ROOTS = "r AS (SELECT DISTINCT memory_seq AS ingest_seq, regexp_replace(session_id, '_perspective_.*$', '') AS root FROM access_log WHERE session_id IS NOT NULL)"
_QUEUE = f"{_NEAR}, {_ROOTS}, queue AS (SELECT query AS new_id, id AS existing_id, sim FROM near n WHERE sim > 85e-2 AND NOT EXISTS (SELECT 1 FROM r x JOIN r y ON x.root = y.root WHERE x.ingest_seq = n.query AND y.ingest_seq = n.id))"


def _roots(s, d):
    return table(s, d, "access_log").where("session_id IS NOT NULL").select(F.col("memory_seq").alias("ingest_seq"), text.session_root(F.col("session_id")).alias("root"))


@q("knn_join", f"{_NEAR} SELECT query, id, sim, rank FROM near")
def knn_join(s, d):
    return _knn(s, d)


@q("conflict_tag", f"{_QUEUE} SELECT new_id, existing_id, sim FROM queue")
def conflict_tag(s, d):
    return maintain.tag_conflicts(_knn(s, d), _roots(s, d))[0]


TIGHT = replace(DEFAULT, conflict_threshold=0.97)


@q("reinforce", f"{_NEAR}, t AS (SELECT id, count(*) AS n FROM near WHERE sim > 75e-2 AND sim <= 97e-2 GROUP BY id) SELECT ingest_seq, round(least(1e0, stability + 5e-2 * n), 6) AS stability FROM t JOIN store s ON s.ingest_seq = t.id")
def reinforce(s, d):
    times = maintain.tag_conflicts(_knn(s, d), _roots(s, d), TIGHT)[1]
    rows = m(s, d).join(times.withColumnRenamed("id", "ingest_seq"), "ingest_seq")
    return rows.select("ingest_seq", R6(F.least(F.lit(1.0), F.col("stability") + F.col("times") * 0.05)).alias("stability"))


def _verdict():
    return F.when(F.length("new_content") > F.length("old_content"), "CONTRADICTION").when(F.length("new_content") < F.length("old_content"), "UPDATE").otherwise("NONE")


@q("conflict_resolve", f"""{_QUEUE}, f AS (SELECT * FROM queue ORDER BY sim DESC, new_id, existing_id LIMIT 50)
  SELECT new_id, existing_id, sim, CASE WHEN length(n.content) > length(o.content) THEN 'CONTRADICTION' WHEN length(n.content) < length(o.content) THEN 'UPDATE' ELSE 'NONE' END AS verdict
  FROM f JOIN store n ON n.ingest_seq = new_id JOIN store o ON o.ingest_seq = existing_id WHERE NOT n.is_superseded AND NOT o.is_superseded""")
def conflict_resolve(s, d):
    queue = maintain.tag_conflicts(_knn(s, d), _roots(s, d))[0]
    return maintain.judged(queue, m(s, d), _verdict()).select("new_id", "existing_id", "sim", "verdict")


@q("conflict_effects")
def conflict_effects(s, d):
    queue = maintain.tag_conflicts(_knn(s, d), _roots(s, d))[0]
    return maintain.resolve_conflicts(queue, m(s, d), _verdict())


@q("consolidation_pairs", f"""{WITH}, f AS (SELECT category, ingest_seq, vec FROM store WHERE vec IS NOT NULL AND {HOT} AND NOT is_superseded AND category <> 'core' AND {ret_sql(LATE)} < 2e-1),
  p AS (SELECT a.ingest_seq AS i, b.ingest_seq AS j FROM f a JOIN f b ON a.category = b.category AND a.ingest_seq <> b.ingest_seq WHERE round(list_cosine_similarity(a.vec, b.vec), 6) >= 7e-1)
  SELECT category, ingest_seq, count(j) AS n_links, least(ingest_seq, coalesce(min(j), ingest_seq)) AS least_label FROM f LEFT JOIN p ON i = ingest_seq GROUP BY 1, 2""")
def consolidation_pairs(s, d):
    """Per fading memory its number of links within its category and the smallest id among them."""
    return maintain.fading_links(m(s, d), LATE, DEFAULT.consolidation_similarity_threshold)


@q("consolidate_greedy")
def consolidate_greedy(s, d):
    return maintain.greedy_groups(m(s, d), LATE, replace(DEFAULT, consolidation_group_size=3))


@q("consolidate_report")
def consolidate_report(s, d):
    return maintain.report(m(s, d), LATE, replace(DEFAULT, consolidation_group_size=3))


@q("tick")
def tick(s, d):
    snapshot, summaries, links = maintain.tick(m(s, d), LATE)
    made = summaries.agg(F.count("*").alias("n_summaries")).crossJoin(links.agg(F.count("*").alias("n_links")))  # one row each
    return statistics.tier_counts(snapshot).crossJoin(made)


# --- ingestion -----------------------------------------------------------------------------------
@q("ingest_raw", SQL["raw_turns"].replace("SELECT conv_id, line, content FROM u", "SELECT conv_id, line, content, 'episodic' AS category, 2e-1 AS stability FROM u"))
def ingest_raw(s, d):
    return ingest.raw_memories(table(s, d, "conversation_text")).select("conv_id", "line", "content", "category", R6("stability").alias("stability"))


_DIMS = 4


@q("synaptic_tagging", SQL["raw_turns"].replace("SELECT conv_id, line, content FROM u", f""", v AS (SELECT conv_id, line, [('0x' || substr(md5(content || ':' || i::VARCHAR), 1, 8))::BIGINT / 4294967296e0 * 2 - 1 FOR i IN range({_DIMS})] AS vec FROM u""")
   + """) SELECT a.conv_id AS batch, a.line AS a, b.line AS b, round(least(5e-1, 2e-1 + (round(list_cosine_similarity(a.vec, b.vec), 6) - 4e-1) * 5e-1), 6) AS weight
  FROM v a JOIN v b ON a.conv_id = b.conv_id AND a.line < b.line WHERE round(list_cosine_similarity(a.vec, b.vec), 6) >= 4e-1""")
def synaptic_tagging(s, d):
    rows = ingest.raw_memories(table(s, d, "conversation_text")).select("conv_id", F.col("line").alias("id"), vector.hash_embed(F.col("content"), _DIMS).alias("vec"))
    return ingest.batch_links(rows, "conv_id")


@q("ingest_semantic_stub", """SELECT conv_id, pos::INTEGER AS pos, content, category, importance, 1e-1 + 3e-1 * importance AS stability, memory_type, ttl_seconds::INTEGER AS ttl_seconds
  FROM conversation_text, (VALUES (0, 'Likes tea', 'semantic', 8e-1, 'preference', NULL), (1, 'Trip on Monday', 'episodic', 5e-1, 'plan', 3600)) AS r(pos, content, category, importance, memory_type, ttl_seconds) WHERE conversation_text IS NOT NULL""")
def ingest_semantic_stub(s, d):
    reply = fixed_reply([{"content": " Likes tea ", "category": "SEMANTIC", "importance": 0.8, "memory_type": "preference"}, {"content": "Trip on Monday", "importance": "x", "memory_type": "plan", "ttl_seconds": "3600"}])
    return ingest.build(ingest.extract(table(s, d, "conversation_text").select("conv_id", "conversation_text"), reply).select("conv_id", "reply"), F.col("reply")).select("conv_id", "pos", "content", "category", "importance", "stability", "memory_type", "ttl_seconds")


def _stream(s, d, name):
    """A table as a stream of its files; a table of one file is found by a pattern."""
    whole = table(s, d, name)
    one = len(whole.inputFiles()) == 1 and whole.inputFiles()[0].endswith(f"/{name}.parquet")
    return s.readStream.schema(whole.schema).option("maxFilesPerTrigger", 4).parquet(f"{d}/{name}*.parquet" if one else f"{d}/{name}.parquet")


@q("stream_changes", P5_SQL.replace("SELECT entity_kind, key_a, key_b, event_no FROM r WHERE rn = 1 AND NOT gone", "SELECT entity_kind, count(*) AS n FROM r WHERE rn = 1 AND NOT gone GROUP BY entity_kind"))
def stream_changes(s, d):
    """The change log as a stream: micro-batches become runs, the state is merged on read."""
    runs = changefeed.new_store(s)
    boosts.stream_changes(s, _stream(s, d, "memory_log"), runs, scratch(s, "stream-checkpoint")).awaitTermination()
    return changefeed.merge_runs(s, runs).groupBy("entity_kind").agg(F.count("*").alias("n"))


@q("stream_boost", SQL["boost_replay"])
def stream_boost(s, d):
    """Stability per memory after an access stream: micro-batches are appended, the accesses are replayed on read."""
    path = scratch(s, "stream-accesses")
    source = _stream(s, d, "access_log")
    boosts.stream_accesses(source, path, scratch(s, "stream-checkpoint")).awaitTermination()
    return maintain.replay_boosts(s.read.schema("memory_seq long, ts timestamp").parquet(path), m(s, d))
