"""The engine end to end on a small store."""

from dataclasses import replace

from pyspark.sql import functions as F

from cinderbase.config import DEFAULT
from cinderbase.engine import MemoryEngine
from cinderbase.providers import Retrying, SeededEmbedder, fixed_reply

DAY = 86_400_000_000
NOW = 20_000 * DAY


def topics():
    """Made in a function, so that workers get the class by value."""

    class Topics:
        """Texts of one topic have nearly one vector."""

        dimensions = 4

        def embed_batch(self, texts):
            return [[1.0, 0.001 * len(t), 0.0, 0.0] if "tea" in t else [0.0, 1.0, 0.001 * len(t), 0.0] for t in texts]

    return Topics()


def test_life_of_a_store(spark, tmp_path):
    cfg = replace(DEFAULT, consolidation_group_size=3, extraction_mode="hybrid")
    e = MemoryEngine(spark, str(tmp_path / "s"), topics(), cfg)
    e.add(spark.createDataFrame([("likes tea", 0.2), ("drinks tea", 0.2), ("hates rain", 0.9)], "content string, importance double"), NOW)
    assert e.memories().count() == 3 and e.conflicts().count() == 1
    found = e.search("tea", NOW + DAY, top_k=2)
    assert {r["sim"] > 0.9 for r in found.results.collect()} == {True}
    e.commit(found, NOW + DAY)
    assert e.memories().where("access_count = 1").count() == 2 and e.edges().count() == 2
    assert e.retrieve("tea", NOW + DAY, 1).count() == 1
    e.tick(NOW + DAY, F.lit("CONTRADICTION"))
    assert e.conflicts().count() == 0
    reply = fixed_reply([{"content": "has a tea shop", "category": "core", "importance": 0.7}])
    e.extract_and_store(spark.createDataFrame([(1, "[head]\nuser: more tea\nuser: green tea please")], "conv_id long, conversation_text string"), NOW + DAY, reply)
    assert e.memories().where("id like 'c-1-%'").count() == 3 and e.edges().count() > 2
    late = NOW + 900 * DAY
    assert e.get_stats(late).first()["total"] == 6
    report = e.consolidate(late).collect()
    assert sum(r["action"] == "compress" and r["category"] == "episodic" for r in report) >= 3
    assert e.memories().where("content like 'Summary: %'").count() >= 1
    e.update(spark.createDataFrame([(e.memories().agg(F.max("ingest_seq")).first()[0], "new rain")], "ingest_seq long, content string"))
    assert e.memories().where("content = 'new rain'").count() == 1
    e.link(spark.createDataFrame([(2, 1, 0.4), (1, 2, 0.1)], "a long, b long, strength double"), late)
    before = e.memories().count()
    e.delete(e.memories().where("content = 'new rain'").select("ingest_seq"))
    assert e.memories().count() == before - 1 and e.query_memories(limit=2).count() <= 2
    e.clear()
    assert e.memories().count() == 0 and e.edges().count() == 0
    e.tick(late)


def test_retrying_embedder():
    class Flaky(SeededEmbedder):
        calls = 0

        def embed_batch(self, texts):
            self.calls += 1
            if self.calls < 3:
                raise OSError
            return super().embed_batch(texts)

    inner = Flaky(8)
    assert len(Retrying(inner, pause=0).embed_batch(["a"])[0]) == 8 and inner.calls == 3


def test_promotion_sessions_and_revival(spark, tmp_path):
    """Direct finds in several sessions make a memory core; a cold one comes back hot, with its dates cleared."""
    cfg = replace(DEFAULT, core_access_threshold=3, core_stability_threshold=0.5, core_session_threshold=3)
    e = MemoryEngine(spark, str(tmp_path / "s"), topics(), cfg)
    e.add(spark.createDataFrame([("likes tea", "semantic", 0.6, "s1")], "content string, category string, importance double, session_id string"), NOW)
    e.update(spark.createDataFrame([(e.memories().first()["ingest_seq"], 3, False, NOW)], "ingest_seq long, days_at_floor int, is_cold boolean, cold_us long"))
    for k in range(1, 4):
        e.commit(e.search("tea", NOW + 7 * k * DAY, session=f"s{k + 1}"), NOW + 7 * k * DAY)
        row = e.memories().first()
        assert row["session_count"] == k + 1 and row["cold_us"] is None
        if row["category"] == "core":
            break
    assert row["category"] == "core" and set(row["sessions"]) >= {"s1", "s2", "s3"}


def test_rows_of_one_session_are_no_conflict(spark, tmp_path):
    e = MemoryEngine(spark, str(tmp_path / "s"), topics())
    rows = [("likes tea", "a_perspective_1"), ("drinks tea", "a_perspective_2")]
    e.add(spark.createDataFrame(rows, "content string, session_id string"), NOW)
    assert e.conflicts().count() == 0
    e.add(spark.createDataFrame([("hates tea", "b")], "content string, session_id string"), NOW)
    assert e.conflicts().count() == 2
    e.tick(NOW, F.lit("CONTRADICTION"))
    assert e.memories().where("contradicted_by IS NOT NULL").count() >= 1


def test_a_crash_between_write_and_manifest(spark, tmp_path, monkeypatch):
    from cinderbase.sources.store import Snapshots

    snap = Snapshots(spark, str(tmp_path / "s"))
    snap.commit(spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(Snapshots, "_publish", lambda self, new: (_ for _ in ()).throw(OSError("lost")))
        try:
            snap.commit(spark.range(5))
        except OSError:
            pass
    assert snap.version() == 1 and snap.read().count() == 3
    assert snap.commit(spark.range(7)) == 2 and snap.read().count() == 7 and snap.read(1).count() == 3
    try:
        snap._publish(2)
        raise AssertionError
    except RuntimeError:
        pass


def test_nulls_of_a_delta(spark):
    from cinderbase.operators import mutate

    old = spark.createDataFrame([(1, 5, 6), (2, 7, 8)], "ingest_seq long, a int, b int")
    new = spark.createDataFrame([(1, None, None)], "ingest_seq long, a int, b int")
    assert sorted(map(tuple, mutate.apply_delta(old, new, nulls=("a",)).collect())) == [(1, None, 6), (2, 7, 8)]


def test_summaries_by_a_model_and_prompts(spark, tmp_path):
    from cinderbase.plans import ingest

    e = MemoryEngine(spark, str(tmp_path / "s"), topics(), replace(DEFAULT, consolidation_group_size=3), compress=lambda contents: "model: " + str(len(contents)))
    e.add(spark.createDataFrame([("tea a",), ("tea b",), ("tea c",)], "content string"), NOW)
    e.consolidate(NOW + 900 * DAY)
    assert e.memories().where("content = 'model: 3'").count() == 1
    shown = spark.range(1).select(ingest.extraction_prompt(F.lit("hello"), "Only facts.").alias("p")).first()["p"]
    assert "Only facts." in shown and shown.endswith("hello")


def test_spanning_edges_keep_the_components(spark, monkeypatch):
    import numpy as np

    from cinderbase.operators import similarity
    from cinderbase.plans import maintain

    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(1)
    x = np.concatenate([c + 0.25 * rng.standard_normal((12, 8)) for c in rng.standard_normal((6, 8))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= 0.8
    label = np.arange(len(x))
    while True:
        new = np.where(near, label[None, :], len(x)).min(axis=1)
        if (new == label).all():
            break
        label = new
    rows = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(x)], "grp string, id long, vec array<double>")
    assert {r["id"]: r["label"] for r in maintain.components(rows, 0.8).collect()} == dict(enumerate(label.tolist()))
    assert similarity.spanning_edges(rows, 0.8).count() < near.sum() / 2


def test_shift_register_embedding():
    from cinderbase.providers import HashEmbedder

    def int32(v):
        v &= 0xFFFFFFFF
        return v - (1 << 32) if v >= 1 << 31 else v

    text, a, b = "grün 𝄞", 0x811C9DC5, 0x01000193
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        unit = raw[k] | raw[k + 1] << 8
        a, b = int32(int32(a) ^ unit) * 0x01000193, int32(int32(b) ^ unit) * 0x811C9DC5
    seed, want = int32(a) ^ int32(b), []
    for _ in range(128):
        seed = int32(seed ^ int32(seed << 13))
        seed = int32(seed ^ (seed >> 17))
        seed = int32(seed ^ int32(seed << 5))
        want.append((seed & 0xFFFFFFFF) / 0xFFFFFFFF * 2 - 1)
    n = sum(v * v for v in want) ** 0.5
    got = HashEmbedder().embed_batch([text, ""])[0]
    assert all(abs(g - w / n) < 1e-9 for g, w in zip(got, want))
