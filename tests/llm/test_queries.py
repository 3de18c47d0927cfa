import re

from cinderbase.llm import queries as q

COLUMNS = {
    "p1_found": ["ingest_seq", "kind"], "p2_found": ["ingest_seq", "group_seq"], "p3_found": ["seq_a", "seq_b"], "p6_found": ["item_id", "doc_id"], "p8_found": ["doc_id"],
}


def test_queries_run(spark, data):
    for name, f in q.queries().items():
        df = f(spark, data)
        if name in COLUMNS:
            assert df.columns == COLUMNS[name]
        assert df.count() > 0 or name in ("p2_found", "p2_clusters"), name


def test_names_and_imports():
    from pathlib import Path

    root = Path(q.__file__).resolve().parents[1]
    outside = [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"cinderbase\.llm|from cinderbase import llm", p.read_text())]
    assert not outside and set(q.oracle_sql()) <= set(q.queries())
