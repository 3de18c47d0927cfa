from cinderbase.llm import queries


def test_caps_temper_a_mix_of_all_available_tokens(spark, data):
    rows = queries.p7_shares(spark, data).collect()
    used, there = sum(r["tokens_used"] for r in rows), sum(r["tokens_available"] for r in rows if r["target_share"] > 0)
    assert 0 < rows[0]["exponent"] <= 1 and len({r["exponent"] for r in rows}) == 1
    assert 0.95 * there <= used <= there
    assert all(r["most_uses"] <= r["max_repeats"] for r in rows)
    assert all(abs(r["actual_share"] - r["planned_share"]) < 0.02 for r in rows)
    assert any(r["most_uses"] == r["max_repeats"] > 1 and r["tokens_used"] > 0.9 * r["max_repeats"] * r["tokens_available"] for r in rows)
