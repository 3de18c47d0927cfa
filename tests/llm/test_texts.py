import random

import numpy as np
import pytest

from cinderbase.llm import leaks, mixing, truncation

ITEM = ("In 1951, the heron breeds 926 hectares north of Komtei, as Quorks noted in 1731. Lodrei of Seifa enlarged the brewery until the flood of 1577. "
        "After the auction of 1567, Sofla and Quous shared one garden despite the old ground. The ruined quarry was catalogued by weavers from Touske, as Grerr noted in 1911.")  # fmt: skip
OTHER = ("Near Gastu, the grey moth breeds 99 tonnes east of Tugrou until the siege of 1602. By 1960, Prethru of Tugrou leased the canal, though the parish roll disagrees. "
         "Some 76 years later, Hopred rebuilt the archive at the cost of 2666 barrels of oats. Trade in slate passed through Mufli, 629 tonnes from Jeised.")  # fmt: skip
DOC = "doc_id long, text string, source string, item_id long, item_text string"
FILLER = "The name is of uncertain origin. Little else is known about it. A lower mill stood beside the canal of Fark despite the windy ground. " * 3


def found(spark, texts, items=((1, ITEM), (2, OTHER))):
    docs = spark.createDataFrame([(i, t, "s", 9, "clash") for i, t in enumerate(texts)], DOC)
    rows = spark.createDataFrame(list(items), "item_id long, item_text string")
    return {(r["item_id"], r["doc_id"]) for r in leaks.leaked(leaks.find_leaks(docs, rows)).collect()}


def test_leaks_survive_changes(spark):
    sentences = ITEM.split(". ")
    typos = ITEM.replace("Quorks", "Quroks").replace("heron", "hreon").replace("garden", "park").replace("brewery", "school")
    markup = ITEM.replace("the heron", "[[Grey heron|the heron]]").replace("Komtei", "'''Komtei'''").replace("1731.", "1731.<ref>{{cite|title=X|year=1900}}</ref>")
    entities = ITEM.replace(" ", "&nbsp;").replace("e", "&#101;")
    texts = [
        FILLER + ITEM + FILLER, FILLER + ". ".join(reversed(sentences)), FILLER + typos, FILLER + markup, FILLER + entities, ITEM.upper(),
        FILLER + " ".join(ITEM.split()[:30]) + " " + FILLER, FILLER, None, "", ITEM.split(",")[0], FILLER + ITEM + " " + OTHER,
    ]
    assert found(spark, texts) == {(1, 0), (1, 1), (1, 2), (1, 3), (1, 4), (1, 5), (1, 6), (1, 11), (2, 11)}


def test_stock_phrases_and_subjects_are_no_leaks(spark):
    rnd = random.Random(1)
    name = lambda: "".join(rnd.choice("bdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)).capitalize()
    same_templates = " ".join(
        f"In {rnd.randint(1500, 1990)}, the heron breeds {rnd.randint(2, 999)} hectares north of {name()}, as {name()} noted in {rnd.randint(1500, 1990)}. "
        f"{name()} of {name()} enlarged the brewery until the flood of {rnd.randint(1500, 1990)}. The ruined quarry was catalogued by weavers from {name()}, as {name()} noted in {rnd.randint(1500, 1990)}."
        for _ in range(5)
    )
    subject = "Komtei is a village. Quorks, Lodrei and Seifa met Sofla near Touske. " * 4
    assert found(spark, [same_templates, subject]) == set()


def test_reparameterised_items_and_blocks(spark, monkeypatch):
    swap = {"1951": "1822", "926": "37", "Komtei": "Zabru", "Quorks": "Vinto", "1731": "1650", "Lodrei": "Marpo", "Seifa": "Dulke", "1577": "1401", "1567": "1444", "Sofla": "Perru", "Quous": "Tolla", "Touske": "Gibbo", "Grerr": "Haxou", "1911": "1999"}
    text = ITEM
    for a, b in swap.items():
        text = text.replace(a, b)
    docs = spark.createDataFrame([(0, text, "s", 0, "")], DOC)
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, item_text string")
    got = leaks.find_leaks(docs, items)
    assert [(r["item_id"], r["kind"]) for r in got.where("kind = 'reparameterised'").collect()] == [(1, "reparameterised")] and leaks.leaked(got).count() == 1
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 10)
    assert found(spark, [FILLER + ITEM, OTHER]) == {(1, 0), (2, 1)}
    assert found(spark, [FILLER], items=[(3, ""), (4, None)]) == set() and found(spark, []) == set()


def texts_of(source, limit, n, rnd, end="."):
    out = []
    for i in range(n):
        t = " ".join(f"word{rnd.randint(1, 99)} and more" for _ in range(rnd.randint(20, 90))) + end
        out.append((t[:limit] if limit else t, source, limit is not None and len(t) > limit and not t[:limit].endswith(".")))
    return out


def test_truncation_against_truth(spark):
    rnd = random.Random(2)
    made = texts_of("whole", None, 200, rnd) + texts_of("limited", 700, 200, rnd) + [(t[: rnd.randint(40, len(t) - 30)] + left, "whole", True) for (t, *_), left in zip(texts_of("x", None, 20, rnd), ["", "...", "…", "�", "&nb", " [..."[:0], " [...]", "<re"] * 3)]
    made += [("'''A''' is here.\n[[Category:B]]", "whole", False), ("A.\n* [[B]] (1937)", "whole", False), ("A.\n{|\n|-\n| x || 1\n|-\n| y ||", "whole", True), ("A.\n{|\n| x\n|}", "whole", False),
             ("B is.\n{{Infobox\n| name = B\n| ti", "whole", True), ("A.\n== See also ==", "whole", False), ("A.\nCode: PRI-1471\nFounded: 1592", "whole", False), ("A (see [[B", "whole", True), ("A.\n{{Reflist}}", "whole", False),
             ("See [[Quax Hollow).", "whole", False), ("It ends.<ref>{{cite|title=Z}}</ref>", "whole", False), ("* https://a.test/b", "whole", False)]
    rows = [(i, t, s, "clash") for i, (t, s, _) in enumerate(made)] + [(9001, None, "whole", ""), (9002, "", "whole", ""), (9003, "It ends here.", None, ""), (9004, "It ends her", None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, row_key string")
    out = {r["row_key"]: r["cut"] for r in truncation.detect(df).collect()}
    want = {i: c for i, (*_, c) in enumerate(made)}
    wrong = [(made[i][0][-40:], c) for i, c in want.items() if out[i] != c]
    assert len(wrong) <= 3, wrong  # a cut may fall on a whole sentence
    assert 9001 not in out and 9002 not in out and not out[9003] and out[9004]
    rates = {r["source"]: r for r in truncation.source_rates(df).collect()}
    assert rates["limited"]["usual_limit"] == 700 and rates["limited"]["n_cut_at_limit"] > 50 and rates[None]["n_texts"] == 2
    assert truncation.detect(df.limit(0)).count() == 0 and truncation.source_rates(df.limit(0)).count() == 0


def test_limit_in_bytes_and_at_word_ends(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(300):
        t = " ".join(rnd.choice(["grün", "Föhre", "alt", "straße", "und"]) for _ in range(rnd.randint(60, 260))) + "."
        rows.append((i, t.encode()[:900].decode(errors="ignore"), "bytes", len(t.encode()) > 900))
        w = t[:800].rsplit(" ", 1)[0] if len(t) > 800 else t
        rows.append((1000 + i, w, "words", len(t) > 800))
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    out = {r["row_key"]: r for r in truncation.detect(df).collect()}
    assert all(out[i]["cut"] == c for i, _, _, c in rows)
    limit = [out[i]["at_limit"] for i, _, s, c in rows if c and s == "bytes"]
    assert sum(limit) > 0.5 * len(limit)


TARGETS = "source string, target_share double, max_repeats int, n_tokens int"


def test_mix_meets_targets(spark):
    rows = [(i, "one two three four " * (i % 5 + 1), "big", 0) for i in range(3000)] + [(5000 + i, "five six seven", "small", 0) for i in range(60)] + [(9000, "x", "none", 0), (9001, None, "big", 0), (9002, "", "small", 0), (9003, "text", None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, block int")
    targets = spark.createDataFrame([("big", 0.6, 1, 0), ("small", 0.3, 4, 0), ("absent", 0.1, 2, 0), (None, 0.1, 1, 0)], TARGETS)
    plan = mixing.mix(docs, targets, exact=True)
    shares = {r["source"]: r for r in plan.shares.collect()}
    assert shares["big"]["actual_share"] == pytest.approx(2 / 3, abs=0.02) and shares["small"]["actual_share"] == pytest.approx(1 / 3, abs=0.02)
    assert shares["absent"]["tokens_used"] == 0 and shares["small"]["most_uses"] <= 4 and plan.exponent == 0
    used = plan.selection.collect()
    assert {r["source"] for r in used} == {"big", "small"} and max(r["pass"] for r in used if r["source"] == "big") == 0
    assert sum(r["n_tokens"] for r in used) == sum(r["tokens_used"] for r in shares.values())
    again = mixing.mix(docs.repartition(5), targets, exact=True).selection.collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, used))
    bigger = mixing.mix(docs, targets, size=10 * sum(r["tokens_used"] for r in shares.values()))
    assert all(r["most_uses"] <= r["max_repeats"] for r in bigger.shares.collect())
    assert mixing.mix(docs.limit(0), targets).selection.count() == 0 and mixing.mix(docs, targets.limit(0)).selection.count() == 0


def test_temperature():
    natural = {"a": 0.7, "b": 0.2, "c": 0.1}
    a = mixing.exponent_for_entropy(natural, 1.0)
    assert mixing.entropy(mixing.tempered(natural, None, a)) == pytest.approx(1.0, abs=1e-9)
    target = {"a": 0.1, "b": 0.1, "c": 0.8}
    exponent, w, size = mixing.plan({"a": 700, "b": 200, "c": 100}, target, {"a": 2, "b": 2, "c": 2}, size=600)
    assert 0 < exponent < 1 and size * w["c"] == pytest.approx(200, rel=1e-6)


def test_token_counts_are_the_tokenizers(spark):
    df = spark.createDataFrame([(1, "Hello world, grün 123!", "s")], "doc_id long, text string, source string")
    import tiktoken  # noqa: F401

    assert mixing.token_counts(df).first()["n_tokens"] == len(mixing._encoder("t", open(mixing.TOKENIZER, "rb").read()).encode_ordinary("Hello world, grün 123!"))


def test_caps_temper_by_default(spark):
    """The exponent lies between 0 and 1, decides the rows, and each pass permutes the blocks anew."""
    docs = spark.createDataFrame([(i, "one two three four " * (i % 5 + 1), "big") for i in range(3000)] + [(5000 + i, "five six seven", "small") for i in range(200)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("small", 0.5, 4, 0)], TARGETS)
    plan = mixing.mix(docs, targets)
    rows = plan.selection.collect()
    exact = mixing.mix(docs, targets, exact=True).selection.collect()
    assert 0 < plan.exponent < 1 and len(rows) > len(exact)
    shares = {r["source"]: r for r in plan.shares.collect()}
    assert abs(shares["small"]["actual_share"] - shares["small"]["planned_share"]) < 0.01 and shares["small"]["most_uses"] == 4
    first, last = ({r["doc_id"]: r["block_place"] for r in rows if r["source"] == "small" and r["pass"] == p} for p in (0, 2))
    assert first.keys() == last.keys() and first != last
    big = sorted(r["position"] for r in rows if r["source"] == "big")
    assert 0 <= big[0] and big[-1] < 1 and len(set(big)) > 20


def test_the_histogram_decides(spark, monkeypatch):
    """At a limit a broken list line and a leftover after a whole sentence are cut; elsewhere, or without spikes, they are not."""
    rng = np.random.default_rng(5)
    rows = [(i, "".join("word "[k % 5] for k in range(400))[:399] + "x", "s") for i in range(30)]
    listed, left = "* oats and barley from the", "All was well. ..."
    rows += [(100, "x" * (400 - len(listed) - 1) + "\n" + listed, "s"), (101, "y" * (400 - len(left) - 1) + " " + left, "s")]
    rows += [(200, "x" * 250 + "\n" + listed, "s"), (201, "y" * 240 + " " + left, "s"), (202, "A whole text stands here.", "s"), (203, "This one breaks off in the mid", "s")]
    rows += [(300 + i, "z " * int(rng.integers(20, 180)) + "end.", "s") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    how = {r["row_key"]: r["how"] for r in truncation.detect(docs).collect()}
    assert (how[100], how[101], how[200], how[201], how[202], how[203]) == ("limit", "limit", None, None, None, "transfer")
    monkeypatch.setattr(truncation, "MIN_AT_SPIKE", 1000)
    off = {r["row_key"]: r["how"] for r in truncation.detect(docs).collect()}
    assert off[100] is None and off[101] is None and off[203] == "transfer"


def test_leaks_do_not_depend_on_the_blocks(spark, data, monkeypatch):
    from cinderbase.session import table

    docs, items = table(spark, data, "documents"), table(spark, data, "eval_items")
    want = sorted(map(tuple, leaks.find_leaks(docs, items).collect()))
    monkeypatch.setattr(leaks, "BLOCK_TOKENS", 3000)
    assert want and sorted(map(tuple, leaks.find_leaks(docs, items).collect())) == want
