import re

import pytest

from cinderbase.llm import privacy
from cinderbase.llm.privacy import Lexicon, find, normalise, surrogate

LEX = Lexicon([("Zoge", "given"), ("Hope", "given"), ("Clover", "given"), ("Luski", "family"), ("Field", "family"), ("Winter", "family")])


def kinds(text):
    return [(text[a:b], k) for a, b, k in find(text, LEX)]


@pytest.mark.parametrize("text,want", [
    ("Send the file to a.b@hq.test now", [("a.b@hq.test", "email")]),
    ("at ann (at) mail (dot) boz (dot) test, thanks", [("ann (at) mail (dot) boz (dot) test", "email")]),
    ("next to runpre dot thor at gurer dot invalid", [("runpre dot thor at gurer dot invalid", "email")]),
    ("x＠y.example", [("x＠y.example", "email")]), ("<mailto:a-b@c.test>", [("a-b@c.test", "email")]), ("JEJU[@]KUV.TEST", [("JEJU[@]KUV.TEST", "email")]),
    ("Call +44 7700 900215.", [("+44 7700 900215", "phone")]), ("Mobile: five five five, oh one two three.", [("five five five, oh one two three", "phone")]),
    ("Fax 555-0198 ext. 151, voicemail", [("555-0198 ext. 151", "phone")]), ("tel (842) 555-0123", [("(842) 555-0123", "phone")]), ("030/23125-210 next", [("030/23125-210", "phone")]),
    ("Call +３３ １ ９９ ００ ９７ ５８ after", [("+３３ １ ９９ ００ ９７ ５８", "phone")]),
    ("tel 030/23125-530 538-6162 points for", [("030/23125-530", "phone")]), ("+44 7700 900215 2024-03-06", [("+44 7700 900215", "phone")]), ("Call 07700 900 417 58643 Trou", [("07700 900 417", "phone")]),
    ("renew my passport, X37243213", [("X37243213", "id_number")]), ("goes to Brinstr. 100 please", [("Brinstr. 100", "address")]),
    ("Ticket 198-214-3442 about the terminal", []), ("330-9390 points for the team", []), ("Part number 371-36-8934 fits", []), ("Batch 8686 8379 5970 9188 passed", []),
    ("Order no. 9622-83107 arrived", []), ("The terminal runs build 4.6.23.224.", []), ("Use the range 2024-03-06 to 2024-04-09.", []), ("Coordinates 40.2926, 15.2378 mark", []),
    ("Social security number 930-19-4110.", [("930-19-4110", "id_number")]), ("NI number PR416401C on file", [("PR416401C", "id_number")]), ("CURP ZXLW078543LMWLZS48.", [("ZXLW078543LMWLZS48", "id_number")]),
    ("Steuer-ID 32 825 565 176.", [("32 825 565 176", "id_number")]), ("insurance id XJ 93 04 59 D for payroll", [("XJ 93 04 59 D", "id_number")]), ("Tax id form 63 is due", []),
    ("Identity card rules changed, see page 895", []), ("id 29866267 of the scanner log", []), ("SSN was asked for but never given", []),
    ("Lives at 1505 Drabu Ave Apt 3, Landville 19617", [("1505 Drabu Ave Apt 3", "address")]), ("home: Dritreskstraße 153a, 77579 M", [("Dritreskstraße 153a", "address")]),
    ("to Calle Fovu 211, 5º B, P", [("Calle Fovu 211, 5º B", "address")]), ("78 rue Greskidrus, 81722 G", [("78 rue Greskidrus", "address")]), ("Flat 21, 76 Stil Road, W", [("Flat 21, 76 Stil Road", "address")]),
    ("in the 135 w. zouteind blvd.", [("135 w. zouteind blvd.", "address")]), ("Hepark Street was closed", []), ("Booked room 21B on level 28", []),
    ("My dentist is Zoge Luski.", [("Zoge Luski", "person")]), ("zoge luski's terminal is broken", [("zoge luski", "person")]), ("Reports to Ms Hope K. FIELD since", [("Hope K. FIELD", "person")]),
    ("Mi jefa se llama Велисей Крапинова.", [("Велисей Крапинова", "person")]), ("user: ask Vofa Brimu about the handover", [("Vofa Brimu", "person")]), ("ask Brari Press about the handover", []),
    ("Plans tea with Sháe Choir in Quandora", []), ("Compared Hope, Olive and Rowan as paint shades", []), ("The Luski Winter Festival is in X", []), ("Mount Luski and Lake Field are", []),
    ("call me later please", []), ("The lease is under review.", []), (None, []), ("", []), ("x" * 20000, []),
])
def test_mentions(text, want):
    assert (kinds(text) if text else find(text, LEX)) == want


def test_without_lexicon():
    assert [k for *_, k in find("Dr. Bata Thuki signed the form. a@b.test", Lexicon([]))] == ["person", "email"]


def test_surrogates_keep_form_and_coreference():
    key = b"k"
    a = surrogate(key, "phone", "442079460312", "+44 20 7946 0312", "u", 0)
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}", a) and a != "+44 20 7946 0312"
    assert normalise("email", "A (at) B (dot) test") == normalise("email", "a@b.test") == "a@b.test"
    assert normalise("phone", "０７７００ ９００ １") == normalise("phone", "07700 900 1")
    one, two = surrogate(key, "person", "zoge luski", "Zoge Luski", "f", 0), surrogate(key, "person", "zoge luski", "zoge LUSKI", "f", 0)
    assert one.lower() == two.lower() and two.split()[1].isupper() and one.split()[0].endswith("a")
    assert surrogate(key, "person", "zoge luski", "Luski, Zoge", "f", 0).lower() == ", ".join(reversed(one.lower().split()))
    ru = surrogate(key, "person", "велисей крапинова", "Велисей Крапинова", "f", 0)
    assert re.fullmatch(r"[Ѐ-ӿ]+ [Ѐ-ӿ]+ова", ru)
    assert surrogate(key, "id_number", "pr416401c", "PR416401C", "u", 0) != surrogate(b"other", "id_number", "pr416401c", "PR416401C", "u", 0)


def test_redaction(spark):
    rows = [(1, "Call +44 7700 900215 or a@b.test", "c"), (2, "a (at) b (dot) test it is", "c"), (3, None, None), (4, "", "c"), (None, "Ring +44 7700 900215", "c"), (1, "Call +44 7700 900215 or a@b.test", "c"), (1, "none here", "c")]
    texts = spark.createDataFrame(rows, "ingest_seq long, content string, row_key string")
    names = spark.createDataFrame([("Zoge", "given"), (None, "family"), ("Zoge", "given")], "person_name string, name_role string")
    out = privacy.redact(texts, names, "secret").collect()
    assert len(out) == len(rows)
    by = {(r["row_key"], r["n_mentions"]): r["redacted"] for r in out}
    phone = re.search(r"<PHONE:([^>]+)>", by[1, 2])[1]
    assert f"Ring <PHONE:{phone}>" == by[None, 1] and by[3, 0] is None and by[4, 0] == "" and by[1, 0] == "none here"
    mail = re.search(r"<EMAIL:([^>]+)>", by[1, 2])[1]
    other = re.search(r"<EMAIL:([^>]+)>", by[2, 1])[1]
    assert normalise("email", mail) != "a@b.test" and other.endswith("(dot) test") and by[2, 1].endswith(" it is")
    kinds = {(r[0], r[1]) for r in privacy.kinds_found(privacy.redact(texts, names, "secret")).collect()}
    assert kinds == {(1, "phone"), (1, "email"), (2, "email"), (None, "phone")}
    assert privacy.redact(texts.limit(0), names.limit(0), "s").count() == 0


def test_surrogates_stay_distinct(spark):
    texts = spark.createDataFrame([(i, f"Ring +44 20 7946 {i:04d} now") for i in range(3000)], "ingest_seq long, content string")
    found = privacy.mentions(texts, spark.createDataFrame([], "person_name string, name_role string"))
    e = privacy.entities(found, b"k").collect()
    assert len(e) == 3000 == len({r["fresh"] for r in e}) and not {r["fresh"] for r in e} & {r["norm"] for r in e}


#: Sentences of no generator (the first five and some values were named by a review and the cues widened after it): (text, kind, value), or (text, None, None) where nothing is private.
HELD_OUT = [
    ("Yesterday I met Margaret Thornbury at the station.", "person", "Margaret Thornbury"), ("Kwame Osei-Bonsu will present the results.", "person", "Kwame Osei-Bonsu"),
    ("Please call Tobias Achterberg back.", "person", "Tobias Achterberg"), ("Priya Raghunathan's report is late.", "person", "Priya Raghunathan"), ("I asked Bram Vandersteen for the key.", "person", "Bram Vandersteen"),
    ("Her cousin Ines Carvalho moved to Porto.", "person", "Ines Carvalho"), ("The parcel is from Oluwaseun Adeyemi, who lives next door.", "person", "Oluwaseun Adeyemi"), ("We had lunch with Sinead O'Rourke.", "person", "Sinead O'Rourke"),
    ("We live at 14 Rosewood Gardens now.", "address", "14 Rosewood Gardens"), ("Send it to 12 Via Garibaldi.", "address", "12 Via Garibaldi"), ("Ik woon op Keizersgracht 241.", "address", "Keizersgracht 241"),
    ("Her driver's licence number is D1234567.", "id_number", "D1234567"), ("My mobile is 138 1234 5678.", "phone", "138 1234 5678"), ("Mail j.doe+home@mail.example.org please.", "email", "j.doe+home@mail.example.org"),
    ("The meeting is in Green Valley on Monday.", None, None), ("Order 138 units of part 5567-1234.", None, None), ("The North Sea was rough.", None, None), ("Version 2.14.1034 fixed it.", None, None),
]


def test_held_out_sentences():
    lex = privacy.Lexicon([])
    right = 0
    for text, kind, value in HELD_OUT:
        got = [(text[s:e], k) for s, e, k in privacy.find(text, lex)]
        right += got == ([(value, kind)] if kind else [])
    assert right >= 0.9 * len(HELD_OUT)


def test_surrogates_keep_script_and_notation():
    key = b"k"
    for name in ("李伟", "Γιώργος Νικολάου", "محمد حسن"):
        new = privacy.surrogate(key, "person", privacy.normalise("person", name), name, "u", 0)
        assert new != name and [privacy._letters(c) for c in new] == [privacy._letters(c) if privacy._letters(c) else None for c in name]
    notations = ["+1 (555) 123-4567", "(555) 123-4567", "555.123.4567", "(555) 123-4567 ext. 12"]
    assert len({privacy.normalise("phone", n) for n in notations}) == 1
    norm = privacy.normalise("phone", notations[0])
    assert len({privacy.normalise("phone", privacy.surrogate(key, "phone", norm, n, "u", 0)) for n in notations}) == 1


def test_found_kinds_are_what_was_replaced(spark):
    texts = spark.createDataFrame([(1, "Mail a@b.example or call Dr. Anna Berg."), (2, "Nothing here."), (3, None)], "ingest_seq long, content string")
    names = spark.createDataFrame([("Anna", "given"), ("Berg", "family")], "person_name string, name_role string")
    out = privacy.redact(texts, names, "s")
    assert {tuple(r) for r in privacy.kinds_found(out).collect()} == {(1, "email"), (1, "person")}
