"""Text expressions: tokens, heuristics, templates and the parsing of model replies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words the importance and category heuristics look for, and words that are no topics.
DECISION = ("decided", "chose", "will", "must", "should", "need to", "plan to")
PERSONAL = ("i ", "my ", "we ", "our ", "me ")
TEMPORAL = ("yesterday", "tomorrow", "next week", "next month", "deadline")
SENTIMENT = ("love", "hate", "critical", "urgent")
PROCEDURAL = ("how to", "step 1", "first", "then", "next", "finally", "instructions")
EPISODIC = ("yesterday", "today", "last week", "last month", "happened", "went", "saw", "met", "talked", "was", "were", "did")
STOP_WORDS = tuple(
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did "
    "will would should could can may might must i you he she it we they".split()
)
VERDICTS = ("CONTRADICTION", "UPDATE", "OVERLAP", "NONE")
MEMORY_TYPES = ("fact", "preference", "plan", "transient_state", "other")
CATEGORIES = ("episodic", "semantic", "procedural", "core")
REPLY_SCHEMA = "array<struct<content:string,category:string,importance:string,memory_type:string,valid_from:string,valid_until:string,ttl_seconds:string,source_turn_ids:array<string>>>"


def tokenize(text: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


def session_root(session: Column) -> Column:
    return F.regexp_replace(session, "_perspective_.*$", "")


def strip_fence(text: Column) -> Column:
    text = F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", "")
    return F.regexp_replace(text, r"\s*```$", "")


def any_of(text: Column, words: Iterable[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def _worth(cond: Column, value: float) -> Column:
    return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))


def importance(text: Column) -> Column:
    total = F.lit(0.3) + F.least(F.lit(0.2), F.length(text) / 500)
    for words, value in ((DECISION, 0.15), (PERSONAL, 0.1), (TEMPORAL, 0.1), (SENTIMENT, 0.15)):
        total = total + _worth(any_of(text, words), value)
    return F.least(F.lit(1.0), total)


def category(text: Column) -> Column:
    return F.when(any_of(text, PROCEDURAL), "procedural").when(any_of(text, EPISODIC), "episodic").otherwise("semantic")


def topic_words(text: Column) -> Column:
    words = F.split(F.regexp_replace(F.lower(text), r"[^A-Za-z0-9_\s]", ""), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*STOP_WORDS))


def verdict(reply: Column) -> Column:
    out = None
    for v in VERDICTS[:-1]:
        cond = F.upper(reply).contains(v)
        out = F.when(cond, v) if out is None else out.when(cond, v)
    return out.otherwise(VERDICTS[-1])


def stub_text(content: Column) -> Column:
    return F.concat(F.lit("[archived] "), F.substring(content, 1, 200))


def numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def truncated(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def clamp_unit(x: Column) -> Column:
    """Between 0 and 1; null of null and NaN."""
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def raw_turns(text: Column) -> Column:
    """The lines of a conversation, trimmed, without blank ones and bracketed headers; with their position."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("content")))
    return F.filter(lines, lambda t: (t["content"] != "") & ~(t["content"].startswith("[") & t["content"].endswith("]")))


def parse_reply(reply: Column) -> Column:
    """The items of a model's JSON reply; a reply that is no JSON array becomes one episodic item of its text."""
    plain = F.array(F.struct(
        F.substring(reply, 1, 500).alias("content"), F.lit("episodic").alias("category"), F.lit("0.5").alias("importance"), F.lit("other").alias("memory_type"),
        *[F.lit(None).cast("string").alias(c) for c in ("valid_from", "valid_until", "ttl_seconds")], F.lit(None).cast("array<string>").alias("source_turn_ids"),
    ))
    return F.coalesce(F.from_json(strip_fence(reply), REPLY_SCHEMA), plain)


def canonical_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def prompt(template: str, **values: Column) -> Column:
    """A prompt template with ``{name}`` filled from columns."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out
