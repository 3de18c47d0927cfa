"""Text cut off by field limits or in transfer.

For each source and column the lengths of all values, in characters and in bytes, are counted. A
length that is far more frequent than the lengths just below it is a spike. Limits that respect word ends
pile values up just below the limit instead; those are found as spikes of the histogram in steps of
``SOFT_STEP``. At a true limit most values have an open end; a spike of whole texts (copies of one text)
is none.

The histogram decides which of two rules judges a value, and each is reported as a class of its own
(``how``):

``limit``     At a spike a value is cut unless it ends with terminal punctuation or with a whole line of
              another kind. Here a line of a list or of fields counts as whole only if it does not break off
              at a connecting word or mark, and a whole sentence with leftovers of a transfer is cut.
``transfer``  Elsewhere a value is cut only if its end shows it: inside a word, a sentence, a table or a
              template. Lines of a list and of fields, and leftovers after a whole sentence, are let stand as
              slips of editors.

Leftovers of a transfer (an ellipsis, half a tag or entity, a replacement character, an error message) are
taken off before the end is looked at.

Everything runs in the JVM; the text is read once and reduced to a few flags per row. Histograms are
aggregated per source and length, so a hot source is folded before the shuffle.

Defined cases: null and empty texts are not cut; rows without a source form a source of their own;
an empty table gives no rows; repeated rows are each judged alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.session import cut

# What transfers leave at the end of a text.
LEFTOVER = (
    r"(?:\s*(?:\.{3,}|…|\[\s*(?:\.{3}|…)\s*\]|\x{FFFD}+|\x00+|<[/!]?[A-Za-z]{0,12}|&#?\w{0,8}"
    r"|\[\[|\{\{|\((?:connection|transfer|download|response|stream)\b[^)\n]{0,40}\)?"
    r"|\[(?:truncated|cut|more|read more|continued)[^\]\n]{0,30}\]?))+\s*$"
)
FRAGMENT = r"<[/!]?[A-Za-z]{0,12}(?:\.{3}|…|\[(?:\.{3}|…)\]|\s)*$"  # half a tag
CLOSERS = r"(?:[\"'”’»)\]]|<ref[^>]*>[^<]*</ref>|<ref[^>]*/>|\{\{[^{}]*\}\}|\s)*$"
SENTENCE_END = r"[.!?。！？]" + CLOSERS
WHOLE_LINE = (
    r"^(?:=+.*=+|\[\[[^\]\[]*\]\]|\{\{.*\}\}|\|\}|\}\}|<[A-Za-z][^<>]*/>|</?[A-Za-z][^<>]*>|-{4,}|__\w+__"
    r"|\[?https?://\S+(?: [^\]]*\])?|)\s*$"
)
LIST_LINE = r"^\s*[*#;:]"
FIELD_LINE = r"^\p{Lu}[\p{L} ]{0,24}: [^.]{1,40}$"
OPEN_BRACKET = r"(?:\[\[?[^\]\[]*|\([^()]*|\{\{[^{}]*|<[A-Za-z][^<>]*)$"
# Words and marks after which a line goes on.
CONNECTING = r"(?:[,;:(\[–—/&-]|\b(?:a|an|the|of|in|on|at|by|for|from|with|and|or|der|die|das|und|von|im|el|la|los|las|de|del|y|en|le|les|du|des|et))\s*$"

SOFT_STEP, SOFT_BACK, HARD_BACK = 20, 10, 64
MIN_AT_SPIKE, HARD_TIMES, SOFT_TIMES, OPEN_SHARE = 5, 6.0, 3.0, 0.4


def end_flags(text: Column) -> dict[str, Column]:
    """Flags of how a text ends; ``body`` is the text without leftovers."""
    body = F.regexp_replace(text, LEFTOVER, "")
    body = F.regexp_replace(body, r"\s+$", "")
    return {"body": body, "leftover": F.length(body) < F.length(F.regexp_replace(text, r"\s+$", ""))}


def profile(df: DataFrame, column: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row: its lengths and how it ends. One pass over the text, without a shuffle."""
    text = F.col(column)
    out = df.select(F.col(key).alias("row_key"), F.col(source).alias("row_source"), text.alias("t")).where(F.length("t") > 0)
    flags = end_flags(F.col("t"))
    out = out.select("row_key", "row_source", "t", flags["body"].alias("body"), flags["leftover"].alias("leftover"))
    out = out.withColumn("line", F.substring_index("body", "\n", -1))
    table_tail, template_tail = F.substring_index("body", "{|", -1), F.substring_index("body", "{{", -1)
    line = F.col("line")
    in_table = (F.instr("body", "{|") > 0) & ~table_tail.contains("|}") & line.rlike(r"^\s*(?:[|!]|\{\|)")
    in_template = (F.instr("body", "{{") > 0) & ~template_tail.contains("}}") & (~template_tail.contains("\n") | line.rlike(r"^\s*\|"))
    in_template = in_template | (line.rlike(r"^\s*\|[^}]") & ~in_table)
    listed, field = line.rlike(LIST_LINE), line.rlike(FIELD_LINE)
    whole = line.rlike(WHOLE_LINE)
    sentence = line.rlike(SENTENCE_END)
    return out.select(
        "row_key",
        "row_source",
        F.length("t").alias("chars"),
        F.octet_length("t").alias("bytes"),
        "leftover",
        F.col("t").rlike(FRAGMENT).alias("fragment"),
        (in_table | in_template).alias("in_markup"),
        # without a whole sentence, heading, list line, category, template or address at the end
        (~sentence & ~whole & ~listed & ~field).alias("open_end"),
        ((listed | field) & line.rlike(OPEN_BRACKET)).alias("open_item"),
        ((listed | field) & line.rlike(CONNECTING) & ~sentence & ~whole).alias("broken_item"),
    )


OPEN_ENDS = "in_markup OR open_end OR open_item OR leftover"


def hard_spikes(rows: DataFrame) -> DataFrame:
    """``row_source, unit, n, c``: lengths far more frequent than those below, mostly with open ends."""
    lengths = rows.select("row_source", F.expr(OPEN_ENDS).alias("o"), F.explode(F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).cast("long").alias("n")) for u in ("chars", "bytes")])).alias("x"))
    hist = lengths.groupBy("row_source", "x.unit", "x.n").agg(F.count("*").alias("c"), F.count_if("o").alias("n_open"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("row_source", "unit").orderBy("n").rangeBetween(-HARD_BACK, -1)), F.lit(0)) / HARD_BACK
    hist = hist.withColumn("below", below)
    found = hist.where((F.col("c") >= MIN_AT_SPIKE) & (F.col("c") >= HARD_TIMES * F.col("below")) & (F.col("n_open") >= OPEN_SHARE * F.col("c")))
    # a limit counts in one unit; its echo in the other is spread over several lengths
    best = F.max("c").over(Window.partitionBy("row_source"))
    own = F.max("c").over(Window.partitionBy("row_source", "unit"))
    return found.withColumn("best", best).withColumn("own", own).where("own = best").select("row_source", "unit", "n", "c")


def soft_spikes(rows: DataFrame) -> DataFrame:
    """``row_source, step, c``: steps of length just below a limit that respects word ends."""
    # steps count down from each multiple, so a limit at a round length closes its step
    step = F.floor((F.col("chars") - 1) / SOFT_STEP)
    hist = rows.groupBy("row_source", step.alias("step")).agg(F.count("*").alias("c"), F.count_if(F.expr(OPEN_ENDS)).alias("n_open"))
    below = F.coalesce(F.sum("c").over(Window.partitionBy("row_source").orderBy("step").rangeBetween(-SOFT_BACK, -1)), F.lit(0)) / SOFT_BACK
    hist = hist.withColumn("below", below)
    return hist.where((F.col("c") >= MIN_AT_SPIKE) & (F.col("c") >= SOFT_TIMES * F.col("below")) & (F.col("n_open") >= OPEN_SHARE * F.col("c"))).select("row_source", "step", "c")


def detect(df: DataFrame, column: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per row ``row_key, row_source, at_limit, by_limit, cut, how``. The rows' flags are written once and read for the histograms and the verdict."""
    rows = cut(profile(df, column, key, source))
    hard = hard_spikes(rows)
    for unit in ("chars", "bytes"):
        one = hard.where(F.col("unit") == unit).select(F.col("row_source").alias("s"), F.col("n").alias("m"), F.lit(True).alias(f"{unit}_hard"))
        rows = rows.join(one, F.col("row_source").eqNullSafe(F.col("s")) & (F.col(unit) == F.col("m")), "left").drop("s", "m")
    rows = rows.withColumn("at_hard", F.col("chars_hard").isNotNull() | F.col("bytes_hard").isNotNull())
    soft = soft_spikes(rows.where("NOT at_hard")).select(F.col("row_source").alias("s"), F.col("step").alias("m"), F.lit(True).alias("soft"))
    rows = rows.join(soft, F.col("row_source").eqNullSafe(F.col("s")) & (F.floor((F.col("chars") - 1) / SOFT_STEP) == F.col("m")), "left").drop("s", "m")
    at_limit = F.col("at_hard") | F.col("soft").isNotNull()
    unfinished = F.col("in_markup") | F.col("open_end") | F.col("open_item") | F.col("fragment")
    by_limit = at_limit & (unfinished | F.col("broken_item") | F.col("leftover"))
    how = F.when(by_limit, "limit").when(~at_limit & unfinished, "transfer")
    return rows.select("row_key", "row_source", "chars", "bytes", at_limit.alias("at_limit"), by_limit.alias("by_limit"), how.isNotNull().alias("cut"), how.alias("how"), "leftover")


def source_rates(df: DataFrame, **names: str) -> DataFrame:
    """How often each source cuts, and at which length most."""
    found = detect(df, **names)
    per_len = found.where("by_limit").groupBy("row_source", "chars").count()
    top = per_len.groupBy("row_source").agg(F.max(F.struct("count", "chars")).alias("m"))
    rates = found.groupBy("row_source").agg(
        F.count("*").alias("n_texts"), F.count_if("cut").alias("n_cut"), F.count_if("by_limit").alias("n_cut_at_limit"), F.count_if(F.col("how") == "transfer").alias("n_cut_in_transfer")
    )
    return rates.join(top.withColumnRenamed("row_source", "s"), F.col("row_source").eqNullSafe(F.col("s")), "left").select(
        F.col("row_source").alias("source"), "n_texts", "n_cut", "n_cut_at_limit", "n_cut_in_transfer", (F.col("n_cut") / F.col("n_texts")).alias("cut_share"), F.col("m.chars").alias("usual_limit")
    )
