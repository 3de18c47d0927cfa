"""Mixing sources to target weights by temperature.

Sizes are tokens of a public tokenizer, counted over whole texts. A weight is a tempered share,
``w_s ∝ p_s^a * t_s^(1-a)``: at ``a = 0`` the target shares, at ``a = 1`` the natural ones. With no
targets it is the classic temperature mix ``p_s^a``. The exponent is bisected to the smallest one at
which no source needs more than its cap of repetitions at the wanted size, or to a target entropy.
The size is all tokens that the sources with a target have, unless one is given; with ``exact`` it is the
largest one at which the targets can be met as they are, so that nothing is tempered.

The weights become budgets of tokens, realised as block permutations. A source's texts are put into blocks
by a keyed hash, and each pass over the source puts the blocks into a keyed order of its own. Blocks are
taken in that order, pass after pass, until the budget ends inside one; only that block's texts are ordered
and cut by a running sum. So a hot source never needs one sorted list of its texts. ``position`` is the part
of its source's budget that lies before a use: sorted by it, the sources interleave at their weights.

Defined cases: sources without a target, and texts that are null or empty, are left out; a target
without documents keeps its row in the report with nothing used, and its share is spread over the
others in proportion; a null ``max_repeats`` means 1; repeated targets of a source are added up;
copies of a text are texts of their own; empty tables give an empty selection. The last text of a
source stops short of its budget, so a source is under its share by less than one text.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cinderbase.session import cut, ship, small_enough

TEXTS_PER_BLOCK, MOST_BLOCKS, KEY = 20_000, 1 << 20, 20_240_501
#: Bytes of a block's row when the blocks are sent to the executors; beyond the checked size they are joined by a shuffle.
BLOCK_BYTES = 64
#: The vocabulary file, read on the driver and sent to the executors.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern the byte-level vocabulary was trained with (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Targets are a table of sources; their number is checked before they come to the driver.
MAX_SOURCES = 100_000

_ENCODERS: dict = {}


def _encoder(name: str, vocabulary: bytes):
    if name not in _ENCODERS:
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[name] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[name]


def token_counts(df: DataFrame, column: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of whole texts."""

    ship(df.sparkSession)
    sent = df.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())  # of a fixed size, some hundred KB

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(tokenizer, sent.value).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "n_tokens": [len(encode(t)) for t in pdf["text"]]})

    return df.where(F.length(column) > 0).select("doc_id", "source", F.col(column).alias("text")).mapInPandas(count, "doc_id long, source string, n_tokens long")


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def tempered(natural: dict[str, float], target: dict[str, float] | None, a: float) -> dict[str, float]:
    raw = {s: p**a * (target[s] ** (1 - a) if target else 1.0) if p > 0 else 0.0 for s, p in natural.items()}
    total = sum(raw.values())
    return {s: w / total for s, w in raw.items()} if total else raw


def bisect(ok, low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent at which ``ok`` holds, for a condition that holds from some point on."""
    if ok(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if ok(mid) else (mid, high)
    return high


def exponent_for_entropy(natural: dict[str, float], wanted: float) -> float:
    """The exponent of the classic temperature mix whose entropy is the wanted one (entropy falls with the exponent)."""
    return bisect(lambda a: entropy(tempered(natural, None, a)) <= wanted, 0.0, 8.0)


def plan(tokens: dict[str, int], targets: dict[str, float], caps: dict[str, int], size: float | None = None) -> tuple[float, dict[str, float], float]:
    """Exponent, weights and size: the least tempering that respects the caps."""
    present = {s: t for s, t in targets.items() if tokens.get(s, 0) > 0 and t > 0}
    if not present:
        return 0.0, {}, 0.0
    total_target = sum(present.values())
    target = {s: t / total_target for s, t in present.items()}
    have = sum(tokens[s] for s in present)
    natural = {s: tokens[s] / have for s in present}
    room = {s: caps.get(s, 1) * tokens[s] for s in present}
    if size is None:
        size = min(room[s] / target[s] for s in present)
    fits = lambda a: all(size * w <= room[s] * (1 + 1e-9) for s, w in tempered(natural, target, a).items())
    a = bisect(fits)
    return a, tempered(natural, target, a), size


@dataclass
class Mix:
    selection: DataFrame
    shares: DataFrame
    exponent: float


def mix(documents: DataFrame, targets: DataFrame, size: float | None = None, tokenizer: str = TOKENIZER, exact: bool = False) -> Mix:
    """The mix of the wanted size, by default as many tokens as there are; with ``exact`` of the largest size that meets the targets.

    The selection has a row for each use of a text: ``doc_id, source, n_tokens, pass, block_place, position``.
    """
    spark = documents.sparkSession
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("max_repeats"))
    if wanted.count() > MAX_SOURCES:
        raise ValueError("too many sources in the targets")
    rows = wanted.collect()
    share = {r["source"]: float(r["target_share"] or 0) for r in rows}
    caps = {r["source"]: int(r["max_repeats"]) for r in rows}
    # only targeted sources are counted; a broadcast-free semi join keeps others out
    used = documents.join(F.broadcast(spark.createDataFrame([(s,) for s in share] or [("",)], "source string")), "source", "left_semi")
    counted = cut(token_counts(used, tokenizer=tokenizer))
    n_blocks = min(MOST_BLOCKS, max(64, counted.count() // TEXTS_PER_BLOCK))
    counted = counted.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(KEY)), F.lit(n_blocks)).cast("int"))
    blocks = counted.groupBy("source", "block").agg(F.sum("n_tokens").alias("tokens"))
    per_source = {r["source"]: int(r["n"]) for r in blocks.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    if size is None and not exact:
        size = float(sum(per_source.get(s, 0) for s, t in share.items() if t > 0))
    a, weights, total = plan(per_source, share, caps, size)
    budgets = [(s, w, float(min(total * w, caps[s] * per_source[s])), per_source[s]) for s, w in weights.items()]
    budget = spark.createDataFrame(budgets or [("", 0.0, 0.0, 0)], "source string, weight double, budget double, whole long")  # a row per source
    # an order of the blocks for each pass; a pass begins where the one before has used the whole source
    passes = F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("budget") / F.col("whole")).cast("int") - 1)))
    order = Window.partitionBy("source", "pass").orderBy(F.xxhash64("block", "pass", F.lit(KEY + 1)), "block")
    placed = blocks.join(F.broadcast(budget), "source").withColumn("pass", passes)
    placed = placed.withColumns({"block_place": F.row_number().over(order), "end": F.sum("tokens").over(order) + F.col("pass") * F.col("whole")})
    placed = placed.withColumn("start", F.col("end") - F.col("tokens")).where("start < budget")
    placed = placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "block_place", "start", "budget", (F.col("end") > F.col("budget")).alias("edge"))
    most = max([1, *(math.ceil(m / w) for _, _, m, w in budgets)])
    placed = F.broadcast(placed) if small_enough(len(weights) * n_blocks * most, BLOCK_BYTES) else placed
    at = counted.join(placed, (F.col("source") == F.col("s")) & (F.col("block") == F.col("b")))
    inner = Window.partitionBy("source", "pass", "block").orderBy(F.xxhash64("doc_id", F.lit(KEY + 2)), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    edge = at.where("edge").withColumn("run", F.col("start") + F.sum("n_tokens").over(inner)).where(F.col("run") <= F.col("budget")).drop("run")
    chosen = at.where("NOT edge").unionByName(edge)
    selection = chosen.select("doc_id", "source", "n_tokens", "pass", "block_place", F.round(F.col("start") / F.col("budget"), 9).alias("position"))
    sums = selection.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), (F.max("pass") + 1).alias("most_uses"), F.count_if(F.col("pass") == 0).alias("n_texts"))
    everything = sums.agg(F.sum("tokens_used").alias("all_used"))
    known = spark.createDataFrame([(s, share[s], caps[s], weights.get(s, 0.0), per_source.get(s, 0)) for s in share] or [("", 0.0, 0, 0.0, 0)], "source string, target_share double, max_repeats int, weight double, tokens_available long")
    known = known.where("source <> ''") if not share else known
    shares = known.join(sums, "source", "left").crossJoin(F.broadcast(everything)).select(
        "source", "target_share", F.round("weight", 9).alias("planned_share"), F.coalesce(F.col("tokens_used") / F.col("all_used"), F.lit(0.0)).alias("actual_share"),
        "tokens_available", F.coalesce("tokens_used", F.lit(0)).cast("long").alias("tokens_used"), F.coalesce("n_texts", F.lit(0)).alias("n_texts"), F.coalesce("most_uses", F.lit(0)).cast("int").alias("most_uses"), "max_repeats",
    )
    return Mix(selection, shares, a)
