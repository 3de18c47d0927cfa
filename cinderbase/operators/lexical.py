"""BM25 over white-space tokens. Only the query's tokens are counted; the corpus is read once for its statistics and once for the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbase.functions.text import tokenize

K1, B = 1.2, 0.75


def _frequency(word: str) -> Column:
    return F.size(F.filter("tokens", lambda t: t == word)).cast("double")


def bm25(corpus: DataFrame, query: str, k: int) -> DataFrame:
    """The k best rows ``ingest_seq, bm25`` of a corpus with ``ingest_seq, content``; every occurrence of a query token counts."""
    words = query.lower().split()
    distinct = list(dict.fromkeys(words))
    docs = corpus.select("ingest_seq", tokenize(F.col("content")).alias("tokens"))
    docs = docs.select("ingest_seq", F.size("tokens").cast("double").alias("len"), *[_frequency(w).alias(f"tf{i}") for i, w in enumerate(distinct)])
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).cast("double").alias(f"df{i}") for i in range(len(distinct))])
    scored = docs.crossJoin(F.broadcast(stats))  # the statistics are one row
    total = F.lit(0.0)
    for i, w in enumerate(distinct):
        idf = F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5) + 1)
        tf = F.col(f"tf{i}")
        total = total + F.lit(float(words.count(w))) * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    found = " OR ".join(f"tf{i} > 0" for i in range(len(distinct))) or "false"
    return scored.where(found).select("ingest_seq", F.round(total, 6).alias("bm25")).orderBy(F.desc("bm25"), "ingest_seq").limit(k)
