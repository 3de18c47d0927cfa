"""Vector expressions over arrays; sums are in double precision."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 where a norm is 0, null where a vector is null, an error where lengths differ."""
    n = norm(a) * norm(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in length"))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(same.isNotNull(), F.lit(None)).otherwise(F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, v: s + v))


def normalize(a: Column) -> Column:
    """The unit vector; zeros stay zeros."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, F.lit(0.0)).otherwise(x.cast("double") / n))


def usable(a: Column, dims: int) -> Column:
    """Of the right length, finite and not all zero."""
    return F.coalesce((F.size(a) == dims) & F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(a, lambda x: x != 0), F.lit(False))


def literal(a: Column, digits: int = 4) -> Column:
    """``[x,y,...]`` with non-finite elements as 0."""
    text = F.transform(a, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0)).otherwise(x).cast("double").cast(f"decimal(18,{digits})").cast("string"))
    return F.concat(F.lit("["), F.array_join(text, ","), F.lit("]"))


def parse_literal(text: Column) -> Column:
    """The vector of such a text; null where it is none."""
    return F.from_json(text, "array<double>")


def hash_embed(text: Column, dims: int) -> Column:
    """A deterministic embedding from md5, the same in any SQL engine."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(text, F.lit(":"), i.cast("string"))), 1, 8), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: part(i) / F.lit(4294967296.0) * 2 - 1)
