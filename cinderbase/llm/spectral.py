"""Clusters of mutually similar records by power-iteration spectral clustering.

1. Sparse affinities: each vector's nearest neighbours with cosine from ``min_sim``, and a link to the
   neighbour with the smallest id, which keeps a cluster connected. The search leaves out no cell that
   could hold a neighbour, and also gives the number of all neighbours, the sum of their cosines and a
   hash of their set. Pairs within a cluster are never emitted.
2. Power iteration: ``VECTORS`` start vectors, drawn at random for every record, are multiplied
   ``ITERATIONS`` times with the row-normalised affinities. Records of one cluster approach one point of
   the embedding, each cluster a point of its own.
3. k-means on the embedding: seeds are the records without a smaller neighbour; points go to the nearest
   centre, looked up in a grid, and centres are means.
4. Exact check: the records of a k-means cluster that have no smaller neighbour outside it form a group if
   the neighbours of each are exactly the others. What fails the check (overlapping or chained groups, or a
   cluster the embedding did not separate) is repaired: vectors that have the same neighbours count as one,
   then the edges are emitted, the components found by label propagation and the maximal sets listed.
   ``route`` says of each row which way it came.

Members are ranked by their internal affinity, the sum of their cosines to the others.

Defined cases: rows without id, category or usable vector, and rows with null or NaN retention, are in
no cluster; categories are compared trimmed and in lower case; exact copies count as members each;
an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderbase.llm import neighbours
from cinderbase.session import cut

VECTORS, ITERATIONS, ROUNDS, NEAREST = 6, 10, 2, 8
#: Side of a grid cell, and how many coordinates have one; a point looks for centres in its own and adjacent cells.
GRID, GRID_COORDINATES = 0.03, 3
NAMES = [f"e{v}" for v in range(VECTORS)]


def fading(memories: DataFrame, below: float = 0.20) -> DataFrame:
    category = F.lower(F.regexp_replace("category", r"^\s+|\s+$", ""))
    rows = memories.where((F.col("retention") < below) & F.col("category").isNotNull())
    return rows.select(category.alias("part"), F.col("ingest_seq").alias("id"), F.col("embedding").alias("vec")).where("id IS NOT NULL").where(neighbours.usable(F.col("vec")))


def affinities(found: DataFrame) -> DataFrame:
    """Symmetric sparse affinities ``i, j, w`` with a loop of weight 1 at each node."""
    top = found.select(F.col("node").alias("i"), F.explode("top").alias("t")).select("i", F.col("t.id").alias("j"), F.col("t.sim").alias("w"))
    least = found.where("least IS NOT NULL").select(F.col("node").alias("i"), F.col("least").alias("j"), F.lit(None).cast("double").alias("w"))
    one = top.unionByName(least)
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    # the smallest neighbour's cosine is known only if it is among the nearest; its link counts as the weakest possible
    edges = both.groupBy("i", "j").agg(F.coalesce(F.max("w"), F.lit(0.8)).alias("w"))
    return edges.unionByName(found.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("w")))


def embed(found: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """The embedding ``node, e0..eN`` after the power iterations."""
    draw = [(F.pmod(F.xxhash64("node", F.lit(v)), F.lit(1_000_003)) / F.lit(1_000_003.0)).alias(e) for v, e in enumerate(NAMES)]
    state = found.select("node", *draw)
    for _ in range(iterations):
        spread = edges.join(state.withColumnRenamed("node", "j"), "j")
        state = spread.groupBy(F.col("i").alias("node")).agg(*[(F.sum(F.col("w") * F.col(e)) / F.sum("w")).alias(e) for e in NAMES])
    return state


def kmeans(points: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Assign each of the points ``part, node, seed, e0..eN`` to a centre; seeds are the points so marked: ``node, centre``."""
    grid = [F.floor(F.col(e) / GRID) for e in NAMES[:GRID_COORDINATES]]
    cells = [f"g{v}" for v in range(GRID_COORDINATES)]
    centres = points.where("seed").select("part", F.col("node").alias("centre"), *[F.col(e).alias(f"c_{e}") for e in NAMES])
    assigned = None
    for k in range(rounds):
        near = centres
        for cell, e in zip(cells, NAMES):
            near = near.withColumn(cell, F.explode(F.array(*[F.floor(F.col(f"c_{e}") / GRID) + d for d in (-1, 0, 1)])))
        dist = sum((F.col(e) - F.col(f"c_{e}")) ** 2 for e in NAMES)
        pairs = points.withColumns(dict(zip(cells, grid))).join(near, ["part", *cells])
        best = F.min_by(F.struct("centre", "part", *NAMES), F.struct(dist.alias("d"), F.col("centre"))).alias("b")
        assigned = pairs.groupBy("node").agg(best).select("node", "b.*")
        if k + 1 < rounds:
            centres = assigned.groupBy("part", "centre").agg(*[F.avg(e).alias(f"c_{e}") for e in NAMES])
    return assigned.select("node", "centre")


def _maximal_sets(adjacent: dict[int, set[int]]) -> list[set[int]]:
    """All maximal sets of mutually adjacent vertices, with pivoting."""
    out: list[set[int]] = []
    stack = [(set(), set(adjacent), set())]
    while stack:
        chosen, left, done = stack.pop()
        if not left and not done:
            out.append(chosen)
            continue
        if not left:
            continue
        pivot = max(left | done, key=lambda v: len(adjacent[v] & left))
        for v in list(left - adjacent[pivot]):
            stack.append((chosen | {v}, left & adjacent[v], done & adjacent[v]))
            left = left - {v}
            done = done | {v}
    return out


def _split(min_size: int):
    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict[int, set[int]] = {}
        for i, js in zip(pdf["rep"], pdf["js"]):
            adjacent.setdefault(int(i), set()).update(map(int, js))
        weight = dict(zip(pdf["rep"].astype(int), pdf["weight"].astype(int)))
        rows = [(pdf["part"].iloc[0], v, min(s)) for s in _maximal_sets(adjacent) if sum(weight[v] for v in s) >= min_size for v in s]
        return pd.DataFrame(rows, columns=["part", "rep", "group_seq"])

    return split


def exact_rest(rest: DataFrame, min_sim: float, min_size: int) -> DataFrame:
    """Maximal groups ``part, rep, group_seq`` among the vectors ``part, id, vec, weight`` that failed the check, from all their edges."""
    found, _, _ = neighbours.search(rest, 1, min_sim, graph=True)
    most = found.agg(F.max("degree")).first()[0] or 0
    found, _, _ = neighbours.search(rest, max(1, int(most)), min_sim, graph=True)
    found = cut(found.select("part", "node", "rep", "weight", F.transform("top", lambda t: t["id"]).alias("js")))
    edges = found.select("node", F.explode("js").alias("j"))
    labels = found.select("node", F.col("rep").alias("label"))
    while True:
        low = edges.join(labels.select(F.col("node").alias("j"), F.col("label").alias("other")), "j").groupBy("node").agg(F.min("other").alias("other"))
        new = cut(labels.join(low, "node", "left").select("node", F.least("label", F.coalesce("other", "label")).alias("label"), (F.col("other") < F.col("label")).alias("moved")))
        labels = new.select("node", "label")
        if new.where("moved").isEmpty():
            break
    listed = edges.join(found.select(F.col("node").alias("j"), F.col("rep").alias("jr")), "j").groupBy("node").agg(F.collect_list("jr").alias("js"))
    rows = found.drop("js").join(listed, "node", "left").join(labels, "node").withColumn("js", F.coalesce("js", F.array().cast("array<long>")))
    return rows.groupBy("part", "label").applyInPandas(_split(min_size), "part string, rep long, group_seq long")


def cluster(memories: DataFrame, min_sim: float = 0.80, min_size: int = 3, below: float = 0.20, iterations: int = ITERATIONS, repair: bool = True) -> DataFrame:
    """One row per member: ``category, group_seq, ingest_seq, affinity, group_size, route``.

    ``route`` is ``spectral`` where the k-means cluster passed the check, ``split`` where it was repaired;
    without ``repair`` the clusters that fail the check are left out.
    """
    rows = fading(memories, below)
    found, encoded, members = neighbours.search(rows, NEAREST, min_sim, graph=True)
    found = cut(found.withColumn("least_rep", F.least("rep", F.coalesce("least_rep", "rep"))))
    # a vector without neighbours is in a group only as a set of copies; the iteration skips it
    linked = found.where("least IS NOT NULL")
    points = embed(linked, affinities(linked), iterations).join(linked.select("node", "part", (F.col("least_rep") == F.col("rep")).alias("seed")), "node")
    placed = kmeans(cut(points))
    checked = linked.join(placed, "node", "left").withColumn("centre", F.coalesce("centre", "node"))
    checked = checked.unionByName(found.where("least IS NULL").withColumn("centre", F.col("node")))
    closed = F.col("mark") + F.col("own_mark")
    totals = checked.groupBy("centre").agg(
        F.sum("weight").alias("size"), F.sum("own_mark").alias("set_mark"), F.min("rep").alias("group_seq"), F.min("least_rep").alias("low_rep"), F.min(closed).alias("low"), F.max(closed).alias("high")
    )
    # the marks agree only if every member's neighbours and itself are exactly the group
    whole = (F.col("low") == F.col("set_mark")) & (F.col("high") == F.col("set_mark")) & (F.col("low_rep") == F.col("group_seq"))
    checked = cut(checked.join(totals, "centre").withColumn("whole", whole))
    groups = checked.where(F.col("whole") & (F.col("size") >= min_size)).select("node", "group_seq", F.lit("spectral").alias("route"))
    failed = checked.where("NOT whole")
    if repair and not failed.isEmpty():
        # vectors with the same neighbours and themselves are in the same groups: one of them stands for all
        alike = ["part", "least_rep", "closed", "closed_n"]
        failed = failed.withColumns({"closed": closed, "closed_n": F.col("degree") + F.col("weight")})
        first = cut(failed.groupBy(*alike).agg(F.min(F.struct("rep", "node")).alias("f"), F.sum("weight").alias("weight")))
        vec = encoded.select("node", "blob").join(first.select(F.col("f.node").alias("node"), "part", F.col("f.rep").alias("id"), "weight"), "node")
        rest = vec.select("part", "id", "weight", neighbours.floats(F.col("blob")).alias("vec"))
        split = exact_rest(rest, min_sim, min_size).select("part", F.col("rep").alias("id"), "group_seq")
        names = first.select("part", F.col("f.rep").alias("id"), "least_rep", "closed", "closed_n")
        back = failed.select("node", *alike).join(names, alike).select("node", "part", "id")
        groups = groups.unionByName(back.join(split, ["part", "id"]).select("node", "group_seq", F.lit("split").alias("route")))
    sizes = groups.join(checked.select("node", "part", "weight", "affinity"), "node")
    size = sizes.groupBy("part", "group_seq").agg(F.sum("weight").alias("group_size"))
    return sizes.join(size, ["part", "group_seq"]).join(members, "node").select(
        F.col("part").alias("category"), "group_seq", F.explode("members").alias("ingest_seq"), (F.col("affinity") + F.col("weight") - 1).alias("affinity"), "group_size", "route"
    )


def describe(members: DataFrame, memories: DataFrame, typical: int = 5) -> DataFrame:
    """Per cluster its size, its most typical members and what is stored of the first of them.

    The most typical members are picked by rank; Spark limits the rows per cluster before the
    shuffle, so a large cluster is never gathered.
    """
    from pyspark.sql import Window

    rank = Window.partitionBy("category", "group_seq").orderBy(F.desc(F.round("affinity", 6)), "ingest_seq")
    best = members.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= typical)
    stored = memories.select("ingest_seq", F.col("retention").alias("r"), F.col("category").alias("c"))
    best = best.join(stored, "ingest_seq")
    return best.groupBy("category", "group_seq").agg(
        F.first("group_size").alias("group_size"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "ingest_seq"))), lambda t: t["ingest_seq"]).alias("typical"),
        F.min_by("r", "rank").alias("retention"),
        F.min_by("c", "rank").alias("category_as_stored"),
        F.round(F.max("affinity") / F.greatest(F.first("group_size") - 1, F.lit(1)), 6).alias("cohesion"),
    )
