"""Most similar vectors for every vector, with randomly rotated one-bit codes.

Index
    A bounded sample (at most ``SAMPLE_ROWS``) gives, in one executor task, the centroids of the cells
    (as many as the square root of the number of vectors, at most ``MAX_CELLS``); a random rotation is
    drawn from a seed. Every vector is indexed: it gets its cell, the signs of its rotated residual
    packed into one 64-bit number, the residual's length and the inner product of the residual with its
    own code (the correction scalar).
Search
    Every vector is a query. A vector within distance ``t`` of the query can only lie in a cell whose
    border with the query's own cell is at most ``t`` away, so the cells whose border is within
    ``margin`` are probed. With the distance that belongs to ``min_sim`` as margin (``margin=None``) no
    cell is left out wrongly; a smaller one trades recall for work. In a probed cell the inner products
    are estimated from the signs and the correction scalars; the error bound of an estimate decides
    which vectors are reranked with their exact cosine in double precision.
Blocks
    Cells that are near each other form a block of base rows; a cell that is larger than a block is
    cut by hash. A query is sent once to each block with cells it probes, together with their list, and
    the queries of a block are cut by hash. So a hot cell is spread over many tasks. Exact copies are
    collapsed within each Arrow batch before anything is shuffled, then over the whole table, to one node
    with a weight. Their ids stay with the batches and are joined to what the node has found at the end,
    by a digest of the vector.
Waves
    A query goes to several blocks, so what is sent is several times the vectors. On a large table the
    nodes ask in waves: in each, about as many rows are sent as there are nodes, its finds are written
    and its shuffles dropped before the next. The disk then holds the nodes, their blocks and one wave.

Defined cases: a vector is usable if it has ``dims`` finite elements, not all zero; others neither
ask nor answer; a row without an id is left out; rows of one id are each listed, and none of them is a
neighbour of another; equal similarities (rounded to six digits) are ordered by id; an empty table
gives no rows; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderbase.session import cut, cut_lean, ship

DIMS, SAMPLE_ROWS, ROWS_PER_CELL, MAX_CELLS, SEED = 64, 200_000, 20, 16_384, 7
#: Most rows of a block, fewest blocks worth a task of their own, queries of a block, and pairs estimated at a time.
BLOCK, FEW, SMALL_BLOCK, QUERY_BLOCK, PAIRS = 32_768, 8, 2048, 65_536, 1 << 21
#: Rows that a wave may send to the blocks even if there are fewer nodes.
WAVE = 1_000_000
#: Width of the error bound of an estimate, in deviations; at 3 a true neighbour is missed once in some thousand.
EPSILON = 3.0
#: Distance to the border up to which the cells are probed: for neighbours from a cosine of about 0.8, and for all.
NEAR_MARGIN, FAR_MARGIN = 0.16, 0.25


def usable(vec: Column, dims: int = DIMS) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vec.isNotNull() & (F.size(vec) == dims) & finite & F.exists(vec, lambda x: x != 0)


@dataclass
class Index:
    """What the executors need to place a vector: centroids, rotation, and the blocks of the cells."""

    centroids: np.ndarray
    rotation: np.ndarray
    first_block: np.ndarray
    n_blocks: np.ndarray
    query_cuts: np.ndarray
    #: Number of nodes, and about how many rows they send to the blocks.
    sends: np.ndarray


def _squares(c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1)


def _chunks(rows: int, cells: int) -> Iterator[slice]:
    step = max(1, (1 << 22) // max(1, cells))
    for lo in range(0, rows, step):
        yield slice(lo, min(rows, lo + step))


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * _squares(c)
    return np.concatenate([np.argmax(x[s] @ c.T - half, axis=1) for s in _chunks(len(x), len(c))])


def _centroids(x: np.ndarray, cells: int, rng: np.random.Generator) -> np.ndarray:
    if cells <= 1024:
        # spread seeding: the next seed is drawn by its squared distance to the seeds so far
        chosen = [int(rng.integers(len(x)))]
        far = 2 - 2 * x @ x[chosen[0]]
        for _ in range(cells - 1):
            p = np.maximum(far, 0).astype(np.float64)
            nxt = int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 1e-9 else int(rng.integers(len(x)))
            chosen.append(nxt)
            far = np.minimum(far, 2 - 2 * x @ x[nxt])
    else:
        chosen = rng.choice(len(x), cells, replace=False)
    c = x[chosen].copy()
    for _ in range(4):
        own = _own(x, c)
        order = np.argsort(own, kind="stable")
        at, start = np.unique(own[order], return_index=True)
        c[at] = np.add.reduceat(x[order], start, axis=0) / np.diff([*start, len(x)])[:, None]
    return c


def _probes(x: np.ndarray, c: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own cell; and as (vector, cell), in order of vectors, own first, the cells whose border with it is within the margin."""
    cc = _squares(c)
    owns, rows, cells = [], [], []
    for s in _chunks(len(x), len(c)):
        square = np.maximum(0, _squares(x[s])[:, None] + cc - 2 * x[s] @ c.T)
        own = np.argmin(square, axis=1)
        between = np.sqrt(np.maximum(1e-12, cc[own][:, None] + cc - 2 * c[own] @ c.T))
        border = (square - np.take_along_axis(square, own[:, None], 1)) / (2 * between)
        asked = border <= margin + 1e-6
        every = np.arange(len(own))
        asked[every, own] = False
        at, cell = np.nonzero(asked)
        at, cell = np.concatenate([every, at]), np.concatenate([own, cell])
        order = np.argsort(at, kind="stable")
        rows.append(at[order] + s.start)
        cells.append(cell[order])
        owns.append(own)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(owns or none), np.concatenate(rows or none), np.concatenate(cells or none)


def _pack_cells(c: np.ndarray, rows: np.ndarray, block: float) -> tuple[np.ndarray, np.ndarray]:
    """First block and number of blocks of each cell; cells near each other share a block."""
    first, n = np.zeros(len(c), np.int32), np.ones(len(c), np.int32)
    stack, made = [np.arange(len(c))], 0
    while stack:
        cells = stack.pop()
        total = rows[cells].sum()
        if len(cells) == 1 or total <= block:
            cuts = max(1, int(np.ceil(total / block))) if len(cells) == 1 else 1
            first[cells], n[cells] = made, cuts
            made += cuts
            continue
        x = c[cells] - c[cells].mean(axis=0)
        axis = np.linalg.eigh(x.T @ x)[1][:, -1]
        order = cells[np.argsort(x @ axis, kind="stable")]
        middle = int(np.clip(np.searchsorted(np.cumsum(rows[order]), total / 2), 1, len(order) - 1))
        stack += [order[middle:], order[:middle]]
    return first, n


def _train(n: int, margin: float, pdf: pd.DataFrame) -> Index:
    rng = np.random.default_rng(SEED)
    rotation = np.linalg.qr(rng.standard_normal((DIMS, DIMS)))[0]
    if pdf.empty:
        return Index(np.zeros((1, DIMS)), rotation, np.zeros(1, np.int32), np.ones(1, np.int32), np.ones(1, np.int32), np.zeros(2))
    x = np.stack([np.asarray(v, np.float32) for v in pdf["vec"]])
    x /= np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    c = _centroids(x, int(min(MAX_CELLS, max(1, round(np.sqrt(n))), max(1, len(x) // 2))), rng).astype(np.float64)
    # sizes of the cells, and how many ask each block, as the sample has them
    rows = np.bincount(_own(x, c), minlength=len(c)) * (n / len(x))
    first, cuts = _pack_cells(c, rows, min(BLOCK, max(SMALL_BLOCK, n / FEW)))
    some = x[rng.choice(len(x), min(len(x), 2000), replace=False)].astype(np.float64)
    asks = np.zeros(int((first + cuts).max()))
    _, who, cells = _probes(some, c, margin)
    asked = np.unique(who * len(asks) + first[cells]) % len(asks)
    asks += np.bincount(asked, minlength=len(asks)) * (n / len(some))
    for cell in np.flatnonzero(cuts > 1):
        asks[first[cell] : first[cell] + cuts[cell]] = asks[first[cell]]
    return Index(c, rotation, first, cuts, np.maximum(1, np.ceil(asks / QUERY_BLOCK)).astype(np.int32), np.array([n, asks.sum()], np.float64))


def train(rows: DataFrame, margin: float, copies: bool = False) -> Index:
    """The index, fitted in one executor task on a bounded sample by hash of the id; of rows with ``copies`` the distinct vectors of a part count."""
    key = F.xxhash64("part", "vec") if copies else F.xxhash64("id", F.lit(SEED))
    n = rows.select(key).distinct().count() if copies else rows.count()
    wanted = min(SAMPLE_ROWS, max(SAMPLE_ROWS // 10, ROWS_PER_CELL * round(np.sqrt(n))))
    share = min(1.0, wanted / max(1, n))
    sample = rows.where(F.pmod(key, F.lit(1_000_000)) < F.lit(round(share * 1_000_000))).select(key.alias("key"), "id", "vec")
    sample = sample.groupBy("key").agg(F.min("id").alias("id"), F.min_by("vec", "id").alias("vec")) if copies else sample
    names = [f.name for f in fields(Index)]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        # in order of ids, so that the index does not depend on how the rows were shuffled
        index = _train(n, margin, pd.concat(got).sort_values("id", kind="stable") if got else pd.DataFrame({"vec": []}))
        yield pd.DataFrame({name: [np.ascontiguousarray(getattr(index, name)).tobytes()] for name in names})

    row = sample.select("id", "vec").repartition(1).mapInPandas(fit, ", ".join(f"{name} binary" for name in names)).first()
    if row is None:  # an empty table has no partition to fit in
        return _train(n, margin, pd.DataFrame({"vec": []}))
    whole = lambda b: np.frombuffer(bytes(b), np.int32)
    wide = lambda b: np.frombuffer(bytes(b), np.float64)
    return Index(wide(row[0]).reshape(-1, DIMS), wide(row[1]).reshape(-1, DIMS), whole(row[2]), whole(row[3]), whole(row[4]), wide(row[5]))


def _mark(ids: np.ndarray) -> np.ndarray:
    """A 32-bit hash of ids; its sum over a set identifies the set in any order."""
    return ((ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64)


def _unit(blobs) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), np.float32).reshape(-1, DIMS).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    """The rows of a batch with copies put together: ``part, blob, members, weight``."""
    pdf = pdf.assign(blob=[np.asarray(v, np.float32).tobytes() for v in pdf["vec"]]).sort_values(["part", "id"], kind="stable")
    if not pdf.duplicated(["part", "blob"]).any():
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "blob": pdf["blob"].to_numpy(), "members": [[i] for i in pdf["id"].tolist()], "weight": pdf["weight"].to_numpy()})
    return pdf.groupby(["part", "blob"], sort=False).agg(members=("id", list), weight=("weight", "sum")).reset_index()


def _collapse(keep: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The nodes of each batch, with their first ``keep`` ids."""
    for pdf in batches:
        if not pdf.empty:
            nodes = _nodes(pdf)
            yield nodes.assign(rep=[m[0] for m in nodes["members"]], firsts=[m[:keep] for m in nodes["members"]])


def _encode(index: Index, margin: float, keep: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if pdf.empty:
            continue
        nodes = next(_collapse(keep, [pdf])) if "vec" in pdf else pdf
        x = _unit(nodes["blob"])
        own, who, cells = _probes(x, index.centroids, margin)
        residual = x - index.centroids[own]
        length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.maximum(length, 1e-12)[:, None]) @ index.rotation
        code = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64).ravel().view(np.int64)
        rep = nodes["rep"].to_numpy(np.int64)
        # a row of a cut cell lies in one of its blocks; who asks such a cell asks all of them
        place = _mark(rep) % index.n_blocks[own] + index.first_block[own]
        ends = np.searchsorted(who, np.arange(1, len(x) + 1)) * 2
        raw, starts = cells.astype(np.uint16).tobytes(), np.concatenate([[0], ends[:-1]])
        yield pd.DataFrame({
            "part": nodes["part"], "rep": rep, "firsts": nodes["firsts"], "weight": nodes["weight"],
            "cell": own.astype(np.int32), "block": place.astype(np.int32), "cuts": index.query_cuts[place], "cells": [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())],
            "code": code, "length": length, "align": np.abs(turned).sum(axis=1) / np.sqrt(DIMS), "blob": nodes["blob"],
        })


def _cells(column) -> tuple[np.ndarray, np.ndarray]:
    """The listed cells of all rows, and the number of each row."""
    return np.frombuffer(b"".join(column), np.uint16).astype(np.int64), np.array([len(b) // 2 for b in column], np.int64)


def _pieces(batches: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for lo in range(0, len(pdf), rows):
            yield pdf.iloc[lo : lo + rows]


def _ask(index: Index, batches: Iterator[pd.DataFrame], everywhere: bool = False, waves: int = 1, cuts: int = 1) -> Iterator[pd.DataFrame]:
    """A row for each block in which a node probes cells, or ``everywhere``; the first of them passes on what belongs to the node.

    In one of ``waves`` the queries of a block are cut into fewer parts, those that ask everywhere into ``cuts``.
    """
    query_cuts = np.full_like(index.query_cuts, cuts) if everywhere else -(-index.query_cuts // waves)
    for pdf in _pieces(batches, max(1, (1 << 20) // len(index.centroids)) if everywhere else 1 << 20):
        if everywhere:
            cells, n = np.tile(np.arange(len(index.centroids)), len(pdf)), np.full(len(pdf), len(index.centroids))
        else:
            cells, n = _cells(pdf["cells"])
        who = np.repeat(np.arange(len(pdf)), n)
        cuts = index.n_blocks[cells]
        inner = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        who, cells = np.repeat(who, cuts), np.repeat(cells, cuts)
        block = index.first_block[cells] + inner
        order = np.lexsort((block, who))
        who, cells, block = who[order], cells[order], block[order]
        start = np.flatnonzero(np.concatenate([[True], (who[1:] != who[:-1]) | (block[1:] != block[:-1])]))
        ends = np.concatenate([start[1:], [len(who)]])
        raw = cells.astype(np.uint16).tobytes()
        row, at = who[start], block[start]
        first = np.concatenate([[True], row[1:] != row[:-1]])
        node = pdf["node"].to_numpy()[row]
        pick = lambda c, null=None: np.where(first, pdf[c].to_numpy()[row], null)
        yield pd.DataFrame({
            "q_block": at.astype(np.int32), "q_qb": ((_mark(node) & 0xFFFF) % query_cuts[at]).astype(np.int32), "q_node": node, "q_part": pdf["part"].to_numpy()[row],
            "q_rep": pd.array(pick("rep"), dtype="Int64"), "q_weight": pd.array(pick("weight"), dtype="Int64"),
            "q_blob": pdf["blob"].to_numpy()[row], "q_cells": [raw[2 * a : 2 * b] for a, b in zip(start.tolist(), ends.tolist())],
        })


COLLAPSED = "part string, blob binary, members array<long>, weight long, rep long, firsts array<long>"
ENCODED = (
    "part string, rep long, firsts array<long>, weight long, cell int, block int, cuts int, cells binary, "
    "code long, length double, align double, blob binary"
)
ASKED = "q_block int, q_qb int, q_node long, q_part string, q_rep long, q_weight long, q_blob binary, q_cells binary"
FOUND = "node long, part string, rep long, weight long, degree long, affinity double, least long, least_rep long, mark long, own_mark long, ids array<long>, sims array<double>"


class _Best:
    """The k best (similarity, id) of each query so far, by similarity and then id."""

    def __init__(self, queries: int, k: int):
        self.k, self.sims, self.ids = k, np.full((queries, k), -9.0), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, qi: np.ndarray, sims: np.ndarray, ids: np.ndarray) -> None:
        order = np.lexsort((ids, -sims, qi))
        qi, sims, ids = qi[order], sims[order], ids[order]
        at, start, n = np.unique(qi, return_index=True, return_counts=True)
        rank = np.arange(len(qi)) - np.repeat(start, n)
        row = np.repeat(np.arange(len(at)), n)
        good = rank < self.k
        s, i = np.full((len(at), self.k), -9.0), np.full((len(at), self.k), np.iinfo(np.int64).max)
        s[row[good], rank[good]], i[row[good], rank[good]] = sims[good], ids[good]
        s, i = np.concatenate([self.sims[at], s], axis=1), np.concatenate([self.ids[at], i], axis=1)
        by = np.lexsort((i, -s), axis=1)[:, : self.k]
        self.sims[at], self.ids[at] = np.take_along_axis(s, by, 1), np.take_along_axis(i, by, 1)


def _search(index: Index, k: int, min_sim: float, graph: bool, base: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in FOUND.split(", ")]
    if queries.empty:
        return pd.DataFrame({c: [] for c in names})
    n_q = len(queries)
    qnode, own = queries["q_node"].to_numpy(np.int64), queries["q_rep"].notna().to_numpy()
    best, floor = _Best(n_q, k), np.full(n_q, float(min_sim))
    degree, affinity, mark = np.zeros(n_q, np.int64), np.zeros(n_q), np.zeros(n_q, np.int64)
    least = np.full(n_q, len(base))  # place in ``base``, which is ordered so that the smallest is the least
    if len(base):
        base = base.sort_values(["rep", "node"], kind="stable").reset_index(drop=True)
        x, q = _unit(base["blob"]), _unit(queries["q_blob"])
        node, rep, weight = (base[c].to_numpy(np.int64) for c in ("node", "rep", "weight"))
        marks = _mark(node)
        bits = np.unpackbits(base["code"].to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32) * 2 - 1
        length, align = base["length"].to_numpy(), np.maximum(base["align"].to_numpy(), 1e-6)
        error = length * np.sqrt(np.maximum(0, 1 - align**2)) / align * EPSILON / np.sqrt(DIMS - 1) + 1e-6
        signs = bits * (length / align / np.sqrt(DIMS))[:, None].astype(np.float32)
        single, asking = x.astype(np.float32), q.astype(np.float32)
        n_firsts = base["firsts"].map(len).to_numpy()
        firsts, begin = np.concatenate(base["firsts"].tolist()).astype(np.int64), np.cumsum(n_firsts) - n_firsts
        groups = base.groupby(["part", "cell"], sort=False).indices
        cells, counts = _cells(queries["q_cells"])
        wanted = pd.DataFrame({"qi": np.repeat(np.arange(n_q), counts), "cell": cells, "part": np.repeat(queries["q_part"].to_numpy(), counts)})
        wanted["again"] = np.arange(len(wanted)) != np.repeat(np.cumsum(counts) - counts, counts)
        # the nearest cell of each query goes first, as it sets the floor for the others
        for (again, part, cell), who in wanted.groupby(["again", "part", "cell"])["qi"]:
            mine = groups.get((part, cell))
            if mine is None:
                continue
            who = who.to_numpy()
            if graph:
                # every pair from the floor counts, so single precision decides which are multiplied again, not an estimate
                step, low = max(16, (PAIRS >> 3) // len(mine)), np.float32(min_sim - 1e-5)
                for lo in range(0, len(who), step):
                    a, b = np.nonzero(asking[who[lo : lo + step]] @ single[mine].T >= low)
                    a, b = who[lo + a], mine[b]
                    exact = np.round(np.clip(np.einsum("ij,ij->i", q[a], x[b]), -1, 1), 6)
                    good = (exact >= min_sim) & (node[b] != qnode[a])
                    a, b, exact = a[good], b[good], exact[good]
                    if not len(a):
                        continue
                    np.add.at(degree, a, weight[b])
                    np.add.at(affinity, a, weight[b] * exact)
                    np.add.at(mark, a, marks[b])
                    np.minimum.at(least, a, b)
                    best.add(a, exact, node[b])
                continue
            centre = index.centroids[cell]
            there = np.column_stack([signs[mine], error[mine], np.ones(len(mine)), x[mine] @ centre]).astype(np.float32)
            step = max(16, PAIRS // len(mine))
            for lo in range(0, len(who), step):
                qi = who[lo : lo + step]
                rest = q[qi] - centre
                far = np.linalg.norm(rest, axis=1)
                here = np.column_stack([rest @ index.rotation, far, rest @ centre, np.ones(len(qi))]).astype(np.float32)
                upper = here @ there.T
                if not again and len(mine) > k:
                    # the k-th largest lower bound: nothing whose upper bound is below it can be among the k
                    lower = upper - (2 * far[:, None] * error[mine][None, :]).astype(np.float32)
                    floor[qi] = np.maximum(floor[qi], np.partition(lower, -k, axis=1)[:, -k])
                likely = upper >= floor[qi][:, None] - 1e-5
                if np.count_nonzero(likely) > 0.02 * likely.size:
                    # so many are cheaper to multiply at once; single precision leaves few open
                    rough = asking[qi] @ single[mine].T
                    least_sim = floor[qi]
                    if len(mine) > k:
                        least_sim = np.maximum(least_sim, np.partition(rough, -k, axis=1)[:, -k] - 1e-5)
                    likely &= rough >= least_sim[:, None] - 1e-5
                a, b = np.nonzero(likely)
                if not len(a):
                    continue
                exact = np.round(np.clip(np.einsum("ij,ij->i", q[qi[a]], x[mine[b]]), -1, 1), 6)
                good = exact >= floor[qi[a]]
                a, b, exact = qi[a[good]], mine[b[good]], exact[good]
                if not len(a):
                    continue
                n = n_firsts[b]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                best.add(np.repeat(a, n), np.repeat(exact, n), firsts[np.repeat(begin[b], n) + inner])
                floor[qi] = np.maximum(floor[qi], best.sims[qi, -1])
    listed = best.sims > -2
    show = np.flatnonzero(own | listed.any(axis=1))
    n = listed[show].sum(axis=1)
    return pd.DataFrame({
        "node": qnode[show], "part": queries["q_part"].to_numpy()[show], "rep": queries["q_rep"].to_numpy()[show], "weight": queries["q_weight"].to_numpy()[show],
        "degree": degree[show], "affinity": affinity[show],
        "least": pd.array([node[j] if j < len(base) else None for j in least[show]], dtype="Int64"), "least_rep": pd.array([rep[j] if j < len(base) else None for j in least[show]], dtype="Int64"), "mark": mark[show], "own_mark": _mark(qnode[show]),
        "ids": [best.ids[j, :c].tolist() for j, c in zip(show, n)], "sims": [best.sims[j, :c].tolist() for j, c in zip(show, n)],
    })[names]


def floats(blob: Column) -> Column:
    """The vector of an encoded node."""
    return F.pandas_udf(lambda column: column.map(lambda b: np.frombuffer(b, np.float32)), "array<float>")(blob)


def distance(min_sim: float) -> float:
    """The distance of two unit vectors of a cosine."""
    return float(np.sqrt(max(0.0, 2 - 2 * min_sim)))


def search(rows: DataFrame, k: int, min_sim: float, margin: float | None = None, graph: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows ``part, id, vec[, weight]``: what each node finds, the encoded nodes, and the ids of each as ``node, members``.

    A node is the set of all copies of a vector (its smallest id ``rep``); its ids are in one row or several. ``top`` has its k best as (sim, id):
    ids of rows, its own among them, or with ``graph`` other nodes. Only then ``degree``, ``affinity`` (the sum of
    cosines), ``mark`` (a hash of the set of neighbours) and ``least`` cover all neighbours from ``min_sim``.
    Without a ``min_sim`` every node has its k, as far as there are so many rows.
    """
    spark = rows.sparkSession
    ship(spark)
    margin = distance(min_sim) if margin is None else margin
    rows = rows.select("part", "id", "vec", (F.col("weight") if "weight" in rows.columns else F.lit(1)).cast("long").alias("weight"))
    keep = 1 if graph else k
    copies = rows.mapInPandas(lambda b: _collapse(keep, b), COLLAPSED)
    sent = spark.sparkContext.broadcast(train(rows, margin, copies=True))
    sends = sent.value.sends[1]
    large = sends > WAVE
    write = cut_lean if large else cut
    firsts = F.array(F.min("rep")) if graph else F.slice(F.array_sort(F.flatten(F.collect_list("firsts"))), 1, k)
    # each batch has sent a vector once, so a much-copied one is no hot key
    placed = copies.select("part", "blob", "rep", "weight", *([] if graph else ["firsts"])).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "part", "blob")
    nodes = placed.groupBy("part", "blob").agg(F.min("rep").alias("rep"), F.sum("weight").alias("weight"), firsts.alias("firsts"))
    encoded = write(nodes.mapInPandas(lambda b: _encode(sent.value, margin, keep, b), ENCODED).withColumn("node", F.monotonically_increasing_id()))

    def pair(b: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return _search(sent.value, k, min_sim, graph, b, q)

    def ask(nodes: DataFrame, everywhere: bool, waves: int, cuts: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), (F.lit(cuts) if everywhere else F.ceil(F.col("cuts") / waves).cast("int")) - 1))
        base = encoded.select("block", every.alias("qb"), "node", "part", "rep", "weight", "firsts", "cell", "code", "length", "align", "blob")
        asked = nodes.select("node", "part", "rep", "weight", "blob", *([] if everywhere else ["cells"])).mapInPandas(lambda b: _ask(sent.value, b, everywhere, waves, cuts), ASKED)
        found = base.groupBy("block", "qb").cogroup(asked.groupBy("q_block", "q_qb")).applyInPandas(pair, FOUND)
        first = lambda c: F.first(c, ignorenulls=True).alias(c)
        low = F.min(F.when(F.col("least").isNotNull(), F.struct("least_rep", "least")))
        merged = found.groupBy("node").agg(
            first("part"), first("rep"), first("weight"), F.sum("degree").alias("degree"), F.sum("affinity").alias("affinity"), F.sum("mark").alias("mark"), first("own_mark"), low.alias("low"),
            F.flatten(F.collect_list(F.arrays_zip("sims", "ids"))).alias("all"),
        )
        top = F.slice(F.array_sort(F.transform("all", lambda p: F.struct((-p["sims"]).alias("minus"), p["ids"].alias("id")))), 1, k)
        top = F.transform(top, lambda p: F.struct((-p["minus"]).alias("sim"), p["id"].alias("id")))
        return merged.select("node", "part", "rep", "weight", "degree", "affinity", F.col("low.least").alias("least"), F.col("low.least_rep").alias("least_rep"), "mark", "own_mark", top.alias("top"))

    def run(nodes: DataFrame, rows: float, everywhere: bool = False) -> DataFrame:
        """What the nodes find, who send so many rows; of a large table in waves."""
        waves = max(1, int(np.ceil(rows / max(WAVE, sent.value.sends[0])))) if large else 1
        cuts = max(1, int(np.ceil(rows / waves / sent.value.query_cuts.size / QUERY_BLOCK)))
        out = None
        for wave in range(waves):
            some = nodes.where(F.pmod(F.xxhash64("node"), F.lit(waves)) == wave) if waves > 1 else nodes
            found = ask(some, everywhere, waves, cuts)
            found = write(found) if large else found
            out = found if out is None else out.unionByName(found)
        return out

    out = run(encoded, sends)
    if min_sim <= -1 and not graph:
        # who found fewer than k in the cells it probed asks all cells
        out = out if large else cut(out)
        short = out.where(F.size("top") < k).select("node")
        n_short = short.count()
        if n_short:
            who = encoded.select("node", "part", "rep", "weight", "blob").join(short, "node", "left_semi")
            who = write(who) if large else who
            again = run(who, n_short * sent.value.query_cuts.size, everywhere=True)
            out = out.join(short, "node", "left_anti").unionByName(again)
    key = F.unhex(F.sha2(F.col("blob"), 256)).alias("key")
    return out, encoded, copies.select("part", key, "members").join(encoded.select("part", key, "node"), ["part", "key"]).select("node", "members")


def knn(rows: DataFrame, k: int = 5, min_sim: float = -1.0, margin: float | None = NEAR_MARGIN, exact: bool = False) -> DataFrame:
    """For each row of ``id, vec`` its k most similar other rows: ``id, neighbour, sim, rank``.

    ``margin`` says which cells are probed; with ``exact`` no cell is left out that could hold a neighbour from ``min_sim``.
    """
    rows = rows.select(F.lit("").alias("part"), "id", "vec").where("id IS NOT NULL").where(usable(F.col("vec")))
    found, _, members = search(rows, k + 1, min_sim, None if exact else margin)
    near = F.slice(F.filter("top", lambda p: p["id"] != F.col("id")), 1, k)
    out = found.select("node", "top").join(members, "node").select(F.explode("members").alias("id"), "top").select("id", F.posexplode(near).alias("pos", "p"))
    return out.select("id", F.col("p.id").alias("neighbour"), F.col("p.sim").alias("sim"), (F.col("pos") + 1).alias("rank"))
