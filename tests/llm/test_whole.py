"""Results that must be whole, against brute force."""

import numpy as np

from cinderbase.llm import queries, spectral
from cinderbase.session import table


def brute_neighbours(rows, k):
    """{(id, neighbour): cosine} of the k most similar other rows of each usable row."""
    rows = [(i, np.asarray(v, np.float64)) for i, v in rows if v is not None and len(v) == 64 and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids = np.array([i for i, _ in rows])
    u = np.stack([v / np.linalg.norm(v) for _, v in rows])
    out = {}
    for at, own in enumerate(ids):
        sims = np.round(u @ u[at], 6)
        order = [j for j in np.lexsort((ids, -sims)) if j != at][:k]
        out |= {(int(own), int(ids[j])): float(sims[j]) for j in order}
    return out


def test_every_memory_has_its_neighbours_however_far(spark, data):
    want = brute_neighbours([(r["ingest_seq"], r["embedding"]) for r in table(spark, data, "memories").collect()], 5)
    got = {(r["ingest_seq"], r["neighbour_seq"]): r["cosine"] for r in queries.p3_neighbours(spark, data).collect()}
    both = got.keys() & want.keys()
    assert len(got) == len(want) and len(both) >= 0.9 * len(want) and all(abs(got[p] - want[p]) < 2e-6 for p in both)
    assert min(want.values()) < 0.5


def bridged(seed, size):
    """Two groups, each in cells of its own, and a third of two members of the first and one of the second."""
    rng = np.random.default_rng(seed)
    across, other = np.linalg.qr(rng.standard_normal((64, 2)))[0].T
    degrees = np.concatenate([rng.uniform(-3, 3, size - 2), [18, 18.5], [53], rng.uniform(67, 73, size - 1)])
    turn = np.radians(degrees)[:, None]
    return (np.cos(turn) * across + np.sin(turn) * other + 0.002 * rng.standard_normal((len(turn), 64))).astype(np.float32)


def test_groups_across_cells_with_the_usual_probes(spark):
    x = bridged(5, 100)
    u = x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    near = np.round(u @ u.T, 6) >= 0.8
    sets = spectral._maximal_sets({i: {int(j) for j in np.flatnonzero(row) if j != i} for i, row in enumerate(near)})
    want = {(i, min(s)) for s in sets if len(s) >= 3 for i in s}
    rows = [(i, v.tolist(), "a", 0.1) for i, v in enumerate(x)]
    memories = spark.createDataFrame(rows, "ingest_seq long, embedding array<float>, category string, retention double")
    assert len({s for _, s in want}) == 3
    assert {(r["ingest_seq"], r["group_seq"]) for r in spectral.cluster(memories).collect()} == want
