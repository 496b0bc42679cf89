import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, every):
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    ids, m = np.array([i for i, _ in sound]), np.array([v for _, v in sound])
    out = {}
    for i, v in sound:
        if i % every == 0:
            s = neighbours.exact(np.repeat(v[None], len(m), 0), m)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def got(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        own = out.setdefault(r.query_id, [])
        assert r.rank == len(own) + 1
        own.append((r.vec_id, r.score))
    return out


def data(seed=0, n=3000, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, dim))
    m = np.where((rng.random(n) < 0.5)[:, None], centres[rng.integers(0, 20, n)] + 0.1 * rng.standard_normal((n, dim)), rng.standard_normal((n, dim)))
    m[n // 30 : n // 8] = m[n // 30]  # a third of a cluster is one vector
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(m)]
    rows[20] = (20, None, 0)
    rows[40] = (40, [0.0] * dim, 0)
    rows[41] = (41, [None] + [1.0] * (dim - 1), 0)
    rows[42] = (42, [float("nan")] * dim, 0)
    rows[43] = (43, [float("inf")] * dim, 0)
    return rows


def test_hilbert_is_a_curve():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3), -1).reshape(-1, 3)
    key = neighbours.hilbert(cells, 3)
    walk = cells[np.argsort(key)]
    assert sorted(key.tolist()) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_whole_results(spark):
    rows = data()
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute(rows, 20, 20)
    assert got(neighbours.nearest(frame, F.col("vec_id") % 20 == 0, min_block=300)) == want
    alone = got(neighbours.nearest(frame, F.col("vec_id") % 20 == 0, complete=False))
    recall = np.mean([len({i for i, _ in alone[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])
    assert recall > 0.5


def test_fewer_vectors_than_asked_for_and_none(spark):
    rows = data(n=600)[:8] + [(8, [1.0] * 16, 0), (8, [1.0] * 16, 0)]
    assert got(neighbours.nearest(spark.createDataFrame(rows[:8], SCHEMA), F.col("vec_id") % 4 == 0)) == brute(rows[:8], 20, 4)
    assert all(len(v) == 8 for v in got(neighbours.nearest(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 8)).values())
    assert neighbours.nearest(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def brute_of_sizes(rows, k, every):
    """As ``brute``, for vectors of several sizes and ids that come several times."""
    best = {}
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    for i, v in sound:
        if i % every == 0:
            own = best.setdefault(i, {})
            for j, w in sound:
                if j != i and len(w) == len(v):
                    own[j] = max(own.get(j, -np.inf), float(neighbours.exact(v[None], w[None])[0]))
    return {i: sorted(own.items(), key=lambda x: (-x[1], x[0]))[:k] for i, own in best.items() if own}


def test_several_sizes_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    vector = lambda n: (rng.standard_normal(n) * rng.choice((0.1, 1, 5))).astype(np.float32).tolist()
    rows = [(i, vector(8), 0) for i in range(400)] + [(i, vector(5), 0) for i in range(400, 460)] + [(500, vector(9), 0), (501, [], 0), (None, vector(8), 0)]
    rows += [(i, vector(8), 0) for i in (10, 10, 20, 20, 33)] + [(40, vector(5), 0)] + rows[50:60]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("v", F.lit(1)).withColumn("q", F.lit("x"))
    assert got(neighbours.nearest(frame, F.col("vec_id") % 10 == 0, k=7, window=16, min_block=50)) == brute_of_sizes(rows, 7, 10)


def test_lengths_don_t_mislead_the_curves(spark):
    """A third component of long vectors is what products are made of; distances alone would look elsewhere."""
    rng = np.random.default_rng(4)
    m = rng.standard_normal((4000, 3)) * rng.choice((0.05, 1, 4), (4000, 1), p=(0.9, 0.09, 0.01))
    rows = [(i, v.astype(np.float32).tolist(), 0) for i, v in enumerate(m)]
    want = brute(rows, 20, 20)
    alone = got(neighbours.nearest(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 20 == 0, complete=False))
    assert np.mean([len({i for i, _ in alone[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]) > 0.9
