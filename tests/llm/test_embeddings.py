import numpy as np

from asterloom.llm import embedding_dedup
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, label int, rep int, copies int"


def plain(rows):
    x = {i: np.array(v, np.float32).astype(float) for i, v, *_ in rows if v and all(c is not None for c in v) and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(a, b) for a in x for b in x if a != b and len(x[a]) == len(x[b]) and x[a] @ x[b] / np.sqrt((x[a] @ x[a]) * (x[b] @ x[b])) >= 0.9]
    comp = brute.component_of([i for i, *_ in rows], links)
    n = {i: sum(a == i for a, _ in links) for i, *_ in rows}
    return sorted((i, n[i], comp[i], i == comp[i]) for i, *_ in rows)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).collect())


def clustered(rng, n=400, width=16):
    base = rng.normal(size=(n, width))
    base[100:200] = base[7] + 0.15 * rng.normal(size=(100, width))
    base[200:260] = np.repeat(base[20:40], 3, 0) + 0.1 * rng.normal(size=(60, width))
    base[300:340] = base[299]
    return [(int(i), [float(c) for c in v]) for i, v in enumerate(base.astype(np.float32))]


def test_recall_against_all_pairs_and_nothing_false(spark):
    rows = clustered(np.random.default_rng(1))
    got, want = run(spark, rows), plain(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want)) >= 0.9 * len(rows)


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rows = clustered(np.random.default_rng(2))
    whole = run(spark, rows)
    monkeypatch.setattr(embedding_dedup, "INDEX_BLOCK", 23)
    monkeypatch.setattr(embedding_dedup, "VISITOR_BLOCK", 31)
    assert run(spark, rows) == whole


def test_traversal_meets_cells_in_order_of_distance():
    rng = np.random.default_rng(6)
    for k1, k2, n in ((4, 4, 16), (7, 3, 21), (30, 20, 50), (5, 40, 200), (6, 6, 36)):
        grid = embedding_dedup.Grid(rng.normal(size=(k1, 3)), rng.normal(size=(k2, 3)), 1)
        x = rng.normal(size=(40, 6))
        cost = ((x[:, None, :3] - grid.first) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - grid.second) ** 2).sum(2)[:, None, :]
        got = grid.nearest(x, n)
        want = np.sort(cost.reshape(40, -1), axis=1)[:, :n]
        assert all(len(set(r)) == n for r in got.tolist())
        assert np.allclose(np.take_along_axis(cost.reshape(40, -1), got, 1), want)


def test_recall_on_real_vectors(spark):
    from asterloom.llm.common import table

    df = table(spark, "/root/testdata/sf0.01", "embeddings")
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(df).select("vec_id", "n_links").collect())
    want = [r[:2] for r in plain([(r.vec_id, r.embedding) for r in df.collect()])]
    assert all(g[1] <= w[1] for g, w in zip(got, want)) and sum(g[1] for g in got) >= 0.9 * sum(w[1] for w in want)


def test_odd_vectors(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, None), (3, [0.0] * 4), (4, [float("nan"), 1.0, 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0, 1.0]), (6, [None, 1.0, 1.0, 1.0]), (7, v), (8, [2.0, 4.0, 6.0, 8.0]), (9, []), (10, [1.0, 2.0, 3.0]), (11, [1e30, 2e30, 3e30, 4e30]), (12, [-1.0, -2.0, -3.0, -4.0])]
    assert run(spark, rows) == plain(rows)
    assert run(spark, []) == [] and run(spark, [(2, None)]) == [(2, 0, 2, True)]
