import numpy as np
import pytest

from lakeloom.llm import embedding_pairs as pairs


def brute(rows, threshold):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and None not in v and np.isfinite(v).all() and np.any(v) for _, v in rows]
    parent, links = list(range(n)), [0] * n

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], np.float64), np.array(rows[j][1], np.float64)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold or np.array_equal(a, b):
                    links[i] += 1
                    links[j] += 1
                    x, y = root(i), root(j)
                    parent[max(x, y)] = min(x, y)
    least = {}
    for i in range(n):
        least.setdefault(root(i), []).append(rows[i][0])
    return sorted((rows[i][0], links[i], min(least[root(i)])) for i in range(n))


@pytest.mark.parametrize("tile", [4096, 20])
def test_links_match_brute_force(spark, tile):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    vectors = [(c + rng.normal(size=16) * s).astype(np.float32).tolist() for c in centres for s in (0, 0.1, 0.2, 0.25, 0.3, 0.5, 0.5, 2) for _ in range(2)]
    vectors += [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [1.0, 2.0], [1.0, 2.0], [2.0, 4.1], [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15]
    rows = [(5 * i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = pairs.near_duplicates(df, 0.9, tile=tile).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_far_tiles_are_left_out_and_near_ones_are_not():
    rng = np.random.default_rng(5)
    points = np.concatenate([c + 0.05 * rng.normal(size=(40, 8)) for c in rng.normal(size=(10, 8))])
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    box = pairs.Boxes(points, 4).of(points)
    tiles = [points[box == k] for k in np.unique(box)]
    assert sum(map(len, tiles)) == len(points) and len(tiles) == 16
    low, high = (np.array([f(t, axis=0) for t in tiles]) for f in (np.min, np.max))
    centre = np.array([t.mean(0) for t in tiles])
    radius = np.array([np.linalg.norm(t - c, axis=1).max() for t, c in zip(tiles, centre, strict=True)])
    reach, left_out = np.sqrt(0.2), 0
    for i in range(len(tiles)):
        near = set(pairs.near_tiles(low, high, centre, radius, np.full(len(tiles), 8), i, reach).tolist())
        for j in range(i, len(tiles)):
            left_out += j not in near
            assert j in near or np.linalg.norm(tiles[i][:, None] - tiles[j][None], axis=2).min() > reach
    assert left_out > 60


def test_bounds_never_lose_a_pair():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(80, 24)) * np.geomspace(3, 0.1, 24)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    for t in (0.3, 0.9, 0.99):
        want = {tuple(x) for x in np.argwhere(a @ a.T >= t)}
        assert want <= {tuple(x) for x in pairs.tile_pairs(a, a, t).tolist()}


def test_wide_vectors_keep_the_given_basis(spark, monkeypatch):
    monkeypatch.setattr(pairs, "MAX_DIMS", 8)
    rng = np.random.default_rng(8)
    rows = [(i, (v + 0.1 * rng.normal(size=12)).tolist()) for i, v in enumerate(np.repeat(rng.normal(size=(15, 12)), 3, axis=0))]
    got = pairs.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.9, tile=7).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)


def test_empty_and_unusable_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in pairs.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert pairs.near_duplicates(df.limit(0)).count() == 0
