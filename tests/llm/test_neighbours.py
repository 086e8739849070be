import numpy as np

from foliospark.llm import neighbours as N


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return s, -np.sort(-s, axis=1)[:, k - 1]


def frame(spark, x, extra=()):
    rows = [(f"v{i:05d}", [float(v) for v in r], "clash", 1) for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, "id string, embedding array<float>, v string, block int")


BAD = [("n1", None, None, 1), ("n2", [0.0] * 8, "x", 1), ("n3", [1.0] * 3, "x", 1), ("n4", [float("nan")] + [1.0] * 7, "x", 1), ("n5", [float("inf")] + [1.0] * 7, "x", 1)]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(2)
    heart = rng.normal(size=(150, 8))
    x = (heart[rng.integers(0, 150, 3000)] + 0.15 * rng.normal(size=(3000, 8))) * rng.uniform(0.1, 9, (3000, 1))
    s, fifth = brute(x.astype(np.float32).astype(float), 5)
    got = N.neighbours(frame(spark, x, BAD), dim=8).collect()
    assert len(got) == 3000
    hit = total = 0
    for r in got:
        i = int(r["id"][1:])
        near = [int(n["id"][1:]) for n in r["neighbours"]]
        assert len(set(near)) == 5 and i not in near
        assert np.allclose([n["similarity"] for n in r["neighbours"]], sorted((float(s[i, j]) for j in near), reverse=True), atol=1e-5)
        hit += sum(s[i, j] >= fifth[i] - 1e-5 for j in near)
        total += 5
    assert hit / total > 0.97


def test_small_and_tied(spark):
    x = np.ones((4, 8))
    pairs = {(r["id_a"], r["id_b"]) for r in N.neighbour_pairs(frame(spark, x, BAD), dim=8).collect()}
    assert pairs == {(f"v{i:05d}", f"v{j:05d}") for i in range(4) for j in range(i + 1, 4)}
    assert N.neighbours(frame(spark, x[:1]), dim=8).first()["neighbours"] == []
    assert N.neighbours(frame(spark, x[:0], BAD), dim=8).count() == 0
    assert N.neighbour_pairs(frame(spark, x[:0], BAD).filter("false"), dim=8).count() == 0


def test_equal_vectors_and_a_dense_cluster(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate((np.ones((9000, 8)) * rng.uniform(0.1, 9, (9000, 1)), np.eye(8)[[0] * 2000] + rng.normal(size=(2000, 8)) * 0.01, rng.normal(size=(1000, 8))))
    got = {r["id"]: r["neighbours"] for r in N.neighbours(frame(spark, x), dim=8).collect()}
    assert len(got) == len(x) and all(len(n) == 5 for n in got.values())
    assert all(n["similarity"] > 1 - 1e-6 for i in range(0, 9000, 97) for n in got[f"v{i:05d}"])
    s = x[9000:] / np.linalg.norm(x[9000:], axis=1, keepdims=True)
    hit = 0
    asked = range(0, 2000, 13)
    for i in asked:
        sims = s @ s[i]
        sims[i] = -9
        hit += sum(n["similarity"] >= np.sort(sims)[-5] - 1e-6 for n in got[f"v{9000 + i:05d}"])
    assert hit / (5 * len(asked)) > 0.99


def test_comparisons_do_not_grow_with_the_rows():
    """A row meets the same number of rows, and of centres the square root of all rows."""
    rng = np.random.default_rng(0)
    compared = []
    for n in (20_000, 200_000):
        heart = rng.normal(size=(n // 100, 16)).astype(np.float32)
        x = N._unit(heart[rng.integers(0, len(heart), n)] + 0.3 * rng.normal(size=(n, 16)).astype(np.float32))
        groups = round((n / N.PER_CELL) ** 0.5)
        own = N._nearest(x, mid := N.centres(x[: N.GROUP_SAMPLE * groups], groups))
        size = np.bincount(own, minlength=len(mid))
        rows = np.flatnonzero(own == np.argsort(size)[len(mid) // 2])
        block = N.Block(x[rows])
        block.search(block.q, block.scale, block.error, np.full(len(rows), -2, np.float32), 5, np.arange(len(rows)))
        compared.append(block.compared / len(rows))
        assert size.max() < 5 * n / groups
    assert max(compared) < 1.5 * N.OWN_CELLS * N.PER_CELL


def test_block_search_keeps_the_best():
    """With all cells searched, the pairs that survive the bounds hold every true neighbour."""
    rng = np.random.default_rng(3)
    x = N._unit(rng.normal(size=(900, 64)).astype(np.float32))
    block = N.Block(x)
    one, row = block.search(block.q, block.scale, block.error, np.full(len(x), -2, np.float32), 5, np.arange(len(x)))
    s, fifth = brute(x.astype(float), 5)
    pairs = set(zip(one.tolist(), row.tolist(), strict=True))
    assert all((i, j) in pairs for i in range(len(x)) for j in np.flatnonzero(s[i] >= fifth[i] - 1e-9))


def test_error_bound():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q, scale, error = N.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * scale[:, None] * scale
    assert (np.abs(approx - x @ x.T) <= error[:, None] + error + error[:, None] * error + 1e-6).all()


def test_finer_queries():
    rng = np.random.default_rng(6)
    for dim in (8, 9):
        x = N._unit(rng.normal(size=(50, dim)).astype(np.float32))
        q, scale, error = N.quantise(x)
        more, left = N.finer(x, q, scale)
        y = N.refined(q, N.unpacked(more, dim), scale)
        assert np.allclose(np.linalg.norm(x - y, axis=1), left, atol=1e-6) and (left < error / 6).all()
