import random

import numpy as np

from foliospark.llm import near_duplicates as D
from foliospark.llm.words import mix

SCHEMA = "id string, content string, a string, band bigint, key int"


def texts():
    rng = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(90)]
        rows.append((f"g{g}_0", " ".join(base)))
        for k in range(1, 4):
            w = list(base)
            for _ in range(k * 2):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((f"g{g}_{k}", " ".join(w)))
    rows += [("copy1", rows[0][1]), ("copy2", rows[0][1].upper() + "!"), ("short", "a b c"), ("null", None), ("blank", " "), ("long", rows[5][1] * 200)]
    return rows + rows[:3]


def truth(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").lower().replace("!", "").split()
        if len(w) >= 40:
            sets[i] = set(zip(w, w[1:], w[2:], strict=False))
    ids = sorted(sets)
    return {(x, y) for n, x in enumerate(ids) for y in ids[n + 1 :] if len(sets[x] & sets[y]) >= 0.6 * len(sets[x] | sets[y])}


def test_pairs_equal_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(*r, "clash", 1, None) for r in rows], SCHEMA)
    got = {(r["id_a"], r["id_b"]) for r in D.near_duplicate_pairs(df).collect()}
    want = truth(rows)
    assert got <= want and len(want) > 60 and len(got) >= 0.98 * len(want)
    groups = {r["id"]: r["group"] for r in D.near_duplicate_groups(df).collect()}
    for a, b in got:
        assert groups[a] == groups[b]
    assert len(groups) == 103 and "short" not in groups and groups["copy1"] == groups["copy2"] == groups["g0_0"]


def test_hot_group_of_copies(spark):
    df = spark.createDataFrame([(f"c{i}", " ".join(f"w{j}" for j in range(60))) for i in range(60)], "id string, content string")
    assert D.near_duplicate_pairs(df).count() == 60 * 59 // 2
    assert D.near_duplicate_groups(df).select("group").distinct().count() == 1


def test_empty(spark):
    df = spark.createDataFrame([], "id string, content string")
    assert D.near_duplicate_pairs(df).count() == 0 and D.near_duplicate_groups(df).count() == 0


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.6, 0.9):
        got = []
        for _ in range(40):
            n = 120
            both = int(2 * n * share / (1 + share))
            pool = mix(rng.integers(0, 1 << 62, 2 * n - both).astype(np.uint64))
            x, y = pool[:n], np.concatenate((pool[:both], pool[n:]))
            sig = D.super_minhash(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2, 128)
            assert (sig >> np.uint64(48)).max() < 128
            got.append((sig[0] == sig[1]).mean())
        real = both / (2 * n - both)
        assert abs(np.mean(got) - real) < 0.02
        assert np.std(got) <= (real * (1 - real) / 128) ** 0.5 * 1.15  # no more than plain MinHash


def test_crowded_bands_are_split_without_loss(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):  # all alike, no two equal
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        rows.append((f"c{i:03d}", " ".join(w)))
    df = spark.createDataFrame(rows + texts(), "id string, content string").repartition(5)
    want = {tuple(r) for r in D.near_duplicate_pairs(df).collect()}
    assert len([p for p in want if p[0][0] == p[1][0] == "c"]) == 150 * 149 // 2 + 1  # and copy1 with copy2
    monkeypatch.setattr(D, "CROWD", 20)
    monkeypatch.setattr(D, "SAMPLED", 1)
    assert len(D._crowded(D.signed(df, "id", "content", 40, 3))[0]) > 10
    assert {tuple(r) for r in D.near_duplicate_pairs(df).collect()} == want
