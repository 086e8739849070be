import random
import re

import pyarrow as pa
import pytest

from foliospark.llm import leaks as K
from foliospark.llm.words import words


def truth(docs, items):
    w = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    grams = {}
    for i, t in items:
        x = w(t)
        for k in range(len(x) - 12):
            grams.setdefault(tuple(x[k : k + 13]), set()).add(i)
    out = {}
    for d, t in docs:
        x = w(t)
        for g in {tuple(x[k : k + 13]) for k in range(len(x) - 12)}:
            for i in grams.get(g, ()):
                out.setdefault((d, i), set()).add(g)
    return {k: len(v) for k, v in out.items()}


@pytest.mark.parametrize("bits", [1 << 28, 1 << 16])
def test_equals_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(K, "MOST_BITS", bits)
    rng = random.Random(bits)
    vocab = [f"w{i}" for i in range(60)] + ["é", "Ä1", "x_y", "3"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([5, 12, 13, 60, 60, 60, 60])))) for i in range(40)] + [(90, None), (91, ""), (5, "again " * 20), (None, "z " * 20)]
    docs = []
    for d in range(120):
        t = [rng.choice(vocab) for _ in range(80)]
        if d % 2:
            s = (items[d % 40][1] or "").upper().replace(" ", ",\n ").split(" ")
            cut = rng.choice([12, 13, 16, 20])
            at = rng.randrange(60)
            t[at:at] = s[3 : 3 + cut]
        docs.append((d, " ".join(t)))
    docs += [(500, None), (501, ""), (1, docs[1][1]), (502, " ".join(docs[3][1] for _ in range(500))), (None, "none")]
    a = spark.createDataFrame([(*r, 7, "clash") for r in docs], "doc_id bigint, text string, item_id int, signature string").repartition(3)
    b = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["windows"] for r in K.leaks(a, b).collect()}
    want = {k: v for k, v in truth(docs, items).items() if k[1] is not None}
    assert got == want and len(want) > 10
    size: dict = {}
    for i, t in items:
        size[i] = size.get(i, 0) + truth([(0, t)], [(i, t)]).get((0, i), 0)
    half = {(r["doc_id"], r["item_id"]) for r in K.leaks(a, b, containment=0.1).collect()}
    assert half == {k for k, v in want.items() if v >= 0.1 * size[k[1]]} and 0 < len(half) < len(want)


def test_signatures_agree_for_equal_windows_only():
    one = words(pa.array([" ".join(f"a{i}" for i in range(40))]))
    two = words(pa.array([" ".join([*(f"b{i}" for i in range(9)), *(f"a{i}" for i in range(10, 30)), "c"])]))
    s, t = K.signatures(one)[1], K.signatures(two)[1]
    assert {x for x in s.tolist() if x in set(t.tolist())} >= set(s[10:18].tolist())
    assert not set(s[:5].tolist()) & set(t.tolist())


def test_empty(spark):
    a, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([(1, "a " * 20)], "item_id bigint, text string")
    assert K.leaks(a, b).count() == 0 and K.leaks(b.withColumnRenamed("item_id", "doc_id"), b.filter("false")).count() == 0
