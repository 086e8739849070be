import random

import numpy as np
import pyarrow as pa

from foliospark.llm import subjects as S
from foliospark.llm.words import words

TERMS = {"tax": ["import duty", "stamp duty", "late assessment"], "sport": ["penalty kick", "doping sample", "stadium ban"], "traffic": ["zebra crossing", "speed camera", "tyre tracks"]}
NONE = ["Costs follow the event.", "The appeal is admissible.", "Leave was granted by order."]


def decision(areas, rng, mention=None):
    lines = ["COURT OF X", "Case 1", f"Headnote: The {rng.choice(TERMS['sport'])} is judged by effect."]
    for n in range(1, 13):
        a = areas[n % len(areas)] if n % 3 else None
        s = f"Whether the {rng.choice(TERMS[a])} sufficed is open. The witness spoke of the {rng.choice(TERMS[a])}." if a else " ".join(rng.sample(NONE, 2))
        if mention and n == 5:
            s += f" The parties also mentioned the {rng.choice(TERMS[mention])}, which has no bearing."
        lines.append(f"{n}) {s}")
    return "\n".join([*lines, "Operative part: The appeal is allowed."])


def tables(spark):
    rng = random.Random(3)
    names = sorted(TERMS)
    docs, labels, truth = [], [], {}
    for i in range(400):
        areas = [names[i % 3]] if i % 4 else [names[i % 3], names[(i + 1) % 3]]
        truth[i] = set(areas)
        docs.append((i, decision(areas, rng, names[(i + 2) % 3] if i % 5 == 0 else None), f"court-{i % 3}"))
        if i % 5 < 2:
            labels += [(i, f"{a.upper()}" if i % 2 else f"{a} law") for a in areas]
    labels += [(0, None), (3, "unknown"), (None, "tax"), (10, "sport" if "sport" not in truth[10] else "tax")]
    docs += [(1000, None, "x"), (1001, "", None), (1002, "no decision at all " * 20, "court-1"), (1003, "a" * 500_000, None), (399, docs[399][1], "court-0")]
    d = spark.createDataFrame([(*r, "clash", 0.1) for r in docs], "doc_id bigint, text string, source string, area string, share double")
    return d, spark.createDataFrame(labels, "doc_id bigint, area string"), spark.createDataFrame([(a, a) for a in names] + [(None, "x")], "area string, description string"), truth


def test_areas(spark):
    docs, labels, areas, truth = tables(spark)
    got = {}
    for r in S.subject_areas(docs, labels, areas).collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
        assert 0 <= r["share"] <= 1 and 0 <= r["confidence"] <= 1
    held_out = [i for i in truth if i % 5 > 1]
    assert sum(got.get(i) == truth[i] for i in held_out) / len(held_out) > 0.97
    assert not {1000, 1001, 1002, 1003} & set(got)
    assert {r["area"]: r["documents"] for r in S.composition(S.subject_areas(docs, labels, areas)).collect()}.keys() == set(TERMS)


def test_empty(spark):
    docs, labels, areas, _ = tables(spark)
    assert S.subject_areas(docs.filter("false"), labels, areas).count() == 0
    assert S.subject_areas(docs, labels.filter("false"), areas).count() == 0
    assert S.subject_areas(docs, labels, areas.filter("false")).count() == 0


def test_paragraphs():
    text = "[1] one\n[2008] OSR 1.\n2) two\n  goes\n3.\tthree\n(4) four\ngoes on\n9 no\n§ 5 five"
    assert [text[a:b] for a, b in S.paragraphs(text)] == ["one", "two", "three", "four\ngoes on", "five"]


def test_the_share_that_counts_is_learned():
    """Features hold no threshold: classifiers that see labels by another share find that share."""
    rng = np.random.default_rng(1)
    for cut in (0.25, 0.5):
        share = rng.integers(0, 21, (1200, 2)) / 20
        odds = np.log((share * 20 + 0.25) / (20 - share * 20 + 0.25))
        own = np.stack((share, odds, np.maximum(odds - odds.mean(axis=1, keepdims=True), 0), share), axis=2)
        labels = share >= cut - 1e-9
        chosen, _ = S.decode(S.fit_chain(own, np.zeros((1200, 2 + S.SOURCES)), labels), own, np.zeros((1200, 2 + S.SOURCES)))
        assert ((chosen > 0) == labels).mean() > 0.99


def test_chain_and_beam_change_results():
    """The second area comes with the first or the third only; its own evidence is worth little."""
    rng = np.random.default_rng(2)
    n = 3000
    labels = np.zeros((n, 3), bool)
    labels[:, 0] = rng.random(n) < 0.5
    labels[:, 1] = labels[:, 0] & (rng.random(n) < 0.9)
    labels[:, 2] = labels[:, 1] & (rng.random(n) < 0.95)
    own = np.repeat(labels[:, :, None].astype(float), 4, axis=2) + rng.normal(size=(n, 3, 4)) * np.array([1.5, 6, 0.8])[None, :, None]
    whole = np.zeros((n, 2 + S.SOURCES))
    chain = S.fit_chain(own[: n // 2], whole[: n // 2], labels[: n // 2])
    alone = [(np.concatenate((w[: 5 + whole.shape[1]], np.zeros(3))), platt) for w, platt in chain]
    held = slice(n // 2, n)
    right = [((S.decode(c, own[held], whole[held], beam)[0] > 0) == labels[held]).all(axis=1).mean() for c, beam in ((chain, S.BEAM), (chain, 1), (alone, S.BEAM))]
    assert right[0] > right[1] and right[0] > right[2] + 0.05


def test_words_of_the_court_decide_nothing():
    rng = random.Random(4)
    names = sorted(TERMS)
    own = [names[i % 3] for i in range(300)]
    s = S.Sentences(pa.array([decision([a], rng) for a in own]))
    tells = S.telling(s, np.array([[a == b for b in names] for a in own]))
    bucket = lambda word: int(words(pa.array([word])).hash[0] & np.uint64(S.BUCKETS - 1))
    assert all(tells[bucket(w)] for w in ("duty", "stadium", "zebra", "camera"))
    assert not any(tells[bucket(w)] for w in ("whether", "witness", "appeal", "spoke", "open", "sufficed"))
