import random

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.llm import splitting as S


def check(text, limit=1200, least=50, most=100):
    spans = S.pieces(text, limit, least, most)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, b in spans:
        assert b - a <= limit
    for (a, b), (c, d) in zip(spans, spans[1:], strict=False):
        assert least <= b - c <= most and d > b
    assert (len(spans) > 1) == (len(text) > limit)
    return spans


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .\n,é́‍👩ٹ-"), max_size=200), st.integers(1, 80))
def test_pieces(part, times):
    check(part * times)


def test_boundaries():
    rng = random.Random(2)
    text = "".join("".join(rng.choice("abcdefg") for _ in range(rng.randrange(2, 9))) + rng.choice([" ", " ", " ", ", ", ". ", ".\n\n"]) for _ in range(1500))
    for a, b in check(text)[:-1]:
        assert text[b - 1].isspace() and (not a or text[a - 1].isspace())
    check("x" * 5000)
    check("x" * 1_000_000)
    check("é" * 1201)


def test_operator(spark):
    rows = [("a", "d", 1, "w " * 900), ("a", "d", 1, "w " * 900), ("b", "d", None, "x" * 1200), ("c", None, 2, None), ("e", "d", 2, ""), (None, "d", 3, "y" * 1201)]
    df = spark.createDataFrame([(*r, "clash", 7) for r in rows], "id string, document_id string, page_number int, content string, piece string, begin int")
    assert {r["id"] for r in S.oversized(df).collect()} == {"a", None}
    got = S.split_oversized(df).orderBy("id", "piece_no").collect()
    assert [(r["id"], r["piece_no"], r["page_number"]) for r in got if r["id"] in ("a", "b")] == [("a", 1, 1), ("a", 2, 1), ("b", 1, None)]
    assert [r["piece"] for r in got if r["id"] == "e"] == [""] and not [r for r in got if r["id"] == "c"]
    for r in got:
        assert len(r["piece"]) == r["end"] - r["begin"] <= 1200
    assert S.split_oversized(df.filter("false")).count() == 0
