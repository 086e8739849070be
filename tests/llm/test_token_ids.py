import random

import pytest

from foliospark.llm import token_ids as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


TEXTS = ["", " ", "a", "Hello world's end", "<|endoftext|> x", "naïve Zoë  \n\n tab\t", "👩‍⚖️ 𝔡𝔢𝔲", "éé", "\x00 null", "it's we'll I'd", "   lead", "trail   ", "0123456789" * 9, "!!!'s''s!!", "دیکھ بھال ۔", "  x"]


@pytest.mark.parametrize("leaf", [16, 40, 100000])
def test_trees_equal_whole_texts(reference, leaf):
    enc = T._encoding(T.rank_file())
    rng = random.Random(4)
    alphabets = ["ab", "abc \n", "0123", "!?.'", "aé ", "ABCdef 12 ,.", "سم ", "'s't ", "x"]
    texts = TEXTS + ["".join(rng.choice(a) for _ in range(rng.randrange(1, 700))) for a in alphabets for _ in range(40)]
    for t in texts:
        assert T.encode(enc, t, leaf) == reference(t) == enc.encode_ordinary(t), (leaf, t)


def test_long_unsplit_text():
    enc = T._encoding(T.rank_file())
    rng = random.Random(9)
    for a in ("abcdefghij", "01", "-=", "é", "aA", "文字", " \n", "-'", "'s"):
        t = "".join(rng.choice(a) for _ in range(20000))
        assert T.encode(enc, t, 256) == enc.encode_ordinary(t)
        assert max(len(x) for x, _ in T.leaves(t, 256)) <= 256


@pytest.mark.parametrize("text", ["文" * 1300 + "\n\n\n\n" + "-" * 12 + "文" * 1306, "文" * 1302 + "------'re" + "文" * 1306, "é " * 3000, "\n" * 5000 + "a", " " * 9000, "a" * 5000 + "'s" + "b" * 4000])
def test_joins_next_to_bounds_of_pre_tokens(text):
    enc = T._encoding(T.rank_file())
    assert T.encode(enc, text) == enc.encode_ordinary(text)


def test_random_texts_of_awkward_parts():
    enc = T._encoding(T.rank_file())
    rng = random.Random(3)
    parts = ["文", "字", "\n", "\n\n", " ", "  ", "\xa0", "\u2009", "'", "'s", "'re", "'ll", "'d", "'ve", "-", "--", "=", "!", "a", "ab", "the", "é", "ß", "1", "23", "²", "५", "س", "م", "।", "\t", "\r\n", "😀", "\u200d", "\x1c", "ﬁ", "ǅ", "Ⅷ", "\ue000", "\u0301"]
    for _ in range(1200):
        few = rng.sample(parts, rng.randrange(1, 7))
        t = "".join(rng.choice(few) * rng.choice((1, 1, 1, 2, 9, 40)) for _ in range(rng.randrange(1, 60)))
        expected = enc.encode_ordinary(t)
        for leaf in (1, 2, 16, 64, 2048):
            assert T.encode(enc, t, leaf) == expected, (leaf, t)
            pieces = T.leaves(t, 4 * leaf)  # as they travel over the cluster
            assert "".join(x for x, _ in pieces) == t
            assert T.join_all(enc, [(T.encode(enc, x, leaf, w), w) for x, w in pieces]) == expected, (leaf, t)


def test_operator(spark, reference):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, None), (101, "word " * 3000), (101, "word " * 3000), (None, "k"), (102, "".join(rng.choice("abcd") for _ in range(3000))), (103, "文" * 700 + "\n\n\n" + "-" * 300 + "字" * 400)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id bigint, text string, ids string, _no int")
    got = [(r["doc_id"], r["ids"]) for r in T.encode_corpus(df, leaf_chars=50, spread_chars=200).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted([(i, reference(t) if t else []) for i, t in rows], key=key)
    assert T.encode_corpus(df.filter("false")).count() == 0
    assert dict(T.encode_corpus(df).dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
