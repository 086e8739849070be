import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.config import Config
from foliospark.operators import chunking, embedding, jobs, predicates, retrieval
from foliospark.operators.noise import AdaptiveNoise


def one(spark, value, schema, f):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("x")).alias("r")).first()["r"]


# -- predicates --


@pytest.mark.parametrize(("chars", "image", "expected"), [(49, True, True), (50, True, False), (0, False, False)])
def test_is_scanned(spark, chars, image, expected):
    row = spark.createDataFrame([("x" * chars, image)], "t string, i boolean").select(predicates.is_scanned(F.col("t"), F.col("i")).alias("r")).first()
    assert row["r"] is expected


def test_valid_english(spark):
    known = F.array(*[F.lit(f"known{c}") for c in "abcde"])
    texts = {"nine": "knowna " * 9, "five": " ".join([f"known{c}" for c in "abcde"] + [f"new{c}" for c in "abcde"]), "six": " ".join([f"known{c}" for c in "abcd"] + [f"new{c}" for c in "abcdef"])}
    rows = spark.createDataFrame(list(texts.items()), "k string, t string")
    got = {r["k"]: r["v"] for r in rows.select("k", predicates.is_valid_english_ocr(F.col("t"), known).alias("v")).collect()}
    assert got == {"nine": False, "five": True, "six": False}
    words = spark.createDataFrame([(f"known{c}",) for c in "abcde"], "word string")
    joined = {r["k"]: r["valid"] for r in predicates.with_valid_english(rows, words, "k", "t").collect()}
    assert joined == got


def test_filters_and_blanks(spark):
    df = spark.createDataFrame([("a", (1, "x")), ("b", (2, "x")), ("  ", (1, "y"))], "text string, metadata struct<p: int, n: string>")
    assert [r["text"] for r in df.filter(predicates.metadata_filter({"p": 1, "n": "x"})).collect()] == ["a"]
    assert df.filter(predicates.metadata_filter(None)).count() == 3
    assert predicates.drop_blank(df).count() == 2
    with pytest.raises(ValueError, match="blank"):
        predicates.require_text("  ")


def test_new_files_rejects_hash_and_name(spark):
    known = spark.createDataFrame([("h1", "n1"), (None, "n5")], "file_hash string, filename string")
    files = spark.createDataFrame([("h1", "other"), ("h2", "n1"), ("h3", "n3")], "file_hash string, filename string")
    assert [r["file_hash"] for r in predicates.new_files(files, known).collect()] == ["h3"]


# -- noise --


def test_noise_threshold(spark):
    docs = spark.createDataFrame([(1, "H\nbody one"), (2, "H\nbody two"), (3, "other")], "k int, text string")
    lines = {r["line"]: round(r["frac"], 2) for r in AdaptiveNoise(0.3).fit(docs).noise.collect()}
    assert lines == {"H": 0.67, "body one": 0.33, "body two": 0.33, "other": 0.33}


def test_noise_remove(spark):
    long = "L" * 101
    docs = spark.createDataFrame([(1, f" H \n{long}\nkeep 1"), (2, f"H\n{long}\nkeep 2"), (3, None), (4, "")], "k int, text string")
    got = {r["k"]: r["text"] for r in AdaptiveNoise(0.4).fit(docs).remove(docs, "k").collect()}
    assert got == {1: f"{long}\nkeep 1", 2: f"{long}\nkeep 2", 3: None, 4: ""}
    with pytest.raises(RuntimeError):
        AdaptiveNoise().remove(docs, "k")
    empty = docs.filter("false")
    assert AdaptiveNoise().fit(empty).remove(empty, "k").count() == 0


def test_noise_by_group(spark):
    docs = spark.createDataFrame([("a", 1, "H\nx y"), ("a", 2, "H\nz w"), ("b", 3, "H\nq"), ("b", 4, "r"), ("b", 5, "s")], "site string, k int, text string")
    got = {r["k"]: r["text"] for r in AdaptiveNoise(0.6, group="site").fit(docs).remove(docs, "k").collect()}
    assert got[1] == "x y" and got[3] == "H\nq"


# -- chunks --


def test_sentences(spark):
    assert one(spark, "a۔ b? c!", "x string", chunking.split_urdu_sentences) == ["a", "b", "c!"]
    assert one(spark, "One. Two?\nThree", "x string", chunking.split_english_sentences) == ["One.", "Two?", "Three"]
    assert one(spark, None, "x string", chunking.split_sentences) == []


def test_windows(spark):
    def spans(size):
        got = one(spark, list(range(size)), "x array<int>", lambda c: chunking.long_windows(c, 504, 50))
        return [(w[0], w[-1] + 1) for w in got]

    assert spans(1000) == [(0, 504), (454, 958), (908, 1000)]
    assert spans(504) == [(0, 504)]
    w = chunking.Windows(504, 50)
    assert [(p[0], p[-1] + 1) for p in chunking.pack([list(range(1000))], w)] == [(0, 504), (454, 958), (908, 1000)]


def test_overlap_carry():
    w = chunking.Windows(504, 50)
    assert [len(c) for c in chunking.pack([[0] * 480, [1] * 40], w)] == [480, 90]
    assert [len(c) for c in chunking.pack([[0] * 480, [1] * 480], w)] == [480, 480]


def test_minimum(spark):
    pages = spark.createDataFrame([("h", "f", 3, "w " * 72), ("h", "f", 4, "w " * 73), ("h", "f", 5, None), ("h", "f", 6, " ")], "file_hash string, filename string, page_number int, text string")
    assert [r["id"] for r in chunking.chunk_pages(pages).collect()] == ["f_4_4"]


def test_chunk_numbers(spark):
    text = ". ".join("w " * 20 + "x" for _ in range(4)) + "."
    pages = spark.createDataFrame([("h", "f", 3, text)], "file_hash string, filename string, page_number int, text string")
    got = chunking.chunk_pages(pages, chunking.Windows(45, 0, 3)).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == [3, 4]


def test_arrow_and_native_agree(spark):
    rng = random.Random(3)
    rows = [("h", f"f{i}", i, " ".join("".join(rng.choice("ab.? ") for _ in range(6)) for _ in range(rng.randrange(0, 60)))) for i in range(60)]
    pages = spark.createDataFrame(rows, "file_hash string, filename string, page_number int, text string")
    for w in (chunking.Windows(8, 2, 3, 0), chunking.Windows(5, 0, 1, 2), chunking.Windows(12, 11, 2, 0)):
        a, b = chunking.chunk_pages(pages, w), chunking.chunk_pages(pages, w, native=True)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
        assert a.filter(F.size(F.split("content", " ")) > w.limit).count() == 0


def test_language(spark):
    assert one(spark, "یہ ایک جملہ ہے", "x string", chunking.detect_language) == "ur"
    assert one(spark, "1 2 3", "x string", chunking.detect_language) == "en"


# -- embedding --


def test_zero_fill_and_alignment(spark):
    df = spark.createDataFrame([(1, "a"), (2, " "), (3, "b"), (4, None)], "k int, content string")
    got = {r["k"]: r["embedding"] for r in embedding.embed_documents(df, embedding.HashingEmbedder(8)).collect()}
    assert got[2] == [0.0] * 8 == got[4]
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6)
    assert got[1] == embedding.embed_single("a", embedding.HashingEmbedder(8))
    with pytest.raises(ValueError, match="blank"):
        embedding.embed_single(" ", embedding.HashingEmbedder(8))


def test_throughput(spark):
    df = embedding.embed_documents(spark.createDataFrame([("a",), (" ",), ("b",)], "content string"), embedding.HashingEmbedder(4))
    watched, seen = embedding.with_throughput(df)
    watched.collect()
    assert seen.get == {"rows": 3, "embedded": 2}


def test_l2(spark):
    assert one(spark, [3.0, 4.0], "x array<double>", embedding.l2_normalize) == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], "x array<double>", embedding.l2_normalize) == [0.0, 0.0]


# -- retrieval --


def docs(spark):
    rows = [(f"d{i}", f"doc{i // 3}", f"alpha {'beta ' * i}gamma", [float(i), 1.0], (f"file{i // 3}", i)) for i in range(12)]
    rows += [("dz", "doc9", None, None, (None, None)), ("dy", "doc9", "", [float("nan"), 1.0], ("f", 1)), ("dx", "doc9", "zeta", [0.0, 0.0], ("f", 1)), ("dw", "doc9", "zeta", [1.0], ("f", 1))]
    return spark.createDataFrame(rows, "id string, document_id string, content string, embedding array<float>, metadata struct<filename: string, page_number: int>")


def test_bm25_from_texts_equals_postings(spark):
    d = docs(spark)
    a = {r["id"]: round(r["score"], 9) for r in retrieval.bm25(d, "beta beta zeta none").collect()}
    b = {r["id"]: round(r["score"], 9) for r in retrieval.bm25_indexed(retrieval.postings(d), retrieval.lengths(d), "beta beta zeta none").collect()}
    assert a == b and len(a) == 13
    assert retrieval.bm25(d, "absent").count() == 0 == retrieval.bm25_indexed(retrieval.postings(d), retrieval.lengths(d), "absent").count()


def test_knn_skips_unusable(spark):
    near = retrieval.knn(docs(spark), [0.0, 1.0], 3).collect()
    assert [r["id"] for r in near] == ["d0", "d1", "d2"] and near[1]["score"] == 0.5


def test_knn_many_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8)).round(1)
    x[5] = x[6]
    rows = spark.createDataFrame([(i, [float(v) for v in r], "extra") for i, r in enumerate(x)], "id bigint, embedding array<double>, query string").repartition(5)
    got = {}
    for r in retrieval.knn_many(rows, rows.filter("id % 10 = 0"), 4, "id", dim=8, block=7).collect():
        got.setdefault(r["query"], []).append((round(r["score"], 9), r["id"]))
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for q in range(0, 300, 10):
        best = sorted((-round(1 / (1 + d[q, j]), 9), j) for j in range(300) if j != q)[:4]
        assert sorted((-s, j) for s, j in got[q]) == best
    assert retrieval.knn_many(rows, rows.filter("false"), 4, "id", dim=8).count() == 0


def test_min_max(spark):
    df = spark.createDataFrame([("a", "x", 5.0), ("b", "y", 1.0), ("c", "y", 3.0), ("d", "y", 2.0)], "id string, leg string, score double")
    got = {r["id"]: r["norm"] for r in retrieval.min_max(df).collect()}
    assert got == {"a": 1.0, "b": 0.001, "c": 1.0, "d": 0.5}


def test_fusion_counts_the_missing_leg(spark):
    lex = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "id string, score double")
    vec = spark.createDataFrame([("a", 0.9), ("c", 0.5)], "id string, score double")
    got = {r["id"]: round(r["score"], 6) for r in retrieval.fuse({"l": (lex, 0.3), "v": (vec, 0.7)}).collect()}
    assert got == {"a": 1.0, "b": 0.0003, "c": 0.0007}


def test_roll_up_takes_three(spark):
    rows = [(f"c{i}", "doc", "t", ("name",), 1.0 - i / 10, i + 1, 0.5) for i in range(5)] + [("z", "late", "t", ("other",), 0.9, 6, 0.1)]
    ranked = spark.createDataFrame(rows, "id string, document_id string, content string, metadata struct<filename: string>, score double, rank int, rerank_score double")
    got = retrieval.roll_up(ranked).collect()
    assert [(r["document_id"], r["chunks"], round(r["semantic_score"], 6)) for r in got] == [("doc", 3, 2.7), ("late", 1, 0.9)]
    assert "WindowGroupLimit" in retrieval.roll_up(ranked)._jdf.queryExecution().executedPlan().toString()
    assert retrieval.as_response(retrieval.roll_up(ranked))["doc"]["document_name"] == "name"


def test_rerank(spark):
    hits = spark.createDataFrame([("a", "x y", 0.1), ("b", "x", 0.9), ("c", "x y", 0.2)], "id string, content string, score double")
    assert [r["id"] for r in retrieval.rerank(hits, "x y").orderBy("rank").collect()] == ["c", "a", "b"]
    assert [r["id"] for r in retrieval.rerank(hits, " ").orderBy("rank").collect()] == ["b", "c", "a"]


def test_top_k_is_partial(spark):
    plan = retrieval.knn(docs(spark), [0.0, 1.0], 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_config(spark, monkeypatch):
    monkeypatch.setenv("FOLIOSPARK_OVERLAP", "7")
    assert Config.load().overlap == 7 and Config.load(spark).k1 == 1.2


def test_jobs(spark):
    from datetime import datetime as D

    rows = [("j", "f", "queued", None, D(2024, 1, 1)), ("j", "f", "failed", "no", D(2024, 1, 3)), ("j", "f", "processing", None, D(2024, 1, 2)), ("k", None, "queued", None, None), (None, "f", "queued", None, None)]
    df = spark.createDataFrame(rows, "job_id string, filename string, status string, error string, updated_at timestamp")
    assert jobs.status(df.union(df), "j") == {"status": "failed", "filename": "f", "error": "no"}
    assert jobs.status(df, "absent") == {"error": "job not found"}
    assert jobs.latest(df).count() == 2


def test_one_per_key_and_upsert(spark):
    from foliospark.operators.upsert import one_per_key, upsert

    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), ("b", 1, "q"), (None, 1, "n")], "k string, n int, s string").repartition(3)
    assert {tuple(r) for r in one_per_key(rows, "k", ("n", "s")).collect()} == {("a", 1, "y"), ("b", None, "z"), (None, 1, "n")}
    assert one_per_key(rows.filter("false"), "k", ("n",)).count() == 0
    new = spark.createDataFrame([("b", 9, "new"), ("c", 9, "new")], "k string, n int, s string")
    assert sorted(map(str, (r["s"] for r in upsert(rows.filter("k is null or k = 'b'"), new, "k").collect()))) == ["n", "new", "new"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_subword_chunks(spark, name):
    from foliospark.operators.tokenizers import FOLDER, SubWord

    if not os.path.exists(f"{FOLDER}/{name}"):
        pytest.skip("no vocabularies here")
    tok = SubWord(name)
    w = chunking.Windows(limit=20, overlap=4, minimum=6)
    page = [f"The committee approved survey number {i} of the harbour." for i in range(12)] + ["unsplittable" * 20 + ".", "دیکھ بھال <|endoftext|>."]
    df = spark.createDataFrame([(page,), ([],), (None,)], "s array<string>").select(chunking.pack_udf(w, tok)(F.col("s")).alias("c"))
    got = [r["c"] for r in df.collect()]
    assert got[1:] == [[], []] and len(got[0]) > 8
    assert all(6 <= len(tok.encode(c)) + w.special <= 20 + w.special + 3 for c in got[0])
    for i in range(12):
        assert any(f"number {i} of" in c for c in got[0])
    assert any("<|endoftext|>" in c for c in got[0])


def test_batches_of_blank_texts_are_an_error():
    e = embedding.HashingEmbedder(8)
    got = embedding.embed_batch(["a b", " ", None, "c"], e)
    assert got.shape == (4, 8) and not got[1].any() and not got[2].any() and abs(float((got[0] ** 2).sum()) - 1) < 1e-6
    for texts in ([], [" ", None]):
        with pytest.raises(ValueError, match="no text"):
            embedding.embed_batch(texts, e)


def test_costly_readers_are_built_once():
    from foliospark.sources.pages import cached_reader

    built = []
    assert cached_reader("t", lambda: built.append(1) or "r") == cached_reader("t", lambda: built.append(1) or "r") == "r" and built == [1]


def test_release_deletes_what_materialise_wrote(spark):
    from foliospark import session

    session.release(spark)
    df = session.materialise(spark.range(3), "t")
    assert df.count() == 3 and session.release(spark) == 1 and session.release(spark) == 0
