import random

import numpy as np

from foliospark.llm import scans as S

WORDS = "committee approved drainage survey before quarter returned invoices register evacuation district previous meeting schedule pre and post".split()


def pages(spark):
    rng = random.Random(1)
    clean = [(i, f"d{i}", 1, " ".join(rng.choice(WORDS) for _ in range(60)), "digital") for i in range(60)]
    ocr = [
        (100, "h", 1, "Annual report of Calder 7  1\nthe comrnittee appr0ved the drain-\nage survey", "ocr"),
        (101, "h", 2, "ANNUAL REPORT OF CALDER 7 ........ 2\nthe s u r v e y before quarter", "ocr"),
        (102, "h", 3, "the invoices\nregister\nPage 3 of 9", "unknown"),
        (103, "h", 4, "mean pre-\nand post-audit H2O-3 of the 1st register in 2019-2021", "ocr"),
        (104, "h", 5, "دیکھ بھ~ال کا ح|کم", "urdu_ocr"),
        (105, "h", 6, None, "ocr"),
        (106, None, None, "", "ocr"),
        (107, "h", 7, "returned sche-\n- 7 -\ndule", "ocr"),
        (108, "d1", 1, "comrnittee", "digital"),
        (109, "h", 9, "committee register " * 50000, "ocr"),
    ]
    return spark.createDataFrame([(*r, "clash", "x") for r in clean + ocr + ocr[:1]], "page_id bigint, file_hash string, page_number int, text string, source_type string, kinds string, word string")


def meta(spark):
    return spark.createDataFrame([("h", "Annual report of Calder 7"), ("h", None), (None, "x")], "file_hash string, title string")


def test_kinds_and_text(spark):
    got = {r["page_id"]: r for r in S.repaired(pages(spark), meta(spark)).collect()}
    assert {k: set(r["kinds"]) for k, r in got.items()} == {100: {"furniture", "glyph", "hyphen"}, 101: {"furniture", "glyph"}, 102: {"furniture"}, 103: set(), 104: {"glyph"}, 105: set(), 106: set(), 107: {"furniture", "hyphen"}, 109: set()}
    assert got[100]["text"] == "the committee approved the drainage survey"
    assert got[101]["text"] == "the survey before quarter"
    assert got[104]["text"] == "دیکھ بھال کا حکم"
    assert got[105]["text"] is None and got[106]["text"] == ""
    assert got[107]["text"] == "returned schedule"
    assert S.found(pages(spark), meta(spark)).count() == 9


def test_empty(spark):
    none = pages(spark).filter("false")
    assert S.found(none, meta(spark)).count() == 0
    assert S.repaired(pages(spark).filter("source_type = 'ocr'"), meta(spark).filter("false")).count() == 8


def test_context_chooses_between_candidates():
    reader = S.Reader(["clay", "day", "pot", "night"], [50, 50, 50, 50], np.zeros((4, S.DIM), np.float32))
    reader.vecs[0], reader.vecs[1] = reader.signs[2], reader.signs[3]
    reader.candidates = lambda w: ("clay", "day") if w == "c1ay" else ()
    assert reader.correct("c1ay", ["pot"]) == "clay" and reader.correct("c1ay", ["night"]) == "day"


def test_numbered_headers():
    for line, page in (("Some title 12  3", 3), ("3  Some title 12", 3), ("Some title ........ 3", 3), ("Some title 12 | Issue-8", 1)):
        assert S.is_numbered_header(line, page), line
    for line, page in (("Some title 12  3", 4), ("reported on 3 May 2012", 2012), ("a | b", 1)):
        assert not S.is_numbered_header(line, page), line


def test_page_numbers():
    for line, page in (("- 12 -", None), ("Page 3 of 9", None), ("3/9", None), ("12 | P a g e", None), ("[7]", None), ("p. 5", None), ("صفحہ 4", None), ("5", 5), ("iv", 4), ("xii", 12)):
        assert S.is_page_number(line, page), line
    for line, page in (("5", 6), ("2017.", 4), ("iv", 5), ("12 March 2020", None), ("page of it", None), ("", 1)):
        assert not S.is_page_number(line, page), line


def test_header_known_from_digital_pages(spark):
    body = "\nthe committee approved the survey before the quarter.\nthe register was returned to the district.\n"
    rows = [(i, "h", i, f"Doren Selik: Safety notice 101 for Velbury{body}the invoices of part {i}.", "digital") for i in range(1, 5)]
    rows += [(5, "h", 5, f"Doren Selik: Safety notice 101 for Velbury{body}the end.", "ocr"), (6, None, 1, f"Doren Selik: Safety notice 101 for Velbury{body}the end.", "ocr")]
    got = {r["page_id"]: set(r["kinds"]) for r in S.repaired(spark.createDataFrame(rows, "page_id bigint, file_hash string, page_number int, text string, source_type string")).collect()}
    assert got == {5: {"furniture"}, 6: set()}


def test_author_and_title(spark):
    body = "\nthe committee approved the survey before the quarter.\nthe register was returned to the district."
    lines = ["Doren Selik: Safety notice 101", "Safety notice 101 - Renke de Ulm", "renke de ulm, Safety notice 101", "Subject: Safety notice 101", "Doren Selik: the invoices of 101"]
    rows = [(i, "h", i, x + body, "ocr") for i, x in enumerate(lines)]
    meta = spark.createDataFrame([("h", "Safety notice 101", "Renke de Ulm")], "file_hash string, title string, author string")
    got = [r["kinds"] for r in S.repaired(spark.createDataFrame(rows, "page_id bigint, file_hash string, page_number int, text string, source_type string"), meta).orderBy("page_id").collect()]
    assert got == [["furniture"]] * 3 + [[]] * 2


def test_header_of_few_pages_in_a_large_file(spark):
    mark = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(400)]
    rows = [(i, "h", i, f"{'Section of the drainage survey' if i < 6 else 'Costs of the harbour 12 | ' + str(i) if i < 8 else mark[i] * 6}\nthe invoices {mark[i]}.\nthe quarter.", "ocr") for i in range(400)]
    rows += [(None, "h", 401, "the quarter.\nSection of the drainage survey\nthe end.", "ocr"), (None, "other", 1, "Section of the drainage survey\nthe end.", "ocr")]
    df = spark.createDataFrame(rows, "page_id bigint, file_hash string, page_number int, text string, source_type string")
    got = S.repaired(df).collect()
    assert len(got) == 402 and sorted(str(r["page_id"]) for r in got if r["kinds"]) == ["0", "1", "2", "3", "4", "5", "6", "7", "None"]


def test_vectors_decide_what_is_corrected(spark, monkeypatch):
    """The same rare form is corrected where its neighbours are those of the frequent word, and left alone where they are not."""
    rng = random.Random(7)
    port, farm = "ship quay mole tide crane anchor".split(), "wheat barn plough sheep meadow tractor".split()
    rows = []
    for i in range(120):
        a, b = (port, "harbour") if i % 2 else (farm, "orchard")
        rows.append((i, f"f{i}", 1, " ".join(f"{rng.choice(a)} {b} {rng.choice(a)}" for _ in range(12)), "digital" if i % 3 else "ocr"))
    rows += [(200, "x", 1, "tide harhour quay and ship", "ocr"), (201, "x", 2, "sheep barbour wheat and barn", "ocr"), (202, "x", 3, "barn orehard sheep", "ocr")]
    df = spark.createDataFrame(rows, "page_id bigint, file_hash string, page_number int, text string, source_type string")
    read = lambda: {r["page_id"]: r["text"] for r in S.repaired(df).filter("page_id >= 200").collect()}
    assert read() == {200: "tide harbour quay and ship", 201: "sheep barbour wheat and barn", 202: "barn orchard sheep"}
    real = S.vectors
    monkeypatch.setattr(S, "vectors", lambda said, size: 0 * real(said, size))
    assert read() == {200: "tide harhour quay and ship", 201: "sheep barbour wheat and barn", 202: "barn orehard sheep"}


def test_candidates_of_long_and_badly_damaged_words():
    long = "immunization" * 6
    reader = S.Reader(["collaboration", "section", long], [9, 9, 9], np.zeros((3, S.DIM), np.float32))
    assert reader.candidates("c0l1ab0rat10n") == ("collaboration",)
    assert reader.candidates(long.replace("o", "0")) == (long,)
    assert reader.candidates("sectíon") == ("section",) and reader.candidates("1" * 400) == () == reader.candidates("ill" * 400)
