import pytest
from pyspark.sql import functions as F

from foliospark.functions import bulk
from foliospark.functions import cleaning as C
from foliospark.functions.register import register

CASES = [
    (C.nfkc, "ﬁle", "file"),
    (C.fix_mojibake, "Ã©tÃ© â€œdÃ©jÃ\xa0â€\x9d", "été “déjà”"),
    (C.fix_mojibake, "ÃƒÂ©", "é"),
    (C.fix_mojibake, "Ø¯ÛŒÚ©Ú¾", "دیکھ"),
    (C.fix_mojibake, "Größe»«Straße» É« l’été Её мир", "Größe»«Straße» É« l’été Её мир"),
    (C.clean_encoding, "Ã©ï¬\x81", "éfi"),
    (C.private_use_to_space, "ab", "a b"),
    (C.strip_structural_noise, "ok\n***junk\n** x", "ok\n\n** x"),
    (C.remove_headers_footers, "x\n12 | P a g e\ny", "x\n\ny"),
    (C.remove_headers_footers, "a\n12\nb", "a\n\nb"),
    (C.fix_hyphenation, "é-\né", "éé"),
    (C.fix_hyphenation, "a- \nb", "a- \nb"),
    (C.fix_hyphenation, "a-\nb-\nc", "ab-\nc"),
    (C.normalize_linebreaks, "a\nb\n\n\n\nc", "a b\n\nc"),
    (C.normalize_whitespace, "  a \t b\n", "a b"),
    (C.normalize_whitespace, " a b　", "a b"),
    (C.deduplicate_paragraphs, "p\n\nq\n\n p \n\n", "p\n\nq"),
    (C.clean_formatting_artifacts, "webpage 3 of 9 ---- x", "web   x"),
    (C.remove_short_lines, "ab\n\nc\n de ", "ab\n de "),
    (C.fix_numeric_spacing, "3 . 5", "3.5"),
    (C.fix_numeric_spacing, "1 - 2 - 3", "1-2 - 3"),
    (C.fix_numeric_spacing, "7 %", "7%"),
    (C.fix_numeric_spacing, "3.5 . 1", "3.5.1"),
    (C.fix_letter_spacing, "x A B C y", "xABCy"),
    (C.fix_letter_spacing, "A\tB C", "A\tBC"),
    (C.fix_letter_spacing, "A B", "A B"),
    (C.fix_letter_spacing, "é a b c", "é abc"),
    (C.fix_common_ocr_confusions, "a0b0c 10 1", "aObOc 10 1"),
    (C.fix_common_ocr_confusions, "0a", "0a"),
    (C.remove_garbage_lines, "--\na\nok\n_*_", "ok"),
    (C.preprocess_digital, "p one\n\np one", "p one\np one"),
    (C.preprocess_ocr, "ab\n\ncd", "ab cd"),
    (C.preprocess_urdu_ocr, "a^~|& b  c\n", "a b c "),
]


@pytest.mark.parametrize(("step", "given", "expected"), CASES)
def test_step(spark, step, given, expected):
    row = spark.createDataFrame([(given,)], "t string").select(step(F.col("t")).alias("r")).first()
    assert row["r"] == expected


@pytest.mark.parametrize("step", sorted({c[0].__name__ for c in CASES}))
def test_null_and_empty(spark, step):
    f = getattr(C, step)
    rows = spark.createDataFrame([(None, 0), ("", 1), (" ", 2)], "t string, n int").select("n", f(F.col("t")).alias("r")).orderBy("n").collect()
    assert rows[0]["r"] is None
    assert rows[1]["r"] == ""
    assert rows[2]["r"].strip() == ""


def test_bulk_equals_expressions(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    both = pages.select(C.preprocess_page(F.col("text"), F.col("source_type")).alias("a"), "text", "source_type")
    both = both.select("a", bulk.preprocess_page_bulk(F.col("text"), F.col("source_type")).alias("b"))
    assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def test_sql_functions_equal_the_steps(spark):
    names = register(spark)
    assert len(names) == len(bulk.single()) + 2
    df = spark.createDataFrame([(g,) for _, g, _ in CASES] + [(None,), ("",)], "t string")
    for name in sorted(bulk.single()):
        both = df.select(getattr(C, name)(F.col("t")).alias("a"), F.expr(f"folio_{name}(t)").alias("b"))
        assert both.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0, name


def test_dispatch_leaves_unknown_alone(spark):
    rows = spark.createDataFrame([("a\nb", "unknown"), ("a\nb", None), ("ab\ncd", "digital")], "t string, s string")
    got = [r["r"] for r in rows.select(C.preprocess_page(F.col("t"), F.col("s")).alias("r")).collect()]
    assert got == ["a\nb", "a\nb", "ab cd"]


def test_chain_stays_in_the_jvm(spark):
    df = spark.createDataFrame([("a",)], "t string").select(C.chain(F.col("t"), C.DIGITAL))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_very_long_text(spark):
    text = "word " * 400_000
    row = spark.createDataFrame([(text,)], "t string").select(F.length(C.chain(F.col("t"), C.DIGITAL)).alias("n")).first()
    assert row["n"] == len(text.strip())
