"""The pN_ queries over the tables of a folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import boilerplate, encoding_repair, language, leaks, near_duplicates, neighbours, scans, splitting, subjects, token_ids
from foliospark.tables import load, spread

Query = Callable[[SparkSession, str], DataFrame]


def _rows(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A table of texts; one that is stored in few pieces is spread over all cores first."""
    return spread(load(spark, folder, table))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.repaired(_rows(spark, folder, "pages")).select("page_id").distinct()


def p1_text(spark: SparkSession, folder: str) -> DataFrame:
    return encoding_repair.repair_all(_rows(spark, folder, "pages"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.found_lines(_rows(spark, folder, "pages")).select("page_id", "line_no")


def p2_text(spark: SparkSession, folder: str) -> DataFrame:
    return boilerplate.strip_lines(_rows(spark, folder, "pages")).select("page_id", "text", "removed")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return scans.found(_rows(spark, folder, "pages"), load(spark, folder, "file_meta"))


def p3_text(spark: SparkSession, folder: str) -> DataFrame:
    return scans.repaired(_rows(spark, folder, "pages"), load(spark, folder, "file_meta")).select("page_id", "text")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.neighbour_pairs(load(spark, folder, "vector_index"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(_rows(spark, folder, "chunks"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(_rows(spark, folder, "chunks"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return language.stretches(_rows(spark, folder, "pages"), load(spark, folder, "page_labels")).select("page_id", "seg_no", "lang")


def p6_stretches(spark: SparkSession, folder: str) -> DataFrame:
    return language.stretches(_rows(spark, folder, "pages"), load(spark, folder, "page_labels"))


def p6_pages(spark: SparkSession, folder: str) -> DataFrame:
    return language.page_languages(_rows(spark, folder, "pages"), load(spark, folder, "page_labels"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized(_rows(spark, folder, "chunks"))


def p7_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.split_oversized(_rows(spark, folder, "chunks"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return token_ids.encode_corpus(_rows(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(_rows(spark, folder, "documents"), load(spark, folder, "eval_items")).select("doc_id", "item_id")


def _areas(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.subject_areas(_rows(spark, folder, "documents"), load(spark, folder, "doc_labels"), load(spark, folder, "subject_areas"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return _areas(spark, folder).select("doc_id", "area")


def p10_composition(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.composition(_areas(spark, folder))


def queries() -> dict[str, Query]:
    named = (p1_found, p1_text, p2_found, p2_text, p3_found, p3_text, p4_found, p5_found, p5_groups, p6_found, p6_stretches, p6_pages, p7_found, p7_pieces, p8_ids, p9_found, p10_found, p10_composition)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    """SQL of the queries whose definition SQL can express on whole tables."""
    word, letter = r"[\p{L}\p{N}]+", r"\P{L}+"
    words = f"regexp_extract_all(lower(%s), '{word}')"
    lines = f"""WITH cut AS (SELECT page_id, file_hash, lower(string_split(filename, '_')[1]) AS site, string_split(text, chr(10)) AS l FROM pages WHERE filename IS NOT NULL AND file_hash IS NOT NULL),
line AS (SELECT page_id, file_hash, site, n AS line_no, l[n] AS line FROM (SELECT *, unnest(range(1, len(l) + 1)) AS n FROM cut)),
keyed AS (SELECT *, lower(upper(regexp_replace(line, '{letter}', '', 'g'))) AS k FROM line WHERE length(line) <= {boilerplate.LONGEST}),
files AS (SELECT site, count(DISTINCT file_hash) AS all_files FROM cut GROUP BY site),
nodes AS (SELECT site, k FROM keyed JOIN files USING (site) WHERE length(k) >= {boilerplate.LEAST_LETTERS} GROUP BY site, k, all_files HAVING count(DISTINCT file_hash) >= {boilerplate.LEAST_FILES} AND count(DISTINCT file_hash) >= {boilerplate.LEAST_SHARE} * all_files)"""

    def grams(key: str, table: str) -> str:
        return f"SELECT {key}, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 11)) AS i FROM (SELECT {key}, {words % 'text'} AS w FROM {table}))"

    shingles = f"""WITH c AS (SELECT DISTINCT id, {words % "content"} AS w FROM (SELECT DISTINCT id, content FROM chunks)), s AS (SELECT DISTINCT id, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM c WHERE len(w) >= 40)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), both_in AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)"""
    pairs = "SELECT id_a, id_b FROM both_in JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE k >= 0.6 * (x.n + y.n - k)"
    vectors = "SELECT id, embedding::DOUBLE[] AS v FROM vector_index WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
    return {
        "p2_text": f"""{lines}, gone AS (SELECT page_id, line_no FROM keyed JOIN nodes USING (site, k)), parts AS (SELECT page_id, n AS line_no, l[n] AS line FROM (SELECT page_id, string_split(text, chr(10)) AS l, unnest(range(1, len(l) + 1)) AS n FROM pages)),
kept AS (SELECT page_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE g.page_id IS NULL), '') AS text, count(g.page_id) AS removed FROM parts p LEFT JOIN gone g USING (page_id, line_no) GROUP BY page_id)
SELECT page_id, kept.text, coalesce(removed, 0)::INT AS removed FROM pages LEFT JOIN kept USING (page_id)""",
        "p4_found": f"""WITH v AS ({vectors}), s AS (SELECT a.id AS x, b.id AS y, list_cosine_similarity(a.v, b.v) AS c FROM v a, v b WHERE a.id <> b.id), r AS (SELECT x, y, row_number() OVER (PARTITION BY x ORDER BY c DESC, y) AS n FROM s)
SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE n <= 5""",
        "p5_groups": f"""{shingles.replace("WITH c", "WITH RECURSIVE c", 1)}, pairs AS ({pairs}), links AS (SELECT id_a AS x, id_b AS y FROM pairs UNION ALL SELECT id_b, id_a FROM pairs), reach AS (SELECT id, id AS other FROM n UNION SELECT reach.id, y FROM reach JOIN links ON reach.other = x)
SELECT id, min(other) AS "group" FROM reach GROUP BY id""",
        "p2_found": f"{lines} SELECT page_id, line_no FROM keyed JOIN nodes USING (site, k)",
        "p5_found": f"{shingles} {pairs}",
        "p7_found": "SELECT DISTINCT id FROM chunks WHERE length(content) > 1200",
        "p9_found": f"SELECT DISTINCT doc_id, item_id FROM ({grams('doc_id', 'documents')}) JOIN ({grams('item_id', 'eval_items')}) USING (g)",
    }
