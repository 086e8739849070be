"""SQL with the results of the named queries, for a second engine. It has no lookaround, so some patterns are put differently here."""

from __future__ import annotations

from foliospark.functions import cleaning as C
from foliospark.functions.regex import NOT_SPACE, SPACE, STRIP, TERM, TOKEN
from foliospark.operators.chunking import ARABIC_LETTER
from foliospark.plans.catalogue import CANDIDATES, KNOWN_BELOW, LIMIT, NOISE_THRESHOLD, QUERY_TEXT, SMALL

NL = "\n"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(e: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({e}, {_q(pattern)}, {_q(by)}, 'g')"


def strip(e: str) -> str:
    return rep(e, STRIP)


def lines(e: str, test: str) -> str:
    return f"array_to_string(list_filter(string_split({e}, {_q(NL)}), lambda x: {test}), {_q(NL)})"


def linebreaks(e: str) -> str:
    return f"replace({rep(rep(e, NL + '{2,}', chr(1)), NL, ' ')}, {_q(chr(1))}, {_q(NL + NL)})"


def numbers(e: str) -> str:
    return rep(rep(rep(e, C.NUMBER_DOT, r"\1.\2"), C.NUMBER_DASH, r"\1-\2"), C.NUMBER_PERCENT, r"\1%")


#: Put around letters that the pattern's word boundary takes for none, and taken out again.
MARK = "qZq"


def letters(e: str) -> str:
    p = _q(rf"\b(?:[A-Za-z]{SPACE}){{2,}}[A-Za-z]\b")
    marked = rep(e, r"([^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}])", rf"{MARK}\1{MARK}")
    joined = f"array_to_string(list_transform(list_zip(regexp_split_to_array({marked}, {p}), list_transform(regexp_extract_all({marked}, {p}), lambda m: replace(m, ' ', ''))), lambda z: z[1] || coalesce(z[2], '')), '')"
    return f"CASE WHEN {e} IS NULL THEN NULL ELSE replace({joined}, '{MARK}', '') END"


def confusions(e: str) -> str:
    other = r"(\P{Nd})"
    for digit, by in (("0", "O"), ("1", "l")):
        for _ in range(2):  # neighbours overlap, so twice
            e = rep(e, other + digit + other, rf"\1{by}\2")
    return e


def headers(e: str) -> str:
    for p in C.HEADER_FOOTERS:
        e = rep(e, p)
    return e


PARAGRAPHS = "dedup"
STEPS = {
    "private_use": lambda e: rep(e, C.PRIVATE_USE, " "),
    "strip_structural": lambda e: rep(e, C.STRUCTURAL),
    "headers_footers": headers,
    "hyphenation": lambda e: rep(e, C.HYPHENATION, r"\1\2"),
    "linebreaks": linebreaks,
    "whitespace": lambda e: strip(rep(e, C.BLANKS, " ")),
    "artifacts": lambda e: rep(rep(e, C.PAGE_LABEL), C.RULES, " "),
    "short_lines": lambda e: lines(e, f"length({strip('x')}) >= 2"),
    "numeric_spacing": numbers,
    "letter_spacing": letters,
    "ocr_confusions": confusions,
    "garbage_lines": lambda e: lines(e, f"length({strip('x')}) >= 2 AND regexp_matches(x, {_q(C.ALNUM)})"),
    "urdu_marks": lambda e: rep(e, C.URDU_MARKS),
    "spaces": lambda e: rep(e, f"{SPACE}+", " "),
}
DIGITAL = ("hyphenation", "headers_footers", "artifacts", "strip_structural", "linebreaks", "short_lines", PARAGRAPHS, "numeric_spacing", "whitespace")
OCR = ("hyphenation", "letter_spacing", "ocr_confusions", "garbage_lines", "linebreaks", "numeric_spacing", "whitespace")
URDU = ("urdu_marks", "spaces")


def _paragraphs(source: str) -> str:
    cut = f"list_filter(list_transform(string_split(text, {_q(NL + NL)}), lambda p: {strip('p')}), lambda p: p <> '')"
    return f"SELECT page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), {_q(NL + NL)}) AS text FROM (SELECT page_id, {cut} AS l FROM ({source}))"


def chain(steps: tuple[str, ...], source: str = "SELECT page_id, text FROM pages") -> str:
    for s in steps:
        source = _paragraphs(source) if s == PARAGRAPHS else f"SELECT page_id, {STEPS[s]('text')} AS text FROM ({source})"
    return source


def _pages(where: str) -> str:
    return f"SELECT page_id, text FROM pages WHERE {where}"


DISPATCH = " UNION ALL ".join([chain(DIGITAL, _pages("source_type = 'digital'")), chain(OCR, _pages("source_type = 'ocr'")), chain(URDU, _pages("source_type = 'urdu_ocr'")), _pages("source_type IS NULL OR source_type NOT IN ('digital', 'ocr', 'urdu_ocr')")])

_STRIPPED = f"list_filter(list_transform(string_split(coalesce(text, ''), {_q(NL)}), lambda x: {strip('x')}), lambda x: x <> '')"
NOISE = f"""SELECT line, count(*) AS df, round(count(*) / (SELECT count(*) FROM pages), 9) AS frac
FROM (SELECT page_id, unnest(list_distinct(CASE WHEN len(l) > 6 THEN list_concat(l[1:3], l[len(l)-2:len(l)]) ELSE l END)) AS line FROM (SELECT page_id, {_STRIPPED} AS l FROM pages))
GROUP BY line HAVING count(*) / (SELECT count(*) FROM pages) >= {NOISE_THRESHOLD}"""
NOISE_REMOVE = f"SELECT page_id, array_to_string(list_filter(string_split(text, {_q(NL)}), lambda x: NOT list_contains(n, {strip('x')}) OR length({strip('x')}) > 100), {_q(NL)}) AS text FROM pages, (SELECT list(line) AS n FROM ({NOISE}))"

_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]{3,}')"
ENGLISH = f"""WITH d AS (SELECT DISTINCT unnest({_WORDS}) AS word FROM eval_items), w AS (SELECT page_id, {_WORDS} AS l FROM pages),
u AS (SELECT page_id, count(*) AS unknown FROM (SELECT page_id, unnest(list_distinct(l)) AS word FROM w) WHERE word NOT IN (SELECT word FROM d) GROUP BY page_id)
SELECT w.page_id, len(l) AS words, coalesce(unknown, 0) AS unknown, len(l) >= 10 AND coalesce(unknown, 0) / greatest(len(l), 1) <= 0.5 AS valid FROM w LEFT JOIN u USING (page_id)"""

_CUT = {
    "en": f"string_split({rep('text', rf'([.!?]){SPACE}+', chr(92) + '1' + chr(1))}, {_q(chr(1))})",
    "ur": f"string_split({rep('text', rf'[۔?!]{SPACE}+', chr(1))}, {_q(chr(1))})",
}


def sentences(kind: str, columns: str = "page_id") -> str:
    l = f"list_filter(list_transform({_CUT[kind]}, lambda s: {strip('s')}), lambda s: s <> '')"  # noqa: E741
    return f"SELECT {columns}, pos - 1 AS pos, l[pos] AS sentence FROM (SELECT {columns}, l, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT {columns}, {l} AS l FROM pages))"


_TOKENS = f"regexp_extract_all(content, {_q(TOKEN)})"
_CHUNKS = "(SELECT DISTINCT id, content FROM chunks)"
_STEP = SMALL.limit - SMALL.overlap
WINDOWS = f"""SELECT id, p AS pos, array_to_string(t[p * {_STEP} + 1 : p * {_STEP} + {SMALL.limit}], ' ') AS content, len(t[p * {_STEP} + 1 : p * {_STEP} + {SMALL.limit}]) AS tokens
FROM (SELECT id, t, unnest(range(0, CASE WHEN len(t) <= {SMALL.limit} THEN 1 ELSE 1 + CAST(ceil((len(t) - {SMALL.limit}) / {_STEP}) AS BIGINT) END)) AS p
FROM (SELECT id, {_TOKENS} AS t FROM {_CHUNKS} WHERE regexp_matches(content, {_q(NOT_SPACE)})))"""

def packed() -> str:
    """The packing of sentences into chunks as a recursion over the sentences of all pages at once."""

    def cut(kind: str) -> str:
        return f"list_filter(list_transform({_CUT[kind]}, lambda s: {strip('s')}), lambda s: s <> '')"

    limit, overlap = SMALL.limit, SMALL.overlap
    carried = f"CASE WHEN len(now) > {overlap} THEN now[len(now) - {overlap - 1} : len(now)] ELSE now END"
    windows = f"list_transform(range(0, 1 + CAST(ceil((len(t) - {limit}) / {_STEP}) AS BIGINT)), lambda k: t[k * {_STEP} + 1 : k * {_STEP} + {limit}])"
    return f"""WITH RECURSIVE s AS (SELECT row_number() OVER () AS r, file_hash, filename, page_number, list_transform(CASE WHEN {_ARABIC} * 2 >= {_ANY} AND {_ANY} > 0 THEN {cut('ur')} ELSE {cut('en')} END, lambda x: regexp_extract_all(x, {_q(TOKEN)})) AS l FROM pages WHERE regexp_matches(text, {_q(NOT_SPACE)})),
f AS (SELECT r, 0 AS i, []::VARCHAR[] AS now, []::VARCHAR[][] AS done FROM s UNION ALL
SELECT r, i + 1, CASE WHEN len(t) > {limit} THEN [] WHEN len(now) + len(t) <= {limit} THEN now || t WHEN len({carried}) + len(t) <= {limit} THEN {carried} || t ELSE t END,
done || CASE WHEN len(now) > 0 AND len(now) + len(t) > {limit} THEN [now] ELSE [] END || CASE WHEN len(t) > {limit} THEN {windows} ELSE [] END
FROM (SELECT f.*, s.l[i + 1] AS t FROM f JOIN s USING (r) WHERE i < len(s.l))),
k AS (SELECT s.*, list_filter(done || CASE WHEN len(now) > 0 THEN [now] ELSE [] END, lambda c: len(c) + {SMALL.special} >= {SMALL.minimum}) AS c FROM f JOIN s USING (r) WHERE i = len(s.l))
SELECT filename || '_' || page_number || '_' || (page_number + n) AS id, file_hash AS document_id, array_to_string(c[n + 1], ' ') AS content, page_number, CAST(page_number + n AS INT) AS chunk_id FROM (SELECT *, unnest(range(0, len(c))) AS n FROM k)"""


_ARABIC, _ANY = f"len(regexp_extract_all(text, {_q(ARABIC_LETTER)}))", r"len(regexp_extract_all(text, '\p{L}'))"
_USABLE = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_DOUBLES = "CAST(embedding AS DOUBLE[])"
L2 = f"SELECT id, pos - 1 AS pos, round(v[pos] / n, 6) AS x FROM (SELECT id, v, n, unnest(range(1, 65)) AS pos FROM (SELECT id, {_DOUBLES} AS v, sqrt(list_sum(list_transform({_DOUBLES}, lambda x: x * x))) AS n FROM vector_index WHERE {_USABLE}))"
KNN = "WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id AS id, 1 / (1 + list_distance(CAST(embedding AS DOUBLE[]), q) ^ 2) AS score FROM embeddings, q) SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 10"
KNN_MANY = """WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, 1 / (1 + list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) ^ 2) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT query, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS r FROM s) WHERE r <= 5"""

_TERMS = QUERY_TEXT.lower().split()
_WEIGHTS = ", ".join(f"('{t}', {_TERMS.count(t)})" for t in sorted(set(_TERMS)))
_TERM_LIST = f"regexp_extract_all(lower(coalesce(content, '')), {_q(TERM)})"


def legs(docs: str = "vector_index") -> str:
    """CTEs lex and vec: the candidates of both legs with their scores."""
    return f"""w AS (SELECT id, {_TERM_LIST} AS l FROM {docs}), n AS (SELECT count(*) AS n, avg(len(l)) AS avgdl FROM w),
t AS (SELECT * FROM (VALUES {_WEIGHTS}) AS x(term, qtf)),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(l) AS dl, unnest(l) AS term FROM w) WHERE term IN (SELECT term FROM t) GROUP BY id, dl, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term) JOIN t USING (term), n GROUP BY id),
lex AS (SELECT id, score FROM bm ORDER BY round(score, 9) DESC, id LIMIT {CANDIDATES}),
usable AS (SELECT id, {_DOUBLES} AS v FROM {docs} WHERE {_USABLE}),
q AS (SELECT {_DOUBLES} AS q FROM vector_index WHERE {_USABLE} ORDER BY id LIMIT 1),
near AS (SELECT id, 1 / (1 + list_sum(list_transform(list_zip(v, q), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score FROM usable, q),
vec AS (SELECT id, score FROM near ORDER BY round(score, 9) DESC, id LIMIT {CANDIDATES})"""


_NORM = "CASE WHEN max(score) OVER (PARTITION BY leg) = min(score) OVER (PARTITION BY leg) THEN 1.0 WHEN score <= min(score) OVER (PARTITION BY leg) THEN 0.001 ELSE (score - min(score) OVER (PARTITION BY leg)) / (max(score) OVER (PARTITION BY leg) - min(score) OVER (PARTITION BY leg)) END"


def fused(docs: str = "vector_index") -> str:
    return f"""{legs(docs)}, both_legs AS (SELECT id, score, 'lexical' AS leg, CAST(0.3 AS DOUBLE) AS weight FROM lex UNION ALL SELECT id, score, 'vector', CAST(0.7 AS DOUBLE) FROM vec),
normed AS (SELECT *, CAST({_NORM} AS DOUBLE) AS norm FROM both_legs),
hits AS (SELECT id, sum(norm * weight) / CAST(1.0 AS DOUBLE) AS score FROM normed GROUP BY id ORDER BY round(sum(norm * weight), 9) DESC, id LIMIT {CANDIDATES})"""


_UNIQUE = sorted(set(_TERMS))
_OVERLAP = f"len(list_intersect(list_distinct({_TERM_LIST}), [{', '.join(_q(t) for t in _UNIQUE)}])) / {float(len(_UNIQUE))}"
_RANKED = f"""{fused()}, full_hits AS (SELECT h.id, h.score, v.document_id, v.content, v.metadata.filename AS filename, v.metadata.page_number AS page_number FROM hits h JOIN vector_index v USING (id)),
scored AS (SELECT *, CAST({_OVERLAP} AS DOUBLE) AS rerank_score FROM full_hits),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(rerank_score, 9) DESC, round(score, 9) DESC, id) AS rank FROM scored)"""
ROLL_UP = f"""WITH {_RANKED}, best AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY rank) AS k FROM ranked)
SELECT document_id, min_by(filename, rank) AS document_name, count(*) AS chunks, round(sum(score), 6) AS semantic_score, round(sum(rerank_score), 6) AS rerank_score, min(rank) AS first_rank FROM best WHERE k <= 3 GROUP BY document_id"""
assert LIMIT * 10 == CANDIDATES

_INDEXED = f"SELECT * FROM vector_index WHERE {_USABLE} AND metadata.filename IS NOT NULL AND document_id IS NOT NULL"


def oracle_sql() -> dict[str, str]:
    text = {f"t_{s}": chain((s,)) for s in ("private_use", "strip_structural", "headers_footers", "hyphenation", "linebreaks", "whitespace", "artifacts", "short_lines", "numeric_spacing", "letter_spacing", "ocr_confusions", "garbage_lines")}
    files = f"(SELECT DISTINCT file_hash, filename FROM file_meta), known AS (SELECT * FROM f WHERE file_hash < '{KNOWN_BELOW}')"
    return text | {
        "t_dedup_paragraphs": chain((PARAGRAPHS,)),
        "clean_digital": chain(DIGITAL),
        "clean_ocr": chain(OCR),
        "clean_urdu": chain(URDU),
        "clean_dispatch": DISPATCH,
        "noise_fit": NOISE,
        "noise_remove": NOISE_REMOVE,
        "route_scanned": f"SELECT page_id, coalesce(length(text), 0) < 50 AND page_id % 2 = 0 AS scanned, coalesce(length({strip('text')}), 0) AS chars FROM pages",
        "english_ocr_valid": ENGLISH,
        "blank_filter": f"SELECT page_id FROM pages WHERE regexp_matches(text, {_q(NOT_SPACE)})",
        "file_hash": "SELECT page_id, sha256(text) AS hash FROM pages",
        "dedup_reject": f"WITH f AS {files} SELECT file_hash, filename FROM f WHERE file_hash NOT IN (SELECT file_hash FROM known WHERE file_hash IS NOT NULL) AND filename NOT IN (SELECT filename FROM known WHERE filename IS NOT NULL)",
        "existing_semi": f"WITH f AS {files} SELECT file_hash, filename FROM f WHERE filename IN (SELECT filename FROM known)",
        "metadata_filter": "SELECT id FROM vector_index WHERE metadata.page_number = 1 AND metadata.chunk_id = 1",
        "language_detect": f"SELECT page_id, CASE WHEN {_ARABIC} * 2 >= {_ANY} AND {_ANY} > 0 THEN 'ur' ELSE 'en' END AS lang FROM pages",
        "sentences_en": sentences("en"),
        "sentences_urdu": sentences("ur"),
        "chunk_ids": f"SELECT page_id, concat_ws('_', filename, page_number, page_number + pos) AS id, page_number + pos AS chunk_id FROM ({sentences('en', 'page_id, filename, page_number')})",
        "long_windows": WINDOWS,
        "chunk_pack": packed(),
        "chunk_pack_native": packed(),
        "chunk_min_filter": f"SELECT id FROM {_CHUNKS} WHERE len({_TOKENS}) + 2 >= 75",
        "truncate_tokens": f"SELECT id, array_to_string({_TOKENS}[1:16], ' ') AS head FROM {_CHUNKS} WHERE content IS NOT NULL",
        "embed_prefix": f"SELECT id, 'passage: ' || content AS passage, 'query: ' || content AS query FROM {_CHUNKS}",
        "l2_normalize": L2,
        "zero_fill": f"SELECT id, true AS zero FROM {_CHUNKS} WHERE content IS NULL OR NOT regexp_matches(content, {_q(NOT_SPACE)})",
        "knn_topk": KNN,
        "knn_multi_query": KNN_MANY,
        "postings": f"SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM (SELECT id, unnest({_TERM_LIST}) AS term FROM {_CHUNKS}) GROUP BY term",
        "term_counts": f"SELECT id, len({_TERM_LIST}) AS dl FROM {_CHUNKS}",
        "bm25_topk": f"WITH {legs()} SELECT id, round(score, 6) AS score FROM lex",
        "bm25_postings": f"WITH {legs()} SELECT id, round(score, 6) AS score FROM lex",
        "minmax_norm": f"WITH {legs()}, one AS (SELECT *, 'vector' AS leg FROM vec) SELECT id, round(CAST({_NORM} AS DOUBLE), 6) AS norm FROM one",
        "hybrid_topk": f"WITH {fused()} SELECT id, round(score, 6) AS score FROM hits",
        "hybrid_filtered": f"WITH docs1 AS (SELECT * FROM vector_index WHERE metadata.page_number = 1), {fused('docs1')} SELECT id, round(score, 6) AS score FROM hits",
        "hit_projection": f"WITH {_RANKED} SELECT id, coalesce(document_id, '') AS document_id, length(coalesce(content, '')) AS chars, filename, CAST(page_number AS BIGINT) AS page_number, round(score, 6) AS score FROM full_hits",
        "rerank_order": f"WITH {_RANKED} SELECT id, rank, round(rerank_score, 6) AS rerank_score FROM ranked",
        "search_end_to_end": ROLL_UP,
        "index_append": f"SELECT document_id, count(*) AS rows FROM ({_INDEXED}) GROUP BY document_id",
        "delete_by_filename": f"WITH i AS ({_INDEXED}) SELECT document_id, count(*) AS rows FROM i WHERE metadata.filename <> (SELECT min(metadata.filename) FROM i) GROUP BY document_id",
        "upsert_by_id": "SELECT id, 'index' AS origin FROM vector_index UNION ALL SELECT DISTINCT id, 'chunks' FROM chunks WHERE id NOT IN (SELECT id FROM vector_index)",
        "job_status": "SELECT job_id, status, epoch_us(updated_at) AS at FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, status DESC NULLS LAST, error DESC NULLS LAST, filename DESC NULLS LAST) AS r FROM jobs WHERE job_id IS NOT NULL) WHERE r = 1",
        "one_per_key": "SELECT file_hash, filename, title, author FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY filename NULLS FIRST, title NULLS FIRST, author NULLS FIRST) AS n FROM file_meta) WHERE n = 1",
        "page_metadata": "SELECT page_id, title, author FROM pages LEFT JOIN (SELECT file_hash, max(title) AS title, max(author) AS author FROM file_meta GROUP BY file_hash) USING (file_hash)",
    }
