"""Text and chunking queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.operators import chunking, guard, keywords
from ricepaper.plans.tables import chunk_rows, sql_chunk_rows, table

WS = X.WS


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '[{WS}]+', ' ', 'g')")


def sql_normalize(c: str) -> str:
    return sql_strip(f"regexp_replace(regexp_replace(replace({c}, chr(160), ' '), '[ \\t]+', ' ', 'g'), '[{WS}]+\\n', chr(10), 'g')")


def sql_tokens(c: str, lower: bool = True) -> str:
    c = f"lower({c})" if lower else c
    return f"list_filter(regexp_split_to_array({c}, '[{WS}]+'), lambda x: x <> '')"


def sql_roman(c: str) -> str:
    for roman, number in X.ROMAN.items():
        for _ in range(2):
            c = f"regexp_replace({c}, '(^|[^{X.WORDCH}])(?:{roman})($|[^{X.WORDCH}])', '\\1{number}\\2', 'gi')"
    return c


def sql_key_joined(c: str) -> str:
    c = f"regexp_replace(strip_accents(lower({sql_strip(c)})), '[-_]', ' ', 'g')"
    return sql_collapse(sql_roman(f"regexp_replace({c}, '([a-z]{{2,4}})[ ]*-?[ ]*(\\d{{2,3}})', '\\1\\2', 'g')"))


def sql_key_ascii(c: str) -> str:
    c = sql_roman(f"lower({sql_collapse(f'strip_accents({c})')})")
    return sql_collapse(f"regexp_replace(regexp_replace({c}, '[_-]', ' ', 'g'), '[^a-z0-9.{WS}]', ' ', 'g')")


def sql_codes(c: str) -> str:
    # boundaries are consumed here, so neighbours must not share one: doubled separators
    wide = f"regexp_replace({c}, '([^{X.WORDCH}])', '\\1\\1', 'g')"
    return f"list_transform(regexp_extract_all({wide}, '(?:^|[^{X.WORDCH}])((?i:{X.CODE}))(?:$|[^{X.WORDCH}])', 1), lambda x: upper(x))"


def sql_ordered_distinct(c: str) -> str:
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def text_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", X.normalize_text(F.col("text")).alias("clean"))


def text_tokens(spark, d):
    t = X.tokens(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, "\u0001")).alias("tokens_md5"))


def title_guess(spark, d):
    return chunk_rows(spark, d).where("text is not null").select("chunk_id", X.guess_title(X.normalize_text(F.col("text"))).alias("title"))


def names(spark, d):
    own = table(spark, d, "knowledge_graph").select(F.explode(F.map_values("name")).alias("name"))
    other = table(spark, d, "aliases").select(F.explode("aliases").alias("name"))
    return own.union(other).where("name is not null").distinct()


NAMES_SQL = "SELECT DISTINCT name FROM (SELECT unnest(map_values(name)) AS name FROM knowledge_graph UNION ALL SELECT unnest(aliases) FROM aliases) WHERE name IS NOT NULL"


def accents_stripped(spark, d):
    return names(spark, d).select("name", X.strip_accents(F.col("name")).alias("bare"))


def name_keys(spark, d):
    n = F.col("name")
    return names(spark, d).select("name", X.name_key_joined(n).alias("key_joined"), X.name_key_ascii(n).alias("key_ascii"))


def entity_codes(spark, d):
    c = F.col("text")
    rows = chunk_rows(spark, d).where("text is not null")
    return rows.select("chunk_id", F.array_join(X.codes(c), ",").alias("codes"), F.array_join(X.code_prefixes(c), ",").alias("prefixes"))


def spaced_codes(spark, d):
    return table(spark, d, "knowledge_graph").select("id").distinct().select("id", X.spaced_code(F.col("id")).alias("spaced"))


def think_stripped(spark, d):
    rows = table(spark, d, "answers").select("answer_id", "answer").distinct()
    return rows.select("answer_id", X.strip_think(F.col("answer")).alias("clean"), X.estimate_tokens(F.col("answer")).alias("n_estimated"))


def chunk_words(spark, d):
    return chunking.by_words(table(spark, d, "documents").select("doc_id", "text"), "text", 512, 50).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def chunk_sentences(spark, d):
    return chunking.by_sentences(table(spark, d, "documents").select("doc_id", "text"), "text", 3, 1).select("doc_id", "chunk_index", F.md5("chunk").alias("chunk_md5"))


def heading_split(spark, d):
    return chunking.by_headings(chunk_rows(spark, d), "text", [r"Section \d", r"Phần \d", r"Mục \d"]).select("chunk_id", "section_index", "section")


def chunk_documents(spark, d):
    return chunking.document_chunks(table(spark, d, "documents"), 512, 50).select("chunk_id", "doc_id", "chunk_index", "source", "pages", F.length("text").alias("n_chars"))


def keywords_topk(spark, d):
    return keywords.top_keywords(chunk_rows(spark, d), "chunk_id", "text", 6).select("chunk_id", F.array_join("keywords", ",").alias("keywords"))


def chunk_questions(spark, d):
    rows = chunk_rows(spark, d).where("text is not null").select("chunk_id", X.guess_title(F.col("text")).alias("title"))
    tops = keywords.top_keywords(chunk_rows(spark, d), "chunk_id", "text", 6)
    q = X.questions_for(F.col("title"), F.coalesce("keywords", F.array().cast("array<string>")), 2)
    return rows.join(tops, "chunk_id", "left").select("chunk_id", F.posexplode(q).alias("question_index", "question"))


def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", X.redact(F.col("text")).alias("redacted"))


def input_guard(spark, d):
    rows = table(spark, d, "answers").select("answer_id", "query").distinct()
    g = guard.check_input(F.col("query"))
    return rows.select("answer_id", g["ok"].alias("ok"), g["clean_text"].alias("clean_text"), F.array_join(g["issues"], ",").alias("issues"))


def output_guard(spark, d):
    rows = table(spark, d, "answers").select("answer_id", "answer").distinct()
    return rows.select("answer_id", guard.has_citations(F.col("answer")).alias("cited"))


QUERIES = {f.__name__: f for f in (text_normalize, text_tokens, title_guess, accents_stripped, name_keys, entity_codes, spaced_codes, think_stripped, chunk_words, chunk_sentences, heading_split, chunk_documents, keywords_topk, chunk_questions, pii_redact, input_guard, output_guard)}

_WINDOW = """
    SELECT doc_id, k AS chunk_index, array_to_string(list_slice(w, k * {step} + 1, k * {step} + {size}), ' ') AS chunk{more}
    FROM (SELECT *, unnest(range(0, 1 + greatest(0, CAST(ceil((len(w) - {size}) / {step}.0) AS BIGINT)))) AS k FROM ({src}) WHERE len(w) > 0)"""
_SENTENCES = f"list_filter(list_transform(string_split(regexp_replace({sql_collapse('text')}, '([.!?\\x{{2026}}])[ ]+([A-Z\\x{{c0}}-\\x{{1ef4}}0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '')"
_KEYWORDS = f"""
    words AS (
        SELECT chunk_id, w, count(*) AS n, min(pos) AS first FROM (
            SELECT chunk_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
            FROM (SELECT chunk_id, regexp_extract_all(lower(text), '([{X.KEYWORD_CHARS}]+)', 1) AS ws FROM rows WHERE text IS NOT NULL)
        ) WHERE length(w) > 2 AND w NOT IN (SELECT unnest(string_split('and or for the a an of in on at with from by as into to than then that this those these which what when where how why whose while who whom is are was were be been being have has had do does did can could should would may might must shall will', ' '))) GROUP BY ALL
    ),
    tops AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY n DESC, first) AS r FROM words),
    kept AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY r) AS k FROM tops WHERE r <= 12 AND regexp_matches(w, '\\p{{L}}')),
    keys AS (SELECT chunk_id, list(w ORDER BY k) AS ks FROM kept WHERE k <= 6 GROUP BY chunk_id)"""


def _sql_between_injections(c: str) -> str:
    for words in ("ignore previous instructions", "disregard all rules", "pretend to be", "change the system prompt", "override"):
        c = f"regexp_replace({c}, '\\b" + words.replace(" ", "\\s+") + "\\b', '', 'gi')"
    return c


_PII = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|(?:\+?\d{1,3})?(?:[\s\-.]?\d){7,}"
_DOMAIN = "course curriculum subject prerequisite semester plan schedule đồ_án luận_văn học_phần tín_chỉ tiên_quyết lộ_trình".replace(" ", "|").replace("_", " ")




def _sql_title(c: str) -> str:
    return f"substr({sql_strip(f'split_part({c}, chr(10), 1)')}, 1, 120)"



_INJECTED = sql_strip(_sql_between_injections("query"))
_MASKED = f"regexp_replace({_INJECTED}, '{_PII}', '[REDACTED]', 'g')"

SQL = {
    "text_normalize": f"SELECT doc_id, {sql_normalize('text')} AS clean FROM documents",
    "text_tokens": f"SELECT doc_id, CAST(len({sql_tokens('text')}) AS INTEGER) AS n_tokens, md5(array_to_string({sql_tokens('text')}, chr(1))) AS tokens_md5 FROM documents WHERE text IS NOT NULL",
    "title_guess": f"SELECT chunk_id, {_sql_title(sql_normalize('text'))} AS title FROM ({sql_chunk_rows()}) WHERE text IS NOT NULL",
    "accents_stripped": f"SELECT name, strip_accents(name) AS bare FROM ({NAMES_SQL})",
    "name_keys": f"SELECT name, {sql_key_joined('name')} AS key_joined, {sql_key_ascii('name')} AS key_ascii FROM ({NAMES_SQL})",
    "entity_codes": f"""
        SELECT chunk_id, array_to_string({sql_ordered_distinct('a')}, ',') AS codes, array_to_string({sql_ordered_distinct('b')}, ',') AS prefixes
        FROM (SELECT chunk_id, {sql_codes('text')} AS a, regexp_extract_all(upper(text), '({X.CODE_PREFIX})', 1) AS b FROM ({sql_chunk_rows()}) WHERE text IS NOT NULL)""",
    "spaced_codes": r"""
        SELECT DISTINCT id, CASE WHEN length(id) >= 6 AND regexp_full_match(id, '[A-Z]{2,4}\d{2,3}[A-Z]{0,3}')
            THEN rtrim(regexp_replace(id, '^([A-Z]{2,4})(\d{2,3})([A-Z]{0,3})$', '\1 \2 \3')) END AS spaced FROM knowledge_graph""",
    "think_stripped": f"""
        SELECT DISTINCT answer_id, {sql_strip("regexp_replace(answer, '(?s)<think>.*?</think>', '', 'g')")} AS clean,
            CASE WHEN coalesce(answer, '') = '' THEN 0 ELSE greatest(1, CAST(floor(length(answer) / 4.0) AS INTEGER)) END AS n_estimated FROM answers""",
    "chunk_words": f"SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM ({_WINDOW.format(step=462, size=512, more='', src=f"SELECT doc_id, {sql_tokens('text', False)} AS w FROM documents WHERE text IS NOT NULL")})",
    "chunk_sentences": f"SELECT doc_id, chunk_index, md5(chunk) AS chunk_md5 FROM ({_WINDOW.format(step=2, size=3, more='', src=f"SELECT doc_id, {_SENTENCES} AS w FROM documents WHERE text IS NOT NULL")})",
    "heading_split": f"""
        WITH s AS (
            SELECT chunk_id, list_filter(list_transform(string_split(regexp_replace(text, '(^|\\n)(Section \\d|Phần \\d|Mục \\d)', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS parts
            FROM ({sql_chunk_rows()}) WHERE text IS NOT NULL
        )
        SELECT chunk_id, CAST(i - 1 AS INTEGER) AS section_index, parts[i] AS section FROM (SELECT *, unnest(generate_series(1, len(parts))) AS i FROM s)""",
    "chunk_documents": f"""
        SELECT doc_id || '#chunk_' || chunk_index AS chunk_id, doc_id, CAST(chunk_index AS INTEGER) AS chunk_index, source, pages, CAST(length(chunk) AS INTEGER) AS n_chars
        FROM ({_WINDOW.format(step=462, size=512, more=', source, pages', src=f"SELECT doc_id, source, pages, {sql_tokens(sql_normalize('text'), False)} AS w FROM documents WHERE text IS NOT NULL")})""",
    "keywords_topk": f"WITH rows AS ({sql_chunk_rows()}), {_KEYWORDS} SELECT chunk_id, array_to_string(ks, ',') AS keywords FROM keys",
    "chunk_questions": f"""
        WITH rows AS ({sql_chunk_rows()}), {_KEYWORDS},
        q AS (
            SELECT chunk_id, list_slice(list_filter([
                CASE WHEN title <> '' THEN 'What does the section "' || title || '" say?' END,
                CASE WHEN len(ks) > 0 THEN 'Where are ' || array_to_string(list_slice(ks, 1, 3), ', ') || ' explained?' END,
                'Which rules apply here?'], lambda x: x IS NOT NULL), 1, 2) AS qs
            FROM (SELECT chunk_id, {_sql_title('text')} AS title, ks FROM rows LEFT JOIN keys USING (chunk_id) WHERE text IS NOT NULL)
        )
        SELECT chunk_id, CAST(i - 1 AS INTEGER) AS question_index, qs[i] AS question FROM (SELECT *, unnest(generate_series(1, len(qs))) AS i FROM q)""",
    "pii_redact": f"SELECT doc_id, regexp_replace(text, '{_PII}', '[REDACTED]', 'g') AS redacted FROM documents",
    "input_guard": f"""
        SELECT DISTINCT answer_id, true AS ok, {_MASKED} AS clean_text,
            array_to_string(list_filter([
                CASE WHEN {_INJECTED} <> {sql_strip('query')} THEN 'injection' END,
                CASE WHEN {_MASKED} <> {_INJECTED} THEN 'pii' END,
                CASE WHEN NOT regexp_matches(lower({_MASKED}), '{_DOMAIN}') THEN 'out_of_domain' END], lambda x: x IS NOT NULL), ',') AS issues
        FROM answers WHERE query IS NOT NULL
        UNION ALL SELECT DISTINCT answer_id, true, NULL, '' FROM answers WHERE query IS NULL""",
    "output_guard": f"SELECT DISTINCT answer_id, coalesce(regexp_matches(answer, '(?i)(^|\\n)[{WS}]*citations:'), false) AS cited FROM answers",
}
