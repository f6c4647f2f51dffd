"""Sparse, dense and hybrid search queries with their SQL.

The query set of a search is every row whose id is divisible by 50.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ricepaper.functions import text as X
from ricepaper.functions import vectors as V
from ricepaper.operators import dense, fusion, rendering, sparse
from ricepaper.plans.tables import chunk_rows, chunk_texts, sql_chunk_rows, table
from ricepaper.plans.text_queries import sql_tokens
from ricepaper.session import among, materialize

DIM = 64


def _questions(spark, d):
    rows = table(spark, d, "answers").where("answer_id % 50 = 0 and query is not null")
    return rows.groupBy(F.col("answer_id").alias("query_id")).agg(F.min("query").alias("query"))


def _index(spark, d):
    return sparse.build(chunk_rows(spark, d, "text"), "chunk_id", "text")


def bm25_term_stats(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(spark, d):
    found = sparse.top_k(_index(spark, d), _questions(spark, d), "query_id", "query", 12)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("chunk_id"), "score")


def bm25_multi_query_max(spark, d):
    """Each question and its accent-free spelling, merged by the best score."""
    q = _questions(spark, d)
    both = q.select("query_id", F.lit(0).alias("v"), "query").unionByName(q.select("query_id", F.lit(1).alias("v"), X.strip_accents(F.col("query")).alias("query")))
    best = sparse.top_k(_index(spark, d), both.withColumn("qid", F.struct("query_id", "v")), "qid", "query", 12, hits_only=True)
    return sparse.merge_queries(best, F.col("query.query_id").alias("query_id"), 6).select("query_id", "rank", F.col("doc").alias("chunk_id"), "score")


def _vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def dense_topk_cosine(spark, d):
    e = _vectors(spark, d)
    found = dense.exact_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def dense_topk_ip_inverse(spark, d):
    e = _vectors(spark, d)
    found = dense.exact_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20, "inverse_ip")
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")


def point_search(spark, d):
    """The 20 nearest chunk points of each question point whose id is divisible by 50."""
    p = table(spark, d, "points").withColumn("sq", F.col("payload.synthetic_question")).where("id is not null and size(vector) = 64")
    asked = p.where(F.col("sq").isNotNull() & (F.conv(F.substring("id", -8, 8), 16, 10).cast("long") % 50 == 0)).dropDuplicates(["id"])
    found = dense.exact_top_k(p.where("sq is null"), asked, "id", "vector", "id", "vector", 20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("point_id"), "score")


def hash_embed(spark, d):
    rows = chunk_rows(spark, d)
    v = V.hash_embedding(X.tokens(F.coalesce("text", F.lit(""))), DIM)
    return rows.select("chunk_id", F.posexplode(v).alias("dim", "value")).where("value > 0").select("chunk_id", "dim", F.round("value", 6).alias("value"))


def _asked_vectors(spark, d):
    words = _questions(spark, d).select(F.col("query_id").alias("query"), X.tokens(F.col("query")).alias("ws"))
    return materialize(V.hash_embedded(words, "query", "ws", DIM).withColumnRenamed("v", "qv"), "askedhash")


def _both(spark, d):
    """Words of chunks, vectors of questions, and the results of both searches; the chunks are read and cut into words once."""
    index, asked = sparse.build(chunk_texts(spark, d), "chunk_id", "text"), _asked_vectors(spark, d)
    rows = V.hash_embedded(index.words, "doc", "ws", DIM)
    s = sparse.top_k(index, _questions(spark, d), "query_id", "query", 12)
    v = dense.exact_top_k(rows, asked, "doc", "v", "query", "qv", 20).withColumnRenamed("key", "doc")
    return index.words, asked, materialize(s, "sparse"), materialize(v, "dense")


def hash_embed_topk(spark, d):
    words = chunk_rows(spark, d, "text").select("chunk_id", X.tokens(F.coalesce("text", F.lit(""))).alias("ws"))
    rows = V.hash_embedded(words, "chunk_id", "ws", DIM)
    found = dense.exact_top_k(rows, _asked_vectors(spark, d), "chunk_id", "v", "query", "qv", 20)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("chunk_id"), "score")


def hybrid_fusion(spark, d):
    _, _, s, v = _both(spark, d)
    fused = fusion.blend(fusion.candidates(s, v))
    return fused.select(F.col("query").alias("query_id"), F.col("doc").alias("chunk_id"), "place", F.round("sparse_norm", 6).alias("sparse_norm"), F.round("dense_norm", 6).alias("dense_norm"), "score")


def _mmr_rows(spark, d):
    e = _vectors(spark, d)
    found = dense.exact_top_k(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", "vec_id", "embedding", 20, exclude_same=True)
    rows = found.withColumnRenamed("key", "vec_id").join(e, "vec_id")
    return rows.join(e.select(F.col("vec_id").alias("query"), F.col("embedding").alias("qv")), "query")


def mmr_select(spark, d):
    picked = fusion.mmr(_mmr_rows(spark, d), "query", "vec_id", "embedding", "qv", 6, 0.5, "rank")
    return picked.select(F.col("query").alias("query_id"), "pick", F.col("doc").alias("vec_id"))


def mmr_select_shrinking(spark, d):
    """The older generation's selection: with no more candidates than picks, one pick less."""
    rows = _mmr_rows(spark, d).where("rank <= 6")
    picked = fusion.mmr(rows, "query", "vec_id", "embedding", "qv", 6, 0.65, "rank", shrinking=True)
    return picked.select(F.col("query").alias("query_id"), "pick", F.col("doc").alias("vec_id"))


def _named(rows, key, found):
    """The rows that a join with the documents ``found`` needs, picked out before anything is shuffled."""
    hashes = materialize(found.select(F.xxhash64("doc").alias("h")).distinct(), "named")
    picked = among(rows, key, hashes)
    return picked[0] if picked else rows


def _retrieved(spark, d):
    words, asked, s, v = _both(spark, d)
    words = _named(words, "doc", s.select("doc").unionByName(v.select("doc")))
    return materialize(fusion.retrieve(s, v, V.hash_embedded(words, "doc", "ws", DIM), asked), "retrieved")


def hybrid_retrieve(spark, d):
    return _retrieved(spark, d).select(F.col("query").alias("query_id"), "rank", F.col("doc").alias("chunk_id"), "score")


def retrieve_citations(spark, d):
    found = _retrieved(spark, d)
    return fusion.citations(found, _named(chunk_rows(spark, d, "source"), "chunk_id", found)).withColumnRenamed("query", "query_id")


def evidence_pack(spark, d):
    """The 12 best chunks by BM25, packed under the budget."""
    s = sparse.top_k(_index(spark, d), _questions(spark, d), "query_id", "query", 12)
    rows = s.join(chunk_rows(spark, d, "text", "source").withColumnRenamed("chunk_id", "doc"), "doc")
    packed = rendering.pack_evidence(rows.select("query", "rank", "source", "text"), "query", "rank", 9000, 1200)
    return packed.select(F.col("query").alias("query_id"), "n_blocks", "n_chars", F.md5("evidence").alias("evidence_md5"))


def evidence_list(spark, d):
    s = sparse.top_k(_index(spark, d), _questions(spark, d), "query_id", "query", 3)
    rows = s.join(chunk_rows(spark, d, "text", "source").withColumnRenamed("chunk_id", "doc"), "doc")
    return rendering.list_evidence(rows, "query", "rank").select(F.col("query").alias("query_id"), F.md5("evidence").alias("evidence_md5"))


def point_build(spark, d):
    from ricepaper.operators import keywords

    rows = chunk_rows(spark, d).where("text is not null").select("chunk_id", "text")
    tops = keywords.top_keywords(rows, "chunk_id", "text", 6)
    q = X.questions_for(X.guess_title(F.col("text")), F.coalesce("keywords", F.array().cast("array<string>")), 2)
    rows = rows.join(tops, "chunk_id", "left").select("chunk_id", "text", q.alias("qs"))
    points = dense.point_rows(rows, F.col("qs"), DIM)
    return points.select("id", "chunk_id", "question_index", F.round(V.dot(F.col("vector"), F.col("vector")), 6).alias("squared"))


def eval_hit_rate(spark, d):
    """Share of course questions with a retrieved chunk that names the course of the recorded alias."""
    rows = table(spark, d, "answers").where("answer_id % 50 = 0 and query is not null")
    gold = rows.groupBy(F.col("answer_id").alias("query_id")).agg(F.max("aliases.canonical").alias("gold")).where("gold is not null")
    s = sparse.top_k(_index(spark, d), _questions(spark, d), "query_id", "query", 12).withColumnRenamed("query", "query_id")
    texts = chunk_rows(spark, d).select(F.col("chunk_id").alias("doc"), "text")
    hit = s.join(gold, "query_id").join(texts, "doc").groupBy("query_id").agg(F.max(F.coalesce(F.col("text").contains(F.col("gold")), F.lit(False)).cast("int")).alias("hit"))
    return hit.agg(F.count("*").alias("n_questions"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hits"), F.round(F.avg("hit"), 6).alias("hit_rate"))


QUERIES = {f.__name__: f for f in (bm25_term_stats, bm25_topk, bm25_multi_query_max, dense_topk_cosine, dense_topk_ip_inverse, point_search, hash_embed, hash_embed_topk, hybrid_fusion, mmr_select, mmr_select_shrinking, hybrid_retrieve, retrieve_citations, evidence_pack, evidence_list, point_build, eval_hit_rate)}

_BM25 = f"""
    rows AS ({sql_chunk_rows()}),
    toks AS (SELECT chunk_id, {sql_tokens("coalesce(text, '')")} AS ws FROM rows),
    docs AS (SELECT chunk_id, len(ws) AS dl FROM toks),
    post AS (SELECT chunk_id, w AS term, count(*) AS tf FROM (SELECT chunk_id, unnest(ws) AS w FROM toks) GROUP BY ALL),
    st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM docs),
    raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
    mi AS (SELECT round(avg(raw), 9) AS m FROM raw),
    terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw, mi),
    q AS (SELECT answer_id AS query_id, min(query) AS query FROM answers WHERE answer_id % 50 = 0 AND query IS NOT NULL GROUP BY 1)"""


def _sql_scores(qs: str) -> str:
    return f"""
        SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
        FROM (SELECT query_id, w AS term, count(*) AS qtf FROM (SELECT query_id, unnest({sql_tokens('query')}) AS w FROM {qs}) GROUP BY ALL)
        JOIN terms USING (term) JOIN post USING (term) JOIN docs USING (chunk_id), st GROUP BY ALL"""


_TOP = f"""{_BM25},
    sc AS ({_sql_scores('q')}),
    bm AS (
        SELECT * FROM (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, chunk_id) AS rank
        FROM (SELECT query_id, chunk_id FROM q, docs) LEFT JOIN sc USING (query_id, chunk_id)) WHERE rank <= 12)"""

_DENSE = """
    e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, round({metric}, 6) AS score FROM e a JOIN e b ON {on} WHERE a.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)"""
_COS = _DENSE.replace("{metric}", "list_cosine_similarity(a.v, b.v)")

_HASHED = f"""
    hb AS (SELECT k, kind, b, count(*) AS c FROM (
        SELECT k, kind, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % {DIM} AS INTEGER) AS b FROM (
            SELECT chunk_id AS k, 'd' AS kind, unnest({sql_tokens("coalesce(text, '')")}) AS w FROM rows
            UNION ALL SELECT CAST(query_id AS VARCHAR), 'q', unnest({sql_tokens('query')}) FROM q)) GROUP BY ALL),
    hv AS (SELECT k, kind, list_transform(range(0, {DIM}), lambda x: coalesce(map_from_entries(list((b, c)))[x], 0) / sqrt(sum(c * c))) AS v FROM hb GROUP BY k, kind)"""
_HASHED = f"""
    hb AS (SELECT k, kind, b, count(*) AS c FROM (
        SELECT k, kind, CAST(('0x' || substr(md5(w), 1, 8))::UBIGINT % {DIM} AS INTEGER) AS b FROM (
            SELECT chunk_id AS k, 'd' AS kind, unnest({sql_tokens("coalesce(text, '')")}) AS w FROM rows
            UNION ALL SELECT CAST(query_id AS VARCHAR), 'q', unnest({sql_tokens('query')}) FROM q)) GROUP BY ALL),
    hn AS (SELECT k, kind, sqrt(sum(c * c)) AS len FROM hb GROUP BY ALL),
    hu AS (SELECT k, kind, b, c / len AS x FROM hb JOIN hn USING (k, kind)),
    hs AS (SELECT CAST(a.k AS BIGINT) AS query_id, z.k AS chunk_id, round(sum(a.x * z.x), 6) AS score FROM hu a JOIN hu z USING (b) WHERE a.kind = 'q' AND z.kind = 'd' GROUP BY ALL),
    hall AS (SELECT query_id, k AS chunk_id FROM (SELECT DISTINCT CAST(k AS BIGINT) AS query_id FROM hu WHERE kind = 'q'), (SELECT DISTINCT k FROM hu WHERE kind = 'd')),
    dn AS (SELECT * FROM (SELECT query_id, chunk_id, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(score, 0.0) DESC, chunk_id) AS rank
        FROM hall LEFT JOIN hs USING (query_id, chunk_id)) WHERE rank <= 20)"""

_FUSED = f"""{_TOP}, {_HASHED},
    fu AS (SELECT coalesce(bm.query_id, dn.query_id) AS query_id, coalesce(bm.chunk_id, dn.chunk_id) AS chunk_id, bm.score AS s, dn.score AS v,
        row_number() OVER (PARTITION BY coalesce(bm.query_id, dn.query_id) ORDER BY bm.rank NULLS LAST, dn.rank NULLS LAST) AS place
        FROM bm FULL JOIN dn ON bm.query_id = dn.query_id AND bm.chunk_id = dn.chunk_id),
    fm AS (SELECT *, coalesce(s, 0) AS s0, coalesce(v, 0) AS v0, min(coalesce(s, 0)) OVER w AS sl, max(coalesce(s, 0)) OVER w AS sh, min(coalesce(v, 0)) OVER w AS vl, max(coalesce(v, 0)) OVER w AS vh FROM fu WINDOW w AS (PARTITION BY query_id)),
    fn AS (SELECT query_id, chunk_id, place, CASE WHEN sh > sl THEN (s0 - sl) / (sh - sl) ELSE 0.0 END AS sparse_norm, CASE WHEN vh > vl THEN (v0 - vl) / (vh - vl) ELSE 0.0 END AS dense_norm FROM fm),
    fb AS (SELECT *, round(0.6 * dense_norm + 0.4 * sparse_norm, 6) AS score FROM fn)"""


def _sql_mmr(cands: str, k: int, lam: float, most: str) -> str:
    """``cands(query_id, rank, id, v, sim)``; unit vectors."""
    return f"""
    cand AS ({cands}),
    lim AS (SELECT query_id, {most} AS most FROM cand GROUP BY query_id),
    pick AS (
        SELECT query_id, 1 AS p, list(struct_pack(o := rank, id := id, v := v, sim := sim, near := NULL::DOUBLE) ORDER BY rank) AS cs, NULL::BIGINT AS o, NULL::VARCHAR AS id
        FROM cand GROUP BY query_id
        UNION ALL
        SELECT query_id, p + 1, list_transform(list_filter(cs, lambda x: x.o <> c.o), lambda x: struct_pack(o := x.o, id := x.id, v := x.v, sim := x.sim, near := greatest(x.near, round(list_dot_product(x.v, c.v), 9)))), c.o, CAST(c.id AS VARCHAR)
        FROM (
            SELECT query_id, p, cs, list_sort(list_transform(cs, lambda x: struct_pack(s := -round({lam} * x.sim - {1 - lam} * coalesce(x.near, 0.0), 9), o := x.o, id := x.id, v := x.v)))[1] AS c
            FROM pick JOIN lim USING (query_id) WHERE p <= most
        )
    )"""


_MMR_CANDS = """SELECT query_id, rank, CAST(r.vec_id AS VARCHAR) AS id, list_transform(e.v, lambda x: x / (sqrt(list_dot_product(e.v, e.v)) + 1e-10)) AS v,
    round(list_dot_product(e.v, f.v) / ((sqrt(list_dot_product(e.v, e.v)) + 1e-10) * (sqrt(list_dot_product(f.v, f.v)) + 1e-10)), 9) AS sim
    FROM r JOIN e ON e.vec_id = r.vec_id JOIN e f ON f.vec_id = r.query_id WHERE rank <= {n}"""

_BLOCK = "'[' || i || '] SOURCE: ' || coalesce(source, 'unknown') || chr(10) || 'TEXT: ' || substr(text, 1, 1200)"

SQL = {
    "bm25_term_stats": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM terms",
    "bm25_topk": f"WITH {_TOP} SELECT query_id, rank, chunk_id, score FROM bm",
    "bm25_multi_query_max": f"""
        WITH {_BM25}, q2 AS (SELECT query_id * 2 AS query_id, query FROM q UNION ALL SELECT query_id * 2 + 1, strip_accents(query) FROM q),
        sc AS ({_sql_scores('q2')}),
        b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM sc),
        m AS (SELECT query_id // 2 AS query_id, chunk_id, greatest(max(score), 0.0) AS score FROM b WHERE r <= 12 GROUP BY ALL)
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank, chunk_id, score FROM m) WHERE rank <= 12""",
    "dense_topk_cosine": f"WITH {_COS.replace('{on}', 'true')} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20",
    "dense_topk_ip_inverse": f"WITH {_DENSE.replace('{metric}', '1 / (1 + list_dot_product(a.v, b.v))').replace('{on}', 'true')} SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20",
    "point_search": """
        WITH p AS (
            SELECT DISTINCT id, vector::DOUBLE[] AS v, payload.synthetic_question IS NOT NULL AS asks FROM points
            WHERE id IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0
        ), s AS (SELECT a.id AS query_id, b.id AS point_id, round(list_cosine_similarity(a.v, b.v), 6) AS score FROM p a JOIN p b ON a.asks AND NOT b.asks WHERE ('0x' || a.id[-8:])::UBIGINT % 50 = 0)
        SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, point_id) AS rank, point_id, score FROM s) WHERE rank <= 20""",
    "hash_embed": f"WITH {_BM25}, {_HASHED} SELECT k AS chunk_id, b AS dim, round(x, 6) AS value FROM hu WHERE kind = 'd'",
    "hash_embed_topk": f"WITH {_BM25}, {_HASHED} SELECT query_id, rank, chunk_id, score FROM dn",
    "hybrid_fusion": f"WITH {_FUSED} SELECT query_id, chunk_id, place, round(sparse_norm, 6) AS sparse_norm, round(dense_norm, 6) AS dense_norm, score FROM fb",
    "mmr_select": f"WITH RECURSIVE {_COS.replace('{on}', 'a.vec_id <> b.vec_id')}, {_sql_mmr(_MMR_CANDS.replace('{n}', '20'), 6, 0.5, 'least(6, count(*))')} SELECT query_id, p - 1 AS pick, CAST(id AS BIGINT) AS vec_id FROM pick WHERE p > 1",
    "mmr_select_shrinking": f"WITH RECURSIVE {_COS.replace('{on}', 'a.vec_id <> b.vec_id')}, {_sql_mmr(_MMR_CANDS.replace('{n}', '6'), 6, 0.65, 'CASE WHEN count(*) <= 6 THEN greatest(1, count(*) - 1) ELSE 6 END')} SELECT query_id, p - 1 AS pick, CAST(id AS BIGINT) AS vec_id FROM pick WHERE p > 1",
    "evidence_pack": f"""
        WITH {_TOP},
        n AS (SELECT query_id, rank, source, text, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM bm JOIN rows USING (chunk_id) WHERE regexp_matches(text, '[^{X.WS}]')),
        b AS (SELECT query_id, i, {_BLOCK} AS block FROM n),
        t AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY i) AS total FROM b)
        SELECT query_id, count(*) AS n_blocks, CAST(max(total) AS BIGINT) AS n_chars, md5(string_agg(block, chr(10) ORDER BY i)) AS evidence_md5 FROM t WHERE total <= 9000 GROUP BY query_id""",
    "evidence_list": f"""
        WITH {_TOP}
        SELECT query_id, md5(string_agg('[' || rank || '] (score=' || printf('%.3f', score) || ') ' || coalesce(source, '') || chr(10) || coalesce(text, ''), chr(10) || chr(10) ORDER BY rank)) AS evidence_md5
        FROM bm JOIN rows USING (chunk_id) WHERE rank <= 3 GROUP BY query_id""",
    "eval_hit_rate": f"""
        WITH {_TOP}, g AS (SELECT answer_id AS query_id, max(aliases.canonical) AS gold FROM answers WHERE answer_id % 50 = 0 AND query IS NOT NULL GROUP BY 1 HAVING gold IS NOT NULL),
        h AS (SELECT query_id, max(CAST(coalesce(contains(text, gold), false) AS INTEGER)) AS hit FROM bm JOIN g USING (query_id) JOIN rows USING (chunk_id) GROUP BY 1)
        SELECT count(*) AS n_questions, CAST(coalesce(sum(hit), 0) AS BIGINT) AS n_hits, round(avg(hit), 6) AS hit_rate FROM h""",
}
