"""Registry of the core queries with their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ricepaper.operators import hierarchy
from ricepaper.plans import course_queries, search_queries, table_queries, text_queries
from ricepaper.plans.tables import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.course_hierarchy(table(spark, sf_dir, "edges"), table(spark, sf_dir, "knowledge_graph"))


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.course_descendants(table(spark, sf_dir, "edges"), table(spark, sf_dir, "knowledge_graph"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found,
    "p4_descendants": p4_descendants,
    **text_queries.QUERIES,
    **search_queries.QUERIES,
    **course_queries.QUERIES,
    **table_queries.QUERIES,
}

_LINKS = """
    ids AS (SELECT DISTINCT upper(trim(id)) AS id FROM knowledge_graph WHERE trim(id) <> ''),
    links AS (
        SELECT DISTINCT upper(trim("from")) AS p, upper(trim("to")) AS c FROM edges
        WHERE (type IS NULL OR lower(trim(type)) = 'prerequisite')
          AND upper(trim("from")) IN (SELECT id FROM ids) AND upper(trim("to")) IN (SELECT id FROM ids)
    ),
    ends AS (SELECT p AS n FROM links UNION SELECT c FROM links),
    reach AS (SELECT p AS a, c AS b FROM links UNION SELECT r.a, l.c FROM reach r JOIN links l ON l.p = r.b),
    cyc AS (SELECT DISTINCT a AS n FROM reach WHERE a = b),
    free AS (SELECT p, c FROM links WHERE p NOT IN (SELECT n FROM cyc) AND c NOT IN (SELECT n FROM cyc))
"""

SQL: dict[str, str] = {
    "p4_found": f"""
        WITH RECURSIVE {_LINKS},
        paths AS (
            SELECT n, n AS root, 0 AS depth, n AS path FROM ends
            WHERE n NOT IN (SELECT c FROM links) AND n NOT IN (SELECT n FROM cyc)
            UNION ALL SELECT f.c, root, depth + 1, path || '>' || f.c FROM paths JOIN free f ON f.p = paths.n
        )
        SELECT n AS course_id, 'path' AS state, root AS root_id, depth, path FROM paths
        UNION ALL SELECT n, 'cycle', '', -1, '' FROM cyc
        UNION ALL SELECT n, 'blocked', '', -1, '' FROM ends WHERE n NOT IN (SELECT n FROM cyc) AND n NOT IN (SELECT n FROM paths)""",
    "p4_descendants": f"""
        WITH RECURSIVE {_LINKS},
        k AS (SELECT a, count(*) AS many FROM reach GROUP BY a)
        SELECT n AS course_id, reach.b AS descendant_id, coalesce(k.many, 0) AS subtree_size
        FROM ends LEFT JOIN reach ON reach.a = n LEFT JOIN k ON k.a = n""",
    **text_queries.SQL,
    **search_queries.SQL,
    **course_queries.SQL,
    **table_queries.SQL,
}
