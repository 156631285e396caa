"""Queries over the chunkers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import chunk as C
from millrace.plans.catalog import query, table
from millrace.plans.text_queries import _strip


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _windows_sql(size: int, stride: int) -> str:
    return f"""SELECT doc_id, CAST(k AS BIGINT) AS ord, substr(text, CAST(k * {stride} + 1 AS BIGINT), {size}) AS chunk FROM (
      SELECT doc_id, text, unnest(range(0, CAST(ceil(greatest(0, length(text) - {size}) / {stride}) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)"""


@query("fixed_chunks", _windows_sql(512, 359))
def fixed_chunks(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.fixed(F.col("text")))


@query("fixed_chunks_stride", _windows_sql(1024, 921))
def fixed_chunks_stride(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.fixed_step(F.col("text"), 1024))


_MARKED = "concat('# Head', chr(10), replace(text, '. ', chr(10) || '- '))"


def _marked():
    return F.concat(F.lit("# Head\n"), F.replace("text", F.lit(". "), F.lit("\n- ")))


def _sections_sql(mark: str, text: str, each: str) -> str:
    return f"""SELECT doc_id, i - 1 AS ord, ps[i] AS chunk FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace({text}, '(?m)^({mark})', chr(1) || '\\1', 'g'), chr(1)), lambda p: {_strip(each)}), lambda p: p <> '') AS ps FROM documents))"""


@query("structure_sections", _sections_sql(C.STRUCTURE, _MARKED, "replace(p, chr(10), ' ')"))
def structure_sections(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir).withColumn("text", _marked()), C.structure(F.col("text")))


@query("structure_chunks", _sections_sql(C.HEADING_OR_CODE, _MARKED, "p"))
def structure_chunks(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir).withColumn("text", _marked()), C.headings_and_code(F.col("text")))


def _fold(name: str, f, **options):
    @query(name)
    def run(spark, sf_dir):
        return C.exploded(_docs(spark, sf_dir), C.applied(f, F.col("text"), **options))

    return run


_LATIN = ["\n\n", "\n", ". ", " "]


# the recursive chunker in SQL: the first fitting separator, then the fold over the parts as a recursive query
@query(
    "recursive_min_chunks",
    r"""WITH RECURSIVE cand AS (SELECT doc_id, text, s.k, s.sep, string_split(text, s.sep) AS ps FROM documents, (VALUES (1, chr(10) || chr(10)), (2, chr(10)), (3, '. '), (4, ' ')) s(k, sep) WHERE length(text) > 0),
    fit AS (SELECT doc_id, arg_min(ps, k) AS ps, arg_min(sep, k) AS sep FROM cand WHERE length(text) > 512 AND len(ps) > 1 AND list_max(list_transform(ps, lambda p: length(p))) <= 512 GROUP BY doc_id),
    parts AS (SELECT d.doc_id, CASE WHEN length(text) <= 512 THEN [text] ELSE list_transform(range(1, len(ps) + 1), lambda i: CASE WHEN i < len(ps) THEN ps[i] || sep ELSE ps[i] END) END AS ps
              FROM documents d LEFT JOIN fit USING (doc_id) WHERE length(text) > 0),
    fold AS (SELECT doc_id, ps, 1 AS i, 1 AS chunk, ps[1] AS part, length(ps[1]) AS cur FROM parts
             UNION ALL
             SELECT doc_id, ps, i + 1, CASE WHEN cur > 0 AND (cur + length(ps[i + 1]) > 512 OR cur >= 128) THEN chunk + 1 ELSE chunk END, ps[i + 1],
                    CASE WHEN cur > 0 AND (cur + length(ps[i + 1]) > 512 OR cur >= 128) THEN length(ps[i + 1]) ELSE cur + length(ps[i + 1]) END
             FROM fold WHERE i < len(ps)),
    made AS (SELECT doc_id, chunk, string_agg(part, '' ORDER BY i) AS c FROM fold GROUP BY doc_id, chunk),
    grp AS (SELECT doc_id, chunk, c, sum(CASE WHEN chunk = 1 OR length(c) >= 128 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY chunk) AS g FROM made WHERE c <> '')
    SELECT doc_id, CAST(g - 1 AS BIGINT) AS ord, string_agg(c, '' ORDER BY chunk) AS chunk FROM grp GROUP BY doc_id, g""",
)
def recursive_min_chunks(spark, sf_dir):
    return C.exploded(_docs(spark, sf_dir), C.applied(C.recursive, F.col("text"), separators=_LATIN))


_fold("recursive_chunks", C.pack, separators=_LATIN)
_fold("semantic_chunks", C.semantic_strict, threshold=0.3)
_fold("semantic_loose_chunks", C.semantic_loose)
_fold("semantic_units", C.semantic_units)
_fold("late_chunks", C.late)
_fold("combined_chunks", C.combined)
_fold("hierarchical_chunks", C.hierarchical)
_fold("hybrid_chunks", C.hybrid)
_fold("metadata_chunks", C.with_metadata, metadata={"source": "test", "lang": "any", "year": "2024", "more": "x"})


@query("kmeans_topics")
def kmeans_topics(spark, sf_dir):
    @F.pandas_udf("array<int>")
    def run(parts: pd.Series) -> pd.Series:
        return pd.Series([C.topics(list(p)) for p in parts])

    lines = F.filter(F.transform(F.split("text", "\n"), X.strip), lambda p: F.length(p) > 0)
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(run(lines)).alias("paragraph", "topic"))


@query("document_tree")
def document_tree(spark, sf_dir):
    return C.document_tree(_docs(spark, sf_dir))


@query("flat_chunks")
def flat_chunks(spark, sf_dir):
    return C.flat_chunks(C.document_tree(_docs(spark, sf_dir)))


@query(
    "enriched_chunks",
    rf"""WITH k AS (SELECT doc_id, ord AS chunk_id, {_strip(f"regexp_replace(chunk, '[{X.WS}]+', ' ', 'g')")} AS content FROM ({_windows_sql(512, 359)})),
         f AS (SELECT * FROM k WHERE length(content) >= 20),
         s AS (SELECT doc_id, chunk_id, arg_max(s, (length(s), -i)) AS best FROM (SELECT doc_id, chunk_id, unnest(regexp_split_to_array(content, '[.。！？]')) AS s, generate_subscripts(regexp_split_to_array(content, '[.。！？]'), 1) AS i FROM f) GROUP BY 1, 2)
         SELECT f.doc_id, f.chunk_id, content, substr(best, 1, CAST(least(120, greatest(50, floor(length(content) * 0.25))) AS INTEGER)) AS summary,
                lag(f.chunk_id) OVER w AS previous, lead(f.chunk_id) OVER w AS next, row_number() OVER w = 1 AS is_first
         FROM f JOIN s ON f.doc_id = s.doc_id AND f.chunk_id = s.chunk_id WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.chunk_id)""",
)
def enriched_chunks(spark, sf_dir):
    return C.enriched(C.exploded(_docs(spark, sf_dir), C.fixed(F.col("text"))))


@query("optimised_chunks")
def optimised_chunks(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = docs.select("doc_id", "lang", "source", F.posexplode(C.fixed(F.col("text"))).alias("ord", "chunk")).withColumn("ord", F.col("ord").cast("bigint"))
    item = lambda c: F.struct(F.lit(c).alias("key"), F.col(c).alias("value"))
    return C.optimised(chunks, F.array(item("source")), F.array(item("lang")), F.array("lang")).drop("embedding")


def _shingles_sql(n: int, column: str, last: str) -> str:
    return rf"""SELECT doc_id, i - 1 AS ord, {last} AS {column} FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {n} + 2)) AS i FROM (
      SELECT doc_id, string_split(trim(regexp_replace(text, '[{X.WS}]+', ' ', 'g')), ' ') AS ws FROM documents) WHERE len(ws) >= {n})"""


@query("word_shingles", _shingles_sql(3, "shingle", "array_to_string(ws[i : i + 2], ' ')"))
def word_shingles(spark, sf_dir):
    from millrace.operators.dedup import shingles

    return C.exploded(_docs(spark, sf_dir), shingles(X.words(F.col("text")), 3)).withColumnRenamed("chunk", "shingle")


@query("sliding_windows", _shingles_sql(100, "digest", "md5(array_to_string(ws[i : i + 99], ' '))"))
def sliding_windows(spark, sf_dir):
    from millrace.operators.dedup import shingles

    return C.exploded(_docs(spark, sf_dir), F.transform(shingles(X.words(F.col("text")), 100), F.md5)).withColumnRenamed("chunk", "digest")
