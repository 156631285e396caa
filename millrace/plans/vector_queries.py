"""Queries over vectors, keywords and tokenizers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import chunk as C
from millrace.operators import ingest as I
from millrace.operators import models
from millrace.operators import tokenizers as T
from millrace.operators import vector as V
from millrace.plans.catalog import query, table
from millrace.plans.dedup_queries import WS


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _queries(spark, sf_dir) -> list[tuple[int, list[float]]]:
    """Every row whose id is divisible by 20."""
    return [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").where("vec_id % 20 = 0").orderBy("vec_id").collect()]


_SEARCH = """SELECT query, vec_id, round(score, 6) + 0.0 AS score, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query, v.vec_id, {s} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, v.vec_id) AS rank
  FROM embeddings q JOIN embeddings v ON {on} WHERE q.vec_id % 20 = 0) WHERE rank <= 5"""
_COS = "list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
_L2 = "-list_distance(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("cosine_topk", _SEARCH.replace("{s}", _COS).replace("{on}", "true"))
def cosine_topk(spark, sf_dir):
    return _rounded(V.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5))


@query("l2_topk", _SEARCH.replace("{s}", _L2).replace("{on}", "true"))
def l2_topk(spark, sf_dir):
    return _rounded(V.nearest(table(spark, sf_dir, "embeddings"), _queries(spark, sf_dir), 5, "l2"))


@query("filtered_topk", _SEARCH.replace("{s}", _COS).replace("{on}", "v.label = 3"))
def filtered_topk(spark, sf_dir):
    return _rounded(V.nearest(table(spark, sf_dir, "embeddings").where("label = 3"), _queries(spark, sf_dir), 5))


@query("metadata_search", "SELECT vec_id, label FROM embeddings WHERE label = 3 ORDER BY vec_id LIMIT 5")
def metadata_search(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("label = 3").select("vec_id", "label").orderBy("vec_id").limit(5)


@query("collection_stats", "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def collection_stats(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))


#: Cells of the inverted file, as in the reference.
CELLS = 100


@query("ivf_topk", _SEARCH.replace("{s}", _L2).replace("{on}", "true").replace("round(score, 6) + 0.0 AS score", "round(-score, 6) + 0.0 AS distance"))
def ivf_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    found = V.search_exact(V.cell_index(vectors, CELLS), vectors.where("vec_id % 20 = 0"), 5)
    return found.withColumn("distance", F.round("distance", 6))


_SPLIT = rf"regexp_split_to_array(trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g')), '[^\p{{L}}\p{{N}}_]+')"


@query("embed_texts", f"""WITH c AS (SELECT doc_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS place, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT}) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2)
  SELECT doc_id, place, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def embed_texts(spark, sf_dir):
    return models.embeddings(_docs(spark, sf_dir)).withColumn("value", F.round("value", 6))


_TERMS = f"(SELECT doc_id, w AS term, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT}) AS w FROM documents) WHERE length(w) >= 2 GROUP BY 1, 2)"


@query("top_terms", f"SELECT doc_id, term, n, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM {_TERMS}) WHERE rank <= 8")
def top_terms(spark, sf_dir):
    return V.top_terms(_docs(spark, sf_dir))


_FUSED = f"""WITH t AS (SELECT doc_id, term, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM {_TERMS}) WHERE rank <= 12),
  s AS (SELECT doc_id, 0 AS "set", term, rank - 1 AS pl, count(*) OVER (PARTITION BY doc_id) AS n FROM t
        UNION ALL SELECT doc_id, 1, term, pl, least(6, n) FROM (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY term) - 1 AS pl, count(*) OVER (PARTITION BY doc_id) AS n FROM t) WHERE pl < 6),
  c AS (SELECT doc_id, term, sum((n - pl) * 0.5) AS score, min("set" * 100 + pl) AS seen FROM s GROUP BY 1, 2),
  o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, seen) AS r FROM c),
  f AS (SELECT * FROM o x WHERE NOT EXISTS (SELECT 1 FROM o y WHERE y.doc_id = x.doc_id AND y.r < x.r AND contains(y.term, x.term)))
  SELECT doc_id, term, score::DOUBLE AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS k FROM f) WHERE k <= 8"""


@query("keyword_fusion", _FUSED)
def keyword_fusion(spark, sf_dir):
    terms = V.top_terms(_docs(spark, sf_dir), 12)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"])
    lists = terms.groupBy("doc_id").agg(ordered.alias("terms"))
    alphabetical = lists.select("doc_id", F.lit(1).alias("set"), F.slice(F.array_sort("terms"), 1, 6).alias("terms"))
    return V.fuse(lists.select("doc_id", F.lit(0).alias("set"), "terms").union(alphabetical))


_CLASSED = f"""(SELECT doc_id, term, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pl) AS rank FROM (SELECT doc_id, w AS term, count(*) AS n, min(i) AS pl FROM (
  SELECT doc_id, unnest({_SPLIT}) AS w, generate_subscripts({_SPLIT}, 1) AS i FROM documents) WHERE length(w) >= 3 AND {{0}} GROUP BY 1, 2))"""
_NOUN = "NOT regexp_matches(w, '(?:ing|ed|ize|ate)$') AND NOT regexp_matches(w, '(?:ous|ful|ive|al)$')"


@query("class_keywords", f"SELECT doc_id, term, n, CAST(rank AS INTEGER) AS rank FROM {_CLASSED.replace('{0}', 'true')} WHERE rank <= 16")
def class_keywords(spark, sf_dir):
    return V.class_keywords(_docs(spark, sf_dir))


@query("short_keywords", f"SELECT doc_id, term, n, CAST(rank AS INTEGER) AS rank FROM {_CLASSED.replace('{0}', _NOUN)} WHERE rank <= 8")
def short_keywords(spark, sf_dir):
    return V.short_keywords(_docs(spark, sf_dir))


_PLACES = "CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER)"


@query(
    "metadata_relevance",
    f"""WITH i AS (SELECT doc_id, k, 'key ' || k || ': ' || v AS t FROM (SELECT doc_id, unnest(['lang', 'source']) AS k, unnest([lang, source]) AS v FROM documents)),
    a AS (SELECT doc_id, {_PLACES} AS p, count(*) AS n FROM (SELECT doc_id, unnest({_SPLIT}) AS w FROM documents) WHERE w <> '' GROUP BY 1, 2),
    b AS (SELECT doc_id, k, {_PLACES} AS p, count(*) AS n FROM (SELECT doc_id, k, unnest({_SPLIT.replace('lower(text)', 'lower(t)')}) AS w FROM i) WHERE w <> '' GROUP BY 1, 2, 3),
    m AS (SELECT b.doc_id, k, sum(a.n * b.n) AS s FROM a JOIN b USING (doc_id, p) GROUP BY 1, 2)
    SELECT i.doc_id, 'key ' || i.k AS key, round(coalesce(s / (sqrt(x.q) * sqrt(y.q)), 0.0), 6)::DOUBLE AS score FROM i LEFT JOIN m ON m.doc_id = i.doc_id AND m.k = i.k
      LEFT JOIN (SELECT doc_id, sum(n * n) AS q FROM a GROUP BY 1) x ON x.doc_id = i.doc_id LEFT JOIN (SELECT doc_id, k, sum(n * n) AS q FROM b GROUP BY 1, 2) y ON y.doc_id = i.doc_id AND y.k = i.k""",
)
def metadata_relevance(spark, sf_dir):
    items = F.array(*[F.struct(F.lit(f"key {c}").alias("key"), F.col(c).alias("value")) for c in ("lang", "source")])
    d = _docs(spark, sf_dir).select("doc_id", items.alias("items"), models.metadata_relevance(F.col("text"), items).alias("scores"))
    return d.select("doc_id", F.explode(F.arrays_zip("items", "scores")).alias("x")).select("doc_id", "x.items.key", F.round("x.scores", 6).alias("score"))


@query("document_metadata", "SELECT doc_id AS document_id, '0' AS chunk_id, upper(lang) AS lang, source FROM documents WHERE length(text) > 0")
def document_metadata(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    chunks = docs.select(F.col("doc_id").alias("document_id"), "lang", "source", F.posexplode(C.fixed(F.col("text"))).alias("chunk_id", "content"))
    own = F.create_map(F.lit("lang"), F.upper("lang"), F.lit("source"), F.col("source"))
    rows = V.chunk_rows(chunks.withColumn("summary", F.substring("content", 1, 80)).withColumn("keywords", F.array("lang")), own)
    return V.document_metadata(rows).select("document_id", *[F.col("metadata")[c].alias(c) for c in ("chunk_id", "lang", "source")])


@query("ingested_documents")
def ingested_documents(spark, sf_dir):
    """Rows of the vector table made of all documents, as if each were a file."""
    docs = _docs(spark, sf_dir)
    read = docs.select(F.concat(F.lit("/docs/"), "doc_id", F.lit(".txt")).alias("path"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.lit("txt").alias("file_type"), F.length("text").alias("file_size"), F.lit("").alias("load_time"), F.col("text").alias("content"))
    rows = I.vector_rows(I.metadata_of(read, {"lang": "any"}))
    return rows.select("document_id", "chunk_id", "document", "keywords", F.col("metadata")["lang"].alias("lang"), F.col("metadata")["filename"].alias("filename"))


@query("corrected_text", "SELECT conv_id, turn, replace(text, 'teh', 'the') AS text FROM conversations")
def corrected_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", models.corrected(F.col("text"), lambda t: t.replace("teh", "the")).alias("text"))


@query("textrank")
def textrank(spark, sf_dir):
    return V.text_rank(_docs(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("rag_prompt", """SELECT string_agg(printf('[%d] %s (%.2f): %s', rn, source, sim, substr(text, 1, 300)), chr(10) ORDER BY rn) || chr(10) || chr(10) || 'What is it?' AS prompt
  FROM (SELECT *, row_number() OVER (ORDER BY sim DESC, doc_id) AS rn FROM (SELECT doc_id, source, text, 1.0 / (1 + doc_id) AS sim FROM documents)) WHERE rn <= 3""")
def rag_prompt(spark, sf_dir):
    c = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("text").alias("content"), (1.0 / (1 + F.col("doc_id"))).alias("similarity"))
    return V.prompt(c, "What is it?")


# -- tokenizers --------------------------------------------------------------------------------------------------------

_NORM = f"trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g'))"
_V1 = rf"regexp_extract_all({_NORM}, '([\p{{L}}\p{{N}}_]+|[.,!?;])', 1)"
_V2 = rf"regexp_extract_all({_NORM}, '([\p{{L}}\p{{N}}_]+(?:''[\p{{L}}\p{{N}}_]+)?|[^\p{{L}}\p{{N}}_{WS}])', 1)"


@query("word_tokens_v1", f"SELECT conv_id, turn, array_to_string({_V1}, ' ') AS tokens FROM conversations")
def word_tokens_v1(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.words_v1(F.col("text")), " ").alias("tokens"))


@query("word_tokens_v2", f"SELECT conv_id, turn, array_to_string({_V2}, ' ') AS tokens FROM conversations")
def word_tokens_v2(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.words_v2(F.col("text")), " ").alias("tokens"))


@query("char_tokens", f"SELECT c AS token, count(*) AS n FROM (SELECT unnest(string_split({_NORM}, '')) AS c FROM conversations) WHERE c <> '' GROUP BY 1")
def char_tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select(F.explode(T.characters(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_VOCAB = f"(SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT token, CAST(row_number() OVER (ORDER BY token) + 1 AS INTEGER) FROM (SELECT DISTINCT unnest({_V2}) AS token FROM conversations))"


def _tokens(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id_"), F.posexplode(T.words_v2(F.col("text"))).alias("ord", "token"))


@query("vocab_ids", f"SELECT token, id FROM {_VOCAB}")
def vocab_ids(spark, sf_dir):
    return T.vocabulary(_tokens(spark, sf_dir))


@query("encode", f"SELECT id_, CAST(i - 1 AS INTEGER) AS ord, id FROM (SELECT conv_id * 1000 + turn AS id_, unnest({_V2}) AS token, generate_subscripts({_V2}, 1) AS i FROM conversations) t JOIN {_VOCAB} v USING (token)")
def encode(spark, sf_dir):
    t = _tokens(spark, sf_dir)
    return T.encode(t, T.vocabulary(t), "id_")


@query("padded_batch", f"SELECT conv_id, turn, array_to_string(list_concat(ws[1:512], list_transform(range(greatest(0, 512 - len(ws))), lambda i: '<pad>')), ' ') AS tokens FROM (SELECT conv_id, turn, {_V2} AS ws FROM conversations)")
def padded_batch(spark, sf_dir):
    ws = T.words_v2(F.col("text"))
    padded = F.concat(F.slice(ws, 1, 512), F.array_repeat(F.lit("<pad>"), F.greatest(F.lit(0), 512 - F.size(ws))))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(padded, " ").alias("tokens"))


_PAIRS = f"""WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({_V2}) AS word FROM documents) GROUP BY 1), s AS (SELECT n, list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</w>') AS s FROM w)
  SELECT s[i] AS "left", s[i + 1] AS "right", CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, s, unnest(range(1, len(s))) AS i FROM s) GROUP BY 1, 2"""


@query("bpe_pair_stats", _PAIRS)
def bpe_pair_stats(spark, sf_dir):
    return T.pair_stats(T.word_counts(_docs(spark, sf_dir)))


@query("bpe_first_merge", f'SELECT "left", "right" FROM ({_PAIRS}) ORDER BY n DESC, "left", "right" LIMIT 1')
def bpe_first_merge(spark, sf_dir):
    return T.pair_stats(T.word_counts(_docs(spark, sf_dir))).orderBy(F.desc("n"), "left", "right").limit(1).select("left", "right")


def _merges_sql(steps: int) -> str:
    """The first merges, step by step: a word is its symbols, each between a space and a line end."""
    symbols = f"""SELECT (SELECT string_agg(' ' || c || chr(10), '' ORDER BY i) FROM (SELECT unnest(list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</w>')) AS c, generate_subscripts(list_append(list_filter(string_split(word, ''), lambda c: c <> ''), '</w>'), 1) AS i)) AS s, n
      FROM (SELECT word, count(*) AS n FROM (SELECT unnest({_V2}) AS word FROM documents) GROUP BY 1)"""
    parts = [f"w0 AS MATERIALIZED ({symbols})"]
    for k in range(steps):
        parts.append(
            f"""b{k} AS MATERIALIZED (SELECT ss[i] AS "left", ss[i + 1] AS "right" FROM (SELECT n, ss, unnest(range(1, len(ss))) AS i FROM (SELECT n, string_split(s[2:-2], chr(10) || ' ') AS ss FROM w{k})) GROUP BY 1, 2 ORDER BY sum(n) DESC, 1, 2 LIMIT 1),
            w{k + 1} AS MATERIALIZED (SELECT replace(s, ' ' || "left" || chr(10) || ' ' || "right" || chr(10), ' ' || "left" || "right" || chr(10)) AS s, n FROM w{k}, b{k})"""
        )
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f'SELECT CAST({k} AS INTEGER) AS rank, "left", "right" FROM b{k}' for k in range(steps))


@query("bpe_merges_5", _merges_sql(5))
def bpe_merges_5(spark, sf_dir):
    got = T.learn_bpe(T.word_counts(_docs(spark, sf_dir)), 5)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(got)], "rank int, left string, right string")


@query("bpe_merges_200")
def bpe_merges_200(spark, sf_dir):
    got = T.learn_bpe(T.word_counts(_docs(spark, sf_dir)), 200)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(got)], "rank int, left string, right string")


def _apply(spark, sf_dir, words, one):
    return _docs(spark, sf_dir).select("doc_id", F.array_join(T.apply_words(words(F.col("text")), one), " ").alias("tokens"))


@query("bpe_encode")
def bpe_encode(spark, sf_dir):
    ranks = {p: k for k, p in enumerate(T.learn_bpe(T.word_counts(_docs(spark, sf_dir)), 200))}
    return _apply(spark, sf_dir, T.words_v2, lambda w: T.bpe_word(w, ranks))


@query("bpe_encode_longest")
def bpe_encode_longest(spark, sf_dir):
    ranks = {p: k for k, p in enumerate(T.learn_bpe(T.word_counts(_docs(spark, sf_dir)), 200))}
    return _apply(spark, sf_dir, T.words_v2, lambda w: T.bpe_word(w, ranks, longest_first=True))


@query("sentencepiece_encode")
def sentencepiece_encode(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    ranks = {p: k for k, p in enumerate(T.learn_bpe(T.word_counts(docs, words=T.with_spaces(F.col("text"))), 200))}
    return _apply(spark, sf_dir, T.with_spaces, lambda w: T.bpe_word(w, ranks))


@query(
    "wordpiece_vocab",
    f"""WITH w AS MATERIALIZED (SELECT word, count(*) AS n FROM (SELECT unnest({_V2}) AS word FROM documents) GROUP BY 1),
      chars AS MATERIALIZED (SELECT DISTINCT CASE WHEN i = 1 THEN c ELSE '##' || c END AS piece FROM (SELECT substr(word, i, 1) AS c, i FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w))),
      k AS (SELECT word, n, unnest(range(2, least(length(word), 20) + 1)) AS k FROM w WHERE length(word) > 1),
      cand AS (SELECT piece, sum(n) AS n FROM (SELECT substr(word, 1, k) AS piece, n FROM k UNION ALL SELECT '##' || substr(word, k + 1) AS piece, n FROM k WHERE k < length(word)) GROUP BY piece)
      SELECT piece FROM chars UNION ALL
      SELECT piece FROM (SELECT piece, row_number() OVER (ORDER BY n DESC, piece) AS r FROM cand WHERE piece NOT IN (SELECT piece FROM chars)) WHERE r <= 10000 - (SELECT count(*) FROM chars)""",
)
def wordpiece_vocab(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in sorted(T.learn_wordpieces(T.word_counts(_docs(spark, sf_dir))))], "piece string")


@query("wordpiece_encode")
def wordpiece_encode(spark, sf_dir):
    vocab = T.learn_wordpieces(T.word_counts(_docs(spark, sf_dir)), 5_000)
    return _apply(spark, sf_dir, T.words_v2, lambda w: T.wordpiece_word(w, vocab))


@query("unigram_encode")
def unigram_encode(spark, sf_dir):
    score = T.learn_unigram(T.word_counts(_docs(spark, sf_dir)), 1_000, rounds=3)
    return _apply(spark, sf_dir, T.words_v2, lambda w: T.unigram_word(w, score))
