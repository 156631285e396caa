"""Queries over duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import dedup as D
from millrace.plans.catalog import query, table

WS = X.WS
_WORDS = rf"list_filter(string_split(trim(regexp_replace({{0}}, '[{WS}]+', ' ', 'g')), ' '), lambda w: w <> '')"
_PLAIN = rf"regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_{WS}]', '', 'g')"


def _words(x: str) -> str:
    return _WORDS.replace("{0}", x)


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def greedy_sql(with_: str, ids: str, edges: str, out: str, rounds: int = 10) -> str:
    """The greedy rule unrolled. with_: CTEs that end in a comma; ids: (v); edges: (i, j), i < j."""
    parts = [f"{with_} ge AS MATERIALIZED ({edges}), u0 AS MATERIALIZED (SELECT i AS v FROM ge UNION SELECT j FROM ge)"]
    for r in range(rounds):
        parts.append(f"k{r} AS MATERIALIZED (SELECT v FROM u{r} WHERE NOT EXISTS (SELECT 1 FROM ge JOIN u{r} s ON s.v = ge.i WHERE ge.j = u{r}.v))")
        parts.append(f"d{r} AS MATERIALIZED (SELECT DISTINCT ge.j AS v FROM ge JOIN k{r} ON k{r}.v = ge.i)")
        parts.append(f"u{r + 1} AS MATERIALIZED (SELECT v FROM u{r} WHERE v NOT IN (SELECT v FROM k{r}) AND v NOT IN (SELECT v FROM d{r}))")
    gone = " UNION ".join(f"SELECT v FROM d{r}" for r in range(rounds))
    return ", ".join(parts) + f" SELECT v AS {out} FROM ({ids}) WHERE v NOT IN ({gone})"


def _window_sql(size: int) -> str:
    with_ = f"""WITH t AS (SELECT doc_id, text, {_words('text')} AS ws FROM documents), o AS (SELECT min(doc_id) AS v, arg_min(ws, doc_id) AS ws FROM t GROUP BY text),
      s AS (SELECT DISTINCT v, n, h FROM (SELECT v, len(ws) AS n, array_to_string(ws[i : i + {size - 1}], ' ') AS h FROM (SELECT v, ws, unnest(range(1, len(ws) - {size} + 2)) AS i FROM o WHERE len(ws) >= {size}))),"""
    ids = f"SELECT doc_id AS v FROM t WHERE length(text) > 0 AND (len(ws) < {size} OR doc_id IN (SELECT v FROM o))"
    return greedy_sql(with_, ids, "SELECT DISTINCT a.v AS i, b.v AS j FROM s a JOIN s b ON a.n = b.n AND a.h = b.h AND a.v < b.v", "doc_id")


for _size in (100, 20):

    @query(f"window_dedup_{_size}", _window_sql(_size))
    def window_dedup(spark, sf_dir, size=_size):
        return D.window_dedup(_docs(spark, sf_dir), size)


_SIM = f"""sh AS MATERIALIZED (WITH c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_words('lower(text)')}) AS w FROM documents) GROUP BY 1, 2),
  h AS (SELECT doc_id, n, ('0x' || substr(md5(w), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(w), 9, 8))::BIGINT AS lo FROM c),
  g AS (SELECT doc_id, {', '.join(f"CASE WHEN sum(CASE WHEN ({c} >> {k}) & 1 = 1 THEN n ELSE -n END) > 0 THEN {1 << k} ELSE 0 END AS {c}{k}" for c in ('hi', 'lo') for k in range(32))} FROM h GROUP BY doc_id)
  SELECT d.doc_id, CAST(coalesce({' + '.join(f'hi{k}' for k in range(32))}, 0) AS BIGINT) AS hi, CAST(coalesce({' + '.join(f'lo{k}' for k in range(32))}, 0) AS BIGINT) AS lo FROM documents d LEFT JOIN g USING (doc_id))"""


@query("simhash", f"WITH {_SIM} SELECT * FROM sh")
def simhash(spark, sf_dir):
    return D.simhash(_docs(spark, sf_dir))


_SIM_ONCE = "so AS MATERIALIZED (SELECT hi, lo, min(doc_id) AS v FROM sh GROUP BY hi, lo)"
_SIM_EDGES = "SELECT a.v AS i, b.v AS j FROM so a JOIN so b ON a.v < b.v AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= {0}"


@query("simhash_pairs", f"WITH {_SIM}, {_SIM_ONCE} " + _SIM_EDGES.replace("{0}", "3"))
def simhash_pairs(spark, sf_dir):
    return D.simhash_pairs(D.simhash(_docs(spark, sf_dir)), 3)


@query(
    "simhash_links",
    f"""WITH {_SIM}, sf AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY hi, lo) AS first FROM sh)
      SELECT i, j, CAST(distance AS INTEGER) AS distance FROM (SELECT a.doc_id AS i, b.doc_id AS j, a.first AS fa, b.first AS fb, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance
        FROM sf a JOIN sf b ON a.doc_id < b.doc_id) WHERE distance <= 3 AND i = fa AND (j = fb OR fa = fb)""",
)
def simhash_links(spark, sf_dir):
    return D.simhash_links(D.simhash(_docs(spark, sf_dir)), 3)


for _bits, _rounds in ((3, 10), (9, 24)):

    @query(f"simhash_dedup_{_bits}", greedy_sql(f"WITH {_SIM}, {_SIM_ONCE},", "SELECT v FROM so", _SIM_EDGES.replace("{0}", str(_bits)), "doc_id", _rounds))
    def simhash_dedup(spark, sf_dir, bits=_bits):
        return D.simhash_dedup(_docs(spark, sf_dir), bits)


_SETS = f"""js AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], '') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT doc_id, {_words(_PLAIN)} AS ws FROM documents) WHERE len(ws) >= 3)),
  jl AS MATERIALIZED (SELECT doc_id, list(s ORDER BY s) AS ss, count(*) AS n FROM js GROUP BY doc_id),
  jo AS MATERIALIZED (SELECT ss, n, min(doc_id) AS v FROM jl GROUP BY ss, n),
  jx AS MATERIALIZED (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM js a JOIN js b ON a.s = b.s AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT v FROM jo) AND b.doc_id IN (SELECT v FROM jo) GROUP BY 1, 2),
  jp AS MATERIALIZED (SELECT i, j, k / (x.n + y.n - k) AS similarity FROM jx JOIN jo x ON x.v = i JOIN jo y ON y.v = j)"""
_JACCARD_IDS = "SELECT doc_id AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM jl WHERE doc_id NOT IN (SELECT v FROM jo))"


@query("jaccard_pairs", f"WITH {_SETS} SELECT i, j, round(similarity, 6) AS similarity FROM jp WHERE similarity >= 0.7")
def jaccard_pairs(spark, sf_dir):
    return D.jaccard_pairs(D.shingle_sets(_docs(spark, sf_dir)), 0.7).withColumn("similarity", F.round("similarity", 6))


@query(
    "jaccard_links",
    f"""WITH {_SETS}, jf AS MATERIALIZED (SELECT *, min(doc_id) OVER (PARTITION BY ss) AS first FROM jl),
      ja AS (SELECT a.doc_id AS i, b.doc_id AS j, count(*) AS k FROM js a JOIN js b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2)
      SELECT i, j, round(k / (x.n + y.n - k), 6) AS similarity FROM ja JOIN jf x ON x.doc_id = i JOIN jf y ON y.doc_id = j
        WHERE k / (x.n + y.n - k) >= 0.7 AND i = x.first AND (j = y.first OR x.first = y.first)""",
)
def jaccard_links(spark, sf_dir):
    return D.jaccard_links(D.shingle_sets(_docs(spark, sf_dir)), 0.7).withColumn("similarity", F.round("similarity", 6))


for _t in (85, 70):

    @query(f"jaccard_dedup_{_t}", greedy_sql(f"WITH {_SETS},", _JACCARD_IDS, f"SELECT i, j FROM jp WHERE similarity >= {_t / 100}", "doc_id"))
    def jaccard_dedup(spark, sf_dir, t=_t):
        return D.jaccard_dedup(_docs(spark, sf_dir), t / 100)


_FIRST_STAGE = greedy_sql(f"WITH {_SIM}, {_SIM_ONCE},", "SELECT v FROM so", _SIM_EDGES.replace("{0}", "3"), "doc_id")


@query(
    "two_stage_dedup",
    greedy_sql(
        f"WITH left_over AS MATERIALIZED (SELECT * FROM documents WHERE doc_id IN ({_FIRST_STAGE})), {_SETS.replace('FROM documents', 'FROM left_over')},",
        _JACCARD_IDS.replace("FROM documents", "FROM left_over"),
        "SELECT i, j FROM jp WHERE similarity >= 0.85",
        "doc_id",
    ),
)
def two_stage_dedup(spark, sf_dir):
    return D.two_stage(_docs(spark, sf_dir), bits=3)


_A, _B = D.permutations(120)
_SLOTS = ", ".join(f"min(({a} * h + {b}) % 2147483647) AS s{k}" for k, (a, b) in enumerate(zip(_A.tolist(), _B.tolist(), strict=True)))
_BANDS = ", ".join(f"md5(concat_ws(',', {', '.join(f's{12 * b + r}' for r in range(12))}))" for b in range(10))


@query(
    "minhash_bands",
    f"""WITH s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT doc_id, {_words('text')} AS ws FROM documents) WHERE len(ws) >= 3)),
    m AS (SELECT doc_id, {_SLOTS} FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % 2147483647 AS h FROM s) GROUP BY doc_id)
    SELECT doc_id, CAST(b AS INTEGER) AS band, bs[b + 1] AS band_hash FROM (SELECT doc_id, [{_BANDS}] AS bs, unnest(range(10)) AS b FROM m)""",
)
def minhash_bands(spark, sf_dir):
    return D.minhash_bands(_docs(spark, sf_dir))


_SIGNED = f"""ms AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM (SELECT doc_id, {_words('text')} AS ws FROM documents) WHERE len(ws) >= 3)),
  mm AS MATERIALIZED (SELECT doc_id, [{', '.join(f's{k}' for k in range(120))}] AS sig FROM (SELECT doc_id, {_SLOTS} FROM (SELECT doc_id, ('0x' || substr(md5(s), 1, 8))::BIGINT % 2147483647 AS h FROM ms) GROUP BY doc_id)),
  mo AS MATERIALIZED (SELECT sig, min(doc_id) AS v FROM mm GROUP BY sig),
  mb AS MATERIALIZED (SELECT v, sig, b, sig[12 * b + 1 : 12 * b + 12] AS cell FROM mo, range(10) r(b)),
  mp AS MATERIALIZED (SELECT DISTINCT x.v AS i, y.v AS j, x.sig AS sa, y.sig AS sb FROM mb x JOIN mb y ON x.b = y.b AND x.cell = y.cell AND x.v < y.v)"""
_SIGNED_IDS = "SELECT doc_id AS v FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM mm WHERE doc_id NOT IN (SELECT v FROM mo))"


@query("minhash_dedup", greedy_sql(f"WITH {_SIGNED},", _SIGNED_IDS, "SELECT i, j FROM mp WHERE len(list_filter(range(1, 121), lambda k: sa[k] = sb[k])) >= 96", "doc_id"))
def minhash_dedup(spark, sf_dir):
    return D.minhash_dedup(_docs(spark, sf_dir))


@query("minhash_cosine_dedup", greedy_sql(f"WITH {_SIGNED},", _SIGNED_IDS, "SELECT i, j FROM mp WHERE list_cosine_similarity(sa::DOUBLE[], sb::DOUBLE[]) > 0.8", "doc_id"))
def minhash_cosine_dedup(spark, sf_dir):
    return D.minhash_dedup(_docs(spark, sf_dir), measure="cosine")


@query("minhash_lsh_join")
def minhash_lsh_join(spark, sf_dir):
    return D.lsh_join(_docs(spark, sf_dir), 0.3, copies=True)


_WEIGHTS = f"""ww AS MATERIALIZED (WITH c AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({_words('lower(text)')}) AS w FROM documents) GROUP BY 1, 2)
  SELECT doc_id, w, n / max(n) OVER (PARTITION BY doc_id) AS x FROM c)"""


@query("word_weights", f"WITH {_WEIGHTS} SELECT doc_id AS v, w, round(x, 6) AS x FROM ww")
def word_weights(spark, sf_dir):
    return D.word_weights(_docs(spark, sf_dir)).withColumn("x", F.round("x", 6))


@query(
    "weighted_jaccard",
    f"""WITH {_WEIGHTS}, tt AS (SELECT doc_id, sum(x) AS t FROM ww GROUP BY 1), p AS (SELECT a.doc_id AS i, b.doc_id AS j, sum(least(a.x, b.x)) AS low FROM ww a JOIN ww b ON a.w = b.w AND a.doc_id < b.doc_id GROUP BY 1, 2)
    SELECT i, j, round(low / (x.t + y.t - low), 6) AS similarity FROM p JOIN tt x ON x.doc_id = i JOIN tt y ON y.doc_id = j WHERE low / (x.t + y.t - low) >= 0.8 - 1e-9""",
)
def weighted_jaccard(spark, sf_dir):
    return D.weighted_set_pairs(D.weighted_sets(_docs(spark, sf_dir)), 0.8).withColumn("similarity", F.round("similarity", 6))


_COS = "cp AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id), ce AS MATERIALIZED (SELECT * FROM cp WHERE cosine > 0.35)"


@query("vector_pairs", f"WITH {_COS} SELECT i, j, round(cosine, 6) AS cosine FROM ce")
def vector_pairs(spark, sf_dir):
    return D.vector_pairs(table(spark, sf_dir, "embeddings"), 0.35).withColumn("cosine", F.round("cosine", 6))


@query(
    "knn_dedup",
    greedy_sql(
        f"WITH {_COS}, cb AS (SELECT i, j, cosine FROM ce UNION ALL SELECT j, i, cosine FROM ce), cn AS (SELECT i, j FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY cosine DESC, j) AS r FROM cb) WHERE r < 10),",
        "SELECT vec_id AS v FROM embeddings",
        "SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM cn",
        "vec_id",
        14,
    ),
)
def knn_dedup(spark, sf_dir):
    return D.vector_dedup(table(spark, sf_dir, "embeddings"), 0.35)


_REACH = f"""WITH RECURSIVE {_COS}, e AS MATERIALIZED (SELECT i, j FROM ce UNION SELECT j, i FROM ce), r AS (SELECT i AS v, i AS root FROM e UNION SELECT e.j, r.root FROM r JOIN e ON e.i = r.v),
  comp AS (SELECT v, min(root) AS comp FROM r GROUP BY v)"""


@query("graph_components", _REACH + " SELECT v, comp FROM comp")
def graph_components(spark, sf_dir):
    return D.vector_components(table(spark, sf_dir, "embeddings"), 0.35)


@query(
    "graph_representatives",
    _REACH
    + """, deg AS (SELECT i AS v, count(*) AS d FROM e GROUP BY 1) SELECT vec_id AS v FROM embeddings WHERE vec_id NOT IN (SELECT v FROM comp)
       UNION ALL SELECT v FROM (SELECT v, row_number() OVER (PARTITION BY comp ORDER BY d DESC, v) AS rn FROM comp JOIN deg USING (v)) WHERE rn = 1""",
)
def graph_representatives(spark, sf_dir):
    return D.vector_representatives(table(spark, sf_dir, "embeddings"), 0.35)
