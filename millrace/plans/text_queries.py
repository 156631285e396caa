"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import convert as C
from millrace.functions import text as X
from millrace.plans.catalog import query, table

WS = X.WS
_STRIP = rf"regexp_replace({{0}}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.replace("{0}", x)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("normalize", rf"SELECT doc_id, trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g')) AS text FROM documents")
def normalize(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.normalise(F.col("text")).alias("text"))


@query(
    "clean_text",
    rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x00-\x1F\x7F]', '', 'g'), '【[^】\n]*】', '', 'g'),
                    '(?:回复|转发):@[\p{{L}}\p{{N}}_]+[{WS}]', '', 'g'), '\\[uU][0-9a-fA-F]{{4}}', '', 'g') AS t
                  FROM (SELECT doc_id, concat('【ad】', text, ' 转发:@user1 ', 'bbbbb') AS t FROM documents)),
         c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM a),
         r AS (SELECT doc_id, ch, i, i - row_number() OVER (PARTITION BY doc_id, ch ORDER BY i) AS g FROM c),
         k AS (SELECT doc_id, ch, i, row_number() OVER (PARTITION BY doc_id, ch, g ORDER BY i) AS n, count(*) OVER (PARTITION BY doc_id, ch, g) AS len FROM r)
         SELECT doc_id, {_strip("string_agg(ch, '' ORDER BY i)")} AS text FROM k WHERE len < 4 OR n <= 2 GROUP BY doc_id""",
)
def clean_text(spark, sf_dir):
    t = F.concat(F.lit("【ad】"), "text", F.lit(" 转发:@user1 "), F.lit("bbbbb"))
    return _docs(spark, sf_dir).select("doc_id", X.remove_noise(t).alias("text"))


@query(
    "redact",
    """SELECT doc_id, regexp_replace(regexp_replace(t, '(^|[^0-9])(1[3-9][0-9])[0-9]{4}([0-9]{4})($|[^0-9])', '\\1\\2****\\3\\4', 'g'),
                      '([1-9][0-9]{5})(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])([0-9]{3}[0-9Xx])', '\\1********\\2', 'g') AS text
       FROM (SELECT doc_id, concat(text, '  ', CAST(13000000000 + doc_id AS VARCHAR), '  11010519900307', lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')) AS t FROM documents)""",
)
def redact(spark, sf_dir):
    t = F.concat("text", F.lit("  "), (F.lit(13000000000) + F.col("doc_id")).cast("string"), F.lit("  11010519900307"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))
    return _docs(spark, sf_dir).select("doc_id", X.redact(t).alias("text"))


@query("half_width", f"SELECT doc_id, translate(concat(text, '　ＡＢＣ１２３！'), '{X.FULL_WIDTH}', '{X.HALF_WIDTH.replace(chr(39), chr(39) * 2)}') AS text FROM documents")
def half_width(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.half_width(F.concat("text", F.lit("　ＡＢＣ１２３！"))).alias("text"))


@query("simplify_chars", "SELECT doc_id, translate(concat(text, '優惠領取'), '優領', '优领') AS text FROM documents")
def simplify_chars(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.simplify(F.concat("text", F.lit("優惠領取")), {"優": "优", "領": "领"}).alias("text"))


#: Phrases that overlap: at each place the longest holds, and what was converted is not looked at again.
PHRASES = {"優惠": "优惠", "優惠領取": "领取优惠", "領": "领", "取": "取", "the": "<the>", "then": "<then>", "hen": "<hen>", "e": "é", "re": "<re>", "red ": "<red> "}
_LONGEST = "|".join(sorted(PHRASES, key=lambda p: (-len(p), p)))
_TO = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in PHRASES.items()) + "}"


@query(
    "convert_phrases",
    f"""SELECT doc_id, array_to_string(list_transform(range(1, len(gaps) + 1), lambda i: gaps[i] || coalesce(({_TO})[hits[i]], '')), '') AS text
        FROM (SELECT doc_id, regexp_split_to_array(t, '{_LONGEST}') AS gaps, regexp_extract_all(t, '{_LONGEST}') AS hits FROM (SELECT doc_id, concat(text, '優惠領取優惠領') AS t FROM documents))""",
)
def convert_phrases(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", C.convert_phrases(F.concat("text", F.lit("優惠領取優惠領")), PHRASES).alias("text"))


@query("decode_mixed", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat('微信支付优惠领取', chr(10), text) ELSE text END AS text FROM documents")
def decode_mixed(spark, sf_dir):
    """Documents as bytes of one encoding or of two, read again."""
    latin = F.when(F.col("text").rlike(r"[^\x00-\x7F\x{A0}-\x{FF}]"), F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    chinese = F.concat(F.lit(bytearray("微信支付优惠领取".encode("gb18030"))), F.encode(F.concat(F.lit("\n"), F.coalesce("text", F.lit(""))), "UTF-8"))
    kind = F.pmod("doc_id", F.lit(3))
    raw = F.when(kind == 0, chinese).when(kind == 1, latin).otherwise(F.encode("text", "UTF-8"))
    return _docs(spark, sf_dir).select("doc_id", raw.alias("raw")).select("doc_id", C.decode_mixed(F.col("raw")).alias("text"))


@query("repair_encoding", "SELECT doc_id, concat('é', text) AS fixed, text AS plain FROM documents")
def repair_encoding(spark, sf_dir):
    broken = F.decode(F.encode(F.concat(F.lit("é"), "text"), "UTF-8"), "ISO-8859-1")
    return _docs(spark, sf_dir).select("doc_id", X.repair_mojibake(broken).alias("fixed"), X.repair_mojibake(F.col("text")).alias("plain"))


_QUALITY = rf"""
(SELECT *, trim(regexp_replace(regexp_replace(regexp_replace({{col}}, '<[^>]+>', '', 'g'), 'https?://[^{WS}]+', '', 'g'), '[{WS}]+', ' ', 'g')) AS v FROM {{tab}})
WHERE length(v) > 0 AND len(string_split(v, ' ')) >= 20 AND length(regexp_replace(v, '[\p{{{{L}}}}\p{{{{N}}}}{WS}]', '', 'g')) <= 0.1 * length(v)
  AND NOT regexp_matches(v, '[\x{{{{1F1E6}}}}-\x{{{{1F1FF}}}}\x{{{{1F300}}}}-\x{{{{1FAFF}}}}\x{{{{2600}}}}-\x{{{{27BF}}}}]')"""


def _quality_sql(what: str, col: str, tab: str) -> str:
    return f"SELECT {what} FROM " + _QUALITY.replace("{col}", col).replace("{tab}", tab).replace("{{", "{").replace("}}", "}")


@query("quality_filter", _quality_sql("doc_id, text", "text", "documents"))
def quality_filter(spark, sf_dir):
    return _docs(spark, sf_dir).where(X.passes_quality(F.col("text"))).select("doc_id", "text")


@query("quality_filter_pages", _quality_sql("page_id", "html", "pages"))
def quality_filter_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(X.passes_quality(F.col("html"))).select("page_id")


@query("toxicity_filter", "SELECT d.doc_id, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic < 0.7")
def toxicity_filter(spark, sf_dir):
    low = table(spark, sf_dir, "labels").where(F.col("toxic") < 0.7).select("doc_id")
    return _docs(spark, sf_dir).join(low, "doc_id").select("doc_id", "text")


@query("full_filter", _quality_sql("doc_id, text", "text", "documents") + " AND doc_id IN (SELECT doc_id FROM labels WHERE toxic < 0.7)")
def full_filter(spark, sf_dir):
    low = table(spark, sf_dir, "labels").where(F.col("toxic") < 0.7).select("doc_id")
    return _docs(spark, sf_dir).where(X.passes_quality(F.col("text"))).join(low, "doc_id", "left_semi").select("doc_id", "text")


@query("quality_label_filter", "SELECT d.doc_id, d.text FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality > 0.9")
def quality_label_filter(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where(F.col("quality") > 0.9).select("doc_id")
    return _docs(spark, sf_dir).join(good, "doc_id").select("doc_id", "text")


_HTML = "html"
for _pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->", "<[^>]+>"):
    _HTML = f"regexp_replace({_HTML}, '{_pattern}', '', 'g')"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
    _HTML = f"replace({_HTML}, '&{_name};', '{_char}')"


@query("html_text", f"SELECT page_id, {_HTML} AS text FROM pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("text"))


def _coalesced(tries: list[tuple[str, int]], column: str) -> str:
    parts = []
    for p, least in tries:
        value = _strip(f"regexp_extract({column}, '{p}', 1)")
        parts.append(f"CASE WHEN length({value}) > {least} THEN {value} END")
    return f"coalesce({', '.join(parts)})"


@query(
    "page_metadata",
    f"""SELECT page_id, {_coalesced([(p, 3) for p in X.TITLE], 'h')} AS title, {_coalesced([(p, 2) for p in X.AUTHOR], 'h')} AS author,
        {_coalesced([(p, 0) for p in X.DATE], 'h')} AS doc_date,
        CASE {' '.join(f"WHEN regexp_matches(h, '{'|'.join(m)}') THEN '{k}'" for k, m in X.TYPES.items())} END AS doc_type
        FROM (SELECT page_id, concat(CASE WHEN page_id % 3 = 0 THEN '# ab' || chr(10) ELSE '' END, html, chr(10), 'Author: Ann Lee', chr(10),
              CASE WHEN page_id % 2 = 0 THEN 'Date: 2024-05-06 report' ELSE '2023/1/9 manual' END) AS h FROM pages)""",
)
def page_metadata(spark, sf_dir):
    h = F.concat(
        F.when(F.col("page_id") % 3 == 0, "# ab\n").otherwise(""), "html", F.lit("\nAuthor: Ann Lee\n"), F.when(F.col("page_id") % 2 == 0, "Date: 2024-05-06 report").otherwise("2023/1/9 manual")
    )
    return table(spark, sf_dir, "pages").select("page_id", X.metadata(h).alias("m")).select("page_id", "m.*")


@query(
    "doc_type_router",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '```|#|import|function|class|接口|API') THEN 'structure' WHEN length(text) > 5000 THEN 'hierarchical'
        WHEN regexp_matches(text, '用户|客户|客服|咨询|\?|？|：') THEN 'semantic' ELSE 'recursive' END AS route FROM documents""",
)
def doc_type_router(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.route(F.col("text")).alias("route"))


_SENT = rf"list_transform(string_split(regexp_replace({{0}}, '([.!?。！？])[{WS}]*', '\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')})"


@query(
    "doc_structure",
    rf"""SELECT doc_id, CAST(len(regexp_extract_all(t, '#+[ \t]*(.+?)\n', 1)) AS INTEGER) AS headings, CAST(len(ps) AS INTEGER) AS paragraph_count,
         CAST(len(ss) AS INTEGER) AS sentence_count, round(coalesce(list_sum(list_transform(ss, lambda s: length(s))), 0) / greatest(1, len(ss)), 6) AS avg_sentence_length
         FROM (SELECT doc_id, t, list_filter(list_transform(regexp_split_to_array(t, '\n\n+'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps,
                      list_filter({_SENT.replace('{0}', 't')}, lambda s: s <> '') AS ss
               FROM (SELECT doc_id, concat('# Head', chr(10), chr(10), text) AS t FROM documents))""",
)
def doc_structure(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", X.structure(F.concat(F.lit("# Head\n\n"), "text")).alias("s")).select("doc_id", "s.*")
    return s.withColumn("avg_sentence_length", F.round("avg_sentence_length", 6))


@query("paragraph_split", rf"""SELECT doc_id, i - 1 AS ord, ps[i] AS paragraph FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
    SELECT doc_id, list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\n+'), lambda p: {_strip('p')}), lambda p: p <> '') AS ps FROM documents))""")
def paragraph_split(spark, sf_dir):
    t = F.replace("text", F.lit("\n"), F.lit("\n\n"))
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.paragraphs(t)).alias("ord", "paragraph")).withColumn("ord", F.col("ord").cast("bigint"))


@query("sentence_split", rf"""SELECT doc_id, i - 1 AS ord, ss[i] AS sentence FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM (
    SELECT doc_id, list_filter({_SENT.replace('{0}', 'text')}, lambda s: length(s) > 5 AND length(s) < 500) AS ss FROM documents))""")
def sentence_split(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(X.sentences(F.col("text"), 5, 500)).alias("ord", "sentence")).withColumn("ord", F.col("ord").cast("bigint"))


@query(
    "fallback_summary",
    rf"""SELECT doc_id, CASE WHEN length(t) < 160 THEN substr(t, 1, 80) WHEN len(ps) > 1 THEN concat(ps[1], '...', ps[len(ps)]) ELSE coalesce(ps[1], substr(t, 1, 80)) END AS summary
         FROM (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[。！？]'), lambda s: {_strip('s')} <> '') AS ps FROM (SELECT doc_id, translate(text, '.', '。') AS t FROM documents))""",
)
def fallback_summary(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.lead_summary(F.translate("text", ".", "。")).alias("summary"))


@query(
    "longest_sentence",
    r"""SELECT doc_id, substr(arg_max(s, (length(s), -i)), 1, 80) AS summary FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.\n]')) AS s, generate_subscripts(regexp_split_to_array(text, '[.\n]'), 1) AS i FROM documents) GROUP BY doc_id""",
)
def longest_sentence(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", X.longest_sentence(F.col("text"), 80, r"[.\n]").alias("summary"))


@query("bounded_scan", f"SELECT doc_id, text FROM documents WHERE {_strip('text')} <> '' ORDER BY doc_id LIMIT 200")
def bounded_scan(spark, sf_dir):
    """The first samples that are not blank: the limit is what this scan is for."""
    return _docs(spark, sf_dir).where(F.length(X.strip(F.col("text"))) > 0).select("doc_id", "text").orderBy("doc_id").limit(200)


@query("text_scan_md5", "SELECT md5(text) AS md5, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def text_scan_md5(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_TAGGED = "concat('<thinking>', text, '</thinking>', CASE WHEN (conv_id + turn) % 3 > 0 THEN concat('<answer>', chr(10), ' ', text, '</answer>') ELSE '' END)"


def tagged(conversations: DataFrame) -> DataFrame:
    """Responses in the tagged format, made of the conversations' texts; every third lacks its answer."""
    body = F.when((F.col("conv_id") + F.col("turn")) % 3 > 0, F.concat(F.lit("<answer>\n "), "text", F.lit("</answer>"))).otherwise("")
    return conversations.withColumn("response", F.concat(F.lit("<thinking>"), "text", F.lit("</thinking>"), body))


@query("answer_extract", f"SELECT conv_id, turn, {_strip(f'regexp_extract({_TAGGED}, {chr(39)}(?s)<answer>(.*?)</answer>{chr(39)}, 1)')} AS answer FROM conversations")
def answer_extract(spark, sf_dir):
    return tagged(table(spark, sf_dir, "conversations")).select("conv_id", "turn", X.answer(F.col("response")).alias("answer"))


@query(
    "response_scores",
    r"""SELECT conv_id, turn, CASE WHEN length(text) < 20 THEN 0.3::DOUBLE WHEN contains(text, 'however') OR contains(text, 'therefore') OR contains(text, 'furthermore') THEN 0.9::DOUBLE ELSE 0.7::DOUBLE END AS coherence,
        CASE WHEN len(list_filter(string_split('the zzz ' || role, ' ')[1:3], lambda w: contains(text, w))) > 0 THEN 0.8::DOUBLE ELSE 0.6::DOUBLE END AS relevance,
        CASE WHEN regexp_matches(text, '[!?]|amazing|important') THEN 0.9::DOUBLE ELSE 0.65::DOUBLE END AS engagement FROM conversations""",
)
def response_scores(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", X.coherence(t).alias("coherence"), X.relevance(t, F.concat(F.lit("the zzz "), "role")).alias("relevance"), X.engagement(t).alias("engagement")
    )


@query("metadata_keys", "SELECT doc_id, source AS value_a, lang AS value_b FROM documents")
def metadata_keys(spark, sf_dir):
    m = X.clean_metadata(F.create_map(F.lit("作者 name"), F.lit("lost"), F.lit("by 作者"), F.col("source"), F.lit("lang"), F.col("lang"), F.lit("blank"), F.lit("  ")))
    return _docs(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", F.col("m")["作者"].alias("value_a"), F.col("m")["lang"].alias("value_b"))
