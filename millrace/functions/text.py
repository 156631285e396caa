"""Text functions: Column to Column, built-in expressions only, so scans stay in generated code and can be pruned.

White space is Unicode white space everywhere (Spark's trim and \\s know ASCII only).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as white space, inside a character class.
WS = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: One of them, for Java's patterns: three ranges that hold few other characters are tried first, since a union of many
#: ranges is tried whole for every character that is in none.
SPACE = rf"[\x09-\x20\x{{85}}-\x{{A0}}\x{{1680}}-\x{{3000}}&&[{WS}]]"
#: The full-width forms U+FF01..U+FF5E stand 65248 above ASCII 0x21..0x7E.
FULL_WIDTH = "".join(map(chr, range(0xFF01, 0xFF5F)))
HALF_WIDTH = "".join(map(chr, range(0x21, 0x7F)))
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; single spaces, which most runs are, are not matched."""
    return F.regexp_replace(text, f"[{SPACE}&&[^ ]]{SPACE}*| {SPACE}+", " ")


def words(text: Column) -> Column:
    """White-space separated words; none in blank text."""
    clean = F.trim(squeeze(text))
    return F.when(F.length(clean) > 0, F.split(clean, " ")).otherwise(F.array().cast("array<string>"))


def normalise(text: Column) -> Column:
    """Lower case, one space between words, none around."""
    return F.trim(squeeze(F.lower(text)))


def remove_noise(text: Column) -> Column:
    """Without control characters, bracketed advertising, reply and forward marks, literal \\uXXXX; long repeats shortened."""
    out = F.regexp_replace(text, r"[\x00-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"【[^】\n]*】", "")
    out = F.regexp_replace(out, rf"(?:回复|转发):@[\p{{L}}\p{{N}}_]+[{WS}]", "")
    out = F.regexp_replace(out, r"\\[uU][0-9a-fA-F]{4}", "")
    return strip(F.regexp_replace(out, r"(?s)(.)\1{3,}", "$1$1"))


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII; the ideographic space stays."""
    return F.translate(text, FULL_WIDTH, HALF_WIDTH)


def simplify(text: Column, table: dict[str, str]) -> Column:
    """Character-wise conversion by a table (traditional to simplified, or any other); the caller supplies the table."""
    keys = [k for k in table if len(k) == 1 and len(table[k]) == 1]
    return F.translate(text, "".join(keys), "".join(table[k] for k in keys)) if keys else text


def repair_mojibake(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 is read again as UTF-8; anything else is left alone.

    Only text whose characters all fit Latin-1 and whose bytes are valid UTF-8 with a multi-byte character changes.
    """
    raw = F.encode(text, "ISO-8859-1")
    fits = ~text.rlike(r"[^\x00-\x{FF}]") & text.rlike(r"[\x{C2}-\x{F4}][\x{80}-\x{BF}]")
    return F.when(fits & F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(text)


def redact(text: Column) -> Column:
    """Mobile numbers keep three and four digits, 18-place identity numbers six and four."""
    phone = F.regexp_replace(text, r"(?<!\d)(1[3-9]\d)\d{4}(\d{4})(?!\d)", "$1****$2")
    month, day = "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12][0-9]|3[01])"
    return F.regexp_replace(phone, rf"([1-9]\d{{5}})(?:19|20)\d\d{month}{day}(\d{{3}}[\dXx])", "$1********$2")


def quality_view(text: Column) -> Column:
    """What the quality rules look at: without tags and URLs, white space squeezed."""
    return F.trim(squeeze(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", ""), rf"https?://[^{WS}]+", "")))


def passes_quality(text: Column, max_symbol_share: float = 0.1, min_words: int = 20) -> Column:
    """Enough words, few symbols, no emoji; false for text without content."""

    def passes(view: Column) -> Column:
        symbols = F.length(F.regexp_replace(view, rf"[\p{{L}}\p{{N}}{WS}]", ""))
        return (F.length(view) > 0) & (F.size(F.split(view, " ")) >= min_words) & (symbols <= F.lit(max_symbol_share) * F.length(view)) & ~view.rlike(EMOJI)

    # the view is bound to a variable: as an expression it would be made anew for every test
    return F.get(F.transform(F.array(quality_view(text)), passes), F.lit(0))


def _first(content: Column, tries: list[tuple[str, int]]) -> Column:
    """The stripped first group of the first pattern whose match is longer than its least length."""
    found = [(strip(F.regexp_extract(content, p, 1)), least) for p, least in tries]
    return F.coalesce(*[F.when(F.length(v) > least, v) for v, least in found])


#: What marks a title, an author and a date, and the words of each document type.
TITLE = [r"(?im)^#+[ \t]+(.+)", r"(?is)<title>(.*?)</title>", r"(?i)标题[:：]\s*(.+)", r"(?i)Title[:：]\s*(.+)"]
AUTHOR = [r"(?i)作者[:：]\s*(.+)", r"(?i)Author[:：]\s*(.+)", r"(?i)By[:：]\s*(.+)", r"\n(.*?)\n(?:责任编辑|编审)"]
DATE = [r"日期[:：]\s*(\d{4}-\d{2}-\d{2})", r"Date[:：]\s*(\d{4}-\d{2}-\d{2})", r"(\d{4}年\d{1,2}月\d{1,2}日)", r"(\d{4}-\d{2}-\d{2})", r"(\d{4}/\d{1,2}/\d{1,2})"]
TYPES = {
    "合同": ["合同", "协议", "agreement", "contract"],
    "报告": ["报告", "分析", "report", "analysis"],
    "手册": ["手册", "指南", "manual", "guide"],
    "研究": ["研究", "论文", "survey", "study"],
}


def metadata(content: Column) -> Column:
    """A struct (title, author, doc_date, doc_type); what is not found is null."""
    kind = None
    for name, marks in TYPES.items():
        hit = content.rlike("|".join(marks))
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return F.struct(
        _first(content, [(p, 3) for p in TITLE]).alias("title"),
        _first(content, [(p, 2) for p in AUTHOR]).alias("author"),
        _first(content, [(p, 0) for p in DATE]).alias("doc_date"),
        kind.alias("doc_type"),
    )


def html_text(page: Column) -> Column:
    """All text of a page but that of scripts and styles; tags and comments go, references of markup are decoded."""
    out = F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1\s*>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"<[^>]+>", "")
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return out


def answer(text: Column) -> Column:
    """The stripped body of the first <answer>, or an empty string."""
    return strip(F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1))


#: The marks of structured and of conversational documents, and the length of long ones.
STRUCTURED, CONVERSATIONAL, LONG = "```|#|import|function|class|接口|API", r"用户|客户|客服|咨询|\?|？|：", 5000


def route(text: Column) -> Column:
    """How a document is to be split: structure, hierarchical, semantic or recursive."""
    return F.when(text.rlike(STRUCTURED), "structure").when(F.length(text) > LONG, "hierarchical").when(text.rlike(CONVERSATIONAL), "semantic").otherwise("recursive")


SENTENCE_END = "[。！？]"


def lead_summary(text: Column, longest: int = 80) -> Column:
    """Short text is cut; of longer text the first and the last sentence that is not blank."""
    parts = F.filter(F.split(text, SENTENCE_END), lambda s: F.length(strip(s)) > 0)
    both = F.concat(F.get(parts, F.lit(0)), F.lit("..."), F.get(parts, F.size(parts) - 1))
    return F.when(F.length(text) < 2 * longest, F.substring(text, 1, longest)).when(F.size(parts) > 1, both).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.substring(text, 1, longest)))


def longest_sentence(text: Column, longest: int = 80, separator: str = SENTENCE_END) -> Column:
    """The longest sentence, the first of equally long ones, cut to `longest`."""
    ranked = F.transform(F.split(text, separator), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.substring(F.array_max(ranked)["s"], 1, longest)


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\n+"), strip), lambda p: F.length(p) > 0)


def sentences(text: Column, shortest: int = 0, longest: int = 1 << 30) -> Column:
    """Split after sentence marks; those outside the length bounds are dropped."""
    parts = F.transform(F.split(text, rf"(?<=[.!?。！？])[{WS}]*"), strip)
    return F.filter(parts, lambda s: (F.length(s) > shortest) & (F.length(s) < longest))


def structure(text: Column) -> Column:
    """A struct (headings, paragraph_count, sentence_count, avg_sentence_length)."""
    found = sentences(text)
    total = F.aggregate(found, F.lit(0), lambda a, s: a + F.length(s))
    return F.struct(
        F.size(F.regexp_extract_all(text, F.lit(r"#+[ \t]*(.+?)\n"), F.lit(1))).alias("headings"),
        F.size(paragraphs(text)).alias("paragraph_count"),
        F.size(found).alias("sentence_count"),
        (total / F.greatest(F.lit(1), F.size(found))).alias("avg_sentence_length"),
    )


# fixed values: the marks and scores of the three response scores


def coherence(text: Column) -> Column:
    linked = text.contains("however") | text.contains("therefore") | text.contains("furthermore")
    return F.when(F.length(text) < 20, 0.3).when(linked, 0.9).otherwise(0.7)


def relevance(text: Column, query: Column) -> Column:
    """Whether one of the query's first three words occurs anywhere in the text."""
    return F.when(F.exists(F.slice(words(query), 1, 3), lambda w: F.contains(text, w)), 0.8).otherwise(0.6)


def engagement(text: Column) -> Column:
    return F.when(text.rlike(r"[!?]|amazing|important"), 0.9).otherwise(0.65)


def clean_metadata(m: Column) -> Column:
    """A map without blank values whose keys are their Chinese characters; a key without any stays whole.

    Where cleaned keys collide, the last one stays.
    """
    kept = F.map_filter(m, lambda k, v: v.isNotNull() & (F.length(strip(v)) > 0))

    def key(k: Column) -> Column:
        han = F.regexp_replace(k, r"[^\x{4E00}-\x{9FFF}]", "")
        return F.when(F.length(han) > 0, han).otherwise(k)

    each = F.transform(F.map_entries(kept), lambda e: F.struct(key(e["key"]).alias("key"), strip(e["value"]).alias("value")))
    last = F.filter(each, lambda e, i: ~F.exists(F.slice(each, i + 2, F.greatest(F.lit(0), F.size(each) - i - 1)), lambda f: f["key"] == e["key"]))
    return F.map_from_entries(last)
