"""Chunkers: a text column to an array of chunks; `exploded` makes rows of it.

Closed forms and splits are built-in expressions. Chunkers that carry state from piece to piece are Arrow-batched
functions, linear in the text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import models

#: The separators of the two recursive chunkers, in order of preference.
SEPARATORS = ["\n\n", "\n", "。", "；", "，", "？", "！"]
PACK_SEPARATORS = ["\n\n", "\n", "。", "；", "？", "！", "，"]
#: What begins a section, of headings, of headings and code, and what calls for the latter.
STRUCTURE = r"(?:#{1,4} |\*\*|- |1\. )"
HEADING_OR_CODE = r"(?:#{1,6}|={3,}|-{3,}|[ \t]*(?:```|~~~|代码示例|import|def|function))"


CODE_LIKE = "#{1,6}|import|function"


def exploded(docs: DataFrame, chunks: Column, key: str = "doc_id") -> DataFrame:
    """(key, chunk number from 0, chunk)."""
    return docs.select(key, F.posexplode(chunks).alias("ord", "chunk")).withColumn("ord", F.col("ord").cast("bigint"))


def windows(text: Column, size: int, stride: int) -> Column:
    """Chunks of `size` characters, `stride` apart, the last one ending with the text; none of an empty text."""
    if size < 1 or stride < 1:
        raise ValueError("size and stride must be positive")
    n = F.ceil(F.greatest(F.lit(0), F.length(text) - size) / stride).cast("int")
    made = F.transform(F.sequence(F.lit(0), n), lambda k: F.substring(text, k * stride + 1, F.lit(size)))
    return F.when(F.length(text) > 0, made).otherwise(F.array().cast("array<string>"))


def fixed(text: Column, size: int = 512, overlap: float = 0.3) -> Column:
    """Overlap is a share of the size, at least one character."""
    if not 0 <= overlap < 1:
        raise ValueError("overlap must be at least 0 and below 1")
    return windows(text, size, size - max(1, int(size * overlap)))


def fixed_step(text: Column, size: int = 512, overlap: float = 0.1) -> Column:
    return windows(text, size, max(1, int(size * (1 - overlap))))


def _at_marks(text: Column, mark: str) -> Column:
    """Parts that begin at lines with a mark."""
    return F.split(F.regexp_replace(text, f"(?m)^({mark})", "\x01$1"), "\x01")


def structure(text: Column) -> Column:
    """Sections that begin at a heading, bold, dash or numbered line; their lines joined by spaces; blank ones dropped."""
    parts = F.transform(_at_marks(text, STRUCTURE), lambda p: X.strip(F.replace(p, F.lit("\n"), F.lit(" "))))
    return F.filter(parts, lambda p: F.length(p) > 0)


def headings_and_code(text: Column) -> Column:
    """Sections that begin at a heading, rule or code line; lines are kept, blank sections dropped."""
    parts = F.transform(_at_marks(text, HEADING_OR_CODE), X.strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


# -- state from piece to piece -----------------------------------------------------------------------------------------


def fixed_list(text: str, size: int, stride: int) -> list[str]:
    return [text[k : k + size] for k in range(0, max(1, len(text) - size + stride), stride)] if text else []


def split_once(text: str, separators: list[str], longest: int) -> list[str]:
    """By the first separator that leaves no part over `longest` (the separator stays with the part before it); fixed chunks if none does."""
    if len(text) <= longest:
        return [text]
    for sep in separators:
        parts = text.split(sep)
        if len(parts) > 1 and max(map(len, parts)) <= longest:
            return [p + sep for p in parts[:-1]] + [parts[-1]]
    return fixed_list(text, longest, longest)


def recursive(text: str, separators: list[str] = SEPARATORS, longest: int = 512, shortest: float = 128) -> list[str]:
    """split_once, then parts are put together while the chunk is short; a short last chunk joins the one before."""
    out: list[str] = []
    current = ""
    for part in split_once(text, separators, longest):
        if current and (len(current) + len(part) > longest or len(current) >= shortest):
            out.append(current)
            current = ""
        current += part
    if current:
        out.append(current)
    merged: list[str] = []
    for chunk in out:
        if merged and len(chunk) < shortest:
            merged[-1] += chunk
        else:
            merged.append(chunk)
    return merged


def pack(text: str, separators: list[str] = PACK_SEPARATORS, size: int = 512) -> list[str]:
    """By the first separator present, parts packed up to `size`; what is over 1.2 times the size is split again by the next."""
    if len(text) <= size:
        return [text] if text else []
    for k, sep in enumerate(separators):
        parts = text.split(sep)
        if len(parts) == 1:
            continue
        out, current = [], ""
        for n, part in enumerate(parts):
            part = part + sep if n < len(parts) - 1 else part
            if current and len(current) + len(part) > size:
                out.append(current)
                current = ""
            current += part
        if current:
            out.append(current)
        return [c for chunk in out for c in (pack(chunk, separators[k + 1 :], size) if len(chunk) > 1.2 * size else [chunk])]
    return fixed_list(text, size, max(1, int(size * 0.9)))


def structure_list(text: str, longest: int) -> list[str]:
    """`structure` on one text, longer sections split further."""
    out: list[str] = []
    current: list[str] = []

    def flush() -> None:
        chunk = " ".join(current).strip()
        current.clear()
        if chunk:
            out.extend(recursive(chunk, longest=longest) if len(chunk) > longest else [chunk])

    for line in text.split("\n"):
        if line.startswith(("# ", "## ", "### ", "#### ", "**", "- ", "1. ")):
            flush()
        current.append(line)
    flush()
    return out


def late(text: str, longest: int = 512, context: int = 1024) -> list[str]:
    """Wide fixed chunks first, structure within each."""
    return [c for wide in fixed_list(text, context, context - max(1, int(context * 0.3))) for c in structure_list(wide, longest)]


def combined(text: str, longest: int = 512) -> list[str]:
    """Structure, small sections put together, large ones split."""
    merged: list[str] = []
    for chunk in structure_list(text, longest * 2):
        if merged and len(merged[-1]) < longest / 2:
            merged[-1] += " " + chunk
        else:
            merged.append(chunk)
    return [c for chunk in merged for c in (recursive(chunk, longest=longest, shortest=longest / 4) if len(chunk) > 1.5 * longest else [chunk])]


def with_metadata(text: str, metadata: dict[str, str], longest: int = 512) -> list[str]:
    """`combined`, each chunk under up to three items of the metadata, which are used up in order."""
    items = [f"{k.upper()}:{v}" for k, v in metadata.items()]
    return [f"[块ID: {k}]\n[元数据]:\n" + "\n".join(items[3 * k : 3 * k + 3]) + f"\n[内容]:\n{chunk}" for k, chunk in enumerate(combined(text, longest))]


def split_sentences(text: str) -> list[str]:
    import re

    return [s.strip() for s in re.split(r"(?<=[.!?。！？])\s*", text) if s.strip()]


def semantic(text: str, joins: Callable[[float, int], bool], shortest: int = 0, embed: Callable[[str], np.ndarray] = models.embed, glue: str = "") -> list[str]:
    """Sentences put together while joins(cosine of the chunk's mean vector and the sentence's, chunk length); short chunks dropped."""
    out: list[str] = []
    current, mean, count = "", None, 0
    for s in split_sentences(text):
        v = np.asarray(embed(s), float)
        if count:
            norms = np.linalg.norm(mean) * np.linalg.norm(v)
            if joins(float(mean @ v / norms) if norms else 0.0, len(current)):
                current += glue + s
                mean = (mean * count + v) / (count + 1)
                count += 1
                continue
            out.append(current)
        current, mean, count = s, v, 1
    if count:
        out.append(current)
    return [c for c in out if len(c) >= shortest]


def semantic_strict(text: str, threshold: float = 0.85, shortest: int = 100, longest: int = 512) -> list[str]:
    return semantic(text, lambda sim, n: sim > threshold and n < longest, shortest)


def semantic_loose(text: str, threshold: float = 0.7, size: int = 512) -> list[str]:
    return semantic(text, lambda sim, n: sim >= threshold or n < size)


def semantic_units(text: str, threshold: float = 0.3) -> list[str]:
    return semantic(text, lambda sim, n: sim > threshold, glue=" ")


def code_sections(text: str, size: int = 512) -> list[str]:
    """`headings_and_code` on one text, sections over 1.5 times the size packed."""
    import re

    parts = [p.strip() for p in re.sub(f"(?m)^({HEADING_OR_CODE})", "\x01\\1", text).split("\x01")]
    return [c for p in parts if p for c in (pack(p, size=size) if len(p) > 1.5 * size else [p])]


def hierarchical(text: str, size: int = 512) -> list[str]:
    """Wide chunks; those with code or headings by section, the others packed."""
    import re

    out = []
    for wide in fixed_list(text, 2 * size, max(1, int(2 * size * 0.9))):
        out += code_sections(wide, size) if re.search(CODE_LIKE, wide) else pack(wide, size=size)
    return out


def hybrid(text: str, size: int = 512) -> list[str]:
    """The chunker that the text's kind asks for."""
    import re

    if re.search(X.STRUCTURED, text):
        return code_sections(text, size)
    if len(text) > X.LONG:
        return hierarchical(text, size)
    if re.search(X.CONVERSATIONAL, text):
        return semantic_loose(text, size=size)
    return pack(text, size=size)


#: Bytes of text that are worked on at once: what is made of a text takes many times its memory.
PIECE = 1 << 20


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """An Arrow batch of texts in runs of about PIECE bytes, each of at least one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // PIECE)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        if b > a:
            yield texts.slice(a, b - a)


def applied(f: Callable[..., list[str]], text: Column, **options) -> Column:
    """A chunker of one text over a column, batch by batch; null text has no chunks."""
    call = partial(f, **options)

    @F.arrow_udf("array<string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            for some in pieces(part):
                yield pa.array([call(t) if t else [] for t in some.to_pylist()], pa.list_(pa.string()))

    return run(text)


# -- document trees ----------------------------------------------------------------------------------------------------


def kmeans(points: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Cluster numbers by Lloyd's rounds from farthest-first centres, without randomness."""
    k = min(k, len(points))
    centres = [0]
    for _ in range(1, k):
        d = np.min([((points - points[c]) ** 2).sum(1) for c in centres], axis=0)
        centres.append(int(d.argmax()))
    c = points[centres].astype(float)
    own = np.zeros(len(points), int)
    for step in range(rounds):
        new = ((points[:, None] - c[None]) ** 2).sum(-1).argmin(1)
        if step and (new == own).all():
            break
        own = new
        for j in range(k):
            if (own == j).any():
                c[j] = points[own == j].mean(0)
    return own


def topics(paragraphs: list[str], embed: Callable[[str], np.ndarray] = models.embed) -> list[int]:
    """A topic number for each paragraph: a fifth as many as paragraphs, 2 to 10, never more than paragraphs."""
    if not paragraphs:
        return []
    return kmeans(np.array([embed(p) for p in paragraphs]), max(2, min(10, len(paragraphs) // 5))).tolist()


NODE = "node string, parent string, level string, ord int, content string"


def tree(doc_id, text: str) -> list[tuple]:
    """The nodes of a document: document, topic, paragraph, semantic, sentence. Ids are paths."""
    root = str(doc_id)
    out = [(root, None, "document", 0, text)]
    paras = [p.strip() for p in text.split("\n\n") if p.strip()] if "\n\n" in text else [p.strip() for p in text.split("\n") if p.strip()]
    own = topics(paras)
    for t in sorted(set(own)):
        topic = f"{root}/t{t}"
        members = [i for i, x in enumerate(own) if x == t]
        out.append((topic, root, "topic", t, "\n\n".join(paras[i] for i in members)))
        for i in members:
            para = f"{topic}/p{i}"
            out.append((para, topic, "paragraph", i, paras[i]))
            for j, unit in enumerate(semantic_units(paras[i])):
                sem = f"{para}/s{j}"
                out.append((sem, para, "semantic", j, unit))
                out += [(f"{sem}/{n}", sem, "sentence", n, s) for n, s in enumerate(split_sentences(unit))]
    return out


def document_tree(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The adjacency table of all documents: key, node, parent, level, ord, content."""

    kind = dict(docs.dtypes)[key]
    names = [key, *(c.split()[0] for c in NODE.split(", "))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            at = 0
            for some in pieces(part.column(2)):
                keys = part.column(0).slice(at, len(some))
                trees = [tree(i, t or "") for i, t in zip(part.column(1).slice(at, len(some)).to_pylist(), some.to_pylist(), strict=True)]
                at += len(some)
                own = keys.take(pa.array(np.repeat(np.arange(len(trees)), [len(x) for x in trees])))
                columns = zip(*(n for x in trees for n in x), strict=True)
                yield pa.RecordBatch.from_arrays([own, *(pa.array(c, pa.int32() if k == 3 else pa.string()) for k, c in enumerate(columns))], names=names)

    return docs.select(key, F.col(key).cast("string").alias("__id"), text).mapInArrow(run, f"`{key}` {kind}, {NODE}")


def tree_nodes(key: Column, text: Column, levels: tuple[str, ...]) -> Column:
    """The nodes of some levels of a document's tree as an array: what else a row holds stays beside it."""

    @F.arrow_udf(f"array<struct<{', '.join(c.replace(' ', ': ') for c in NODE.split(', '))}>>")
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = [c.split()[0] for c in NODE.split(", ")]
        kind = pa.list_(pa.struct([(n, pa.int32() if n == "ord" else pa.string()) for n in names]))
        for keys, texts in parts:
            at = 0
            for some in pieces(texts):
                own = keys.slice(at, len(some)).to_pylist()
                at += len(some)
                yield pa.array([[dict(zip(names, n, strict=True)) for n in tree(i, t or "") if n[2] in levels] for i, t in zip(own, some.to_pylist(), strict=True)], kind)

    return run(key, text)


def flat_chunks(nodes: DataFrame, levels: tuple[str, ...] = ("paragraph", "semantic")) -> DataFrame:
    """Nodes of some levels with short ids made of their paths; a node's parent is null only at the root."""
    short = lambda c: F.substring(F.sha2(c, 256), 1, 8)
    return nodes.where(F.col("level").isin(*levels)).select("*", short(F.col("node")).alias("id"), F.coalesce(short(F.col("parent")), F.lit("")).alias("parent_id"))


def enriched(chunks: DataFrame, key: str = "doc_id", shortest: int = 20, more: tuple[str, ...] = ()) -> DataFrame:
    """Chunks (key, ord, chunk) of some length with a summary and links to the neighbours that are left; `optimised` adds the rest.

    more: columns that go with their chunks.
    """
    from pyspark.sql import Window

    clean = F.array(F.trim(X.squeeze(F.col("chunk"))))  # an array of one: a filter on a column would make it twice
    kept = chunks.select(key, "ord", F.explode(F.filter(clean, lambda c: F.length(c) >= shortest)).alias("content"), *more)
    w = Window.partitionBy(key).orderBy("ord")
    limit = F.least(F.lit(120), F.greatest(F.lit(50), F.floor(F.length("content") * 0.25))).cast("int")
    ranked = F.transform(F.split(F.col("content"), "[.。！？]"), lambda s, i: F.struct(F.length(s).alias("n"), (-i).alias("at"), s.alias("s")))
    return kept.select(
        key,
        F.col("ord").alias("chunk_id"),
        "content",
        F.substring(F.array_max(ranked)["s"], F.lit(1), limit).alias("summary"),
        F.lag("ord").over(w).alias("previous"),
        F.lead("ord").over(w).alias("next"),
        (F.row_number().over(w) == 1).alias("is_first"),
        *more,
    )


def select_metadata(items: list[tuple[str, str, float]], text_length: int, core: int = 2, threshold: float = 0.45, most: int = 4, share: float = 0.25) -> dict[str, str]:
    """Items (key, value, relevance): the first `most` relevant ones in order, else the first `core`; cut to a share of the text."""
    chosen = [(k, v) for k, v, s in items if s >= threshold][:most] or [(k, v) for k, v, _ in items][:core]
    used, budget, out = sum(len(k) + len(v) for k, v in chosen), int(text_length * share), {}
    for k, v in chosen:
        if used > budget and len(v) > 80:
            out[k] = v[:80] + "..."
            break
        out[k] = v
        used += len(v) if used > budget else 0
    return out


def optimised(chunks: DataFrame, core: Column, extended: Column, given: Column | None = None, key: str = "doc_id", embed: Callable[[str], np.ndarray] = models.embed) -> DataFrame:
    """`enriched` with keywords, the metadata that fits the chunk and its budget, relations and the embedding.

    chunks: key, ord, chunk and the columns that core and extended (arrays of (key, value)) and given (an array of
    keywords) are made of. Core items come first; only they stand in where nothing is relevant.
    """
    none = F.array().cast("array<string>")
    told = chunks.select(key, "ord", "chunk", core.alias("__core"), extended.alias("__extended"), F.coalesce(given if given is not None else none, none).alias("__given"))
    made = enriched(told, key, more=("__core", "__extended", "__given"))

    # all of a chunk's own comes from the chunk in one call: its words are not exploded, counted by a shuffle and joined
    @F.pandas_udf("metadata array<struct<key:string,value:string>>, embedding array<double>, own array<string>")
    def fitting(contents: pd.Series, cores: pd.Series, others: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for t, c, o in zip(contents, cores, others, strict=True):
            vector = np.asarray(embed(t), float)
            items = [(x["key"], x["value"]) for x in [*c, *o]]
            scored = [(k, v, s) for (k, v), s in zip(items, models.relevances(vector, items, embed, known), strict=True)]
            n = Counter(w for w in models.WORD.findall(t.lower()) if len(w) > 1)
            own = sorted(n, key=lambda w: (-n[w], w))[:8]
            out.append(([{"key": k, "value": v} for k, v in select_metadata(scored, len(t), min(2, len(c))).items()], vector, own))
        return pd.DataFrame(out, columns=["metadata", "embedding", "own"])

    both = made.withColumn("fit", fitting("content", "__core", "__extended"))
    link = lambda kind, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(kind).alias("type"), F.col(c).alias("chunk_id")))
    return both.select(
        key, "chunk_id", "content", "summary", F.map_from_entries("fit.metadata").alias("metadata"), F.array_union("fit.own", "__given").alias("keywords"),
        F.array_compact(F.array(link("previous", "previous"), link("next", "next"))).alias("relations"), F.col("fit.embedding").alias("embedding"),
    )
