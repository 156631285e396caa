"""Sources: text, JSON and document files. A file that cannot be read becomes a row with its error, never a failed job."""

from __future__ import annotations

import html
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that a folder is searched for.
EXTENSIONS = ("txt", "pdf", "docx", "md", "html", "htm")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, column text."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def records(spark: SparkSession, path: str) -> DataFrame:
    """JSON records: an array in a .json file, a record a line in a .jsonl file."""
    return spark.read.option("multiLine", not path.rstrip("/").endswith(".jsonl")).json(path)


def text_field(df: DataFrame) -> str:
    """The field that holds the text: text, else prompt, else the first string."""
    names = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    for name in ("text", "prompt"):
        if name in names:
            return name
    if not names:
        raise ValueError("no string field")
    return names[0]


#: The names that datasets go by, with their folder and subset.
DATASETS = {"wikitext": ("wikitext", "wikitext-103-raw-v1"), "c4": ("c4", "en"), "pile": ("EleutherAI/pile", None)}


def dataset(spark: SparkSession, root: str, name: str, split: str = "test", most: int | None = None) -> DataFrame:
    """The texts of a dataset by its name: Parquet under root / folder / subset / split. most: so many that are not blank."""
    folder, subset = DATASETS.get(name, (name, None))
    df = spark.read.parquet("/".join(x for x in (root, folder, subset, split) if x))
    texts = df.select(F.col(text_field(df)).alias("text"))
    return texts if most is None else texts.where(F.trim("text") != "").limit(most)


def preferences(spark: SparkSession, path: str, debug: bool = False) -> DataFrame:
    """(prompt, chosen, rejected); debug: the first 100."""
    df = records(spark, path).select("prompt", "chosen", "rejected")
    return df.limit(100) if debug else df


def instructed(pairs: DataFrame) -> DataFrame:
    """Prompts in the instruction frame, joined with either answer."""
    p = F.concat(F.lit("[INST] "), "prompt", F.lit(" [/INST] "))
    return pairs.select("prompt", F.concat(p, "chosen").alias("chosen_text"), F.concat(p, "rejected").alias("rejected_text"))


def cycled(prompts: DataFrame, n: int, prompt: str = "prompt") -> DataFrame:
    """n rows (i, prompt) that go round the prompts in order; prompts: (idx, prompt) with idx from 0."""
    size = prompts.count()
    if not size:
        raise ValueError("no prompts")
    return prompts.sparkSession.range(n).select(F.col("id").alias("i"), (F.col("id") % size).alias("idx")).join(prompts, "idx").select("i", prompt)


def parse(extension: str, content: bytes) -> str:
    """The text of a file by its extension; unknown ones are read as UTF-8."""
    if extension in ("html", "htm"):
        page = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>", "", content.decode("utf-8", "replace"))
        return html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"(?s)<!--.*?-->", "", page)))
    if extension == "md":
        return re.sub(r"(?m)^#+\s*|[*_`]{1,3}", "", content.decode("utf-8"))
    if extension == "docx":
        w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{w}t")) for p in root.iter(f"{w}p"))
    if extension == "pdf":
        try:
            from pypdf import PdfReader
        except ImportError as e:
            raise ValueError("no reader for pdf is installed") from e
        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(content)).pages)
    return content.decode("utf-8")


def documents(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """(processed, skipped) of a folder and all below it.

    processed: path, filename, file_type, file_size, load_time, content; skipped: path, reason.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.withColumn("file_type", F.lower(F.element_at(F.split("path", r"\."), -1))).withColumn("filename", F.element_at(F.split("path", "/"), -1))
    wanted = files.where(F.col("file_type").isin(*extensions))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, name, kind, size, at, raw in zip(part["path"], part["filename"], part["file_type"], part["length"], part["load_time"], part["content"], strict=True):
                try:
                    rows.append((path, name, kind, size, at, parse(kind, bytes(raw)), None))
                except Exception as e:  # one bad file must not stop the others
                    rows.append((path, name, kind, size, at, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "filename", "file_type", "file_size", "load_time", "content", "reason"])

    stamped = wanted.withColumn("load_time", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    read = stamped.select("path", "filename", "file_type", "length", "load_time", "content").mapInPandas(run, "path string, filename string, file_type string, file_size long, load_time string, content string, reason string")
    refused = files.where(~F.col("file_type").isin(*extensions)).select("path", F.lit("unsupported type").alias("reason"))
    return read.where("reason is null").drop("reason"), read.where("reason is not null").select("path", "reason").unionByName(refused)


def flattened(content):
    """Every white-space character as one space, the ends trimmed."""
    from millrace.functions.text import WS

    return F.trim(F.regexp_replace(content, f"[{WS}]", " "))
