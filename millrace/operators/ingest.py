"""From document files to rows of the vector table: metadata, chunks, keywords, names, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import chunk as C
from millrace.operators import models
from millrace.operators import vector as V
from millrace.sources import files


def metadata_of(documents: DataFrame, custom: dict[str, str] | None = None) -> DataFrame:
    """documents (path, filename, file_type, file_size, load_time, content) with `metadata`, a map, and `document_id`.

    What is found in the content is there if it was found; custom entries win. A document without an id of its own gets
    one made of its path, the same in every run.
    """
    found = X.metadata(F.col("content"))
    facts = {"source_file": F.col("path"), "filename": F.col("filename"), "file_type": F.col("file_type"), "load_time": F.col("load_time"), "file_size": F.col("file_size").cast("string")}
    facts |= {c: found[c] for c in ("title", "author", "doc_date", "doc_type")}
    auto = F.map_filter(F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    given = F.create_map(*[F.lit(x) for kv in custom.items() for x in kv]) if custom else F.create_map().cast("map<string,string>")
    out = documents.withColumn("metadata", V.overridden(auto, given))
    out = out.withColumn("document_id", F.coalesce(F.col("metadata")["document_id"], F.concat(F.lit("doc_"), F.substring(F.sha2("path", 256), 1, 16))))
    return out.withColumn("metadata", V.overridden(F.col("metadata"), F.create_map(F.lit("document_id"), F.col("document_id"))))


def vector_rows(documents: DataFrame, embed=models.embed, keywords: int = 8) -> DataFrame:
    """Rows of the vector table: document_id, chunk_id, embed_text, document, keywords, metadata, embedding.

    documents: document_id, content, metadata. The chunks are the paragraphs and semantic units of each document's tree.
    A chunk's metadata stay beside it and its keywords are counted within the row: nothing is shuffled.
    """
    levels = ("paragraph", "semantic")
    each = documents.select("document_id", "metadata", F.explode(C.tree_nodes(F.col("document_id"), F.col("content"), levels)).alias("x"))
    nodes = C.flat_chunks(each.select("document_id", "metadata", "x.*"), levels)
    told = nodes.withColumn("keywords", V.leading_terms(F.col("content"), keywords))
    chunks = told.select("document_id", F.col("node").alias("chunk_id"), "level", "parent_id", "content", X.lead_summary(F.col("content")).alias("summary"), "keywords", models.names(F.col("content")).alias("entities"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.col("metadata").alias("own"))

    @F.pandas_udf("array<double>")
    def vector(part: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(embed(t), float).tolist() for t in part])

    rows = V.chunk_rows(chunks, F.col("own"))
    return rows.withColumn("embedding", vector("embed_text"))


def ingest(spark: SparkSession, folder: str, path: str, custom: dict[str, str] | None = None, extensions: tuple[str, ...] = files.EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """Read all documents of a folder into the vector table at `path`; documents that are there already are replaced.

    (document_id, path, metadata) of what was read, and (path, reason) of what was not.
    """
    done, skipped = files.documents(spark, folder, extensions)
    documents = metadata_of(done, custom)
    V.upsert(vector_rows(documents), path)
    return documents.select("document_id", "path", "metadata"), skipped


def fetched(rows: DataFrame, document_id: Column | str) -> dict | None:
    """The metadata of one document, or None."""
    got = V.document_metadata(rows.where(F.col("document_id") == document_id)).first()
    return got["metadata"] if got else None
