"""The queries of this subpackage over the test tables, with production parameters, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import chat_format, decontaminate, fill_middle, html_wrapper, mixing, ngram_join, oracles, packing, pii, prefix_trie, quality_ordinal, quality_rules, toxicity, url_reputation
from millrace.storage import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in ("documents", "pages", "conversations") else df


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report_query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_ordinal.fit(docs, quality_ordinal.graded(_table(spark, sf_dir, "labels")), n_grades=3)
    return quality_ordinal.classify(docs, model)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.report(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    outcomes = url_reputation.labelled_outcomes(pages, _table(spark, sf_dir, "labels"))
    return url_reputation.judge(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rules = quality_rules.fit(docs, _table(spark, sf_dir, "labels"))
    judged = quality_rules.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def base_text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics and the base rules of op8_quality_rules alone, which SQL can express."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), [])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrapper.extract_pages(_table(spark, sf_dir, "pages"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.format_chats(chat_format.with_probe(_table(spark, sf_dir, "conversations")))
    return chat_format.digests(chats)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_table(spark, sf_dir, "documents")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(_table(spark, sf_dir, "conversations")))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_ngram_join": op2_ngram_join,
        "op3_toxicity": op3_toxicity,
        "op4_url_filter": op4_url_filter,
        "op5_decontamination": op5_decontamination,
        "op6_packing": op6_packing,
        "op7_pii": op7_pii,
        "op8_quality_rules": op8_quality_rules,
        "base_text_stats": base_text_stats,
        "op9_html_extraction": op9_html_extraction,
        "op10_chat_format": op10_chat_format,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_source_mix": op13_source_mix,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
