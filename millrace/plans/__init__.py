"""Queries over the test tables. Importing this package fills the registry in `catalog`."""

from millrace.plans import catalog, chunk_queries, dedup_queries, kernel_queries, layer_queries, metric_queries, more_queries, source_queries, text_queries, vector_queries  # noqa: F401
