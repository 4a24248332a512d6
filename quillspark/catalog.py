"""Queries and check SQL of the library operators, by name."""

from quillspark.plans import catalog_queries, job_queries, pipeline_queries, table_queries, text_queries, vector_queries  # noqa: F401
from quillspark.plans.registry import CHECKS as ORACLE_SQL
from quillspark.plans.registry import QUERIES

FLAGSHIP = "chunk_similarity_topk"
