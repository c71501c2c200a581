"""The named queries over the test tables and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.operators import bm25
from docloom.plans import relational_queries, retrieval_queries, storage_queries, text_queries
from docloom.plans.registry import Query, table

REGISTRIES = [text_queries.registry, retrieval_queries.registry, relational_queries.registry, storage_queries.registry]


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 of three terms over the documents."""
    index = bm25.build_index(table(spark, sf, "documents"), "doc_id", "text")
    asked = spark.createDataFrame([(1, "passport office review")], "query_id int, query string")
    return bm25.search(index, asked, top_k=10)


def queries() -> dict[str, Query]:
    return {name: f for r in REGISTRIES for name, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for r in REGISTRIES for name, sql in r.sql.items()}
