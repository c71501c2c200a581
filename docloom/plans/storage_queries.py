"""Queries that write by the sinks and read back by the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import filter_tokens, tokenize
from docloom.operators import ranking, relational
from docloom.plans.registry import Registry, table
from docloom.plans.text_queries import tokens_sql
from docloom.session import scratch
from docloom.sources import sinks, tables

registry = Registry()
add = registry.add


@add("select distinct page_ptr_id, title, live, coalesce(case when lower(trim(announced_date)) <> 'nan' then announced_date end, '-') as announced_date, current_status.slug as status, len(agencies_affected) as agencies from policies")
def jsonl_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Policies as strict JSON lines, read back with bad and blank lines between them."""
    path, policies = scratch(spark, "jsonl"), table(spark, sf, "policies").distinct()
    sinks.write_jsonl(policies, path)
    spark.createDataFrame([('{"page_ptr_id": 1,',), ("",), ("not json",)], "value string").coalesce(1).write.mode("append").text(path)
    good, bad = tables.read_jsonl(spark, path, policies.schema)
    assert bad.count() == 2
    return good.select("page_ptr_id", "title", "live", F.coalesce("announced_date", F.lit("-")).alias("announced_date"), F.col("current_status.slug").alias("status"), F.when(F.col("agencies_affected").isNotNull(), F.size("agencies_affected")).cast("long").alias("agencies"))


@add("select distinct query_id, doc_id, case when isnan(score) then null else score end as score from search_results")
def strict_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Search results through JSON lines that are read strictly; NaN has become null."""
    path, rows = scratch(spark, "strict"), table(spark, sf, "search_results").select("query_id", "doc_id", "score").distinct()
    sinks.write_jsonl(rows, path)
    return tables.read_jsonl(spark, path, rows.schema, strict=True)[0].distinct()


@add("select query_id, query, top_k from search_queries")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path, queries = scratch(spark, "csv"), table(spark, sf, "search_queries").select("query_id", "query", "top_k")
    # a CSV has no difference between null and nothing, so nulls are marked
    sinks.write_csv(queries.withColumn("none", F.col("query").isNull()), path)
    read = spark.read.option("header", "true").option("escape", '"').option("multiLine", "true").schema("query_id long, query string, top_k int, none boolean").csv(path)
    return read.select("query_id", F.when(~F.col("none"), F.coalesce("query", F.lit(""))).alias("query"), "top_k")


@add("select distinct chunk_id from chunk_records where chunk_id is not null")
def resumed_write(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks written in two runs with the same settings, the second of all: only what is missing is added."""
    path, settings = scratch(spark, "resume"), {"dims": 64, "pooling": "mean"}
    chunks = ranking.first_rows(table(spark, sf, "chunk_records").where("chunk_id is not null"), ["chunk_id"], ["ingested_at"]).select("chunk_id", "source_type")
    sinks.resume_write(chunks.where("source_type = 'pdf_page'"), path, "chunk_id", settings)
    sinks.resume_write(chunks, path, "chunk_id", settings)
    return spark.read.parquet(path).select("chunk_id")


@add("select count(*) as queries, count(distinct lower(trim(query))) as words from search_queries where trim(coalesce(query, '')) <> '' and not starts_with(trim(query), '#')")
def query_file(spark: SparkSession, sf: str) -> DataFrame:
    """Queries from a text file with comments and blank lines, and as a list of words."""
    path, queries = scratch(spark, "queries"), table(spark, sf, "search_queries")
    queries.where("query is not null").select("query").union(spark.createDataFrame([("# a comment",), ("",)], "query string")).write.text(path)
    # the words are counted where they are, for a list of any length; read_stopwords is for lists that go into a plan
    words = tables.read_list(spark, path, lower=True).agg(F.count_distinct("item").alias("words"))
    return tables.read_list(spark, path).agg(F.count("*").alias("queries")).crossJoin(words)


@add(f"select doc_id, len(list_filter({tokens_sql('text')}, lambda t: length(t) >= 3 and t not in ('the', 'and', 'for'))) as n from documents")
def own_stopwords(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens by a stopword file of one's own."""
    path = scratch(spark, "stop")
    spark.createDataFrame([("The",), ("and",), ("# no words",), ("for",)], "value string").write.text(path)
    kept = filter_tokens(tokenize("text"), 3, tables.read_stopwords(spark, path))
    return table(spark, sf, "documents").select("doc_id", F.size(kept).cast("long").alias("n"))


@add("select s_suppkey, s_name, null::varchar as rating, s_nationkey::bigint as s_nationkey from supplier")
def parts_read(spark: SparkSession, sf: str) -> DataFrame:
    """A table of several parts with columns that are wanted, one of them missing; ids of any kind become BIGINT."""
    path = scratch(spark, "parts")
    table(spark, sf, "supplier").withColumn("s_nationkey", F.col("s_nationkey").cast("double")).repartition(3).write.parquet(path)
    assert len(tables.list_parts(spark, path)) == 3 and tables.read_table(spark, f"{path}-none", ["a"]).isEmpty()
    return tables.coerce_ids(tables.read_table(spark, path, ["s_suppkey", "s_name", "rating", "s_nationkey"]), "s_nationkey")


@add("with v as (select chunk_id, min(shard_idx) as old from chunk_vectors where chunk_id is not null group by chunk_id) select chunk_id, old, ((row_number() over (order by chunk_id) - 1) // 100)::int as shard_idx from v")
def vector_shards(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the first shard of each id, put into new shards of a hundred."""
    first = tables.first_of_shards(table(spark, sf, "chunk_vectors").where("chunk_id is not null"))
    return tables.vector_shards(first.select("chunk_id", "embedding"), shard_size=100).select("chunk_id", "shard_idx").join(first.select("chunk_id", F.col("shard_idx").alias("old")), "chunk_id")


@add("select query, row_number() over (order by q, r, e) as place from (select query, first(query_id order by query_id, rank, entry_id) as q, first(rank order by query_id, rank, entry_id) as r, first(entry_id order by query_id, rank, entry_id) as e from judged_rows where query is not null group by query)")
def query_order(spark: SparkSession, sf: str) -> DataFrame:
    """Judged queries in the order in which they first appear."""
    return ranking.first_appearance(table(spark, sf, "judged_rows").where("query is not null"), ["query"], ["query_id", "rank", "entry_id"])


@add("select count(*) as \"rows\", coalesce(max(len(agencies_affected)), 0) as longest_agencies_affected, coalesce(max(len(subject_matter)), 0) as longest_subject_matter, count(*) filter (live) as live, count(*) filter (len(agencies_affected) > 1) as several from policies")
def probe_counts(spark: SparkSession, sf: str) -> DataFrame:
    return relational.probe(table(spark, sf, "policies"), ["agencies_affected", "subject_matter"], live=F.col("live"), several=F.size("agencies_affected") > 1)


@add("select distinct title from policies where title is not null order by title limit 50")
def distinct_titles(spark: SparkSession, sf: str) -> DataFrame:
    return relational.distinct_values(table(spark, sf, "policies"), "title", 50)


@add("select distinct stable_id, document_type from page_records where lower(dest_relpath) like '%.pdf' and coalesce(lower(trim(document_type)), '') <> 'commentary'")
def pdf_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return relational.pdf_manifest(table(spark, sf, "page_records"), kind="document_type").select("stable_id", "document_type").distinct()
