"""Queries of the joins, aggregates, windows, set operations and of the extras that Spark brings along."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import values as v
from docloom.operators import ranking, relational
from docloom.plans.registry import Registry, table
from docloom.session import scratch
from docloom.sources import sinks, tables
from docloom.streaming import ingest

registry = Registry()
add = registry.add


@add("select s_suppkey, s_name, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey left join region on r_regionkey = n_regionkey")
def snowflake_join(spark: SparkSession, sf: str) -> DataFrame:
    nation, region, supplier = (table(spark, sf, t) for t in ("nation", "region", "supplier"))
    return relational.enrich(supplier, (nation, F.col("n_nationkey") == F.col("s_nationkey")), (region, F.col("r_regionkey") == F.col("n_regionkey"))).select("s_suppkey", "s_name", "n_name", "r_name")


@add("select o_orderkey, o_custkey, p_name, l_linenumber, l_quantity from lineitem left join orders on o_orderkey = l_orderkey left join part on p_partkey = l_partkey")
def fact_join(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders, part = (table(spark, sf, t) for t in ("lineitem", "orders", "part"))
    return relational.enrich(lines, (orders, F.col("o_orderkey") == F.col("l_orderkey")), (part, F.col("p_partkey") == F.col("l_partkey"))).select("o_orderkey", "o_custkey", "p_name", "l_linenumber", "l_quantity")


@add("select c_custkey, coalesce(count(o_orderkey), 0) as n_orders, coalesce(string_agg(o_orderkey || ':' || o_orderstatus, ' ' order by o_orderdate, o_orderkey), '') as orders from customer left join orders on o_custkey = c_custkey group by c_custkey")
def nested_children(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    nested = relational.nest(orders, "c_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"], "orders")
    out = relational.attach(table(spark, sf, "customer").select("c_custkey"), "c_custkey", (nested, "orders"))
    return out.select("c_custkey", F.size("orders").cast("long").alias("n_orders"), F.array_join(F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"], o["o_orderstatus"])), " ").alias("orders"))


@add("select o_custkey, string_agg(o_orderpriority, ',' order by o_orderdate, o_orderkey) as priorities from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate, o_orderkey) as r from orders) where r = 1 group by o_custkey")
def distinct_children(spark: SparkSession, sf: str) -> DataFrame:
    nested = relational.nest_distinct(table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderpriority"], "p", ["o_orderpriority"])
    return nested.select("o_custkey", F.array_join(F.transform("p", lambda x: x["o_orderpriority"]), ",").alias("priorities"))


@add("select page_ptr_id, first(file_title order by stable_id nulls first, page_num nulls first) filter (file_title is not null) as file_title, first(document_type order by stable_id nulls first, page_num nulls first) filter (document_type is not null) as document_type from page_records group by page_ptr_id")
def first_nonnull(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_records")
    return ranking.first_values(pages, ["page_ptr_id"], ["stable_id", "page_num"], ["file_title", "document_type"])


@add("select page_ptr_id, a.id as related_id, title from (select distinct page_ptr_id, unnest([page_ptr_id - 1, page_ptr_id + 1]) as id from policies) a left join (select page_ptr_id as id, any_value(title) as title from policies group by page_ptr_id) b using (id)")
def related_lookup(spark: SparkSession, sf: str) -> DataFrame:
    policies = ranking.first_rows(table(spark, sf, "policies"), ["page_ptr_id"], ["title"])
    asked = policies.select("page_ptr_id", F.array(F.col("page_ptr_id") - 1, F.col("page_ptr_id") + 1).alias("ids"))
    found = relational.resolve_ids(asked, "page_ptr_id", "ids", policies, "page_ptr_id", ["title"], "related")
    return found.select("page_ptr_id", F.explode("related").alias("r")).select("page_ptr_id", F.col("r.id").alias("related_id"), "r.title")


@add("select doc_id, source from documents where page_ptr_id in (select page_ptr_id from policies where live)")
def semi_join(spark: SparkSession, sf: str) -> DataFrame:
    return relational.only(table(spark, sf, "documents"), table(spark, sf, "policies").where("live"), "page_ptr_id").select("doc_id", "source")


@add("select distinct chunk_id from chunk_records where chunk_id is not null and chunk_id not in (select chunk_id from chunk_vectors where chunk_id is not null)")
def anti_resume(spark: SparkSession, sf: str) -> DataFrame:
    return relational.remaining(table(spark, sf, "chunk_records").where("chunk_id is not null"), table(spark, sf, "chunk_vectors"), "chunk_id").select("chunk_id").distinct()


@add("select chunk_id as id, 'chunk' as kind from chunk_records union all select stable_id, 'page' from page_records union all select slug, 'policy' from policies")
def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    parts = [("chunk_records", "chunk_id", "chunk"), ("page_records", "stable_id", "page"), ("policies", "slug", "policy")]
    return relational.union_all(*(table(spark, sf, t).select(F.col(c).alias("id"), F.lit(k).alias("kind")) for t, c, k in parts))


@add("select l_orderkey, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_partkey order by l_linenumber, l_suppkey, l_extendedprice) as r from lineitem) where r = 1")
def manifest_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_rows(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_linenumber", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey")


@add("select doc_id, text from (select *, row_number() over (partition by text order by doc_id) as r from documents where text is not null) where r = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_rows(table(spark, sf, "documents").where("text is not null"), ["text"], ["doc_id"]).select("doc_id", "text")


@add("with t as (select *, row_number() over (partition by b order by md5(c_custkey || '|7'), c_custkey) as turn from (select *, c_mktsegment || ' | ' || c_nationkey as b from customer)) select c_custkey, b as bucket, turn::int as turn from (select *, row_number() over (order by turn, md5(b || '|7'), b) as o from t) where o <= 100")
def round_robin_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.round_robin_sample(table(spark, sf, "customer"), [F.col("c_mktsegment"), F.col("c_nationkey")], "c_custkey", 100).select("c_custkey", "bucket", "turn")


@add("select c_custkey from customer order by md5(c_custkey || '|7'), c_custkey limit 50")
def hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.hash_sample(table(spark, sf, "customer"), "c_custkey", 50).select("c_custkey")


@add("select event_id, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as island from (select *, case when event_type is distinct from lag(event_type) over w or row_number() over w = 1 then 1 else 0 end as c from events window w as (partition by user_id order by ts, event_id))")
def islands(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.islands(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "island")


@add("with n as (select *, row_number() over (order by ts, event_id) - 1 as r from events), g as (select *, r - row_number() over (partition by user_id order by r) as gap from n) select event_id from (select *, min(gap) over (partition by user_id) as f from g) where gap = f")
def first_islands(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.first_islands(table(spark, sf, "events"), ["ts", "event_id"], ["user_id"])[0].select("event_id")


@add("select event_id, row_number() over (order by ts, event_id) - 1 as row from events")
def global_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.number_rows(table(spark, sf, "events"), ["ts", "event_id"]).select("event_id", "row")


@add("select c_nationkey, c_custkey, c_acctbal, rank from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey)::int as rank from customer) where rank <= 3")
def top_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ranking.top_k(table(spark, sf, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), F.asc("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal", "rank")


@add("select distinct stable_id, 's3://' || s3_bucket || '/' || s3_key as uri, dest_relpath as dest, lower(dest_relpath) like '%.pdf' as pdf from page_records where s3_bucket is not null and s3_key is not null and dest_relpath is not null")
def manifest_normalize(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "page_records")
    manifest = tables.normalize_manifest(pages.select("s3_bucket", "s3_key", "dest_relpath").distinct())
    ids = pages.select("stable_id", F.col("s3_bucket").alias("bucket"), F.col("s3_key").alias("key"), F.col("dest_relpath").alias("dest")).distinct()
    return ids.join(manifest, ["bucket", "key", "dest"]).select("stable_id", "uri", "dest", v.is_pdf_path("dest").alias("pdf"))


@add("select o_orderkey, case when o_orderstatus = 'P' then false when o_custkey % 3 = 0 then o_totalprice > 0 else o_totalprice::bigint = o_custkey * 100 end as skip from orders")
def skip_predicate(spark: SparkSession, sf: str) -> DataFrame:
    local = F.when(F.col("o_orderstatus") != "P", F.bround("o_totalprice").cast("long"))
    expected = F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") * 100)
    return table(spark, sf, "orders").select("o_orderkey", v.skip_download(local, expected, True).alias("skip"))


@add("select query_id, rank, entry_id, score from (select q.query_id, coalesce(r.rank, 0)::int as rank, coalesce(r.entry_id, '') as entry_id, coalesce(printf('%.6f', r.rrf_score), '') as score from (select distinct query_id from search_queries) q left join (select query_id, entry_id, rrf_score, row_number() over (partition by query_id order by rrf_score desc, entry_id) as rank from (select distinct query_id, entry_id, rrf_score from rrf_hits)) r on r.query_id = q.query_id and r.rank <= 3)")
def result_csv(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "rrf_hits").select("query_id", "entry_id", "rrf_score").distinct()
    top = ranking.top_k(hits, ["query_id"], [F.desc("rrf_score"), F.asc("entry_id")], 3)
    rows = sinks.result_rows(table(spark, sf, "search_queries"), top.withColumnRenamed("rrf_score", "score"))
    return rows.select("query_id", "rank", F.coalesce("entry_id", F.lit("")).alias("entry_id"), F.coalesce("score", F.lit("")).alias("score"))


# extras -----------------------------------------------------------------------------------------------------------
@add("select time_bucket(interval 1 hour, ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.tumbling_counts(table(spark, sf, "events"))


@add("select user_id, min(ts) as start, max(ts) + interval 30 minutes as \"end\", count(*) as n from (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as s from (select *, case when ts >= lag(ts) over (partition by user_id order by ts, event_id) + interval 30 minutes or lag(ts) over (partition by user_id order by ts, event_id) is null then 1 else 0 end as c from events)) group by user_id, s")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.session_counts(table(spark, sf, "events"))


@add("select coalesce(l_returnflag, '*') as flag, coalesce(l_linestatus, '*') as status, count(*) as n, round(sum(l_quantity), 2) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def lineitem_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "quantity")


@add()
def approximate_users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"))


@add("select * from (pivot (select l_returnflag, l_linestatus, l_quantity from lineitem) on l_linestatus in ('F', 'O') using round(sum(l_quantity), 2) group by l_returnflag)")
def lineitem_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.sum("l_quantity"), 2))


@add()
def streamed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """chunk_records through a stream that keeps each id once, until all that is there is read."""
    path = scratch(spark, "stream")
    schema = table(spark, sf, "chunk_records").schema
    stream = ingest.stream_table(spark, f"{sf}/chunk_records.parquet", schema).where("chunk_id is not null").select("chunk_id", "source_type", "ingested_at")
    ingest.ingest(ingest.first_arrivals(stream, lateness="3650 days"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")
