"""Queries of the lexical and dense search, entry results, fusion, cut-off and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import vectors as vec
from docloom.functions.values import stable_shard
from docloom.operators import bm25, dense, entries, evaluation, ranking
from docloom.plans.registry import Registry, table
from docloom.plans.text_queries import ONCE, chunks_once, kept_sql
from docloom.session import materialise, scratch

registry = Registry()
add = registry.add

# BM25 of search_queries over chunk_records ------------------------------------------------------------------------
SCORED = f"""
chunks as {ONCE},
toks as (select chunk_id, {kept_sql("text")} as k from chunks),
docs as (select chunk_id, k, len(k) as dl from toks where len(k) > 0 and len(list_distinct(k)) <= 50000),
stats as (select count(*) as n, avg(dl) as avgdl from docs),
post as (select term, chunk_id, dl, count(*) as tf from (select chunk_id, dl, unnest(k) as term from docs) group by all),
asked as (select query_id, unnest(list_distinct({kept_sql("query")})) as term from search_queries),
freq as (select term, count(*) as df from post group by term),
scored as (
  select query_id, chunk_id as doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) as score, min(a.term) as first_term
  from asked a join freq using (term) join post using (term), stats group by query_id, chunk_id)
"""


def ranked_sql(k: int, where: str = "true", of: str = "scored") -> str:
    return f"select query_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, first_term, doc_id)::int as rank from {of} where {where}) where rank <= {k}"


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    return bm25.build_index(chunks_once(spark, sf), "chunk_id", "text")


def _search(spark: SparkSession, sf: str, **options) -> DataFrame:
    return bm25.search(_index(spark, sf), table(spark, sf, "search_queries"), **options)


@add(f"with {SCORED} {ranked_sql(10)}")
def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, top_k=10)


@add(f"with {SCORED} {ranked_sql(10)}")
def bm25_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The same by an index that is written, and read again by the shards of the terms asked only."""
    path = scratch(spark, "index")
    bm25.save_index(_index(spark, sf), path)
    queries = table(spark, sf, "search_queries")
    return bm25.search(bm25.load_index(spark, path, queries), queries, top_k=10)


ONE_QUERY = "asylum hearing officer and the decision"


@add(f"with {SCORED} {ranked_sql(50)}".replace("from search_queries", f"from (select 1 as query_id, '{ONE_QUERY}' as query)"))
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_index(spark, sf), spark.createDataFrame([(1, ONE_QUERY)], "query_id int, query string"), top_k=50)


FILTER = "doc_id in (select chunk_id from chunk_records where meta_flat.administration = 'Birchwell')"


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.metadata_filter(table(spark, sf, "chunk_records"), administration="Birchwell").select(F.col("chunk_id").alias("doc_id")).distinct()


@add(f"with {SCORED}, cand as (select * from (select *, row_number() over (partition by query_id order by score desc, first_term, doc_id) as r from scored) where r <= 100) {ranked_sql(10, FILTER, 'cand')}")
def bm25_filtered_post(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, top_k=10, filtered=_filtered(spark, sf), mode="post")


@add(f"with {SCORED} {ranked_sql(10, FILTER)}")
def bm25_filtered_pre(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, top_k=10, filtered=_filtered(spark, sf), mode="pre")


DAY = "case when length(trim(announced_date)) >= 10 then coalesce(try_cast(substr(trim(announced_date), 1, 4) as int) * 10000 + try_cast(substr(trim(announced_date), 6, 2) as int) * 100 + try_cast(substr(trim(announced_date), 9, 2) as int), 0) else 0 end"
ENTRY = f"""{SCORED},
cand as (select * from (select *, row_number() over (partition by query_id order by score desc, first_term, doc_id) as hit_rank from scored) where hit_rank <= 100),
hits as (select query_id, hit_rank, score, c.chunk_id, c.page_ptr_id as entry_id, c.source_type, coalesce(c.policydocument_id, '') as attachment_id, meta_flat.announced_date as announced_date, c.text from cand join chunks c on c.chunk_id = doc_id),
dated as (select *, {DAY} as date from hits),
placed as (select *, row_number() over (partition by query_id, entry_id order by score desc, date desc, hit_rank) as m, first(source_type) over (partition by query_id, entry_id order by score desc, date desc, hit_rank) as top_type from dated),
shown as (select *, row_number() over (partition by query_id, entry_id order by case when top_type <> 'policy_title' then 0 when source_type = 'pdf_page' then 0 when source_type = 'policy_summary' then 1 else 2 end, m) as d from placed),
ents as (
  select query_id, entry_id, max(score) filter (m = 1) as score, max(hit_rank) filter (m = 1) as best_rank, max(date) filter (m = 1) as best_date, max(top_type) as top_type, max(chunk_id) filter (d = 1) as chunk_id, max(announced_date) filter (d = 1) as announced_date, count(*) as matched_count, string_agg(chunk_id, ' ' order by m) as matched
  from shown group by query_id, entry_id)
"""


def _hits(index: bm25.Index, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Candidates with the columns of their chunks, without texts, for which no query of entries asks."""
    found = bm25.best(index, queries, 100)
    shown = chunks.select(F.col("chunk_id").alias("doc_id"), "chunk_id", F.col("page_ptr_id").alias("entry_id"), F.coalesce("policydocument_id", F.lit("")).alias("attachment_id"), "source_type", F.lit(None).cast("string").alias("text"), F.col("meta_flat.announced_date").alias("announced_date"))
    return found.join(shown, "doc_id")


def _entries(spark: SparkSession, sf: str, by_date: bool = False) -> DataFrame:
    """Entries of each query; queries with the same terms have the same, which are rolled up once."""
    queries, chunks = table(spark, sf, "search_queries"), materialise(chunks_once(spark, sf), "chunks", tidy=True)
    same = materialise(bm25.same_terms(queries), "same")
    ids = same.select("first_id").distinct()
    first = queries.join(ids, queries.query_id.eqNullSafe(ids.first_id), "left_semi")
    found = entries.roll_up(_hits(bm25.build_index(chunks, "chunk_id", "text"), first, chunks), top_k=10, by_date=by_date)
    found = found.withColumnRenamed("query_id", "_first")
    return same.join(found, F.col("first_id").eqNullSafe(F.col("_first"))).drop("first_id", "_first")


ENTRY_COLUMNS = "query_id, entry_id, rank, score, best_rank::int as best_rank, case top_type when 'policy_title' then 'title' when 'policy_summary' then 'summary' else 'pdf' end as source, chunk_id, matched_count, matched"


@add(f"with {ENTRY} select {ENTRY_COLUMNS} from (select *, row_number() over (partition by query_id order by score desc, best_date desc, best_rank, entry_id)::int as rank from ents) where rank <= 10")
def bm25_entries(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf).select("query_id", "entry_id", "rank", "score", "best_rank", "source", "chunk_id", "matched_count", F.array_join("matched_chunk_ids", " ").alias("matched"))


@add(f"with {ENTRY} select {ENTRY_COLUMNS} from (select *, row_number() over (partition by query_id order by {DAY} desc, score desc, best_rank, entry_id)::int as rank from ents) where rank <= 10")
def bm25_entries_by_date(spark: SparkSession, sf: str) -> DataFrame:
    return _entries(spark, sf, by_date=True).select("query_id", "entry_id", "rank", "score", "best_rank", "source", "chunk_id", "matched_count", F.array_join("matched_chunk_ids", " ").alias("matched"))


TITLES = f"select page_ptr_id as entry_id, coalesce(min_by(text, chunk_id) filter (source_type = 'policy_title' and text is not null), '') as title, coalesce(min_by(text, chunk_id) filter (source_type = 'policy_summary' and text is not null), '') as summary from {ONCE} group by page_ptr_id"


@add(TITLES)
def titles_and_summaries(spark: SparkSession, sf: str) -> DataFrame:
    return entries.titles_and_summaries(chunks_once(spark, sf))


@add(f"with {ENTRY}, titles as ({TITLES}), top as (select *, row_number() over (partition by query_id order by score desc, best_date desc, best_rank, entry_id)::int as rank from ents) select query_id, top.entry_id, rank, coalesce(title, '') as title, coalesce(summary, '') as summary from top left join titles on titles.entry_id = top.entry_id where rank <= 10")
def entry_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Entry results with the title and summary of their entry."""
    return entries.with_titles(_entries(spark, sf), entries.titles_and_summaries(chunks_once(spark, sf))).select("query_id", "entry_id", "rank", "title", "summary")


# lists of search_results ------------------------------------------------------------------------------------------
LISTS = """lists as (
  select query_id, retriever, entry_id, score, best_rank, chunk_id, doc_id, row_number() over (partition by query_id, retriever order by score desc, best_rank nulls last, entry_id)::int as rank
  from (select *, row_number() over (partition by query_id, retriever, entry_id order by score desc, best_rank nulls last, doc_id) as r from search_results where entry_id is not null and not isnan(score) and score is not null) where r = 1)
"""


def _lists(spark: SparkSession, sf: str) -> DataFrame:
    """Ranked entry lists of both retrievers: an entry's best hit counts."""
    rows = table(spark, sf, "search_results").where("entry_id is not null and score is not null and not isnan(score)")
    best = ranking.first_rows(rows, ["query_id", "retriever", "entry_id"], [F.desc("score"), F.asc_nulls_last("best_rank"), "doc_id"])
    w = Window.partitionBy("query_id", "retriever").orderBy(F.desc("score"), F.asc_nulls_last("best_rank"), "entry_id")
    return best.withColumn("rank", F.row_number().over(w)).select("query_id", "retriever", "entry_id", "score", "best_rank", "chunk_id", "doc_id", "rank")


def _fused(spark: SparkSession, sf: str) -> DataFrame:
    lists = _lists(spark, sf)
    one = lambda r: lists.where(F.col("retriever") == r).withColumn("matched_chunk_ids", F.array("chunk_id"))
    return entries.fuse({"bm25": one("bm25"), "semantic": one("semantic")}, rrf_k=60, final_k=50)


FUSED = f"""{LISTS},
fused as (
  select query_id, entry_id, round(sum(1.0::double / (60 + rank)), 12) as rrf_score, string_agg(distinct retriever, ' ' order by retriever) as sources,
    min(rank) filter (retriever = 'bm25') as bm25_rank, min(rank) filter (retriever = 'semantic') as semantic_rank,
    max(score) filter (retriever = 'bm25') as bm25_score, max(score) filter (retriever = 'semantic') as semantic_score,
    min_by(chunk_id, retriever) as chunk_id, count(distinct chunk_id)::int as matched_count
  from lists group by query_id, entry_id),
ranked as (select *, row_number() over (partition by query_id order by rrf_score desc, entry_id)::int as rank from fused)
"""


@add(f"with {FUSED} select * replace (coalesce(bm25_rank, 0) as bm25_rank, coalesce(semantic_rank, 0) as semantic_rank) from ranked where rank <= 50")
def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "entry_id", "rrf_score", F.array_join("sources", " ").alias("sources"), F.coalesce("bm25_rank", F.lit(0)).alias("bm25_rank"), F.coalesce("semantic_rank", F.lit(0)).alias("semantic_rank"), "bm25_score", "semantic_score", "chunk_id", "matched_count", "rank")


@add(
    f"""with {LISTS}, s as (select query_id, entry_id, score * 12 - 6 as ce_score, rank from lists where retriever = 'semantic'),
    p as (select *, row_number() over w as i, first(ce_score) over w as best, count(*) over (partition by query_id) as m from s window w as (partition by query_id order by rank)),
    ok as (select *, min(case when ce_score >= best - 4.5 and ce_score >= -3.5 then 1 else 0 end) over (partition by query_id order by i rows unbounded preceding) as good from p),
    k as (select *, sum(good) over (partition by query_id) as n from ok)
    select query_id, entry_id, rank from k where i <= least(case when n < 3 then greatest(n, least(3, 20, m)) else n end, 20)"""
)
def confidence_band(spark: SparkSession, sf: str) -> DataFrame:
    return entries.confidence_band(_semantic(spark, sf)).select("query_id", "entry_id", "rank")


def _semantic(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf).where("retriever = 'semantic'").select("query_id", "entry_id", (F.col("score") * 12 - 6).alias("ce_score"), "rank")


@add(
    f"""with {LISTS}, s as (select query_id, entry_id, score * 12 - 6 as ce_score, rank from lists where retriever = 'semantic'),
    p as (select *, row_number() over w as i, count(*) over (partition by query_id) as m, avg(ce_score) over (partition by query_id order by rank rows unbounded preceding) as above, avg(ce_score) over (partition by query_id order by rank rows between 1 following and unbounded following) as below from s window w as (partition by query_id order by rank)),
    q as (select *, case when i <= least(20, m - 1) then round(above - below - 5.0 / i, 9) end as sep from p),
    st as (select query_id, coalesce(min(i) filter (sep = top), 1) as star from (select *, max(sep) over (partition by query_id) as top from q) group by query_id),
    ok as (select q.*, min(case when i <= star and ce_score >= -2.5 then 1 else 0 end) over (partition by query_id order by i rows unbounded preceding) as good from q join st using (query_id)),
    k as (select *, sum(good) over (partition by query_id) as n from ok)
    select query_id, entry_id, rank from k where i <= least(case when n < 3 then greatest(n, least(3, 20, m)) else n end, 20)"""
)
def confidence_changepoint(spark: SparkSession, sf: str) -> DataFrame:
    return entries.change_point(_semantic(spark, sf)).select("query_id", "entry_id", "rank")


_WORDS = "list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]{{2,}}'))"
RERANKED = f"""{FUSED},
pairs as (select r.*, {_WORDS.format("q.query")} as asked, {_WORDS.format("c.text")} as had from ranked r join search_queries q using (query_id) left join {ONCE} c on c.chunk_id = r.chunk_id where rank <= 50),
scored as (select *, (len(list_intersect(asked, had)) + 0.5::double) / (len(asked) + 1) as p from pairs),
ce as (select query_id, entry_id, rrf_score, round(ln(p / (1 - p)), 9) as ce_score from scored)
"""


@add(f"with {RERANKED} select query_id, entry_id, row_number() over (partition by query_id order by ce_score desc, rrf_score desc, entry_id)::int as rank, ce_score, rrf_score from ce")
def reranked(spark: SparkSession, sf: str) -> DataFrame:
    texts = chunks_once(spark, sf).select("chunk_id", "text")
    return entries.rerank(_fused(spark, sf), table(spark, sf, "search_queries"), texts).select("query_id", "entry_id", "rank", "ce_score", "rrf_score")


@add(f"with {RERANKED.replace('rank <= 50', 'true')} select query_id, entry_id, case when old > 5 then old else row_number() over (partition by query_id, old > 5 order by ce_score desc, rrf_score desc, entry_id)::int end as rank, case when old <= 5 then ce_score end as ce_score from (select ce.*, r.rank as old from ce join ranked r using (query_id, entry_id)) where old <= 50")
def reranked_head(spark: SparkSession, sf: str) -> DataFrame:
    """Only the first five of each query by pair score, the others stay behind them."""
    texts = chunks_once(spark, sf).select("chunk_id", "text")
    return entries.rerank(_fused(spark, sf), table(spark, sf, "search_queries"), texts, depth=5).select("query_id", "entry_id", "rank", "ce_score")


DENSE = """
vec as (select chunk_id, min_by(embedding, shard_idx)::double[] as v from chunk_vectors where chunk_id is not null and embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 group by chunk_id),
near as (select * from (select q.chunk_id as query_id, e.chunk_id, round(list_dot_product(q.v, e.v), 6) + 0.0 as score, row_number() over (partition by q.chunk_id order by round(list_dot_product(q.v, e.v), 6) desc, e.chunk_id) as rank from vec q, vec e where ('0x' || left(md5(q.chunk_id), 8))::bigint % 50 = 0) where rank <= 100),
hits as (select near.*, page_ptr_id as entry_id from near join """ + ONCE + """ c using (chunk_id) where FILTER),
enough as (select query_id, count(distinct entry_id) filter (rank <= 20) >= 5 as yes from hits group by query_id),
seen as (select hits.*, row_number() over (partition by query_id order by rank) as hit_rank from hits join enough using (query_id) where rank <= 20 or not yes),
ents as (select query_id, entry_id, max(score) as score, min(hit_rank) as best_rank, count(*) as matched_count from seen where entry_id is not null group by query_id, entry_id)
select query_id, entry_id, row_number() over (partition by query_id order by score desc, best_rank, entry_id)::int as rank, score, best_rank::int as best_rank, matched_count from ents"""


def _dense_entries(spark: SparkSession, sf: str, **filters: str) -> DataFrame:
    vectors = materialise(dense.valid_vectors(table(spark, sf, "chunk_vectors"), 64), "vectors")
    asked = vectors.where(stable_shard("chunk_id", 50) == 0).withColumnRenamed("chunk_id", "query_id")
    near = dense.exact_search(vectors, asked, 100)
    chunks = chunks_once(spark, sf)
    allowed = bm25.metadata_filter(chunks, **filters) if filters else None
    shown = chunks.select("chunk_id", F.col("page_ptr_id").alias("entry_id"), F.col("chunk_id").alias("doc_id"), F.coalesce("policydocument_id", F.lit("")).alias("attachment_id"), "source_type", "text", F.lit(None).cast("string").alias("announced_date"))
    hits = dense.entry_hits(near, shown, top_k=5, depth=20, retry=5, allowed=allowed)
    return entries.roll_up(hits, top_k=None).select("query_id", "entry_id", "rank", "score", "best_rank", "matched_count")


@add("with " + DENSE.replace("FILTER", "true"))
def dense_entries(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of a dense search: twenty chunks of each query, a hundred where these have fewer than five entries."""
    return _dense_entries(spark, sf)


@add("with " + DENSE.replace("FILTER", "meta_flat.administration = 'Birchwell'"))
def dense_entries_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The same with a filter after the search, so that the retry matters."""
    return _dense_entries(spark, sf, administration="Birchwell")


@add()
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 and dense lists of the queries, fused, reranked and cut."""
    queries = table(spark, sf, "search_queries")
    chunks = materialise(chunks_once(spark, sf), "chunks")
    embedder = dense.Embedder()
    stored = materialise(dense.embed(chunks, embedder), "vectors")
    asked = materialise(dense.embed(queries.where("query is not null"), embedder, "query_id", "query"), "queries")
    # written, for the lists below would each run it again; hits go without their texts, which the rerank joins to the few entries
    near = materialise(dense.exact_search(stored, asked, 100), "near", tidy=True)
    hits = near.withColumn("hit_rank", F.col("rank")).join(chunks.select("chunk_id", F.col("page_ptr_id").alias("entry_id"), F.col("chunk_id").alias("doc_id"), F.coalesce("policydocument_id", F.lit("")).alias("attachment_id"), "source_type", F.lit(None).cast("string").alias("text"), F.col("meta_flat.announced_date").alias("announced_date")), "chunk_id")
    lists = {"bm25": _entries(spark, sf), "semantic": entries.roll_up(hits, top_k=10)}
    ranked = entries.rerank(entries.fuse(lists), queries, chunks.select("chunk_id", "text"))
    return entries.confidence_band(ranked).select("query_id", "entry_id", "rank", "ce_score", "rrf_score")


# evaluation -------------------------------------------------------------------------------------------------------
METRICS = """(
  with r as (select query, rank, relevance as rel, row_number() over (partition by query order by rank, relevance desc) as n, count(*) filter (rank <= 5) over (partition by query) as within from judged_rows where query is not null and rank is not null and relevance is not null),
  k as (select *, row_number() over (partition by query order by n) as i, row_number() over (partition by query order by rel desc, n) as j from r where rank <= 5 or (within = 0 and n <= 5))
  select query, round(case when sum(case when j <= 5 then rel / log2(j + 1) else 0 end) > 0 then sum(case when i <= 5 then rel / log2(i + 1) else 0 end) / sum(case when j <= 5 then rel / log2(j + 1) else 0 end) else 0.0 end, 6) as ndcg,
    (count(*) filter (i <= 5 and rel >= 2) > 0)::int::double as success, round(coalesce(1.0 / min(i) filter (i <= 5 and rel >= 2), 0.0), 6) as mrr,
    round((count(*) filter (i <= 5 and rel >= 2))::double / count(*) filter (i <= 5), 6) as "precision", count(*) as num_considered from k group by query)"""


@add(f"select * from {METRICS}")
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ir_metrics(table(spark, sf, "judged_rows"))


@add(f"select count(*) as num_queries, coalesce(round(avg(ndcg), 6), 0) as ndcg, coalesce(round(avg(success), 6), 0) as success, coalesce(round(avg(mrr), 6), 0) as mrr, coalesce(round(avg(\"precision\"), 6), 0) as \"precision\" from {METRICS}")
def ir_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.ir_summary(table(spark, sf, "judged_rows"))


# vectors ----------------------------------------------------------------------------------------------------------
DOUBLES = "(embedding::double[])"


@add(f"select vec_id, round(list_aggregate(list_transform({DOUBLES}, lambda x: x / greatest(sqrt(list_dot_product({DOUBLES}, {DOUBLES})), 1e-12)), 'sum'), 6) as total, round({DOUBLES}[1] / greatest(sqrt(list_dot_product({DOUBLES}, {DOUBLES})), 1e-12), 6) as first from embeddings")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    unit = vec.l2_normalize(F.col("embedding"))
    return table(spark, sf, "embeddings").select("vec_id", unit.alias("u")).select("vec_id", F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(F.element_at("u", 1), 6).alias("first"))


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: vectors whose id is divisible by 50, searched among all."""
    return table(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def nearest_sql(score: str, k: int) -> str:
    return f"select query_id, vec_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from (select q.vec_id as query_id, e.vec_id, round({score}, 6) + 0.0 as score from embeddings q, embeddings e where q.vec_id % 50 = 0)) where rank <= {k}"


INNER = "list_dot_product(q.embedding::double[], e.embedding::double[])"


@add(nearest_sql(INNER, 10))
def ip_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.exact_search(table(spark, sf, "embeddings"), _asked(spark, sf), 10, "ip", "vec_id")


@add(nearest_sql("-power(list_distance(q.embedding::double[], e.embedding::double[]), 2)", 10))
def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.exact_search(table(spark, sf, "embeddings"), _asked(spark, sf), 10, "l2", "vec_id")


@add(f"select q.vec_id as query_id, r.rank as own_rank from embeddings q left join ({nearest_sql(INNER, 5)}) r on r.query_id = q.vec_id and r.vec_id = q.vec_id where q.vec_id % 50 = 0")
def self_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return dense.self_retrieval(vectors, vectors.where("vec_id % 50 = 0"), 5, "vec_id")


@add("select label, pos, round(avg(x::double), 6) as mean from (select label, unnest(range(len(embedding)))::int as pos, unnest(embedding) as x from embeddings) group by label, pos")
def centroid_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return dense.centroids(table(spark, sf, "embeddings"), "label").withColumn("mean", F.round("mean", 6))


@add(
    """select *, case when missing_id > 0 then 'MISSING_ID' when missing_vector > 0 then 'MISSING_VECTOR' when bad_dimension > 0 then 'BAD_DIMENSION' when not_finite > 0 then 'NOT_FINITE' when duplicate_id > 0 then 'DUPLICATE_ID' else 'OK' end as status from (
    select shard_idx, count(*) as "rows", count(*) filter (e = 1) as missing_id, count(*) filter (e = 2) as missing_vector, count(*) filter (e = 3) as bad_dimension, count(*) filter (e = 4) as not_finite, count(*) filter (again) as duplicate_id, count(*) as expected
    from (select shard_idx, case when chunk_id is null then 1 when embedding is null then 2 when len(embedding) <> 64 then 3 when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 4 end as e,
      chunk_id is not null and shard_idx > min(shard_idx) over (partition by chunk_id) as again from chunk_vectors) group by shard_idx)"""
)
def vector_validation(spark: SparkSession, sf: str) -> DataFrame:
    return dense.validate_shards(table(spark, sf, "chunk_vectors"), 64)


@add(
    """with e as (select shard_idx, case when chunk_id is null then 1 when embedding is null then 2 when len(embedding) <> 64 then 3 when len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) > 0 then 4 else 0 end as e from chunk_vectors),
    s as (select shard_idx, count(*) as n, count(*) filter (e > 0) as bad from e group by shard_idx)
    select shard_idx from s where bad = 0 and shard_idx % 3 <> 1"""
)
def shard_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Shards that may be indexed by a manifest that counts one vector too many in every third shard and has one shard that is missing."""
    vectors = table(spark, sf, "chunk_vectors")
    manifest = vectors.groupBy("shard_idx").agg((F.count("*") + (F.col("shard_idx") % 3 == 1).cast("int")).alias("count"))
    manifest = manifest.unionByName(spark.createDataFrame([(1_000_000, 5)], "shard_idx int, count long"))
    return dense.usable_shards(dense.validate_shards(vectors, 64, manifest), empty=True)


@add("select count(*) as chunks, count(v.chunk_id) as indexed, round(100.0 * count(v.chunk_id) / count(*), 2) as coverage_pct from (select distinct chunk_id from chunk_records) c left join (select distinct chunk_id from chunk_vectors) v using (chunk_id)")
def vector_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return dense.coverage(table(spark, sf, "chunk_vectors"), table(spark, sf, "chunk_records"))


@add()
def centroid_list_topk(spark: SparkSession, sf: str) -> DataFrame:
    lists = dense.CentroidLists(table(spark, sf, "embeddings"), 16, "vec_id")
    return lists.search(_asked(spark, sf), 10, 8)


@add()
def embed_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return dense.embed(chunks_once(spark, sf), dense.Embedder())
