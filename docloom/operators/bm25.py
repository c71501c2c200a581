"""Lexical index and BM25 search over batches of queries."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions.text import filter_tokens, tokenize
from docloom.functions.values import stable_shard
from docloom.operators import blocks
from docloom.operators.ranking import number_rows
from docloom.session import materialise

K1, B = 1.2, 0.75
MAX_UNIQUE_TERMS = 50_000


@dataclass
class Index:
    """postings: term, doc_id, tf, dl (the document's length rides along, so a search needs no further join).
    terms: term, df, idf. docs: doc_id, dl. n_docs, avgdl: over the admitted documents. tokens: doc_id, tokens, dl, of an index just built."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    n_docs: int
    avgdl: float
    tokens: DataFrame | None = None


def idf(n_docs: Column, df: Column) -> Column:
    return F.log(1 + (n_docs - df + 0.5) / (df + 0.5))


def term_score(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    below = tf + k1 * (1 - b + b * dl / avgdl)
    return F.when(below <= 0, 0.0).otherwise(idf_ * tf * (k1 + 1) / below)


def document_terms(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tokens and dl of documents with a token and not too many different ones."""
    tokens = df.select(F.col(id_col).alias("doc_id"), filter_tokens(tokenize(text_col)).alias("tokens"))
    # a document can have too many different terms only if it has so many terms, which spares most the distinct
    admitted = (F.size("tokens") > 0) & ((F.size("tokens") <= MAX_UNIQUE_TERMS) | (F.size(F.array_distinct("tokens")) <= MAX_UNIQUE_TERMS))
    return tokens.where(admitted).withColumn("dl", F.size("tokens"))


def postings_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """term, doc_id, dl, tf."""
    return _postings(document_terms(df, id_col, text_col))


def _postings(docs: DataFrame) -> DataFrame:
    """Postings partitioned by document: what is grouped by document later on needs no further shuffle."""
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    terms = docs.repartition(n, "doc_id").select("doc_id", "dl", F.explode("tokens").alias("term"))
    return terms.groupBy("doc_id", "dl", "term").agg(F.count("*").cast("int").alias("tf"))


def corpus_stats(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row: n_docs, total_len, avgdl."""
    return _stats(document_terms(df, id_col, text_col))


def _stats(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total_len"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def build_index(df: DataFrame, id_col: str, text_col: str) -> Index:
    """The index of the documents. Their tokens are written once; all parts of the index read that table."""
    docs = materialise(document_terms(df, id_col, text_col), "tokens")
    postings = _postings(docs)
    stats = _stats(docs).first()
    frequencies = postings.groupBy("term").agg(F.count("*").alias("df"))
    terms = frequencies.withColumn("idf", idf(F.lit(stats.n_docs), F.col("df")))
    return Index(postings, terms, docs.select("doc_id", "dl"), stats.n_docs, stats.avgdl, docs)


def posting_lists(postings: DataFrame) -> DataFrame:
    """term, df and its postings in order of doc_id: the stored form of the index.

    A term's list is as long as its df; ``save_index`` stores rows instead, which has no such group.
    """
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def dense_ids(df: DataFrame, order: list[str]) -> DataFrame:
    """doc_id from 0 without gaps, in the order given."""
    return number_rows(df, order, "doc_id")


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id and its distinct terms."""
    tokens = F.array_distinct(filter_tokens(tokenize("query")))
    return queries.select("query_id", F.explode(tokens).alias("term"))


def score(index: Index, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score (six decimals) and first_term of every document with a term of the query.

    The weights of the query terms are written first, so their size is known: while they are small, the optimizer
    broadcasts them to the postings, which stay partitioned by document, and scores are summed and cut to the best of each
    partition before anything is shuffled; a large batch is joined by term instead.
    """
    asked = query_terms(queries)
    # the filter by the terms asked goes below the counting of terms: postings of others are never made, here and in the scores
    of_asked = lambda terms: index.postings.join(terms.select("term").distinct(), "term", "left_semi")
    df = of_asked(asked).groupBy("term").agg(F.count("*").alias("df"))
    weights = materialise(asked.join(df, "term").select("query_id", "term", idf(F.lit(index.n_docs), F.col("df")).alias("idf")), "weights")
    part = term_score(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(index.avgdl), k1, b)
    return of_asked(weights).join(weights, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"), F.min("term").alias("first_term"))


#: Different terms of a batch up to which they are handed to the scan as a filter.
TERMS_IN_FILTER = 1000


def save_index(index: Index, path: str, shards: int = 128) -> None:
    """Postings in a folder a shard of terms, sorted by term in each file, terms likewise, document lengths and statistics."""
    spark = index.postings.sparkSession
    for df, name in ((index.postings.select("term", "doc_id", "tf", "dl"), "postings"), (index.terms.select("term", "df"), "terms")):
        sharded = df.withColumn("shard", stable_shard("term", shards))
        sharded.repartition("shard").sortWithinPartitions("shard", "term").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/{name}")
    index.docs.write.mode("overwrite").parquet(f"{path}/docs")
    spark.createDataFrame([(index.n_docs, float(index.avgdl), shards)], "n_docs long, avgdl double, shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")


def load_index(spark: SparkSession, path: str, queries: DataFrame | None = None) -> Index:
    """A stored index. With ``queries``, only the folders of their terms are read, and in these only the row groups of the terms."""
    stats = spark.read.parquet(f"{path}/stats").first()
    postings, terms = spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms")
    if queries is not None:
        asked = query_terms(queries).select("term").distinct()
        shards = [r.shard for r in asked.select(stable_shard("term", stats.shards).alias("shard")).distinct().collect()]  # at most as many as there are shards
        listed = [r.term for r in asked.limit(TERMS_IN_FILTER + 1).collect()]
        of = F.col("shard").isin(shards) if len(listed) > TERMS_IN_FILTER else F.col("shard").isin(shards) & F.col("term").isin(listed)
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        # by document, as in an index just built: scores of a document are summed where its postings are
        postings, terms = postings.where(of).repartition(n, "doc_id"), terms.where(of)
    return Index(postings.drop("shard"), terms.drop("shard").withColumn("idf", idf(F.lit(stats.n_docs), F.col("df"))), spark.read.parquet(f"{path}/docs"), stats.n_docs, stats.avgdl)


def candidates(scored: DataFrame, top_k: int = 10, oversample: int = 10, max_candidates: int | None = None) -> DataFrame:
    """The best documents of each query with hit_rank; ties by the first matching term, then doc_id."""
    n = max_candidates if max_candidates and max_candidates > 0 else max(top_k * max(1, oversample), top_k)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_term", "doc_id")
    return scored.withColumn("hit_rank", F.row_number().over(w)).where(F.col("hit_rank") <= n)


def same_terms(queries: DataFrame) -> DataFrame:
    """query_id and first_id, the smallest id of the queries with the same terms; queries without a term have no row."""
    sets = _term_sets(queries)
    return sets.join(sets.groupBy("key").agg(F.min("query_id").alias("first_id")), "key").select("query_id", "first_id")


def _term_sets(queries: DataFrame) -> DataFrame:
    """query_id, asked (its terms in order) and key, equal for equal terms."""
    asked = F.sort_array(F.collect_list("term"))
    return query_terms(queries).groupBy("query_id").agg(asked.alias("asked")).withColumn("key", F.array_join("asked", " "))


def best(index: Index, queries: DataFrame, n: int, filtered: DataFrame | None = None, mode: str = "post") -> DataFrame:
    """query_id, doc_id, score, first_term and hit_rank of the n best documents of each query; filtered and mode as in ``search``.

    Different sets of terms are scored against blocks of documents. A batch of more than ``blocks.MAX_TERMS`` different terms is joined by term.
    """
    sets = materialise(_term_sets(queries), "sets")
    terms = sorted(r.term for r in sets.select(F.explode("asked").alias("term")).distinct().limit(blocks.MAX_TERMS + 1).collect())
    if not 0 < len(terms) <= blocks.MAX_TERMS:
        return _best_by_join(index, queries, n, filtered, mode)
    tokens = index.tokens
    if tokens is not None and not tokens.groupBy("doc_id").count().where("count > 1").isEmpty():
        tokens = None  # copies of an id are one document, which the postings have put together
    rows = blocks.from_postings(index.postings, terms) if tokens is None else blocks.from_tokens(tokens, terms)
    built = blocks.build(rows, len(terms), filtered)
    df, avgdl = blocks.frequencies(built, len(terms)), index.avgdl
    idfs = np.log(1 + (index.n_docs - df + 0.5) / (df + 0.5))

    def part(term: np.ndarray, tf: np.ndarray, dl: np.ndarray) -> np.ndarray:
        return idfs[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))

    place = {t: i for i, t in enumerate(terms)}
    found = blocks.top(built, sets.select("key", "asked").dropDuplicates(["key"]), terms, place, part, n, filtered is not None and mode == "pre")
    return sets.select("query_id", "key").join(found.join(blocks.doc_ids(built), ["block", "place"]), "key").select("query_id", "doc_id", "score", "first_term", "hit_rank")


def _best_by_join(index: Index, queries: DataFrame, n: int, filtered: DataFrame | None, mode: str) -> DataFrame:
    scored = score(index, queries)
    if filtered is not None and mode == "pre":
        scored = scored.join(filtered.select("doc_id"), "doc_id", "left_semi")
    found = candidates(scored, n, 1)
    if filtered is not None and mode == "post":
        found = found.join(filtered.select("doc_id"), "doc_id", "left_semi")
    return found


def metadata_filter(df: DataFrame, entry_id: str | None = None, administration: str | None = None, agency: str | None = None, subject: str | None = None, meta: str = "meta_flat", entry: str = "page_ptr_id") -> DataFrame:
    """Rows that meet all filters given; an empty filter is none."""
    if entry_id:
        df = df.where(F.col(entry) == entry_id)
    if administration:
        df = df.where(F.col(f"{meta}.administration") == administration)
    if agency:
        df = df.where(F.array_contains(f"{meta}.agencies_affected", agency))
    if subject:
        df = df.where(F.array_contains(f"{meta}.subject_matter", subject))
    return df


def search(index: Index, queries: DataFrame, top_k: int = 10, oversample: int = 10, filtered: DataFrame | None = None, mode: str = "post") -> DataFrame:
    """query_id, doc_id, score, rank of the best documents.

    filtered: ids (doc_id) that a filter leaves. Mode "post" applies it to the candidates, so that it may leave fewer than
    ``top_k``; "pre" applies it before ranking.
    """
    if filtered is None or mode == "pre":
        return best(index, queries, top_k, filtered, mode).select("query_id", "doc_id", "score", F.col("hit_rank").alias("rank"))
    found = best(index, queries, max(top_k * max(1, oversample), top_k), filtered, mode)
    w = Window.partitionBy("query_id").orderBy("hit_rank")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "doc_id", "score", "rank")
