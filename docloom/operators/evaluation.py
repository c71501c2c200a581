"""Retrieval metrics and overlap statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import containment, word_set


def considered(judged: DataFrame, k: int) -> DataFrame:
    """Rows of rank up to k of each query, or its first k rows if it has none; with their place ``i`` and ideal place ``j``.

    Rows without a query, rank or relevance don't count; rank and relevance may be text.
    """
    rows = judged.select("query", F.col("rank").cast("string").try_cast("double").cast("int").alias("rank"), F.col("relevance").cast("string").try_cast("double").cast("int").alias("rel")).where("query is not null and rank is not null and rel is not null")
    w = Window.partitionBy("query")
    rows = rows.withColumn("n", F.row_number().over(w.orderBy("rank", F.desc("rel")))).withColumn("within", F.count_if(F.col("rank") <= k).over(w))
    kept = rows.where((F.col("rank") <= k) | ((F.col("within") == 0) & (F.col("n") <= k)))
    return kept.withColumn("i", F.row_number().over(w.orderBy("n"))).withColumn("j", F.row_number().over(w.orderBy(F.desc("rel"), "n")))


def ir_metrics(judged: DataFrame, k: int = 5, threshold: int = 2) -> DataFrame:
    """ndcg, success, mrr, precision and considered rows of each query; the ideal order is that of the same rows."""
    rows = considered(judged, k)
    good = F.col("rel") >= threshold
    gain = lambda place: F.when(F.col(place) <= k, F.col("rel") / F.log2(F.col(place) + 1)).otherwise(0.0)
    top = F.col("i") <= k
    out = rows.groupBy("query").agg(F.sum(gain("i")).alias("dcg"), F.sum(gain("j")).alias("ideal"), F.count_if(good & top).alias("hits"), F.count_if(top).alias("shown"), F.min(F.when(good & top, F.col("i"))).alias("first"), F.count("*").alias("num_considered"))
    return out.select("query", F.round(F.when(F.col("ideal") > 0, F.col("dcg") / F.col("ideal")).otherwise(0.0), 6).alias("ndcg"), (F.col("hits") > 0).cast("double").alias("success"), F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("mrr"), F.round(F.col("hits") / F.col("shown"), 6).alias("precision"), "num_considered")


def ir_summary(judged: DataFrame, k: int = 5, threshold: int = 2) -> DataFrame:
    means = [F.coalesce(F.round(F.avg(c), 6), F.lit(0.0)).alias(c) for c in ("ndcg", "success", "mrr", "precision")]
    return ir_metrics(judged, k, threshold).agg(F.count("*").alias("num_queries"), *means)


def overlaps(chunks: DataFrame, keys: list[str], order: list[str], id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """Neighbouring chunks of a group and how much of the first one's words the second has."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = chunks.select(*keys, *[c for c in dict.fromkeys([*order, id_col]) if c not in keys], word_set(text_col).alias("_w"))
    pairs = rows.withColumn("next_id", F.lead(id_col).over(w)).withColumn("_v", F.lead("_w").over(w)).where("next_id is not null")
    return pairs.select(*keys, F.col(id_col).alias("id"), "next_id", F.round(containment(F.col("_w"), F.col("_v")), 6).alias("overlap"))


def overlap_summary(pairs: DataFrame, threshold: float = 0.1) -> DataFrame:
    """pairs, mean, median, share at or above the threshold and nearest-rank percentiles (ties of the rank to even)."""
    total = pairs.agg(F.count("*").alias("pairs"), F.round(F.avg("overlap"), 6).alias("mean"), F.round(F.percentile("overlap", F.lit(0.5)), 6).alias("median"), F.round(F.avg((F.col("overlap") >= threshold).cast("double")), 6).alias("share"))
    # distinct values have six decimals: at most a million and one rows are summed up in order
    values = pairs.groupBy("overlap").agg(F.count("*").alias("n"))
    upto = values.withColumn("upto", F.sum("n").over(Window.orderBy("overlap"))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ranks = [F.min(F.when(F.col("upto") > F.bround(p / 100 * (F.col("total") - 1)), F.col("overlap"))).alias(f"p{p}") for p in (10, 25, 75, 90)]
    return total.crossJoin(upto.agg(*ranks))  # two single rows


def extreme_pairs(pairs: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs of least and the n of most overlap."""
    low = pairs.orderBy("overlap", "id").limit(n).withColumn("end", F.lit("least"))
    return low.unionByName(pairs.orderBy(F.desc("overlap"), "id").limit(n).withColumn("end", F.lit("most")))
