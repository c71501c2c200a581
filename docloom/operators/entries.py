"""Entry-level results: hits of chunks rolled up, fusion of lists, rerank and cut-off."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.text import shorten, source_label
from docloom.functions.values import date_to_int

HIT = ["chunk_id", "doc_id", "attachment_id", "source_type", "text", "announced_date"]


def roll_up(hits: DataFrame, top_k: int | None = 10, by_date: bool = False) -> DataFrame:
    """Entry results of chunk hits: query_id, entry_id, score, hit_rank, HIT columns.

    The best hit of an entry is that of the highest score, then latest date, then lowest rank. Its score and rank
    count; shown is the best PDF hit (else summary) where the best hit is a title. Lists are in the order of the hits.
    """
    hits = hits.withColumn("date", date_to_int("announced_date"))
    order = F.struct((-F.col("score")).alias("s"), (-F.col("date")).alias("d"), F.col("hit_rank").alias("r"))
    hit = F.struct("date", *HIT, "score", "hit_rank")

    def best(kind: str | None) -> Column:
        return F.min_by(hit, order if kind is None else F.when(F.col("source_type") == kind, order))

    ordered = lambda c: F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col(c).cast("string").alias("x")))), lambda x: x["x"]), lambda x: x.isNotNull() & (x != "")))
    entries = hits.where("entry_id is not null").groupBy("query_id", "entry_id").agg(
        best(None).alias("top"),
        best("pdf_page").alias("pdf"),
        best("policy_summary").alias("summary"),
        F.count("*").alias("matched_count"),
        ordered("chunk_id").alias("matched_chunk_ids"),
        ordered("doc_id").alias("matched_doc_ids"),
        ordered("attachment_id").alias("matched_attachment_ids"),
    )
    shown = F.when(F.col("top.source_type") == "policy_title", F.coalesce("pdf", "summary", "top")).otherwise(F.col("top"))
    out = entries.withColumn("shown", shown).select(
        "query_id", "entry_id", F.col("top.score").alias("score"), F.col("top.hit_rank").alias("best_rank"), F.col("top.date").alias("best_date"),
        source_label("top.source_type").alias("source"), F.col("shown.chunk_id").alias("chunk_id"), F.col("shown.doc_id").cast("string").alias("doc_id"), F.col("shown.attachment_id").alias("attachment_id"),
        F.col("shown.announced_date").alias("announced_date"), shorten("shown.text", 220).alias("snippet"),
        F.when(F.col("pdf").isNotNull(), F.struct(shorten("pdf.text", 75).alias("text"), F.col("pdf.chunk_id").alias("chunk_id"), F.col("pdf.attachment_id").alias("document_id"))).alias("relevant_chunk"),
        "matched_count", "matched_chunk_ids", "matched_doc_ids", "matched_attachment_ids",
    )
    return order_entries(out, top_k, by_date)


def order_entries(entries: DataFrame, top_k: int | None, by_date: bool = False) -> DataFrame:
    """Entries with their rank: by score, date, rank; or by announced date first."""
    first = [F.desc(date_to_int("announced_date")), F.desc("score"), "best_rank"] if by_date else [F.desc("score"), F.desc("best_date"), "best_rank"]
    ranked = entries.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*first, "entry_id")))
    return ranked.where(F.col("rank") <= top_k) if top_k else ranked


def titles_and_summaries(chunks: DataFrame, entry: str = "page_ptr_id") -> DataFrame:
    """entry_id, title and summary of each entry: the first title, the first paragraph of the summary."""
    place = F.struct(F.coalesce(F.regexp_extract("chunk_id", r"_sum_par(\d+)_", 1).try_cast("int"), F.lit(0)), F.col("chunk_id"))
    kind = lambda k: F.min_by("text", F.when((F.col("source_type") == k) & F.col("text").isNotNull(), place))
    return chunks.groupBy(F.col(entry).alias("entry_id")).agg(F.coalesce(kind("policy_title"), F.lit("")).alias("title"), F.coalesce(kind("policy_summary"), F.lit("")).alias("summary"))


def with_titles(results: DataFrame, titles: DataFrame) -> DataFrame:
    """Results with the title and summary of their entry, empty where there is none."""
    known = titles.select("entry_id", F.col("title").alias("_title"), F.col("summary").alias("_summary"))
    joined = results.join(known, "entry_id", "left")
    return joined.withColumn("title", F.coalesce("_title", F.lit(""))).withColumn("summary", F.coalesce("_summary", F.lit(""))).drop("_title", "_summary")


def fuse(lists: dict[str, DataFrame], rrf_k: int = 60, final_k: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked entry lists by source name; the first list's display fields win.

    Each list: query_id, entry_id, rank, score and, where it has them, chunk_id, doc_id, attachment_id, snippet,
    announced_date, matched_chunk_ids, best_rank.
    """
    texts, arrays = ["chunk_id", "doc_id", "attachment_id", "snippet", "announced_date"], ["matched_chunk_ids", "matched_doc_ids", "matched_attachment_ids"]
    rows = None
    for place, (source, df) in enumerate(lists.items()):
        have = set(df.columns)
        cols = [F.col("query_id"), F.col("entry_id").cast("string").alias("entry_id"), F.lit(source).alias("source"), F.lit(place).alias("place"), F.col("rank"), F.col("score").cast("double").alias("score")]
        cols += [(F.col(c).cast("string") if c in have else F.lit(None).cast("string")).alias(c) for c in texts]
        cols += [(F.col(c) if c in have else F.lit(None)).cast("array<string>").alias(c) for c in arrays]
        part = df.select(*cols, (F.col("best_rank") if "best_rank" in have else F.lit(None)).cast("int").alias("best_rank"))
        rows = part if rows is None else rows.unionByName(part)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.struct("place", "rank"))).alias(c)
    union = lambda c: F.filter(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "rank", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda x: x["x"]))), lambda x: x.isNotNull() & (x != "")).alias(c)
    of = lambda s: F.col("source") == s
    aggregates = [F.sum(1.0 / (rrf_k + F.col("rank"))).alias("rrf_score"), F.array_sort(F.collect_set("source")).alias("sources")]
    for s in lists:
        aggregates += [F.min(F.when(of(s), F.col("rank"))).alias(f"{s}_rank"), F.min_by("score", F.when(of(s), F.col("rank"))).alias(f"{s}_score"), F.min(F.when(of(s) & (F.col("best_rank") > 0), F.col("best_rank"))).alias(f"{s}_best_rank")]
    fused = rows.where("entry_id is not null and entry_id <> ''").groupBy("query_id", "entry_id").agg(*aggregates, *map(first, texts), *map(union, arrays))
    fused = fused.withColumn("rrf_score", F.round("rrf_score", 12)).withColumn("matched_count", F.size("matched_chunk_ids"))
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), "entry_id")))
    return ranked.where(F.col("rank") <= final_k) if final_k else ranked


class PairScorer:
    """Scores pairs of query and text in batches; subclass it to plug a model in, which is then loaded once a task.

    This default is a stand-in without a model: the share of the query's words that the text has, on a log-odds scale.
    """

    def score(self, queries: list[str], texts: list[str]) -> list[float]:
        import math
        import re

        out = []
        for q, t in zip(queries, texts, strict=True):
            words = set(re.findall("[a-z0-9]{2,}", (q or "").lower()))
            have = len(words & set(re.findall("[a-z0-9]{2,}", (t or "").lower())))
            p = (have + 0.5) / (len(words) + 1)
            out.append(math.log(p / (1 - p)))
        return out


def pair_scores(scorer: PairScorer):
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in batches:
            yield pd.Series(scorer.score(list(q), list(t)), dtype="float64")

    return run


def rerank(fused: DataFrame, queries: DataFrame, texts: DataFrame, scorer: PairScorer | None = None, depth: int = 50, max_chars: int = 2000, by_date: bool = False) -> DataFrame:
    """The first ``depth`` results of each query in the order of the pair scores, the others after them.

    texts: chunk_id, text; a result without one is scored by its snippet. A given scorer sees
    ``max_chars`` of a text, the stand-in all of it. by_date orders the head by date and drops the tail.
    """
    head = F.col("rank") <= depth
    pairs = fused.join(queries.select("query_id", "query"), "query_id").join(texts.select("chunk_id", "text"), "chunk_id", "left")
    text = F.coalesce(F.nullif("text", F.lit("")), "snippet", F.lit(""))
    if scorer is not None:
        text = shorten(text, max_chars)
    scored = pairs.where(head).withColumn("ce_score", F.round(pair_scores(scorer or PairScorer())("query", text), 9)).drop("query", "text")
    keys = [F.desc(date_to_int("announced_date"))] if by_date else []
    w = Window.partitionBy("query_id").orderBy(*keys, F.desc("ce_score"), F.desc("rrf_score"), "entry_id")
    top = scored.withColumn("rank", F.row_number().over(w))
    if by_date:
        return top
    return top.unionByName(fused.where(~head).withColumn("ce_score", F.lit(None).cast("double")), allowMissingColumns=True)


def _scored(df: DataFrame, score: str) -> tuple[DataFrame, Window]:
    w = Window.partitionBy("query_id").orderBy("rank")
    return df.where(F.col(score).isNotNull()).withColumn("_i", F.row_number().over(w)), Window.partitionBy("query_id").orderBy("_i")


def _cut(df: DataFrame, clean: Column, cap: int, min_return: int) -> DataFrame:
    """Rows up to the clean prefix, or the forced minimum, or the cap."""
    everyone = Window.partitionBy("query_id")
    n = F.sum(clean.cast("int")).over(everyone)
    m = F.count("*").over(everyone)
    kept = F.least(F.when(n < min_return, F.greatest(n, F.least(F.lit(min_return), F.lit(cap), m))).otherwise(n), F.lit(cap))
    return df.withColumn("_k", kept).where("_i <= _k").drop("_i", "_k")


def confidence_band(df: DataFrame, score: str = "ce_score", a_tail: float = -3.5, delta: float = 4.5, cap: int = 20, min_return: int = 3) -> DataFrame:
    """The prefix of each query's results within ``delta`` of the first score and above ``a_tail``."""
    rows, w = _scored(df, score)
    passes = (F.col(score) >= F.first(score).over(w) - delta) & (F.col(score) >= a_tail)
    rows = rows.withColumn("_ok", passes.cast("int")).withColumn("_ok", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _cut(rows, F.col("_ok") == 1, cap, min_return).drop("_ok")


def change_point(df: DataFrame, score: str = "ce_score", a_tail: float = -2.5, penalty: float = 5.0, cap: int = 20, min_return: int = 3) -> DataFrame:
    """The prefix up to the largest drop: mean above less mean below less penalty / k is greatest at k, the smallest such k."""
    rows, w = _scored(df, score)
    everyone = Window.partitionBy("query_id")
    above = F.avg(score).over(w.rowsBetween(Window.unboundedPreceding, 0))
    below = F.avg(score).over(w.rowsBetween(1, Window.unboundedFollowing))
    limit = F.least(F.lit(cap), F.count("*").over(everyone) - 1)
    separation = F.when(F.col("_i") <= limit, F.round(above - below - F.lit(float(penalty)) / F.col("_i"), 9))
    rows = rows.withColumn("_s", separation)
    star = F.coalesce(F.max_by(-F.col("_i"), F.when(F.col("_s").isNotNull(), F.struct("_s", -F.col("_i")))).over(everyone), F.lit(-1))
    passes = (F.col("_i") <= -star) & (F.col(score) >= a_tail)
    rows = rows.withColumn("_ok", passes.cast("int")).withColumn("_ok", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return _cut(rows, F.col("_ok") == 1, cap, min_return).drop("_ok", "_s")
