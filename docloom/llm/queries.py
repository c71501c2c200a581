"""The queries pN_... over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import mixing, near_duplicates, rank_fusion, reading_level, scan_repair, splitting, tokenizer, top_n, vector_neighbors


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = near_duplicates.similar_documents(_read(spark, sf, "chunk_records"), "chunk_id", "text", threshold=0.6, width=3)
    return pairs.select(F.col("doc_a").alias("chunk_id_a"), F.col("doc_b").alias("chunk_id_b"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.similar_classes(_read(spark, sf, "documents"), "doc_id", "text", threshold=0.8, width=5)


HIT_ORDER = [("score", "desc"), ("best_rank", "asc"), ("doc_id", "asc")]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.top_n(_read(spark, sf, "search_results"), ["query_id", "retriever"], HIT_ORDER, 5).select("query_id", "retriever", "doc_id")


def p2_top(spark: SparkSession, sf: str) -> DataFrame:
    return top_n.top_n(_read(spark, sf, "search_results"), ["query_id", "retriever"], HIT_ORDER, 5, carry=["entry_id", "chunk_id"]).drop("best_rank")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_texts(_read(spark, sf, "chunk_records"), "chunk_id", "text", "page_start", "page_end", limit=2000, overlap=200).withColumnRenamed("id", "chunk_id")


SCORES = {"bm25_score": 1.0, "faiss_score": 1.0, "rrf_score": 1.0}


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return rank_fusion.best(_read(spark, sf, "rrf_hits"), "query_id", "entry_id", SCORES)


def p4_ranking(spark: SparkSession, sf: str) -> DataFrame:
    return rank_fusion.fuse(_read(spark, sf, "rrf_hits"), "query_id", "entry_id", SCORES)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    near = vector_neighbors.similar_vectors(_read(spark, sf, "chunk_vectors"), "chunk_id", "embedding", "shard_idx", k=10, least=0.9)
    return near.select(F.least("doc", "neighbour").alias("chunk_id_a"), F.greatest("doc", "neighbour").alias("chunk_id_b")).distinct()


def p5_neighbors(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of the stated query set: chunks whose hashed id is divisible by 50."""
    vectors = _read(spark, sf, "chunk_vectors")
    asked = vectors.where(F.pmod(F.xxhash64("chunk_id"), F.lit(50)) == 0)
    return vector_neighbors.search(vectors, asked, "chunk_id", "embedding", "shard_idx", k=10)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_repair.scan_lines(_read(spark, sf, "page_records"))


def p6_text(spark: SparkSession, sf: str) -> DataFrame:
    return scan_repair.scan_pages(_read(spark, sf, "page_records")).select("stable_id", "page_num", "repaired")


VOCABULARY = tokenizer.DEFAULT


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode(_read(spark, sf, "documents"), "doc_id", "text", VOCABULARY)


def p7_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.count_tokens(_read(spark, sf, "documents"), ["doc_id", "source"], "text", VOCABULARY)


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"), vocabulary=VOCABULARY)[0]


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_read(spark, sf, "documents"), _read(spark, sf, "mix_targets"), vocabulary=VOCABULARY)[1]


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_levels(spark, sf).where("band = 5").select("doc_id")


def p9_levels(spark: SparkSession, sf: str) -> DataFrame:
    return reading_level.reading_levels(_read(spark, sf, "documents"), _read(spark, sf, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit()}


def _normal_sql(p: str) -> str:
    """The inverse normal distribution as in ``rank_fusion``."""

    def poly(coefficients: tuple[float, ...], x: str) -> str:
        out = repr(coefficients[0])
        for c in coefficients[1:]:
            out = f"(({out}) * {x} + {c!r})"
        return out

    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    outer = f"{poly(rank_fusion.C, tail)} / {poly(rank_fusion.D, tail)}"
    return f"case when abs({q}) <= 0.47575 then {q} * {poly(rank_fusion.A, r)} / {poly(rank_fusion.B, r)} when {q} < 0 then {outer} else -({outer}) end"


_WORDS = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_SHINGLES = f"(select chunk_id, count(*) over (partition by chunk_id) as n, s from (select distinct chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) as s from (select distinct chunk_id, {_WORDS} as w from chunk_records where chunk_id is not null) where len(w) >= 3))"
_BLANK = r"'^[ \t\r\n\f]+|[ \t\r\n\f]+$'"
_TOP = "select *, row_number() over (partition by query_id, retriever order by score desc, best_rank nulls last, doc_id)::int as place from (select query_id, retriever, doc_id, score + 0.0 as score, best_rank, min(entry_id) as entry_id, min(chunk_id) as chunk_id from search_results where score is not null and not isnan(score) group by all)"
_ITEMS = "select query_id, entry_id, " + ", ".join(f"max(case when not isnan({c}) then {c} end) as {c}" for c in SCORES) + " from rrf_hits where query_id is not null and entry_id is not null group by query_id, entry_id"
_FUSED = f"""with items as ({_ITEMS}),
long as (select query_id, entry_id, unnest(['{"', '".join(SCORES)}']) as kind, unnest([{", ".join(SCORES)}]) as v from items),
ranks as (select *, rank() over (partition by query_id, kind order by v nulls first) + (count(*) over (partition by query_id, kind, v) - 1) / 2.0 as r, count(*) over (partition by query_id, kind) as n from long),
p as (select query_id, entry_id, (r - 0.5::double) / n as p from ranks),
fused as (select query_id, entry_id, round(sum({_normal_sql("p")}) / {float(len(SCORES))}, 9) as fused from p group by query_id, entry_id)"""
_VECTORS = "(select chunk_id, v from (select chunk_id, embedding::double[] as v, row_number() over (partition by chunk_id order by shard_idx) as r from chunk_vectors where chunk_id is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0) where r = 1)"


def oracle_sql() -> dict[str, str]:
    """Exact twins; p5_found's is a brute force, which the hashing equals at its recall."""
    return {
        "p1_found": f"with g as {_SHINGLES} select a.chunk_id as chunk_id_a, b.chunk_id as chunk_id_b from g a join g b on a.s = b.s and a.chunk_id < b.chunk_id group by a.chunk_id, b.chunk_id having count(*) >= 0.6 * (any_value(a.n) + any_value(b.n) - count(*))",
        "p2_found": f"select query_id, retriever, doc_id from ({_TOP}) where place <= 5",
        "p2_top": f"select * exclude (best_rank) from ({_TOP}) where place <= 5",
        "p3_found": f"select distinct chunk_id from chunk_records where chunk_id is not null and length(regexp_replace(text, {_BLANK}, '', 'g')) > 2000",
        "p4_found": f"{_FUSED} select query_id, min_by(entry_id, [(-fused)::varchar, entry_id]) as entry_id from (select *, max(fused) over (partition by query_id) as top from fused) where fused = top group by query_id",
        "p4_ranking": f"{_FUSED} select query_id, entry_id, fused, rank() over (partition by query_id order by fused desc) as place from fused",
        "p5_found": f"with u as {_VECTORS} select distinct least(a, b) as chunk_id_a, greatest(a, b) as chunk_id_b from (select *, row_number() over (partition by a order by round(c, 6) desc, b) as r from (select x.chunk_id as a, y.chunk_id as b, list_cosine_similarity(x.v, y.v) as c from u x join u y on x.chunk_id <> y.chunk_id)) where r <= 10 and c >= 0.9",
    }
