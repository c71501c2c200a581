"""Vectors: validation, exact search by blocks, lists of near centroids, embedding."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of query vectors that go to every task at once.
BLOCK_BYTES = 32 << 20
#: Queries and vectors whose products are in memory at once.
QUERY_ROWS, VECTOR_ROWS = 512, 2048


def vector_errors(dims: int, vec: str = "embedding", id_col: str = "chunk_id") -> Column:
    """What is wrong with a vector row, or null."""
    v = F.col(vec)
    return (
        F.when(F.col(id_col).isNull(), "MISSING_ID")
        .when(v.isNull(), "MISSING_VECTOR")
        .when(F.size(v) != dims, "BAD_DIMENSION")
        .when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), "NOT_FINITE")
    )


def validate_shards(df: DataFrame, dims: int, manifest: DataFrame | None = None, shard: str = "shard_idx", vec: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    """One row a shard: rows, faulty rows by kind, ids that an earlier shard has, and the first error.

    manifest: shard_idx and count as they were written.
    """
    # the first shard of every id is aggregated and joined; null ids take no part
    firsts = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(shard).alias("_first"))
    rows = df.select(shard, id_col, vec).withColumn("error", vector_errors(dims, vec, id_col)).join(firsts.withColumnRenamed(id_col, "_id"), F.col(id_col) == F.col("_id"), "left").withColumn("again", F.col("_first").isNotNull() & (F.col(shard) > F.col("_first")))
    kinds = ["MISSING_ID", "MISSING_VECTOR", "BAD_DIMENSION", "NOT_FINITE"]
    out = rows.groupBy(shard).agg(F.count("*").alias("rows"), *(F.count_if(F.col("error") == k).alias(k.lower()) for k in kinds), F.count_if("again").alias("duplicate_id"))
    if manifest is not None:
        out = out.join(manifest.select(shard, F.col("count").alias("expected")), shard, "full_outer")
    else:
        out = out.withColumn("expected", F.col("rows"))
    first = F.when(F.col("rows").isNull(), "MISSING_SHARD").when(~F.col("rows").eqNullSafe(F.col("expected")), "COUNT_MISMATCH")
    for k in [*kinds, "DUPLICATE_ID"]:
        first = first.when(F.col(k.lower()) > 0, k)
    return out.withColumn("status", first.otherwise("OK"))


def usable_shards(report: DataFrame, skip: bool = True, shard: str = "shard_idx", empty: bool = False) -> DataFrame:
    """Shards that may be indexed, by a report of ``validate_shards``: those without a fault, and those whose repeated ids alone are at fault.

    With skip = False any other fault is an error; no shard left is one anyway, unless ``empty``. A report has a row a shard.
    """
    good = report.where(F.col("status").isin("OK", "DUPLICATE_ID")).select(shard)
    if not skip:
        bad = report.where(~F.col("status").isin("OK", "DUPLICATE_ID")).orderBy(shard).first()
        if bad is not None:
            raise ValueError(f"shard {bad[shard]}: {bad['status']}")
    if not empty and good.isEmpty():
        raise ValueError("no shard can be indexed")
    return good


def valid_vectors(df: DataFrame, dims: int, shard: str = "shard_idx", vec: str = "embedding", id_col: str = "chunk_id") -> DataFrame:
    """id and vector of every id once: the faultless vector of its first shard."""
    good = df.where(vector_errors(dims, vec, id_col).isNull())
    return good.groupBy(id_col).agg(F.min_by(vec, F.col(shard)).alias(vec))


def entry_hits(near: DataFrame, chunks: DataFrame, top_k: int = 10, depth: int = 100, retry: int = 5, allowed: DataFrame | None = None, entry: str = "entry_id") -> DataFrame:
    """Chunk hits of a dense search with the columns of their chunks, hit_rank counted among those that a filter leaves.

    near: query_id, chunk_id, score, rank down to ``retry * depth``. The first ``depth`` count; a query that has fewer than ``top_k`` entries
    among them is answered from ``retry`` times as many, once.
    """
    kept = near.join(allowed.select("chunk_id").distinct(), "chunk_id", "left_semi") if allowed is not None else near
    hits = kept.join(chunks, "chunk_id")
    enough = hits.where(F.col("rank") <= depth).groupBy("query_id").agg(F.count_distinct(entry).alias("_n")).where(F.col("_n") >= top_k).select("query_id", F.lit(True).alias("_enough"))
    seen = hits.join(enough, "query_id", "left").where((F.col("rank") <= depth) | (F.col("_enough").isNull() & (F.col("rank") <= retry * depth))).drop("_enough")
    return seen.withColumn("hit_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def coverage(vectors: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """chunks, indexed and their share in per cent, to two decimals."""
    have = vectors.select(id_col).distinct().withColumn("_v", F.lit(1))
    out = chunks.select(id_col).distinct().join(have, id_col, "left").agg(F.count("*").alias("chunks"), F.count("_v").alias("indexed"))
    return out.withColumn("coverage_pct", F.round(100 * F.col("indexed") / F.nullif("chunks", F.lit(0)), 2))


def metric_of(normalized: bool, stored: str | None = None) -> str:
    """The metric in the index's metadata, else the inner product for vectors of length 1, else L2."""
    return stored or ("ip" if normalized else "l2")


class _Top:
    """The k best of some queries over vectors that come in the order of their ids; ties go to the earlier."""

    def __init__(self, k: int):
        self.k, self.bound = k, None
        self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, s: np.ndarray, start: int) -> None:
        """s: scores of the queries (rows) with the vectors from place ``start`` on."""
        n = min(self.k, s.shape[1])
        bound = -np.partition(-s, n - 1, axis=1)[:, n - 1] if self.bound is None else self.bound
        bound = np.where(np.isnan(bound), -np.inf, bound)  # scores that are no numbers stay out, the others count
        a, b = np.nonzero(s >= bound[:, None])  # ties at the bound stay
        if not len(a):
            return
        q, place, score = (np.concatenate(x) for x in zip(self.rows, (a, b + start, s[a, b]), strict=True))
        order = np.lexsort((place, -score, q))
        q, place, score = q[order], place[order], score[order]
        starts = np.searchsorted(q, np.arange(len(s)))
        kept = np.arange(len(q)) - starts[q] < self.k
        self.rows = q, place, score = q[kept], place[kept], score[kept]
        counts = np.bincount(q, minlength=len(s))
        last = np.minimum(np.cumsum(counts) - 1, len(q) - 1)
        self.bound = np.where(counts == self.k, score[np.maximum(last, 0)], -np.inf)


def exact_search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", id_col: str = "chunk_id", vec: str = "embedding", query_vec: str = "embedding", decimals: int = 6) -> DataFrame:
    """query_id, id, score (larger is better, L2 as the negated squared distance) and rank of the k best of each query.

    Queries are sent to the tasks in blocks of ``BLOCK_BYTES``; each task multiplies its vectors with a block and
    passes on its k best a query. Vectors are read once a block and never shuffled. Ties go to the smaller id.
    """
    spark = vectors.sparkSession
    asked = queries.select("query_id", F.col(query_vec).cast("array<double>").alias("v")).where("v is not null")
    dims = vectors.where(F.col(vec).isNotNull()).select(F.size(vec)).first()
    kind = vectors.schema[id_col].dataType.simpleString()
    query_kind = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {query_kind}, {id_col} {kind}, score double"
    kinds = [to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(vectors.schema[id_col].dataType)]
    if dims is None:
        return spark.createDataFrame([], schema + ", rank int")
    rows = max(1, BLOCK_BYTES // (8 * dims[0]))
    parts: DataFrame | None = None
    block: list = []

    def searched(ids: list, matrix: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            ids: list[pa.Array] = []
            seen = 0
            tops = [_Top(k) for _ in range(0, len(q), QUERY_ROWS)]
            for whole in batches:
                for at in range(0, whole.num_rows, VECTOR_ROWS):
                    batch = whole.slice(at, VECTOR_ROWS)
                    keep = pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), q.shape[1]), False)
                    part = batch.filter(keep)
                    if not part.num_rows:
                        continue
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    for i, top in enumerate(tops):
                        p = q[i * QUERY_ROWS : (i + 1) * QUERY_ROWS]
                        s = p @ x.T if metric == "ip" else -((p**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * p @ x.T)
                        top.add(np.round(s, decimals) + 0.0, seen)
                    ids.append(part.column(0))
                    seen += part.num_rows
            if not seen:
                return
            known = pa.chunked_array(ids)
            for i, top in enumerate(tops):
                a, place, score = top.rows
                asked = pa.array([names[i * QUERY_ROWS + j] for j in a], kinds[0])
                yield pa.RecordBatch.from_arrays([asked, known.take(pa.array(place)).combine_chunks().cast(kinds[1]), pa.array(score)], names=["query_id", id_col, "score"])

        # by id, so that places stand in the order of ids
        return vectors.select(id_col, F.col(vec).cast("array<double>")).sortWithinPartitions(id_col).mapInArrow(run, schema)

    def add(found: list) -> None:
        nonlocal parts
        out = searched([r[0] for r in found], np.array([r[1] for r in found]))
        parts = out if parts is None else parts.unionByName(out)

    for r in asked.where(F.size("v") == dims[0]).toLocalIterator():
        block.append((r[0], r[1]))
        if len(block) == rows:
            add(block)
            block = []
    if block:
        add(block)
    if parts is None:
        return spark.createDataFrame([], schema + ", rank int")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return parts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def self_retrieval(vectors: DataFrame, sample: DataFrame, k: int, id_col: str = "chunk_id", vec: str = "embedding", metric: str = "ip") -> DataFrame:
    """Of each sampled vector the rank at which it finds itself within the first k, or null."""
    found = exact_search(vectors, sample.select(F.col(id_col).alias("query_id"), vec), k, metric, id_col, vec)
    own = found.where(F.col("query_id") == F.col(id_col)).select("query_id", F.col("rank").alias("own_rank"))
    return sample.select(F.col(id_col).alias("query_id")).join(own, "query_id", "left")


def centroids(vectors: DataFrame, label: str, vec: str = "embedding") -> DataFrame:
    """label, pos (from 0) and mean of each number of the vectors of a label."""
    return vectors.select(label, F.posexplode(vec).alias("pos", "x")).groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


class CentroidLists:
    """Vectors in lists by their nearest of some centroids; a search reads the lists of the nearest centroids only.

    The centroids are fitted on a sample of at most ``sample`` vectors, every vector is put into the lists of its
    ``places`` nearest, so that one near a border is found from both sides.
    """

    def __init__(self, vectors: DataFrame, lists: int, id_col: str = "chunk_id", vec: str = "embedding", sample: int = 20_000, rounds: int = 8, places: int = 2):
        rows = vectors.where(F.col(vec).isNotNull()).orderBy(F.xxhash64(id_col)).limit(sample).select(F.col(vec).cast("array<double>")).toPandas()
        x = np.stack(rows[rows.columns[0]].to_numpy())
        g = np.random.default_rng(0)
        c = x[g.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(rounds):
            near = (x @ c.T - (c**2).sum(1) / 2).argmax(1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            count = np.bincount(near, minlength=len(c))
            c = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], c)
        self.c, self.id_col, self.vec = c, id_col, vec
        self.assigned = vectors.where(F.col(vec).isNotNull()).withColumn("lists", self._nearest(places)(F.col(vec).cast("array<double>")))

    def _nearest(self, n: int):
        c = self.c

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy())
            return pd.Series(list(np.argsort(-(x @ c.T - (c**2).sum(1) / 2), axis=1)[:, :n].astype(np.int32)))

        return nearest

    def search(self, queries: DataFrame, k: int, probes: int, metric: str = "ip") -> DataFrame:
        """query_id, id, score, rank; queries: query_id and the vector column."""
        from docloom.functions.vectors import similarity

        visits = queries.select("query_id", F.col(self.vec).alias("q"), self._nearest(probes)(F.col(self.vec).cast("array<double>")).alias("visited"))
        visits = visits.withColumn("list", F.explode("visited"))
        stored = self.assigned.select("lists", self.id_col, self.vec).withColumn("list", F.explode("lists"))
        # a vector counts in the first of its lists that the query visits
        once = visits.join(stored, "list").where(F.element_at(F.filter("lists", lambda x: F.array_contains("visited", x)), 1) == F.col("list"))
        scored = once.select("query_id", self.id_col, F.round(similarity(F.col("q"), F.col(self.vec), metric), 6).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), self.id_col)
        return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class EmbedConfig:
    """Settings that decide a vector; a run may only be resumed, and a query only be embedded, with equal ones."""

    model: str = "hashing"
    dims: int = 64
    pooling: str = "mean"
    normalize: bool = True
    max_length: int = 256

    def fingerprint(self) -> dict:
        return asdict(self)


class Embedder:
    """Turns texts into vectors; subclass it to plug a model in, which is then loaded once a task.

    This default hashes all words: deterministic, without a model, good for tests and plumbing, not for meaning.
    ``max_length`` is for models, whose window it is.
    """

    def __init__(self, config: EmbedConfig = EmbedConfig()):  # noqa: B008
        self.config = config

    def load(self) -> None:
        pass

    def embed(self, texts: list[str]) -> np.ndarray:
        c = self.config
        out = np.zeros((len(texts), c.dims), np.float32)
        for row, text in zip(out, texts, strict=True):
            words = re.findall(r"\w+", (text.strip() or ".").lower()) or ["."]
            for w in words[:1] if c.pooling == "cls" else words:
                h = hashlib.blake2b(w.encode(), digest_size=8).digest()
                row[int.from_bytes(h[:4], "big") % c.dims] += 1 if h[4] & 1 else -1
            row /= max(1, len(words)) if c.pooling == "mean" else 1
        if c.normalize:
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)
        return out


def embed(df: DataFrame, embedder: Embedder, id_col: str = "chunk_id", text_col: str = "text", batch: int = 64) -> DataFrame:
    """id and embedding of each row with an id; a batch that is too large for the device is halved up to four times."""

    def halving(texts: list[str], depth: int = 0) -> np.ndarray:
        try:
            return embedder.embed(texts)
        except MemoryError:
            if depth == 4 or len(texts) < 2:
                raise
            half = len(texts) // 2
            return np.concatenate([halving(texts[:half], depth + 1), halving(texts[half:], depth + 1)])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        embedder.load()
        for texts in batches:
            rows = [v for at in range(0, len(texts), batch) for v in halving(list(texts.iloc[at : at + batch].fillna("")))]
            yield pd.Series(rows)

    vector = F.pandas_udf(run, T.ArrayType(T.FloatType()))
    return df.where(F.col(id_col).isNotNull()).select(id_col, vector(F.col(text_col)).alias("embedding"))
