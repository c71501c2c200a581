"""Most similar vectors by multiprobe p-stable hashing.

Every vector is scaled to length 1, so that Euclidean distance orders as the cosine does. A table hashes a vector by
``floor((a.x + b) / width)`` under several normal (2-stable) vectors a; its bucket is the tuple of these. A query
visits its own bucket and the buckets next to it in the estimated order of success: the single and joint
perturbations with the smallest sums of squared distances to the borders, in the order that is expected for uniform
borders. Candidates of all tables are merged and reranked by the exact cosine.

The number of hash functions follows the logarithm of the number of vectors, so that buckets stay small as
the collection grows; the number of tables follows that of the functions, so that a pair at the least cosine wanted
meets with a probability of ``MEET`` at any size (``tables_needed``). A bucket row holds a 128-bit sign sketch of its vector instead of the vector; pairs more
than SIGMAS standard deviations away from the least cosine wanted never get to the reranking (three pairs in ten million at
that cosine; the hashing itself misses one in a hundred).
Buckets above ``LARGE`` vectors (a topic that holds a third of all) go another, exact way: blocks of
the bucket's vectors are multiplied with blocks of its visitors and each visitor keeps its k best of a block.

Defined results: null vectors, vectors of another length, with null, NaN or infinite numbers or all zero and null
ids have no neighbours and are none; of a repeated id the valid vector of lowest ``order`` counts; equal vectors are one for the
search and share its result; ties go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.session import materialise

LARGE = 4000
SEED = 20_240_501
SIGMAS = 5
#: Least probability at which a pair at the least cosine wanted meets in some table, and the made pairs it is measured on.
MEET, PAIRS = 0.99, 4000


def probe_order(functions: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets as places in the sorted list of the 2 x functions border distances.

    Ordered by the expected sum of squares for uniform borders; a set never moves one function both ways.
    """
    m = functions
    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    j = np.arange(m + 1, 2 * m + 1)
    far = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    z = np.r_[near, far]
    out: list[tuple[int, ...]] = []
    heap = [(z[0], (0,))]
    while heap and len(out) < probes:
        total, chosen = heapq.heappop(heap)
        if all(2 * m - 1 - i not in chosen for i in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + z[last + 1], (*chosen, last + 1)))
    return out


class Tables:
    """Hash tables of p-stable functions; the same for every worker."""

    def __init__(self, dims: int, tables: int, functions: int, width: float, probes: int):
        g = np.random.default_rng(SEED)
        self.a = g.normal(size=(tables, dims, functions))
        self.b = g.random((tables, functions)) * width
        self.c = g.integers(1, 2**62, (tables, functions), dtype=np.int64) | 1
        self.start = g.integers(0, 2**62, tables, dtype=np.int64)
        self.width, self.order = width, probe_order(functions, probes)

    def keys(self, x: np.ndarray, probing: bool) -> np.ndarray:
        """(vectors, tables, 1 + probes): the own bucket first."""
        out = []
        with np.errstate(over="ignore"):
            for a, b, c, start in zip(self.a, self.b, self.c, self.start, strict=True):
                f = (x @ a + b) / self.width
                floor = np.floor(f)
                own = start + (floor.astype(np.int64) * c).sum(1)
                keys = [own]
                if probing:
                    borders = np.concatenate([f - floor, 1 - (f - floor)], 1)
                    step = np.concatenate([-c, c])[np.argsort(borders, 1)]
                    keys += [own + step[:, list(places)].sum(1) for places in self.order]
                out.append(np.stack(keys, 1))
        return np.stack(out, 1)


def tables_needed(dims: int, tables: int, functions: int, width: float, probes: int, least: float) -> int:
    """The number of tables, ``tables`` or more, at which a pair at cosine ``least`` meets with a probability of MEET.

    Both of a pair visit. Tables are independent, so the share of made pairs that meet is taken over single tables.
    """
    if least <= 0:
        return tables
    g = np.random.default_rng(SEED + 2)
    x, z = g.normal(size=(2, PAIRS, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
    y = least * x + math.sqrt(max(0.0, 1 - least * least)) * z
    hashed = Tables(dims, 8, functions, width, probes)
    of_x, of_y = hashed.keys(x, True), hashed.keys(y, True)
    met = ((of_x == of_y[:, :, :1]) | (of_y == of_x[:, :, :1])).any(2).mean()
    met = min(max(met, 1 / (8 * PAIRS)), 1 - 1e-9)
    # a tenth of the misses is left to the error of the estimate and to the sketch's filter
    return max(tables, math.ceil(math.log(0.9 * (1 - MEET)) / math.log1p(-met)))


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, order_col: str | None, dims: int) -> DataFrame:
    """doc, vec (hash of the unit vector, equal for equal ones), v (float32 bytes), f1 and f2 (sign sketch)."""
    good = f"doc is not null and size(x) = {dims} and not exists(x, e -> e is null or isnan(e) or abs(e) = double('infinity')) and exists(x, e -> e <> 0)"
    order = F.struct(F.col(order_col).isNull().alias("n"), F.col(order_col).alias("o"), F.col("x")) if order_col else F.col("x")
    rows = df.select(F.col(id_col).cast("string").alias("doc"), F.col(vec_col).cast("array<double>").alias("x"), *([order_col] if order_col and order_col not in ("doc", "x") else [])).where(good)
    rows = rows.groupBy("doc").agg(F.min_by("x", order).alias("x"))
    planes = np.random.default_rng(SEED + 1).normal(size=(dims, 128))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, dims)
            x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
            v = np.ascontiguousarray((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)) + np.float32(0)
            bits = np.packbits(v @ planes > 0, axis=1).view(np.int64)
            blobs = [r.tobytes() for r in v]
            vec = np.array([xxhash.xxh64_intdigest(r) for r in blobs], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec), pa.array(blobs, pa.binary()), pa.array(bits[:, 0]), pa.array(bits[:, 1])], names=["doc", "vec", "v", "f1", "f2"])

    return rows.mapInArrow(run, "doc string, vec long, v binary, f1 long, f2 long")


def _matrix(blobs, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float32).reshape(-1, dims)


def _entries(vectors: DataFrame, tables: Tables, dims: int, probing: bool) -> DataFrame:
    """key, probe (false: the vector stands there, true: it visits), vec, f1, f2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                keys = tables.keys(_matrix(batch.column(1).to_pylist(), dims).astype(np.float64), probing)
                n, t, p = keys.shape
                out = {"key": [keys[:, :, 0].ravel()], "probe": [np.zeros(n * t, bool)], "row": [np.repeat(np.arange(n), t)]}
                if probing:
                    out["key"].append(keys.ravel())
                    out["probe"].append(np.ones(n * t * p, bool))
                    out["row"].append(np.repeat(np.arange(n), t * p))
                row = np.concatenate(out["row"])
                cols = [np.concatenate(out["key"]), np.concatenate(out["probe"]), *(batch.column(i).to_numpy()[row] for i in (0, 2, 3))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "probe", "vec", "f1", "f2"])

    return vectors.select("vec", "v", "f1", "f2").mapInArrow(run, "key long, probe boolean, vec long, f1 long, f2 long")


def _meet(key: np.ndarray, probe: np.ndarray, vec: np.ndarray, f1: np.ndarray, f2: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """Pairs of standing and visiting vectors of the same key with at most ``most`` differing sketch bits.

    Rows are sorted by key, standing ones first.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    visiting = np.add.reduceat(probe.astype(np.int64), starts)
    standing = ends - starts - visiting
    use = (standing > 0) & (visiting > 0)
    starts, standing, visiting = starts[use], standing[use], visiting[use]
    combos = standing * visiting
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(np.cumsum(combos[at:]), 4_000_000, "right")) + at)
        n = combos[at:to]
        group = np.repeat(np.arange(at, to), n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i = starts[group] + place % standing[group]
        j = starts[group] + standing[group] + place // standing[group]
        differ = np.bitwise_count((f1[i] ^ f1[j]).view(np.uint64)).astype(np.int16) + np.bitwise_count((f2[i] ^ f2[j]).view(np.uint64))
        ok = (differ <= most) & (vec[i] != vec[j])
        x, y = vec[i[ok]], vec[j[ok]]
        if len(x):
            pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["a", "b"])
        at = to


def _cold_pairs(entries: DataFrame, most: int) -> DataFrame:
    names = ["key", "probe", "vec", "f1", "f2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if kept is not None:
                cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)]
            if not len(cols[0]):
                continue
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last bucket may go on
            if cut:
                yield from _meet(*(c[:cut] for c in cols), most)
            kept = [c[cut:] for c in cols]
        if kept is not None:
            yield from _meet(*kept, most)

    return entries.select(*names).repartition("key").sortWithinPartitions("key", "probe").mapInArrow(run, "a long, b long")


def _cosine(dims: int):
    @F.pandas_udf("double")
    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = _matrix(a, dims).astype(np.float64), _matrix(b, dims).astype(np.float64)
        return pd.Series(np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y)))

    return cosine


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, order_col: str | None = None, k: int = 10, least: float = 0.9, dims: int = 64, tables: int = 6, width: float = 2.2, probes: int = 12) -> DataFrame:
    """doc, neighbour, cosine and place (1 to k): the k most similar others of every id with a cosine of ``least`` or more.

    ``tables`` is the least number of tables; with more vectors, so more functions, there are as many as find 0.99 of
    the neighbours at a cosine of ``least``, and more above.
    """
    members = materialise(unit_vectors(df, id_col, vec_col, order_col, dims), "members")
    vectors = materialise(members.groupBy("vec").agg(F.first("v").alias("v"), F.first("f1").alias("f1"), F.first("f2").alias("f2")), "vectors")
    n = vectors.count()
    functions = max(6, round(3.3 * math.log10(max(n, 10))))
    hashed = Tables(dims, tables_needed(dims, tables, functions, width, probes, least), functions, width, probes)
    share = math.acos(least) / math.pi
    most = math.ceil(128 * share + SIGMAS * math.sqrt(128 * share * (1 - share)))
    counts = _entries(vectors, hashed, dims, False).groupBy("key").agg(F.count("*").alias("standing")).where(F.col("standing") > LARGE)
    hot = materialise(counts, "hot")
    entries = _entries(vectors, hashed, dims, True)
    pairs = _cold_pairs(entries.join(hot.select("key"), "key", "left_anti"), most)
    if not hot.isEmpty():
        busy = materialise(entries.join(hot.select("key"), "key", "left_semi"), "busy")
        sizes = busy.groupBy("key").agg(F.count_if(~F.col("probe")).alias("standing"), F.count_if(F.col("probe")).alias("visiting"))
        hot_pairs = _directed(busy, sizes, vectors.select("vec", "v"), dims, k + 1).where(F.col("cosine") >= least - 1e-6)
        pairs = pairs.unionByName(hot_pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    pairs = pairs.distinct()
    a, b = (vectors.select(F.col("vec").alias(x), F.col("v").alias(f"v{x}")) for x in "ab")
    close = pairs.join(a, "a").join(b, "b").select("a", "b", _cosine(dims)("va", "vb").alias("cosine")).where(F.col("cosine") >= least)
    close = materialise(close, "close")
    # k + 1 ids of a vector are enough for all lists it stands in
    few = members.select("vec", "doc").withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("doc"))).where(F.col("n") <= k + 1).select("vec", "doc")
    few = materialise(few, "few")
    directed = close.select(F.col("a").alias("of"), F.col("b").alias("vec"), "cosine").unionAll(close.select("b", "a", "cosine"))
    options = directed.join(few, "vec").select("of", F.col("doc").alias("neighbour"), "cosine").unionAll(few.select(F.col("vec").alias("of"), F.col("doc").alias("neighbour"), F.lit(1.0).alias("cosine")))
    best = Window.partitionBy("of").orderBy(F.desc("cosine"), "neighbour")
    lists = options.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    own = Window.partitionBy("doc").orderBy(F.desc("cosine"), "neighbour")
    return members.select("doc", F.col("vec").alias("of")).join(lists, "of").where("doc <> neighbour").select("doc", "neighbour", "cosine", F.row_number().over(own).alias("place")).where(F.col("place") <= k)


def search(df: DataFrame, queries: DataFrame, id_col: str, vec_col: str, order_col: str | None = None, k: int = 10, dims: int = 64, tables: int = 10, functions: int = 4, width: float = 1.2, probes: int = 32) -> DataFrame:
    """query, neighbour, cosine and place: the k most similar vectors of a stated set of queries, however far they are.

    For neighbours at no particular cosine few functions and many probes are needed; bucket visits then bring the
    vectors along, and each query keeps its k best of a block of a bucket. The defaults reach a recall above 0.9 where
    even the nearest of 64 dimensions are hardly nearer than the rest; meant for query sets much smaller than the collection.
    """
    members = materialise(unit_vectors(df, id_col, vec_col, order_col, dims), "members")
    vectors = materialise(members.groupBy("vec").agg(F.first("v").alias("v")), "vectors")
    hashed = Tables(dims, tables, functions, width, probes)
    asked = unit_vectors(queries, id_col, vec_col, order_col, dims).groupBy("vec").agg(F.first("v").alias("v"))
    zero = (F.lit(0).cast("long").alias("f1"), F.lit(0).cast("long").alias("f2"))
    standing = _entries(vectors.select("vec", "v", *zero), hashed, dims, False)
    visiting = materialise(_entries(asked.select("vec", "v", *zero), hashed, dims, True).where("probe"), "visits")
    visited = visiting.select("key").distinct()
    sizes = standing.join(visited, "key", "left_semi").groupBy("key").agg(F.count("*").alias("standing")).join(visiting.groupBy("key").agg(F.count("*").alias("visiting")), "key")
    sizes = materialise(sizes, "sizes")
    every = vectors.select("vec", "v").union(asked.select("vec", "v")).dropDuplicates(["vec"])
    rows = standing.join(visited, "key", "left_semi").unionByName(visiting)
    found = _directed(rows, sizes, every, dims, k)
    best = found.dropDuplicates(["a", "b"]).withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("n") <= 2 * k)
    few = members.select("vec", "doc").withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("doc"))).where(F.col("n") <= k + 1).select("vec", "doc")
    own = members.join(queries.select(F.col(id_col).cast("string").alias("doc")).distinct(), "doc", "left_semi").select(F.col("doc").alias("query"), F.col("vec").alias("a"))
    options = best.select("a", F.col("b").alias("vec"), "cosine").unionByName(own.select("a", F.col("a").alias("vec"), F.lit(1.0).alias("cosine")).distinct()).join(few, "vec").select("a", F.col("doc").alias("neighbour"), "cosine")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "neighbour"))
    return own.join(options, "a").where("query <> neighbour").select("query", "neighbour", "cosine", place.alias("place")).where(F.col("place") <= k)


def _directed(rows: DataFrame, sizes: DataFrame, vectors: DataFrame, dims: int, k: int) -> DataFrame:
    """a (the visitor), b and cosine: each visitor's k best of a block of a bucket."""
    blocks = sizes.select("key", F.ceil(F.col("standing") / LARGE).cast("int").alias("s"), F.ceil(F.col("visiting") / LARGE).cast("int").alias("q"))
    placed = rows.select("key", "probe", "vec").join(blocks, "key").join(vectors, "vec")
    own = lambda n: F.pmod(F.xxhash64("vec", F.lit(3)), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    standing = placed.where("not probe").withColumn("i", own("s")).withColumn("j", all_of("q"))
    visiting = placed.where("probe").withColumn("j", own("q")).withColumn("i", all_of("s"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        there, come = pdf[~pdf["probe"]], pdf[pdf["probe"]]
        if not len(there) or not len(come):
            return pd.DataFrame({"a": [], "b": [], "cosine": []})
        ids, names = there["vec"].to_numpy(), come["vec"].to_numpy()
        cosine = _matrix(come["v"], dims) @ _matrix(there["v"], dims).T
        cosine[names[:, None] == ids[None, :]] = -2
        n = min(k, len(ids))
        top = np.argpartition(-cosine, n - 1, axis=1)[:, :n]
        r = np.repeat(np.arange(len(names)), n)
        value = cosine[r, top.ravel()]
        good = value > -2
        return pd.DataFrame({"a": names[r[good]], "b": ids[top.ravel()[good]], "cosine": value[good].astype(float)})

    return standing.unionByName(visiting).select("key", "i", "j", "probe", "vec", "v").groupBy("key", "i", "j").applyInPandas(best, "a long, b long, cosine double")
