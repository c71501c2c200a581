"""Row numbers, runs, samples and first values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number_rows(df: DataFrame, order: list[str], name: str = "row") -> DataFrame:
    """Numbers from 0 in the order of ``order``, without one task that sorts everything.

    Rows are partitioned by ranges of the order; each partition numbers its own and is shifted by
    the sizes of those before it. Ties of the whole order are numbered in an unspecified way.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    # the number within a partition: the id is unique by partition and row, and grows by one within a partition
    placed = ranged.withColumn("_i", F.monotonically_increasing_id())
    from docloom.session import materialise

    placed = materialise(placed, "numbered")
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_first"))
    shifts = sizes.withColumn("_shift", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).select("_p", "_first", F.coalesce("_shift", F.lit(0)).alias("_shift"))
    # a row a partition: its number is that of the tasks, not of the rows
    return placed.join(F.broadcast(shifts), "_p").withColumn(name, (F.col("_i") - F.col("_first") + F.col("_shift")).cast("long")).drop("_p", "_i", "_first", "_shift")


def first_appearance(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """Each key once, numbered from 1 in the order in which keys first appear."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    placed = number_rows(first.select(*keys, *(F.col(f"_first.{o}").alias(f"_o{i}") for i, o in enumerate(order))), [f"_o{i}" for i in range(len(order))] + keys, name)
    return placed.select(*keys, (F.col(name) + 1).alias(name))


def first_rows(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of every key in the order given: a stable ``dropDuplicates``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of every key with their rank; Spark limits each partition to k rows a key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def first_values(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """For each column its first value that isn't null, in ascending order with nulls first; aggregated before the shuffle."""
    place = F.struct(*order)
    return df.groupBy(*keys).agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Number of the run of equal values that a row stands in, from 1, within its keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    return df.withColumn("_c", changed.cast("int")).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_c")


def first_islands(df: DataFrame, order: list[str], key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the first run of every key over the input's order, and those of keys that come again later.

    A row belongs to a later run if another key stands between it and the key's first run: then more rows lie
    between its place and the key's first than the key has had.
    """
    numbered = number_rows(df, order, "_row")
    within = Window.partitionBy(*key).orderBy("_row")
    # the place of a row in the input less its place in its key is constant within a run and grows with every gap
    marked = numbered.withColumn("_gap", F.col("_row") - F.row_number().over(within)).withColumn("_first", F.min("_gap").over(Window.partitionBy(*key)))
    good = marked.where("_gap = _first").drop("_row", "_gap", "_first")
    return good, marked.where("_gap > _first").drop("_row", "_gap", "_first")


def round_robin_sample(df: DataFrame, buckets: list[Column], key: str, n: int, seed: str = "7") -> DataFrame:
    """n rows, taken in turn from buckets; buckets and their rows are in an order that the seed decides."""
    bucket = F.concat_ws(" | ", *buckets)
    rows = df.withColumn("bucket", bucket)
    inner = Window.partitionBy("bucket").orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), F.col(key))
    turned = rows.withColumn("turn", F.row_number().over(inner)).where(F.col("turn") <= n)
    return turned.orderBy("turn", F.md5(F.concat_ws("|", "bucket", F.lit(seed))), "bucket").limit(n)


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """n rows in the order of a hash of the key: the same ones at every run."""
    return df.orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed))), key).limit(n)
