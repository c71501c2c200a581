"""Sources: parquet tables, JSON lines, text lists, manifests and vector shards."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def list_parts(spark: SparkSession, prefix: str) -> list[str]:
    """Parquet parts below a table's prefix, in order of their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(prefix)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    out, files = [], fs.listFiles(p, True)
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(".parquet"):
            out.append(name)
    return sorted(out)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None, max_parts: int | None = None) -> DataFrame:
    """All parts of a table with the wanted columns; columns and tables that are missing come as nulls and empty."""
    if not _exists(spark, path):
        if schema is None:
            schema = T.StructType([T.StructField(c, T.StringType()) for c in columns or []])
        return spark.createDataFrame([], schema)
    parts = list_parts(spark, path) if max_parts else []
    df = spark.read.option("recursiveFileLookup", "true").parquet(*(parts[:max_parts] or [path]))
    if columns:
        kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
        df = df.select(*(F.col(c) if c in df.columns else F.lit(None).cast(kinds.get(c, T.StringType())).alias(c) for c in columns))
    return df


def coerce_ids(df: DataFrame, *columns: str) -> DataFrame:
    """Ids of any kind as nullable BIGINT; what isn't a whole number becomes null."""
    for c in columns:
        n = F.col(c).cast("string").try_cast("double")
        df = df.withColumn(c, F.when(n == F.floor(n), n.try_cast("bigint")))
    return df


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good records, and the lines that aren't (type, line); blank lines are no records. strict: a bad line fails the query."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    if strict:
        return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"), lines.limit(0).select(F.lit("BAD_JSON_LINE").alias("type"), F.col("value").alias("line"))
    marked = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select("value", F.from_json("value", marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = parsed.where(f"r.{CORRUPT} is null").select("r.*").drop(CORRUPT)
    return good, parsed.where(f"r.{CORRUPT} is not null").select(F.lit("BAD_JSON_LINE").alias("type"), F.col("value").alias("line"))


def read_list(spark: SparkSession, path: str, lower: bool = False) -> DataFrame:
    """One item a line (``item``); blank lines and those that begin with # aren't items. A missing file is empty."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "item string")
    item = F.trim("value")
    rows = spark.read.text(path).select((F.lower(item) if lower else item).alias("item"))
    return rows.where("item <> '' and not startswith(item, '#')")


def read_stopwords(spark: SparkSession, path: str, limit: int = 100_000) -> list[str]:
    """Lower-case stopwords for ``filter_tokens``; a list above ``limit`` words is refused, for it becomes part of the plan."""
    words = [r.item for r in read_list(spark, path, lower=True).distinct().limit(limit + 1).collect()]
    if len(words) > limit:
        raise ValueError(f"more than {limit} stopwords")
    return sorted(words)


DESTINATIONS = ["dest_relpath", "local_path", "path", "dest", "relpath"]
SIZES = ["size", "content_length", "bytes"]


def normalize_manifest(df: DataFrame) -> DataFrame:
    """bucket, key, uri, dest, size of manifest rows in any of their spellings; rows without a source or destination are dropped."""
    have = set(df.columns)
    pick = lambda names: F.coalesce(*(F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in have), F.lit(None).cast("string"))
    uri = pick(["s3_uri", "uri", "url"])
    bucket = F.coalesce(pick(["s3_bucket", "bucket"]), F.nullif(F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 1), F.lit("")))
    key = F.coalesce(pick(["s3_key", "key"]), F.nullif(F.regexp_extract(uri, r"^s3://([^/]+)/(.+)$", 2), F.lit("")))
    out = df.select(bucket.alias("bucket"), key.alias("key"), pick(DESTINATIONS).alias("dest"), pick(SIZES).try_cast("long").alias("size"))
    return out.where("bucket is not null and key is not null and dest is not null").withColumn("uri", F.concat(F.lit("s3://"), "bucket", F.lit("/"), "key"))


def read_pages(spark: SparkSession, path: str, splitter: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, page_num and text of every page of the files below ``path``.

    The splitter turns a file's bytes into page texts; a PDF reader can be plugged in. The default
    takes UTF-8 text with a form feed at each page break. A file that can't be read gives one row with an error.
    """
    split = splitter or (lambda raw: raw.decode("utf-8").split("\f"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(name, i, text, None) for i, text in enumerate(split(raw), 1)]
                except Exception as e:  # one bad file must not end the job
                    rows.append((name, None, None, f"{type(e).__name__}: {e}"[:800]))
            yield pd.DataFrame(rows, columns=["path", "page_num", "text", "error"]).astype({"page_num": "Int32"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, page_num int, text string, error string")


def vector_shards(df: DataFrame, id_col: str = "chunk_id", vec_col: str = "embedding", shard_size: int = 1000) -> DataFrame:
    """Vectors with a shard number, ``shard_size`` to a shard, in the order of the ids.

    Places come from counts by hash-free id ranges: rows are sorted by range and each partition is shifted by the
    rows before it, so no task sees all rows.
    """
    from docloom.operators.ranking import number_rows

    numbered = number_rows(df.select(id_col, vec_col), [id_col], "row")
    return numbered.withColumn("shard_idx", F.floor(F.col("row") / shard_size).cast("int"))


def first_of_shards(df: DataFrame, id_col: str = "chunk_id", order: str = "shard_idx") -> DataFrame:
    """One row an id, the one of the first shard."""
    w = Window.partitionBy(id_col).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
