"""Sinks: JSON lines, result CSV, partitioned tables and resumable output. Spark's commit protocol makes each write atomic."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.values import sanitize


def strict_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text with NaN and "nan" as null; infinite numbers and maps with keys other than strings are refused."""

    def check(kind: T.DataType) -> None:
        if isinstance(kind, T.MapType):
            if not isinstance(kind.keyType, T.StringType):
                raise TypeError("JSON keys must be strings")
            check(kind.valueType)
        elif isinstance(kind, T.ArrayType):
            check(kind.elementType)
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                check(f.dataType)

    check(df.schema)
    clean = df.select(*(sanitize(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
    return clean.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    strict_json(df).write.mode("overwrite" if overwrite else "errorifexists").text(path)


RESULT_COLUMNS = ["query", "rank", "entry_id", "score", "title", "snippet", "announced_date", "matched_chunk_ids"]


def result_rows(queries: DataFrame, results: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Rows of the result CSV: lists as JSON, scores with six decimals; a query without results gives rank 0 if ``keep_empty``.

    queries: query_id, query. results: query_id, rank and any of the other columns.
    """
    shown = []
    for f in results.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.format_string("%.6f", c)
        shown.append(c.alias(f.name))
    flat = results.select(*shown)
    joined = queries.select("query_id", "query").join(flat, "query_id", "left" if keep_empty else "inner")
    return joined.withColumn("rank", F.coalesce("rank", F.lit(0)))


def write_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", "true").option("escape", '"').csv(path)


def read_done(spark: SparkSession, path: str, id_col: str) -> DataFrame:
    """Ids that an earlier run has written."""
    from docloom.sources.tables import _exists

    return spark.read.parquet(path).select(id_col).distinct() if _exists(spark, path) else spark.createDataFrame([], f"{id_col} string")


def resume_write(df: DataFrame, path: str, id_col: str, fingerprint: dict) -> int:
    """Appends the rows whose id isn't written yet and gives their number.

    The fingerprint of the run's settings must equal that of the runs before, else nothing is written.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}.settings.json")
    fs = mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    settings = json.dumps(fingerprint, sort_keys=True)
    if fs.exists(mark):
        before = spark.read.text(str(mark.toString()), wholetext=True).first()[0]
        if json.loads(before) != json.loads(settings):
            raise ValueError("the settings differ from those of the earlier run")
    else:
        out = fs.create(mark, False)
        out.write(bytearray(settings.encode()))
        out.close()
    new = df.join(read_done(spark, path, id_col), id_col, "left_anti")
    written = new.count()
    if written:
        new.write.mode("append").parquet(path)
    return written
