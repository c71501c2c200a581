import json

import pytest
from pyspark.sql import types as T

from docloom.operators import dense
from docloom.sources import sinks, tables
from docloom.streaming import ingest

SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a":1,"b":"x"}\n\n{bad\n{"a":2}\n')
    good, bad = tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA)
    assert sorted((r.a, r.b) for r in good.collect() if r.a) == [(1, "x"), (2, None)] and [r.line for r in bad.collect()] == ["{bad"]
    with pytest.raises(Exception, match="(?i)malformed"):
        tables.read_jsonl(spark, str(tmp_path / "x.jsonl"), SCHEMA, strict=True)[0].collect()


def test_tables(spark, tmp_path):
    spark.createDataFrame([(1, "x")], SCHEMA).repartition(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(2, "y")], SCHEMA).repartition(1).write.mode("append").parquet(str(tmp_path / "t"))
    assert len(tables.list_parts(spark, str(tmp_path / "t"))) == 2
    assert tables.read_table(spark, str(tmp_path / "t"), max_parts=1).count() == 1
    df = tables.read_table(spark, str(tmp_path / "t"), ["a", "missing"])
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, None)]
    empty = tables.read_table(spark, str(tmp_path / "none"), ["a"])
    assert empty.columns == ["a"] and empty.count() == 0
    ids = tables.coerce_ids(spark.createDataFrame([("1",), ("2.0",), ("x",), ("1.5",), (None,)], "i string"), "i")
    assert [r.i for r in ids.collect()] == [1, 2, None, None, None]


def test_lists(spark, tmp_path):
    (tmp_path / "s.txt").write_text("# words\nThe\n\n a \n")
    assert tables.read_stopwords(spark, str(tmp_path / "s.txt")) == ["a", "the"]
    assert [r.item for r in tables.read_list(spark, str(tmp_path / "s.txt")).collect()] == ["The", "a"]
    assert tables.read_stopwords(spark, str(tmp_path / "none.txt")) == []


def test_manifest(spark):
    df = spark.createDataFrame([("s3://b/k.pdf", None, "d1", "10"), (None, "k2", None, "x"), ("s3://b/k3", None, " ", None)], "s3_uri string, key string, local_path string, bytes string")
    assert [tuple(r) for r in tables.normalize_manifest(df).collect()] == [("b", "k.pdf", "d1", 10, "s3://b/k.pdf")]


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe\xfa")
    got = {(r.path.rsplit("/", 1)[1], r.page_num, r.text, r.error is not None) for r in tables.read_pages(spark, str(tmp_path)).collect()}
    assert got == {("a.txt", 1, "one", False), ("a.txt", 2, "two", False), ("b.txt", None, None, True)}


def test_shards(spark):
    df = spark.createDataFrame([(f"c{i:02d}", [float(i)]) for i in range(25)], "chunk_id string, embedding array<float>").repartition(4)
    assert sorted((r.shard_idx, r.chunk_id) for r in tables.vector_shards(df, shard_size=10).collect()) == [(i // 10, f"c{i:02d}") for i in range(25)]


def test_strict_json(spark, tmp_path):
    df = spark.createDataFrame([(float("nan"), "nan", {"k": "v"})], "x double, s string, m map<string,string>")
    assert json.loads(sinks.strict_json(df).first().value) == {"x": None, "s": None, "m": {"k": "v"}}
    with pytest.raises(TypeError):
        sinks.strict_json(spark.createDataFrame([({1: "v"},)], "m map<int,string>"))
    sinks.write_jsonl(df, str(tmp_path / "o"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_jsonl(df, str(tmp_path / "o"))
    sinks.write_jsonl(df, str(tmp_path / "o"), overwrite=True)


def test_result_rows(spark, tmp_path):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, query string")
    r = spark.createDataFrame([(1, 1, "e", 0.5, ["x", "y"])], "query_id int, rank int, entry_id string, score double, ids array<string>")
    got = {x.query_id: (x["rank"], x.score, x.ids) for x in sinks.result_rows(q, r).collect()}
    assert got == {1: (1, "0.500000", '["x","y"]'), 2: (0, None, None)}
    assert sinks.result_rows(q, r, keep_empty=False).count() == 1


def test_resume(spark, tmp_path):
    out = str(tmp_path / "run")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    settings = dense.EmbedConfig().fingerprint()
    assert sinks.resume_write(df, out, "id", settings) == 2
    more = spark.createDataFrame([("b", 9), ("c", 3)], "id string, v int")
    assert sinks.resume_write(more, out, "id", settings) == 1
    assert sorted((r.id, r.v) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 2), ("c", 3)]
    with pytest.raises(ValueError, match="settings"):
        sinks.resume_write(more, out, "id", settings | {"dims": 3})


def test_stream_goes_on_where_it_ended(spark, tmp_path):
    src = str(tmp_path / "in")
    kind = "chunk_id string, ingested_at timestamp"
    spark.sql("select 'a' chunk_id, timestamp'2025-01-01 00:00:00' ingested_at union all select 'a', timestamp'2025-01-01 00:01:00'").write.parquet(src)
    schema = T._parse_datatype_string(kind)

    def run():
        ingest.ingest(ingest.first_arrivals(ingest.stream_table(spark, src, schema)), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted(r.chunk_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a"]
    spark.sql("select 'b' chunk_id, timestamp'2025-01-01 00:02:00' ingested_at union all select 'a', timestamp'2025-01-01 00:03:00'").write.mode("append").parquet(src)
    assert run() == ["a", "b"]
