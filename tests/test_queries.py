"""Every query with SQL against DuckDB over the smallest tables, where these are."""

import os

import numpy as np
import pytest

from docloom.operators import bm25
from docloom.plans import catalog

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(x):
    if x is None or isinstance(x, float) and x != x or str(x) == "<NA>":
        return None
    if isinstance(x, list | tuple | np.ndarray):
        return [plain(y) for y in x]
    return round(float(x), 6) if isinstance(x, int | float | np.integer | np.floating) and not isinstance(x, bool) else x


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, tables, name):
    got = catalog.queries()[name](spark, SF).toPandas()
    want = tables.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda df: sorted(str([plain(v) for v in r]) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert catalog.flagship.__doc__


def test_first_nonnull_sees_every_attachment(spark, tmp_path):
    rows = [(1, "a", 1, None, None), (1, "a", 2, None, "rule"), (1, "b", 1, "Title", "memo"), (2, "c", 1, None, None)]
    spark.createDataFrame(rows, "page_ptr_id long, stable_id string, page_num int, file_title string, document_type string").write.parquet(f"{tmp_path}/page_records.parquet")
    got = {tuple(r) for r in catalog.queries()["first_nonnull"](spark, str(tmp_path)).collect()}
    assert got == {(1, "Title", "rule"), (2, None, None)}


def test_normalize_text_has_every_document(spark, tmp_path):
    space = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"
    rows = [(i, f"{c}a{c}{c}b-\nc{c}") for i, c in enumerate(space)] + [(len(space), None), (len(space) + 1, f"x{space}y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in catalog.queries()["normalize_text"](spark, str(tmp_path)).collect()}
    assert got == {i: "a bc" for i in range(len(space))} | {len(space): "", len(space) + 1: "x y"}


def test_shard_policy_without_a_usable_shard(spark, tmp_path):
    rows = [(s, f"c{s}-{i}", [0.5] * (64 if i else 3)) for s in range(3) for i in range(4)]  # a fault in every shard
    spark.createDataFrame(rows, "shard_idx int, chunk_id string, embedding array<float>").write.parquet(f"{tmp_path}/chunk_vectors.parquet")
    assert catalog.queries()["shard_policy"](spark, str(tmp_path)).collect() == []


def test_query_file_counts_more_words_than_a_plan_holds(spark, tmp_path):
    many = spark.range(100_003).selectExpr("id as query_id", "case when id = 0 then null when id % 2 = 0 then concat('Word ', id) else concat(' word ', id) end as query")
    many.unionByName(many.where("query_id = 1").selectExpr("-1L as query_id", "upper(query) as query")).write.parquet(f"{tmp_path}/search_queries.parquet")
    assert [tuple(r) for r in catalog.queries()["query_file"](spark, str(tmp_path)).collect()] == [(100_003, 100_002)]


@pytest.mark.parametrize("name", ["bm25_entries", "bm25_entries_by_date", "bm25_stored", "bm25_filtered_post"])
def test_searches_make_no_row_a_pair(spark, tables, monkeypatch, name):
    def no_pairs(*_):
        raise AssertionError("queries are joined to postings")

    monkeypatch.setattr(bm25, "score", no_pairs)
    assert len(catalog.queries()[name](spark, SF).collect()) == tables.execute(f"select count(*) from ({catalog.oracle_sql()[name]})").fetchone()[0]
