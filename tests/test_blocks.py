"""Scores by blocks of documents against the plain join of queries and postings."""

import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import blocks, bm25

WORDS = [f"w{i}" for i in range(12)]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    texts = [" ".join(r.choices(WORDS, range(1, 13), k=r.randint(1, 6))) for _ in range(300)]
    docs = spark.createDataFrame([(f"d{i:03d}", t) for i, t in enumerate(texts + texts[:150])] + [("none", None)], "doc_id string, text string")
    asked = [" ".join(r.sample(WORDS, r.randint(1, 4))) for _ in range(60)] + ["w1 unknown", "unknown", "w2 w1", "w1 w2", "", None]
    return docs, spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")


def rows(df):
    return sorted((r.query_id, r.hit_rank, r.doc_id, round(r.score, 6), r.first_term) for r in df.collect())


def no_pairs(*_):
    raise AssertionError("queries are joined to postings")


@pytest.mark.parametrize("mode", ["all", "post", "pre"])
def test_blocks_equal_the_join(spark, corpus, monkeypatch, mode):
    docs, asked = corpus
    index = bm25.build_index(docs, "doc_id", "text")
    only = docs.where(F.crc32("doc_id") % 3 == 0).select("doc_id") if mode != "all" else None
    want = rows(bm25._best_by_join(index, asked, 7, only, mode))
    monkeypatch.setattr(blocks, "BLOCK_DOCS", 40)  # several blocks a task, ties over their borders
    monkeypatch.setattr(blocks, "SETS", 20)
    monkeypatch.setattr(bm25, "score", no_pairs)
    assert rows(bm25.best(index, asked, 7, only, mode)) == want != []


def test_copies_of_an_id_are_one_document(spark, corpus, monkeypatch):
    docs, asked = corpus
    index = bm25.build_index(docs.unionByName(docs.limit(50)).unionByName(docs.limit(20).withColumn("text", F.lit("w1 w3 w3"))), "doc_id", "text")
    want = rows(bm25._best_by_join(index, asked, 7, None, "post"))
    monkeypatch.setattr(bm25, "score", no_pairs)
    assert rows(bm25.best(index, asked, 7)) == want


def test_search_makes_no_row_a_pair(spark, corpus, monkeypatch):
    docs, asked = corpus
    index = bm25.build_index(docs, "doc_id", "text")
    monkeypatch.setattr(bm25, "score", no_pairs)
    got = bm25.search(index, asked, 5).groupBy("query_id").count().collect()
    assert len(got) == 63 and max(r["count"] for r in got) == 5


def test_many_terms_are_joined(spark, corpus, monkeypatch):
    docs, asked = corpus
    index = bm25.build_index(docs, "doc_id", "text")
    want = rows(bm25.best(index, asked, 7))
    monkeypatch.setattr(blocks, "MAX_TERMS", 3)
    assert rows(bm25.best(index, asked, 7)) == want
