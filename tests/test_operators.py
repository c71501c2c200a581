import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import bm25, chunking, dense, entries, evaluation, ranking, relational

HITS = "query_id int, entry_id string, score double, hit_rank int, chunk_id string, doc_id string, attachment_id string, source_type string, text string, announced_date string"


def test_bm25_scores_and_ties(spark):
    docs = spark.createDataFrame([(1, "border wall wall"), (2, "border"), (3, "border"), (4, "the of"), (5, None), (6, "river")], "id int, text string")
    index = bm25.build_index(docs, "id", "text")
    assert (index.n_docs, index.avgdl) == (4, 6 / 4)
    queries = spark.createDataFrame([(1, "border border WALL"), (2, "the"), (3, None), (4, "border wall")], "query_id int, query string")
    got = {}
    for r in bm25.search(index, queries).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    assert set(got) == {1, 4} and got[1] == got[4] and [d for d, _ in got[1]] == [1, 2, 3]
    idf = lambda n: math.log(1 + (4 - n + 0.5) / (n + 0.5))
    part = lambda n, tf, dl: idf(n) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / 1.5))
    assert got[1][0][1] == pytest.approx(part(3, 1, 3) + part(1, 2, 3), abs=1e-6)


def test_filters_before_and_after(spark):
    docs = spark.createDataFrame([(i, "border " * (20 - i)) for i in range(1, 15)], "id int, text string")
    index = bm25.build_index(docs, "id", "text")
    q = spark.createDataFrame([(1, "border")], "query_id int, query string")
    only = spark.createDataFrame([(14,), (1,)], "doc_id int")
    find = lambda mode: {r.doc_id for r in bm25.search(index, q, 2, 2, only, mode).collect()}
    assert find("pre") == {1, 14} and find("post") < {1, 14}


def test_postings_invariants(spark):
    docs = spark.createDataFrame([(i, " ".join(random.Random(i).choices("alpha beta gamma delta".split(), k=i))) for i in range(1, 20)], "id int, text string")
    p = bm25.postings_of(docs, "id", "text")
    assert p.groupBy("doc_id", "term").count().where("count > 1").count() == 0
    assert all(r.n == r.dl for r in p.groupBy("doc_id", "dl").agg(F.sum("tf").alias("n")).collect())
    assert [r.doc_id for r in bm25.dense_ids(docs, ["id"]).orderBy("id").collect()] == list(range(19))


def hit(entry, score, rank, kind, date="2020-01-01", chunk=None):
    return (1, entry, score, rank, chunk or f"{entry}-{rank}", str(rank), f"a{rank}", kind, "text " * 60, date)


def test_entries_and_display(spark):
    rows = [hit("e1", 9.0, 1, "policy_title"), hit("e1", 5.0, 3, "policy_summary"), hit("e1", 4.0, 4, "pdf_page"), hit("e2", 7.0, 2, "policy_summary"), hit("e2", 1.0, 7, "pdf_page"), hit("e3", 7.0, 5, "pdf_page", "2021-01-01"), hit(None, 8.0, 6, "pdf_page"), hit("e4", 6.0, 8, "policy_title"), hit("e4", 2.0, 9, "policy_summary")]
    got = entries.roll_up(spark.createDataFrame(rows, HITS)).orderBy("rank").collect()
    assert [(r.entry_id, r.source, r.chunk_id, r.score, r.best_rank) for r in got] == [("e1", "title", "e1-4", 9.0, 1), ("e3", "pdf", "e3-5", 7.0, 5), ("e2", "summary", "e2-2", 7.0, 2), ("e4", "title", "e4-9", 6.0, 8)]
    assert got[0].matched_chunk_ids == ["e1-1", "e1-3", "e1-4"] and got[0].relevant_chunk.chunk_id == "e1-4" and got[3].relevant_chunk is None
    assert len(got[0].snippet) == 220 and got[0].snippet.endswith("…")
    by_date = entries.roll_up(spark.createDataFrame(rows, HITS), by_date=True).orderBy("rank").first()
    assert by_date.entry_id == "e3"


def test_fusion(spark):
    kind = "query_id int, entry_id string, rank int, score double, chunk_id string, doc_id string, matched_chunk_ids array<string>"
    a = spark.createDataFrame([(1, "x", 1, 9.0, "c1", "0", ["c1"]), (1, "y", 2, 8.0, "c2", "2", ["c2", "c3"])], kind)
    b = spark.createDataFrame([(1, "y", 1, 0.9, "c9", None, ["c3", "c9"]), (1, "z", 2, 0.8, "c7", None, [])], kind)
    got = {r.entry_id: r for r in entries.fuse({"bm25": a, "semantic": b}).collect()}
    assert got["y"].rrf_score == pytest.approx(1 / 62 + 1 / 61) and got["y"].rank == 1
    assert (got["y"].chunk_id, got["y"].sources, got["y"].matched_chunk_ids, got["y"].matched_count) == ("c2", ["bm25", "semantic"], ["c2", "c3", "c9"], 3)
    assert got["x"].doc_id == "0" and got["x"].semantic_rank is None and got["z"].bm25_score is None
    swapped = {r.entry_id: r.rrf_score for r in entries.fuse({"semantic": b, "bm25": a}).collect()}
    assert swapped == {k: r.rrf_score for k, r in got.items()}


def cut(spark, f, scores, **options):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(scores, 1)], "query_id int, rank int, ce_score double")
    return [r.rank for r in f(df, **options).orderBy("rank").collect()]


def plain_change_point(scores, cap, penalty):
    best, star = -math.inf, 1
    for k in range(1, min(cap, len(scores) - 1) + 1):
        s = sum(scores[:k]) / k - sum(scores[k:]) / (len(scores) - k) - penalty / k
        if s > best + 1e-9:
            best, star = s, k
    return star


def test_cut_offs(spark):
    assert cut(spark, entries.confidence_band, [5.0, 4.0, 1.0, 0.4, 0.6]) == [1, 2, 3]
    assert cut(spark, entries.confidence_band, [-9.0, -9.5, -9.9, -10.0]) == [1, 2, 3]
    assert cut(spark, entries.confidence_band, [1.0] * 30) == list(range(1, 21))
    assert cut(spark, entries.confidence_band, [1.0] * 5, cap=2, min_return=3) == [1, 2]
    assert cut(spark, entries.confidence_band, []) == [] and cut(spark, entries.confidence_band, [0.0]) == [1]
    r = random.Random(1)
    for n in (1, 2, 5, 12):
        scores = sorted((r.uniform(-2, 8) for _ in range(n)), reverse=True)
        assert len(cut(spark, entries.change_point, scores, min_return=1)) == plain_change_point(scores, 20, 5.0)


def test_rerank(spark):
    fused = spark.createDataFrame([(1, "a", 1, 0.3, "c1", "s", "2020-01-01"), (1, "b", 2, 0.2, "c2", "border wall", "2022-01-01"), (1, "c", 3, 0.1, "c3", "s", None)], "query_id int, entry_id string, rank int, rrf_score double, chunk_id string, snippet string, announced_date string")
    q = spark.createDataFrame([(1, "border wall")], "query_id int, query string")
    texts = spark.createDataFrame([("c1", "river")], "chunk_id string, text string")
    assert [r.entry_id for r in entries.rerank(fused, q, texts, depth=2).orderBy("rank").collect()] == ["b", "a", "c"]
    assert [r.entry_id for r in entries.rerank(fused, q, texts, depth=2, by_date=True).orderBy("rank").collect()] == ["b", "a"]


def test_exact_search_in_blocks(spark, monkeypatch):
    g = np.random.default_rng(0)
    x = g.normal(size=(80, 8))
    df = spark.createDataFrame([(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(99, None), (98, [1.0])], "chunk_id int, embedding array<float>")
    asked = df.where("chunk_id < 7").withColumnRenamed("chunk_id", "query_id")
    monkeypatch.setattr(dense, "BLOCK_BYTES", 8 * 8 * 3)
    for metric in ("ip", "l2"):
        got = {(r.query_id, r["rank"]): r.chunk_id for r in dense.exact_search(df, asked, 4, metric).collect()}
        y = x.astype(np.float32).astype(float)
        s = y @ y.T if metric == "ip" else -((y[:, None] - y[None]) ** 2).sum(2)
        assert got == {(q, i + 1): int(n) for q in range(7) for i, n in enumerate(np.argsort(-s[q], kind="stable")[:4])}
    assert {r.own_rank for r in dense.self_retrieval(df.where("chunk_id < 80"), df.where("chunk_id < 5"), 3, metric="l2").collect()} == {1}


def test_shard_faults(spark):
    rows = [(0, "a", [1.0, 2.0]), (0, "b", [1.0]), (1, "a", [1.0, 2.0]), (2, None, [1.0, 2.0]), (3, "d", [float("nan"), 1.0]), (4, "e", [1.0, 1.0])]
    got = {r.shard_idx: r.status for r in dense.validate_shards(spark.createDataFrame(rows, "shard_idx int, chunk_id string, embedding array<float>"), 2, spark.createDataFrame([(0, 2), (1, 1), (2, 1), (3, 1), (4, 2), (5, 1)], "shard_idx int, count long")).collect()}
    assert got == {0: "BAD_DIMENSION", 1: "DUPLICATE_ID", 2: "MISSING_ID", 3: "NOT_FINITE", 4: "COUNT_MISMATCH", 5: "MISSING_SHARD"}


def test_embedder_is_deterministic(spark):
    df = spark.createDataFrame([("a", "Border wall"), ("b", ""), (None, "x")], "chunk_id string, text string")
    got = {r.chunk_id: np.array(r.embedding) for r in dense.embed(df, dense.Embedder()).collect()}
    assert set(got) == {"a", "b"} and all(abs(np.linalg.norm(x) - 1) < 1e-5 for x in got.values())

    class Small(dense.Embedder):
        def embed(self, texts):
            if len(texts) > 1:
                raise MemoryError
            return super().embed(texts)

    again = {r.chunk_id: np.array(r.embedding) for r in dense.embed(df, Small()).collect()}
    assert all((again[k] == got[k]).all() for k in got)


PAGE = "page_ptr_id string, policydocument_id string, page_num int, text string, source_path string"


def plain_chunks(pages, c, least):
    """The fold over pages already split into units."""
    fold, out = chunking.Fold(c, least), []
    for page, units in pages:
        out += [x for u in units if (x := fold.add(u, page))]
    return out + ([x] if (x := fold.end()) else [])


def test_chunks(spark):
    c = chunking.ChunkConfig(target_chars=100, min_chars=40, relaxed_min_chars=10, max_unit_chars=80, hard_split_chars=30)
    pages = [("1", "7", p, " ".join(f"Sentence {p} number {i} is here." for i in range(9)), "x.pdf") for p in (2, 1, 3)]
    pages += [("1", "8", 1, "Short text only.", "y.pdf"), ("2", "9", 1, "a. " * 90, "p1.pdf"), ("2", "9", 2, "b. " * 90, "p2.pdf"), ("3", "1", 1, "This table of contents is long. " * 20, "z.pdf"), ("4", "1", 1, "A" * 260, "w.pdf"), ("5", "1", 1, None, "v.pdf")]
    got = {}
    for r in chunking.pdf_chunks(spark.createDataFrame(pages, PAGE), c).orderBy("page_start", "page_end").collect():
        got.setdefault((r.page_ptr_id, r.policydocument_id), []).append(r)
    assert set(got) == {("1", "7"), ("1", "8"), ("4", "1")}
    want = plain_chunks([(p, [f"Sentence {p} number {i} is here." for i in range(9)]) for p in (1, 2, 3)], c, 40)
    assert sorted(r.text for r in got["1", "7"]) == sorted(w[0] for w in want)
    assert all(r.chunk_id.startswith(f"1_pdf_7_p{r.page_start:04d}-p{r.page_end:04d}_h") and len(r.chunk_id.split("_h")[1]) == 16 for r in got["1", "7"])
    assert [r.text for r in got["1", "8"]] == ["Short text only."] and max(len(r.text) for r in got["4", "1"]) < 260


def test_overlap_carries_the_last_unit():
    c = chunking.ChunkConfig(target_chars=50, min_chars=10)
    fold = chunking.Fold(c, 10)
    assert fold.add("a" * 30, 1) is None
    text, start, end = fold.add("b" * 30, 2)
    assert (start, end) == (1, 2) and fold.units == [("b" * 30, 2)]


def test_title_and_summary_chunks(spark):
    df = spark.createDataFrame([(1, " T ", "x\n\ny"), (2, "", None), (3, None, "a\n\n" + "b" * 1600)], "page_ptr_id long, title string, description_text string")
    assert [(r.page_ptr_id, r.text) for r in chunking.title_chunks(df).collect()] == [("1", "T")]
    got = sorted((r.chunk_id.split("_h")[0], r.text) for r in chunking.summary_chunks(df).collect())
    assert got == [("1_sum", "x\n\ny"), ("3_sum_par0000", "a"), ("3_sum_par0001", "b" * 1600)]


@pytest.mark.parametrize(("share", "want"), [(80, True), (79, False)])
def test_scanned(spark, share, want):
    df = spark.createDataFrame([("a", "x" if i < share else "y" * 40) for i in range(100)], "stable_id string, text string")
    assert chunking.scanned(df).first().scanned is want


def plain_metrics(rels, k=5, threshold=2):
    dcg = lambda r: sum(x / math.log2(i + 2) for i, x in enumerate(r[:k]))
    top, best = rels[:k], dcg(sorted(rels, reverse=True))
    first = next((i for i, r in enumerate(top) if r >= threshold), None)
    return round(dcg(rels) / best if best else 0.0, 6), float(first is not None), round(1 / (first + 1) if first is not None else 0.0, 6), round(sum(r >= threshold for r in top) / len(top), 6)


def test_metrics(spark):
    judged = {"q1": [3, 0, 2, 1, 0, 3], "q2": [0, 0, 0], "q3": [1, 2]}
    rows = [(q, str(i + 1), str(r)) for q, rs in judged.items() for i, r in enumerate(rs)] + [("q1", "x", "3"), ("q4", "9", "2"), ("q4", "11", "0"), (None, "1", "3")]
    got = {r.query: (r.ndcg, r.success, r.mrr, r.precision) for r in evaluation.ir_metrics(spark.createDataFrame(rows, "query string, rank string, relevance string")).collect()}
    assert got == {"q1": plain_metrics([3, 0, 2, 1, 0]), "q2": plain_metrics([0, 0, 0]), "q3": plain_metrics([1, 2]), "q4": plain_metrics([2, 0])}


def test_runs_and_numbers(spark):
    rows = [(1, "E1", "p1"), (2, "E2", "p1"), (3, "E1", "p2"), (4, "E1", "p3"), (5, "E3", "p1"), (6, "E3", "p2")]
    df = spark.createDataFrame(rows, "i int, e string, p string").repartition(3)
    good, late = ranking.first_islands(df, ["i"], ["e"])
    assert sorted(r.i for r in good.collect()) == [1, 2, 5, 6] and sorted(r.i for r in late.collect()) == [3, 4]
    assert sorted((r.i, r.row) for r in ranking.number_rows(df, ["i"]).collect()) == [(i + 1, i) for i in range(6)]
    assert [r.island for r in ranking.islands(df.withColumn("k", F.lit(1)), ["k"], ["i"], "e").orderBy("i").collect()] == [1, 2, 3, 3, 4, 4]


def test_first_values(spark):
    df = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "x", "b"), (2, 1, None, None)], "k int, o int, u string, w string")
    assert [(r.k, r.u, r.w) for r in ranking.first_values(df, ["k"], ["o"], ["u", "w"]).orderBy("k").collect()] == [(1, "x", "a"), (2, None, None)]


def test_tags_and_rejects(spark):
    schemas = [("app_policy", ["id", "Title", "status_id"]), ("app_status", ["id", "title"]), ("app_policy_agencies", ["id", "policy_id", "agency_id"]), ("docs_document", ["id", "file", "title"]), ("y", []), ("z", None)]
    df = spark.createDataFrame(schemas, "table string, columns array<string>")
    assert {r.table: r.tags for r in relational.table_tags(df).collect()} == {"app_policy": ["refers to:status", "referenced"], "app_status": ["dimension", "referenced"], "app_policy_agencies": ["joins:agency,policy"], "docs_document": ["dimension", "files"], "y": [], "z": []}
    assert relational.matching_tables(df, "POLICY", "agenc").count() == 1
    pages = spark.createDataFrame([("s", 1, 1, "0", "t"), ("s", 1, 1, "-2", "t"), ("s", 1, 1, "1", "t"), ("s", 1, 1, "x", "t"), ("s", None, 1, "1", "t")], "stable_id string, page_ptr_id int, policydocument_id int, page_num string, text string")
    good, audit = relational.valid_pages(pages)
    assert good.count() == 1 and {r.type: r["rows"] for r in relational.audit_counts(audit).collect()} == {"SKIP_NONPOSITIVE_PAGE_NUM": 2, "SKIP_BAD_PAGE_NUM": 1, "SKIP_BAD_RECORD": 1}


def test_centroid_lists_recall(spark):
    x = np.random.default_rng(3).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    rows = [(r.query_id, r.vec_id) for r in dense.CentroidLists(df, 16, "vec_id").search(asked, 10, 8).collect()]
    s = np.round(x[::20] @ x.T, 6)
    want = {(20 * i, int(j)) for i in range(len(s)) for j in np.argsort(-s[i], kind="stable")[:10]}
    assert len(rows) == len(set(rows)) == 1000
    print("recall", len(want & set(rows)) / len(want))
    assert len(want & set(rows)) >= 0.9 * len(want)


def test_embedder_hashes_all_words():
    words = [f"w{i}" for i in range(600)]
    one = lambda w: dense.Embedder(dense.EmbedConfig(normalize=False, pooling="sum")).embed([" ".join(w)])[0]
    assert np.array_equal(one(words), one(words[:256]) + one(words[256:512]) + one(words[512:]))
    assert not np.array_equal(one(words), one(words[:256]))


def test_stand_in_scores_whole_texts(spark):
    fused = spark.createDataFrame([(1, "e", "c", "s", 1, 0.5), (1, "f", "d", "s", 2, 0.4)], "query_id int, entry_id string, chunk_id string, snippet string, rank int, rrf_score double")
    asked = spark.createDataFrame([(1, "asylum")], "query_id int, query string")
    texts = spark.createDataFrame([("c", "word " * 600), ("d", "word " * 600 + "asylum")], "chunk_id string, text string")
    assert {r.entry_id: r["rank"] for r in entries.rerank(fused, asked, texts).collect()} == {"f": 1, "e": 2}
    cut = entries.rerank(fused, asked, texts, entries.PairScorer()).collect()  # a given scorer has a window
    assert {r.entry_id: r["rank"] for r in cut} == {"e": 1, "f": 2}


def test_stored_index_reads_the_shards_of_the_terms_only(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"border wall number{i % 7} crossing{i % 3}") for i in range(200)] + [(999, None)], "doc_id int, text string")
    asked = spark.createDataFrame([(1, "wall crossing1"), (2, "nothing known"), (3, "")], "query_id int, query string")
    index = bm25.build_index(docs, "doc_id", "text")
    bm25.save_index(index, str(tmp_path / "index"), 16)
    loaded = bm25.load_index(spark, str(tmp_path / "index"), asked)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(bm25.search(loaded, asked, 5)) == rows(bm25.search(index, asked, 5)) != []
    assert rows(bm25.search(bm25.load_index(spark, str(tmp_path / "index")), asked, 5)) == rows(bm25.search(index, asked, 5))
    plan = loaded.postings._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: ")[1].split("]")[0]
    assert "shard" in filters and "In(term" in plan
    assert (loaded.n_docs, loaded.avgdl) == (index.n_docs, index.avgdl) and loaded.docs.count() == 200


def test_dense_entries_retry_once_and_obey_filters(spark):
    near = spark.createDataFrame([(q, f"c{i:03d}", 1.0 - i / 1000, i) for q in (1, 2) for i in range(1, 101)], "query_id int, chunk_id string, score double, rank int")
    chunks = spark.createDataFrame([(f"c{i:03d}", f"e{i // 10}") for i in range(1, 101)], "chunk_id string, entry_id string")
    hits = lambda **o: sorted((r.hit_rank, r.chunk_id) for r in dense.entry_hits(near.where("query_id = 1"), chunks, **o).collect())
    assert len(hits(top_k=2, depth=20, retry=5)) == 20  # entries enough among the first twenty
    assert len(hits(top_k=4, depth=20, retry=3)) == 60  # not enough: three times as many, once
    few = chunks.where("chunk_id like '%5'").select("chunk_id")
    assert [n for n, _ in hits(top_k=2, depth=20, retry=5, allowed=few)] == [1, 2] and len(hits(top_k=3, depth=20, retry=5, allowed=few)) == 10


def test_shard_policy(spark):
    report = spark.createDataFrame([(0, "OK"), (1, "NOT_FINITE"), (2, "DUPLICATE_ID")], "shard_idx int, status string")
    assert sorted(r.shard_idx for r in dense.usable_shards(report).collect()) == [0, 2]
    with pytest.raises(ValueError, match="shard 1: NOT_FINITE"):
        dense.usable_shards(report, skip=False)
    with pytest.raises(ValueError, match="no shard"):
        dense.usable_shards(report.where("shard_idx = 1"))


def test_exact_search_by_small_tiles(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.round(r.normal(size=(90, 4)), 1)  # coarse, so that there are ties
    x[40:80] = x[:40]
    ids = [f"v{i:02d}" for i in r.permutation(90)]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:25])], "query_id int, embedding array<double>")
    monkeypatch.setattr(dense, "QUERY_ROWS", 8)  # no product is larger than this by that, whatever the queries and vectors are
    monkeypatch.setattr(dense, "VECTOR_ROWS", 7)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in dense.exact_search(vectors, asked, 6).collect()}
    s = np.round(x[:25] @ x.T, 6)
    for q in range(25):
        want = sorted(zip(-s[q], ids, strict=True))[:6]
        assert [got[q, n + 1] for n in range(6)] == [(i, pytest.approx(-v, abs=1e-9)) for v, i in want]
