import math
import random

from docloom.llm import top_n


def brute(rows, n):
    groups = {}
    for q, ret, doc, score, rank in set(rows):
        if score is not None and not math.isnan(score):
            groups.setdefault((q, ret), set()).add((-score, rank is None, rank or 0, doc))
    return sorted(((*g, x[3]) for g, xs in groups.items() for x in sorted(xs)[:n]), key=key)


SCHEMA = "query_id long, retriever string, doc_id long, score double, best_rank int"
ORDER = [("score", "desc"), ("best_rank", "asc"), ("doc_id", "asc")]
key = lambda x: tuple((v is None, v) for v in x)


def test_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for doc in range(4000):
        q = 1 if r.random() < 0.4 else r.choice([None, *range(2, 400)])
        rows.append((q, r.choice(["a", "b"]), doc, r.choice([None, float("nan"), 0.0, -0.0, 1.5, round(r.random(), 1)]), r.choice([None, 1, 2, 3])))
    rows += rows[::3]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    for n in (1, 5):
        got = [(x.query_id, x.retriever, x.doc_id) for x in top_n.top_n(df, ["query_id", "retriever"], ORDER, n).collect()]
        # -0.0 and 0.0 tie
        want = brute([(a, b, c, d + 0.0 if d is not None else d, e) for a, b, c, d, e in rows], n)
        assert sorted(got, key=key) == sorted(want, key=key)


def test_pruning_in_steps(spark, monkeypatch):
    rows = [(i % 3, "a", i, float(i * 7919 % 1000), None) for i in range(3000)]
    monkeypatch.setattr(top_n, "HELD", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = [(x.query_id, x.retriever, x.doc_id) for x in top_n.top_n(spark.createDataFrame(rows, SCHEMA), ["query_id", "retriever"], ORDER, 4).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == brute(rows, 4)


def test_clashing_names_carry_and_empty(spark):
    df = spark.createDataFrame([(1, 2.0, "x", 5), (1, 2.0, "b", 6), (1, None, "z", 7), (None, 1.0, None, 8)], "k0 int, o0 double, nth string, bound int")
    got = sorted(((x.k0, x.o0, x.nth, x.place) for x in top_n.top_n(df, ["k0"], [("o0", "desc")], 3, carry=["nth"]).collect()), key=str)
    assert got == [(1, 2.0, "b", 1), (None, 1.0, None, 1)]
    assert top_n.top_n(df.limit(0), ["k0"], [("o0", "desc")], 3).count() == 0


def test_extreme_integers(spark):
    df = spark.createDataFrame([(1, -(2**63)), (1, 2**63 - 1), (1, 0)], "g int, v long")
    assert [x.v for x in top_n.top_n(df, ["g"], [("v", "asc")], 2).orderBy("place").collect()] == [-(2**63), 0]


def test_bounds_act_before_the_shuffle(spark, monkeypatch):
    """Without the bound every partition would pass on its best 5 of each group; with it hardly more than 5 of all go on."""
    rows = [(i % 4, "a", i, float(i * 7919 % 10_007), None) for i in range(8000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(16)
    seen = []
    above = top_n._above

    def counted(survivors, groups):
        out = above(survivors, groups)
        seen.append((survivors.count(), out.count()))
        return out

    monkeypatch.setattr(top_n, "_above", counted)
    for bounds in (top_n.BOUNDS, 0):
        monkeypatch.setattr(top_n, "BOUNDS", bounds)
        result = top_n.top_n(df, ["query_id", "retriever"], ORDER, 5)
        assert sorted((x.query_id, x.retriever, x.doc_id) for x in result.collect()) == brute(rows, 5)
        held, passed = seen[-1]
        assert held == 16 * 4 * 5 and passed < held / 2
        plan = result._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        if bounds:  # the join with the bounds stands below the one exchange by group
            assert plan.index("hashpartitioning(k0") < plan.index("BroadcastHashJoin") and plan.count("hashpartitioning(k0") == 1
