import math
import random
from statistics import NormalDist

import pytest

from docloom.llm import rank_fusion as rf


def brute(rows, weights):
    groups = {}
    for g, i, *scores in rows:
        if g is not None and i is not None:
            groups.setdefault(g, {})[i] = [None if s is None or math.isnan(s) else s for s in scores]
    out = {}
    for g, items in groups.items():
        total = dict.fromkeys(items, 0.0)
        for k, w in enumerate(weights):
            values = [float("-inf") if v[k] is None else v[k] for v in items.values()]
            for i, v in items.items():
                x = float("-inf") if v[k] is None else v[k]
                rank = sum(y < x for y in values) + (sum(y == x for y in values) + 1) / 2
                total[i] += w * NormalDist().inv_cdf((rank - 0.5) / len(values))
        for i, t in total.items():
            out[g, i] = t / sum(weights)
    return out


SCHEMA = "q long, e string, a double, b double, v double"


def made(seed):
    r = random.Random(seed)
    rows = []
    for q in range(20):
        for e in range(r.randint(1, 30)):
            rows.append((q, f"e{e}", r.choice([None, float("nan"), 1.0, r.gauss(0, 1)]), r.choice([None, r.random() * 1000]), r.choice([0.1, 1e9, r.random()])))
    return rows + rows[::5] + [(None, "e", 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0)]


@pytest.mark.parametrize("big", [100_000, 3])
def test_equals_brute_force(spark, monkeypatch, big):
    monkeypatch.setattr(rf, "BIG", big)
    rows, weights = made(1), {"a": 1.0, "b": 2.0, "v": 0.5}
    got = rf.fuse(spark.createDataFrame(rows, SCHEMA), "q", "e", weights).collect()
    want = brute(rows, list(weights.values()))
    assert {(r.q, r.e) for r in got} == set(want)
    for r in got:
        assert abs(r.fused - want[r.q, r.e]) < 1e-6
        assert r.place == 1 + sum(w > want[r.q, r.e] + 1e-7 for (q, _), w in want.items() if q == r.q)


def test_missing_is_no_advantage_and_outliers_do_not_decide(spark):
    rows = [(1, "x", 5.0, 5.0, 5.0), (1, "y", 4.0, 4.0, 1e12), (1, "z", None, None, 6.0)]
    assert [(r.q, r.e) for r in rf.best(spark.createDataFrame(rows, SCHEMA), "q", "e", {"a": 1, "b": 1, "v": 1}).collect()] == [(1, "x")]


def test_empty(spark):
    assert rf.fuse(spark.createDataFrame([], SCHEMA), "q", "e", {"a": 1.0}).count() == 0
