import numpy as np
import pytest

from docloom.llm import vector_neighbors as vn

SCHEMA = "id string, v array<float>, shard int, doc string, vec int"


def made(seed, n, dims=64):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, dims))
    for i in range(n // 3):
        x[n - 1 - i] = x[i] + g.normal(size=dims) * g.uniform(0.05, 0.6)
    return x * g.uniform(0.1, 30, (n, 1))


def brute(ids, x, k, least):
    x = np.asarray(x, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-round(s[i, j], 9), ids[j]))[:k]:
            if s[i, j] >= least:
                out.add((ids[i], ids[j]))
    return out


@pytest.mark.parametrize("large", [4000, 8])
def test_equals_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(vn, "LARGE", large)
    x = made(1, 400)
    if large == 8:
        x[:60] = x[0] + np.random.default_rng(2).normal(size=(60, 64)) * 0.05  # one large bucket
    ids = [f"c{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(e) for e in v], 0, "x", 1) for i, v in zip(ids, x, strict=True)], SCHEMA)
    got = vn.similar_vectors(df, "id", "v", "shard", k=5, least=0.9).collect()
    pairs = {(r.doc, r.neighbour) for r in got}
    want = brute(ids, x, 5, 0.9)
    assert len(pairs & want) >= 0.97 * len(want)
    assert all(1 <= r.place <= 5 and r.cosine >= 0.9 for r in got)


def test_bad_vectors_copies_and_shards(spark):
    a, b = [1.0] * 64, [1.0] * 63 + [2.0]
    rows = [("a", a, 0), ("a", [-1.0] * 64, 1), ("b", b, 0), ("n", None, 0), ("s", [1.0] * 32, 0), ("z", [0.0] * 64, 0), ("f", [float("nan")] + [1.0] * 63, 0), ("i", [float("inf")] + [1.0] * 63, 0), (None, a, 0), ("e", [None] + [1.0] * 63, 0)]
    rows += [("f", b, 2)] + [(f"copy{i:02d}", a, 0) for i in range(15)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = {}
    for r in vn.similar_vectors(df, "id", "v", "shard", k=3).collect():
        got.setdefault(r.doc, {})[r.place] = r.neighbour
    assert set(got) == {"a", "b", "f"} | {f"copy{i:02d}" for i in range(15)}
    assert got["a"] == {1: "copy00", 2: "copy01", 3: "copy02"}
    assert got["copy00"] == {1: "a", 2: "copy01", 3: "copy02"}
    assert got["b"] == {1: "f", 2: "a", 3: "copy00"}


def test_empty(spark):
    assert vn.similar_vectors(spark.createDataFrame([], SCHEMA), "id", "v").count() == 0


def test_probe_order():
    order = vn.probe_order(8, 50)
    assert order[0] == (0,) and len(set(order)) == 50
    assert all(15 - i not in s for s in order for i in s)


def test_search_recall(spark):
    x = made(4, 1500)
    ids = [f"c{i:04d}" for i in range(len(x))]
    df = spark.createDataFrame([(i, [float(e) for e in v], 0, "x", 1) for i, v in zip(ids, x, strict=True)], SCHEMA)
    asked = df.where("id < 'c0050'")
    got = {(r.query, r.neighbour) for r in vn.search(df, asked, "id", "v", k=10).collect()}
    want = {p for p in brute(ids, x, 10, -1) if p[0] < "c0050"}
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.parametrize("functions", [6, 13, 16, 19, 22, 25])
def test_pairs_at_the_least_cosine_meet_at_every_size(functions):
    g = np.random.default_rng(9)
    x, z = g.normal(size=(2, 3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.9 * x + np.sqrt(1 - 0.9**2) * z / np.linalg.norm(z, axis=1)[:, None]
    tables = vn.tables_needed(64, 6, functions, 2.2, 12, 0.9)
    hashed = vn.Tables(64, tables, functions, 2.2, 12)
    of_x, of_y = hashed.keys(x, True), hashed.keys(y, True)
    met = ((of_x == of_y[:, :, :1]) | (of_y == of_x[:, :, :1])).any((1, 2)).mean()
    print(functions, tables, met)
    assert met >= vn.MEET - 2 * np.sqrt(vn.MEET * (1 - vn.MEET) / 3000)
