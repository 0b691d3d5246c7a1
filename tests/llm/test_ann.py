import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inkledger.llm import ann
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def brute(ids, x, asked, k=20):
    out = {}
    for a in asked:
        q = x[np.flatnonzero(ids == a)[0]]
        s = (x * q).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != a][:k]
        out[int(a)] = [(int(ids[i]), float(s[i])) for i in order]
    return out


def test_query_recall_order_and_scores(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    want = brute(ids, x, ids[ids % 20 == 0])
    got = {}
    for r in QUERIES["op9_nearest_neighbours"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    at = dict(zip(ids.tolist(), x, strict=True))
    hits = 0
    assert set(got) == set(want)
    for a, found in got.items():
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 21)) and all(v != a for _, v, _ in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        assert all(abs(s - (at[v] * at[a]).sum()) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & {v for v, _ in want[a]})
    assert hits >= 0.9 * 20 * len(want)


def test_pieces_of_hot_lists_change_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 6))
    x[200:420] = x[3]  # a hot group of copies
    x *= rng.uniform(0.2, 5, size=(600, 1))  # norms differ
    x[200:420] = x[3]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    results = []
    for size, queries in ((10**6, 10**6), (16, 7)):
        monkeypatch.setattr(ann, "GROUP", size)
        monkeypatch.setattr(ann, "QUERIES", queries)
        results.append(sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 20 == 0, 5).collect())))
    assert results[0] == results[1]
    ids = np.arange(600)
    want = brute(ids, x, ids[ids % 20 == 0], 5)
    hits = sum(r[2] in {v for v, _ in want[r[0]]} for r in results[0])
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_graph_finds_the_nearest_centroids():
    rng = np.random.default_rng(2)
    c, q = rng.normal(size=(700, 12)), rng.normal(size=(200, 12))
    at, far = ann.Graph(c).search(q, 64)
    true = np.argsort(((q[:, None] - c[None]) ** 2).sum(axis=2), axis=1)[:, :8]
    assert np.mean([len(set(a[:8]) & set(t)) / 8 for a, t in zip(at, true, strict=True)]) > 0.97
    assert (np.diff(far, axis=1) >= 0).all()


def test_many_lists_are_found_without_a_wider_walk(monkeypatch):
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(900, 8)), rng.normal(size=(40, 8))
    index = ann.Index(None, 8, float((x**2).sum(axis=1).max()), 2.0)
    index.graph = ann.Graph(index.lifted(x))
    beams, search = [], ann.Graph.search
    monkeypatch.setattr(ann.Graph, "search", lambda self, y, beam: beams.append(beam) or search(self, y, beam))
    rows, lists = index.lists_for(q, np.ones(900, dtype=np.int64), 4)
    far = np.sqrt(((np.pad(q, ((0, 0), (0, 1)))[:, None] - index.graph.centers[None]) ** 2).sum(axis=2))
    want = {(i, j) for i, j in zip(*np.nonzero(far <= 2.0 * far.min(axis=1)[:, None]), strict=True)}
    assert {*zip(rows.tolist(), lists.tolist(), strict=True)} == {(int(i), int(j)) for i, j in want} and len(want) > 40 * 64
    assert beams == [ann.BEAM]


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (20, None), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [None, 1.0]), (120, [1.0]), (None, [1.0, 1.0]), (3, [1.0, 0.0]), (3, [1.0, 0.0]), (140, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, list int")
    got = sorted(tuple(r) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 3, 1.0), (0, 3, 2, 0.5), (0, 4, 140, -1.0), (140, 1, 2, -0.5), (140, 2, 0, -1.0), (140, 3, 1, -1.0), (140, 4, 3, -1.0)]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ann.nearest(df.where("vec_id = 20"), F.col("vec_id") % 20 == 0).count() == 0


def test_every_query_gets_all_that_there_are(spark):
    rng = np.random.default_rng(3)
    for n in (15, 21, 1500):  # the last has lists of few vectors
        x = rng.normal(size=(n, 8)) + (np.arange(n) % 6)[:, None] * 50
        df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
        got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).groupBy("query_id").count().collect()
        assert len(got) == -(-n // 20) and all(r["count"] == min(20, n - 1) for r in got)


def test_recall_where_queries_are_unlike_the_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST", 64)
    rng = np.random.default_rng(6)
    n = 4000
    x = rng.normal(size=(40, 32))[rng.integers(0, 40, n)] + 0.1 * rng.normal(size=(n, 32))  # clusters, and queries anywhere
    ids = np.arange(n)
    x[ids % 20 == 0] = rng.normal(size=(n // 20, 32))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    want = brute(ids, x, ids[ids % 20 == 0])
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    hits = sum(r["vec_id"] in {v for v, _ in want[r["query_id"]]} for r in got)
    assert hits >= 0.9 * 20 * len(want)


def test_ids_that_repeat_take_no_place_of_others(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 8)) + 3
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(7, [9.0 + 0.001 * j] * 8) for j in range(60)]
    got = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = ann.nearest(got, F.col("vec_id") % 20 == 0, 20).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {20} and len(got) == 20


def test_rows_are_placed_by_one_product_and_lists_scored_apart(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(600, 8))
    index = ann.fit(x, 6000, float((x**2).sum(axis=1).max()))
    monkeypatch.setattr(ann.Graph, "search", None)
    row, lists = index.lists_of(x)
    far = ((index.lifted(x)[:, None] - index.graph.centers[None]) ** 2).sum(axis=2)
    assert {*zip(row.tolist(), lists.tolist(), strict=True)} >= {*enumerate(far.argmin(axis=1).tolist())}
    own = [[int(v) for v in lists[row == i]] for i in range(600)]
    block = ann._Block([(np.arange(600), x, own)], 5)
    asked = [[0, 3, 999], [int(v) for v in range(len(index.graph.centers))], [1]]
    for scale in (1.0, 1e200):  # beyond single precision
        q = rng.normal(size=(3, 8)) * scale
        batch = pa.record_batch([pa.array([-1, -2, -3]), pa.array(asked, pa.list_(pa.int32())), pa.array(q.tolist())], names=["id", "lists", "v"])
        for j, r in enumerate(block.best(batch, 8, 5).to_pylist()):
            allowed = [i for i in range(600) if {*own[i]} & {*asked[j]}]
            assert r["vec_ids"] == sorted(allowed, key=lambda i: -(x[i] * q[j]).sum())[:5]


def test_vectors_are_assigned_once_a_round(monkeypatch):
    calls, own = [], ann._nearest
    monkeypatch.setattr(ann, "_nearest", lambda x, c: calls.append(len(x)) or own(x, c))
    ann.split_centroids(np.random.default_rng(3).normal(size=(500, 4)), 40)
    assert len(calls) == 9
