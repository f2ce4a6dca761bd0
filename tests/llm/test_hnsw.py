import numpy as np

from ledgerloom.llm import hnsw


def brute(rows, queries, k):
    out = {}
    for q, x in queries:
        x = np.array(x, np.float64)
        near = [(-float(x @ np.array(v, np.float64)) / (np.linalg.norm(x) * np.linalg.norm(np.array(v, np.float64))), i) for i, v in rows if i != q and len(v) == len(x)]
        out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in near)[:k]]
    return out


def recall(got, want):
    """By score: a neighbour counts if its score is no less than the last true one's."""
    hits = total = 0
    for q, near in want.items():
        total += len(near)
        hits += sum(s >= near[-1][1] - 1e-9 for s in got.get(q, []))
    return hits / max(total, 1)


def test_recall_of_one_shard():
    rng = np.random.default_rng(0)
    for v in (rng.normal(size=(5000, 64)), rng.normal(size=(10, 64))[rng.integers(0, 10, 5000)] + 0.3 * rng.normal(size=(5000, 64))):
        v = hnsw.unit(v)
        found = hnsw.search(v[::50], v, hnsw.build(v), 10)
        true = np.argsort(-(v[::50] @ v.T), axis=1)[:, :6]
        assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(true.tolist(), found.tolist(), strict=True)]) > 0.95


def test_small_shards():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 20, 200):
        v = hnsw.unit(rng.normal(size=(n, 8)))
        found = hnsw.search(v, v, hnsw.build(v), 5)
        assert all(set(np.argsort(-(v @ v[k]))[: min(5, n)].tolist()) <= set(found[k].tolist()) for k in range(n))


def test_table_against_brute_force(spark, monkeypatch):
    from ledgerloom.llm.queries import op8_hnsw

    monkeypatch.setattr(hnsw, "SHARD", 200)
    d = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in sorted(op8_hnsw(spark, d).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    assert recall({q: [s for _, s in x] for q, x in got.items()}, want) >= 0.9
    vectors = dict(rows)
    for q, near in got.items():
        assert len(near) == 5 and all(abs(s - brute([(i, vectors[i])], [(q, vectors[q])], 1)[q][0][1]) < 1e-9 for i, s in near)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0]), (9, [1.0, 0.0, 0.0])]
    rows += [(10 + k, [1.0, 0.0]) for k in range(30)] + [(50, [0.0, 1e200]), (50, [0.0, 1e200])]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    got = {}
    for r in sorted(hnsw.nearest(t, t.where("id in (0, 1, 9, 50)"), 3).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [7, 8, 10] and 1 not in got and 9 not in got and len(got[50]) == 3
    assert hnsw.nearest(t.where("false"), t.where("false"), 3).collect() == []


def exact(rows, queries, k):
    """Rows (id, vector) that differ, by all pairs, with exact integers in place of doubles where these would overflow."""
    from fractions import Fraction
    from math import sqrt

    def score(a, b):
        top = max(map(abs, a)), max(map(abs, b))
        a, b = ([Fraction(x) / Fraction(t) for x in v] for v, t in zip((a, b), top, strict=True))
        dot = sum(x * y for x, y in zip(a, b, strict=True))
        return float(dot) / sqrt(float(sum(x * x for x in a) * sum(y * y for y in b)))

    return sorted((q, n, i, s) for q, x in set(queries) for n, (s, i) in enumerate(sorted(((round(score(x, v), 12), i) for i, v in set(rows) if i != q), key=lambda t: (-t[0], t[1]))[:k], 1))


def test_repeated_rows_and_ids_against_all_pairs(spark):
    """Query rows that are repeated, one id with several vectors, equal vectors of many ids, very large and small components."""
    rows = [(50, (1.0, 2.0, 0.5))] * 8 + [(50, (3.0, -1.0, 0.0)), (60, (1.0, 2.0, 0.5)), (70, (1.0, 2.0, 0.6)), (70, (1.0, 2.0, 0.6)), (1, (2.0, 4.0, 1.0)), (2, (1.0, 1.0, 0.9))]
    rows += [(100, (1e200, 1e200, 0.0)), (101, (1e-200, 1e-200, 1e-200)), (102, (1e300, 0.0, 1e-300)), (103, (5e-324, 0.0, 5e-324)), (104, (-1e200, 1.0, 0.0))]
    rows += [(200 + k, (0.0, 1.0, 1.0)) for k in range(12)]
    t = spark.createDataFrame([(i, list(v)) for i, v in rows], "id long, vector array<double>")
    asked = [r for r in rows if r[0] in (50, 60, 70, 100, 101, 102, 103, 200, 211)]
    q = spark.createDataFrame([(i, list(v)) for i, v in asked], t.schema)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hnsw.nearest(t, q, 5).collect())
    want = exact(rows, asked, 5)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert np.abs(np.array([x[3] for x in got]) - [x[3] for x in want]).max() < 1e-9


def test_many_shards_and_parts(spark, monkeypatch):
    """The same answers however queries are dealt, and no query lost between graphs of one task."""
    rng = np.random.default_rng(5)
    rows = [(k, x.tolist()) for k, x in enumerate(rng.normal(size=(900, 6)))] + [(1000 + k, x.tolist()) for k, x in enumerate(rng.normal(size=(90, 3)))]
    t = spark.createDataFrame(rows, "id long, vector array<double>")
    monkeypatch.setattr(hnsw, "SHARD", 60)
    monkeypatch.setattr(hnsw, "QUERIES", 10)
    got = {}
    for r in hnsw.nearest(t, t.where("id % 10 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 10 == 0], 5)
    assert set(got) == set(want) and all(sorted(x[0] for x in v) == [1, 2, 3, 4, 5] for v in got.values())
    assert recall({q: [s for _, _, s in x] for q, x in got.items()}, {q: x for q, x in want.items()}) >= 0.99


def test_recall_of_the_query_over_several_shards(spark, tmp_path):
    """op8 as it is registered, shards of their real size, against all pairs."""
    from ledgerloom.llm.queries import op8_hnsw

    rng = np.random.default_rng(7)
    n, centres = 2 * hnsw.SHARD + 500, rng.normal(size=(300, 16))
    x = (centres[rng.integers(0, 300, n)] + 0.5 * rng.normal(size=(n, 16))).astype(np.float32)
    import pyarrow as pa
    import pyarrow.parquet as pq

    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": pa.array(list(x))}), tmp_path / "embeddings.parquet")
    got = {}
    for r in op8_hnsw(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    v = x.astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        s = v @ v[q]
        s[q] = -9
        hits += len(got[q] & set(np.argpartition(-s, 4)[:5].tolist()))
    assert len(got) == len(range(0, n, 50)) and hits / (5 * len(got)) >= 0.9
