import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import mixing


def water(sizes):
    """Targets by sharing again and again, source after source."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    cap, got, left, free = {s: 2.0 * sizes[s] for s in order}, {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap[s]]
        if not over:
            return got | {s: level * w[s] for s in free}
        for s in over:
            got[s] = cap[s]
            left -= cap[s]
            free.discard(s)
    return got


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 50, None: 70}, {"a": 1}, {"a": 0, "b": 0}, {"a": 10**6, "b": 3, "c": 0, "d": 500, "é": 90, None: 1}, {f"s{k}": 100 + k for k in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    for s, t in water(sizes).items():
        assert got[s] == pytest.approx(t, rel=1e-12), s


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 500), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_quotas_are_split_exactly(quotas, shards, seed):
    out = mixing.split_quotas(quotas, shards, seed)
    assert (out.sum(0) == quotas).all() and (out >= 0).all()
    assert np.ptp(out.sum(1)) <= 2 + shards.bit_length()


@given(st.integers(1, 3000), st.integers(0, 2**32))
@settings(max_examples=60, deadline=None)
def test_permutation(n, key):
    assert sorted(mixing.permuted(np.arange(n), n, key).tolist()) == list(range(n))


def test_large_draws_stay_possible():
    rng = np.random.default_rng(0)
    for good, bad, draws in [(10**12, 10**11, 10**11), (5, 2 * 10**9, 10**9), (2 * 10**9, 0, 7)]:
        x = mixing.hypergeometric(rng, good, bad, draws)
        assert max(0, draws - bad) <= x <= min(good, draws)


def test_large_draws_are_exact():
    """Against exact probabilities, by the same code with numpy's range taken away from it."""
    from math import comb, log

    with mixing.localcontext() as c:
        c.prec = 40
        for n in (0, 1, 5, 63, 64, 200):
            want = sum(log(k) for k in range(2, n + 1))
            assert float(mixing._log_factorial(n)) == pytest.approx(want, rel=1e-13, abs=1e-13)
    rng = np.random.default_rng(1)
    good, bad, draws = 5, 2 * 10**9, 10**9
    seen = np.bincount([mixing.hypergeometric(rng, good, bad, draws) for _ in range(2000)], minlength=6) / 2000
    assert np.abs(seen - [comb(5, k) / 32 for k in range(6)]).max() < 0.04
    good, bad, draws = 3 * 10**9, 10**9, 2 * 10**9
    x = np.array([mixing.hypergeometric(rng, good, bad, draws) for _ in range(400)], float)
    spread = (draws * 0.75 * 0.25 * (good + bad - draws) / (good + bad)) ** 0.5
    assert abs(x.mean() - 1.5 * 10**9) < 4 * spread / 20 and 0.85 < x.std() / spread < 1.15


def test_rows_that_are_alike(spark, monkeypatch):
    """Copies of one row, more than a task expands and more than its share, are as many documents."""
    monkeypatch.setattr(mixing, "COPIES", 16)
    monkeypatch.setattr(mixing, "share_of", lambda rows: 40)
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text, "a", k % 2) for k in range(150)] + [(k, f"{text} {k}", "a", 0) for k in range(20)] + [(1, text, None, 0)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, shard int")
    plans = mixing.plan(docs).collect()
    assert len(plans) == len(rows) and sum(r.size for r in plans) == sum(len(r[1].split()) for r in rows)
    want = {}
    for r in plans:
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert sum(got.values()) == sum(want.values()) and set(got) == {k for k, v in want.items() if v}
    again = sorted(map(tuple, mixing.mixed(docs.repartition(5)).collect()), key=repr)
    assert again == sorted(map(tuple, out.collect()), key=repr)


def plan_of(docs):
    return sorted(mixing.plan(docs).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.digest))


def test_plan(spark, odd_docs):
    for docs in (odd_docs.withColumn("source", odd_docs.fp), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = plan_of(docs)
        assert rows == plan_of(docs.repartition(7))
        size, target, taken, slots = {}, {}, {}, {}
        by_doc = {}
        for d in docs.collect():
            by_doc.setdefault(d.doc_id, []).append(d)
        assert len(rows) == docs.count()
        for r in rows:
            assert r.taken == sum(p.n_words for p in r.pieces) <= 2 * r.size
            key = (r.source_size, r.target)
            size[key], target[key], taken[key] = r.source_size, r.target, taken.get(key, 0) + r.taken
            for p in r.pieces:
                assert (key, p.slot) not in slots
                slots[key, p.slot] = p.shard
        for key in size:
            assert taken[key] == pytest.approx(target[key], rel=0.02, abs=2)
    assert mixing.plan(odd_docs.withColumn("source", odd_docs.fp).where("false")).collect() == []


def test_mixed_rows_hold_the_words_taken(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    taken = {r.doc_id: r.taken for r in mixing.plan(docs).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text) and all(x in text[r.doc_id] for x in r.text.split("\n")[:3])
    assert got == {k: v for k, v in taken.items() if v}


def test_take():
    text = " a b  c d\te f "
    assert mixing.take(text, [(0, 6)], 6) == text
    assert mixing.take(text, [(4, 2), (0, 2)], 6) == "a b\ne f"
    assert mixing.take(text, [(2, 2), (0, 2)], 6) == "a b  c d"
