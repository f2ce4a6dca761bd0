import numpy as np
import pytest
import xxhash

from ledgerloom.llm import simhash


def brute_print(text):
    words = []
    for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" "):
        words += [x] if x else []
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                label[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return sorted((d if d is not None else -1, f"{p:016x}", least.get(top(i), -1)) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True)))


def run(docs):
    got = simhash.components(docs).withColumn("fp", simhash.hex_digits(simhash.F.col("fp"))).collect()
    return sorted((r.doc_id if r.doc_id is not None else -1, r.fp, r.component_id if r.component_id is not None else -1) for r in got)


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_near_lanes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 4).astype(np.uint64)
    fps = base[rng.integers(0, 4, 300)]
    for _ in range(5):
        fps = fps ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    sliced = simhash.planes(fps.view(np.int64))
    query, word = np.repeat(fps, 5), np.tile(np.arange(5), 300)
    near = simhash.near_lanes(sliced, query, word, radius)
    for q, w, got in zip(query[::7], word[::7], near[::7], strict=True):
        for lane in range(min(64, 300 - 64 * w)):
            assert bool(int(got) >> lane & 1) == (bin(int(q ^ fps[64 * w + lane])).count("1") <= radius)


def test_no_pair_escapes_the_buckets():
    rng = np.random.default_rng(3)
    for n in (10, 10**7, 10**10):
        masks = simhash.bucket_masks(n, 4)
        for _ in range(500):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)


def test_odd_documents(odd_docs):
    assert run(odd_docs) == brute_components([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert run(odd_docs.where("false")) == []


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    assert run(docs) == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_large_buckets_and_chains(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rng = np.random.default_rng(5)
    center = int(rng.integers(0, 2**62))
    fps = {center}
    at = center
    for _ in range(60):
        at ^= 1 << int(rng.integers(0, 62))
        fps.add(at)
    fps |= {int(x) for x in rng.integers(0, 2**62, 50)}
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    roots = {r.node: r.root for r in simhash.stars(simhash.links(df, 4, len(fps))).collect()}
    fps = sorted(fps)
    label = {x: x for x in fps}
    for _ in fps:
        for x in fps:
            for y in fps:
                if bin(x ^ y).count("1") <= 4:
                    label[x] = min(label[x], label[y])
    assert {x: roots.get(x, x) for x in fps} == label


def test_hot_fingerprints_and_hubs(spark, monkeypatch):
    """Rows of hot keys are joined where they are: the same components as by one path for all keys."""
    from ledgerloom.llm import shared

    rows = [(k, "one and the same text here again") for k in range(40)] + [(100 + k, f"w{k} x{k % 3} y z") for k in range(30)] + [(None, "one and the same text here again"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, simhash.components(docs, radius=20).collect()), key=repr)
    monkeypatch.setattr(shared, "LEAST_SHARE", 2)
    assert sorted(map(tuple, simhash.components(docs, radius=20).collect()), key=repr) == want
