"""The pipeline's stage of near copies against brute force over exact Jaccard similarity."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from ledgerloom.llm import near_copies

D = "/root/testdata/sf0.001"


def jaccard(a: str, b: str) -> float:
    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y)


def least_ids(rows: list[tuple[int, str]]) -> list[int]:
    """The smallest id of each component of links, by all pairs."""
    label = {i: i for i, _ in rows}
    for (i, a), (j, b) in combinations(rows, 2):
        if label[i] != label[j] and jaccard(a, b) >= 0.8:
            low, high = sorted((label[i], label[j]))
            label = {k: low if v == high else v for k, v in label.items()}
    return sorted(set(label.values()))


def variants(seed: int) -> list[tuple[int, str]]:
    """Texts of 120 words, each with copies in which 1 to 8 words differ, and chains of copies of copies."""
    draw, rows = random.Random(seed), []
    for _ in range(6):
        words = [f"w{draw.randrange(5000)}" for _ in range(120)]
        rows.append(words)
        for n in range(1, 9):
            copy = (words if n % 2 else rows[-1])[:]
            for at in draw.sample(range(120), n):
                copy[at] = f"x{draw.randrange(5000)}"
            rows.append(copy)
    return [(k, " ".join(x)) for k, x in enumerate(rows)]


def test_same_as_brute_force(spark):
    rows = variants(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_ids(rows)
    assert 6 < len(want) < len(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_same_as_brute_force_on_documents(spark):
    docs = corpus_pipeline.quality(spark, spark.read.parquet(f"{D}/documents.parquet"), D).persist()
    want = least_ids([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, D).collect()) == want


def test_borders():
    a = near_copies.shingles(" ".join(f"w{k}" for k in range(14)).encode())
    assert len(a) == 10 and near_copies.similar(a, a[:8]) and not near_copies.similar(a, a[:7])
    assert len(near_copies.shingles(b"")) == 1 and (near_copies.shingles(b" A  b\n") == near_copies.shingles(b"a B")).all()


def test_null_and_repeated_ids(spark):
    draw = random.Random(2)
    words = [[f"w{draw.randrange(5000)}" for _ in range(60)] for _ in range(8)]
    texts = [" ".join(x) for x in words]
    near = " ".join([*words[0][:-1], "other"])
    # Different texts without id, and a copy of one that has an id; different texts of one id, one of them a copy.
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[2]), (7, texts[2]), (5, texts[3]), (5, texts[4]), (1, near), (5, near), (5, texts[5]), (5, texts[5]), (None, texts[6]), (None, texts[6]), (None, None), (None, None)]
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, _id int")
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(1, near), (None, texts[1]), (7, texts[2]), (5, texts[3]), (5, texts[4]), (5, texts[5]), (None, texts[6]), (None, None)], key=repr)


def test_fingerprints_of_similar_texts_are_near():
    """Sets of every small size and of some large ones, at the least similarity that is linked: well inside the radius."""
    draw = np.random.default_rng(3)
    far = 0
    for n, more in [(4, 1), (8, 2), (9, 2), (12, 3), (40, 10), (400, 100)] * 40:
        a = np.unique(draw.integers(0, 1 << 64, n + more, np.uint64))
        both, first = a[:n], more // 2 if n > 4 else 0
        x, y = np.sort(np.concatenate([both, a[n : n + first]])), np.sort(np.concatenate([both, a[n + first :]]))
        assert near_copies.similar(x, y)
        far = max(far, int((np.unpackbits(near_copies.fingerprint(x).view(np.uint8)) != np.unpackbits(near_copies.fingerprint(y).view(np.uint8))).sum()))
    assert 30 < far <= near_copies.RADIUS - 8


def test_pairs_by_bit_planes():
    """Wide fingerprints in buckets of all sizes, against all pairs."""
    draw = np.random.default_rng(4)
    fps = draw.integers(0, 1 << 64, (300, 4), np.uint64)
    fps[1::3] = fps[::3] ^ (draw.integers(0, 1 << 64, (100, 4), np.uint64) & draw.integers(0, 1 << 64, (100, 4), np.uint64) & draw.integers(0, 1 << 64, (100, 4), np.uint64))
    group, root = np.sort(draw.integers(0, 9, 300)), np.arange(300) // 2
    got = {(int(a), int(b)) for x, y in near_copies.near_pairs(group, fps.view(np.int64), 40, root) for a, b in zip(x, y, strict=True)}
    bits = np.unpackbits(fps.view(np.uint8), axis=1)
    want = {(a, b) for a, b in combinations(range(300), 2) if group[a] == group[b] and root[a] != root[b] and (bits[a] != bits[b]).sum() <= 40}
    assert got == want and want


def test_a_bucket_of_many_groups(spark, monkeypatch):
    """Texts that share most of their words but are no near copies, in several groups, with small tiles and fans."""
    monkeypatch.setattr(near_copies, "TILE", 8000)
    monkeypatch.setattr(near_copies, "FAN", 3)
    draw, rows = random.Random(6), []
    common = [f"w{k}" for k in range(100)]
    for g in range(8):
        words = common + [f"g{g}x{k}" for k in range(35)]
        for _ in range(6):
            copy = words[:]
            copy[draw.randrange(100, 135)] = f"y{draw.randrange(99)}"
            rows.append((len(rows), " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = least_ids(rows)
    assert len(want) == 8
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want


def test_heads_are_compared_by_bit_planes(spark, monkeypatch):
    """A similar pair whose fingerprints are beyond the radius is not confirmed; within it, only similar ones are."""
    words = [f"w{k}" for k in range(100)]
    texts = [" ".join([*words, f"x{k}"]) for k in range(150)] + [" ".join(words[k:] + words[:k]) for k in (20, 50)] + [" ".join(f"v{k}" for k in range(100))]
    found = [near_copies.shingles(x.encode()) for x in texts]
    prints = [near_copies.fingerprint(x) for x in found]
    sets = spark.createDataFrame([(k, bytearray(prints[k].tobytes()), bytearray(x.tobytes())) for k, x in enumerate(found)], "node long, fp binary, found binary")
    every = [(0, k) for k in range(1, len(texts))] + [(1, 2), (151, 152)]
    pairs = spark.createDataFrame(every, "a long, b long")
    bits = [np.unpackbits(x.view(np.uint8)) for x in prints]
    far = {(a, b): int((bits[a] != bits[b]).sum()) for a, b in every}
    for radius in (near_copies.RADIUS, int(np.median([far[x] for x in every]))):
        monkeypatch.setattr(near_copies, "RADIUS", radius)
        got = sorted(map(tuple, near_copies.confirmed(pairs, sets).collect()))
        want = sorted(x for x in every if far[x] <= radius and near_copies.similar(found[x[0]], found[x[1]]))
        assert got == want and 0 < len(got) < len(every)
