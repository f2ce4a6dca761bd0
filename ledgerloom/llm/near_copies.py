"""SimHash near-duplicates by similarity of word shingles: operator 7 as the pipeline uses it.

A text's shingles are its runs of five words, lower-cased (a shorter text is one). Two texts are linked if the Jaccard
similarity of their sets of shingles is 0.8 at least; groups are the components of links. Work is done on distinct texts,
each named by its 64-bit hash (`node`), so copies of any number are one row and a row's doc_id plays no part.

Fingerprints have 256 bits here, from the set of shingles. Of two texts of similarity 0.8 each bit differs with probability
0.1875 at most (sets of four and five shingles, by counting; 0.15 for large sets), of unrelated ones with 0.5. So linked
texts are `RADIUS` = 80 bits apart or less but for one pair in 10^6, while unrelated ones are 128 apart, give or take 8.

At such a radius no choice of agreeing blocks is a bucket: of 256 bits 176 agree, and all blocks of useful size may differ.
So the buckets are those of texts that agree in the minima of five permutations of their shingles, for 32 choices of
five; a pair of similarity 0.8 shares no bucket with probability 3e-6, a more similar one with less. In a bucket all
texts are compared with one of them, which takes in most copies. Buckets that are not one group then are compared in full,
a tile in one task, each pair in the first bucket that it shares. Both are comparisons of fingerprints by bit planes with
carry-save adders and abandonment, as in `simhash`. Pairs within the radius are confirmed by the exact similarity of their shingles there and then, unless they are
in one group already, so there are no false links, and what leaves a tile is a forest and no list of pairs.

Null texts and texts without a word have one and the same empty shingle. Only column text is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_folder, in_chunks, remove, utf8, written
from .simhash import near_pairs, stars, tiled, within

WIDTH, BANDS, MINIMA = 5, 32, 5
#: Least similarity of linked texts, as a fraction, so that it is compared without rounding.
LEAST = (4, 5)
#: 64-bit words of a fingerprint, and bits in which those of linked texts differ at most.
PARTS, RADIUS = 4, 80
#: Pairs with one text that one task confirms.
FAN = 256
#: Bytes of shingles, about, in a chunk of a bucket; a task compares two chunks at a time.
TILE = 1 << 23
_draws = np.random.default_rng(5).integers(0, 1 << 64, (4, BANDS * MINIMA), np.uint64)
MASKS, FACTORS, WEIGHTS = _draws[0], _draws[1] | np.uint64(1), (_draws[2] | np.uint64(1)).reshape(BANDS, MINIMA)
TURNS = _draws[3, :PARTS] | np.uint64(1)
#: Shingles whose hashes are mapped at once.
SLAB = 1024


def node() -> Column:
    """A text's name; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; one at least."""
    import xxhash

    words, digest = text.lower().split(), xxhash.xxh64_intdigest
    flat = b" ".join(words)
    ends = np.cumsum([len(x) + 1 for x in words], dtype=np.int64)
    starts, ends = [0, *ends[:-1].tolist()], (ends - 1).tolist()
    last = ends[width - 1 :] or ends[-1:] or [0]
    return np.unique(np.array([digest(flat[a:b], 42) for a, b in zip(starts, last, strict=False)], np.uint64))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """256 bits, each set if it is in over half the hashes of a set of shingles; hashes are turned anew for each 64."""
    counts = np.zeros(64 * PARTS, np.int64)
    for at in range(0, len(found), SLAB):
        h = (found[at : at + SLAB, None] ^ (found[at : at + SLAB, None] >> np.uint64(32))) * TURNS
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        counts += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<i8")


def bands(found: np.ndarray) -> np.ndarray:
    """A number for each band of minima; texts that agree in one share a bucket."""
    least = np.full(BANDS * MINIMA, np.uint64(2**64 - 1))
    for at in range(0, len(found), SLAB):
        np.minimum(least, ((found[at : at + SLAB, None] ^ MASKS) * FACTORS).min(0), out=least)
    return (least.reshape(BANDS, MINIMA) * WEIGHTS).sum(1, dtype=np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if small * LEAST[1] < large * LEAST[0]:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LEAST[1] >= (small + large - both) * LEAST[0]


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose fingerprints are within the radius, by bit planes, and that are similar. The set of a
    goes once to each task that has up to about `FAN` of its pairs, ahead of the sets they are compared with, so one text
    with any number of pairs is many tasks' work."""
    fans = F.ceil(F.col("n") / FAN)
    of_a = pairs.groupBy("a").agg(F.count("*").alias("n"))
    heads = of_a.select("a", F.explode(F.sequence(F.lit(0).cast("long"), fans - 1)).alias("fan")).join(sets.toDF("a", "fp", "found"), "a").select("a", "fan", F.lit(None).cast("long").alias("b"), "fp", "found")
    dealt = pairs.join(of_a.where(F.col("n") > FAN), "a", "left").withColumn("fan", F.pmod(F.xxhash64("b"), F.coalesce(fans, F.lit(1).cast("long"))))
    rows = heads.unionByName(dealt.join(sets.toDF("b", "fp", "found"), "b").select("a", "fan", "b", "fp", "found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, print_, mine = None, np.empty(0, np.int64), np.empty(0, np.uint64)
        for part in in_chunks(batches):
            firsts, seconds, data = part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(4)
            fps = np.frombuffer(b"".join(part.column(3).to_pylist()), np.int64).reshape(-1, PARTS)
            good = np.zeros(len(firsts), bool)
            cuts = [0, *(k for k, y in enumerate(seconds) if y is None), len(firsts)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if to > at and seconds[at] is None:
                    head, print_, mine, at = firsts[at], fps[at], np.frombuffer(data[at].as_py(), np.uint64), at + 1
                for k in at + within(print_, fps[at:to], RADIUS) if to > at else ():
                    good[k] = firsts[k] == head and similar(mine, np.frombuffer(data[int(k)].as_py(), np.uint64))
            yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    count = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first()).mapInArrow(run, "a long, b long")


def links_of_tile(nodes: np.ndarray, roots: np.ndarray, fps: np.ndarray, of_bands: np.ndarray, band: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the similar pairs of a tile: nodes, and the least node that each is linked to."""
    size, (_, label) = np.array([len(x) for x in sets]), np.unique(roots, return_inverse=True)
    left, right, known = [], [], label.max() + 1
    for a, b in near_pairs(np.zeros(len(nodes), np.int64), fps, RADIUS, label):
        fits = np.minimum(size[a], size[b]) * LEAST[1] >= np.maximum(size[a], size[b]) * LEAST[0]
        # The first band that both agree in is this one, or another bucket compares them.
        fits[fits] = of_bands[a[fits], (of_bands[a[fits]] == of_bands[b[fits]]).argmax(1)] == band
        for x, y in zip(a[fits].tolist(), b[fits].tolist(), strict=True):
            if label[x] != label[y] and similar(sets[x], sets[y]):
                left.append(x)
                right.append(y)
                label = np.where(label == label[y], label[x], label)
                known -= 1
        if known == 1:
            break
    return nodes[left], nodes[right]


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of batches sorted by their first column, one of its values at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        group = batch.column(0).to_numpy()
        cuts = np.flatnonzero(group[1:] != group[:-1]) + 1
        for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
            if to > at:
                if held and held[0].column(0)[0].as_py() != group[at]:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                held.append(batch.slice(at, to - at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def groups(docs: DataFrame) -> DataFrame | None:
    """node, root: for each text that is linked to another one the least node of its group. None if there is no link."""
    texts = docs.select(node().alias("node"), F.col("text").cast("string").alias("text"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches):
            found = [bands(shingles(x)) for x in utf8(part.column(1))]
            flat = pa.array(np.concatenate(found) if found else np.empty(0, np.int64), pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), lists], ["node", "bands"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches):
            found = [shingles(x) for x in utf8(part.column(1))]
            columns = [[fingerprint(x).tobytes() for x in found], [bands(x).tobytes() for x in found], [x.tobytes() for x in found]]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.binary()) for x in columns)], ["node", "fp", "bands", "found"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in tiles(batches):
            _, band, nodes, roots = (x.to_numpy() for x in tile.columns[:4])
            fps, of_bands, sets = (x.to_pylist() for x in tile.columns[4:])
            fps, of_bands = (np.frombuffer(b"".join(x), np.int64).reshape(len(x), -1) for x in (fps, of_bands))
            for one in np.unique(band):  # one, but for a rare clash of two groups
                mine = np.flatnonzero(band == one)
                a, b = links_of_tile(nodes[mine], roots[mine], fps[mine], of_bands[mine], int(one), [np.frombuffer(sets[k], np.uint64) for k in mine])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], ["a", "b"])

    spark, paths = docs.sparkSession, []

    def held(df: DataFrame, name: str) -> DataFrame:
        """Written like any intermediate table, but removed when the groups are known."""
        paths.append(fresh_folder(spark, name))
        df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    def end(roots: DataFrame | None) -> DataFrame | None:
        for path in paths:
            remove(spark, path)
        return roots

    sketches = held(texts.mapInArrow(sketch, "node long, bands array<long>"), "bands")
    keyed = sketches.dropDuplicates(["node"]).select("node", F.explode("bands").alias("band"))
    heads = keyed.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head != tail").select("band", "head")
    shared = held(keyed.join(heads, "band").select("band", "node", "head"), "buckets")
    if not shared.take(1):
        return end(None)
    # Copies of a text are cut to one before they move.
    once = texts.dropDuplicates(["node"]).join(shared.select("node").distinct(), "node", "left_semi")
    sets = held(once.select("node", "text").mapInArrow(whole, "node long, fp binary, bands binary, found binary"), "shingles")
    first = shared.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    edges = held(confirmed(held(first, "pairs"), sets.select("node", "fp", "found")), "links")
    roots = rooted(edges)
    named = shared.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    still = named.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("band")
    rest = named.join(still, "band").join(sets, "node")
    rest = tiled(rest, ["band"], "node", ["band", "node", "root", "fp", "bands", "found"], F.octet_length("found") + 512, TILE)
    more = held(rest.mapInArrow(compare, "a long, b long"), "links")
    if more.take(1):
        roots = rooted(edges.union(more))
    return end(roots if roots.take(1) else None)


def rooted(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each node's group, for the least one itself as well."""
    if not edges.take(1):
        return edges.toDF("node", "root")
    roots = stars(edges)
    return written(roots.union(roots.select(F.col("root"), F.col("root")).distinct()).toDF("node", "root"), "roots")
