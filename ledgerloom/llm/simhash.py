"""SimHash near-duplicates by bit-sliced comparison (operator 7).

A fingerprint has a bit for each of 64 that is set in over half the hashes of a text's word shingles. Texts are linked
if their fingerprints differ in a few bits at most, and components of links are found. Work is done on distinct
fingerprints, so a group of copies of any size is one row.

Candidates: the 64 bits are cut into blocks, more than the radius, so linked fingerprints agree in all but `radius`
blocks at least. For each choice of blocks to leave out, fingerprints that agree in the others form a bucket. No link
is lost, as all buckets are compared in full; one of more than `TILE` rows is split into chunks, and each pair of
chunks is a task's work of its own. More blocks give more and smaller buckets, so their number follows the number of
fingerprints.

Comparison: the fingerprints of a bucket lie in bit planes, 64 of them to a machine word. One fingerprint is compared
with a word's 64 at once: eight planes at a time are added by carry-save adders, three planes to a sum and a carry, to
counters that are themselves bit planes. When all 64 have passed the radius, the word is abandoned.

Null texts and texts without a word have fingerprint 0 and are linked like any others; shorter texts than a shingle are
one shingle; a text of any length counts in full; rows with the same doc_id are separate rows; a null doc_id never
names a component unless the component has no other; an empty table gives no row. Only doc_id and text are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh_folder, in_chunks, joined_by, remove, share_of, utf8, written

#: Fingerprints of one bucket that are compared in one piece; a larger bucket is split into pairs of chunks.
TILE = 2048
#: The number of blocks is the least by which a bucket of evenly spread fingerprints has no more rows than this.
BUCKET = 1024
#: Rows that a task compares at once, and pairs of a row and a word.
SLAB, STEP = 1 << 17, 1 << 16
#: Words with hits that are unpacked at once.
HITS = 1 << 11


def fingerprint(text: bytes, width: int = 4) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(x) + 1 for x in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    counts, total = np.zeros(64, np.int64), max(1, len(words) - width + 1)
    last = ends[width - 1 :] or ends[-1:]
    for at in range(0, total, 1 << 15):
        h = [digest(flat[a:b], 42) for a, b in zip(starts[at : at + (1 << 15)], last[at : at + (1 << 15)], strict=False)]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches):
            found = [fingerprint(x, width) for x in utf8(part.column(1))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_masks(n: int, radius: int) -> list[int]:
    """For each table of buckets the bits that its rows agree in."""
    blocks = radius + 1
    while n > BUCKET * 2 ** (64 * (blocks - radius) / blocks) and blocks < 2 * radius + 4:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << bit for bit in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - radius)]


def planes(fps: np.ndarray) -> np.ndarray:
    """Row b has bit b of all fingerprints, 64 to a word; the last word is filled up with zeros. fps has a row for each
    fingerprint, of one or more 64-bit words."""
    fps = fps.reshape(len(fps), -1)
    n, parts = fps.shape
    bits = np.zeros((-(-n // 64) * 64, 64 * parts), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view("<u8")


def near_lanes(sliced: np.ndarray, queries: np.ndarray, words: np.ndarray, radius: int) -> np.ndarray:
    """For each query fingerprint and word of 64 others, the lanes (bits of the result) within `radius` of it."""
    queries = queries.reshape(len(queries), -1)
    near = np.zeros(len(queries), np.uint64)
    live = np.arange(len(queries))
    n_counters = max(3, (radius + 1).bit_length())
    counters = [np.zeros(len(queries), np.uint64) for _ in range(n_counters)]
    over = np.zeros(len(queries), np.uint64)
    full, one = np.uint64(2**64 - 1), np.uint64(1)

    def beyond() -> np.ndarray:
        """Lanes whose counters hold more than the radius."""
        more, same = np.zeros_like(over), np.full_like(over, full)
        for k in reversed(range(n_counters)):
            if radius >> k & 1:
                same &= counters[k]
            else:
                more |= same & counters[k]
                same &= ~counters[k]
        return more

    def differs(bit: int) -> np.ndarray:
        return sliced[bit][words] ^ (np.uint64(0) - (queries[:, bit >> 6] >> np.uint64(bit & 63) & one))

    def two_more(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Save the sum of two more planes in counter k; their carry, of twice the weight, isn't added up yet."""
        half = counters[k] ^ x
        carry = counters[k] & x | half & y
        counters[k] = half ^ y
        return carry

    for bit in range(0, len(sliced), 8):
        fours = []
        for at in (bit, bit + 4):
            twos = [two_more(0, differs(at + k), differs(at + k + 1)) for k in (0, 2)]
            fours.append(two_more(1, *twos))
        carry = two_more(2, *fours)
        for k in range(3, n_counters):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        over |= beyond()
        stay = np.flatnonzero(over != full)
        if bit + 8 >= len(sliced):
            near[live] = ~over
        elif len(stay) < 0.75 * len(live):
            live, words, queries, over = live[stay], words[stay], queries[stay], over[stay]
            counters = [c[stay] for c in counters]
            if not len(live):
                break
    return near


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that links (a, b) join it to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def near_pairs(group: np.ndarray, fps: np.ndarray, radius: int, other: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (a, b), a < b, of fingerprints within `radius` in each run of equal `group`, piece by piece; with `other`
    only those of different values of it."""
    n = len(fps)
    cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    ends = np.repeat(np.concatenate([cut[1:], [n]]), np.diff(np.concatenate([cut, [n]])))
    rows = np.flatnonzero(ends - np.arange(n) > 1)  # each is compared with those after it
    if not len(rows):
        return
    sliced, queries = planes(fps), np.ascontiguousarray(fps).view(np.uint64).reshape(len(fps), -1)
    first, last = rows + 1 >> 6, ends[rows] - 1 >> 6
    total = last - first + 1
    bounds = np.searchsorted(np.cumsum(total), np.arange(STEP, total.sum() + STEP, STEP), "left") + 1
    at = 0
    for to in bounds.tolist():
        part, count = rows[at:to], total[at:to]
        if len(part):
            row = np.repeat(part, count)
            word = np.repeat(first[at:to], count) + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            near = near_lanes(sliced, queries[row], word, radius)
            hit = np.flatnonzero(near)
            for some in (hit[k : k + HITS] for k in range(0, len(hit), HITS)):
                lanes = np.unpackbits(near[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                which, lane = np.nonzero(lanes)
                a, b = row[some][which], word[some][which] * 64 + lane
                good = (b > a) & (b < ends[a])
                a, b = a[good], b[good]
                if other is not None:
                    good = other[a] != other[b]
                    a, b = a[good], b[good]
                yield a, b
        at = to


def within(one: np.ndarray, fps: np.ndarray, radius: int) -> np.ndarray:
    """Places of the fingerprints within `radius` of a given one, by bit planes."""
    words = np.arange(-(-len(fps) // 64))
    near = near_lanes(planes(fps), np.repeat(np.ascontiguousarray(one).view(np.uint64).reshape(1, -1), len(words), 0), words, radius)
    return np.flatnonzero(np.unpackbits(near.astype("<u8").view(np.uint8), bitorder="little")[: len(fps)])


def linked(group: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the components of each run of equal `group`: a fingerprint and a smaller-numbered one of its run."""
    pairs = list(near_pairs(group, fps, radius))
    if not pairs:
        return fps[:0], fps[:0]
    label = forest(np.concatenate([a for a, _ in pairs]), np.concatenate([b for _, b in pairs]), len(fps))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def tiled(keyed: DataFrame, keys: list[str], row: str, columns: list[str], size: Column | None = None, tile: int | None = None) -> DataFrame:
    """Column group and `columns` of `keyed`, dealt and sorted so that each group lies in one task. A group is a bucket (the
    rows of equal `keys`) of up to `tile` rows, or up to so much of their `size`; a larger bucket is split by `row` into
    chunks, and each pair of chunks is a group, so all pairs of rows of a bucket meet in some group."""
    size, tile = F.lit(1) if size is None else size, tile or TILE
    # Only keys of large buckets come here. Whether they are few enough to broadcast is measured at run time.
    large = keyed.groupBy(*keys).agg(F.sum(size).alias("n")).where(F.col("n") > tile).select(*keys, F.ceil(F.col("n") / tile).cast("int").alias("g"))
    parts = keyed.join(large, keys, "left").withColumn("g", F.coalesce("g", F.lit(1)))
    chunk = F.pmod(F.xxhash64(row), F.col("g")).cast("int")
    parts = parts.withColumn("own", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    # A rare clash of two groups only adds comparisons.
    group = F.xxhash64(*keys, F.least("own", "other"), F.greatest("own", "other")).alias("group")
    count = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parts.select(group, *columns).repartition(count, "group").sortWithinPartitions("group")


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns (longs) of batches sorted by the first one, about SLAB rows at a time, no group cut in two."""
    held: list[np.ndarray] = []
    for batch in batches:
        new = [x.to_numpy() for x in batch.columns]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)] if held else new
        if len(held[0]) >= SLAB:
            cut = int(np.searchsorted(held[0], held[0][-1], "left"))  # the last group may go on
            if cut:
                yield [x[:cut] for x in held]
                held = [x[cut:] for x in held]
    if held and len(held[0]):
        yield held


def links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """a, b: links between different fingerprints (column fp), enough to join all that are within `radius`."""
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(x - (1 << 64) if x >> 63 else x)).alias("key")) for t, x in enumerate(bucket_masks(n, radius))]
    keyed = distinct.select("fp", F.explode(F.array(*tables)).alias("x")).select("fp", "x.t", "x.key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, fps in whole_groups(batches):
            a, b = linked(group, fps, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tiled(keyed, ["t", "key"], "fp", ["fp"]).mapInArrow(run, "a long, b long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """node, root: for each node of the links (a, b) the least node of its component.

    Large-star and small-star steps in turn, each step's links written in the shared folder, until nothing changes.
    Minima are aggregated before the shuffle; the links of a hub, which has more than its share of all, stay where they
    are when the minimum is brought back.
    """
    spark, edges, path, before = edges.sparkSession, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), None, None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        limit = share_of(edges)
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = joined_by(both, low, "u", "n", limit).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = joined_by(large, low, "u", "n", limit).select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        old, path = path, fresh_folder(spark, "stars")
        small.select("x.u", "x.v").where(F.col("u") != F.col("v")).distinct().write.parquet(path)
        edges = spark.read.schema("u long, v long").parquet(path)
        if old:
            remove(spark, old)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def components(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach from a document, itself included."""
    prints = written(fingerprints(docs, width), "prints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "distinct-prints")
    edges = written(links(distinct, radius, distinct.count()), "links")
    if edges.take(1):
        roots = stars(edges)
        roots = written(roots.union(roots.select(F.col("root"), F.col("root")).distinct()).toDF("fp", "root"), "roots")
        per = written(roots.join(distinct, "fp").groupBy("root").agg(F.min("first_doc").alias("least"), F.count("*").alias("nodes")), "roots")
        named = distinct.join(joined_by(roots, per, "root", "nodes", share_of(roots)).select("fp", "least"), "fp", "left")
        distinct = named.select("fp", F.coalesce("least", "first_doc").alias("first_doc"), "n")
    # The rows of a fingerprint that more than its share of all have, exact copies, stay where they are.
    distinct = distinct.withColumnRenamed("first_doc", "component_id")
    return joined_by(prints, distinct, "fp", "n", share_of(prints)).select("doc_id", "fp", "component_id")


def hex_digits(fp) -> Column:
    """A fingerprint column as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
