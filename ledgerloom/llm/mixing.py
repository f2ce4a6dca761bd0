"""Mixing sources to target weights by a splitting tree of multivariate hypergeometric draws (operator 10).

Each source's words are cut into blocks: up to so many words of one document. A source takes part with a whole number
of blocks, its quota, by which its words come near its target; quotas above its number of blocks take every block once
and the rest a second time. A tree splits all quotas exactly among the output shards: at each node the left half's
blocks are a multivariate hypergeometric draw from what the node has. A source's blocks are permuted, once for each
time they are taken, and shard after shard takes its quota's next run of the permuted blocks. So the shards' blocks are
disjoint, every quota is met exactly, and no word is taken more than twice. Rows are shuffled inside each shard.

All draws and permutations follow from `seed`, the sources' names and the documents' order by (doc_id, text), so reruns
agree however rows are dealt out. Draws are exact at every size.

Rows that are alike are one row with a count until their blocks are dealt, so a document that most rows repeat is no hot
key. Texts are read once for their sizes; what follows handles a few numbers a document.

Null texts have no word and a document without a word is taken 0 times; a null source is a source, the last one; rows
with the same doc_id are separate documents; a source without a word has target 0; an empty table gives no row. Only
doc_id, source and text are read for the plan.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from decimal import Decimal, localcontext
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .quality_rules import words
from .shared import in_chunks, share_of, written

#: Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
#: Per cent of all words that the mix has, and the number of times a word is taken at most.
SHARE, MOST = 150, 2
#: A source is cut into this many blocks or more, unless they would be under a word; and blocks have so many words at most.
BLOCKS, BLOCK_WORDS = 8192, 2048
#: Words of an output shard, and shards at most.
SHARD_WORDS, MAX_SHARDS = 1 << 24, 4096
#: Numbers in the table of quotas by shard and source, which the driver draws and tasks get. With more sources there are
#: fewer shards, which are a matter of layout only; with one shard there is no such table.
CELLS = 1 << 21
#: Sources up to which their totals, a row each, are broadcast.
FEW_SOURCES = 100_000
#: Documents of one bucket of a source, which are numbered in one task; a source has as many buckets as it needs.
BUCKET = 2000
#: Copies of one row that are expanded in one piece.
COPIES = 1024


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target from source, source_size (one row a source).

    The mix has `share` per cent of all words. Sharing them by weight, holding sources at `most` times their size and
    sharing the excess again ends where each source has the lesser of that cap and its weight times one common level.
    The level follows from running sums over the sources by cap per weight. There is one row a source here, so windows
    without a key hold few rows.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.select("source", "source_size", weight.alias("w")).withColumn("cap", most * F.col("source_size").cast("double"))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, whole = by_cap.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.lit(share / 100.0) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    s = s.withColumn("level", level).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    # All sources up to the first that stays under its cap are at theirs; its level holds for it and all behind it.
    first = F.min(F.when(F.col("free"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("source").isNull().alias("z"), "source", "level"))).over(whole)
    return s.select("source", "source_size", F.when(first.isNull(), F.col("cap")).otherwise(F.least("cap", first["level"] * F.col("w"))).alias("target"))


def block_words(source_size: Column) -> Column:
    """Words of a source's blocks."""
    return F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(source_size / BLOCKS))).cast("long")


@cache
def _bernoulli(n: int) -> list[Decimal]:
    """The first n even Bernoulli numbers from B2 on."""
    from fractions import Fraction
    from math import comb

    b = [Fraction(1)]
    for m in range(1, 2 * n + 1):
        b.append(-sum(comb(m + 1, k) * b[k] for k in range(m)) / (m + 1))
    return [Decimal(b[2 * k].numerator) / Decimal(b[2 * k].denominator) for k in range(1, n + 1)]


def _log_factorial(n: int) -> Decimal:
    """ln n! to the precision of the context: Stirling's series from a number on where its terms vanish."""
    x, low = Decimal(n + 1), Decimal(1)
    while x < 64:
        low *= x
        x += 1
    out = (x - Decimal("0.5")) * x.ln() - x + Decimal("0.91893853320467274178032973640561763986139747363778341281")
    for k, b in enumerate(_bernoulli(12), 1):
        out += b / (2 * k * (2 * k - 1) * x ** (2 * k - 1))
    return out - low.ln()


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of `draws` are good, exactly distributed. Where numpy's generator ends (10^9), by ratio of uniforms under
    the usual table mountain around the mean, with probabilities to 40 digits; a third of the tries is refused, about."""
    n = good + bad
    if n < 10**9:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    with localcontext() as c:
        c.prec = 40
        ways = lambda k: -sum(_log_factorial(x) for x in (k, good - k, draws - k, bad - draws + k))
        top = ways(min(max((good + 1) * (draws + 1) // (n + 2), low), high))
        mean = Decimal(draws) * good / n
        spread = (mean * (n - good) / n * (n - draws) / max(1, n - 1) + Decimal("0.5")).sqrt()
        # Fixed values of the mountain: 2 sqrt(2/e) and 3 - 2 sqrt(3/e).
        width = Decimal("1.7155277699214135") * spread + Decimal("0.8989161620588988")
        while True:
            u, v = Decimal(1 - rng.random()), Decimal(rng.random())
            k = int((mean + Decimal("0.5") + width * (v - Decimal("0.5")) / u).to_integral_value("ROUND_FLOOR"))
            if low <= k <= high and 2 * u.ln() <= ways(k) - top:
                return k


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """quotas[source] split into [shard, source], exactly; shards get equal totals, give or take a block a level."""
    out = np.zeros((shards, len(quotas)), np.int64)
    nodes = [(0, shards, np.array(quotas, np.int64), 1)]
    while nodes:
        first, n, have, node = nodes.pop()
        if n == 1:
            out[first] = have
            continue
        rng, half, rest = np.random.default_rng([seed, node]), n // 2, int(have.sum())
        draws = rest * half // n
        if rest < 10**9:
            left = rng.multivariate_hypergeometric(have, draws, method="marginals") if rest else have
        else:
            left = np.zeros_like(have)
            for k, x in enumerate(have.tolist()):
                rest -= x
                left[k] = hypergeometric(rng, x, rest, draws) if x and draws else 0
                draws -= int(left[k])
        nodes += [(first, half, left, 2 * node), (first + half, n - half, have - left, 2 * node + 1)]
    return out


def permuted(block: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where a keyed permutation of range(n) puts each block: a Feistel network over the next even power of two, walked
    along until the value is in range again."""
    bits = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    low, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    keys = np.random.default_rng(key).integers(0, 2**63, 6).astype(np.uint64)
    out, todo = block.astype(np.uint64), np.arange(len(block))
    while len(todo):
        x = out[todo]
        a, b = x >> shift, x & low
        for k in keys:
            h = (b ^ k) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((h >> np.uint64(32)) & low)
        out[todo] = a << shift | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


PIECES = "array<struct<shard:int, slot:long, start:int, n_words:int>>"
PLAN = f"doc_id long, digest long, rest long, size long, source_size long, target double, taken long, pieces {PIECES}"


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _rest(docs: DataFrame) -> Column:
    """A hash of all columns but the text."""
    others = [F.col(f"`{x}`") for x in docs.columns if x != "text"]
    return F.xxhash64(F.to_json(F.struct(*others)))


def plan(docs: DataFrame, seed: int = 7) -> DataFrame:
    """For each document doc_id, digest (of its text), size, source_size, target, taken and its pieces: the words from
    `start` that shard `shard` takes, in `slot` of its source's permuted blocks."""
    return planned(docs, seed, F.lit(0).cast("long"))[0].drop("rest")


def planned(docs: DataFrame, seed: int, rest: Column) -> tuple[DataFrame, int]:
    """The plan, with `rest` to tell apart documents of equal doc_id, source and text, and the number of shards."""
    spark = docs.sparkSession
    source, of_source = F.col("source"), F.col("source").eqNullSafe(F.col("s"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), F.xxhash64(_text()).alias("digest"), rest.alias("rest"), F.size(words(_text())).cast("long").alias("size"))
    # Rows that are alike are counted before they move.
    sized = written(sized.groupBy("doc_id", "source", "digest", "rest", "size").agg(F.count("*").alias("copies")), "sizes")
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_docs"))
    goals = written(targets(totals).join(totals.select(source.alias("s"), "n_docs"), of_source).drop("s"), "targets").withColumnRenamed("source", "s")
    known = goals.agg(F.count("*").alias("n"), F.sum("target").alias("words")).first()
    # A row a source: broadcast up to a checked number of them, else as Spark sees fit.
    cut = sized.join(F.broadcast(goals) if known.n <= FEW_SOURCES else goals, of_source).drop("s")
    cut = cut.withColumn("width", block_words(F.col("source_size"))).withColumn("n_blocks", F.ceil(F.col("size") / F.col("width")).cast("long"))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "digest", "rest"), F.ceil(F.col("n_docs") / BUCKET)))
    per = cut.groupBy("source", "bucket").agg(F.sum(F.col("n_blocks") * F.col("copies")).alias("blocks"), F.max("source_size").alias("source_size"), F.max("target").alias("target"))
    # One row a bucket, of which there are as many as rows / BUCKET plus one a source.
    offset = F.coalesce(F.sum("blocks").over(W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = F.sum("blocks").over(W.partitionBy("source"))
    quota = F.when(F.col("source_size") > 0, F.least(MOST * F.col("n"), F.round(F.col("n") * F.col("target") / F.col("source_size")).cast("long"))).otherwise(F.lit(0).cast("long"))
    per = written(per.select(source.alias("s"), F.col("bucket").alias("b"), offset.alias("offset"), n.alias("n"), "target", "source_size").withColumn("quota", quota).drop("target", "source_size"), "buckets")
    shards = int(max(1, min(MAX_SHARDS, (known.words or 0) // SHARD_WORDS, CELLS // max(1, known.n))))
    shared = None
    if shards > 1:
        rows = per.groupBy("s").agg(F.max("quota").alias("quota")).orderBy(F.col("s").asc_nulls_last()).collect()  # CELLS / 2 at most
        shared = spark.sparkContext.broadcast(({r.s: k for k, r in enumerate(rows)}, split_quotas([r.quota for r in rows], shards, seed).cumsum(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = {k: batch.column(k) for k in batch.schema.names}
            first, count, width, size, all_blocks, quota = (d[k].to_numpy() for k in ("first_block", "n_blocks", "width", "size", "n", "quota"))
            names = d["source"].dictionary_encode()
            values = [*names.dictionary.to_pylist(), None]
            source = names.indices.fill_null(len(values) - 1).to_numpy()
            doc = np.repeat(np.arange(len(count)), count)
            inner = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            found = []
            for s in np.unique(source).tolist():
                mine = np.flatnonzero(source[doc] == s)
                if not len(mine):
                    continue
                name, n, goal = values[s], int(all_blocks[doc[mine[0]]]), int(quota[doc[mine[0]]])
                key = zlib.crc32(f"{seed}:{name is None}:{name}".encode())
                for turn in range(-(-goal // max(1, n))):
                    slot = turn * n + permuted(first[doc[mine]] + inner[mine], n, key + turn)
                    taken = slot < goal
                    if shared:
                        place, ends = shared.value
                        shard = np.searchsorted(ends[:, place[name]], slot[taken], "right")
                    else:
                        shard = np.zeros(int(taken.sum()), np.int64)
                    found.append((doc[mine][taken], shard, slot[taken], inner[mine][taken]))
            got = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 4
            by = np.lexsort((got[3], got[2], got[0]))
            at, shard, slot, block = (x[by].astype(np.int64) for x in got)
            start = block * width[at]
            n_words = np.minimum(width[at], size[at] - start)
            struct = pa.StructArray.from_arrays([pa.array(shard, pa.int32()), pa.array(slot, pa.int64()), pa.array(start, pa.int32()), pa.array(n_words, pa.int32())], ["shard", "slot", "start", "n_words"])
            pieces = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(len(count) + 1)), pa.int32()), struct)
            taken = np.bincount(at, n_words, len(count)).astype(np.int64)
            same = ["doc_id", "digest", "rest", "size", "source_size", "target"]
            yield pa.RecordBatch.from_arrays([*(d[x] for x in same), pa.array(taken), pieces], [*same, "taken", "pieces"])

    in_bucket = W.partitionBy("source", "bucket").orderBy("doc_id", "digest", "rest").rowsBetween(W.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("n_blocks") * F.col("copies")).over(in_bucket), F.lit(0))
    numbered = cut.withColumn("inside", inside).join(per, of_source & (F.col("bucket") == F.col("b")))
    same = ["doc_id", "source", "digest", "rest", "size", "source_size", "target", "width", "n_blocks", "n", "quota"]
    ready = numbered.select(*same, (F.col("offset") + F.col("inside")).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))).alias("from"), "copies")
    if sized.where(F.col("copies") > COPIES).take(1):  # a row's copies become many tasks' work
        ready = ready.repartition("doc_id", "digest", "rest", "from")
    copy = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + COPIES, F.col("copies")) - 1))
    ready = ready.select(*same, "first", copy.alias("copy")).select(*same, (F.col("first") + F.col("copy") * F.col("n_blocks")).alias("first_block"))
    return ready.mapInArrow(run, PLAN), shards


def sizes_and_taken(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return plan(docs, seed).select("doc_id", "size", "source_size", "target", "taken")


def take(text: str, pieces: list[tuple[int, int]], size: int) -> str:
    """The words of `pieces` (start, n_words), with what stands between them; apart pieces are put on lines of their own."""
    if sum(n for _, n in pieces) == size and len({a for a, _ in pieces}) == len(pieces):
        return text
    spans = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    runs: list[list[int]] = []
    for a, n in sorted(pieces):
        if runs and runs[-1][1] == a:
            runs[-1][1] = a + n
        else:
            runs.append([a, a + n])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)


def mixed(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix, with the columns of `docs`: a row for each shard and time that a document is taken, its text the words
    taken. A column n_chars, if there is one, follows the text. A shard's rows lie together in a few partitions, shuffled.

    A text moves twice: to its plan, and to its shard. What else a row has moves beside it, without the text.
    """
    columns = docs.columns
    pieces, shards = planned(docs, seed, _rest(docs))
    pieces = written(pieces.where("taken > 0"), "mix-plan")
    key = ["digest", "rest"]
    row = F.struct(*[F.col(f"`{x}`") for x in columns if x != "text"]).alias("row")
    own = docs.select(row, _text().alias("text"), F.xxhash64(_text()).alias("digest"), _rest(docs).alias("rest"))
    often = pieces.groupBy(*key).agg(F.count("*").alias("copies"))
    hot, hot_rows = often.where(F.col("copies") > share_of(pieces)), None
    if hot.take(1):  # a bounded number of rows, as each is more than a given share of all
        # Of rows that are alike one is enough; it goes to as many tasks as its copies need.
        once = own.join(F.broadcast(hot), key, "left_semi").groupBy(*key).agg(F.first(F.struct("row", "text")).alias("one"))
        parts = once.join(F.broadcast(hot), key).select(*key, "one", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("copies") / COPIES))).alias("part"))
        dealt = pieces.join(F.broadcast(hot), key).withColumn("part", F.pmod(F.xxhash64("pieces"), F.floor(F.col("copies") / COPIES) + 1))
        hot_rows = parts.join(dealt.select(*key, "part", "size", "pieces"), [*key, "part"]).select("one.row", "one.text", "size", "pieces")
        own, pieces = (x.join(F.broadcast(hot), key, "left_anti") for x in (own, pieces))
    # The k-th of rows that are alike gets the k-th of their plans; which is which makes no difference.
    lists = pieces.groupBy(*key).agg(F.max("size").alias("size"), F.collect_list("pieces").alias("plans"))
    number = F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0)))
    joined = own.withColumn("number", number).join(lists, key).withColumn("pieces", F.try_element_at("plans", F.col("number"))).where("pieces IS NOT NULL")
    joined = joined.select("row", "text", "size", "pieces")
    if hot_rows is not None:
        joined = joined.union(hot_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in in_chunks(batches, 64):
            index, shards, texts = [], [], []
            for k, (text, size, pieces) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                times: dict[tuple[int, int], list[tuple[int, int]]] = {}
                seen: dict[int, int] = {}
                for x in sorted(pieces, key=lambda x: x["slot"]):
                    turn = seen[x["start"]] = seen.get(x["start"], -1) + 1
                    times.setdefault((turn, x["shard"]), []).append((x["start"], x["n_words"]))
                for (_, shard), got in sorted(times.items()):
                    index.append(k)
                    shards.append(shard)
                    texts.append(take(text, got, size))
            rows = part.column(0).take(pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(shards, pa.int32()), pa.array(texts, pa.string())], ["row", "shard", "text"])

    out = joined.mapInArrow(run, f"row {joined.schema['row'].dataType.simpleString()}, shard int, text string")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.xxhash64(F.lit(seed), F.to_json("row"), "text")
    out = out.withColumn("salt", salt).repartition(count, "shard", F.pmod("salt", F.lit(-(-count // shards)))).sortWithinPartitions("shard", "salt")
    fresh = {"text": F.col("text"), "n_chars": F.char_length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return out.select(*[fresh[x].alias(x) if x in fresh else F.col(f"row.`{x}`").alias(x) for x in columns])
