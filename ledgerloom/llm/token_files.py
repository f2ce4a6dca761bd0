"""Token ids of documents in bit-packed files (operator 1).

Texts are encoded with the tokenizers library, an end id is appended to each document, and the ids go to segment
files in ascending doc_id order. An id takes the minimum number of bits that the vocabulary needs.

A segment file is, with little-endian integers throughout:

    magic "LLSEG1\\0\\0" | bits u32 | block_ids u32 | n_docs u64 | n_ids u64 | n_blocks u64 |
    block offsets u64 x (n_blocks + 1), from the start of the file | document ends u64 x n_docs, in ids |
    doc_id i64 x n_docs | doc_id is null u8 x n_docs | blocks

A block holds `block_ids` ids (the last one fewer), id k in bits k * bits up to (k + 1) * bits, lowest bit first, and
starts on a byte. So any range of ids is read by seeking to a block and unpacking it with numpy.

Null texts count as empty and yield the end id alone; rows with a null doc_id come first; rows with the same doc_id
stay separate documents, in the order of their ids; an empty table gives no file and no row. Only doc_id and text are
read, so further columns of any name do no harm. A text of any length is encoded whole.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import fresh_folder, in_chunks, utf8, written

MAGIC = b"LLSEG1\0\0"
HEAD = struct.Struct("<8sIIQQQ")
#: Cached words of a Python worker at most; beyond, those that the present slice does not use go.
CACHE = 500_000
#: Words that the library gets at once.
JOINED = 200
#: Bytes that can end a word and never take part in a contraction: ASCII punctuation but the apostrophe.
TAIL = bytes(x for x in range(33, 127) if not chr(x).isalnum() and chr(x) != "'")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell `vocabulary` ids apart."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as `bits` bits each, lowest bit first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    wide = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of what `pack` wrote."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int, block_ids: int) -> bytes:
    """One segment file as bytes."""
    blocks = [pack(ids[at : at + block_ids], bits) for at in range(0, len(ids), block_ids)]
    n = len(doc_ids)
    first = HEAD.size + 8 * (len(blocks) + 1) + 17 * n
    offsets = first + np.cumsum([0, *map(len, blocks)])
    return b"".join([
        HEAD.pack(MAGIC, bits, block_ids, n, len(ids), len(blocks)), offsets.astype("<u8").tobytes(), ends.astype("<u8").tobytes(),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), np.array([x is None for x in doc_ids], np.uint8).tobytes(), *blocks,
    ])


class Segment:
    """Random access to one segment file's bytes (or a memory map of it)."""

    def __init__(self, data: bytes):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids, n_blocks = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a segment file")
        self.data, at = data, HEAD.size
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at)
        self.ends = np.frombuffer(data, "<u8", self.n_docs, at := at + 8 * (n_blocks + 1))
        self.doc_ids = np.frombuffer(data, "<i8", self.n_docs, at := at + 8 * self.n_docs)
        self.null = np.frombuffer(data, np.uint8, self.n_docs, at + 8 * self.n_docs).astype(bool)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, self.n_ids - k * self.block_ids)
        return unpack(self.data[int(self.offsets[k]) : int(self.offsets[k + 1])], self.bits, n)

    def ids(self, start: int, end: int) -> np.ndarray:
        """Ids start up to end; only the blocks that hold them are unpacked."""
        if end <= start:
            return np.empty(0, np.uint32)
        first = start // self.block_ids
        parts = [self.block(k) for k in range(first, (end - 1) // self.block_ids + 1)]
        return np.concatenate(parts)[start - first * self.block_ids : end - first * self.block_ids]


#: Words of ASCII and Latin-1 letters, as UTF-8.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch


def letter_ends(word: bytes) -> bool:
    """Whether `word` ends in a letter or digit of ASCII or a Latin-1 letter: one that stays a letter in lower case."""
    if not word or word[-1] < 128:
        return word[-1:].isalnum()
    return word[-2:-1] == b"\xc3" and word[-1] not in b"\x97\xb7"


class WordEncoder:
    """Encodes whole texts with the tokenizers library, calling it once for each distinct word.

    That gives the library's own ids only where words between ASCII blanks are encoded independently. So the
    tokenizer's configuration is looked at: it has to drop white space and split on it before its model sees a text,
    and its added tokens must hold no blank. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.lib = Tokenizer.from_file(path)
        conf = json.loads(self.lib.to_str())
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        norm = [x["type"] for x in (conf["normalizer"] or {}).get("normalizers", [conf["normalizer"]]) if x]
        pre = (conf["pre_tokenizer"] or {}).get("pretokenizers", [conf["pre_tokenizer"]])
        split = next((x for x in pre if x and x["type"] == "Split" and x["behavior"] == "Removed" and x["invert"]), {})
        added = [x["content"] for x in conf["added_tokens"]]
        self.by_word = (
            set(norm) <= {"NFC", "Replace", "Lowercase"} and split.get("pattern", {}).get("Regex", "").endswith("|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and not any(set(x["content"]) & set(" \t\n\r") or x["lstrip"] or x["rstrip"] or x["single_word"] for x in conf["added_tokens"])
        )
        self.lower = "Lowercase" in norm
        #: A text that holds one of these may hold an added token: neither lower-case it nor cut off its words' ends.
        self.marks = {x[:2].encode() for x in added}
        #: Which ids end a word; None if the vocabulary doesn't mark them.
        suffix = conf["model"].get("end_of_word_suffix")
        self.last = None
        if suffix and self.by_word:
            self.last = np.zeros(self.size, bool)
            self.last[[v for k, v in self.lib.get_vocab().items() if k.endswith(suffix)]] = True
        self.words: dict[bytes, bytes] = {b"": b""}
        self.cores: dict[bytes, bytes] = {b"": b""}

    def _encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text. Words of letters alone, each of which has one last token, are handed over many at a time:
        the library's time goes more by calls than by letters."""
        if self.last is None:
            return self._each(texts)
        out: dict[bytes, bytes] = {}
        plain = [x for x in texts if LETTERS(x)]
        groups = [plain[at : at + JOINED] for at in range(0, len(plain), JOINED)]
        for group, found in zip(groups, self.lib.encode_batch_fast([b" ".join(x).decode() for x in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, self.kind)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(group):
                data, size = ids.tobytes(), ids.itemsize
                cuts = [0, *(ends * size).tolist()]
                out |= {x: data[a:b] for x, a, b in zip(group, cuts, cuts[1:], strict=False)}
        rest = [x for x in texts if x not in out]
        out |= zip(rest, self._each(rest), strict=True)
        return [out[x] for x in texts]

    def _each(self, texts: list[bytes]) -> list[bytes]:
        found = self.lib.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def _room(self, cache: dict[bytes, bytes], needed: set[bytes], new: int) -> None:
        if len(cache) + new > CACHE:
            kept = {x: cache[x] for x in needed if x in cache}
            cache.clear()
            cache |= kept | {b"": b""}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian integers of type `kind`."""
        if not self.by_word:
            return self._encode(texts)
        split = []
        for x in texts:
            if self.lower and not any(m in x for m in self.marks):
                x = x.lower()
            split.append(x.replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\t", b" ").split(b" "))
        needed = set().union(*split)
        missing = [x for x in needed if x not in self.words]
        self._room(self.words, needed, len(missing))
        # A word and the punctuation that ends it are separate for the tokenizer, and shared by many words.
        every = b" ".join(missing)
        whole = {x for x in missing if any(m in x for m in self.marks)} if any(m in every for m in self.marks) else ()
        cut = [y if letter_ends(y := x.rstrip(TAIL)) and x not in whole else x for x in missing]
        tails = [x[len(y) :] for x, y in zip(missing, cut, strict=True)]
        parts = {*cut, *tails}
        new = [x for x in parts if x not in self.cores]
        self._room(self.cores, parts, len(new))
        self.cores |= zip(new, self._encode(new), strict=True)
        self.words |= {x: self.cores[y] + self.cores[z] for x, y, z in zip(missing, cut, tails, strict=True)}
        return [b"".join(map(self.words.__getitem__, x)) for x in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker and tokenizer."""
    return WordEncoder(path)


def encode(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """doc_id, ids (binary, the tokenizer's narrowest integers with the end id appended)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind).tobytes()
        for part in in_chunks(batches):
            got = [x + end for x in enc.encode(utf8(part.column(1)))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def place(value: Column, ends: list[int]) -> Column:
    """How many of the sorted `ends` are below a value, by halving."""
    if not ends:
        return F.lit(0)
    half = len(ends) // 2
    above = half + 1 + place(value, ends[half + 1 :])
    return F.when(value > ends[half], above).when(value.isNotNull(), place(value, ends[:half]))


def write_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, segment_ids: int = 1 << 21, block_ids: int = 1 << 14) -> DataFrame:
    """Write `docs` as segment files in `folder` and return its table of files: file, first_id (ids before it), n_ids, n_docs.

    Ranges of doc_id are cut at approximate quantiles, for which only that column is read; then texts are encoded once,
    and what is shuffled to their ranges are ids, about a third of the text. A task streams its sorted range into
    segments of `segment_ids` ids or one document more. A segment is written under a temporary name and renamed, and only
    the names that the successful tasks report are in the table, so a lost or repeated task leaves no wrong file in the
    result.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.col("doc_id").cast("long")
    cuts = docs.select(key.alias("doc_id")).approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    ends = sorted({int(x) for x in cuts})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, context = encoder(tokenizer), TaskContext.get()
        bits, part, rows = bits_for(max(enc.size, end_id + 1)), context.partitionId(), []
        doc_ids: list[int | None] = []
        arrays: list[np.ndarray] = []
        held = 0

        def flush() -> None:
            nonlocal doc_ids, arrays, held
            data = segment(doc_ids, np.cumsum([len(x) for x in arrays]), np.concatenate(arrays), bits, block_ids)
            name = f"{part:08d}-{len(rows):08d}-{context.taskAttemptId()}.seg"
            put(folder, name, data)
            rows.append((part, len(rows), name, held, len(doc_ids)))
            doc_ids, arrays, held = [], [], 0

        for batch in in_chunks(batches):
            for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids.append(doc)
                arrays.append(np.frombuffer(x, enc.kind))
                held += len(arrays[-1])
                if held >= segment_ids:
                    flush()
        if doc_ids:
            flush()
        names = ["part", "seq", "file", "n_ids", "n_docs"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("file", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    # The number of cuts below an id is its range, null ids are in the first.
    dealt = encode(docs, tokenizer, end_id).repartitionById(len(ends) + 1, F.coalesce(place(F.col("doc_id"), ends), F.lit(0)))
    dealt = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    files = written(dealt.mapInArrow(run, "part long, seq long, file string, n_ids long, n_docs long"), "token-files")
    # One row for each file of some MB: a running sum over them in one task stays small at any size.
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("first_id"), "n_ids", "n_docs")


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file in full or not at all, on any file system that pyarrow knows."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/.{name}.tmp") as out:
        out.write(data)
    system.move(f"{path}/.{name}.tmp", f"{path}/{name}")


def read_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """Documents of the segment files, as they stand in them: doc_id, start, n_tokens, ids (binary, u32)."""
    if not files.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.seg").load(folder)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(files.select("file", "first_id"), "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches, 1):
            seg, first = Segment(batch.column(0)[0].as_py()), batch.column(1)[0].as_py()
            start = 0
            for at in range(0, seg.n_docs, 512):
                ends = seg.ends[at : at + 512].astype(np.int64)
                starts = np.concatenate([[start], ends[:-1]])
                ids = seg.ids(start, int(ends[-1])).astype("<u4")
                yield pa.RecordBatch.from_arrays([
                    pa.array(seg.doc_ids[at : at + 512], pa.int64(), mask=seg.null[at : at + 512]), pa.array(first + starts, pa.int64()), pa.array(ends - starts, pa.int64()),
                    pa.array([ids[a - start : b - start].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()),
                ], ["doc_id", "start", "n_tokens", "ids"])
                start = int(ends[-1])

    return named.select("content", "first_id").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1, folder: str | None = None, **sizes: int) -> DataFrame:
    """Write the files and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "segments")
    files = written(write_files(docs, folder, tokenizer, end_id, **sizes), "token-manifest")
    return read_files(spark, folder, files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
