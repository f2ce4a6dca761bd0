"""Byte-level BPE by prefix dynamic programming (operator 4).

For every prefix of a byte string BPE's encoding has one last token, and cutting that token off leaves the encoding of
a shorter prefix. So the last token of each prefix, found from those of shorter prefixes, holds the whole encoding.
A token may follow another exactly where BPE, encoding both spans together, would not merge across their border.

A text is cut by the vocabulary's pattern and each match is encoded by itself, without special tokens. Null texts
count as empty and give no ids; texts and pieces of any length are encoded whole, in time proportional to their
length; repeated rows and ids stay separate rows; an empty table gives no row. Only doc_id and text are read, so
further columns of any name do no harm.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_chunks, utf8

#: Entries of each of a worker's caches at most. They save work only: what is dropped is found again.
CACHE = 600_000
#: Prefixes are shared between pieces up to this many bytes; longer pieces keep theirs in one list.
SHARED = 32


class PrefixBpe:
    """Encoding and decoding by a table of byte strings and their ranks, which are also their ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks))
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._follows: dict[tuple[int, int], bool] = {}
        self._last: dict[bytes, int] = {}
        #: What some token ends in, with its id if BPE makes such a token and else -1.
        self.tails = {x[k:]: -1 for x in ranks for k in range(1, len(x))} | {x: v for x, v in ranks.items() if self.halves(v)}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; itself twice for one byte; None if BPE never makes it."""
        if token not in self._halves:
            text = self.tokens[token]
            if len(text) == 1:
                self._halves[token] = (token, token)
            else:
                # Encode its bytes by the merges that come before its own; two parts are left if it can be made.
                parts = [text[i : i + 1] for i in range(len(text))]
                while len(parts) > 2:
                    best, at = min((self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                    if best >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self._halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE can put `right` next after `left`: no merge across their border comes before their own merges.

        The merges on both sides are undone, latest first. At each step the tokens at the border are those that
        stood there just before the merge undone last; if they could merge earlier than it, BPE would have done so.
        """
        known = self._follows.get((left, right))
        if known is not None:
            return known
        a, b, next_merge = left, right, len(self.ranks) + 1
        while True:
            across = self.ranks.get(self.tokens[a] + self.tokens[b])
            if across is not None and across < next_merge:
                good = False
                break
            a_half, b_half = self.halves(a), self.halves(b)
            a_whole, b_whole = a_half[0] == a, b_half[0] == b
            if a_whole and b_whole:
                good = True
                break
            # Equal ranks merge from the left: the right side's merge of that rank comes after one across the border.
            if not a_whole and (b_whole or a > b):
                a, next_merge = a_half[1], a
            else:
                b, next_merge = b_half[0], b + 1
        if len(self._follows) >= CACHE:
            self._follows.clear()
        self._follows[left, right] = good
        return good

    def _find(self, text: bytes, end: int, before, off: int = 0) -> int:
        """The last token of text[:end]; before(n) is that of text[:n]. The `off` bytes before `text` are left out."""
        tails, follows, fits = self.tails, self._follows, []
        for start in range(end - 1, -1, -1):
            token = tails.get(text[start:end])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
        # One of them is right; the longest is most often.
        for start, token in reversed(fits):
            if not start and not off:
                return token
            left = before(start)
            good = follows.get((left, token))
            if self.follows(left, token) if good is None else good:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def last_tokens(self, text: bytes) -> list[int]:
        """The last token of each prefix of 1, 2, ... bytes."""
        found = Prefixes(self)
        found.append(text)
        return found.last

    def encode_piece(self, text: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(text)
        if whole is not None:
            return [whole]
        if not text:
            return []
        if len(text) > SHARED:
            last = self.last_tokens(text)
            token_at = lambda n: last[n - 1]
        else:
            if len(self._last) >= CACHE:
                self._last.clear()
            token_at = lambda n: self._shared(text[:n])
        ids, at, tokens = [], len(text), self.tokens
        while at:
            ids.append(token := token_at(at))
            at -= len(tokens[token])
        return ids[::-1]

    def _shared(self, text: bytes) -> int:
        """The last token of a short prefix, which pieces share. Only the prefixes that the answer needs are looked at,
        those before the longest tokens first, as these are most often right."""
        store = self._last
        known = store.get(text)
        if known is not None:
            return known
        tails, end, fits = self.tails, len(text), []
        for start in range(end - 1, -1, -1):
            token = tails.get(text[start:])
            if token is None:
                break
            if token >= 0:
                fits.append((start, token))
        for start, token in reversed(fits):
            if start:
                left = self._shared(text[:start])
                good = self._follows.get((left, token))
                if not (self.follows(left, token) if good is None else good):
                    continue
            store[text] = token
            return token
        raise ValueError("the vocabulary lacks a byte")

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The encoding of one piece that grows and changes."""

    def __init__(self, bpe: PrefixBpe):
        self.bpe, self.text, self.last = bpe, bytearray(), []

    def append(self, more: bytes) -> None:
        """Exact: what is known of the shorter prefixes stays."""
        done = len(self.text)
        self.text += more
        text, last = bytes(self.text[max(0, done - self.bpe.longest) :]), self.last
        off = len(self.text) - len(text)
        for end in range(done + 1, len(self.text) + 1):
            last.append(self._at(text, off, end))

    def _at(self, text: bytes, off: int, end: int) -> int:
        return self.bpe._find(text, end - off, lambda n: self.last[off + n - 1], off)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put `new` for bytes start up to end; returns how many prefixes were computed anew. Once as many prefixes in
        a row as the longest token has bytes end in the same tokens as before, so do all that follow."""
        old, moved = self.last[end:], start + len(new)
        self.text[start:end] = new
        text = bytes(self.text)
        del self.last[start:]
        same = 0
        for n in range(start + 1, len(text) + 1):
            self.last.append(self._at(text, 0, n))
            same = same + 1 if n > moved and self.last[-1] == old[n - moved - 1] else 0
            if same >= self.bpe.longest:
                self.last += old[n - moved :]
                return n - start
        return len(text) - start

    def ids(self) -> list[int]:
        found, at = [], len(self.text)
        while at:
            found.append(self.last[at - 1])
            at -= len(self.bpe.tokens[found[-1]])
        return found[::-1]


#: A character or two of each kind that patterns tell apart: letters, marks, digits, signs, apostrophe, control, others.
KINDS = ["a", "s", "S", "É", "ß", "中", "\u0301", "ʰ", "1", "½", "'", ".", "_", "<", "€", "\x00", "\u200d", "😀"]


def cuts_before_blanks(find: Callable[[str], list[str]]) -> bool:
    """Whether a pattern cuts any two words at the blank between them, tried on all words of up to two kinds of
    characters."""
    words = KINDS + [a + b for a in KINDS for b in KINDS]
    alone, after = {x: find(x) for x in words}, {x: find(" " + x) for x in words}
    return all(find(f"{a} {b}") == alone[a] + after[b] for a in words for b in words)


class TextBpe:
    """Whole texts: cut by the pattern, pieces by `PrefixBpe`."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            self.bpe = PrefixBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
        self.find = regex.compile(pattern).findall
        self.space = regex.compile(r"\s\Z").search
        self.cuts = cuts_before_blanks(self.find)
        #: Ids of a blank and the word after it; None if the cut before a blank that follows the word may be wrong.
        self.words: dict[bytes, bytes | None] = {}
        #: Ids of pieces that don't begin with a blank.
        self.pieces: dict[bytes, bytes] = {}

    def _pieces(self, text: str) -> bytes:
        out = []
        for x in self.find(text):
            piece = x.encode()
            blank = piece[0] == 32 and len(piece) > 1
            known, key = (self.words, piece[1:]) if blank else (self.pieces, piece)
            ids = known.get(key)
            if ids is None:
                found = self.bpe.encode_piece(piece)
                ids = pack(f"<{len(found)}I", *found)
                if len(piece) <= 64 and len(known) < CACHE and not (blank and x.isspace()):
                    known[key] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian u32.

        If the pattern always cuts before a blank between two characters that are no white space, such words are
        looked up by themselves. A text in which white space precedes a blank is cut by the pattern as a whole, and so
        are all texts under another pattern.
        """
        if not self.cuts:
            return [self._pieces(x.decode()) for x in texts]
        split = [x.split(b" ") for x in texts]
        needed = set().union(*(x[1:] for x in split))
        missing = [x for x in needed if x not in self.words]
        if len(self.words) + len(missing) > CACHE:
            self.words = {x: self.words[x] for x in needed if x in self.words}
        if len(self.pieces) >= CACHE // 4:
            self.pieces.clear()
        for x in missing:
            word = x.decode()
            self.words[x] = None if not word or self.space(word) else self._pieces(" " + word)
        out, get = [], self.words.__getitem__
        for text, (first, *rest) in zip(texts, split, strict=True):
            found = list(map(get, rest))
            if None in found or not first or self.space(first.decode()):
                out.append(self._pieces(text.decode()))
            else:
                out.append(b"".join([self._pieces(first.decode()), *found]))
        return out

    def decode(self, ids: bytes) -> bytes:
        return self.bpe.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def text_bpe(path: str, pattern: str) -> TextBpe:
    """One for each Python worker and vocabulary."""
    return TextBpe(path, pattern)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary, little-endian u32)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(vocabulary, pattern)
        for part in in_chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(bpe.encode(utf8(part.column(1))), pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids are encoded and decoded in the same pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = text_bpe(vocabulary, pattern)
        for part in in_chunks(batches):
            ids = bpe.encode(utf8(part.column(1)))
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha256(x).hexdigest() for x in ids]), pa.array([sha256(bpe.decode(x)).hexdigest() for x in ids]),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
