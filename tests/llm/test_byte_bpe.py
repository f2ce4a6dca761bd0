import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def bpe():
    return byte_bpe.text_bpe(PATH, PATTERN)


@pytest.fixture(scope="module")
def lib():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeinorst'sl .,\n\t\r\x85  \x1c12½²é中ñ#<|>"), max_size=40))
def test_texts_like_the_library(bpe, lib, text):
    ids = bpe.encode([text.encode()])[0]
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode_ordinary(text)
    assert bpe.decode(ids) == text.encode()


def test_pieces_like_the_library(bpe, lib):
    rng, vocabulary = random.Random(0), list(bpe.bpe.ranks)
    for _ in range(5000):
        piece = b"".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 5)))
        assert bpe.bpe.encode_piece(piece) == lib._encode_single_piece(piece)


def test_long_piece(bpe, lib):
    text = "".join(random.Random(1).choice("abcdest") for _ in range(20000))
    assert np.frombuffer(bpe.encode([text.encode()])[0], "<u4").tolist() == lib.encode_ordinary(text)


def test_appends_and_edits(bpe):
    rng, p = random.Random(2), byte_bpe.Prefixes(bpe.bpe)
    for _ in range(200):
        new = bytes(rng.choices(b"etaoin shrdlu", k=rng.randint(0, 9)))
        if rng.random() < 0.5:
            p.append(new)
        else:
            start = rng.randint(0, len(p.text))
            p.edit(start, min(len(p.text), start + rng.randint(0, 5)), new)
        assert p.last == bpe.bpe.last_tokens(bytes(p.text))
        assert bpe.bpe.decode(p.ids()) == bytes(p.text)


def test_an_edit_is_local(bpe):
    p = byte_bpe.Prefixes(bpe.bpe)
    p.append(b"the quick brown fox " * 500)
    assert p.edit(4000, 4003, b"cat") < 1000
    assert p.last == bpe.bpe.last_tokens(bytes(p.text))


def test_query(spark, odd_docs, lib):
    def brute(text):
        ids = np.array(lib.encode_ordinary(text or ""), "<u4").tobytes()
        return len(ids) // 4, sha256(ids).hexdigest(), sha256((text or "").encode()).hexdigest()

    key = lambda x: (x[0] or -1, *x[1:])
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), odd_docs.where("false")):
        got = [tuple(r) for r in byte_bpe.round_trip(docs, PATH, PATTERN).collect()]
        assert sorted(got, key=key) == sorted(((r.doc_id, *brute(r.text)) for r in docs.collect()), key=key)


def test_patterns_that_join_words_over_a_blank():
    """Under a pattern that doesn't cut before each blank texts are cut by it as a whole."""
    import public_tokenizers
    import regex
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    from ledgerloom.llm.byte_bpe import TextBpe, cuts_before_blanks

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert TextBpe(path, public_tokenizers.PATTERN).cuts
    for pattern in (r"\w+ \w+|\s+|.", r"[^,]+|,", r"\d+ \d+|\S+|\s+"):
        assert not cuts_before_blanks(regex.compile(pattern).findall)
        lib = tiktoken.Encoding("x", pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(path), special_tokens={})
        for text in ("one two three, four 5 6 7", " a b  c"):
            got = TextBpe(path, pattern).encode([text.encode()])[0]
            assert np.frombuffer(got, "<u4").tolist() == lib.encode_ordinary(text)
