import zlib

import numpy as np
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


def brute(rows):
    """(doc_id, start, n_tokens, crc) from the library itself on whole texts."""
    lib, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=70))
def test_pack_and_unpack(bits, ids):
    ids = np.array([x % (1 << bits) for x in ids], np.uint32)
    data = tf.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (tf.unpack(data, bits, len(ids)) == ids).all()


def test_bits():
    assert [tf.bits_for(x) for x in (1, 2, 3, 256, 257, 49408, 65536, 65537)] == [1, 1, 2, 8, 9, 16, 16, 17]


@pytest.mark.parametrize("bits", [13, 16, 17])
def test_random_access(bits):
    ids = np.random.default_rng(0).integers(0, 1 << bits, 1000).astype(np.uint32)
    seg = tf.Segment(tf.segment([5, None], np.array([400, 1000]), ids, bits, 64))
    for a, b in [(0, 1000), (63, 65), (128, 192), (999, 1000), (7, 7)]:
        assert (seg.ids(a, b) == ids[a:b]).all()
    assert seg.null.tolist() == [False, True] and seg.ends.tolist() == [400, 1000]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBcé'sTİΣς.,!# \n\t ́<|>12中½_")), min_size=1, max_size=4))
def test_word_encoder_is_the_library(texts):
    enc = tf.encoder(PATH)
    assert enc.by_word
    got = [np.frombuffer(x, enc.kind).tolist() for x in enc.encode([x.encode() for x in texts])]
    assert got == [enc.lib.encode(x, add_special_tokens=False).ids for x in texts]


def test_added_tokens_in_texts():
    enc = tf.encoder(PATH)
    for x in ["<|endoftext|>", "a<|endoftext|>.b c", "<|ENDOFTEXT|> A", "x<|startoftext|><|endoftext|>!!"]:
        assert np.frombuffer(enc.encode([x.encode()])[0], enc.kind).tolist() == enc.lib.encode(x, add_special_tokens=False).ids


def test_files_hold_every_document(spark, odd_docs):
    got = tf.round_trip(odd_docs, PATH, segment_ids=2000, block_ids=64).collect()
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    order = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in order] == [x[0] for x in want]
    assert sorted(((r.doc_id or -1), r.n_tokens, r.ids_crc32) for r in got) == sorted((x[0] or -1, *x[2:]) for x in want)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens


def test_sample_table(spark):
    from ledgerloom.llm.queries import op1_token_files

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r)[:4] for r in op1_token_files(spark, "/root/testdata/sf0.001").collect())
    assert got == brute([tuple(r) for r in docs])


def test_empty_table(spark, odd_docs):
    assert tf.round_trip(odd_docs.where("false"), PATH).collect() == []
