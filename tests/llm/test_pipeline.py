import numpy as np

import corpus_pipeline
from ledgerloom.llm import mixing, pii, quality_rules

from test_near_copies import least_ids

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert len(names) == 5
    kept = stage["quality"](spark, docs, D).persist()
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality_rules.judged(docs).where("kept").collect()}
    one = stage["near_duplicates"](spark, kept, D).persist()
    assert sorted(r.doc_id for r in one.collect()) == least_ids([(r.doc_id, r.text) for r in kept.collect()]) and one.columns == docs.columns
    masked = stage["personal_data"](spark, one, D).persist()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in masked.collect():
        assert r.text == pii.masked_text(before[r.doc_id], pii.spans(before[r.doc_id])) and r.n_chars == len(r.text)
        assert not pii.plain(r.text)
    mixed = stage["mix"](spark, masked, D).persist()
    taken = {r.doc_id: r.taken for r in mixing.plan(masked).collect() if r.taken}
    words = {}
    for r in mixed.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
    assert words == taken and mixed.columns == docs.columns
    ids = stage["tokens"](spark, mixed, D).collect()
    assert len(ids) == mixed.count()
    from ledgerloom.llm.byte_bpe import text_bpe

    import public_tokenizers

    bpe = text_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert sorted(bpe.decode(bytes(r.ids)).decode() for r in ids) == sorted(r.text for r in mixed.collect())
    assert all(r.n_tokens == len(np.frombuffer(bytes(r.ids), "<u4")) for r in ids)


def test_odd_rows(spark):
    prose = " ".join(f"Word{k} and others that follow number{k * 7 % 11} here." for k in range(20))
    rows = [(1, None, "en", "a", 0, 5), (2, "", "en", None, 0, 5), (None, prose + " x", None, None, None, 5), (3, prose, "en", "a", 1, 5), (3, prose, "en", "a", 1, 5), (4, prose, "en", "b", 1, None), (5, "me@x.org " + prose.replace("follow", "lead"), "en", "b", 1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").persist()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp"]
    # Row 3 names its group of copies, which row null is one of (a word more) and row 5 is none of.
    assert {r.doc_id for r in docs.collect()} == {3, 5}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, "")
    assert last.count() == docs.count()
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
        assert empty.count() == 0


def test_clashing_columns(spark):
    prose = [" ".join(f"Word{k} and others{j} that follow number{k * 7 % 11} here." for k in range(20)) for j in range(2)]
    rows = [(7, prose[0], 1, 2, 3, 4), (7, prose[1], 1, 2, 3, 4), (8, prose[1], 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, stay_id int, first int, node int, row int")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(rows[:2])
