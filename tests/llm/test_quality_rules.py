import re
from collections import Counter

from pyspark.sql import functions as F

from ledgerloom.llm import quality_rules as qr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    runs = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    seen = Counter(runs)
    covered = {k + j for k, x in enumerate(runs) if seen[x] > 1 for j in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def check(docs):
    rows = qr.judged(docs).collect()
    got = sorted(((r.doc_id if r.doc_id is not None else -1), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted(((r.doc_id if r.doc_id is not None else -1), *brute(r.text)) for r in docs.collect())
    assert not any(r.kept and r.base_failed for r in rows)
    return rows


def test_odd_documents(odd_docs):
    check(odd_docs)
    assert qr.judged(odd_docs.where("false")).collect() == []


def test_windows(spark):
    base = " ".join(f"w{k}" for k in range(40))
    texts = [base, f"{base} {base}", f"{base} x {' '.join(base.split()[10:19])}", "a " * 50, "a b " * 30, "one two three four five six seven", " ".join(f"w{k % 8}" for k in range(16)), "é 中\n\n é 中\x0b|#", base + "\n" + base]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_sample_table(spark):
    rows = check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    assert 0.5 < sum(r.kept for r in rows) / len(rows) < 1


def test_junk_goes_and_prose_stays(spark):
    prose = " ".join(f"Word{k} and others that follow number{k * 7 % 11} here." for k in range(20))
    texts = {"prose": prose, "symbols": " ".join(f"w{k}###" for k in range(60)), "shout": " ".join(f"WORD{k}!!" for k in range(60)), "lines": "\n".join(["same line of words here"] * 4 + [f"other {k}" for k in range(8)]), "few": " ".join(f"w{k // 8}" for k in range(64))}
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    kept = {r.doc_id for r in qr.judged(df).where("kept").collect()}
    assert kept == {"prose"}
    assert {r.doc_id for r in qr.keep(df).collect()} == {"prose"}


def test_keep_agrees_with_judged_and_carries_columns(spark, odd_docs):
    for docs in (odd_docs, spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("words", F.lit(1)).withColumn("lines", F.lit(2))):
        want = sorted(str(r.doc_id) for r in qr.judged(docs).where("kept").collect())
        out = qr.keep(docs)
        assert out.columns == docs.columns and sorted(str(r.doc_id) for r in out.collect()) == want
    assert qr.keep(odd_docs.where("false")).collect() == []


def test_order_is_by_rejection_per_cost_and_changes_no_verdict(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = qr.measure(docs, qr.all_rules(), 100)
    assert [x.worth for x in found] == sorted((x.worth for x in found), reverse=True) and len(found) == len(qr.all_rules())
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", qr.words(F.col("text")).alias("words"), qr.word_lines(F.col("text")).alias("lines"))
    rules = [x.rule for x in found]
    a = base.where(qr.cascade(rules).isNull()).select("doc_id")
    b = base.where(qr.cascade(rules[::-1]).isNull()).select("doc_id")
    assert sorted(a.collect()) == sorted(b.collect())
