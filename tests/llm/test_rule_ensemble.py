import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import rule_ensemble as re_
from ledgerloom.llm.queries import op5_rule_ensemble


def test_rules_are_found_and_sparse():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5))
    y = ((x[:, 0] > 0.7) | ((x[:, 1] < 0.3) & (x[:, 2] > 0.5))).astype(float)
    m = re_.fit(x, y, [f"f{k}" for k in range(5)])
    test = rng.random((2000, 5))
    want = (test[:, 0] > 0.7) | ((test[:, 1] < 0.3) & (test[:, 2] > 0.5))
    assert ((m.score(test) > 0.5) == want).mean() > 0.95
    assert len(m.rules) < 150


def test_column_says_what_numpy_says(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, 3))
    m = re_.fit(x, (x[:, 0] + x[:, 1] > 1).astype(float), ["a", "b", "c"])
    got = spark.createDataFrame(x.tolist(), "a double, b double, c double").select(m.column().alias("s")).collect()
    assert np.allclose([r.s for r in got], m.score(x))


def test_without_labels(spark, odd_docs):
    none = spark.createDataFrame([], "doc_id long, label int")
    for labels in (none, spark.createDataFrame([(3, 1), (4, 1)], "doc_id long, label int")):
        model = re_.learn(odd_docs, labels)
        rows = re_.scored(odd_docs, model).collect()
        assert len(rows) == odd_docs.count() and all(0 < r.score < 1 for r in rows)
    assert re_.scored(odd_docs.where("false"), model).collect() == []


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = op5_rule_ensemble(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("acc"), F.avg(F.when(F.col("quality") == 0, 1 - F.col("predicted"))).alias("bad"), F.count("*").alias("n")).first()
    assert r.n > 500 and r.acc > 0.95 and r.bad > 0.85


def test_statistics(spark):
    texts = ["", "Aa aa aa|b!", "x y\nx y\n\n12 34.", None]
    rows = {r.doc_id: r for r in re_.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert all(v == 0 for v in rows[0][1:]) and all(v == 0 for v in rows[3][1:])
    assert rows[1].n_words == 3 and rows[1].bars == pytest.approx(1 / 3) and rows[1].twice == 0 and rows[1].capitals == pytest.approx(1 / 7)
    assert rows[2].dup_lines == pytest.approx(1 / 3) and rows[2].digits == pytest.approx(4 / 15)
