"""Queries of the corpus operators against their SQL in DuckDB."""

import pytest
from differential import differences

from ledgerloom.llm import queries

D = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(queries.queries()[name](spark, D), queries.oracle_sql()[name], D) == []


def test_held_out_is_never_null(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs.limit(200).unionByName(docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{D}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.held_out for r in queries.op5_rule_ensemble(spark, str(tmp_path)).where("doc_id IS NULL").collect()} == {True}
