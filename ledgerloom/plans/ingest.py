"""Ingest and data-quality queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import keep_first, keep_others, parse, split
from ..sources.tables import insert_only
from ..sources.views import KEEP_ORDER, txn
from .registry import query

#: Days after this are out of range; a fixed day keeps results the same on any day.
TODAY = "2001-12-31"


def raw_txn(spark: SparkSession, d: str) -> DataFrame:
    """Transactions as vendors write them: all strings, some of them broken."""
    k, s = F.col("l_orderkey"), lambda c: F.col(c).cast("string")
    return txn(spark, d).select(
        "txn_id", s("user_id").alias("user_id"), F.when(k % 89 == 0, "2024-13-45").otherwise(s("txn_date")).alias("txn_date"), s("post_date").alias("post_date"),
        F.when(k % 97 == 0, "12.3O").otherwise(s("amount")).alias("amount"), F.when(k % 101 == 0, "XXX").otherwise("USD").alias("currency"),
        F.when(k % 83 == 0, "").otherwise(F.concat(F.lit("ITEM "), s("l_partkey"))).alias("merchant_descriptor"), F.when(k % 103 == 0, "x1").otherwise(s("l_suppkey")).alias("mcc"),
        "source", "delivery", "l_partkey", "l_suppkey", "l_quantity",
    )


RAW = """raw_txn AS (SELECT txn_id, CAST(user_id AS VARCHAR) AS user_id, CASE WHEN l_orderkey % 89 = 0 THEN '2024-13-45' ELSE CAST(txn_date AS VARCHAR) END AS txn_date, CAST(post_date AS VARCHAR) AS post_date,
  CASE WHEN l_orderkey % 97 = 0 THEN '12.3O' ELSE CAST(amount AS VARCHAR) END AS amount, CASE WHEN l_orderkey % 101 = 0 THEN 'XXX' ELSE 'USD' END AS currency,
  CASE WHEN l_orderkey % 83 = 0 THEN '' ELSE 'ITEM ' || l_partkey END AS merchant_descriptor, CASE WHEN l_orderkey % 103 = 0 THEN 'x1' ELSE CAST(l_suppkey AS VARCHAR) END AS mcc,
  source, delivery, l_partkey, l_suppkey, l_quantity FROM txn)"""
REASONS = f"""{RAW}, parsed AS (SELECT *, TRY_CAST(txn_date AS DATE) AS d, TRY_CAST(amount AS DECIMAL(14,2)) AS a, TRY_CAST(mcc AS INT) AS m FROM raw_txn),
judged AS (SELECT *, concat_ws(',', CASE WHEN coalesce(trim(txn_id), '') = '' THEN 'missing_txn_id' END, CASE WHEN coalesce(trim(user_id), '') = '' THEN 'missing_user_id' END,
  CASE WHEN d IS NULL THEN 'bad_txn_date' END, CASE WHEN d < DATE '1996-01-01' OR d > DATE '{TODAY}' THEN 'txn_date_out_of_range' END, CASE WHEN a IS NULL THEN 'bad_amount' END,
  CASE WHEN abs(a) > 90000 THEN 'amount_out_of_range' END, CASE WHEN coalesce(currency, '') NOT IN ('USD') THEN 'bad_currency' END,
  CASE WHEN coalesce(trim(merchant_descriptor), '') = '' THEN 'missing_descriptor' END, CASE WHEN m IS NULL THEN 'bad_mcc' END) AS reasons FROM parsed)"""


def checked(spark: SparkSession, d: str) -> DataFrame:
    return parse(raw_txn(spark, d), min_date="1996-01-01", max_date=TODAY, max_abs_amount=90000)


@query(f"WITH {REASONS} SELECT txn_id, d AS txn_date, CAST(a AS DOUBLE) AS amount, m AS mcc FROM judged")
def try_parse(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select("txn_id", F.col("_txn_date").alias("txn_date"), F.col("_amount").cast("double").alias("amount"), F.col("_mcc").alias("mcc"))


@query(f"WITH {REASONS} SELECT txn_id, l_partkey, reasons FROM judged")
def dq_expectations(spark: SparkSession, d: str) -> DataFrame:
    return checked(spark, d).select("txn_id", "l_partkey", F.concat_ws(",", "dq_reasons").alias("reasons"))


@query(f"WITH {REASONS} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM judged WHERE reasons <> '') GROUP BY ALL")
def dq_quarantine_reasons(spark: SparkSession, d: str) -> DataFrame:
    bad = split(checked(spark, d))[1]
    return bad.select(F.explode(F.split("dq_reasons", ",")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def redelivered(df: DataFrame) -> DataFrame:
    return df.withColumn("redelivered", F.col("delivery") == "redelivery")


@query("SELECT txn_id, user_id, txn_date, post_date, CAST(amount AS DOUBLE) AS amount, source, delivery FROM clean")
def dedup_keep_first(spark: SparkSession, d: str) -> DataFrame:
    first = keep_first(redelivered(txn(spark, d)), ["txn_id"], KEEP_ORDER)
    return first.select("txn_id", "user_id", "txn_date", "post_date", F.col("amount").cast("double").alias("amount"), "source", "delivery")


DUPS = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY CASE WHEN delivery = 'redelivery' THEN 1 ELSE 0 END, post_date, l_partkey, l_suppkey, l_quantity, amount) AS rn FROM txn) WHERE rn > 1"


@query(f"SELECT txn_id, source, delivery, post_date, 'in_batch' AS reason FROM ({DUPS}) UNION ALL SELECT txn_id, source, delivery, post_date, 'already_loaded' FROM clean WHERE txn_id IN (SELECT txn_id FROM clean WHERE txn_date < DATE '1996-01-01')")
def dedup_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows that are dropped: repeats within the batch, and first rows of ids that were loaded before."""
    t = redelivered(txn(spark, d))
    cols = ["txn_id", "source", "delivery", "post_date"]
    again = keep_others(t, ["txn_id"], KEEP_ORDER).select(*cols, F.lit("in_batch").alias("reason"))
    first = keep_first(t, ["txn_id"], KEEP_ORDER)
    loaded = first.where("txn_date < date'1996-01-01'").select("txn_id")
    return again.unionByName(first.join(loaded, "txn_id", "left_semi").select(*cols, F.lit("already_loaded").alias("reason")))


@query("SELECT user_id, txn_id, post_date FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY post_date DESC, txn_id) AS n FROM clean) WHERE n = 1")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import clean

    return keep_first(clean(spark, d), ["user_id"], [F.col("post_date").desc(), "txn_id"]).select("user_id", "txn_id", "post_date")


@query("SELECT txn_id, source FROM txn WHERE txn_id IN (SELECT txn_id FROM clean WHERE txn_date < DATE '1996-01-01')")
def semi_join_already_loaded(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import clean

    return txn(spark, d).join(clean(spark, d).where("txn_date < date'1996-01-01'").select("txn_id"), "txn_id", "left_semi").select("txn_id", "source")


@query("SELECT txn_id, source, txn_date FROM clean")
def insert_only_merge(spark: SparkSession, d: str) -> DataFrame:
    """A target that has the first year, after all years are merged into it: only new ids are added."""
    from ..sources.views import clean

    every = clean(spark, d).select("txn_id", "source", "txn_date")
    target = every.where("txn_date < date'1996-01-01'")
    return target.unionByName(insert_only(target, every, ["txn_id"]))


@query(f"WITH {REASONS} SELECT 'bronze' AS layer, count(*) AS n FROM judged UNION ALL SELECT 'quarantine', count(*) FILTER (WHERE reasons <> '') FROM judged UNION ALL SELECT 'silver', count(DISTINCT txn_id) FROM judged WHERE reasons = '' UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT txn_id) FROM judged WHERE reasons = ''")
def reconcile_counts(spark: SparkSession, d: str) -> DataFrame:
    """bronze = silver + quarantine + duplicates, in one pass over the rows."""
    rows = checked(spark, d).select("txn_id", (F.size("dq_reasons") > 0).alias("bad"))
    per = rows.groupBy("txn_id").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("bad"))
    one = per.agg(F.sum("n").alias("bronze"), F.sum("bad").alias("quarantine"), F.sum((F.col("n") > F.col("bad")).cast("long")).alias("silver"), F.sum(F.greatest(F.col("n") - F.col("bad") - 1, F.lit(0))).alias("duplicates"))
    return one.select(F.explode(F.create_map(*[x for c in ("bronze", "quarantine", "silver", "duplicates") for x in (F.lit(c), F.coalesce(F.col(c), F.lit(0)).cast("long"))])).alias("layer", "n"))


@query("SELECT 'region' AS source, '' AS partition, r_regionkey FROM region")
def source_from_path(spark: SparkSession, d: str) -> DataFrame:
    """Each file's rows with the table that its path names."""
    rows = spark.read.parquet(f"{d}/region.parquet").select(F.col("_metadata.file_path").alias("path"), "r_regionkey")
    return rows.select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("source"), F.regexp_extract("path", "source=([^/]+)", 1).alias("partition"), "r_regionkey")
