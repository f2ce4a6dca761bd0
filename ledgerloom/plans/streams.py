"""Streaming and file round-trip queries, and the simulator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import simulate
from ..sources.staging import scratch
from ..sources.views import load
from ..streaming.ingest import SilverMerge, file_stream, ingest
from .ingest import RAW, REASONS, raw_txn
from .registry import query


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_custkey % 5 AS INT) AS source FROM customer")
def csv_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Gzipped CSV, one file for each source's folder, read back."""
    folder = scratch(spark, "csv")
    c = load(spark, d, "customer").select("c_custkey", "c_name", (F.col("c_custkey") % 5).alias("source"))
    c.repartition("source").write.partitionBy("source").option("header", True).option("compression", "gzip").csv(folder)
    return spark.read.option("header", True).schema("c_custkey string, c_name string, source int").csv(folder)


BRONZE = "txn_id string, user_id string, txn_date string, post_date string, amount string, currency string, merchant_descriptor string, mcc string, delivery string, l_partkey long, l_suppkey long, l_quantity double"


def bronze_counts(spark: SparkSession, raw: DataFrame) -> DataFrame:
    """Vendor files to bronze in two runs; the second finds nothing new."""
    root = scratch(spark, "bronze")
    raw.repartition("source").write.partitionBy("source").option("header", True).option("compression", "gzip").csv(f"{root}/landing")
    for _ in range(2):
        ingest(file_stream(spark, f"{root}/landing", BRONZE), f"{root}/table", f"{root}/checkpoint")
    b = spark.read.parquet(f"{root}/table")
    return b.groupBy(F.col("_path_source").alias("source")).agg(F.count("*").alias("n"), F.countDistinct("txn_id").alias("ids"))


@query(f"WITH {RAW} SELECT source, count(*) AS n, count(DISTINCT txn_id) AS ids FROM raw_txn GROUP BY source")
def stream_bronze_ingest(spark: SparkSession, d: str) -> DataFrame:
    return bronze_counts(spark, raw_txn(spark, d))


def silver_counts(spark: SparkSession, bronze: DataFrame) -> DataFrame:
    """Bronze as a stream of micro-batches, merged by id; a second run adds nothing."""
    from ..operators.quality import parse
    from .ingest import TODAY

    root = scratch(spark, "silver")
    bronze.repartition(3, "l_suppkey").write.parquet(f"{root}/bronze")
    merge = SilverMerge(root, ["txn_id"], ["delivery", "post_date", "l_partkey", "l_suppkey", "l_quantity"], lambda df: parse(df, min_date="1996-01-01", max_date=TODAY, max_abs_amount=90000))
    for _ in range(2):
        merge.run(spark.readStream.schema(bronze.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/bronze"), f"{root}/checkpoint")
    out = [merge.read(spark, x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in ("silver", "quarantine", "duplicates")]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(f"""WITH {REASONS} SELECT 'silver' AS name, count(DISTINCT txn_id) AS n FROM judged WHERE reasons = ''
UNION ALL SELECT 'quarantine', count(*) FROM judged WHERE reasons <> '' UNION ALL SELECT 'duplicates', count(*) - count(DISTINCT txn_id) FROM judged WHERE reasons = ''""")
def stream_silver_merge(spark: SparkSession, d: str) -> DataFrame:
    return silver_counts(spark, raw_txn(spark, d))


def panel(spark: SparkSession) -> DataFrame:
    return simulate.members(spark, 2000, "2022-01-01", 365)


@query()
def sim_members(spark: SparkSession, d: str) -> DataFrame:
    return panel(spark)


@query()
def sim_transactions(spark: SparkSession, d: str) -> DataFrame:
    brands = [r.p_brand for r in load(spark, d, "part").select("p_brand").distinct().orderBy("p_brand").collect()]
    return simulate.transactions(panel(spark), brands, "2022-01-01", 365)


