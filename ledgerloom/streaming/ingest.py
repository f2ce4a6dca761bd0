"""Incremental ingestion: files to bronze, bronze to silver, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import keep_first, keep_others, split
from ..sources.tables import insert_only


def file_stream(spark: SparkSession, folder: str, schema: str, files: int = 250) -> DataFrame:
    """New CSV files, with the path of each row's file and what its folders say."""
    raw = spark.readStream.format("csv").schema(schema).option("header", True).option("maxFilesPerTrigger", files).load(folder)
    path = F.col("_metadata.file_path")
    return raw.select("*", path.alias("_source_file"), F.regexp_extract(path, "source=([^/]+)", 1).alias("_path_source"), F.current_timestamp().alias("_ingested_at"))


def ingest(stream: DataFrame, table: str, checkpoint: str) -> int:
    """Append what is new to a Parquet table; returns the rows. The checkpoint remembers the files, so a second call
    without new files adds nothing."""
    query = stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(p.numInputRows for p in query.recentProgress)


class SilverMerge:
    """Micro-batches of checked rows into silver, quarantine and duplicate log.

    Each batch writes a folder of its own number and overwrites it if the batch is replayed, so a failure between the
    three writes leaves nothing twice. What was loaded before is read without the batch's own folder.
    """

    def __init__(self, root: str, key: list[str], order: list[str], check):
        self.root, self.key, self.order, self.check = root.rstrip("/"), key, order, check

    def _write(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/batch_id={batch}")

    def __call__(self, df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        checked = self.check(df).persist()
        try:
            good, bad = split(checked)
            self._write(bad, "quarantine", batch)
            first, again = keep_first(good, self.key, self.order), keep_others(good, self.key, self.order)
            loaded = self.read(spark, "silver", batch)
            fresh = first if loaded is None else insert_only(loaded, first, self.key)
            log = again.withColumn("reason", F.lit("in_batch"))
            if loaded is not None:
                old = first.join(loaded.select(*self.key).distinct(), self.key, "left_semi").withColumn("reason", F.lit("already_loaded"))
                log = log.unionByName(old)
            self._write(log, "duplicates", batch)
            self._write(fresh, "silver", batch)
        finally:
            checked.unpersist()

    def read(self, spark: SparkSession, name: str, before: int | None = None) -> DataFrame | None:
        """The table, of the batches before `before`."""
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return None
        df = spark.read.parquet(f"{self.root}/{name}")
        return (df if before is None else df.where(F.col("batch_id") < before)).drop("batch_id")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
