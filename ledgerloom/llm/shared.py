"""What the operators of this subpackage share: the shared folder, written intermediate tables, text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: \x20 and \x09-\x0D: what separates words unless a contract says otherwise.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset (tests, one machine) a temporary one is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}")
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: it is computed once, its lineage is cut, and
    an executor that is lost takes nothing with it."""
    spark = df.sparkSession
    path = fresh_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that `fresh_folder` named, on whatever file system it is."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A key is hot if it has more than this part of all rows, so there are no more than SHARES hot keys.
SHARES, LEAST_SHARE = 100_000, 1000


def share_of(rows: DataFrame) -> int:
    """The number of rows beyond which a key of `rows` is hot."""
    return max(LEAST_SHARE, rows.count() // SHARES)


def joined_by(rows: DataFrame, one: DataFrame, key: str, n: str, limit: int) -> DataFrame:
    """rows joined with `one`, which has one row a key and in `n` the number of its rows. Keys with more than `limit` rows
    (as `share_of` tells, so that their number is bounded) are broadcast and their rows stay where they are."""
    hot = one.where(F.col(n) > limit)
    if not hot.take(1):
        return rows.join(one.drop(n), key)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.where(F.col(n) <= limit).drop(n), key)
    return cold.unionByName(rows.join(F.broadcast(hot.drop(n)), key))


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text of an Arrow column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def in_chunks(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Cut batches into small slices, so that what is held in Python stays small beside long texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
