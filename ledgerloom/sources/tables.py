"""Tables by layer and name on any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LAYERS = ("ref", "bronze", "silver", "gold", "truth", "eval")


class Catalog:
    """Parquet tables `<root>/<layer>/<name>`."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: str, name: str) -> str:
        if layer not in LAYERS:
            raise ValueError(f"no layer {layer}")
        return f"{self.root}/{layer}/{name}"

    def _hadoop(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, layer: str, name: str) -> bool:
        p, fs = self._hadoop(self.path(layer, name))
        return fs.exists(p)

    def read(self, layer: str, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, name))

    def write(self, df: DataFrame, layer: str, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
        writer = df.write.mode(mode)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(layer, name))

    def checkpoint(self, layer: str, name: str) -> str:
        return f"{self.root}/_checkpoints/{layer}_{name}"

    def drop(self, layer: str, name: str) -> None:
        for path in (self.path(layer, name), self.checkpoint(layer, name)):
            p, fs = self._hadoop(path)
            fs.delete(p, True)

    def write_pandas(self, rows, layer: str, name: str, schema: str | None = None) -> None:
        """A small pandas frame as a table."""
        self.write(self.spark.createDataFrame(rows, schema), layer, name)

    def load_csv(self, path: str, layer: str, name: str, schema: str) -> None:
        """A CSV file, gzipped or not, with a header, as a table."""
        self.write(self.spark.read.schema(schema).option("header", True).csv(path), layer, name)

    def names(self, layer: str) -> list[str]:
        """The tables of a layer."""
        p, fs = self._hadoop(f"{self.root}/{layer}")
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def reset(self, *layers: str, landing: bool = False) -> None:
        """Remove all tables of the layers with their checkpoints, and the landed files if asked for."""
        for layer in layers:
            for name in self.names(layer):
                self.drop(layer, name)
        if landing:
            p, fs = self._hadoop(f"{self.root}/landing")
            fs.delete(p, True)

    def register(self, layer: str, name: str) -> str:
        """A temporary view `<layer>_<name>` for SQL."""
        view = f"{layer}_{name}"
        self.read(layer, name).createOrReplaceTempView(view)
        return view


def insert_only(target: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of `new` whose key the target lacks: what an insert-only merge appends."""
    return new.join(target.select(*key).distinct(), key, "left_anti")


def review_overlay(scores: DataFrame, reviews: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """`scores` with `columns` replaced where a review of the same key has them."""
    from pyspark.sql import functions as F

    new = reviews.select(*key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_reviewed"))
    joined = scores.join(new, key, "left")
    return joined.select(*[F.when(F.col("_reviewed"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in scores.columns])
