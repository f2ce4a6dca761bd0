"""Joins and folds over dates: effective-dated dimensions, range joins, islands, densified grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def effective_dated_join(rows: DataFrame, dim: DataFrame, key: list[str], date: str) -> DataFrame:
    """Rows with the dimension's row that was valid on their date (both ends inclusive).

    An equi-join with the interval as a residual, so it stays a hash join; a small dimension is broadcast by its
    measured size, a large one shuffled.
    """
    return rows.join(dim, key).where(F.col(date).between(F.col("valid_from"), F.col("valid_to"))).drop("valid_from", "valid_to")


def range_join(points: DataFrame, spans: DataFrame, key: list[str], point: str, start: str, end: str) -> DataFrame:
    """Points inside spans of the same key."""
    return points.join(spans, key).where(F.col(point).between(F.col(start), F.col(end)))


def islands(days: DataFrame, key: list[str], date: str = "date", gap: int = 2) -> DataFrame:
    """Runs of days at most `gap` apart: key, start, end, n_days (from start to end)."""
    w = W.partitionBy(*key).orderBy(date)
    new = F.coalesce(F.datediff(F.col(date), F.lag(date).over(w)) > gap, F.lit(True)).cast("int")
    runs = days.select(*key, date).distinct().withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    found = runs.groupBy(*key, "_run").agg(F.min(date).alias("start"), F.max(date).alias("end"))
    return found.select(*key, "start", "end", (F.datediff("end", "start") + 1).alias("n_days"))


def days_of(start: Column, end: Column) -> Column:
    """Each day from start to end; none if the end comes first (a plain sequence would count down)."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def grid(a: DataFrame, b: DataFrame, on_b: list[str], known: list) -> DataFrame:
    """Each row of `a` with each of the `known` key values of b: an explode, not a cross join. known: rows of values."""
    kind = b.select(*on_b).schema
    values = F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind, strict=True)]) for row in known])
    return a.withColumn("_k", F.explode(values)).select(*a.columns, *[F.col(f"_k.{c}").alias(c) for c in on_b])
