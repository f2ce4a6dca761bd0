"""A company's fiscal quarters from the facts of its filings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.staging import written
from .review import overlap_chain

#: By how much concepts may differ where they overlap, and quarters' sum from their year.
AGREE, SUM_CHECK = 0.005, 0.002


def first_reported(facts: DataFrame) -> DataFrame:
    """Each period's value as it was first filed, the latest one, and whether it was restated. `filed` is the day on which
    the period first became public under any concept."""
    order = F.struct("filed", "accn")
    g = facts.where(F.col("kind").isin("quarter", "annual")).groupBy("ticker", "concept", "start", "end", "kind").agg(F.min_by("val", order).alias("val"), F.max_by("val", order).alias("val_latest"), F.min("filed").alias("filed"))
    public = F.min("filed").over(W.partitionBy("ticker", "start", "end"))
    return g.withColumn("filed", public).withColumn("restated", F.abs(F.col("val_latest") - F.col("val")) > 0.001 * F.abs("val"))


def chosen(periods: DataFrame, concepts: list[str], since: str) -> DataFrame:
    """One value a period: the concept with the most periods since a day leads; the others, in the order of their number of
    periods, add periods that are missing if they agree on all that are there. Concepts are a few, so there is a join
    for each."""
    cover = periods.groupBy("ticker", "concept").agg(F.count_distinct(F.when(F.col("end") >= since, F.col("end"))).alias("n"))
    rank = F.row_number().over(W.partitionBy("ticker").orderBy(F.col("n").desc(), F.array_position(F.lit(concepts), F.col("concept"))))
    ranked = periods.join(cover.select("ticker", "concept", rank.alias("rank")), ["ticker", "concept"])
    primary = cover.select("ticker", rank.alias("rank"), F.col("concept").alias("primary_concept")).where("rank = 1").drop("rank")
    ranked = written(ranked, "periods")  # small, and read by each of the joins
    key, have = ["ticker", "start", "end"], ranked.where("rank = 1")
    for k in range(2, len(concepts) + 1):
        other = ranked.where(F.col("rank") == k)
        both = have.select(*key, F.col("val").alias("v")).join(other.select(*key, "val"), key)
        differ = both.groupBy("ticker").agg(F.max(F.abs(F.col("v") - F.col("val")) / F.abs("v")).alias("worst")).where(F.col("worst") > AGREE)
        have = written(have.unionByName(other.join(differ, "ticker", "left_anti").join(have.select(*key), key, "left_anti")), "periods")
    return have.drop("rank").join(primary, "ticker")


def with_last_quarters(series: DataFrame) -> DataFrame:
    """Quarters, and those that only a year's value tells: the year less the three quarters inside it."""
    q = series.where("kind = 'quarter'").withColumn("derived", F.lit(False))
    years = series.where("kind = 'annual'").select("ticker", "concept", "primary_concept", *[F.col(c).alias(f"y_{c}") for c in ("start", "end", "val", "val_latest", "filed", "restated")])
    inside = years.join(q.select("ticker", "start", "end", "val", "val_latest", "restated"), "ticker").where("start >= y_start AND end <= y_end")
    three = inside.groupBy("ticker", "concept", "primary_concept", "y_end", "y_val", "y_val_latest", "y_filed", "y_restated").agg(
        F.count("*").alias("n"), F.max("end").alias("last"), F.sum("val").alias("v"), F.sum("val_latest").alias("l"), F.max("restated").alias("r")
    ).where("n = 3 AND last < y_end")
    fourth = three.select(
        "ticker", "concept", F.date_add("last", 1).alias("start"), F.col("y_end").alias("end"), F.lit("quarter").alias("kind"), (F.col("y_val") - F.col("v")).alias("val"), (F.col("y_val_latest") - F.col("l")).alias("val_latest"),
        F.col("y_filed").alias("filed"), (F.col("y_restated") | F.col("r")).alias("restated"), "primary_concept", F.lit(True).alias("derived"),
    )
    first = F.row_number().over(W.partitionBy("ticker", "start", "end").orderBy("derived"))
    return q.unionByName(fourth).withColumn("n", first).where("n = 1").drop("n")


def labelled(quarters: DataFrame, years: DataFrame) -> DataFrame:
    """Fiscal year and quarter: the year by the end of the first year at or after the quarter, less seven days (years of 52
    and 53 weeks). Quarters count from 1 in their year; in a year that begins before the data the last one counts as 4."""
    ends = years.select("ticker", F.col("end").alias("year_end"), F.lit(1).alias("is_year")).distinct()
    rows = quarters.select("ticker", "end", "start", F.lit(0).alias("is_year")).unionByName(ends.select("ticker", F.col("year_end").alias("end"), F.lit(None).cast("date").alias("start"), "is_year"))
    ahead = W.partitionBy("ticker").orderBy(F.col("end").desc(), F.col("is_year").desc()).rowsBetween(W.unboundedPreceding, 0)
    nxt = rows.withColumn("year_end", F.last(F.when(F.col("is_year") == 1, F.col("end")), ignorenulls=True).over(ahead)).where("is_year = 0")
    # After the last year that is reported the next ones end a year later each.
    latest = ends.groupBy("ticker").agg(F.max("year_end").alias("latest"))
    nxt = nxt.join(latest, "ticker", "left").withColumn("ahead", F.ceil(F.datediff("end", "latest") / 372.0))
    guess = F.coalesce(F.col("year_end"), F.date_add("latest", (F.greatest(F.col("ahead"), F.lit(1)) * 365).cast("int")), F.date_add("end", 364))
    # Before the first year that is reported they end a year earlier each.
    years_off = F.floor(F.datediff(guess, F.col("end")) / 355.0)
    fy = nxt.select("ticker", "start", "end", F.year(F.date_sub(guess, (7 + 365 * years_off).cast("int"))).alias("fiscal_year"))
    place, n = W.partitionBy("ticker", "fiscal_year").orderBy("start"), F.count("*").over(W.partitionBy("ticker", "fiscal_year"))
    first_year = F.col("fiscal_year") == F.min("fiscal_year").over(W.partitionBy("ticker"))
    number = F.row_number().over(place) + F.when(first_year & (n < 4), 4 - n).otherwise(0)
    return quarters.join(fy.withColumn("fiscal_quarter", number.cast("int")), ["ticker", "start", "end"])


def quarterly_revenue(facts: DataFrame, concepts: list[str], since: str) -> DataFrame:
    """ticker, fiscal_year, fiscal_quarter, start, end, val, val_latest, filed, restated, derived, concept, primary_concept from
    facts: ticker, concept, start, end, kind, val, filed, accn."""
    series = chosen(first_reported(facts.where(F.col("concept").isin(concepts))), concepts, since)
    q = written(overlap_chain(with_last_quarters(series).where(F.col("end") >= since)), "quarters")
    return labelled(q, series.where("kind = 'annual'"))


def issues(quarters: DataFrame, facts: DataFrame, concepts: list[str], since: str) -> DataFrame:
    """ticker, issue: gaps and overlaps between neighbours, revenue that isn't positive, years that their quarters don't add up to."""
    w = W.partitionBy("ticker").orderBy("start")
    gaps = quarters.withColumn("before", F.lag("end").over(w)).where(F.col("start") != F.date_add("before", 1)).select("ticker", F.concat(F.lit("gap or overlap before "), F.col("start").cast("string")).alias("issue"))
    low = quarters.where("val <= 0").select("ticker", F.concat(F.lit("revenue not positive in "), F.col("start").cast("string")).alias("issue"))
    years = chosen(first_reported(facts.where(F.col("concept").isin(concepts))), concepts, since).where((F.col("kind") == "annual") & (F.col("end") >= since)).select("ticker", F.col("start").alias("s"), F.col("end").alias("e"), F.col("val").alias("total"))
    inside = years.join(quarters.select("ticker", "start", "end", "val"), "ticker").where("start >= s AND end <= e").groupBy("ticker", "e", "total").agg(F.count("*").alias("n"), F.sum("val").alias("four"))
    off = inside.where((F.col("n") == 4) & (F.abs(F.col("four") - F.col("total")) > SUM_CHECK * F.abs("total"))).select("ticker", F.concat(F.lit("quarters don't add up to the year to "), F.col("e").cast("string")).alias("issue"))
    return gaps.unionByName(low).unionByName(off)
