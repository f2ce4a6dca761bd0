"""Sequential and reviewed decisions: chains of periods without overlap, adjudication of queued matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def overlap_chain(periods: DataFrame, key: str = "ticker") -> DataFrame:
    """Of overlapping periods (start, end, derived) of one key a chain without overlap: the later start wins, unless it is
    derived and the one before is not. What is kept depends on what was kept before, so a key's periods, of which there
    are a few a year, are folded in an array."""
    rest = [c for c in periods.columns if c not in (key, "start")]

    def link(chain: Column, p: Column) -> Column:
        last = F.try_element_at(chain, F.lit(-1))
        clear = F.coalesce(p.start > last.end, F.lit(True))
        weaker = p.derived & ~last.derived
        return F.when(clear, F.array_append(chain, p)).when(weaker, chain).otherwise(F.array_append(F.slice(chain, 1, F.size(chain) - 1), p))

    g = periods.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", *rest))).alias("all"))
    none = F.filter("all", lambda p: F.lit(False))
    return g.select(key, F.inline(F.aggregate("all", none, link))).select(*periods.columns)


#: What a reviewer is asked (number, descriptor, category code) and answers by number: brand, confidence, reason.
Decide = Callable[[list[tuple[int, str, int]]], dict[int, tuple[str, float, str]]]
VERDICT = "number long, brand string, confidence double, reason string"


def adjudicated(queue: DataFrame, brands: DataFrame, decide: Decide, batch: int = 20, least: float = 0.8, most: int = 400) -> DataFrame:
    """descriptor, mcc, brand (null if there is none), confidence, reason of the first `most` rows of a queue (columns
    descriptor, mcc, place). `decide` sees `batch` rows at a time. An answer counts if its brand is one of `brands` and
    its confidence is enough; a row without an answer has no brand.

    The queue is a limited one by design: what a reviewer can take in."""
    first = queue.orderBy("place", "descriptor", "mcc").limit(most)
    rows = first.withColumn("number", F.row_number().over(W.orderBy("place", "descriptor", "mcc")).cast("long") - 1)
    asked = rows.groupBy(F.floor(F.col("number") / batch).alias("part")).agg(F.array_sort(F.collect_list(F.struct("number", "descriptor", "mcc"))).alias("rows"))

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            said = [(n, *answer) for rows in part["rows"] for n, answer in (decide([(r["number"], r["descriptor"], r["mcc"]) for r in rows]) or {}).items()]
            yield pd.DataFrame(said, columns=["number", "brand", "confidence", "reason"])

    said = asked.select("rows").mapInPandas(ask, VERDICT).dropDuplicates(["number"])
    known = brands.select("brand", F.lit(True).alias("known")).distinct()
    j = rows.join(said.join(known, "brand", "left"), "number", "left")
    good = F.coalesce(F.col("known") & (F.col("confidence") >= least), F.lit(False))
    return j.select("descriptor", "mcc", F.when(good, F.col("brand")).alias("brand"), "confidence", F.coalesce("reason", F.lit("no answer")).alias("reason"))
