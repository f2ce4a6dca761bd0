"""Six tools for a research agent, each a query over tables as they were known on a day; answers are small by their limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fiscal import masked
from .notes import guarded_sql


def percent(growth: str) -> F.Column:
    """Log growth as per cent, two digits; null stays null."""
    return F.round(100 * (F.exp(growth) - 1), 2)


@dataclass
class Tools:
    """Tables of a day. brands: brand, ticker, valid_from; quarters: ticker, fiscal_year, fiscal_quarter, period_start,
    period_end, filed, revenue, rev_yoy, panel_yoy; predictions: ticker, period_end, nowcast_date, model, pred, lo, hi,
    revenue_prior; events: type, source, ticker, start, end, action; descriptors: ticker, decision, method, abs_spend;
    scorecard: any columns."""

    spark: SparkSession
    day: str
    brands: DataFrame
    quarters: DataFrame
    predictions: DataFrame
    events: DataFrame
    descriptors: DataFrame
    scorecard: DataFrame

    def __post_init__(self) -> None:
        day = F.lit(self.day).cast("date")
        self.quarters = masked(self.quarters, day, ["revenue", "rev_yoy"])
        self.predictions = self.predictions.where(F.col("nowcast_date") <= day)
        self.events = self.events.where(F.col("start") <= day)

    def _latest(self, ticker: str) -> dict[str, Any]:
        rows = self.predictions.where((F.col("ticker") == ticker) & (F.col("model") == "ensemble")).orderBy(F.col("period_end").desc()).limit(1).collect()
        if not rows:
            raise LookupError(f"no nowcast for {ticker} on {self.day}")
        return rows[0].asDict()

    def overview(self, ticker: str) -> dict[str, Any]:
        brands = self.brands.where(F.col("ticker") == ticker).select("brand", F.col("valid_from").cast("string").alias("counts_from")).orderBy("brand").limit(200).collect()
        last = self.quarters.where(F.col("ticker") == ticker).orderBy(F.col("period_end").desc()).limit(4).collect()
        return {"ticker": ticker, "brands": [r.asDict() for r in brands], "quarters": [{"label": f"FY{r.fiscal_year} Q{r.fiscal_quarter}", "start": str(r.period_start), "end": str(r.period_end)} for r in reversed(last)]}

    def nowcast(self, ticker: str) -> dict[str, Any]:
        t = self._latest(ticker)
        p = self.predictions.where((F.col("ticker") == ticker) & (F.col("period_end") == F.lit(t["period_end"])))
        usd = lambda c: F.round(F.col("revenue_prior") * F.exp(c) / 1e9, 2)
        rows = p.select("model", percent("pred").alias("yoy"), percent("lo").alias("lo"), percent("hi").alias("hi"), usd("pred").alias("usd"), usd("lo").alias("usd_lo"), usd("hi").alias("usd_hi")).collect()
        best = next(r for r in rows if r.model == "ensemble")
        return {
            "ticker": ticker, "period_end": str(t["period_end"]), "nowcast_date": str(t["nowcast_date"]), "yoy_pct": best.yoy, "band_80_pct": [best.lo, best.hi],
            "revenue_usd_bn": best.usd, "revenue_band_usd_bn": [best.usd_lo, best.usd_hi], "models_yoy_pct": {r.model: r.yoy for r in rows},
        }

    def quarter_history(self, ticker: str, n: int = 8) -> list[dict[str, Any]]:
        p = self.predictions.where(F.col("model") == "ensemble").select("ticker", "period_end", "pred")
        q = self.quarters.where((F.col("ticker") == ticker) & F.col("rev_yoy").isNotNull()).orderBy(F.col("period_end").desc()).limit(n).join(p, ["ticker", "period_end"], "left")
        q = q.select("fiscal_year", "fiscal_quarter", F.col("period_end").cast("string").alias("period_end"), percent("rev_yoy").alias("reported_pct"), percent("panel_yoy").alias("panel_pct"), percent("pred").alias("nowcast_pct"), F.col("filed").cast("string").alias("filed"))
        rows = [r.asDict() for r in q.withColumn("error_pp", F.round(F.col("nowcast_pct") - F.col("reported_pct"), 2)).orderBy("period_end").collect()]
        errors = [abs(r["error_pp"]) for r in rows if r["error_pp"] is not None]
        return [*rows, {"with_nowcast": len(errors), "mean_abs_error_pp": round(sum(errors) / len(errors), 2) if errors else None}] if rows else []

    def data_quality(self, ticker: str) -> dict[str, Any]:
        end = self._latest(ticker)["period_end"]
        span = self.quarters.where((F.col("ticker") == ticker) & (F.col("period_end") == F.lit(end))).select("period_start", "period_end")
        e = self.events.withColumnRenamed("ticker", "t").join(F.broadcast(span.limit(1)), (F.col("end") >= F.col("period_start")) & (F.col("start") <= F.col("period_end"))).where(F.col("t").isNull() | (F.col("t") == ticker))
        rows = e.select("type", "source", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "action").orderBy("start", "source").limit(200).collect()
        s = {(r.decision, r.method): r.s for r in self.descriptors.where(F.col("ticker") == ticker).groupBy("decision", "method").agg(F.sum("abs_spend").alias("s")).collect()}
        matched, review = sum(v for (d, _), v in s.items() if d == "MATCH"), sum(v for (d, _), v in s.items() if d == "REVIEW")
        return {
            "events": [r.asDict() for r in rows], "matched_pct": {m: round(100 * v / matched, 2) for (d, m), v in s.items() if d == "MATCH"} if matched else {},
            "review_pct": round(100 * review / (matched + review), 2) if matched + review else None,
        }

    def asset_scorecard(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.scorecard.limit(200).collect()]

    def run_sql(self, query: str) -> list[dict[str, Any]]:
        """Rows, or what was wrong with the query as a row."""
        try:
            return [r.asDict() for r in guarded_sql(self.spark, query, {"quarters": self.quarters, "predictions": self.predictions, "events": self.events}).collect()]
        except Exception as e:  # the caller is a model, which reads the message
            return [{"error": str(e).split("\n")[0]}]

    def all(self) -> dict[str, Callable]:
        return {f.__name__: f for f in (self.overview, self.nowcast, self.quarter_history, self.data_quality, self.asset_scorecard, self.run_sql)}
