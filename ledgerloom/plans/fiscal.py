"""Fiscal periods, weighting, forecasts and their evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.calendar import holiday_factor, nth, super_bowl
from ..operators.forecast import walk
from ..operators.intervals import days_of, range_join
from ..operators.weighting import raked_shares
from ..sources.staging import written
from ..sources.views import fiscal, load, member, quarters, tagged
from .registry import query

ROLL = """roll AS (SELECT f.ticker, fiscal_year, fiscal_quarter, f.period_start, f.period_end, f.filed, revenue, CAST(f.period_end + 7 AS DATE) AS nowcast_date, sum(raw) AS panel, CAST(least(f.period_end, b.z) - greatest(f.period_start, b.a) + 1 AS BIGINT) AS days, f.period_start >= b.a AND f.period_end <= b.z AS complete
  FROM fiscal f JOIN panel_daily p ON p.ticker = f.ticker AND p.date BETWEEN f.period_start AND f.period_end, (SELECT min(date) AS a, max(date) AS z FROM panel_daily) b GROUP BY ALL)"""
YOY = f"""{ROLL}, yoy AS (SELECT c.*, p.revenue AS revenue_prior, CASE WHEN c.revenue > 0 AND p.revenue > 0 THEN ln(c.revenue / p.revenue) END AS rev_yoy, CASE WHEN c.panel > 0 AND p.panel > 0 AND c.complete AND p.complete THEN ln(c.panel / p.panel) END AS panel_yoy
  FROM roll c JOIN roll p ON p.ticker = c.ticker AND p.fiscal_quarter = c.fiscal_quarter AND p.fiscal_year = c.fiscal_year - 1)"""


def daily(spark: SparkSession, d: str) -> DataFrame:
    """Each ticker's daily spend, all customers' and the panel's (every third customer), from one pass over the
    transactions. A row a ticker and day, written, as all of the forecasts' inputs are sums of it."""
    of_panel = F.col("user_id") % 3 == 0
    rows = tagged(spark, d).groupBy(F.col("txn_date").alias("date"), "ticker")
    return written(rows.agg(F.sum("amount").alias("spend"), F.sum(F.when(of_panel, F.col("amount"))).cast("double").alias("raw")), "ticker-days")


def rollup(spark: SparkSession, d: str) -> DataFrame:
    """Panel spend summed over exact fiscal periods. The panel has each day from its first to its last one (a day without
    a ticker's transaction is a day of no spend), and a period counts as complete with all of its days."""
    days = daily(spark, d)
    p = days.where("raw IS NOT NULL").select("date", "ticker", "raw")
    j = range_join(p, quarters(days), ["ticker"], "date", "period_start", "period_end")
    keys = ["ticker", "fiscal_year", "fiscal_quarter", "period_start", "period_end", "period_days", "filed", "revenue"]
    g = j.groupBy(*keys).agg(F.sum("raw").alias("panel")).crossJoin(F.broadcast(p.agg(F.min("date").alias("first"), F.max("date").alias("last"))))  # one row
    seen = F.datediff(F.least("period_end", "last"), F.greatest("period_start", "first")) + 1
    return g.select(*keys, "panel", seen.cast("long").alias("days"), F.date_add("period_end", 7).alias("nowcast_date"), (seen == F.col("period_days")).alias("complete"))


def growth(spark: SparkSession, d: str) -> DataFrame:
    """Log growth on the same quarter a year before, by key and not by row, so gaps do no harm."""
    r = rollup(spark, d)
    prior = r.select("ticker", (F.col("fiscal_year") + 1).alias("fiscal_year"), "fiscal_quarter", F.col("revenue").alias("revenue_prior"), F.col("panel").alias("panel_prior"), F.col("complete").alias("complete_prior"))
    j = r.join(prior, ["ticker", "fiscal_year", "fiscal_quarter"])
    both = lambda a, b: F.when((F.col(a) > 0) & (F.col(b) > 0), F.ln(F.col(a) / F.col(b)))
    return j.withColumn("rev_yoy", both("revenue", "revenue_prior")).withColumn("panel_yoy", F.when(F.col("complete") & F.col("complete_prior"), both("panel", "panel_prior")))


@query(f"WITH {ROLL} SELECT ticker, fiscal_year, fiscal_quarter, round(panel, 2) AS panel, days, complete, nowcast_date, CAST(filed - nowcast_date AS BIGINT) AS lead_days FROM roll")
def fiscal_rollup(spark: SparkSession, d: str) -> DataFrame:
    r = rollup(spark, d)
    return r.select("ticker", "fiscal_year", "fiscal_quarter", F.round("panel", 2).alias("panel"), "days", "complete", "nowcast_date", F.datediff("filed", "nowcast_date").cast("long").alias("lead_days"))


@query(f"WITH {YOY} SELECT ticker, fiscal_year, fiscal_quarter, round(rev_yoy, 5) AS rev_yoy, round(panel_yoy, 5) AS panel_yoy FROM yoy")
def fiscal_yoy(spark: SparkSession, d: str) -> DataFrame:
    return growth(spark, d).select("ticker", "fiscal_year", "fiscal_quarter", F.round("rev_yoy", 5).alias("rev_yoy"), F.round("panel_yoy", 5).alias("panel_yoy"))


FEATURES = f"""{YOY}, feats AS (SELECT * FROM (SELECT ticker, period_end, filed, nowcast_date, revenue, revenue_prior, rev_yoy, panel_yoy, lag(rev_yoy) OVER w AS lag_yoy, lag(rev_yoy) OVER w - lag(panel_yoy) OVER w AS gap, panel_yoy - lag(panel_yoy) OVER w AS accel FROM yoy WINDOW w AS (PARTITION BY ticker ORDER BY period_end)) WHERE rev_yoy IS NOT NULL AND panel_yoy IS NOT NULL AND lag_yoy IS NOT NULL AND gap IS NOT NULL AND accel IS NOT NULL)"""
COLUMNS = ["panel_yoy", "lag_yoy", "gap", "accel"]


def features(spark: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("period_end")
    g = growth(spark, d)
    f = g.select("ticker", "period_end", "filed", "nowcast_date", "revenue", "revenue_prior", "rev_yoy", "panel_yoy", F.lag("rev_yoy").over(w).alias("lag_yoy"), (F.lag("rev_yoy").over(w) - F.lag("panel_yoy").over(w)).alias("gap"), (F.col("panel_yoy") - F.lag("panel_yoy").over(w)).alias("accel"))
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in ("rev_yoy", *COLUMNS)]
    return written(f.where(reduce(Column.__and__, finite)), "features")


@query(f"WITH {FEATURES} SELECT ticker, period_end, round(rev_yoy, 5) AS rev_yoy, round(lag_yoy, 5) AS lag_yoy, round(gap, 5) AS gap, round(accel, 5) AS accel FROM feats")
def quarterly_features(spark: SparkSession, d: str) -> DataFrame:
    return features(spark, d).select("ticker", "period_end", *[F.round(c, 5).alias(c) for c in ("rev_yoy", "lag_yoy", "gap", "accel")])


def masked(df: DataFrame, day: Column, hide: list[str], known: str = "filed", begun: str = "period_end") -> DataFrame:
    """What was known on a day: rows that had ended, without the values that weren't filed yet."""
    return df.where(F.col(begun) <= day).select(*[F.when(F.col(known) <= day, F.col(c)).alias(c) if c in hide else F.col(c) for c in df.columns])


@query("SELECT ticker, period_end, CASE WHEN filed <= DATE '1999-01-15' THEN round(revenue, 2) END AS revenue FROM fiscal WHERE period_end <= DATE '1999-01-15'")
def as_of_view(spark: SparkSession, d: str) -> DataFrame:
    return masked(fiscal(spark, d), F.lit("1999-01-15").cast("date"), ["revenue"]).select("ticker", "period_end", F.round("revenue", 2).alias("revenue"))


NAIVE = f"{FEATURES}, naive AS (SELECT t.ticker, t.period_end, t.filed, t.nowcast_date, t.rev_yoy, t.lag_yoy AS pred FROM feats t WHERE (SELECT count(*) FROM feats a WHERE a.filed < t.nowcast_date) >= 12)"
OLS = f"{FEATURES}, ols AS (SELECT t.ticker, t.period_end, t.filed, t.nowcast_date, t.rev_yoy, t.lag_yoy, t.revenue, t.revenue_prior, regr_intercept(a.rev_yoy, a.panel_yoy) + regr_slope(a.rev_yoy, a.panel_yoy) * t.panel_yoy AS pred FROM feats t JOIN feats a ON a.filed < t.nowcast_date GROUP BY t.ticker, t.period_end, t.filed, t.nowcast_date, t.rev_yoy, t.lag_yoy, t.revenue, t.revenue_prior, t.panel_yoy HAVING count(*) >= 12)"


def by_date(f: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Each nowcast_date with `sums` over all rows filed before it: sums by filing date, then running sums over the
    calendar's dates, so no row meets another."""
    day = lambda c: F.unix_date(c).alias("day")
    filed = f.groupBy(day("filed")).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    asked = f.select(day("nowcast_date")).distinct()
    before = W.orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    return asked.join(filed, "day", "full").select("day", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums]).join(asked, "day").withColumn("nowcast_date", F.date_from_unix_date("day")).drop("day")


def fits(spark: SparkSession, d: str, f: DataFrame | None = None) -> DataFrame:
    """The rows with the line (n, m, b) fitted to what was filed before, from running sums."""
    f = features(spark, d) if f is None else f
    x, y = F.col("panel_yoy"), F.col("rev_yoy")
    s = by_date(f, {"n": F.lit(1).cast("long"), "sx": x, "sy": y, "sxx": x * x, "sxy": x * y}).where("n >= 12")
    m = F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    line = s.withColumn("m", m).select("nowcast_date", "n", "m", ((F.col("sy") - F.col("m") * F.col("sx")) / F.col("n")).alias("b"))
    return f.join(line, "nowcast_date")


@query(f"WITH {NAIVE} SELECT ticker, period_end, round(pred, 5) AS pred FROM naive")
def walk_forward_naive(spark: SparkSession, d: str) -> DataFrame:
    return fits(spark, d).select("ticker", "period_end", F.round("lag_yoy", 5).alias("pred"))


@query(f"WITH {OLS} SELECT ticker, period_end, round(pred, 5) AS pred FROM ols")
def walk_forward_ols(spark: SparkSession, d: str) -> DataFrame:
    return fits(spark, d).select("ticker", "period_end", F.round(F.col("b") + F.col("m") * F.col("panel_yoy"), 5).alias("pred"))


@query()
def walk_forward_ridge(spark: SparkSession, d: str) -> DataFrame:
    return walk(features(spark, d), COLUMNS, ("ridge",))


@query()
def walk_forward_gbm(spark: SparkSession, d: str) -> DataFrame:
    return walk(features(spark, d), COLUMNS, ("gbm",))


@query()
def walk_forward_ensemble(spark: SparkSession, d: str) -> DataFrame:
    return walk(features(spark, d), COLUMNS, ("ensemble",))


INTERVALS = f"""{OLS}, past AS (SELECT c.ticker, c.period_end, c.pred, p.rev_yoy - p.pred AS err, row_number() OVER (PARTITION BY c.ticker, c.period_end ORDER BY p.nowcast_date DESC, p.ticker DESC) AS n FROM ols c JOIN ols p ON p.filed < c.nowcast_date)"""


@query(f"WITH {INTERVALS} SELECT ticker, period_end, round(pred + quantile_cont(err, 0.1), 5) AS lo, round(pred + quantile_cont(err, 0.9), 5) AS hi FROM past WHERE n <= 60 GROUP BY ticker, period_end, pred HAVING count(*) >= 20")
def empirical_intervals(spark: SparkSession, d: str) -> DataFrame:
    """80 % intervals from the last 60 errors that were known by then, at least 20. Of each filing date the last 60 are
    kept, so what a date looks back on is a list a filing date."""
    p = fits(spark, d).select("ticker", "period_end", "filed", "nowcast_date", "rev_yoy", (F.col("b") + F.col("m") * F.col("panel_yoy")).alias("pred"))
    p = written(p, "predictions")
    one = F.struct("nowcast_date", "ticker", (F.col("rev_yoy") - F.col("pred")).alias("err"))
    last = lambda xs: F.slice(F.sort_array(xs, False), 1, 60)
    filed = p.groupBy(F.unix_date("filed").alias("day")).agg(last(F.collect_list(one)).alias("errs"))
    asked = p.select(F.unix_date("nowcast_date").alias("day")).distinct()
    before = W.orderBy("day").rangeBetween(W.unboundedPreceding, -1)
    past = asked.join(filed, "day", "full").select("day", last(F.flatten(F.collect_list("errs").over(before))).alias("errs")).join(asked, "day")
    j = p.join(past.select(F.date_from_unix_date("day").alias("nowcast_date"), "errs"), "nowcast_date").where(F.size("errs") >= 20)
    e = F.array_sort(F.transform("errs", lambda x: x.err))

    def quantile(q: float) -> Column:
        at = (F.size("e") - 1) * F.lit(q)
        low, high = F.element_at("e", (F.floor(at) + 1).cast("int")), F.element_at("e", (F.ceil(at) + 1).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return j.withColumn("e", e).select("ticker", "period_end", F.round(F.col("pred") + quantile(0.1), 5).alias("lo"), F.round(F.col("pred") + quantile(0.9), 5).alias("hi"))


@query(f"""WITH {OLS}, m AS (SELECT 'panel' AS model, * FROM ols UNION ALL SELECT 'naive', * REPLACE (lag_yoy AS pred) FROM ols),
e AS (SELECT model, unnest(CASE WHEN period_end < DATE '1999-01-01' THEN ['all', 'early'] ELSE ['all', 'late'] END) AS segment, rev_yoy, pred, abs(rev_yoy - pred) AS e, abs(rev_yoy - lag_yoy) AS ne, abs(revenue_prior * exp(pred) / revenue - 1) AS pe FROM m)
SELECT model, segment, count(*) AS n, round(avg(e), 5) AS mae, round(median(e), 5) AS median_ae, round(sqrt(avg(e ** 2)), 5) AS rmse, round(avg(pe), 5) AS revenue_mape, round(avg(CASE WHEN sign(rev_yoy) = sign(pred) THEN 1.0 ELSE 0.0 END), 5) AS direction_acc,
  round(avg(CASE WHEN e < ne THEN 1.0 ELSE 0.0 END), 5) AS beats_naive FROM e GROUP BY model, segment""")
def forecast_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Errors of the panel's line and of the naive forecast, by segment; revenue is last year's grown by the forecast."""
    early = F.col("period_end") < F.lit("1999-01-01")
    both = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(s).alias("segment"), p.alias("pred")) for m, p in (("panel", F.col("b") + F.col("m") * F.col("panel_yoy")), ("naive", F.col("lag_yoy"))) for s in ("all", "early", "late")])
    p = fits(spark, d).select("*", F.inline(both)).where((F.col("segment") == "all") | ((F.col("segment") == "early") == early))
    err = F.abs(F.col("rev_yoy") - F.col("pred"))
    e = p.select("model", "segment", err.alias("e"), (err < F.abs(F.col("rev_yoy") - F.col("lag_yoy"))).cast("double").alias("better"), F.abs(F.col("revenue_prior") * F.exp("pred") / F.col("revenue") - 1).alias("pe"), (F.signum("rev_yoy") == F.signum("pred")).cast("double").alias("hit"))
    mean = lambda c: F.round(F.avg(c), 5)
    return e.groupBy("model", "segment").agg(
        F.count("*").alias("n"), mean("e").alias("mae"), F.round(F.median("e"), 5).alias("median_ae"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"),
        mean("pe").alias("revenue_mape"), mean("hit").alias("direction_acc"), mean("better").alias("beats_naive"),
    )


@query(f"WITH {YOY} SELECT ticker, CASE WHEN count(*) >= 6 THEN round(corr(rev_yoy, panel_yoy), 5) END AS r, count(*) AS n FROM yoy WHERE rev_yoy IS NOT NULL AND panel_yoy IS NOT NULL GROUP BY ticker")
def asset_corr(spark: SparkSession, d: str) -> DataFrame:
    g = growth(spark, d).where("rev_yoy IS NOT NULL AND panel_yoy IS NOT NULL")
    return g.groupBy("ticker").agg(F.when(F.count("*") >= 6, F.round(F.corr("rev_yoy", "panel_yoy"), 5)).alias("r"), F.count("*").alias("n"))


@query(f"""WITH {OLS}, s AS (SELECT o.ticker, count(*) AS n, avg(abs(o.rev_yoy - o.pred)) AS mae, avg(abs(f.rev_yoy - f.lag_yoy)) AS naive FROM ols o JOIN feats f ON f.ticker = o.ticker AND f.period_end = o.period_end GROUP BY o.ticker)
SELECT ticker, n, round(1 - mae / naive, 4) AS skill, CASE WHEN n < 8 THEN 'too short' WHEN 1 - mae / naive >= 0.3 THEN 'strong' WHEN 1 - mae / naive >= 0.1 THEN 'useful' WHEN 1 - mae / naive >= 0 THEN 'weak' ELSE 'none' END AS verdict FROM s""")
def asset_scorecard(spark: SparkSession, d: str) -> DataFrame:
    p = fits(spark, d).withColumn("pred", F.col("b") + F.col("m") * F.col("panel_yoy"))
    s = p.groupBy("ticker").agg(F.count("*").alias("n"), (1 - F.avg(F.abs(F.col("rev_yoy") - F.col("pred"))) / F.avg(F.abs(F.col("rev_yoy") - F.col("lag_yoy")))).alias("skill"))
    verdict = F.when(F.col("n") < 8, "too short").when(F.col("skill") >= 0.3, "strong").when(F.col("skill") >= 0.1, "useful").when(F.col("skill") >= 0, "weak").otherwise("none")
    return s.select("ticker", "n", F.round("skill", 4).alias("skill"), verdict.alias("verdict"))


@query(f"WITH {YOY} SELECT ticker, round(avg(e), 5) AS mae, round(median(e), 5) AS median_ae, round(quantile_cont(e, 0.9), 5) AS p90 FROM (SELECT ticker, abs(panel_yoy - rev_yoy) AS e FROM yoy) WHERE e IS NOT NULL GROUP BY ticker")
def panel_error_quantiles(spark: SparkSession, d: str) -> DataFrame:
    e = growth(spark, d).select("ticker", F.abs(F.col("panel_yoy") - F.col("rev_yoy")).alias("e")).where("e IS NOT NULL")
    return e.groupBy("ticker").agg(F.round(F.avg("e"), 5).alias("mae"), F.round(F.median("e"), 5).alias("median_ae"), F.round(F.percentile("e", F.lit(0.9)), 5).alias("p90"))


CONF = "conf AS (SELECT p_brand AS truth, CASE WHEN p_partkey % 13 = 0 THEN 'Brand#1' WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS pred, count(*) AS n, CAST(sum(abs(amount)) AS DOUBLE) AS spend FROM clean JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def confusion(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import clean

    k = F.col("p_partkey")
    parts = load(spark, d, "part").select(k.alias("l_partkey"), F.col("p_brand").alias("truth"), F.when(k % 13 == 0, "Brand#1").when(k % 17 != 0, F.col("p_brand")).alias("pred"))
    return clean(spark, d).join(parts, "l_partkey").groupBy("truth", "pred").agg(F.count("*").alias("n"), F.sum(F.abs("amount")).cast("double").alias("spend"))


@query(f"WITH {CONF} SELECT * FROM conf")
def er_confusion(spark: SparkSession, d: str) -> DataFrame:
    return confusion(spark, d)


PRF = "SELECT level, weight, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM (SELECT level, weight, sum(CASE WHEN p = t THEN w END) / sum(CASE WHEN p IS NOT NULL THEN w END) AS p, sum(CASE WHEN p = t THEN w END) / sum(w) AS r FROM keyed GROUP BY level, weight)"


@query(f"""WITH {CONF}, keyed AS (SELECT level, weight, CASE level WHEN 'brand' THEN truth ELSE 'T' || (CAST(substr(truth, 7) AS INT) % 5) END AS t, CASE level WHEN 'brand' THEN pred ELSE 'T' || (CAST(substr(pred, 7) AS INT) % 5) END AS p,
  CASE weight WHEN 'txns' THEN CAST(n AS DOUBLE) ELSE spend END AS w FROM conf, (VALUES ('brand'), ('ticker')) l(level), (VALUES ('txns'), ('spend')) v(weight)) {PRF}""")
def er_prf(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 at the level of brands and of their owners, by rows and by spend."""
    owner = lambda c: F.concat(F.lit("T"), F.substring(c, 7, 9).cast("int") % 5)
    one = lambda level, t, p, weight, w: F.struct(F.lit(level).alias("level"), t.alias("t"), p.alias("p"), F.lit(weight).alias("weight"), w.cast("double").alias("w"))
    cases = [one(level, t, p, weight, F.col(w)) for level, t, p in (("brand", F.col("truth"), F.col("pred")), ("ticker", owner("truth"), owner("pred"))) for weight, w in (("txns", "n"), ("spend", "spend"))]
    k = confusion(spark, d).select(F.inline(F.array(*cases)))
    hit = F.sum(F.when(F.col("p") == F.col("t"), F.col("w")))
    c = k.groupBy("level", "weight").agg((hit / F.sum(F.when(F.col("p").isNotNull(), F.col("w")))).alias("p"), (hit / F.sum("w")).alias("r"))
    return c.select("level", "weight", F.round("p", 6).alias("precision"), F.round("r", 6).alias("recall"), F.round(2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r")), 6).alias("f1"))


REPORTS = "reports AS (SELECT ticker, period_start, period_end, k, revenue * (1 + CASE WHEN k = 2 AND fiscal_quarter = 1 THEN 0.01 ELSE 0 END) AS val, CAST(filed + 20 * k AS DATE) AS filed FROM fiscal, (SELECT unnest([0, 1, 2]) AS k))"


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Each period reported three times; the last report of first quarters is restated."""
    f = fiscal(spark, d).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    val = F.col("revenue") * (1 + F.when((F.col("k") == 2) & (F.col("fiscal_quarter") == 1), 0.01).otherwise(0.0))
    return f.select("ticker", "period_start", "period_end", val.alias("val"), F.expr("date_add(filed, 20 * k)").alias("filed"))


@query(f"WITH {REPORTS} SELECT ticker, period_start, round(arg_min(val, filed), 2) AS revenue, round(arg_max(val, filed), 2) AS revenue_latest, abs(arg_max(val, filed) / arg_min(val, filed) - 1) > 0.001 AS restated FROM reports GROUP BY ALL")
def first_reported(spark: SparkSession, d: str) -> DataFrame:
    g = reports(spark, d).groupBy("ticker", "period_start").agg(F.min_by("val", "filed").alias("a"), F.max_by("val", "filed").alias("z"))
    return g.select("ticker", "period_start", F.round("a", 2).alias("revenue"), F.round("z", 2).alias("revenue_latest"), (F.abs(F.col("z") / F.col("a") - 1) > 0.001).alias("restated"))


@query(f"WITH {REPORTS} SELECT ticker, period_start, min(filed) AS first_public FROM reports GROUP BY ALL")
def first_public(spark: SparkSession, d: str) -> DataFrame:
    return reports(spark, d).groupBy("ticker", "period_start").agg(F.min("filed").alias("first_public"))


@query("""WITH a AS (SELECT ticker, fiscal_year, min(period_start) AS s, max(period_end) AS e, sum(revenue) AS total FROM fiscal GROUP BY ALL HAVING count(*) = 4), q AS (SELECT * FROM fiscal WHERE fiscal_quarter < 4)
SELECT a.ticker, a.fiscal_year, CAST(max(q.period_end) + 1 AS DATE) AS period_start, a.e AS period_end, round(a.total - sum(q.revenue), 2) AS revenue FROM a JOIN q ON q.ticker = a.ticker AND q.period_start >= a.s AND q.period_end <= a.e GROUP BY a.ticker, a.fiscal_year, a.e, a.total HAVING count(*) = 3""")
def q4_derivation(spark: SparkSession, d: str) -> DataFrame:
    """A year's last quarter is the year without the three quarters inside it."""
    f = fiscal(spark, d)
    year = f.groupBy("ticker", "fiscal_year").agg(F.min("period_start").alias("s"), F.max("period_end").alias("e"), F.sum("revenue").alias("total"), F.count("*").alias("n")).where("n = 4").drop("n")
    q = f.where("fiscal_quarter < 4").select("ticker", "period_start", "period_end", "revenue")
    j = year.join(q, "ticker").where("period_start >= s AND period_end <= e")
    g = j.groupBy("ticker", "fiscal_year", "e", "total").agg(F.count("*").alias("n"), F.max("period_end").alias("last"), F.sum("revenue").alias("three")).where("n = 3")
    return g.select("ticker", "fiscal_year", F.date_add("last", 1).alias("period_start"), F.col("e").alias("period_end"), F.round(F.col("total") - F.col("three"), 2).alias("revenue"))


@query("""WITH f AS (SELECT ticker, period_end, (SELECT min(e.period_end) FROM fiscal e WHERE e.ticker = f.ticker AND e.fiscal_quarter = 1 AND e.period_end >= f.period_end) AS fye FROM fiscal f), y AS (SELECT *, CAST(year(CAST(coalesce(fye, period_end + 364) - 7 AS DATE)) AS INT) AS fy FROM f)
SELECT ticker, period_end, fy, CAST(row_number() OVER (PARTITION BY ticker, fy ORDER BY period_end) AS INT) AS fq FROM y""")
def fiscal_labels(spark: SparkSession, d: str) -> DataFrame:
    """Fiscal year by the year's end less seven days (52/53-week years), quarter by its place in the year. The year ends with
    the calendar's first quarter here."""
    back = W.partitionBy("ticker").orderBy(F.col("period_end").desc())
    f = fiscal(spark, d).withColumn("fye", F.min(F.when(F.col("fiscal_quarter") == 1, F.col("period_end"))).over(back))
    f = f.withColumn("fy", F.year(F.date_sub(F.coalesce("fye", F.date_add("period_end", 364)), 7)))
    return f.select("ticker", "period_end", "fy", F.row_number().over(W.partitionBy("ticker", "fy").orderBy("period_end")).alias("fq"))


DAYS = "days AS (SELECT ticker, period_start, period_end, revenue, CAST(unnest(generate_series(CAST(period_start AS TIMESTAMP), CAST(period_end AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM fiscal)"


@query(f"WITH {DAYS}, n AS (SELECT ticker, period_start, revenue, coalesce(lead(revenue) OVER w, revenue) AS nxt FROM fiscal WINDOW w AS (PARTITION BY ticker ORDER BY period_start)) SELECT d.ticker, d.date, round(n.revenue + (n.nxt - n.revenue) * (d.date - d.period_start) / (d.period_end - d.period_start + 1) + 1e-6, 3) AS level FROM days d JOIN n ON n.ticker = d.ticker AND n.period_start = d.period_start")
def interp_linear(spark: SparkSession, d: str) -> DataFrame:
    """Each day's value on the line from its quarter's to the next one's; a hair is added so that no rounding is a tie."""
    nxt = F.coalesce(F.lead("revenue").over(W.partitionBy("ticker").orderBy("period_start")), F.col("revenue"))
    f = fiscal(spark, d).withColumn("nxt", nxt).withColumn("date", F.explode(days_of(F.col("period_start"), F.col("period_end"))))
    t = F.datediff("date", "period_start") / F.col("period_days")
    return f.select("ticker", "date", F.round(F.col("revenue") + (F.col("nxt") - F.col("revenue")) * t + 1e-6, 3).alias("level"))


@query(f"WITH {DAYS}, w AS (SELECT *, [1.0, 0.9, 0.95, 1.0, 1.3, 1.5, 1.1][isodow(date)] AS wt FROM days) SELECT ticker, date, round(revenue * wt / sum(wt) OVER (PARTITION BY ticker, period_start), 3) AS daily FROM w")
def seasonal_shape(spark: SparkSession, d: str) -> DataFrame:
    """A quarter's revenue over its days by weights of the weekdays; days sum to the quarter exactly."""
    f = fiscal(spark, d).withColumn("date", F.explode(days_of(F.col("period_start"), F.col("period_end"))))
    f = f.withColumn("wt", F.element_at(F.lit([1.0, 0.9, 0.95, 1.0, 1.3, 1.5, 1.1]), F.weekday("date") + 1))
    return f.select("ticker", "date", F.round(F.col("revenue") * F.col("wt") / F.sum("wt").over(W.partitionBy("ticker", "period_start")), 3).alias("daily"))


@query()
def pchip_daily(spark: SparkSession, d: str) -> DataFrame:
    """Daily values whose running total is a monotone cubic through the quarters' totals: slopes by the weighted harmonic
    mean of the neighbours' (Fritsch and Carlson), a Hermite polynomial inside each quarter, differences by day."""
    w = W.partitionBy("ticker").orderBy("period_start")
    f = fiscal(spark, d).withColumn("h", F.col("period_days").cast("double")).withColumn("s", F.greatest("revenue", F.lit(0.0)) / F.col("h"))
    f = f.withColumn("h0", F.lag("h").over(w)).withColumn("s0", F.lag("s").over(w)).withColumn("before", F.coalesce(F.sum(F.greatest("revenue", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    mean = (3 * (F.col("h") + F.col("h0"))) / ((2 * F.col("h") + F.col("h0")) / F.col("s0") + (F.col("h") + 2 * F.col("h0")) / F.col("s"))
    f = f.withColumn("m0", F.when(F.col("s0").isNull(), F.col("s")).when((F.col("s0") > 0) & (F.col("s") > 0), mean).otherwise(0.0))
    f = f.withColumn("m1", F.coalesce(F.lead("m0").over(w), F.col("s"))).withColumn("date", F.explode(days_of(F.col("period_start"), F.col("period_end"))))

    def total(t: Column) -> Column:
        h, y = F.col("h"), F.col("s") * F.col("h")
        return F.col("m0") * h * (t * t * t - 2 * t * t + t) + y * (3 * t * t - 2 * t * t * t) + F.col("m1") * h * (t * t * t - t * t)

    t = F.datediff("date", "period_start") / F.col("h")
    return f.select("ticker", "period_start", "date", (total(t + 1 / F.col("h")) - total(t)).alias("daily"))


@query("""SELECT y, CAST(make_date(y, 11, 1) + CAST((4 - isodow(make_date(y, 11, 1)) + 7) % 7 + 21 AS INT) AS DATE) AS thanksgiving, CAST(make_date(y, 5, 1) + CAST((7 - isodow(make_date(y, 5, 1)) + 7) % 7 + 7 AS INT) AS DATE) AS mothers_day, CASE WHEN y >= 2022 THEN CAST(make_date(y, 2, 1) + CAST((7 - isodow(make_date(y, 2, 1)) + 7) % 7 + 7 AS INT) AS DATE) ELSE CAST(make_date(y, 2, 1) + CAST((7 - isodow(make_date(y, 2, 1)) + 7) % 7 + 0 AS INT) AS DATE) END AS super_bowl,
CAST(make_date(y, 9, 1) + CAST((1 - isodow(make_date(y, 9, 1)) + 7) % 7 + 0 AS INT) AS DATE) AS labor_day, CAST(make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT) AS DATE) AS memorial_day FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders UNION SELECT 2022 UNION SELECT 2026)""")
def nth_weekday(spark: SparkSession, d: str) -> DataFrame:
    """The floating holidays of the years of the orders, and of two later ones."""
    y = load(spark, d, "orders").select(F.year("o_orderdate").alias("y")).union(spark.createDataFrame([(2022,), (2026,)], "y int")).distinct()
    c = F.col("y")
    return y.select("y", nth(c, 11, "Thu", 4).alias("thanksgiving"), nth(c, 5, "Sun", 2).alias("mothers_day"), super_bowl(c).alias("super_bowl"), nth(c, 9, "Mon", 1).alias("labor_day"), nth(c, 5, "Mon", -1).alias("memorial_day"))


@query()
def daily_curve(spark: SparkSession, d: str) -> DataFrame:
    """A quarter's revenue by day: the smooth curve, weekdays and holidays together, scaled so that days sum to the quarter."""
    smooth = pchip_daily(spark, d).withColumn("wt", F.element_at(F.lit([1.0, 0.9, 0.95, 1.0, 1.3, 1.5, 1.1]), F.weekday("date") + 1) * holiday_factor(F.col("date"), "retail"))
    over = W.partitionBy("ticker", "period_start")
    shaped = F.col("daily") * F.col("wt")
    return smooth.select("ticker", "period_start", "date", F.coalesce(F.try_divide(shaped * F.sum("daily").over(over), F.sum(shaped).over(over)), F.lit(0.0)).alias("daily"))


@query("""WITH RECURSIVE f AS (SELECT ticker, revenue, row_number() OVER (PARTITION BY ticker ORDER BY period_start) AS n FROM fiscal), r AS (SELECT ticker, n, revenue / 1e6 AS x FROM f WHERE n = 1 UNION ALL SELECT f.ticker, f.n, 0.7 * r.x + f.revenue / 1e6 FROM r JOIN f ON f.ticker = r.ticker AND f.n = r.n + 1)
SELECT ticker, n, round(x, 5) AS x FROM r""")
def ar1_fold(spark: SparkSession, d: str) -> DataFrame:
    """x[n] = 0.7 x[n-1] + e[n], folded over each ticker's ordered values."""
    f = fiscal(spark, d).groupBy("ticker").agg(F.transform(F.array_sort(F.collect_list(F.struct("period_start", "revenue"))), lambda x: x["revenue"] / 1e6).alias("e"))
    fold = F.aggregate("e", F.array().cast("array<double>"), lambda acc, e: F.array_append(acc, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)) * 0.7 + e))
    return f.select("ticker", F.posexplode(fold).alias("k", "x")).select("ticker", (F.col("k") + 1).cast("long").alias("n"), F.round("x", 5).alias("x"))


DIMS = {"seg": {"AUTOMOBILE": 0.3, "BUILDING": 0.25, "FURNITURE": 0.2, "HOUSEHOLD": 0.15, "MACHINERY": 0.1}, "bal": {"low": 0.4, "mid": 0.35, "high": 0.25}}


@query("SELECT seg, bal, round(a.share * b.share, 6) AS share FROM (VALUES ('AUTOMOBILE', 0.3), ('BUILDING', 0.25), ('FURNITURE', 0.2), ('HOUSEHOLD', 0.15), ('MACHINERY', 0.1)) a(seg, share), (VALUES ('low', 0.4), ('mid', 0.35), ('high', 0.25)) b(bal, share)")
def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    """The population's cells as products of its margins."""
    seg = F.explode(F.create_map(*[x for k, v in DIMS["seg"].items() for x in (F.lit(k), F.lit(v))])).alias("seg", "a")
    bal = F.explode(F.create_map(*[x for k, v in DIMS["bal"].items() for x in (F.lit(k), F.lit(v))])).alias("bal", "b")
    return spark.range(1).select(seg).select("seg", "a", bal).select("seg", "bal", F.round(F.col("a") * F.col("b"), 6).alias("share"))


def shares(spark: SparkSession, d: str) -> DataFrame:
    """Raked shares of the members' cells by year of joining."""
    m = member(spark, d).groupBy(F.year("join_date").alias("year"), "seg", "bal").agg(F.count("*").alias("members"))
    return raked_shares(m, ["year"], DIMS, "members")


@query()
def rake_ipf(spark: SparkSession, d: str) -> DataFrame:
    return shares(spark, d).select("year", "seg", "bal", "members", F.round("share", 8).alias("share"))


def cell_spend(spark: SparkSession, d: str) -> DataFrame:
    cells = member(spark, d).select("user_id", "seg")
    t = tagged(spark, d).join(cells, "user_id")
    return t.groupBy(F.year("txn_date").alias("year"), "ticker", "seg").agg(F.sum("amount").cast("double").alias("spend"), F.countDistinct("user_id").alias("members"))


CELL = "cell AS (SELECT CAST(year(txn_date) AS INT) AS year, ticker, seg, CAST(sum(amount) AS DOUBLE) AS spend, count(DISTINCT tagged.user_id) AS members FROM tagged JOIN member ON member.user_id = tagged.user_id GROUP BY ALL)"
TARGET = "tgt AS (SELECT * FROM (VALUES ('AUTOMOBILE', 0.3), ('BUILDING', 0.25), ('FURNITURE', 0.2), ('HOUSEHOLD', 0.15), ('MACHINERY', 0.1)) t(seg, share))"


@query(f"WITH {CELL} SELECT year, ticker, round(sum(spend) / sum(members), 4) AS clean FROM cell WHERE NOT (seg = 'BUILDING' AND year % 2 = 0) GROUP BY ALL")
def clean_estimator(spark: SparkSession, d: str) -> DataFrame:
    """Spend per member without excluded cells."""
    c = cell_spend(spark, d).where("NOT (seg = 'BUILDING' AND year % 2 = 0)")
    return c.groupBy("year", "ticker").agg(F.round(F.sum("spend") / F.sum("members"), 4).alias("clean"))


@query(f"WITH {CELL}, {TARGET} SELECT year, ticker, round(sum(CAST(share AS DOUBLE) * spend / members) / sum(CAST(share AS DOUBLE)), 4) AS raked FROM cell JOIN tgt USING (seg) GROUP BY ALL")
def raked_estimator(spark: SparkSession, d: str) -> DataFrame:
    """Cells' spend per member, weighted by the population's shares."""
    return weighted(cell_spend(spark, d)).groupBy("year", "ticker").agg(F.round(F.sum(F.col("share") * F.col("spend") / F.col("members")) / F.sum("share"), 4).alias("raked"))


def weighted(cells: DataFrame) -> DataFrame:
    share = F.create_map(*[x for k, v in DIMS["seg"].items() for x in (F.lit(k), F.lit(v))])
    return cells.withColumn("share", F.element_at(share, F.col("seg"))).where("share IS NOT NULL")


@query(f"WITH {CELL}, {TARGET}, a AS (SELECT year, ticker, sum(spend) AS raw, sum(spend) / sum(members) AS per_member FROM cell GROUP BY ALL), r AS (SELECT year, ticker, sum(CAST(share AS DOUBLE) * spend / members) / sum(CAST(share AS DOUBLE)) AS raked FROM cell JOIN tgt USING (seg) WHERE members > 5 GROUP BY ALL) SELECT coalesce(a.year, r.year) AS year, coalesce(a.ticker, r.ticker) AS ticker, round(raw, 2) AS raw, round(per_member, 4) AS per_member, round(raked, 4) AS raked FROM a FULL JOIN r ON a.year = r.year AND a.ticker = r.ticker")
def ticker_daily(spark: SparkSession, d: str) -> DataFrame:
    """The estimators side by side; one that lacks a period leaves null."""
    c = cell_spend(spark, d)
    a = c.groupBy("year", "ticker").agg(F.round(F.sum("spend"), 2).alias("raw"), F.round(F.sum("spend") / F.sum("members"), 4).alias("per_member"))
    r = weighted(c.where("members > 5")).groupBy("year", "ticker").agg(F.round(F.sum(F.col("share") * F.col("spend") / F.col("members")) / F.sum("share"), 4).alias("raked"))
    return a.join(r, ["year", "ticker"], "full")
