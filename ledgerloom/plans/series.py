"""Time-series queries: consensus ratios, baselines, flags, events, actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.intervals import days_of, islands
from ..operators.series import flagged, with_baseline
from ..operators.series import tagging_breaks as breaks_of
from ..sources.views import event_day, fiscal, load, source_daily, tagged, txn
from .registry import query

DAILY = """daily AS (SELECT date, source, txns, members, CAST(txns AS DOUBLE) / members AS rate, spend / txns AS ticket FROM source_daily)"""
RATIO = f"""{DAILY}, med AS (SELECT date, median(rate) AS mr, median(ticket) AS mt FROM daily GROUP BY date),
ratio AS (SELECT date, source, txns, members, ln(rate / mr) AS lr_rate, CASE WHEN ticket / mt > 0 THEN ln(ticket / mt) END AS lr_ticket FROM daily JOIN med USING (date))"""


def ratios(spark: SparkSession, d: str) -> DataFrame:
    """Logs of each source's rate and ticket against the day's median over sources."""
    s = source_daily(spark, d).select("date", "source", "txns", "members", (F.col("txns") / F.col("members")).alias("rate"), (F.col("spend") / F.col("txns")).alias("ticket"))
    med = s.groupBy("date").agg(F.median("rate").alias("mr"), F.median("ticket").alias("mt"))
    t = F.try_divide("ticket", "mt")
    return s.join(med, "date").select("date", "source", "txns", "members", F.ln(F.col("rate") / F.col("mr")).alias("lr_rate"), F.when(t > 0, F.ln(t)).alias("lr_ticket"))


@query(f"WITH {RATIO} SELECT date, source, round(lr_rate, 5) AS lr_rate, round(lr_ticket, 5) AS lr_ticket FROM ratio")
def source_consensus_ratio(spark: SparkSession, d: str) -> DataFrame:
    return ratios(spark, d).select("date", "source", F.round("lr_rate", 5).alias("lr_rate"), F.round("lr_ticket", 5).alias("lr_ticket"))


@query("SELECT date, source, ticker, round(ln((n + 1e-9) / (median(n) OVER (PARTITION BY date, ticker) + 1e-9)), 5) AS lr FROM event_day")
def consensus_log_ratio(spark: SparkSession, d: str) -> DataFrame:
    med = F.median("n").over(W.partitionBy("date", "ticker"))
    return event_day(spark, d).select("date", "source", "ticker", F.round(F.ln((F.col("n") + 1e-9) / (med + 1e-9)), 5).alias("lr"))


BASE = f"""{RATIO}, base AS (SELECT *, CASE WHEN count(lr_rate) OVER w >= 14 THEN median(lr_rate) OVER w END AS rate_base, CASE WHEN count(lr_rate) OVER w >= 14 THEN 1.4826 * mad(lr_rate) OVER w END AS rate_scale,
  CASE WHEN count(lr_ticket) OVER w >= 14 THEN median(lr_ticket) OVER w END AS ticket_base FROM ratio WINDOW w AS (PARTITION BY source ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING))"""


@query(f"WITH {BASE} SELECT date, source, round(rate_base, 5) AS rate_base, round(rate_scale, 5) AS rate_scale FROM base")
def trailing_baseline(spark: SparkSession, d: str) -> DataFrame:
    s = with_baseline(ratios(spark, d), "lr_rate", 28, ["source"], "rate")
    return s.select("date", "source", F.round("rate_base", 5).alias("rate_base"), F.round("rate_scale", 5).alias("rate_scale"))


@query(f"WITH {BASE} SELECT date, source, round((lr_rate - rate_base) / greatest(rate_scale, 0.02), 4) AS z FROM base")
def robust_z(spark: SparkSession, d: str) -> DataFrame:
    s = with_baseline(ratios(spark, d), "lr_rate", 28, ["source"], "rate")
    return s.select("date", "source", F.round((F.col("lr_rate") - F.col("rate_base")) / F.greatest("rate_scale", F.lit(0.02)), 4).alias("z"))


#: Looser thresholds than production's, as the test series are short and noisy.
FLAGS = f"""{BASE}, z AS (SELECT *, (lr_rate - rate_base) / greatest(rate_scale, 0.02) AS z, exp(lr_rate - rate_base) - 1 AS change, lr_ticket - ticket_base AS jump FROM base),
flags AS (SELECT date, source, CASE WHEN txns = 0 THEN 'outage' WHEN jump BETWEEN 1.0 AND 2.0 OR jump BETWEEN -2.0 AND -1.0 THEN 'unit_error' WHEN z <= -2 AND change <= -0.2 THEN 'volume_drop' WHEN z >= 2 AND change >= 0.5 THEN 'volume_spike' END AS type,
  CASE WHEN txns = 0 THEN -99.0 WHEN jump BETWEEN 1.0 AND 2.0 OR jump BETWEEN -2.0 AND -1.0 THEN jump ELSE z END AS score,
  CASE WHEN txns = 0 THEN 'exclude' WHEN jump BETWEEN 1.0 AND 2.0 OR jump BETWEEN -2.0 AND -1.0 THEN 'rescale' WHEN z <= -2 THEN 'exclude' ELSE 'flag' END AS action,
  CASE WHEN txns = 0 THEN 1.0 WHEN jump BETWEEN 1.0 AND 2.0 THEN 0.01 WHEN jump BETWEEN -2.0 AND -1.0 THEN 100.0 ELSE 1.0 END AS factor FROM z WHERE members > 0)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    return flagged(ratios(spark, d), 28, 2.0, (1.0, 2.0), 0.2)


@query(f"WITH {FLAGS} SELECT date, source, type, round(CAST(score AS DOUBLE), 4) AS score, action, CAST(factor AS DOUBLE) AS factor FROM flags WHERE type IS NOT NULL")
def source_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("date", "source", "type", F.round("score", 4).alias("score"), "action", "factor")


EVENTS = f"""{FLAGS}, f AS (SELECT DISTINCT source, type, date FROM flags WHERE type IS NOT NULL), m AS (SELECT *, CASE WHEN date - lag(date) OVER w <= 2 THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY source, type ORDER BY date)),
isl AS (SELECT source, type, min(date) AS start, max(date) AS "end", CAST(max(date) - min(date) + 1 AS INT) AS n_days FROM (SELECT *, sum(new) OVER (PARTITION BY source, type ORDER BY date) AS run FROM m) GROUP BY source, type, run),
events AS (SELECT source, CASE WHEN type = 'outage' AND n_days > 14 THEN 'source_dropout' ELSE type END AS type, start, "end", n_days, CASE type WHEN 'unit_error' THEN 'rescale' WHEN 'volume_spike' THEN 'flag' ELSE 'exclude' END AS action FROM isl)"""


def events(spark: SparkSession, d: str) -> DataFrame:
    e = islands(flags(spark, d), ["source", "type"])
    kind = F.when((F.col("type") == "outage") & (F.col("n_days") > 14), "source_dropout").otherwise(F.col("type"))
    action = F.when(F.col("type") == "unit_error", "rescale").when(F.col("type") == "volume_spike", "flag").otherwise("exclude")
    return e.select("source", kind.alias("type"), "start", "end", "n_days", action.alias("action"))


@query(f'WITH {EVENTS} SELECT * FROM events')
def gaps_islands_events(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d)


@query(f"""WITH {FLAGS}, f AS (SELECT date, source, CAST(NULL AS VARCHAR) AS ticker, type, action, CAST(factor AS DOUBLE) AS factor FROM flags WHERE type IS NOT NULL),
spans AS (SELECT ticker, 'SRC_1' AS source, period_start AS start, CAST(period_start + 10 AS DATE) AS "end" FROM fiscal WHERE fiscal_quarter = 1)
SELECT * FROM f UNION ALL SELECT CAST(unnest(generate_series(CAST(start AS TIMESTAMP), CAST("end" AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE), source, ticker, 'tagging_break', 'exclude', 1.0 FROM spans""")
def anomaly_actions(spark: SparkSession, d: str) -> DataFrame:
    """What to do on which day: flags of whole sources, and each day of the spans of single tickers."""
    spans = fiscal(spark, d).where("fiscal_quarter = 1").select("ticker", F.explode(days_of(F.col("period_start"), F.date_add("period_start", 10))).alias("date"))
    days = spans.select("date", F.lit("SRC_1").alias("source"), "ticker", F.lit("tagging_break").alias("type"), F.lit("exclude").alias("action"), F.lit(1.0).alias("factor"))
    f = flags(spark, d).select("date", "source", F.lit(None).cast("string").alias("ticker"), "type", "action", "factor")
    return f.unionByName(days)


DUPLICATES = """SELECT source, delivery, min(post_date) AS start, max(post_date) AS "end", count(*) AS n_rows FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY CASE WHEN delivery = 'redelivery' THEN 1 ELSE 0 END, post_date, l_partkey, l_suppkey, l_quantity, amount) AS rn FROM txn) WHERE rn > 1 GROUP BY ALL HAVING count(*) >= 25"""


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    from .ingest import KEEP_ORDER, keep_others, redelivered

    again = keep_others(redelivered(txn(spark, d)), ["txn_id"], KEEP_ORDER)
    return again.groupBy("source", "delivery").agg(F.min("post_date").alias("start"), F.max("post_date").alias("end"), F.count("*").alias("n_rows")).where("n_rows >= 25")


@query(DUPLICATES)
def duplicate_delivery_events(spark: SparkSession, d: str) -> DataFrame:
    return duplicates(spark, d)


@query(f"""WITH {EVENTS}, d AS ({DUPLICATES}) SELECT type, source, start, "end", n_days, action FROM events UNION ALL SELECT 'duplicate_delivery', source, start, "end", CAST("end" - start + 1 AS INT), 'dropped' FROM d""")
def anomaly_events_union(spark: SparkSession, d: str) -> DataFrame:
    dup = duplicates(spark, d).select(F.lit("duplicate_delivery").alias("type"), "source", "start", "end", (F.datediff("end", "start") + 1).alias("n_days"), F.lit("dropped").alias("action"))
    return events(spark, d).unionByName(dup).select("type", "source", "start", "end", "n_days", "action")


SEVEN = """by_ticker AS (SELECT txn_date AS date, source, ticker, count(*) AS txns FROM tagged GROUP BY ALL),
dense AS (SELECT s.date, s.source, t.ticker, CASE WHEN s.members % 11 = 0 THEN NULL ELSE coalesce(b.txns, 0) END AS txns, CASE WHEN s.members % 11 = 0 THEN NULL ELSE s.members END AS members
  FROM source_daily s CROSS JOIN (SELECT DISTINCT ticker FROM brand) t LEFT JOIN by_ticker b ON b.date = s.date AND b.source = s.source AND b.ticker = t.ticker),
roll AS (SELECT date, source, ticker, CASE WHEN count(txns) OVER w >= 5 THEN CAST(sum(txns) OVER w AS DOUBLE) END AS txns7, CASE WHEN count(txns) OVER w >= 5 THEN CAST(sum(members) OVER w AS DOUBLE) END AS members7 FROM dense WINDOW w AS (PARTITION BY source, ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)),
con AS (SELECT date, ticker, median(txns7 / members7) AS c7 FROM roll GROUP BY ALL)"""


def seven_days(spark: SparkSession, d: str) -> DataFrame:
    """Trailing seven rows of each source and ticker, excluded days without values, and the consensus over sources."""
    from ..operators.intervals import grid
    from ..sources.views import brand

    tickers = brand(spark, d).select("ticker").distinct()
    dense = grid(source_daily(spark, d).select("date", "source", "members"), tickers, ["ticker"], [tuple(r) for r in tickers.orderBy("ticker").collect()])
    per = tagged(spark, d).groupBy(F.col("txn_date").alias("date"), "source", "ticker").agg(F.count("*").alias("txns"))
    used = F.col("members") % 11 != 0
    dense = dense.join(per, ["date", "source", "ticker"], "left").select("date", "source", "ticker", F.when(used, F.coalesce("txns", F.lit(0))).alias("txns"), F.when(used, F.col("members")).alias("members"))
    w = W.partitionBy("source", "ticker").orderBy("date").rowsBetween(-6, 0)
    total = lambda c: F.when(F.count("txns").over(w) >= 5, F.sum(c).over(w).cast("double"))
    roll = dense.select("date", "source", "ticker", total("txns").alias("txns7"), total("members").alias("members7"))
    con = roll.groupBy("date", "ticker").agg(F.median(F.col("txns7") / F.col("members7")).alias("c7"))
    return roll.join(con, ["date", "ticker"])


@query(f"WITH {SEVEN} SELECT date, source, ticker, txns7, members7, round(c7, 6) AS c7 FROM roll JOIN con USING (date, ticker)")
def ticker_consensus_7d(spark: SparkSession, d: str) -> DataFrame:
    return seven_days(spark, d).select("date", "source", "ticker", "txns7", "members7", F.round("c7", 6).alias("c7"))


@query()
def tagging_breaks(spark: SparkSession, d: str) -> DataFrame:
    """Each source's spans of days on which it lacks a ticker's transactions; SRC_1 loses T1 after 1999."""
    s = seven_days(spark, d)
    lost = (F.col("source") == "SRC_1") & (F.col("ticker") == "T1") & (F.col("date") > F.lit("1999-01-01"))
    return breaks_of(s.withColumn("txns7", F.when(lost, F.floor(F.col("txns7") * 0.05)).otherwise(F.col("txns7"))))


VIEWS_Q = "q AS (SELECT ticker, CAST(date_trunc('quarter', txn_date) AS DATE) AS quarter, greatest(median(CAST(amount AS DOUBLE) * (1 + l_partkey % 3 * 20)), 1) AS m FROM tagged WHERE amount > 0 GROUP BY ALL)"


@query(f"WITH {VIEWS_Q} SELECT ticker, quarter, round(ratio, 4) AS ratio FROM (SELECT *, m / lag(m) OVER (PARTITION BY ticker ORDER BY quarter) AS ratio FROM q) WHERE ratio >= 1.05 OR ratio <= 1 / 1.05")
def rename_suspects(spark: SparkSession, d: str) -> DataFrame:
    """Quarters whose median is a multiple or a fraction of the one before. Production asks for 10 and 0.1; the test series move less."""
    t = tagged(spark, d).where("amount > 0").withColumn("v", F.col("amount").cast("double") * (1 + F.col("l_partkey") % 3 * 20))
    q = t.groupBy("ticker", F.to_date(F.date_trunc("quarter", "txn_date")).alias("quarter")).agg(F.greatest(F.median("v"), F.lit(1.0)).alias("m"))
    r = q.withColumn("ratio", F.col("m") / F.lag("m").over(W.partitionBy("ticker").orderBy("quarter")))
    return r.where("ratio >= 1.05 OR ratio <= 1 / 1.05D").select("ticker", "quarter", F.round("ratio", 4).alias("ratio"))


@query(f"""WITH p AS (SELECT ticker, date, ln(1 + greatest(raw, 0)) AS x, raw FROM panel_daily), b AS (SELECT *, CASE WHEN count(x) OVER w >= 14 THEN median(x) OVER w END AS base, CASE WHEN count(x) OVER w >= 14 THEN 1.4826 * mad(x) OVER w END AS scale FROM p WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING)),
z AS (SELECT ticker, date, raw, (x - base) / greatest(scale, 0.05) AS z FROM b) SELECT ticker, date, round(z, 4) AS z FROM z WHERE z >= 1.5 AND raw >= 1000""")
def attention_spikes(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.views import panel_daily

    p = panel_daily(spark, d).withColumn("x", F.log1p(F.greatest("raw", F.lit(0.0))))
    z = with_baseline(p, "x", 28, ["ticker"], "x").withColumn("z", (F.col("x") - F.col("x_base")) / F.greatest("x_scale", F.lit(0.05)))
    return z.where("z >= 1.5 AND raw >= 1000").select("ticker", "date", F.round("z", 4).alias("z"))


GAPPY = "g AS (SELECT ticker, period_start, period_end FROM fiscal WHERE (fiscal_year * 4 + fiscal_quarter + CAST(substr(ticker, 2) AS INT)) % 9 <> 0)"


@query(f"WITH {GAPPY}, b AS (SELECT *, CASE WHEN lead(period_start) OVER w = CAST(period_end + 1 AS DATE) OR lead(period_start) OVER w IS NULL THEN 0 ELSE 1 END AS gap FROM g WINDOW w AS (PARTITION BY ticker ORDER BY period_start)) SELECT ticker, period_start FROM (SELECT *, sum(gap) OVER (PARTITION BY ticker ORDER BY period_start DESC) AS gaps FROM b) WHERE gaps = 0")
def contiguous_tail(spark: SparkSession, d: str) -> DataFrame:
    """The latest periods without a gap between them."""
    g = fiscal(spark, d).where("(fiscal_year * 4 + fiscal_quarter + CAST(substr(ticker, 2) AS INT)) % 9 <> 0")
    next_start = F.lead("period_start").over(W.partitionBy("ticker").orderBy("period_start"))
    b = g.withColumn("gap", F.when(next_start != F.date_add("period_end", 1), 1).otherwise(0))
    return b.withColumn("gaps", F.sum("gap").over(W.partitionBy("ticker").orderBy(F.col("period_start").desc()))).where("gaps = 0").select("ticker", "period_start")


@query(f"WITH {GAPPY} SELECT ticker, period_start, prev_end, CASE WHEN period_start <= prev_end THEN 'overlap' WHEN period_start > prev_end + 1 THEN 'gap' ELSE 'ok' END AS verdict FROM (SELECT *, lag(period_end) OVER (PARTITION BY ticker ORDER BY period_start) AS prev_end FROM g) WHERE prev_end IS NOT NULL")
def period_gap_check(spark: SparkSession, d: str) -> DataFrame:
    g = fiscal(spark, d).where("(fiscal_year * 4 + fiscal_quarter + CAST(substr(ticker, 2) AS INT)) % 9 <> 0")
    p = g.withColumn("prev_end", F.lag("period_end").over(W.partitionBy("ticker").orderBy("period_start"))).where("prev_end IS NOT NULL")
    verdict = F.when(F.col("period_start") <= F.col("prev_end"), "overlap").when(F.col("period_start") > F.date_add("prev_end", 1), "gap").otherwise("ok")
    return p.select("ticker", "period_start", "prev_end", verdict.alias("verdict"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY ALL")
def tumbling_window(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("t", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n", "total")


@query("SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 12 HOUR * CASE WHEN hour(ts) < 12 THEN 1 ELSE -1 END]) AS s FROM events) GROUP BY ALL")
def sliding_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows of a day that begin every twelve hours."""
    e = load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("t", "1 day", "12 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM r GROUP BY user_id, run""")
def session_window(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that end after six hours without an event."""
    e = load(spark, d, "events").withColumn("t", F.col("ts").cast("timestamp"))
    w = e.groupBy("user_id", F.session_window("t", "6 hours").alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("last"), F.count("*").alias("n"))
    return w.select("user_id", "start", "last", "n")
