"""What operators must do on small made-up rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text as tx
from ledgerloom.operators import quality, series, simulate
from ledgerloom.operators.intervals import days_of, islands
from ledgerloom.operators.weighting import raked_shares
from ledgerloom.plans import QUERIES
from ledgerloom.plans.fiscal import masked
from ledgerloom.plans.notes import Research, claims_of, guarded_sql, verify
from ledgerloom.sources.tables import Catalog

RAW = "txn_id string, user_id string, txn_date string, post_date string, amount string, currency string, merchant_descriptor string, mcc string, delivery string, n int"


def raw(spark, rows):
    base = dict(txn_id="t", user_id="u", txn_date="2024-01-05", post_date="2024-01-06", amount="10.00", currency="USD", merchant_descriptor="SHOP", mcc="5411", delivery="daily", n=0)
    return spark.createDataFrame([tuple((base | r).values()) for r in rows], RAW)


def test_expectations(spark):
    rows = [{}, {"txn_date": "2024-13-45"}, {"amount": "12.3O"}, {"amount": "99999"}, {"merchant_descriptor": None}, {"currency": None, "mcc": "x"}, {"txn_date": "2009-12-31"}, {"user_id": " "}]
    got = [r.dq_reasons for r in quality.parse(raw(spark, [r | {"n": k} for k, r in enumerate(rows)]), max_date="2024-12-31").orderBy("n").collect()]
    assert got == [[], ["bad_txn_date"], ["bad_amount"], ["amount_out_of_range"], ["missing_descriptor"], ["bad_currency", "bad_mcc"], ["txn_date_out_of_range"], ["missing_user_id"]]
    good, bad = quality.split(quality.parse(raw(spark, rows), max_date="2024-12-31"))
    assert good.count() == 1 and bad.count() == 7 and dict(good.dtypes)["amount"] == "decimal(14,2)"


def test_originals_win_over_redeliveries(spark):
    df = raw(spark, [{"delivery": "redelivery_1", "n": 1}, {"delivery": "daily", "n": 2}])
    order = [F.col("delivery").startswith("redelivery"), "n"]
    assert quality.keep_first(df, ["txn_id"], order).first().n == 2 and quality.keep_others(df, ["txn_id"], order).first().n == 1


NORMALIZED = {
    "POS PURCHASE STARBUCKS STORE 01234 SEATTLE WA": "STARBUCKS", "AMAZON.COM*2K4L91XZ3 AMZN.COM/BILL WA": "AMAZON AMZN", "T.J. MAXX 123 DALLAS TX": "T J MAXX", "7-Eleven 1669": "SEVEN ELEVEN", "": "",
    "SQ *JOE'S DINER NEW YORK NY": "JOES DINER", "DD *TACO BELL XXXX1234": "DOORDASH TACO BELL", "help.uber.com/x": "UBER", "TX": "TX", "dallas": "DALLAS",
}


def test_normalizer(spark):
    got = spark.createDataFrame([(k,) for k in NORMALIZED], "raw string").select("raw", tx.normalize(F.col("raw")).alias("n")).collect()
    assert {r.raw: r.n for r in got} == NORMALIZED
    assert spark.sql("SELECT CAST(NULL AS STRING) AS raw").select(tx.normalize(F.col("raw")).alias("n")).first().n is None


def test_merchant_of_record(spark):
    texts = ["DOORDASH TACO", "UBER TRIP", "LYFT RIDE", "MY UBER", "GRUBHUB X", "", "INSTACAR"]
    got = [r.r for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(tx.merchant_of_record(F.col("t")).alias("r")).collect()]
    assert [(r and (r.brand, r.decision)) for r in got] == [("DOORDASH", "MATCH"), ("UBER", "MATCH"), (None, "NONE"), None, (None, "NONE"), (None, "NONE"), (None, "NONE")]


def test_fuzzy_parts():
    assert tx.ratio("abcd", "abxd") == 0.75 and tx.token_sort("b a", "a b") == 1 and tx.token_set("a b c", "b a") == 1
    assert tx.jaro_winkler("MARTHA", "MARHTA") == pytest.approx(0.961111, abs=1e-6) and tx.jaro_winkler("", "x") == 0


def daily(spark, n, **columns):
    rows = [tuple([dt.date(2024, 1, 1) + dt.timedelta(k), "S", *[float(c[k]) for c in columns.values()]]) for k in range(n)]
    return spark.createDataFrame(rows, "date date, source string, " + ", ".join(f"{c} double" for c in columns))


def test_source_flags(spark):
    rng = np.random.default_rng(7)
    rate, ticket = rng.normal(0, 0.02, 200), rng.normal(0, 0.02, 200)
    txns = np.full(200, 100.0)
    txns[120:122] = 0
    ticket[150:155] += np.log(100)
    f = series.flagged(daily(spark, 200, members=np.full(200, 50), txns=txns, lr_rate=rate, lr_ticket=ticket)).collect()
    assert sorted(r.type for r in f) == ["outage"] * 2 + ["unit_error"] * 5 and all(r.factor == 0.01 for r in f if r.type == "unit_error")


def test_baseline_excludes_the_day_itself(spark):
    x = np.arange(40.0)
    got = series.with_baseline(daily(spark, 40, x=x), "x", 28, ["source"], "x").orderBy("date").collect()
    for k, r in enumerate(got):
        before = x[max(0, k - 28) : k]
        want = np.median(before) if len(before) >= 14 else None
        assert r.x_base == want and (want is None or r.x_scale == pytest.approx(1.4826 * np.median(np.abs(before - want))))


def breaks_of(spark, txns7):
    rows = [("S", "T", dt.date(2024, 1, 1) + dt.timedelta(k), float(x), 1000.0, 0.2) for k, x in enumerate(txns7)]
    return series.tagging_breaks(spark.createDataFrame(rows, "source string, ticker string, date date, txns7 double, members7 double, c7 double")).collect()


def test_tagging_breaks(spark):
    x = np.random.default_rng(3).poisson(200, 300).astype(float)
    assert breaks_of(spark, x) == []
    x[200:] *= 0.05
    (b,) = breaks_of(spark, x)
    assert abs((b.start - dt.date(2024, 1, 1)).days - 200) <= 7 and b.drop > 0.8 and (b.end - dt.date(2024, 1, 1)).days == 299


def test_tagging_breaks_close_and_open_again(spark):
    """A span ends when the level of before is back; the days after may open another; a short dip opens none."""
    x = np.random.default_rng(4).poisson(200, 420).astype(float)
    x[150:153] *= 0.1  # too short
    x[200:240] *= 0.1
    x[320:] *= 0.3
    day = lambda b: ((b.start - dt.date(2024, 1, 1)).days, (b.end - dt.date(2024, 1, 1)).days)
    found = sorted(day(b) for b in breaks_of(spark, x))
    assert len(found) == 2
    (a, z), (a2, z2) = found
    assert 196 <= a <= 203 and 238 <= z <= 241 and 316 <= a2 <= 323 and z2 == 419
    # Back-dated by the days that a seven-day sum lags: the first low day less two.
    y = np.full(200, 200.0)
    y[100:] = 20.0
    (b,) = breaks_of(spark, y)
    assert day(b) == (98, 199) and b.drop == pytest.approx(0.9, abs=0.01)


def test_islands_and_days(spark):
    days = spark.createDataFrame([("S", dt.date(2024, 1, k)) for k in (1, 2, 3, 5, 9)], "source string, date date")
    assert sorted((r.start.day, r.end.day, r.n_days) for r in islands(days, ["source"]).collect()) == [(1, 5, 5), (9, 9, 1)]
    one = spark.sql("SELECT date'2024-01-03' AS a, date'2024-01-01' AS b")
    assert one.select(F.size(days_of(F.col("a"), F.col("b"))).alias("n")).first().n == 0


def test_raking(spark):
    df = spark.createDataFrame([(1, "x", "p", 50), (1, "x", "q", 10), (1, "y", "p", 30), (1, "y", "q", 10)], "day int, a string, b string, members long")
    got = raked_shares(df, ["day"], {"a": {"x": 0.4, "y": 0.6}, "b": {"p": 0.7, "q": 0.3}}, "members").groupBy("a").agg(F.sum("share").alias("s")).collect()
    assert {r.a: round(r.s, 6) for r in got} == {"x": 0.4, "y": 0.6}
    # Against plain passes over the margins; a level without weight leaves its part to the others.
    for weights in ([50, 10, 30, 10], [0, 0, 30, 10], [1, 99, 5, 2]):
        rows = [(1, a, b, w) for (a, b), w in zip(("xp", "xq", "yp", "yq"), weights, strict=True)]
        table = spark.createDataFrame(rows, df.schema)
        w = np.array(weights, float).reshape(2, 2)
        for _ in range(200):
            for axis, target in ((1, [0.4, 0.6]), (0, [0.7, 0.3])):
                have = w.sum(axis)
                goal = np.where(have > 0, target, 0)
                w = w * np.expand_dims(np.divide(goal / goal.sum() * w.sum(), have, out=np.ones(2), where=have > 0), axis)
        out = {(r.a, r.b): r.share for r in raked_shares(table, ["day"], {"a": {"x": 0.4, "y": 0.6}, "b": {"p": 0.7, "q": 0.3}}, "members").collect()}
        assert np.allclose([out[x] for x in (("x", "p"), ("x", "q"), ("y", "p"), ("y", "q"))], (w / w.sum()).ravel(), atol=1e-6)


def test_daily_curve_ties_out(spark):
    d = QUERIES["pchip_daily"](spark, "/root/testdata/sf0.001").groupBy("ticker", "period_start").agg(F.sum("daily").alias("total"))
    from ledgerloom.sources.views import fiscal

    j = d.join(fiscal(spark, "/root/testdata/sf0.001"), ["ticker", "period_start"]).collect()
    assert j and all(r.total == pytest.approx(max(r.revenue, 0), rel=1e-9, abs=1e-6) for r in j)


def test_as_of_masks(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), dt.date(2024, 2, 1), 5.0), (dt.date(2024, 6, 1), dt.date(2024, 7, 1), 6.0)], "period_end date, filed date, revenue double")
    assert [r.revenue for r in masked(df, F.lit("2024-01-15").cast("date"), ["revenue"]).collect()] == [None]


def test_notes(spark):
    assert claims_of("FY2026 Q2 ended 2026-06-30 on SRC_A, 5 sources, up 4.3% in 2025") == [(4.3, 1, "%")]
    assert verify("revenue $40.9B", {"r": 40.86e9}) == [] and verify("revenue $41.2B", {"r": 40.86e9}) == ["ungrounded 41.2usd"]
    assert verify("You should buy.", {}, ("Risks",)) == ["missing section Risks", "advice"]
    assert verify("Members hold cards and sell nothing; buyers recommend it.", {}) == []
    t = {"t": spark.range(3)}
    assert guarded_sql(spark, "SELECT id FROM t", t).count() == 3
    assert guarded_sql(spark, "WITH u AS (SELECT id FROM t WHERE id > 0) SELECT * FROM u JOIN t USING (id)", t).count() == 2
    for bad in ("DROP TABLE t", "SELECT 1; SELECT 2", "INSERT INTO t SELECT 1", "SELECT reflect('java.lang.System', 'getenv')", "SELECT * FROM parquet.`/any/file`", "SELECT * FROM other", "SELECT id FROM t WHERE id IN (SELECT id FROM other)", "SELECT java_method('x', 'y') FROM t"):
        with pytest.raises(ValueError):
            guarded_sql(spark, bad, t)
    said = iter(["up 9%", "up 4.3%"])
    r = Research(write=lambda facts, issues: next(said), template=lambda f: "none")
    assert r.run({"g": 4.3}) == "up 4.3%" and len(r.log) == 2
    assert Research(write=lambda f, i: "up 9%", template=lambda f: "none").run({}) == "none"


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert not c.exists("gold", "x")
    c.write(spark.range(3), "gold", "x")
    c.write(spark.range(2), "gold", "x", mode="append")
    assert c.exists("gold", "x") and c.read("gold", "x").count() == 5 and spark.table(c.register("gold", "x")).count() == 5
    c.drop("gold", "x")
    assert not c.exists("gold", "x")
    with pytest.raises(ValueError):
        c.path("other", "x")


def test_simulator_is_the_same_however_rows_are_dealt(spark):
    m = simulate.members(spark, 200, "2022-01-01", 100)
    a = sorted(simulate.transactions(m, ["A", "B"], "2022-01-01", 100).collect())
    assert a == sorted(simulate.transactions(m.repartition(7), ["A", "B"], "2022-01-01", 100).collect()) and len(a) > 500
    assert all(r.join_date <= (r.leave_date or r.join_date) for r in m.collect())
