"""Each registered query of the panel against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import numpy as np
import pytest
from differential import differences

from ledgerloom import plans
from ledgerloom.functions import text as tx
from ledgerloom.operators import forecast, simulate
from ledgerloom.plans.fiscal import COLUMNS, DIMS, features
from ledgerloom.sources.views import fiscal

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_same_as_sql(spark, name):
    assert differences(plans.QUERIES[name](spark, D), plans.ORACLES[name], D) == []


def test_what_has_no_sql_is_tested_elsewhere():
    """Here below, in test_operators (raking, breaks, daily curve, simulator) and in test_resolve."""
    assert set(plans.QUERIES) - set(plans.ORACLES) == {
        "daily_curve", "fuzzy_score", "pchip_daily", "rake_ipf", "resolve", "sim_members", "sim_transactions", "tagging_breaks", "walk_forward_ensemble", "walk_forward_gbm", "walk_forward_ridge",
    }


def test_walk_forward_models_by_loops(spark):
    """Each row's prediction from the rows filed before its date, one model after another."""
    rows = sorted(features(spark, D).collect(), key=lambda r: (r.ticker, r.period_end))
    got = {m: {(r.ticker, r.period_end): r.pred for r in plans.QUERIES[f"walk_forward_{m}"](spark, D).collect()} for m in ("ridge", "gbm", "ensemble")}
    x_of = lambda rs: np.array([[getattr(r, c) for c in COLUMNS] for r in rs])
    seen = 0
    for t in rows[:: max(1, len(rows) // 8)]:
        known = [r for r in rows if r.filed < t.nowcast_date]
        key = (t.ticker, t.period_end)
        if len(known) < 12:
            assert all(key not in v for v in got.values())
            continue
        tests = [r for r in rows if r.nowcast_date == t.nowcast_date]
        names = sorted({r.ticker for r in known + tests})
        hot = lambda rs: np.array([[float(r.ticker == n) for n in names] for r in rs])  # noqa: B023, E731
        x, y, at = x_of(known), np.array([r.rev_yoy for r in known]), x_of([t])
        w0, w = forecast.best_ridge(np.hstack([x, hot(known)]), y, forecast.ALPHAS)
        ridge = float(w0 + np.hstack([at, hot([t])])[0] @ w)
        w0, w = forecast.best_ridge(x, y, forecast.ALPHAS)
        gbm = float(w0 + at[0] @ w + forecast.boost(x, y - (w0 + x @ w), 300)(at)[0])
        assert got["ridge"][key] == pytest.approx(ridge, abs=1e-9) and got["gbm"][key] == pytest.approx(gbm, abs=1e-9)
        assert got["ensemble"][key] == pytest.approx((ridge + gbm) / 2, abs=1e-9)
        seen += 1
    assert seen >= 3


def test_fuzzy_scores_by_loops(spark):
    rows = plans.QUERIES["fuzzy_score"](spark, D).collect()
    cosine = {(r.descr, r.alias): r.cosine for r in plans.QUERIES["tfidf_topk"](spark, D).collect()}
    assert len(rows) == len(cosine) > 100
    for r in rows[:300]:
        best = max(tx.token_set(r.desc, r.alias), tx.ratio(r.desc.replace(" ", ""), r.alias.replace(" ", "")))
        s = 0.4 * best + 0.2 * tx.token_sort(r.desc, r.alias) + 0.2 * cosine[r.desc, r.alias] + 0.2 * tx.jaro_winkler(r.desc.split()[0], r.alias.split()[0])
        assert r.score == pytest.approx(min(s, 0.5) if len(r.alias) <= 4 and r.alias not in r.desc.split() else s, abs=2e-6)


def test_daily_curve_sums_to_quarters(spark):
    rows = plans.QUERIES["daily_curve"](spark, D).collect()
    total, revenue = {}, {(r.ticker, r.period_start): max(r.revenue, 0) for r in fiscal(spark, D).collect()}
    for r in rows:
        total[r.ticker, r.period_start] = total.get((r.ticker, r.period_start), 0) + r.daily
    assert total.keys() == revenue.keys() and all(v == pytest.approx(revenue[k], rel=1e-9, abs=1e-6) for k, v in total.items())
    day = {(r.ticker, r.date): r.daily for r in rows}
    christmas = [k for k in day if (k[1].month, k[1].day) == (12, 25) and day[k] > 0]
    assert christmas and all(day[t, c] < day[t, c - datetime.timedelta(2)] for t, c in christmas)


def test_raked_shares_meet_the_margins(spark):
    rows = plans.QUERIES["rake_ipf"](spark, D).collect()
    for year in {r.year for r in rows}:
        mine = [r for r in rows if r.year == year]
        for dim, targets in DIMS.items():
            got = {k: sum(r.share for r in mine if r[dim] == k) for k in targets}
            there = sum(v for k, v in targets.items() if got[k])
            assert sum(got.values()) == pytest.approx(1, abs=1e-6)
            if dim == list(DIMS)[-1]:  # the last one fitted is met exactly
                assert all(got[k] == pytest.approx(v / there, abs=1e-6) for k, v in targets.items() if got[k])


def test_breaks_of_the_registered_query(spark):
    rows = plans.QUERIES["tagging_breaks"](spark, "/root/testdata/sf0.1").collect()
    assert [(r.source, r.ticker) for r in rows if (r.source, r.ticker) == ("SRC_1", "T1")]


def test_simulated_panel(spark):
    people = {r.user_id: r for r in plans.QUERIES["sim_members"](spark, D).collect()}
    bought = plans.QUERIES["sim_transactions"](spark, D).collect()
    assert len(people) == 2000 and len({r.txn_id for r in bought}) == len(bought) > 10000
    for r in bought[::97]:
        m = people[r.user_id]
        assert m.join_date <= r.txn_date and (m.leave_date is None or r.txn_date < m.leave_date) and 0 <= (r.post_date - r.txn_date).days <= 3
    assert 0.005 < sum(r.amount < 0 for r in bought) / len(bought) < 0.02


def test_poisson_counts(spark):
    rows = spark.range(20000).select(simulate.poisson(simulate.uniform("id"), 1.7).alias("n")).groupBy("n").count().collect()
    share = {r.n: r["count"] / 20000 for r in rows}
    for n in range(6):
        assert share[n] == pytest.approx(math.exp(-1.7) * 1.7**n / math.factorial(n), abs=0.015)


def test_review_queue_of_nulls_and_ties(spark, tmp_path):
    """Rows without a name stand last among those of a price; of equal rows at the limit the same ones come however they lie."""
    part = "p_partkey long, p_name string, p_brand string, p_size int, p_retailprice double"
    nulls = [(5 * k + 4, None if k % 2 else f"n{k}", f"Brand#{k % 9}", 1, 7.0) for k in range(280)] + [(3, "x", "Brand#1", 1, None)]
    spark.createDataFrame(nulls, part).write.parquet(f"{tmp_path}/nulls/part.parquet")
    sql = plans.ORACLES["review_queue_topn"].replace("FROM part", f"FROM read_parquet('{tmp_path}/nulls/part.parquet/*.parquet')")
    queue = plans.QUERIES["review_queue_topn"](spark, f"{tmp_path}/nulls").where("raw IS NOT NULL")
    assert differences(queue, f"SELECT * FROM ({sql}) WHERE raw IS NOT NULL", "") == [] and queue.count() == 140
    ties = [(5 * k + 4, "one name", f"Brand#{k}", 1, 7.0) for k in range(400)]
    found = []
    for name, rows in (("up", ties), ("down", ties[::-1])):
        spark.createDataFrame(rows, part).repartition(7).write.parquet(f"{tmp_path}/{name}/part.parquet")
        found.append([r.brand for r in plans.QUERIES["review_queue_topn"](spark, f"{tmp_path}/{name}").collect()])
    assert found[0] == found[1] == [f"Brand#{k}" for k in range(150)]
