"""Walk-forward models: full boosting, and the ridge penalty by leave-one-out error."""

import datetime

import numpy as np
import pandas as pd

from ledgerloom import plans
from ledgerloom.operators import forecast
from ledgerloom.plans.fiscal import COLUMNS, features

D = "/root/testdata/sf0.01"


def rows_of(df):
    return {(r.ticker, r.period_end): r.pred for r in df.collect()}


def test_queries_boost_300_trees(spark):
    for model in ("gbm", "ensemble"):
        got, want = rows_of(plans.QUERIES[f"walk_forward_{model}"](spark, D)), rows_of(forecast.walk(features(spark, D), COLUMNS, (model,), trees=300))
        assert got and got.keys() == want.keys()
        assert np.allclose([got[k] for k in got], [want[k] for k in got], atol=1e-12)


def test_ridge_has_the_penalty_of_least_leave_one_out_error(spark):
    draw, day = np.random.default_rng(3), datetime.date
    n = 16
    x = draw.normal(size=(n + 1, 2))
    y = x @ [0.2, 0.1] + draw.normal(size=n + 1)
    rows = [("A", day(2020, 1, 1) + datetime.timedelta(k), day(2020, 2, 1) if k < n else day(2020, 4, 1), day(2020, 1, 20) if k < n else day(2020, 3, 1), float(y[k]), *map(float, x[k])) for k in range(n + 1)]
    f = spark.createDataFrame(pd.DataFrame(rows, columns=["ticker", "period_end", "filed", "nowcast_date", "rev_yoy", "p", "q"]))
    got = forecast.walk(f, ["p", "q"], ("ridge",)).collect()
    z = np.hstack([x, np.ones((n + 1, 1))])  # the one ticker's column

    def miss(alpha):
        error = 0
        for k in range(n):
            rest = np.arange(n) != k
            w0, w = forecast.ridge(z[:n][rest], y[:n][rest], alpha)
            error += (y[k] - w0 - z[k] @ w) ** 2
        return error

    alpha = min(np.logspace(-3, 2, 12), key=miss)
    w0, w = forecast.ridge(z[:n], y[:n], alpha)
    assert alpha > 2 and len(got) == 1 and abs(got[0].pred - (w0 + z[n] @ w)) < 1e-9
