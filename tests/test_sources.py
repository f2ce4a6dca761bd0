"""Connectors with a transport made up here, tables, the revenue builder, the research tools."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.revenue import issues, quarterly_revenue
from ledgerloom.plans.tools import Tools
from ledgerloom.sources.connectors import Files, TooManyRequests, canonical_titles, company_facts, facts_frame, page_views
from ledgerloom.sources.tables import Catalog

day = dt.date


def test_files_are_asked_for_once(spark, tmp_path):
    asked, slept = [], []
    doc = {"facts": {"us-gaap": {"Revenues": {"units": {"USD": [{"start": "2020-01-01", "end": "2020-03-31", "val": 5, "filed": "2020-05-01", "form": "10-Q", "accn": "a"}, {"end": "2020-03-31", "val": 9, "filed": "2020-05-01"}]}}, "Other": {"units": {"USD": []}}}}}
    answers = [(429, {"Retry-After": "3"}, b""), (429, {}, b""), (200, {}, json.dumps(doc).encode())]

    def get(url, headers):
        asked.append((url, headers["User-Agent"]))
        return answers[min(len(asked), len(answers)) - 1]

    files = Files(tmp_path, get, "me@example.org", sleep=slept.append)
    assert company_facts(files, 7, "https://x/facts") == company_facts(files, 7, "https://x/facts")
    assert len(asked) == 3 and asked[0] == ("https://x/facts/CIK0000000007.json", "me@example.org") and slept == [3.0, 10.0, 0.15]
    (r,) = facts_frame(spark, f"file://{tmp_path}/facts", ["Revenues"]).collect()
    assert (r.cik, r.concept, r.start, r.days, r.kind, r.val) == (7, "Revenues", day(2020, 1, 1), 91, "quarter", 5.0)
    with pytest.raises(TooManyRequests):
        Files(tmp_path, lambda u, h: (429, {}, b""), "me", sleep=lambda s: None).fetch("x", "u")
    with pytest.raises(OSError):
        Files(tmp_path, lambda u, h: (500, {}, b""), "me", sleep=lambda s: None).fetch("x", "u")
    views = {"items": [{"timestamp": "2024010200", "views": 11}]}
    titles = {"query": {"normalized": [{"from": "acme", "to": "Acme"}], "redirects": [{"from": "Acme", "to": "Acme Corp"}]}}
    web = Files(tmp_path, lambda u, h: (200, {}, json.dumps(titles if "action=query" in u else views).encode()), "me", sleep=lambda s: None)
    assert canonical_titles(web, ["acme", "Bolt"], "https://w/api") == {"acme": "Acme Corp", "Bolt": "Bolt"}
    assert [tuple(r) for r in page_views(spark, web, "Acme Corp", "2024-01-01", "2024-01-31", "https://w").collect()] == [("Acme Corp", day(2024, 1, 2), 11)]


def test_tables(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    c.write_pandas(pd.DataFrame({"a": [1, 2]}), "ref", "x", "a int")
    (tmp_path / "y.csv").write_text("a,b\n1,q\n")
    c.load_csv(f"file://{tmp_path}/y.csv", "ref", "y", "a int, b string")
    assert c.read("ref", "x").count() == 2 and c.read("ref", "y").first().b == "q" and c.names("ref") == ["x", "y"]
    c.reset("ref", landing=True)
    assert c.names("ref") == []


def ends(y):
    return [(day(y, 1, 1), day(y, 3, 31)), (day(y, 4, 1), day(y, 6, 30)), (day(y, 7, 1), day(y, 9, 30)), (day(y, 10, 1), day(y, 12, 31))]


def facts_of(spark, rows):
    return spark.createDataFrame(rows, "ticker string, concept string, start date, end date, kind string, val double, filed date, accn string")


def test_revenue_from_facts(spark):
    rows = []
    for y in (2020, 2021):
        for k, (a, z) in enumerate(ends(y)[:3]):
            rows.append(("T", "Revenues", a, z, "quarter", 10.0 + k, z + dt.timedelta(30), "a"))
            rows.append(("T", "Revenues", a, z, "quarter", (10.0 + k) * (1.1 if (y, k) == (2021, 0) else 1), z + dt.timedelta(400), "b"))
        rows.append(("T", "Revenues", day(y, 1, 1), day(y, 12, 31), "annual", 50.0, day(y + 1, 2, 15), "c"))
    # Another concept that agrees has an earlier filing and two quarters more; a third one disagrees.
    rows += [("T", "Sales", *ends(2020)[1], "quarter", 11.0, day(2020, 7, 10), "s"), ("T", "Sales", *ends(2022)[0], "quarter", 13.0, day(2022, 5, 1), "s"), ("T", "Sales", *ends(2019)[3], "quarter", 9.0, day(2020, 2, 1), "s")]
    rows += [("T", "Net", *ends(2020)[1], "quarter", 99.0, day(2020, 7, 30), "n"), ("T", "Net", *ends(2022)[1], "quarter", 99.0, day(2022, 8, 1), "n")]
    facts = facts_of(spark, rows)
    q = quarterly_revenue(facts, ["Revenues", "Sales", "Net"], "2019-01-01")
    got = {r.start: r for r in q.collect()}
    assert sorted(got) == [ends(2019)[3][0], *[a for y in (2020, 2021) for a, _ in ends(y)], ends(2022)[0][0]]
    last = got[day(2020, 10, 1)]
    assert (last.val, last.derived, last.filed, last.fiscal_year, last.fiscal_quarter) == (50 - 33, True, day(2021, 2, 15), 2020, 4)
    assert got[day(2020, 4, 1)].filed == day(2020, 7, 10) and got[day(2021, 1, 1)].restated and not got[day(2021, 4, 1)].restated
    assert [(got[a].fiscal_year, got[a].fiscal_quarter) for a in (day(2019, 10, 1), day(2020, 1, 1), day(2022, 1, 1))] == [(2019, 4), (2020, 1), (2022, 1)]
    assert got[day(2022, 1, 1)].concept == "Sales" and {r.primary_concept for r in got.values()} == {"Revenues"}
    assert issues(q, facts, ["Revenues", "Sales", "Net"], "2019-01-01").collect() == []
    off = facts.where("NOT (concept = 'Revenues' AND start = DATE'2021-04-01')").unionByName(facts_of(spark, [("T", "Revenues", *ends(2020)[3], "quarter", 30.0, day(2021, 1, 30), "z")]))
    found = {r.issue for r in issues(quarterly_revenue(off, ["Revenues"], "2020-01-01"), off, ["Revenues"], "2020-01-01").collect()}
    assert found == {"gap or overlap before 2021-07-01", "quarters don't add up to the year to 2020-12-31"}


def test_tools_know_what_was_known(spark):
    quarters = spark.createDataFrame([("T", 2024, k + 1, a, z, z + dt.timedelta(40), 1e9 * (k + 1), 0.1, 0.2) for k, (a, z) in enumerate(ends(2024))], "ticker string, fiscal_year int, fiscal_quarter int, period_start date, period_end date, filed date, revenue double, rev_yoy double, panel_yoy double")
    predictions = spark.createDataFrame([("T", z, z + dt.timedelta(7), m, p, 0.0, 0.2, 2e9) for _, z in ends(2024) for m, p in (("ensemble", 0.1), ("ridge", 0.3))], "ticker string, period_end date, nowcast_date date, model string, pred double, lo double, hi double, revenue_prior double")
    events = spark.createDataFrame([("outage", "S", None, day(2024, 8, 1), day(2024, 8, 2), "exclude"), ("tagging_break", "S", "U", day(2024, 8, 1), day(2024, 8, 9), "exclude"), ("outage", "S", None, day(2024, 2, 1), day(2024, 2, 2), "exclude")], "type string, source string, ticker string, start date, end date, action string")
    descriptors = spark.createDataFrame([("T", "MATCH", "exact", 60.0), ("T", "MATCH", "fuzzy", 20.0), ("T", "REVIEW", "fuzzy", 20.0)], "ticker string, decision string, method string, abs_spend double")
    brands = spark.createDataFrame([("ACME", "T", day(2020, 1, 1))], "brand string, ticker string, valid_from date")
    t = Tools(spark, "2024-10-10", brands, quarters, predictions, events, descriptors, spark.range(1).select(F.lit("panel").alias("asset")))
    assert len(t.all()) == 6 and t.overview("T")["quarters"][-1]["label"] == "FY2024 Q3"
    n = t.nowcast("T")
    assert (n["period_end"], n["yoy_pct"], n["band_80_pct"], n["models_yoy_pct"]["ridge"], n["revenue_usd_bn"]) == ("2024-09-30", 10.52, [0.0, 22.14], 34.99, 2.21)
    h = t.quarter_history("T")
    assert len(h) == 3 and h[0]["error_pp"] == 0.0 and h[-1] == {"with_nowcast": 2, "mean_abs_error_pp": 0.0}  # the third quarter isn't filed yet
    q = t.data_quality("T")
    assert [e["start"] for e in q["events"]] == ["2024-08-01"] and q["matched_pct"] == {"exact": 75.0, "fuzzy": 25.0} and q["review_pct"] == 20.0
    assert t.asset_scorecard() == [{"asset": "panel"}] and t.run_sql("SELECT count(*) AS n FROM quarters WHERE revenue IS NOT NULL") == [{"n": 2}]
    assert "error" in t.run_sql("DROP TABLE quarters")[0]
    with pytest.raises(LookupError):
        t.nowcast("X")
