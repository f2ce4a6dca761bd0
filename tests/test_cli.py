import datetime as dt

import pytest

from ledgerloom import cli
from ledgerloom.operators.review import adjudicated, overlap_chain
from ledgerloom.stages import NEEDS, Panel, chosen


def test_end_to_end_and_idempotent(spark, tmp_path):
    """Rows add up with faults planted, what was planted is found, and a second run of the streams adds nothing."""
    p = Panel(spark, f"file://{tmp_path}", cli.settings(changes=["panel.members=600", "panel.days=210"]))
    cli.run(p, ["all"])
    counts = lambda: [p.tables.read("bronze", "transactions").count(), *(p.silver(x).count() for x in ("silver", "quarantine", "duplicates"))]
    rows, good, bad, again = counts()
    assert rows == good + bad + again and min(good, bad, again) > 0
    cli.run(p, ["silver", "bronze"])
    assert counts() == [rows, good, bad, again]
    found = {r.name: r.value for r in p.tables.read("eval", "summary").collect()}
    assert found["malformed rows"] == found["malformed rows quarantined"] > 0 and found["sound rows quarantined"] == 0
    assert found["duplicates delivered"] == found["duplicates logged"] == again
    assert found["anomalies planted"] == 5 and found["anomalies caught"] >= 4 and found["anomaly delay, median days"] <= 2
    assert found["brand precision by spend"] > 0.99 and found["brand recall by spend"] > 0.9
    daily = p.tables.read("gold", "ticker_daily").where("raked IS NOT NULL AND clean > 0").collect()
    assert len(daily) > 300 and all(0.3 < r.raked / r.clean < 3 for r in daily[:50] if r.clean > 0.5)
    assert any("anomalies caught" in r.value for r in spark.read.text(f"file://{tmp_path}/report").collect())


def test_stages_are_ordered_by_need():
    assert chosen(["silver", "reference", "bronze"]) == ["reference", "bronze", "silver"]
    assert chosen(["bronze"], upstream=True) == ["reference", "simulated", "bronze"]
    assert chosen(["all"])[0] == "reference" and chosen(["all"])[-1] == "report" and len(chosen(["all"])) == len(NEEDS)


def test_settings(tmp_path):
    (tmp_path / "s.json").write_text('{"panel": {"members": 7}, "targets": {"age": {"x": 1.0}}, "flags.z": 4}')
    s = cli.settings(str(tmp_path / "s.json"), ["panel.start=2020-02-01", "panel.days=9"])
    assert (s["panel.members"], s["panel.days"], s["panel.start"], s["flags.z"], s["targets.age"], s["flags.window"]) == (7, 9, "2020-02-01", 4, {"x": 1.0}, 28)
    with pytest.raises(ValueError):
        cli.settings(changes=["panel.typo=1"])


def test_overlap_chain(spark):
    day = lambda m, d: dt.date(2024, m, d)
    rows = [("T", day(1, 1), day(3, 31), False), ("T", day(3, 1), day(5, 31), False), ("T", day(5, 1), day(7, 31), True), ("T", day(8, 1), day(9, 30), True)]
    got = overlap_chain(spark.createDataFrame(rows, "ticker string, start date, end date, derived boolean")).collect()
    assert [r.start for r in got] == [day(3, 1), day(8, 1)]


def test_adjudication(spark):
    answers = {0: ("TARGET", 0.9, "same"), 1: ("NOPE", 0.99, "x"), 2: ("TARGET", 0.5, "unsure")}
    queue = spark.createDataFrame([("A", 1, 1), ("B", 2, 2), ("C", 3, 3), ("D", 4, 4), ("E", 5, 5)], "descriptor string, mcc int, place int")
    brands = spark.createDataFrame([("TARGET",)], "brand string")
    got = adjudicated(queue, brands, lambda part: {k: answers[k] for k, *_ in part if k in answers}, batch=3, most=4).orderBy("descriptor").collect()
    assert [r.brand for r in got] == ["TARGET", None, None, None] and [r.reason for r in got] == ["same", "x", "unsure", "no answer"]
