"""Rules on hand-made ledgers, one quirk at a time."""

from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tracewell.operators import features, replay, rules
from tracewell.sources import ledger

T0 = datetime(2024, 1, 1, 9)
SCHEMA = "txn_id long, ts timestamp_ntz, account_id string, direction string, channel string, amount decimal(15,2), counterparty_name string"


def rows(spark, *items):
    return spark.createDataFrame(
        [(i, T0 + timedelta(hours=h), a, d, c, Decimal(str(x)), cp) for i, (h, a, d, c, x, cp) in enumerate(items)], SCHEMA
    )


def found(df):
    return sorted((r.account_id, r.ts, r.amount) for r in df.collect())


def test_window_excludes_its_start_and_includes_its_end(spark):
    t = rows(spark, (0, "A", "CR", "UPI", 100, None), (0, "A", "DR", "UPI", 100, None), (48, "B", "DR", "UPI", 85, None), (0, "B", "CR", "UPI", 100, None))
    assert [r[0] for r in found(rules.rapid_pass_through(t, 100, 48, 0.85))] == ["B"]
    assert found(rules.rapid_pass_through(t, 100, 47, 0.85)) == []


def test_least_time_and_amount_are_independent(spark):
    t = rows(spark, (0, "A", "CR", "UPI", 300, None), (1, "A", "DR", "UPI", 300, None), (5, "A", "CR", "UPI", 200, None), (6, "A", "DR", "UPI", 200, None))
    assert found(rules.rapid_pass_through(t, 100, 48, 0.85)) == [("A", T0, 200.0)]


def test_round_trip_needs_one_channel(spark):
    t = rows(spark, (0, "A", "DR", "RTGS", 100, None), (9, "A", "CR", "NEFT", 100, None), (0, "B", "DR", "RTGS", 100, None), (9, "B", "CR", "RTGS", 95, None))
    assert [r[0] for r in found(rules.round_trip(t, 10, 12, 0.95))] == ["B"]


def test_concentration_counts_unnamed_credits(spark):
    named = [(h, "A", "CR", "NEFT", 100, "X") for h in range(4)]
    t = rows(spark, *named, (5, "A", "CR", "NEFT", 400, None))
    assert len(found(rules.counterparty_concentration(t, 100, 0.5, 4))) == 1
    assert found(rules.counterparty_concentration(t, 100, 0.51, 4)) == []


def test_equal_quiet_credits_merge_and_double_their_debits(spark):
    t = rows(
        spark, (0, "A", "CR", "UPI", 1, None), (300, "A", "CR", "UPI", 100, None), (300, "A", "CR", "UPI", 100, None), (301, "A", "DR", "UPI", 60, None),
        (0, "B", "CR", "UPI", 100, None), (1, "B", "DR", "UPI", 100, None),
    )
    assert found(rules.dormancy_burst(t, 7, 24, 0.5, 50)) == [("A", T0 + timedelta(hours=300), 100.0)]


def test_structuring_and_geography(spark):
    t = rows(spark, *[(h, "A", "CR", "CASH", 50, None) for h in range(5)], (1, "A", "DR", "INT", 9, "big iran and syria co"))
    assert found(rules.structuring_burst(t, 100, 5, 250)) == [("A", T0 + timedelta(hours=4), 250.0)]
    assert rules.high_risk_geography(t).first().reason.endswith("Iran")


def test_no_rows_give_no_alerts(spark):
    assert rules.run_all(rows(spark).withColumn("extra", F.lit(1))).count() == 0


@pytest.mark.parametrize("name", ["structuring_burst", "rapid_pass_through", "counterparty_concentration", "dormancy_burst"])
def test_first_days_equal_a_run_on_each_days_ledger(spark, sf_dir, name):
    from tracewell.plans import catalogue as c

    limits = {"structuring_burst": c.D1, "rapid_pass_through": c.D2, "counterparty_concentration": c.D4, "dormancy_burst": c.D5}[name]
    bank = ledger.from_driver(spark, sf_dir)
    few = bank.transactions.filter(F.col("account_id").isin("A1", "A3", "A7")).cache()
    first = {r.account_id: r.day for r in getattr(replay, name)(few, **limits).collect()}
    slow = {}
    for d in range(1, 32, 3):
        day = datetime(2024, 1, 1) + timedelta(days=d)
        for r in getattr(rules, name)(few.filter(F.col("ts") < day), **limits).collect():
            slow.setdefault(r.account_id, day)
    # Sampled days: a detector that has fired by then fired first on an earlier day or that one.
    assert all(a in first and first[a] < day.date() for a, day in slow.items())


def test_gap_counts_boundaries_of_seconds(spark):
    t = rows(spark, (0, "A", "CR", "UPI", 1, None))
    t = t.withColumn("ts", F.lit("2024-01-01 00:00:00.9").cast("timestamp_ntz")).unionByName(t.withColumn("txn_id", F.lit(9).cast("long")).withColumn("ts", F.lit("2024-01-01 00:00:01.1").cast("timestamp_ntz")))
    assert features.gap_hours(t).first().max_gap_hours == pytest.approx(1 / 3600)
