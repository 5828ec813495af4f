"""Six detection rules. Each returns ``account_id``, ``rule``, ``reason``, ``ts``, ``amount``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import window_after, window_join, with_previous

# Jurisdictions that international transfers are held against.
HIGH_RISK = ("IRAN", "NORTH KOREA", "MYANMAR", "SYRIA", "YEMEN", "SOUTH SUDAN", "TURKEY", "NIGERIA", "PHILIPPINES")


def _alerts(df: DataFrame, rule: str, reason: Column, ts: str = "ts", amount: str = "amount") -> DataFrame:
    return df.select("account_id", F.lit(rule).alias("rule"), reason.alias("reason"), F.col(ts).alias("ts"), F.col(amount).cast("double").alias("amount"))


def _money(column: str) -> Column:
    return F.format_number(column, 0)


def structuring_burst(txns: DataFrame, ceiling: float = 100_000, min_count: int = 24, min_total: float = 1_400_000) -> DataFrame:
    """Many cash deposits under a ceiling that sum past a total."""
    small = txns.filter((F.col("direction") == "CR") & (F.col("channel") == "CASH") & (F.col("amount") < ceiling))
    burst = small.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.max("ts").alias("ts"))
    burst = burst.filter((F.col("n") >= min_count) & (F.col("amount") >= min_total)).withColumn("amount", F.col("amount").cast("double"))
    reason = F.concat(F.col("n"), F.lit(f" deposits of cash, each below Rs {ceiling:,}, add up to Rs "), _money("amount"))
    return _alerts(burst, "structuring_burst", reason)


def _followed(txns: DataFrame, first: str, second: str, min_amount: float, width_s: int, ratio: float, channel: str | None = None) -> DataFrame:
    """Rows of one direction at or over an amount that a row of the other, large enough, follows in the window."""
    rows = (txns if channel is None else txns.filter(F.col("channel") == channel)).select("account_id", "direction", "ts", "amount")
    large = (F.col("direction") == first) & (F.col("amount") >= min_amount)
    met = window_after(rows, ["account_id"], "ts", width_s, large, F.col("direction") == second, max_other=F.col("amount"))
    return met.filter(F.col("max_other") >= F.col("amount") * F.lit(float(ratio)))


def _least(rows: DataFrame) -> DataFrame:
    """Least time and least amount of each account, each for itself."""
    return rows.groupBy("account_id").agg(F.min("ts").alias("ts"), F.min("amount").cast("double").alias("amount"))


def rapid_pass_through(txns: DataFrame, min_amount: float = 300_000, hop_hours: int = 48, min_ratio: float = 0.85) -> DataFrame:
    """A large credit mostly debited within hours."""
    met = _followed(txns, "CR", "DR", min_amount, hop_hours * 3600, min_ratio)
    return _alerts(_least(met), "rapid_pass_through", F.concat(F.lit("Rs "), _money("amount"), F.lit(f" credited, then largely debited inside {hop_hours} hours")))


def round_trip(txns: DataFrame, min_amount: float = 1000, hop_days: int = 12, min_return_ratio: float = 0.95, channel: str = "RTGS") -> DataFrame:
    """A debit that comes back on the same channel within days."""
    met = _followed(txns, "DR", "CR", min_amount, hop_days * 86_400, min_return_ratio, channel)
    return _alerts(_least(met), "round_trip", F.concat(F.lit("Rs "), _money("amount"), F.lit(f" sent out returned inside {hop_days} days")))


def counterparty_concentration(txns: DataFrame, min_total: float = 1_000_000, min_concentration: float = 0.5, min_count: int = 4) -> DataFrame:
    """A counterparty that makes up most of an account's credits, unnamed ones included."""
    by_party = txns.filter("direction = 'CR'").groupBy("account_id", "counterparty_name").agg(
        F.sum("amount").alias("part"), F.count("*").alias("n"), F.max("ts").alias("ts")
    )
    whole = F.sum("part").over(Window.partitionBy("account_id")).cast("double")
    shares = by_party.withColumn("share", F.col("part").cast("double") / whole).withColumn("amount", F.col("part").cast("double"))
    found = shares.filter(
        F.col("counterparty_name").isNotNull() & (F.col("amount") >= min_total) & (F.col("n") >= min_count) & (F.col("share") >= min_concentration)
    )
    reason = F.concat(F.format_number(F.col("share") * 100, 0), F.lit("% of money in is from "), F.col("counterparty_name"), F.lit(": Rs "), _money("amount"))
    return _alerts(found, "counterparty_concentration", reason)


def _quiet(txns: DataFrame, min_gap_days: int, min_amount: float) -> tuple[DataFrame, Column]:
    """Rows with the time of the account's row before, and which are credits after days without any row."""
    gaps = with_previous(txns.select("account_id", "txn_id", "direction", "ts", "amount"), "account_id", "ts", "txn_id", "last_ts")
    long_gap = F.col("ts") - F.col("last_ts") >= F.make_dt_interval(days=F.lit(min_gap_days))
    return gaps, (F.col("direction") == "CR") & long_gap & (F.col("amount") >= min_amount)


def cash_outs(txns: DataFrame, min_gap_days: int, cashout_hours: int, min_amount: float) -> DataFrame:
    """Quiet credits beside the debits that follow within hours."""
    gaps, quiet = _quiet(txns, min_gap_days, min_amount)
    debits = txns.filter("direction = 'DR'").select("account_id", F.col("ts").alias("ts2"), F.col("amount").alias("amount2"), "txn_id")
    credits = gaps.filter(quiet).select("account_id", "ts", "amount")
    return window_join(credits, debits, ["account_id"], "ts", "ts2", cashout_hours * 3600, F.lit(True))


def dormancy_burst(txns: DataFrame, min_gap_days: int = 7, cashout_hours: int = 24, min_cashout_ratio: float = 0.5, min_amount: float = 20_000) -> DataFrame:
    """A credit after a quiet stretch, cashed out within hours. Equal credits at one moment are
    one burst, and its debits count once for each of them."""
    gaps, quiet = _quiet(txns, min_gap_days, min_amount)
    met = window_after(gaps, ["account_id"], "ts", cashout_hours * 3600, quiet, F.col("direction") == "DR", sum_out=F.col("amount"))
    out = met.groupBy("account_id", "ts", "amount").agg(F.sum("sum_out").alias("out"))
    found = out.filter(F.col("out") >= F.col("amount") * F.lit(float(min_cashout_ratio))).withColumn("amount", F.col("amount").cast("double"))
    tail = f" came after silence; {min_cashout_ratio:.0%} or more went out inside {cashout_hours} hours"
    return _alerts(found, "dormancy_burst", F.concat(F.lit("Rs "), _money("amount"), F.lit(tail)))


def first_listed(name: Column, entries: Sequence[str]) -> Column:
    """The first entry that the upper-cased name contains, else null."""
    hit = F.lit(None).cast("string")
    for entry in reversed(entries):
        hit = F.when(F.upper(name).contains(entry), entry).otherwise(hit)
    return hit


def high_risk_geography(txns: DataFrame, watchlist: Sequence[str] = HIGH_RISK) -> DataFrame:
    """International transfers that name a listed jurisdiction."""
    named = txns.filter("channel = 'INT' and counterparty_name is not null").withColumn("hit", first_listed(F.col("counterparty_name"), watchlist))
    reason = F.concat(F.lit("international payment naming "), F.initcap("hit"))
    return _alerts(named.filter("hit is not null"), "high_risk_geography", reason)


SCENARIO: tuple[Callable[[DataFrame], DataFrame], ...] = (
    structuring_burst, rapid_pass_through, round_trip, counterparty_concentration, dormancy_burst, high_risk_geography,
)


def run_all(txns: DataFrame, scenario: Sequence[Callable[[DataFrame], DataFrame]] = SCENARIO) -> DataFrame:
    """All alerts of a scenario; a rule is any function from transactions to alerts."""
    return reduce(DataFrame.unionByName, [rule(txns) for rule in scenario])
