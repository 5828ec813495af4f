"""The first day on which each detector fires for an account, in closed form.

The specification is a run of every detector on each day's ledger; these forms give the same
first days from one pass over the whole ledger.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import window_after
from . import rules
from .graph import all_paths


def _first(df: DataFrame, detector: str, day="day") -> DataFrame:
    return df.groupBy("account_id").agg(F.min(day).alias("day")).select("account_id", F.lit(detector).alias("detector"), "day")


def structuring_burst(txns: DataFrame, ceiling: float, min_count: int, min_total: float) -> DataFrame:
    """The first deposit by which both the count and the sum are reached."""
    by = Window.partitionBy("account_id").orderBy("ts", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    small = txns.filter((F.col("direction") == "CR") & (F.col("channel") == "CASH") & (F.col("amount") < ceiling))
    run = small.withColumns({"n": F.count("*").over(by), "total": F.sum("amount").over(by), "day": F.to_date("ts")})
    return _first(run.filter((F.col("n") >= min_count) & (F.col("total") >= min_total)), "structuring_burst")


def _second_legs(txns: DataFrame, first: str, second: str, min_amount: float, width_s: int, ratio: float, channel: str | None = None) -> DataFrame:
    """The rule's pairs seen from their second leg: rows that the least first leg of the window before them asks no more of."""
    rows = (txns if channel is None else txns.filter(F.col("channel") == channel)).select("account_id", "direction", "ts", "amount")
    large = (F.col("direction") == first) & (F.col("amount") >= min_amount)
    met = window_after(rows, ["account_id"], "ts", width_s, F.col("direction") == second, large, back=True, min_other=F.col("amount"))
    return met.filter(F.col("amount") >= F.col("min_other") * F.lit(float(ratio)))


def rapid_pass_through(txns: DataFrame, min_amount: float, hop_hours: int, min_ratio: float) -> DataFrame:
    """The day of the earliest second leg."""
    return _first(_second_legs(txns, "CR", "DR", min_amount, hop_hours * 3600, min_ratio), "rapid_pass_through", F.to_date("ts"))


def round_trip(txns: DataFrame, min_amount: float, hop_days: int, min_return_ratio: float, channel: str) -> DataFrame:
    return _first(_second_legs(txns, "DR", "CR", min_amount, hop_days * 86_400, min_return_ratio, channel), "round_trip", F.to_date("ts"))


def counterparty_concentration(txns: DataFrame, min_total: float, min_concentration: float, min_count: int) -> DataFrame:
    """The first day, among days the counterparty pays, on which its share so far is enough: between
    its payments a share can only fall."""
    credits = txns.filter("direction = 'CR'").withColumn("day", F.to_date("ts"))
    daily = credits.groupBy("account_id", "counterparty_name", "day").agg(F.sum("amount").alias("part"), F.count("*").alias("n"))
    far = Window.partitionBy("account_id", "counterparty_name").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("account_id").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    run = daily.withColumns({"part": F.sum("part").over(far), "n": F.sum("n").over(far), "whole": F.sum("part").over(whole)})
    enough = (F.col("part").cast("double") >= min_total) & (F.col("n") >= min_count)
    enough = enough & (F.col("part").cast("double") / F.col("whole").cast("double") >= min_concentration)
    return _first(run.filter(F.col("counterparty_name").isNotNull() & enough), "counterparty_concentration")


def dormancy_burst(txns: DataFrame, min_gap_days: int, cashout_hours: int, min_cashout_ratio: float, min_amount: float) -> DataFrame:
    """The day by whose end the debits of a burst reach the ratio. Equal credits at one moment
    count each debit once for each of them, as the rule does."""
    out = rules.cash_outs(txns, min_gap_days, cashout_hours, min_amount).withColumn("day", F.to_date("ts2"))
    daily = out.groupBy("account_id", "ts", "amount", "day").agg(F.sum("amount2").alias("out"))
    by = Window.partitionBy("account_id", "ts", "amount").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    run = daily.withColumn("out", F.sum("out").over(by))
    return _first(run.filter(F.col("out") >= F.col("amount") * F.lit(float(min_cashout_ratio))), "dormancy_burst")


def high_risk_geography(txns: DataFrame, watchlist) -> DataFrame:
    return _first(rules.high_risk_geography(txns, watchlist), "high_risk_geography", F.to_date("ts"))


def chains(edges: DataFrame, min_hops: int = 2, **limits) -> DataFrame:
    """The day of the last hop of the earliest path of two hops that holds the account. Every
    account of a longer path is in one of its runs of two hops, or in a prefix of it."""
    paths = all_prefixes(edges, min_hops, **limits)
    own = paths.select(F.explode(F.col("accounts").cast("array<string>")).alias("account_id"), F.to_date("ended").alias("day"))
    return _first(own, "chain")


def all_prefixes(edges: DataFrame, min_hops: int, **limits) -> DataFrame:
    """Paths of at least ``min_hops``, with every prefix that is as long: those were maximal earlier."""
    paths = all_paths(edges, min_hops=min_hops, **limits)
    times = edges.select(F.col("txn_id"), F.col("ts").alias("hop_ts"))
    cuts = paths.select("accounts", "txns", F.explode(F.sequence(F.lit(min_hops), F.col("hops"))).alias("n"))
    cuts = cuts.select(F.slice("accounts", 1, F.col("n") + 1).alias("accounts"), F.element_at("txns", F.col("n")).alias("txn_id")).distinct()
    return cuts.join(times, "txn_id").select("accounts", F.col("hop_ts").alias("ended"))


def latency(fired: DataFrame, schemes: DataFrame) -> DataFrame:
    """``scheme_id``, ``typology``, ``started``, ``caught``, ``days``, ``moved_before_alert``.

    fired: account_id, detector, day. schemes: scheme_id, typology, account_id, day, amount. Only
    alerts on or after a scheme's first day are caused by it; the share of its value on or
    before the day it was caught had moved. Nulls if never caught."""
    spans = schemes.groupBy("scheme_id", "typology").agg(F.min("day").alias("started"), F.sum("amount").alias("total"))
    accounts = schemes.select("scheme_id", "account_id").distinct()
    caused = accounts.join(fired, "account_id").join(spans.select("scheme_id", "started"), "scheme_id").filter("day >= started")
    caught = caused.groupBy("scheme_id").agg(F.min("day").alias("caught"))
    moved = schemes.join(caught, "scheme_id").filter("day <= caught").groupBy("scheme_id").agg(F.sum("amount").alias("moved"))
    out = spans.join(caught, "scheme_id", "left").join(moved, "scheme_id", "left")
    return out.select(
        "scheme_id", "typology", "started", "caught", F.date_diff("caught", "started").alias("days"),
        F.when(F.col("caught").isNotNull(), F.col("moved").cast("double") / F.nullif(F.col("total").cast("double"), F.lit(0.0))).alias("moved_before_alert"),
    )


def latency_report(latencies: DataFrame) -> DataFrame:
    """``typology``, ``schemes``, ``never``, ``median_days``, ``median_moved``."""
    return latencies.groupBy("typology").agg(
        F.count("*").alias("schemes"), F.count_if(F.col("caught").isNull()).alias("never"), F.median("days").alias("median_days"), F.median("moved_before_alert").alias("median_moved")
    )
