"""Features of each account, and sequences of its last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import seconds, window_after, with_previous

SUB_THRESHOLD = (70_000, 100_000)
RAPID_HOURS, RAPID_RATIO = 24, 0.70
SEQUENCE_ROWS = 32

# The features' names, in order.
NAMES = (
    "txn_count", "total_in", "total_out", "net_flow", "mean_amount", "median_amount", "max_amount", "std_amount", "amount_cv",
    "distinct_counterparties", "counterparty_ratio", "counterparty_entropy", "top_counterparty_share", "credit_ratio",
    "active_days", "txns_per_active_day", "max_gap_hours", "mean_gap_hours", "balance_min", "balance_max", "balance_mean",
    "balance_std", "round_amount_ratio", "sub_threshold_ratio", "pct_cash", "pct_upi", "pct_wire", "pct_atm",
    "pct_international", "rapid_credit_ratio", "rapid_amount_ratio",
)


def _base(txns: DataFrame) -> DataFrame:
    return txns.select(
        "account_id", "direction", "channel", "ts", F.col("amount").cast("double").alias("amt"), "amount", F.col("balance_after").cast("double").alias("bal"),
    )


def _share(condition: Column) -> Column:
    return F.count_if(condition).cast("double") / F.count("*")


def counterparty_shares(txns: DataFrame) -> DataFrame:
    """``account_id``, ``counterparty_entropy``, ``top_counterparty_share``, ``distinct_counterparties``."""
    party = F.coalesce("counterparty_ref", "counterparty_name", F.lit("UNKNOWN"))
    counts = txns.groupBy("account_id", party.alias("cp")).agg(F.count("*").alias("n"))
    p = counts.withColumn("p", F.col("n").cast("double") / F.sum("n").over(Window.partitionBy("account_id")))
    return p.groupBy("account_id").agg(
        (-F.sum(F.col("p") * F.log("p"))).alias("counterparty_entropy"), F.max("p").alias("top_counterparty_share"),
        F.count("*").alias("distinct_counterparties"),
    )


def gap_hours(txns: DataFrame) -> DataFrame:
    """``account_id``, ``max_gap_hours``, ``mean_gap_hours`` between rows that follow each other."""
    rows = with_previous(txns.select("account_id", "txn_id", "ts"), "account_id", "ts", "txn_id", "before")
    gaps = rows.select("account_id", ((seconds("ts") - seconds("before")) / F.lit(3600.0)).alias("gap")).filter("gap is not null")
    return gaps.groupBy("account_id").agg(F.max("gap").alias("max_gap_hours"), F.avg("gap").alias("mean_gap_hours"))


def rapid_credits(txns: DataFrame, hours: int = RAPID_HOURS, ratio: float = RAPID_RATIO) -> DataFrame:
    """``account_id``, ``rapid_credits``, ``rapid_amount``: credits mostly debited within hours."""
    rows = txns.select("account_id", "direction", "ts", "amount")
    met = window_after(rows, ["account_id"], "ts", hours * 3600, F.col("direction") == "CR", F.col("direction") == "DR", max_other=F.col("amount").cast("double"))
    met = met.filter(F.col("max_other") >= F.col("amount").cast("double") * F.lit(ratio))
    return met.groupBy("account_id").agg(F.count("*").alias("rapid_credits"), F.sum("amount").cast("double").alias("rapid_amount"))


def account_features(txns: DataFrame) -> DataFrame:
    """``account_id`` and NAMES; nulls of ratios without a base are zero."""
    base = _base(txns)
    credit, debit = F.col("direction") == "CR", F.col("direction") == "DR"
    main = base.groupBy("account_id").agg(
        F.count("*").alias("txn_count"),
        F.coalesce(F.sum(F.when(credit, F.col("amount"))), F.lit(0)).cast("double").alias("total_in"),
        F.coalesce(F.sum(F.when(debit, F.col("amount"))), F.lit(0)).cast("double").alias("total_out"),
        F.avg("amt").alias("mean_amount"), F.median("amt").alias("median_amount"), F.max("amt").alias("max_amount"),
        F.coalesce(F.stddev_pop("amt"), F.lit(0.0)).alias("std_amount"),
        _share(credit).alias("credit_ratio"),
        F.count_distinct(F.to_date("ts")).alias("active_days"),
        F.min("bal").alias("balance_min"), F.max("bal").alias("balance_max"), F.avg("bal").alias("balance_mean"),
        F.coalesce(F.stddev_pop("bal"), F.lit(0.0)).alias("balance_std"),
        _share(F.col("amt") == F.round("amt", -3)).alias("round_amount_ratio"),
        _share(F.col("amt").between(*SUB_THRESHOLD)).alias("sub_threshold_ratio"),
        _share(F.col("channel") == "CASH").alias("pct_cash"), _share(F.col("channel") == "UPI").alias("pct_upi"),
        _share(F.col("channel").isin("NEFT", "IMPS", "RTGS")).alias("pct_wire"), _share(F.col("channel") == "ATM").alias("pct_atm"),
        _share(F.col("channel") == "INT").alias("pct_international"),
    )
    joined = main.join(counterparty_shares(txns), "account_id", "left").join(gap_hours(txns), "account_id", "left").join(rapid_credits(txns), "account_id", "left")
    zero = F.lit(0.0)
    derived = joined.withColumns({
        "net_flow": F.col("total_in") - F.col("total_out"),
        "amount_cv": F.col("std_amount") / F.nullif(F.col("mean_amount"), zero),
        "counterparty_ratio": F.col("distinct_counterparties").cast("double") / F.col("txn_count"),
        "txns_per_active_day": F.col("txn_count").cast("double") / F.col("active_days"),
        "rapid_credit_ratio": F.col("rapid_credits").cast("double") / F.col("txn_count"),
        "rapid_amount_ratio": F.col("rapid_amount") / F.nullif(F.col("total_in"), zero),
    })
    return derived.select("account_id", *(F.coalesce(F.col(n).cast("double"), zero).alias(n) for n in NAMES))


def sequences(txns: DataFrame, rows: int = SEQUENCE_ROWS) -> DataFrame:
    """``account_id``, ``steps``: up to ``rows`` last rows, oldest first, as (amount, sign, gap in
    hours, balance, is cash); the first kept row's gap is 0. A model pads on the left."""
    order = Window.partitionBy("account_id").orderBy("ts", "txn_id")
    back = Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("txn_id"))
    kept = txns.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= rows)
    gap = F.coalesce((seconds("ts") - seconds(F.lag("ts").over(order))) / F.lit(3600.0), F.lit(0.0))
    step = F.struct(
        (-F.col("back")).alias("place"), F.col("amount").cast("double").alias("amount"), F.when(F.col("direction") == "CR", 1.0).otherwise(-1.0).alias("sign"),
        gap.alias("gap_hours"), F.col("balance_after").cast("double").alias("balance"), (F.col("channel") == "CASH").cast("double").alias("is_cash"),
    )
    return kept.select("account_id", step.alias("step")).groupBy("account_id").agg(F.sort_array(F.collect_list("step")).alias("steps"))
