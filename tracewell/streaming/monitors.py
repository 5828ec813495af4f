"""Streaming forms of rules that have one: an extension for live ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import HIGH_RISK, high_risk_geography


def geography(stream: DataFrame, watchlist=HIGH_RISK) -> DataFrame:
    """Stateless: the batch rule as it is."""
    return high_risk_geography(stream, watchlist)


def structuring(stream: DataFrame, ceiling: float, min_count: int, min_total: float, window: str = "20 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding windows of deposits; ``ts`` must be a timestamp with zone."""
    small = stream.filter((F.col("direction") == "CR") & (F.col("channel") == "CASH") & (F.col("amount") < ceiling)).withWatermark("ts", late)
    counted = small.groupBy("account_id", F.window("ts", window, slide)).agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return counted.filter((F.col("n") >= min_count) & (F.col("total") >= min_total))


def pass_through(stream: DataFrame, min_amount: float, hop_hours: int, min_ratio: float, late: str = "1 hour") -> DataFrame:
    """Credits joined to the debits that follow, state bounded by watermarks on both sides."""
    credit = stream.filter((F.col("direction") == "CR") & (F.col("amount") >= min_amount)).select("account_id", "ts", "amount").withWatermark("ts", late)
    debit = stream.filter("direction = 'DR'").select(F.col("account_id").alias("account2"), F.col("ts").alias("ts2"), F.col("amount").alias("amount2")).withWatermark("ts2", late)
    near = F.expr(f"account_id = account2 AND ts2 > ts AND ts2 <= ts + INTERVAL {hop_hours} HOURS")
    return credit.join(debit, near & (F.col("amount2") >= F.col("amount") * F.lit(min_ratio))).select("account_id", "ts", "amount", "ts2", "amount2")
