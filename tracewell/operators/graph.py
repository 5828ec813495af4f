"""Transfers paired from ledger rows, and maximal pass-through chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranges import cut, window_join

def paired_transfers(rows: DataFrame) -> DataFrame:
    """``src``, ``dst``, ``amount``, ``ts``, ``dr_txn``, ``cr_txn`` of rows that share reference,
    amount and time across two accounts. The reference is the third part of the narration."""
    referred = rows.filter(F.col("narration").like("%/%/%/%")).withColumn("ref", F.split_part("narration", F.lit("/"), F.lit(3)))
    debit = referred.filter("direction = 'DR'").select("ref", "amount", "ts", F.col("account").alias("src"), F.col("txn_id").alias("dr_txn"))
    credit = referred.filter("direction = 'CR'").select("ref", "amount", "ts", F.col("account").alias("dst"), F.col("txn_id").alias("cr_txn"))
    return debit.join(credit, ["ref", "amount", "ts"]).filter("src <> dst").select("src", "dst", "amount", "ts", "dr_txn", "cr_txn")


def degrees(edges: DataFrame) -> DataFrame:
    """``account``, ``out_degree``, ``in_degree`` counting parallel edges."""
    out = edges.select(F.col("src").alias("account"), F.lit(1).alias("o"), F.lit(0).alias("i"))
    into = edges.select(F.col("dst").alias("account"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    return out.unionByName(into).groupBy("account").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def _grown(runs: DataFrame, hops: int) -> DataFrame:
    """Runs of more than ``hops`` hops, twice as many less one at most: those of just as many, whose last transfer
    is the first of another, without any that come back to an account."""
    left = runs.filter(F.col("hops") == hops)
    right = runs.select(F.col("txns")[0].alias("shared"), *(F.col(c).alias(f"r_{c}") for c in ("accounts", "amounts", "txns", "ended", "hops")))
    rest = lambda c, n: F.slice(f"r_{c}", n, F.size(f"r_{c}"))
    new = rest("accounts", 3)  # the shared transfer's two accounts are the left run's last
    met = left.join(right, (F.element_at("txns", -1) == F.col("shared")) & ~F.arrays_overlap("accounts", new))
    return met.select(
        F.concat("accounts", new).alias("accounts"), F.concat("amounts", rest("amounts", 2)).alias("amounts"), F.concat("txns", rest("txns", 2)).alias("txns"),
        "started", F.col("r_ended").alias("ended"), (F.col("hops") + F.col("r_hops") - 1).alias("hops"), "starts",
    )


def all_paths(edges: DataFrame, max_hop_hours: int = 36, retain_min: float = 0.80, retain_max: float = 1.00, min_amount: float = 50_000, min_hops: int = 2) -> DataFrame:
    """Maximal paths of ``min_hops`` or more over ``src, dst, amount, ts, txn_id``: ``accounts``, ``amounts``, ``txns``,
    ``started``, ``ended``, ``hops``. A path starts with a transfer of at least ``min_amount``, and grows by
    one that starts within the window after its last, carries the given share of the last amount, and leads to a new
    account. It is maximal if no transfer extends it, whatever else leaves its end.

    Which transfer may follow which is found once, by a join on account and time cell; transfers that
    nothing follows or precedes go no further. Runs then double: one of n hops and one of up to n that shares its
    last transfer make one of up to 2n - 1, so rounds grow with the logarithm of the longest path.
    """
    one = edges.select("txn_id", "src", F.col("dst").alias("via"), "amount", "ts")
    two = edges.select(F.col("src").alias("via"), F.col("dst").alias("to"), F.col("amount").alias("next_amount"), F.col("ts").alias("next_ts"), F.col("txn_id").alias("next_txn"))
    ratio = F.col("next_amount") / F.nullif(F.col("amount"), F.lit(0.0))
    fits = (ratio >= retain_min) & (ratio <= retain_max) & (F.col("src") != F.col("to")) & (F.col("via") != F.col("to"))
    follows = cut(window_join(one, two, ["via"], "ts", "next_ts", max_hop_hours * 3600, fits))
    runs = follows.select(
        F.array("src", "via", "to").alias("accounts"), F.array("amount", "next_amount").alias("amounts"), F.array("txn_id", "next_txn").alias("txns"),
        F.col("ts").alias("started"), F.col("next_ts").alias("ended"), F.lit(2).alias("hops"), (F.col("amount") >= min_amount).alias("starts"),
    )
    hops = 2
    while True:
        more = cut(_grown(runs, hops))
        if more.isEmpty():
            break
        runs, hops = runs.unionByName(more), 2 * hops - 1
    runs = runs.filter(F.col("starts") & (F.col("hops") >= min_hops)).drop("starts")
    if min_hops < 2:
        alone = edges.filter(F.col("amount") >= min_amount)
        runs = runs.unionByName(alone.select(F.array("src", "dst").alias("accounts"), F.array("amount").alias("amounts"), F.array("txn_id").alias("txns"), F.col("ts").alias("started"), F.col("ts").alias("ended"), F.lit(1).alias("hops")))
    after = follows.select(F.col("txn_id").alias("after"), "to")
    return runs.join(after, (F.element_at("txns", -1) == F.col("after")) & ~F.array_contains("accounts", F.col("to")), "left_anti")


def find_chains(edges: DataFrame, min_hops: int = 2, **limits) -> DataFrame:
    """The chains of all_paths with ``min_hops`` or more, one for each list of accounts (the first
    by start and transactions), without those inside a longer one; with ``retained``."""
    paths = all_paths(edges, min_hops=min_hops, **limits)
    unique = paths.groupBy("accounts").agg(F.min_by(F.struct("amounts", "txns", "started", "ended", "hops"), F.struct("started", "txns")).alias("own")).select("accounts", "own.*")
    unique = cut(unique)
    # Every shorter run of a longer chain is listed, so that containment is an equality join.
    runs = unique.select(F.explode(F.expr(
        """flatten(transform(sequence(1, size(accounts)), i ->
             transform(sequence(1, size(accounts) - i + 1), n -> slice(accounts, i, n))))"""
    )).alias("accounts"), F.size("accounts").alias("whole"))
    inside = runs.filter((F.size("accounts") < F.col("whole")) & (F.size("accounts") > min_hops)).select("accounts").distinct()
    kept = unique.join(inside, "accounts", "left_anti")
    first, last = F.element_at("amounts", 1), F.element_at("amounts", -1)
    return kept.withColumn("retained", F.when(first == 0, 0.0).otherwise(last / F.nullif(first, F.lit(0.0))))


def neighbour_mean(edges: DataFrame, values: DataFrame) -> DataFrame:
    """``account``, ``mean_value`` over distinct neighbours of either direction, from (account, value)."""
    both = edges.select(F.col("src").alias("account"), F.col("dst").alias("other")).union(edges.select("dst", "src")).distinct()
    return both.join(values.select(F.col("account").alias("other"), "value"), "other").groupBy("account").agg(F.avg("value").alias("mean_value"))
