"""Banks that see their own rows only, and share keyed fingerprints of suspicious transfers."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pads(key: bytes) -> tuple[bytes, bytes]:
    """The inner and the outer block that HMAC-SHA256 puts before what it digests."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def keyed_token(key: bytes) -> Callable[[Column], Column]:
    """HMAC-SHA256 of a reference under the banks' common key, by two digests."""
    inner, outer = pads(key)

    def token(ref: Column) -> Column:
        first = F.sha2(F.concat(F.lit(bytearray(inner)), ref.cast("binary")), 256)
        return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 256)

    return token


def fingerprints(rows: DataFrame, flagged: DataFrame, token) -> DataFrame:
    """``bank``, ``token``, ``direction``, ``amount``, ``ts`` of all referred rows of flagged accounts;
    nothing in them names an account. rows carry ``bank``, ``account`` and ``narration``."""
    own = rows.join(flagged.select("account").distinct(), "account", "left_semi").filter(F.col("narration").like("%/%/%/%"))
    ref = F.split_part("narration", F.lit("/"), F.lit(3))
    return own.filter(ref != "").select("bank", token(ref).alias("token"), "direction", "amount", "ts")


def cross_bank_edges(prints: DataFrame) -> DataFrame:
    """Debits met by credits of another bank: ``from_bank``, ``to_bank``, ``token``, ``amount``, ``ts``.
    Repeated fingerprints give repeated edges."""
    out = prints.filter("direction = 'DR'").select("token", "amount", "ts", F.col("bank").alias("from_bank"))
    into = prints.filter("direction = 'CR'").select("token", "amount", "ts", F.col("bank").alias("to_bank"))
    return out.join(into, ["token", "amount", "ts"]).filter("from_bank <> to_bank")


def same_bank_runs(hops: DataFrame, min_hops: int = 2) -> DataFrame:
    """``chain``, ``bank``, ``first``, ``hops``: stretches of a chain's hops (chain, position, bank)
    that one bank sees whole."""
    by = Window.partitionBy("chain").orderBy("position")
    island = F.col("position") - F.row_number().over(Window.partitionBy("chain", "bank").orderBy("position"))
    runs = hops.withColumn("island", island).groupBy("chain", "bank", "island").agg(F.min("position").alias("first"), F.count("*").alias("hops"))
    return runs.filter(F.col("hops") >= min_hops).drop("island")


def hops_seen(planted: DataFrame, found: DataFrame) -> DataFrame:
    """``plant``, ``best``: most hops of a planted chain that one found chain has, in order and adjacent.
    planted (plant, position, account) and found (chain, position, account)."""
    pair = lambda df, name: df.alias("x").join(df.alias("y"), (F.col(f"x.{name}") == F.col(f"y.{name}")) & (F.col("y.position") == F.col("x.position") + 1)).select(
        F.col(f"x.{name}").alias(name), F.col("x.account").alias("a"), F.col("y.account").alias("b"))
    met = pair(planted, "plant").join(pair(found, "chain"), ["a", "b"]).select("plant", "chain", "a", "b").distinct()
    return met.groupBy("plant", "chain").count().groupBy("plant").agg(F.max("count").alias("best"))


def split_banks(rows: DataFrame, n: int = 4) -> DataFrame:
    """rows with ``bank``, by the account's number."""
    return rows.withColumn("bank", F.pmod(F.col("account"), F.lit(n)).cast("long"))


def hops_of(chains: DataFrame) -> DataFrame:
    """``plant``, ``position``, ``txn_id``, ``a``, ``b``: each hop of chains (plant, accounts, txns)."""
    own = chains.select("plant", "accounts", F.posexplode("txns").alias("position", "txn_id"))
    return own.select("plant", "position", "txn_id", F.get("accounts", F.col("position")).alias("a"), F.get("accounts", F.col("position") + 1).alias("b"))


def outcomes(chains: DataFrame, solo: DataFrame, recovered: DataFrame, bank: Callable[[Column], Column]) -> DataFrame:
    """For each chain (plant, accounts, txns): ``hops``, which all banks' pooled rows show; ``same_bank``, hops
    within one bank; ``solo_best``, most hops that one chain of a single bank has; ``coop``, hops whose
    fingerprints two banks matched. solo is (chain, position, account); recovered has ``txn_id``."""
    hops = hops_of(chains)
    met = hops.join(recovered.select("txn_id").distinct().withColumn("met", F.lit(1)), "txn_id", "left")
    counted = met.groupBy("plant").agg(F.count("*").alias("hops"), F.count_if(bank(F.col("a")) == bank(F.col("b"))).alias("same_bank"), F.count("met").alias("coop"))
    planted = chains.select("plant", F.posexplode("accounts").alias("position", "account"))
    return counted.join(hops_seen(planted, solo), "plant", "left").select("plant", "hops", "same_bank", F.coalesce("best", F.lit(0)).alias("solo_best"), "coop")


def chain_report(chains: DataFrame, flagged: DataFrame, bank: Callable[[Column], Column]) -> DataFrame:
    """For each chain (plant, accounts): how many ``accounts`` and ``banks`` it has, how many of its accounts their own bank
    flagged (``flagged``: account), and the ``longest_run`` of accounts that follow each other in one bank."""
    own = chains.select("plant", F.posexplode("accounts").alias("position", "account")).withColumn("bank", bank(F.col("account")))
    met = own.join(flagged.select("account").distinct().withColumn("met", F.lit(1)), "account", "left")
    counts = met.groupBy("plant").agg(F.count("*").alias("accounts"), F.count_distinct("bank").alias("banks"), F.count("met").alias("locally_flagged"))
    runs = same_bank_runs(own.withColumnRenamed("plant", "chain"), 1).groupBy("chain").agg(F.max("hops").alias("longest_run"))
    return counts.join(runs.withColumnRenamed("chain", "plant"), "plant")


def privacy_notes(prints: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row: fingerprints ``published``, ``banks`` that did, links that need both sides (``crossing``) and those
    ``lost`` as one side alone flagged its account."""
    shared = prints.agg(F.count("*").alias("published"), F.count_distinct("bank").alias("banks"))
    crossing = F.sum(F.col("hops") - F.col("same_bank"))
    return shared.crossJoin(outcomes.agg(crossing.alias("crossing"), (crossing - F.sum("coop")).alias("lost")))  # one row each
