"""The ledger: schemas, the adapter over the test tables, loads, updates, checks and statements."""

from __future__ import annotations

import os
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranges import path_exists, running_total

# The domains of the ledger's columns.
CHANNELS = ("UPI", "NEFT", "IMPS", "RTGS", "NACH", "ATM", "POS", "CASH", "CHQ", "INT")
SEGMENTS = ("salaried", "business", "student", "nri", "merchant")
STATUSES = ("active", "dormant", "frozen", "closed")
OPENING = 1000


_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(), "money": T.DecimalType(15, 2),
}


def _schema(columns: str, required: str) -> T.StructType:
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind], name not in required.split()) for name, kind in pairs])


SCHEMAS = {
    "customers": _schema(
        "customer_id string, full_name string, dob date, segment string, city string, kyc_level string, risk_rating string, created_at timestamp_ntz",
        "customer_id full_name segment created_at",
    ),
    "accounts": _schema(
        "account_id string, customer_id string, account_type string, ifsc string, status string, opened_at timestamp_ntz",
        "account_id customer_id account_type ifsc status opened_at",
    ),
    "transactions": _schema(
        "txn_id long, ts timestamp_ntz, account_id string, direction string, channel string, amount money, "
        "counterparty_name string, counterparty_ref string, narration string, balance_after money",
        "txn_id ts account_id direction channel amount narration balance_after",
    ),
    "adverse_media": _schema(
        "article_id long, ts timestamp_ntz, headline string, body string, mentioned_name string, category string",
        "article_id ts headline body mentioned_name category",
    ),
}


@dataclass(frozen=True)
class Ledger:
    """A bank's tables. ``as_of`` gives the ledger as it was before a moment."""

    transactions: DataFrame
    accounts: DataFrame
    customers: DataFrame

    def as_of(self, moment: datetime | Column) -> Ledger:
        return replace(self, transactions=self.transactions.filter(F.col("ts") < moment))


#: The environment's variable that names a ledger's folder.
FOLDER = "TRACEWELL_LEDGER"


def open_ledger(spark: SparkSession, path: str | None = None) -> Ledger:
    """A ledger kept as one Parquet table each, read with its declared schema, from a folder or else from the
    one that the environment names. Tables that nothing was appended to are empty."""
    folder = path or os.environ.get(FOLDER)
    if not folder:
        raise ValueError(f"no folder given, and {FOLDER} is not set")
    held = lambda t: f"{folder.rstrip('/')}/{t}"
    tables = ("transactions", "accounts", "customers")
    return Ledger(*(spark.read.schema(SCHEMAS[t]).parquet(held(t)) if path_exists(spark, held(t)) else spark.createDataFrame([], SCHEMAS[t]) for t in tables))


def append(rows: DataFrame, path: str, table: str) -> None:
    """Append rows in the table's column order; no rows are no error. Null and '' stay apart."""
    rows.select(*(F.col(f.name).cast(f.dataType) for f in SCHEMAS[table])).write.mode("append").parquet(f"{path}/{table}")


def signed(amount: str = "amount") -> Column:
    return F.when(F.col("direction") == "CR", F.col(amount)).otherwise(-F.col(amount))


def from_driver(spark: SparkSession, sf_dir: str, balances: bool = True) -> Ledger:
    """The test tables as a bank: events are transactions, users accounts and customers. Without ``balances`` the
    transactions lack ``balance_after``, and no running sum is made."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    direction = F.when(F.col("event_type").isin("purchase", "error"), "DR").otherwise("CR")
    channel = F.element_at(F.array(*map(F.lit, CHANNELS)), 1 + k % 10)
    party = F.concat(F.lit("CP"), (k % 12).cast("string"))
    base = events.select(
        F.col("event_id").alias("txn_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), F.concat(F.lit("A"), F.col("user_id")).alias("account_id"),
        direction.alias("direction"), channel.alias("channel"), F.col("value").cast("decimal(15,2)").alias("amount"),
        party.alias("counterparty_name"), F.lit(None).cast("string").alias("counterparty_ref"), k.alias("k"),
    )
    narration = F.concat_ws("/", "channel", "direction", "txn_id", "counterparty_name")
    txns = base.withColumn("narration", narration)
    if balances:
        posted = running_total(txns, "account_id", "ts", "txn_id", signed(), "posted")
        txns = posted.withColumn("balance_after", (F.lit(OPENING) + F.col("posted")).cast("decimal(15,2)")).drop("posted")
    people = events.select("user_id").distinct()
    accounts = people.select(
        F.concat(F.lit("A"), "user_id").alias("account_id"), F.concat(F.lit("C"), F.floor(F.col("user_id") / 2).cast("string")).alias("customer_id")
    )
    customers = accounts.select("customer_id").distinct()
    return Ledger(txns, accounts, customers)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``src``, ``dst``, ``amount``, ``ts``, ``txn_id``: a transfer for each event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value > 0")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int")
    users = events.agg(F.max("user_id").alias("most"))
    dst = (7 * F.col("user_id") + 13 * k + 1) % (F.col("most") + 1)
    joined = events.crossJoin(F.broadcast(users))  # one row, an aggregate
    return joined.select(
        F.col("user_id").alias("src"), dst.alias("dst"), F.col("value").cast("double").alias("amount"),
        F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_id").alias("txn_id"),
    ).filter("src <> dst")


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each transfer as its two ledger rows, which share reference, amount and time."""
    e = edges(spark, sf_dir)
    dr = e.select((2 * F.col("txn_id")).alias("txn_id"), "ts", F.col("src").alias("account"), F.lit("DR").alias("direction"), "amount", F.concat(F.lit("UPI/DR/"), "txn_id", F.lit("/x")).alias("narration"))
    cr = e.select((2 * F.col("txn_id") + 1).alias("txn_id"), "ts", F.col("dst").alias("account"), F.lit("CR").alias("direction"), "amount", F.concat(F.lit("UPI/CR/"), "txn_id", F.lit("/x")).alias("narration"))
    return dr.unionByName(cr)


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name``, ``n``."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def bulk_update(table: DataFrame, key: str, column: str, updates: DataFrame) -> DataFrame:
    """table with ``column`` replaced where updates (key, column) has the key; null updates too."""
    new = updates.select(F.col(key), F.col(column).alias("__new"), F.lit(True).alias("__met"))
    return table.join(new, key, "left").withColumn(column, F.when(F.col("__met"), F.col("__new")).otherwise(F.col(column))).drop("__new", "__met").select(table.columns)


def load_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON array, in file order by ``position``, without the notice."""
    rows = spark.read.json(path, multiLine=True)
    return rows.withColumn("position", F.monotonically_increasing_id()).filter("type <> 'notice'")


def split_into_banks(bank: Ledger, mapping: DataFrame, path: str) -> None:
    """Write each bank's own accounts and transactions under ``bank=<name>``, from (account_id, bank).
    A bank is opened by its folder alone, so no detector can see another's rows."""
    for name in ("transactions", "accounts"):
        getattr(bank, name).join(mapping, "account_id").write.partitionBy("bank").mode("overwrite").parquet(f"{path}/{name}")


def violations(ledger: Ledger) -> DataFrame:
    """``table_name``, ``violated``, ``n`` of each broken constraint."""
    t, a, c = ledger.transactions, ledger.accounts, ledger.customers

    def rows(table: str, rule: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(table).alias("table_name"), F.lit(rule).alias("violated"), "n").filter("n > 0")

    checks = [
        rows("transactions", "amount > 0", t.filter("amount <= 0 or amount is null")),
        rows("transactions", "direction", t.filter("direction is null or direction not in ('DR', 'CR')")),
        rows("transactions", "channel", t.filter(~F.coalesce(F.col("channel").isin(*CHANNELS), F.lit(False)))),
        rows("transactions", "account exists", t.join(a, "account_id", "left_anti")),
        rows("transactions", "balance not negative", t.filter("balance_after < 0")),
        rows("transactions", "txn_id unique", t.groupBy("txn_id").count().filter("count > 1")),
        rows("accounts", "customer exists", a.join(c, "customer_id", "left_anti")),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.unionByName(check)
    return out


def opening_balances(txns: DataFrame) -> DataFrame:
    """``account_id``, ``opening``: the first row's balance with the row itself undone."""
    first = txns.groupBy("account_id").agg(F.min_by(F.struct("balance_after", "amount", "direction"), F.struct("ts", "txn_id")).alias("f"))
    undone = F.when(F.col("f.direction") == "CR", F.col("f.balance_after") - F.col("f.amount")).otherwise(F.col("f.balance_after") + F.col("f.amount"))
    return first.select("account_id", undone.alias("opening"))


def running_balances(txns: DataFrame) -> DataFrame:
    """Rows with ``replayed``, the balance rebuilt from the opening in order of time."""
    posted = running_total(txns, "account_id", "ts", "txn_id", signed(), "posted")
    return posted.join(opening_balances(txns), "account_id").withColumn("replayed", F.col("opening") + F.col("posted")).drop("posted")


def true_minimum(txns: DataFrame) -> DataFrame:
    """``account_id``, ``minimum``: least of the opening and all balances after."""
    low = txns.groupBy("account_id").agg(F.min("balance_after").alias("low"))
    return opening_balances(txns).join(low, "account_id").select("account_id", F.least("opening", "low").alias("minimum"))


def safe_debit_ceiling(txns: DataFrame, share: float = 0.6) -> DataFrame:
    """``account_id``, ``ceiling``: what a past debit may take at most, a share of the minimum."""
    return true_minimum(txns).select("account_id", F.greatest(F.col("minimum").cast("double") * share, F.lit(0.0)).alias("ceiling"))


def statement(txns: DataFrame, account_id: str) -> DataFrame:
    """One account's rows in order, with debit and credit columns."""
    own = running_total(txns.filter(F.col("account_id") == account_id), "account_id", "ts", "txn_id", F.lit(1), "line")
    return own.select(
        F.col("line").cast("int").alias("line"), "ts", "narration",
        F.when(F.col("direction") == "DR", F.col("amount")).alias("debit"), F.when(F.col("direction") == "CR", F.col("amount")).alias("credit"), "balance_after",
    )
