"""Cases as an append-only log of events; a case's state is the fold of its events."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .risk import MIN_CASE_SCORE

# How a case may end.
DISPOSITIONS = ("false_positive", "true_positive_sar", "true_positive_no_sar", "escalated")
EVENTS = "event_id long, case_id long, ts timestamp_ntz, actor string, event_type string, detail string"


class LifecycleError(ValueError):
    """A step that the case's state does not allow."""


def event(spark: SparkSession, event_id: int, case_id: int, ts, actor: str, kind: str, detail: str) -> DataFrame:
    """One row to append to the log."""
    return spark.createDataFrame([(event_id, case_id, ts, actor, kind, detail)], EVENTS)


def close_detail(disposition: str, rationale: str) -> str:
    """The detail of a closing event; needs a known disposition and a reason."""
    if disposition not in DISPOSITIONS:
        raise LifecycleError(f"unknown disposition {disposition!r}")
    if not rationale.strip():
        raise LifecycleError("closing needs a rationale")
    return f"{disposition}: {rationale.strip()}"


def state(events: DataFrame) -> DataFrame:
    """``case_id``, ``status``, ``disposition``, ``assigned_to``, ``opened_at``, ``closed_at``.

    Assigning puts a case in review, closing sets its disposition, reopening clears it."""
    order = F.struct("ts", "event_id")
    moves = events.filter(F.col("event_type").isin("opened", "assigned", "closed", "reopened"))
    last = moves.groupBy("case_id").agg(
        F.max_by("event_type", order).alias("last"), F.max_by("detail", order).alias("detail"), F.max_by("ts", order).alias("moved"),
        F.min(F.when(F.col("event_type") == "opened", F.col("ts"))).alias("opened_at"),
        F.max_by(F.when(F.col("event_type") == "assigned", F.col("detail")), F.when(F.col("event_type") == "assigned", order)).alias("assigned_to"),
    )
    status = F.when(F.col("last") == "closed", "closed").when(F.col("last") == "assigned", "in_review").when(
        (F.col("last") == "reopened") & F.col("assigned_to").isNotNull(), "in_review").otherwise("open")
    shut = F.col("last") == "closed"
    return last.select(
        "case_id", status.alias("status"), F.when(shut, F.split_part("detail", F.lit(":"), F.lit(1))).alias("disposition"), "assigned_to", "opened_at",
        F.when(shut, F.col("moved")).alias("closed_at"),
    )


class Casebook:
    """Cases on a log of events (``published.Log`` of EVENTS) that any number of analysts write to.

    A step is checked against the case's state in the log's last version, and appended only if that version
    still is the last; else it is checked again on what came between. So two analysts cannot both close a case."""

    #: The states that a step may be taken in.
    ALLOWED = {"assigned": ("open", "in_review"), "note": ("open", "in_review", "closed"), "closed": ("open", "in_review"), "reopened": ("closed",)}

    def __init__(self, log, tries: int = 50):
        self.log, self.tries = log, tries

    def states(self) -> DataFrame:
        return state(self.log.read())

    def _step(self, case_id: int | None, actor: str, ts, kind: str, detail: str) -> int:
        for attempt in range(self.tries):
            number, version = self.log.versions.latest()
            events = self.log.read_version(version)
            last = events.agg(F.max("event_id").alias("event"), F.max("case_id").alias("case")).first()
            case = (last["case"] or 0) + 1 if case_id is None else case_id
            if case_id is not None:
                now = state(events.filter(F.col("case_id") == case_id)).select("status").first()
                if now is None:
                    raise LifecycleError(f"no case {case_id}")
                if now.status not in self.ALLOWED[kind]:
                    raise LifecycleError(f"case {case_id} is {now.status}: it cannot be {kind}")
            if self.log.append_after(number, event(self.log.spark, (last["event"] or 0) + 1, case, ts, actor, kind, detail)):
                return case
            time.sleep(0.01 * (attempt + 1))
        raise LifecycleError("the log changed each time")

    def open_case(self, account_id: str, actor: str, ts) -> int:
        """The new case's number."""
        return self._step(None, actor, ts, "opened", account_id)

    def assign(self, case_id: int, to: str, actor: str, ts) -> None:
        self._step(case_id, actor, ts, "assigned", to)

    def note(self, case_id: int, text: str, actor: str, ts) -> None:
        if not text.strip():
            raise LifecycleError("an empty note")
        self._step(case_id, actor, ts, "note", text)

    def close(self, case_id: int, disposition: str, rationale: str, actor: str, ts) -> None:
        self._step(case_id, actor, ts, "closed", close_detail(disposition, rationale))

    def reopen(self, case_id: int, reason: str, actor: str, ts) -> None:
        if not reason.strip():
            raise LifecycleError("reopening needs a reason")
        self._step(case_id, actor, ts, "reopened", reason)


def timeline(events: DataFrame, case_id: int) -> DataFrame:
    return events.filter(F.col("case_id") == case_id).orderBy("event_id")


def queue(cases: DataFrame, status: str | None = "open", limit: int = 50) -> DataFrame:
    """Cases by falling score; open ones include those in review, None is all."""
    wanted = {None: None, "open": ("open", "in_review")}.get(status, (status,))
    own = cases if wanted is None else cases.filter(F.col("status").isin(*wanted))
    return own.orderBy(F.desc("risk_score"), "case_id").limit(limit)


def to_open(scores: DataFrame, cases: DataFrame, threshold: float = MIN_CASE_SCORE, limit: int = 50) -> DataFrame:
    """The accounts to open cases for: at or over the threshold, without a live case, best first."""
    live = cases.filter("status <> 'closed'").select("account_id")
    return scores.filter(F.col("score") >= threshold).join(live, "account_id", "left_anti").orderBy(F.desc("score"), "account_id").limit(limit)


def snapshot(signals: DataFrame, cases: DataFrame) -> DataFrame:
    """The evidence of each case as it stood: ``case_id``, ``source``, ``detail``, ``contribution``."""
    return signals.join(cases.select("case_id", "account_id"), "account_id").select(
        "case_id", "source", "detail", F.round("contribution", 3).cast("decimal(4,3)").alias("contribution")
    )


def entity_360(
    txns: DataFrame, chains: DataFrame, cases: DataFrame, account_id: str, last: int = 20,
    accounts: DataFrame | None = None, customers: DataFrame | None = None, media: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """One account's totals, last rows, chains and live cases; with ``accounts`` and ``customers`` also its holder's profile, and
    with ``media`` (article_id, customer_id, category, headline, score) the articles that name the holder."""
    own = txns.filter(F.col("account_id") == account_id)
    out = {
        "totals": account_summary(own),
        "transactions": own.orderBy(F.desc("ts"), F.desc("txn_id")).limit(last),
        "chains": chains.filter(F.array_contains(F.col("accounts").cast("array<string>"), account_id)),
        "cases": cases.filter((F.col("account_id") == account_id) & F.col("status").isin("open", "in_review")),
    }
    if accounts is not None:
        holder = accounts.filter(F.col("account_id") == account_id)
        if customers is not None:
            out["profile"] = holder.join(customers.drop("account_id"), "customer_id")
        if media is not None:
            out["media"] = media.join(holder.select("customer_id"), "customer_id").orderBy(F.desc("score"), "article_id")
    return out


def told_at(ts: str) -> Column:
    """A moment as narratives write it: day, month's short name, year, hours and minutes."""
    return F.date_format(ts, "dd MMM yyyy HH:mm")


def narrative_rows(txns: DataFrame, account_id: str, n: int = 10) -> DataFrame:
    """``place``, ``at``, ``line`` of an account's largest rows, as a report lists them."""
    top = top_values(txns.filter(F.col("account_id") == account_id), n)
    line = F.concat(F.col("direction"), F.lit(" "), F.format_number(F.col("amount").cast("double"), 2), F.lit(" by "), F.col("channel"), F.coalesce(F.concat(F.lit(", "), F.col("counterparty_name")), F.lit("")))
    return top.select("place", told_at("ts").alias("at"), line.alias("line"))


def account_summary(txns: DataFrame) -> DataFrame:
    """``account_id``, ``n``, ``total_in``, ``total_out``, ``first_ts``, ``last_ts``."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0)).cast("double")
    return txns.groupBy("account_id").agg(
        F.count("*").alias("n"), side("CR").alias("total_in"), side("DR").alias("total_out"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def channel_mix(txns: DataFrame) -> DataFrame:
    """``account_id``, ``channel``, ``n``, ``total``."""
    return txns.groupBy("account_id", "channel").agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("total"))


def top_values(txns: DataFrame, n: int = 10) -> DataFrame:
    """Each account's n largest rows, by amount, then time, with ``place``."""
    from pyspark.sql import Window

    by = Window.partitionBy("account_id").orderBy(F.desc("amount"), "ts", "txn_id")
    return txns.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= n)
