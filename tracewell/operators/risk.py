"""Evidence from all layers, aggregated to one score for each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What each source weighs, where bands begin, and which evidence comes first.
WEIGHTS = {"rules": 0.35, "screening": 0.30, "graph": 0.20, "ml": 0.15}
BANDS = ((60, "critical"), (40, "high"), (18, "medium"))
TIERS = ("graph", "rules", "screening", "ml")
DECAY, MIN_CASE_SCORE, MEDIA_WEIGHT = 0.4, 17.5, 0.20
MEDIA_MODES = ("off", "separate", "folded")


def corroboration(n: Column) -> Column:
    """1 - 0.4 ^ n: 0 without evidence, towards 1 with much."""
    return F.when(n <= 0, 0.0).otherwise(1 - F.pow(F.lit(DECAY), n))


def rule_signals(alerts: DataFrame) -> DataFrame:
    """One signal for each distinct rule of an account, all as strong as their number makes them."""
    first = alerts.groupBy("account_id", "rule").agg(F.min("reason").alias("reason"))
    n = F.count("*").over(Window.partitionBy("account_id"))  # a row for each rule at most
    return first.select("account_id", F.lit("rules").alias("source"), F.concat_ws(": ", "rule", "reason").alias("detail"), corroboration(n).alias("contribution"))


def first_account(accounts: DataFrame) -> DataFrame:
    """``customer_id``, ``account_id``: the least account of each customer."""
    return accounts.groupBy("customer_id").agg(F.min("account_id").alias("account_id"))


def screening_signals(hits: DataFrame, accounts: DataFrame, source: str = "screening") -> DataFrame:
    """The best hit (customer_id, detail, score) of each account."""
    own = hits.join(first_account(accounts), "customer_id")
    best = own.groupBy("account_id").agg(F.max_by("detail", F.struct("score", "detail")).alias("detail"), F.max("score").alias("contribution"))
    return best.select("account_id", F.lit(source).alias("source"), "detail", "contribution")


def graph_signals(chains: DataFrame) -> DataFrame:
    """A signal for each chain and account in it."""
    own = chains.select(F.explode(F.col("accounts").cast("array<string>")).alias("account_id"), "hops", F.element_at("amounts", 1).alias("entering"), "retained")
    detail = F.concat(F.lit("on a chain of "), F.col("hops"), F.lit(" hops; Rs "), F.format_number("entering", 0), F.lit(" go in, "), F.format_number(F.col("retained") * 100, 0), F.lit("% come out"))
    return own.select("account_id", F.lit("graph").alias("source"), detail.alias("detail"), corroboration(F.col("hops")).alias("contribution"))


def ml_signals(scores: DataFrame) -> DataFrame:
    """A signal for each (account_id, score) over zero."""
    some = scores.filter("score > 0")
    return some.select("account_id", F.lit("ml").alias("source"), F.concat(F.lit("unlike other accounts: "), F.format_number("score", 2)).alias("detail"), F.col("score").alias("contribution"))


def media_signals(hits: DataFrame, accounts: DataFrame, mode: str) -> DataFrame:
    """Best adverse article of each account; folded evidence counts as screening."""
    if mode not in MEDIA_MODES[1:]:
        raise ValueError(f"no media signals in mode {mode!r}")
    return screening_signals(hits, accounts, "media" if mode == "separate" else "screening")


def band(score: Column) -> Column:
    out = F.lit("low")
    for least, name in reversed(BANDS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def aggregate(signals: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """``account_id``, ``score``, ``band``: the strongest signal of each source, weighted and summed,
    from 0 to 100. Sources without a weight count nothing."""
    table = weights or WEIGHTS
    weight = F.coalesce(F.element_at(F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.lit(v)))), F.col("source")), F.lit(0.0))
    strongest = signals.groupBy("account_id", "source").agg(F.max("contribution").alias("contribution"))
    total = strongest.groupBy("account_id").agg(F.sum(weight * F.col("contribution")).alias("total"))
    score = F.round(F.col("total") * 100, 2)
    return total.select("account_id", score.alias("score"), band(score).alias("band"))


def evidence_tier(signals: DataFrame) -> DataFrame:
    """``account_id``, ``tier``: the first of TIERS that an account has evidence from, else ml."""
    own = signals.groupBy("account_id").agg(F.collect_set("source").alias("sources"))
    out = F.lit("ml")
    for tier in reversed(TIERS):
        out = F.when(F.array_contains("sources", tier), tier).otherwise(out)
    return own.select("account_id", out.alias("tier"))


def weights_with_media(weight: float = MEDIA_WEIGHT, base: dict[str, float] | None = None) -> dict[str, float]:
    """Weights with media's share, scaled to sum to one."""
    table = dict(base or WEIGHTS) | {"media": weight}
    total = sum(table.values())
    return {k: v / total for k, v in table.items()}


def min_case_score(weights: dict[str, float] | None = None) -> tuple[float, float, float]:
    """(threshold, quietest control, model ceiling): a case opens below the quietest single
    control's score and above the most that a model alone can reach."""
    table = weights or WEIGHTS
    one = 1 - DECAY
    # One rule, the weakest screening hit, or a chain of two hops.
    quietest = min(100 * one * table["rules"], 100 * 0.88 * table["screening"], 100 * (1 - DECAY**2) * table["graph"])
    return round(quietest - 0.1, 2), round(quietest, 2), round(100 * table["ml"], 2)


def unsupervised_scores(raw: DataFrame, budget: int = 100) -> DataFrame:
    """(account_id, raw) scaled over all accounts to 0..1; the top ``budget`` are returned. Fewer
    than two accounts, or equal scores, give none."""
    ends = raw.agg(F.min("raw").alias("low"), F.max("raw").alias("high"), F.count("*").alias("n"))
    scaled = raw.crossJoin(F.broadcast(ends)).filter("n >= 2 and high > low")  # one row, an aggregate
    return scaled.select("account_id", ((F.col("raw") - F.col("low")) / (F.col("high") - F.col("low"))).alias("score")).orderBy(F.desc("score"), "account_id").limit(budget)
