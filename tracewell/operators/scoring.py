"""Evaluation against ground truth. Only this module and model training read labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.ranges import sums_down
from . import risk


def _rate(part, whole):
    return F.when(whole == 0, 0.0).otherwise(part / F.nullif(whole, F.lit(0)))


def precision_recall(flagged: DataFrame, truth: DataFrame) -> DataFrame:
    """One row over distinct ids ``id`` flagged and ``id, scheme_id`` true: ``flagged``, ``hits``,
    ``precision``, ``false_positive_rate``, ``schemes``, ``caught``, ``recall``; 0 over nothing."""
    ids = flagged.select("id").distinct()
    bad = truth.select("id").distinct().withColumn("bad", F.lit(1))
    a = ids.join(bad, "id", "left").agg(F.count("*").alias("flagged"), F.count("bad").alias("hits"))
    met = truth.join(ids.withColumn("met", F.lit(1)), "id", "left").groupBy("scheme_id").agg(F.max("met").alias("met"))
    b = met.agg(F.count("*").alias("schemes"), F.count("met").alias("caught"))
    return a.crossJoin(b).select(  # one row each
        "flagged", "hits", _rate(F.col("hits"), F.col("flagged")).alias("precision"),
        _rate(F.col("flagged") - F.col("hits"), F.col("flagged")).alias("false_positive_rate"), "schemes", "caught", _rate(F.col("caught"), F.col("schemes")).alias("recall"),
    )


def recall_by(flagged: DataFrame, truth: DataFrame, kind: str = "typology") -> DataFrame:
    """``kind``, ``schemes``, ``caught``, ``recall`` of each kind of scheme."""
    ids = flagged.select("id").distinct().withColumn("met", F.lit(1))
    met = truth.join(ids, "id", "left").groupBy(kind, "scheme_id").agg(F.max("met").alias("met"))
    return met.groupBy(kind).agg(F.count("*").alias("schemes"), F.count("met").alias("caught")).withColumn("recall", _rate(F.col("caught"), F.col("schemes")))


def chain_score(chains: DataFrame, truth: DataFrame, shared: int = 2) -> DataFrame:
    """A chain is true if it shares two accounts with one scheme; a scheme is seen if a chain does."""
    members = truth.select("scheme_id", F.col("id").cast("string").alias("account")).distinct()
    path = F.col("accounts").cast("array<string>")
    own = chains.select(path.alias("chain"), F.explode(F.array_distinct(path)).alias("account"))
    met = own.join(members, "account").groupBy("chain", "scheme_id").count().filter(F.col("count") >= shared)
    n = chains.agg(F.count("*").alias("chains")).crossJoin(met.agg(F.count_distinct("chain").alias("true_chains"), F.count_distinct("scheme_id").alias("seen")))
    n = n.crossJoin(members.agg(F.count_distinct("scheme_id").alias("schemes")))  # one row each
    return n.select("*", _rate(F.col("true_chains"), F.col("chains")).alias("precision"), _rate(F.col("seen"), F.col("schemes")).alias("recall"))


def ranked(scores: DataFrame) -> DataFrame:
    """(id, score, label) with ``place`` by falling score, then id.

    Counts of distinct scores are summed first; only places among equal scores need a window
    within that score."""
    by_score = sums_down(scores.groupBy("score").agg(F.count("*").alias("n")), "score", {"upto": "n"})
    own = F.row_number().over(Window.partitionBy("score").orderBy("id"))
    above = by_score.select("score", (F.col("upto") - F.col("n")).alias("above"))
    return scores.join(above, "score").withColumn("place", F.col("above") + own).drop("above")


def at_budgets(scores: DataFrame, budgets: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """``budget``, ``reviewed``, ``hits``, ``precision``, ``recall``, ``reviews_per_find`` (null if none)."""
    total = scores.agg(F.sum("label").alias("bad"))
    top = ranked(scores).filter(F.col("place") <= max(budgets))
    each = top.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).filter("place <= budget")
    out = each.groupBy("budget").agg(F.count("*").alias("reviewed"), F.sum("label").cast("long").alias("hits")).crossJoin(total)
    return out.select(
        "budget", "reviewed", "hits", _rate(F.col("hits"), F.col("reviewed")).alias("precision"), _rate(F.col("hits"), F.col("bad")).alias("recall"),
        (F.col("reviewed") / F.nullif(F.col("hits"), F.lit(0))).alias("reviews_per_find"),
    )


def _by_score(scores: DataFrame) -> DataFrame:
    groups = scores.groupBy("score").agg(F.sum("label").cast("double").alias("tp"), F.count("*").cast("double").alias("n"))
    return sums_down(groups, "score", {"sum_tp": "tp", "sum_n": "n"})


def average_precision(scores: DataFrame) -> DataFrame:
    """One row ``average_precision``; equal scores are one step."""
    groups = _by_score(scores)
    return groups.agg((F.sum(F.col("tp") * F.col("sum_tp") / F.col("sum_n")) / F.nullif(F.sum("tp"), F.lit(0.0))).alias("average_precision"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row ``roc_auc``: the chance that a true case scores higher, ties counting half."""
    groups = _by_score(scores).withColumn("fp", F.col("n") - F.col("tp"))
    above = F.col("sum_tp") - F.col("tp")
    won = F.sum(F.col("fp") * (above + F.col("tp") / 2))
    return groups.agg((won / F.nullif(F.sum("tp") * F.sum("fp"), F.lit(0.0))).alias("roc_auc"))


def conversion(cases: DataFrame) -> DataFrame:
    """One row ``closed``, ``confirmed``, ``conversion``; null, not 0, where nothing is closed."""
    shut = F.col("status") == "closed"
    good = shut & F.col("disposition").startswith("true_positive")
    out = cases.agg(F.count_if(shut).alias("closed"), F.count_if(good).alias("confirmed"))
    return out.withColumn("conversion", F.col("confirmed") / F.nullif(F.col("closed"), F.lit(0)))


def layer_comparison(signals: DataFrame, truth: DataFrame, budget: int = 25) -> DataFrame:
    """``source``, ``hits``, ``precision`` of each source's own top accounts at a budget."""
    best = signals.groupBy("source", "account_id").agg(F.max("contribution").alias("score"))
    by = Window.partitionBy("source").orderBy(F.desc("score"), "account_id")
    top = best.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= budget)
    bad = truth.select(F.col("id").alias("account_id")).distinct().withColumn("bad", F.lit(1))
    out = top.join(bad, "account_id", "left").groupBy("source").agg(F.count("*").alias("reviewed"), F.count("bad").alias("hits"))
    return out.withColumn("precision", _rate(F.col("hits"), F.col("reviewed")))


def entity_score(hits: DataFrame, entities: DataFrame) -> DataFrame:
    """``match_kind``, ``planted``, ``found``, ``recall`` over customers planted by kind."""
    ids = hits.select("customer_id").distinct().withColumn("met", F.lit(1))
    met = entities.select("customer_id", "match_kind").distinct().join(ids, "customer_id", "left")
    return met.groupBy("match_kind").agg(F.count("*").alias("planted"), F.count("met").alias("found")).withColumn("recall", _rate(F.col("found"), F.col("planted")))


def media_score(hits: DataFrame, links: DataFrame) -> DataFrame:
    """One row ``flagged``, ``hits``, ``planted``, ``precision``, ``recall`` over distinct (article, customer) pairs."""
    found = hits.select("article_id", "customer_id").distinct()
    good = links.select("article_id", "customer_id").filter("customer_id is not null").distinct().withColumn("good", F.lit(1))
    a = found.join(good, ["article_id", "customer_id"], "left").agg(F.count("*").alias("flagged"), F.count("good").alias("hits"))
    out = a.crossJoin(good.agg(F.count("*").alias("planted")))  # one row each
    return out.withColumns({"precision": _rate(F.col("hits"), F.col("flagged")), "recall": _rate(F.col("hits"), F.col("planted"))})


def marginal_trade(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: accounts that a new queue (account_id) ``gained`` and ``lost``, and how many of each are true."""
    bad = truth.select(F.col("id").alias("account_id")).distinct().withColumn("bad", F.lit(1))
    old, new = before.select("account_id").distinct(), after.select("account_id").distinct()
    gained = new.join(old, "account_id", "left_anti").join(bad, "account_id", "left").agg(F.count("*").alias("gained"), F.count("bad").alias("gained_true"))
    lost = old.join(new, "account_id", "left_anti").join(bad, "account_id", "left").agg(F.count("*").alias("lost"), F.count("bad").alias("lost_true"))
    return gained.crossJoin(lost)  # one row each


#: Weights of media that the experiment tries.
MEDIA_WEIGHTS = (0.05, 0.10, 0.15, 0.20)


def media_experiment(separate: DataFrame, folded: DataFrame, truth: DataFrame, budget: int = 50) -> DataFrame:
    """What media evidence does to the queue of ``budget`` accounts: ``label``, ``weight``, ``threshold``, ``queue``,
    ``true_positives``, ``false_positives``, ``false_negatives``, ``precision``, ``recall``, ``media_cases`` (with any
    media) and ``media_only_cases`` (with nothing else), for no media, each weight of MEDIA_WEIGHTS, and media
    folded into screening. All arms are scored in one pass over the same evidence (account_id, source, detail, contribution)."""
    none, fold = "no media", "folded into screening"
    tables = [(none, 0.0, risk.WEIGHTS, risk.MIN_CASE_SCORE)]
    for w in MEDIA_WEIGHTS:
        table = risk.weights_with_media(w)
        tables.append((f"media weight {w:.2f}", w, table, risk.min_case_score(table)[0]))
    tables.append((fold, 0.0, risk.WEIGHTS, risk.MIN_CASE_SCORE))
    weighed = F.create_map(*(x for label, _, table, _ in tables for x in (F.lit(label), F.create_map(*(y for k, v in table.items() for y in (F.lit(k), F.lit(v)))))))
    arm = F.explode(F.array(*(F.lit(label) for label, *_ in tables[:-1])))
    used = separate.withColumn("label", arm).filter((F.col("label") != none) | (F.col("source") != "media")).unionByName(folded.withColumn("label", F.lit(fold)))
    is_media = F.col("detail").startswith("adverse media")
    best = used.groupBy("label", "account_id", "source").agg(F.max("contribution").alias("c"), F.max(is_media.cast("int")).alias("some"), F.min(is_media.cast("int")).alias("whole"))
    weight = F.coalesce(F.element_at(F.element_at(weighed, F.col("label")), F.col("source")), F.lit(0.0))
    total = best.groupBy("label", "account_id").agg(F.round(F.sum(weight * F.col("c")) * 100, 2).alias("score"), F.max("some").alias("some"), F.min("whole").alias("whole"))
    bar = F.create_map(*(x for label, _, _, t in tables for x in (F.lit(label), F.lit(float(t)))))
    by = Window.partitionBy("label").orderBy(F.desc("score"), "account_id")
    queue = total.filter(F.col("score") >= F.element_at(bar, F.col("label"))).withColumn("place", F.row_number().over(by)).filter(F.col("place") <= budget)
    bad = truth.select(F.col("id").alias("account_id")).distinct().withColumn("bad", F.lit(1))
    counts = queue.join(bad, "account_id", "left").groupBy("label").agg(
        F.count("*").alias("queue"), F.count("bad").alias("true_positives"), F.sum("some").alias("media_cases"), F.sum("whole").alias("media_only_cases")
    )
    arms = separate.sparkSession.createDataFrame([(label, w, float(t)) for label, w, _, t in tables], "label string, weight double, threshold double")
    out = arms.join(counts, "label", "left").fillna(0).crossJoin(bad.agg(F.count("*").alias("all")))  # one row
    return out.select(
        "label", "weight", "threshold", "queue", "true_positives", (F.col("queue") - F.col("true_positives")).alias("false_positives"), (F.col("all") - F.col("true_positives")).alias("false_negatives"),
        F.coalesce(F.col("true_positives") / F.nullif(F.col("queue"), F.lit(0)), F.lit(0.0)).alias("precision"), F.coalesce(F.col("true_positives") / F.nullif(F.col("all"), F.lit(0)), F.lit(0.0)).alias("recall"),
        "media_cases", "media_only_cases",
    )


#: Assumed hours that one review takes.
HOURS = 0.5


def review_hours(budgets: DataFrame) -> DataFrame:
    """``budget``, ``hours``, ``hours_per_find`` (null without a find) and ``ceiling``, the share of reviews that can
    be confirmed at best, of rows of at_budgets."""
    hours = F.col("reviewed") * F.lit(HOURS)
    return budgets.select("budget", hours.alias("hours"), (hours / F.nullif(F.col("hits"), F.lit(0))).alias("hours_per_find"), F.col("precision").alias("ceiling"))


def combined_comparison(signals: DataFrame, scores: DataFrame, truth: DataFrame, universe: DataFrame, budgets: tuple[int, ...] = (10, 25, 50)) -> DataFrame:
    """``source``, ``budget``, ``reviewed``, ``hits``, ``precision``, ``recall`` of the combined score and of each source
    alone, over the accounts of a universe only (those that no model was trained on)."""
    each = signals.groupBy("source", "account_id").agg(F.max("contribution").alias("score"))
    ranked = each.unionByName(scores.select(F.lit("combined").alias("source"), "account_id", "score")).join(universe, "account_id", "left_semi")
    by = Window.partitionBy("source").orderBy(F.desc("score"), "account_id")
    top = ranked.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= max(budgets))  # ranks beyond are dropped before the sort ends
    bad = truth.select(F.col("id").alias("account_id")).distinct().join(universe, "account_id", "left_semi").withColumn("bad", F.lit(1))
    placed = top.join(bad, "account_id", "left").withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).filter("place <= budget")
    out = placed.groupBy("source", "budget").agg(F.count("*").alias("reviewed"), F.count("bad").alias("hits")).crossJoin(bad.agg(F.count("*").alias("all")))  # one row
    return out.select("source", "budget", "reviewed", "hits", _rate(F.col("hits"), F.col("reviewed")).alias("precision"), _rate(F.col("hits"), F.col("all")).alias("recall"))


def bars(values: DataFrame) -> DataFrame:
    """(label, value) with ``place``: by falling value, then label. Few rows, as a chart has."""
    return values.withColumn("place", F.row_number().over(Window.orderBy(F.desc("value"), "label")))
