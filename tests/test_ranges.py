"""Windows after a row, scans by cells and by ranges, against plain versions and with one hot key."""

import random
import time
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewell.functions import names
from tracewell.operators import features, graph, replay, rules, screening
from tracewell.plans import ranges

START = datetime(2024, 1, 1)


def rows(seed, n=900, accounts=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(seconds=rng.choice((0, 3600, 86_400)) * rng.randrange(40) + rng.randrange(3), microseconds=rng.choice((0, 0, 1, 999_999)))
        out.append((i, f"A{rng.randrange(accounts)}", at if rng.random() > 0.02 else None, rng.choice(("CR", "DR")), float(rng.randrange(1, 300))))
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "txn_id long, account_id string, ts timestamp_ntz, direction string, amount double").withColumn("amount", F.col("amount").cast("decimal(15,2)"))


@pytest.mark.parametrize("back", [False, True])
@pytest.mark.parametrize("width", [1, 3600, 5000, 86_400])
def test_window_after_equals_pairs(spark, width, back):
    data = rows(width)
    probe, counted = (F.col("direction") == "CR") & (F.col("amount") >= 50), F.col("direction") == "DR"
    found = ranges.window_after(frame(spark, data), ["account_id"], "ts", width, probe, counted, back=back, max_a=F.col("amount"), min_a=F.col("amount"), sum_a=F.col("amount"))
    got = {r.txn_id: tuple(None if x is None else float(x) for x in (r.max_a, r.min_a, r.sum_a)) for r in found.collect()}
    want = {}
    span = timedelta(seconds=width)
    for i, account, ts, direction, amount in data:
        if direction == "CR" and amount >= 50:
            met = [b for _, a, t, d, b in data if ts and t and a == account and d == "DR" and (ts - span <= t < ts if back else ts < t <= ts + span)]
            want[i] = (max(met), min(met), sum(met)) if met else (None, None, None)
    assert got == want


def test_running_total_and_previous_by_cells(spark):
    data = [r for r in rows(5, 400) if r[2]]
    df = frame(spark, data)
    total = {r.txn_id: float(r.total) for r in ranges.running_total(df, "account_id", "ts", "txn_id", F.col("amount"), "total").collect()}
    before = {r.txn_id: r.before for r in ranges.with_previous(df, "account_id", "ts", "txn_id", "before").collect()}
    by = defaultdict(list)
    for r in sorted(data, key=lambda r: (r[1], r[2], r[0])):
        by[r[1]].append(r)
    for own in by.values():
        run, last = 0.0, None
        for i, _, ts, _, amount in own:
            run += amount
            assert total[i] == run and before[i] == last
            last = ts


def test_running_sums_cross_ranges(spark):
    rng = random.Random(2)
    data = [(rng.choice(("hot", "hot", "hot", "a", "b")), rng.randrange(10**6), rng.randrange(100)) for _ in range(3000)]
    df = spark.createDataFrame(data, "key string, at long, n long").repartition(4)
    got = ranges.running_sums(df, "key", ["at", "n"], {"total": "n", "rest": "n"}, {"rest": 97})
    assert got.select("n", "total").count() == len(data)
    by = defaultdict(list)
    for r in got.collect():
        by[r.key].append((r.at, r.n, r.total, r.rest))
    for own in by.values():
        run = 0
        for _, n, total, rest in sorted(own, key=lambda x: (x[0], x[1], x[2])):
            run += n
            assert total == run and rest == run % 97
    assert ranges.running_sums(df.limit(0), "key", ["at"], {"total": "n"}).count() == 0


def test_a_hot_account(spark):
    """One account has a million rows: no pair of rows is made, and no window holds more than a cell."""
    n = 1_000_000
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("id") * 3)
    amount = (F.pmod(F.xxhash64("id"), F.lit(1000)) + 1).cast("decimal(15,2)")
    hot = spark.range(n).select(
        F.col("id").alias("txn_id"), F.lit("HOT").alias("account_id"), at.alias("ts"), F.when(F.col("id") % 2 == 0, "CR").otherwise("DR").alias("direction"),
        F.lit("RTGS").alias("channel"), amount.alias("amount"), F.lit("x").alias("counterparty_name"),
    )
    began = time.time()
    assert rules.rapid_pass_through(hot, 900, 48, 0.85).count() == 1
    assert rules.round_trip(hot, 900, 12).count() == 1
    assert rules.dormancy_burst(hot).count() == 0
    assert features.rapid_credits(hot).first().rapid_credits > n * 0.49
    assert features.gap_hours(hot).first().max_gap_hours == 3 / 3600
    last = ranges.running_total(hot.select("txn_id", "account_id", "ts", "amount"), "account_id", "ts", "txn_id", F.col("amount"), "total").agg(F.max("total")).first()[0]
    assert last == hot.agg(F.sum("amount")).first()[0]
    assert replay.rapid_pass_through(hot, 900, 48, 0.85).first().day == START.date()
    assert time.time() - began < 120
    probes = (F.col("direction") == "CR") & (F.col("amount") >= 900)
    met = ranges.window_after(hot.select("account_id", "direction", "ts", "amount"), ["account_id"], "ts", 172_800, probes, F.col("direction") == "DR", max_a=F.col("amount"))
    assert met.count() == hot.filter(probes).count()


# --- signatures of words ---------------------------------------------------------------------


def words(seed, n, odd=True):
    rng = random.Random(seed)
    parts = ["ra", "ma", "sha", "ka", "an", "vi", "kr", "su", "esh", "pra", "deep", "no", "li", "th", "omas", "jo", "hn", "mi", "ch", "ael", "ba", "lu", "zi", "q", "x", "fe", "wy"]
    out = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)}
    if not odd:
        return sorted(out)
    out |= {"".join(rng.choice("abcdefgh") for _ in range(rng.choice((1, 2, 3, 5, 9, 14, 26, 31)))) for _ in range(n // 4)}
    return sorted(out | {w[:k] + w[k + 1 :] for w in list(out)[: n // 5] for k in (1,) if len(w) > 3})


@pytest.mark.parametrize("least", [0.5, 0.5999, 0.7, 0.75, 0.8799, 0.95])
def test_signatures_lose_no_pair(least):
    some = words(int(least * 100), 150)
    left = {w: set(names.signatures(w, least, False)) for w in some if len(w) > 1}
    right = {w: set(names.signatures(w, least, True)) for w in some if len(w) > 1}
    for a in left:
        for b in right:
            if names.jaro_winkler(a, b) >= least:
                assert left[a] & right[b], (a, b)


@pytest.mark.parametrize("least", [0.5999, 0.8799])
def test_alike_words_are_those_of_all_pairs(spark, least):
    one, two = words(1, 120), words(2, 120)
    left, right = (spark.createDataFrame([(w,) for w in s], f"{c} string") for s, c in ((one, "x"), (two, "y")))
    got = {tuple(r) for r in screening._alike(left, right, least).collect()}
    assert got == {(a, b) for a in one for b in two if names.token_score(a, b) >= least}


def test_few_words_are_compared(spark):
    """Of 100,000 words on one side and 500 on the other, below a twentieth of all pairs is scored."""
    one, two = words(3, 400_000, False)[:100_000], words(4, 600, False)[:500]
    assert len(one) == 100_000
    left, right = (spark.createDataFrame([(w,) for w in s], f"{c} string") for s, c in ((one, "x"), (two, "y")))
    pairs = screening.candidates(left, right, 0.8799)
    assert pairs.count() < len(one) * len(two) / 20
    assert "CartesianProduct" not in pairs._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().toString()


# --- chains by doubling ----------------------------------------------------------------------


def plain_paths(edges, min_amount):
    after = {e: [f for f in edges if f[0] == e[1] and timedelta(0) < f[3] - e[3] <= timedelta(hours=36) and 0.8 <= f[2] / e[2] <= 1.0] for e in edges}
    out, todo = set(), [(e,) for e in edges if e[2] >= min_amount]
    while todo:
        path = todo.pop()
        seen = {path[0][0], *(e[1] for e in path)}
        more = [f for f in after[path[-1]] if f[1] not in seen]
        todo += [(*path, f) for f in more]
        if not more and len(path) > 1:
            out.add(tuple(e[4] for e in path))
    return out


def test_doubled_paths_are_those_of_a_search(spark):
    rng = random.Random(11)
    edges = []
    for i in range(260):
        a, b = rng.sample(range(14), 2)
        edges.append((a, b, 100.0 - (i % 90) / 6 - rng.randrange(5), START + timedelta(hours=i + rng.randrange(12)), i))
    edges += [(100 + k, 101 + k, 90.0, START + timedelta(hours=k), 1000 + k) for k in range(37)]  # 37 hops
    edges += [(200, 201, 90.0, START, 2000), (201, 200, 90.0, START + timedelta(hours=1), 2001), (201, 201, 90.0, START + timedelta(hours=2), 2002)]
    df = spark.createDataFrame(edges, "src long, dst long, amount double, ts timestamp_ntz, txn_id long")
    got = [tuple(r.txns) for r in graph.all_paths(df, min_amount=85).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_paths(edges, 85)
    assert max(map(len, got)) >= 37
