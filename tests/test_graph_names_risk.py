"""Chains, names, evidence, cases, scores and banks."""

import hashlib
import hmac
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions.names import jaro_winkler, metaphone, normalise, similarity
from tracewell.operators import cases, graph, ml, multibank, redteam, risk, scoring, screening
from tracewell.plans import ranges
from tracewell.sources import ledger, world

T0 = datetime(2024, 1, 1)
WORDS = st.text(alphabet="abcdefghst", min_size=0, max_size=8)


def edges(spark, *items):
    return spark.createDataFrame([(s, d, float(a), T0 + timedelta(hours=h), i) for i, (s, d, a, h) in enumerate(items)], "src long, dst long, amount double, ts timestamp_ntz, txn_id long")


def test_chains_are_maximal_and_whole(spark):
    e = edges(spark, (1, 2, 100, 0), (2, 3, 95, 5), (3, 4, 90, 10), (3, 1, 90, 11), (4, 5, 10, 12), (7, 8, 100, 0), (8, 9, 79, 1))
    found = {tuple(r.accounts): r for r in graph.find_chains(e, min_amount=50).collect()}
    assert set(found) == {(1, 2, 3, 4), (2, 3, 1)}
    assert found[1, 2, 3, 4].hops == 3 and found[1, 2, 3, 4].retained == pytest.approx(0.9)


def test_ratio_is_to_the_last_hop_and_only_the_first_needs_the_amount(spark):
    e = edges(spark, (1, 2, 100, 0), (2, 3, 85, 1), (3, 4, 70, 2))
    assert [tuple(r.accounts) for r in graph.find_chains(e, min_amount=90).collect()] == [(1, 2, 3, 4)]


def test_parallel_edges_keep_the_first_by_time(spark):
    e = edges(spark, (1, 2, 100, 0), (2, 3, 95, 5), (2, 3, 96, 6))
    r = graph.find_chains(e, min_amount=50).collect()
    assert len(r) == 1 and r[0].txns == [0, 1]


def test_no_edges_no_chains(spark):
    assert graph.find_chains(edges(spark)).count() == 0


@pytest.mark.parametrize("a,b", [("Mohammed Khan", "Muhammad Khan"), ("Farhan Ali", "Farhaan Ali"), ("Suresh Kumar Gupta", "Gupta Suresh Kumar"), ("S K Gupta", "S. K. Gupta"), ("José Pérez", "Jose Perez")])
def test_same_person(a, b):
    assert similarity(a, b) >= 0.88


@pytest.mark.parametrize("a,b", [("Suresh Kumar", "Suresh Gupta"), ("Meera Nair", "Vikram Singh"), ("", "Anyone"), ("Priya Iyer", "Pooja Rao")])
def test_other_person(a, b):
    assert similarity(a, b) < 0.88


def test_normalise_and_codes():
    assert normalise("Farhaan  Álí.") == "farhaan ali" and normalise(None) == ""
    assert metaphone("mohammed") == metaphone("muhammad") and metaphone("knight") == "NT" and metaphone("phone") == "FN"


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS)
def test_jaro_winkler_properties(a, b):
    assert 0 <= jaro_winkler(a, b) <= 1 and (jaro_winkler(a, b) == 1) == (a == b)


def signals(spark, *items):
    return spark.createDataFrame(list(items), "account_id string, source string, detail string, contribution double")


def test_evidence_is_strongest_by_source(spark):
    s = signals(spark, ("A", "rules", "x", 0.6), ("A", "rules", "y", 0.6), ("B", "graph", "x", 0.84), ("B", "rules", "x", 0.6), ("C", "other", "x", 1.0))
    out = {r.account_id: (r.score, r.band) for r in risk.aggregate(s).collect()}
    assert out == {"A": (21.0, "medium"), "B": (37.8, "medium"), "C": (0.0, "low")}


def test_case_threshold_lies_between_models_and_controls():
    low, quiet, model = risk.min_case_score()
    assert model < risk.MIN_CASE_SCORE and model < low < quiet
    assert sum(risk.weights_with_media().values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        risk.media_signals(None, None, "sideways")


def test_case_lifecycle(spark):
    with pytest.raises(cases.LifecycleError):
        cases.close_detail("gone", "why")
    with pytest.raises(cases.LifecycleError):
        cases.close_detail("escalated", "  ")
    log = cases.event(spark, 1, 7, T0, "a", "opened", "-").unionByName(cases.event(spark, 2, 7, T0, "a", "closed", cases.close_detail("escalated", "big")))
    assert cases.state(log).first().disposition == "escalated"
    reopened = cases.state(log.unionByName(cases.event(spark, 3, 7, T0, "a", "reopened", "-"))).first()
    assert reopened.status == "open" and reopened.disposition is None


def test_scores_of_nothing(spark):
    none = spark.createDataFrame([], "id string, scheme_id string")
    r = scoring.precision_recall(none.select("id"), none).first()
    assert (r.precision, r.recall) == (0.0, 0.0)
    empty = spark.createDataFrame([], "status string, disposition string")
    assert scoring.conversion(empty).first().conversion is None


def test_quartet(spark):
    truth = spark.createDataFrame([("A1", "S1", "t"), ("A2", "S2", "t")], "id string, scheme_id string, typology string")
    flagged = spark.createDataFrame([("A1",), ("A2",), ("A5",), ("A1",)], "id string")
    r = scoring.precision_recall(flagged, truth).first()
    assert r.precision == pytest.approx(2 / 3) and r.false_positive_rate == pytest.approx(1 / 3) and r.recall == 1


def test_auc_with_ties(spark):
    s = spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 1), ("c", 0.5, 0), ("d", 0.1, 0)], "id string, score double, label int")
    assert scoring.roc_auc(s).first()[0] == pytest.approx(0.875)
    assert scoring.average_precision(s).first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_prints_need_two_banks_and_name_nobody(spark):
    rows = spark.createDataFrame(
        [(0, 1, "UPI/DR/77/x", "DR", 5.0, T0), (1, 2, "UPI/CR/77/x", "CR", 5.0, T0), (0, 1, "UPI/DR/78/x", "DR", 5.0, T0), (0, 3, "UPI/CR/78/x", "CR", 5.0, T0), (0, 1, "a/b//c", "DR", 5.0, T0)],
        "bank long, account long, narration string, direction string, amount double, ts timestamp_ntz",
    )
    prints = multibank.fingerprints(rows, rows, multibank.keyed_token(b"k"))
    assert "account" not in prints.columns and prints.count() == 4
    assert multibank.cross_bank_edges(prints).count() == 1


def test_screening_and_watchlist(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text('[{"name":"n","type":"notice"},{"name":"Farhan Ali","type":"pep"}]')
    listed = ledger.load_watchlist(spark, str(path))
    people = spark.createDataFrame([("C1", "Farhaan Ali"), ("C2", "Zed Zeta"), ("C3", None)], "customer_id string, full_name string")
    assert [r.customer_id for r in screening.screen_customers(people, listed).collect()] == ["C1"]
    assert screening.screen_name(spark, "IRAN EXPORTS", listed).first().decision == "REVIEW"


def test_updates_keep_nulls_apart(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, v string")
    u = spark.createDataFrame([(1, None), (2, "x"), (9, "y")], "k long, v string")
    assert sorted(map(tuple, ledger.bulk_update(t, "k", "v", u).collect())) == [(1, None), (2, "x"), (3, "c")]


def test_worlds_repeat_and_never_overdraw(spark):
    people = world.population(spark, 50)
    a = world.post(world.life_events(people, 10))
    assert sorted(a.collect()) == sorted(world.post(world.life_events(world.population(spark, 50), 10)).collect())
    assert a.filter("balance_after < 0").count() == 0
    with pytest.raises(ValueError):
        world.partition_pool(people, {"x": 60})
    with pytest.raises(ValueError):
        world.name_variant(F.lit("A B"), "upside-down")


def test_split_is_stratified(spark):
    rows = spark.createDataFrame([(f"A{i}", int(i < 10)) for i in range(40)], "account_id string, label int")
    out = ml.stratified_split(rows, 0.3).groupBy("label").agg({"account_id": "count"}).count()
    n = {r.label: r.n for r in ml.stratified_split(rows, 0.3).filter("test").groupBy("label").count().withColumnRenamed("count", "n").collect()}
    assert out == 2 and n == {0: 9, 1: 3}


def test_chains_are_planted_across_banks(spark):
    mapping = world.assign_banks(world.population(spark, 200))
    bank = {r.account_id: r.bank for r in mapping.collect()}
    for placement in ("naive", "deliberate"):
        planted = [r.account_ids for r in world.plant_chains(mapping, 6, 5, placement).collect()]
        assert len(planted) == 6 and len({a for c in planted for a in c}) == 30
        if placement == "deliberate":
            assert all(bank[a] != bank[b] for c in planted for a, b in zip(c, c[1:]))
    with pytest.raises(ValueError):
        world.plant_chains(mapping, placement="sideways")
    with pytest.raises(ValueError):
        world.plant_chains(mapping.limit(3))
    assert world.post(world.life_events(world.cast(spark), 7)).count() > 25


@pytest.mark.parametrize("key", [b"k", b"x" * 64, b"long" * 40])
def test_tokens_are_hmacs(spark, key):
    refs = spark.createDataFrame([("77",), ("",), ("é/1",)], "ref string")
    got = {r.ref: r.token for r in refs.withColumn("token", multibank.keyed_token(key)(F.col("ref"))).collect()}
    assert got == {r: hmac.new(key, r.encode(), hashlib.sha256).hexdigest() for r in ("77", "", "é/1")}


def test_schemes_are_as_described(spark):
    people = world.population(spark, 40)
    accounts = people.select("account_id")
    sums = {r.scheme_id: (r.n, float(r.total)) for r in world.shell_company(accounts, total=1000.01).groupBy("scheme_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total")).collect()}
    assert len(sums) == 40 and all(3 <= n <= 8 and total == 1000.01 for n, total in sums.values())
    dormant = world.dormant_reactivation(accounts, amount=50_000).groupBy("scheme_id", "direction").agg(F.count("*").alias("n"), F.sum("amount").alias("t"), F.min("ts").alias("a"), F.max("ts").alias("b")).collect()
    for r in dormant:
        assert r.n == 1 and r.t == 50_000 and (r.a - T0).total_seconds() >= 3 * 86_400 if r.direction == "CR" else 2 <= r.n <= 4 and 0.9 <= float(r.t) / 50_000 <= 0.97
    spare = accounts.withColumn("ceiling", F.lit(700.0))
    trips = world.round_tripping(spare).groupBy("scheme_id").agg(F.sum(F.when(F.col("direction") == "DR", F.col("amount"))).alias("out"), F.sum(F.when(F.col("direction") == "CR", F.col("amount"))).alias("back")).collect()
    assert all(r.out == 700 and 1.02 <= float(r.back) / 700 <= 1.1 for r in trips)
    legs = world.geography(spare, ("IRAN",)).groupBy("scheme_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("direction") == "DR", F.col("amount"))).alias("out")).collect()
    assert all(1 <= r.n <= 3 and (r.out or 0) <= 700 for r in legs) and any(r.out for r in legs)
    chain = world.layering(spark.createDataFrame([("c", ["A1", "A2", "A3"])], "chain_id string, account_ids array<string>"), total=1000.0).orderBy("ts", "direction").collect()
    assert [(r.account_id, r.direction, r.role) for r in chain] == [("A1", "CR", "source"), ("A2", "CR", "mule"), ("A1", "DR", "source"), ("A3", "CR", "sink"), ("A2", "DR", "mule")]
    amounts = [float(r.amount) for r in chain if r.direction == "CR"]
    assert all(0.92 <= b / a <= 0.97 for a, b in zip(amounts, amounts[1:])) and all(2 <= (b.ts - a.ts).total_seconds() / 3600 <= 30 for a, b in zip(chain[0::2], chain[2::2]))
    with pytest.raises(Exception, match="two accounts"):
        world.layering(spark.createDataFrame([("c", ["A1"])], "chain_id string, account_ids array<string>")).collect()
    txns = world.post(world.life_events(people, 20))
    assert txns.count() == txns.select("txn_id").distinct().count()
    big = world.population(spark, 4000).groupBy("segment").count().collect()
    assert all(abs(r["count"] / 4000 - dict(world.SHARES)[r.segment]) < 0.03 for r in big)


def test_running_sums_by_ranges(spark):
    rows = spark.createDataFrame([(i * 0.5, i) for i in range(200)], "score double, n long").repartition(5)
    got = {r.score: r.upto for r in ranges.sums_down(rows, "score", {"upto": "n"}).collect()}
    assert got == {i * 0.5: sum(range(i, 200)) for i in range(200)}
    assert ranges.sums_down(rows.limit(0), "score", {"upto": "n"}).count() == 0


def test_knobs_move_to_their_bounds_and_rest(spark, monkeypatch):
    knob = redteam.Knob("n", 5, 1, -1)
    assert [knob.moved(5), knob.moved(1.5), redteam.Knob("x", 0, 2, 5).moved(1)] == [4, 1, 2] and redteam.around("gap_days", 1.0) == (0.1, 4.5)
    seen = iter([{"structuring"}, set()])
    monkeypatch.setattr(redteam, "flagged", lambda txns, caught=seen: txns.filter(F.col("narration").contains("CASH") & F.col("counterparty_name").eqNullSafe("SELF")).select(F.col("account_id").alias("id")) if next(caught) else txns.limit(0).select(F.col("account_id").alias("id")))
    rows = {(r.generation, r.typology): r for r in redteam.decay(spark.range(60), generations=2, schemes=2, days=4).collect()}
    assert rows[0, "structuring"].recall == 1 and rows[1, "structuring"].knobs == {"deposit_ceiling": 95_500.0} and rows[1, "structuring"].recall == 0
    assert rows[0, "shell"].recall == 0 and rows[1, "shell"].knobs == rows[0, "shell"].knobs
    after = {r.typology: (r.converged_at, r.mean_recall) for r in redteam.after_convergence(spark.createDataFrame([(0, "a", 1.0), (1, "a", 0.0), (2, "a", 0.5), (0, "b", 1.0)], "generation int, typology string, recall double")).collect()}
    assert after == {"a": (1, 0.5), "b": (None, None)}


def test_paths_longer_than_a_cut(spark):
    hour = timedelta(hours=1)
    edges = [(k, k + 1, 1000.0, T0 + k * hour, k) for k in range(11)] + [(5, 40, 990.0, T0 + 6 * hour, 50), (30, 31, 10.0, T0, 60)]
    found = graph.all_paths(spark.createDataFrame(edges, "src long, dst long, amount double, ts timestamp_ntz, txn_id long"), min_amount=100).collect()
    assert sorted(r.hops for r in found if r.txns[0] == 0) == [6, 11] and all(r.amounts[0] >= 100 for r in found)


@pytest.mark.parametrize("threshold", [0.88, 0.6])
def test_screening_loses_no_pair(spark, threshold):
    names = ["Farhan Ali", "F. Ali", "ali farhan", "Meera Nair", "Mira Nayar", "Phillip Smith", "Filip Smyth", "Jo", "", "  ", "Ana Maria de la Cruz", "Anna Cruz", "Zed", "Ravi Kumar", "Ravee Kumaar", "Étienne Roux"]
    others = ["Farhaan Ali", "Philip Smith", "Ana Cruz", "Meera Nayar", "Ravi Kumar", "Etienne Rous", "J", "Zeta Zed"]
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    got = {(r.name, r.other): r.score for r in screening.scored_pairs(df(names), df(others), threshold).collect()}
    assert got == {(a, b): similarity(a, b) for a in names for b in others if similarity(a, b) >= threshold}
