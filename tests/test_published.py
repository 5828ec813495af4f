"""Logs, bucket updates and recorded calls: whole versions, concurrent writers, torn writes."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tracewell.operators import cases
from tracewell.sources import published
from tracewell.sources.published import CALLS, Buckets, Log, Versions, recorded


def events(spark, start, n):
    kinds = ("opened", "assigned", "note", "closed", "reopened")
    rows = [(i, i % 4, datetime(2024, 1, 1, i // 4 % 24, i % 4), "x", kinds[i // 4 % 5], "false_positive: seen" if i // 4 % 5 == 3 else "analyst") for i in range(start, start + n)]
    return spark.createDataFrame(rows, cases.EVENTS)


def test_state_is_the_same_before_and_after_compaction(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), cases.EVENTS)
    assert log.read().count() == 0 and cases.state(log.read()).count() == 0
    for start in (0, 9, 18):
        log.append(events(spark, start, 9))
    before = sorted(map(tuple, cases.state(log.read()).collect()), key=str)
    log.compact()
    assert sorted(map(tuple, cases.state(log.read()).collect()), key=str) == before
    assert log.versions.latest()[1]["parts"] == []
    log.append(events(spark, 27, 9))
    whole = spark.createDataFrame([], cases.EVENTS).unionByName(events(spark, 0, 36))
    assert sorted(map(tuple, cases.state(log.read()).collect()), key=str) == sorted(map(tuple, cases.state(whole).collect()), key=str)
    log.compact(lambda rows: rows.filter("event_type <> 'note'"))
    assert log.read().filter("event_type = 'note'").count() == 0 and log.read().count() == whole.filter("event_type <> 'note'").count()


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    logs = [Log(spark, path, cases.EVENTS) for _ in range(4)]

    def write(k):
        for j in range(3):
            logs[k].append(events(spark, 100 * k + 5 * j, 5))
        logs[k].compact()

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    found = [r.event_id for r in logs[0].read().collect()]
    assert sorted(found) == sorted(100 * k + i for k in range(4) for i in range(15))


def test_a_version_is_published_once(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() == (0, {})
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: versions.publish(1, {"by": k}), range(8)))
    assert won.count(True) == 1 and versions.latest() == (1, {"by": won.index(True)})
    assert versions.change(lambda now: now | {"more": 1}) == {"by": won.index(True), "more": 1}
    with pytest.raises(published.Conflict):
        versions.publish = lambda number, content: False
        versions.change(lambda now: now, tries=2)


def test_rows_that_no_version_names_are_not_read(spark, tmp_path):
    log = Log(spark, str(tmp_path / "log"), cases.EVENTS)
    log.append(events(spark, 0, 3))
    log._write(events(spark, 50, 5))  # a writer that was lost before it published
    assert log.read().count() == 3


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_updates_rewrite_touched_buckets_only(spark, tmp_path):
    rows = spark.range(1000).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") % 7).alias("kind"))
    table = Buckets(spark, str(tmp_path / "t"), "id", rows.schema, buckets=16)
    table.load(rows)
    before, named = files(tmp_path), table.versions.latest()[1]["buckets"]
    updates = spark.createDataFrame([(3, "new"), (4, None), (99_999, "nobody")], "id long, name string")
    n = table.update("name", updates)
    after = table.versions.latest()[1]["buckets"]
    assert 1 <= n <= 3 and sum(after[b] != named[b] for b in named) == n and set(after) == set(named)
    assert {p: t for p, t in files(tmp_path).items() if p in before} == before
    got = {r.id: (r.name, r.kind) for r in table.read().collect()}
    assert got == {i: ({3: "new", 4: None}.get(i, f"n{i}"), i % 7) for i in range(1000)}
    assert table.update("name", updates.limit(0)) == 0
    assert Buckets(spark, str(tmp_path / "none"), "id", rows.schema).read().count() == 0


def test_updates_at_once_are_both_kept(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    Buckets(spark, str(tmp_path / "t"), "id", rows.schema, buckets=3).load(rows)

    def update(column):
        for k in range(1, 3):
            Buckets(spark, str(tmp_path / "t"), "id", rows.schema, buckets=3).update(column, spark.range(200).select("id", F.lit(k).cast("long").alias(column)))

    with ThreadPoolExecutor(2) as pool:
        list(pool.map(update, ("a", "b")))
    assert {tuple(r) for r in Buckets(spark, str(tmp_path / "t"), "id", rows.schema, 3).read().select("a", "b").distinct().collect()} == {(2, 2)}


def test_calls_are_recorded_with_their_outcome(spark, tmp_path):
    log = Log(spark, str(tmp_path / "calls"), CALLS)
    at = datetime(2024, 3, 1)
    tool = recorded(log, "evens", lambda below, step=2: spark.range(0, below, step), clock=lambda: at)
    assert tool(below=10).count() == 5
    assert tool(step=3, below=10).count() == 4
    with pytest.raises(TypeError):
        tool(unknown=1)
    with pytest.raises(TypeError):
        tool(10)
    bad = recorded(log, "bad", lambda: spark.range(3).select("nothing"), clock=lambda: at)
    with pytest.raises(Exception, match="nothing"):
        bad()
    assert sorted(map(tuple, log.read().collect()), key=str) == sorted([
        (at, "evens", '{"below":10}', "ok", 5), (at, "evens", '{"below":10,"step":3}', "ok", 4), (at, "evens", '{"unknown":1}', "error: TypeError", None),
        (at, "bad", "{}", "error: query failed", None),
    ], key=str)


def test_a_ledger_is_opened_by_path_or_environment(spark, tmp_path, sf_dir, monkeypatch):
    from tracewell.sources import ledger

    bank = ledger.from_driver(spark, sf_dir)
    ledger.append(bank.transactions, str(tmp_path), "transactions")
    opened = ledger.open_ledger(spark, str(tmp_path))
    assert opened.transactions.count() == bank.transactions.count() and opened.accounts.count() == 0
    monkeypatch.delenv(ledger.FOLDER, raising=False)
    with pytest.raises(ValueError):
        ledger.open_ledger(spark)
    monkeypatch.setenv(ledger.FOLDER, str(tmp_path))
    assert ledger.open_ledger(spark).transactions.schema == opened.transactions.schema


def test_a_casebook_allows_a_step_once(spark, tmp_path):
    at = datetime(2024, 5, 1)
    book = cases.Casebook(Log(spark, str(tmp_path / "book"), cases.EVENTS))
    one, two = book.open_case("A1", "x", at), book.open_case("A2", "x", at)
    assert (one, two) == (1, 2)
    book.assign(one, "ann", "x", at)
    book.log.compact()
    for bad in (lambda: book.reopen(one, "why", "x", at), lambda: book.close(one, "unknown", "r", "x", at), lambda: book.close(one, "escalated", " ", "x", at),
                lambda: book.note(9, "no case", "x", at), lambda: book.note(one, " ", "x", at)):
        with pytest.raises(cases.LifecycleError):
            bad()

    def shut(k):
        try:
            cases.Casebook(Log(spark, str(tmp_path / "book"), cases.EVENTS)).close(one, "escalated", f"by {k}", str(k), at)
            return True
        except cases.LifecycleError:
            return False

    with ThreadPoolExecutor(3) as pool:
        assert list(pool.map(shut, range(3))).count(True) == 1
    got = {r.case_id: (r.status, r.disposition, r.assigned_to) for r in book.states().collect()}
    assert got == {1: ("closed", "escalated", "ann"), 2: ("open", None, None)}
    book.reopen(one, "more came in", "x", at)
    assert {r.case_id: r.status for r in book.states().collect()} == {1: "in_review", 2: "open"}
    ids = [r.event_id for r in book.log.read().collect()]
    assert sorted(ids) == list(range(1, 6))
