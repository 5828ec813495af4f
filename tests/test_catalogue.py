"""Registered queries against their SQL, the truth boundary, and streams."""

import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SAMPLE = (
    "run_all_rules", "running_balance", "account_features", "paired_transfers", "chains_maximal", "jaro_winkler_pairs", "normalise_names", "risk_scores", "case_state_fold",
    "precision_recall", "roc_auc", "moved_before_alert", "first_fired_chain", "cross_bank_edges", "same_bank_runs", "sequence_last_32", "screen_watchlist", "media_matches", "chain_outcomes",
    "stratified_split", "posted_world", "inject_layering", "inject_dormant", "combined_comparison", "audit_log", "reloaded_ledger", "media_experiment", "case_log_state", "bucket_update", "observed_conversion", "screen_name", "true_minimum", "dormancy_burst", "gap_hours", "rapid_credit_ratio", "chain_report", "privacy_notes", "entity_profile", "narrative_rows", "statement_rows",
)


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, tables, sf_dir, name):
    got, sql = entry.queries()[name](spark, sf_dir).toArrow(), entry.oracle_sql()[name]
    tables.register("got", got)
    columns = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    want = tables.execute(f"SELECT {columns} FROM ({sql}) ORDER BY ALL").fetchall()
    assert tables.execute(f"SELECT {columns} FROM got ORDER BY ALL").fetchall() == want and want


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_only_scoring_reads_truth():
    for path in (ROOT / "tracewell" / "operators").glob("*.py"):
        if path.name not in ("scoring.py", "ml.py", "replay.py"):
            assert not re.search(r"labels|truth|scheme_labels", path.read_text()), path.name


def test_streams_equal_batches(spark, sf_dir, tmp_path):
    from tracewell.operators import rules
    from tracewell.sources import ledger
    from tracewell.streaming import monitors

    txns = ledger.from_driver(spark, sf_dir).transactions.select("account_id", "ts", "direction", "channel", "amount", "counterparty_name")
    txns = txns.withColumn("ts", txns["ts"].cast("timestamp"))
    txns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(txns.schema).parquet(str(tmp_path / "in"))

    def run(df, name):
        df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name)

    assert run(monitors.geography(stream, ("CP1", "CP9")), "geo").count() == rules.high_risk_geography(txns, ("CP1", "CP9")).count()
    pairs = run(monitors.pass_through(stream, 100, 48, 0.85), "pass")
    assert {r.account_id for r in pairs.collect()} == {r.account_id for r in rules.rapid_pass_through(txns.withColumn("ts", txns["ts"].cast("timestamp_ntz")), 100, 48, 0.85).collect()}
