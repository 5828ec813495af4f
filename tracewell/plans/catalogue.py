"""Every registered query over the test tables, beside its DuckDB counterpart.

The test tables hold amounts of some hundreds, so queries pass thresholds of that scale. Floats are
rounded, and cast to double or bigint, alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names
from ..operators import cases, features, graph, ml, multibank, redteam, replay, risk, rules, scoring, screening
from ..session import ship
from .ranges import cut, path_exists, shared_folder
from ..sources import ledger, published, world

D1 = {"ceiling": 200, "min_count": 4, "min_total": 100}
D2 = {"min_amount": 100, "hop_hours": 48, "min_ratio": 0.85}
D3 = {"min_amount": 20, "hop_days": 12, "min_return_ratio": 0.95, "channel": "RTGS"}
D4 = {"min_total": 200, "min_concentration": 0.2, "min_count": 3}
D5 = {"min_gap_days": 1, "cashout_hours": 24, "min_cashout_ratio": 0.5, "min_amount": 20}
D6 = ("CP1", "CP9")
CHAIN = {"min_amount": 100.0}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CHANNELS = ", ".join(f"'{c}'" for c in ledger.CHANNELS)
_TXN = f"""
WITH RECURSIVE txn AS (
  SELECT event_id AS txn_id, ts, concat('A', user_id) AS account_id, user_id,
         CASE WHEN event_type IN ('purchase', 'error') THEN 'DR' ELSE 'CR' END AS direction,
         ([{_CHANNELS}])[1 + k % 10] AS channel, CAST(value AS DECIMAL(15,2)) AS amount, concat('CP', k % 12) AS cp,
         CAST(1000 + sum(CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END * CAST(value AS DECIMAL(15,2)))
              OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(15,2)) AS balance, k, value
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events WHERE value > 0)),
edges AS (
  SELECT user_id AS src, (7 * user_id + 13 * k + 1) % ((SELECT max(user_id) FROM txn) + 1) AS dst, CAST(value AS DOUBLE) AS amount, ts, txn_id
  FROM txn WHERE user_id <> (7 * user_id + 13 * k + 1) % ((SELECT max(user_id) FROM txn) + 1)),
truth AS (SELECT DISTINCT account_id AS id, concat('S', k % 7) AS scheme_id, concat('T', k % 3) AS typology, CAST(ts AS DATE) AS day, amount FROM txn WHERE k >= 95),
people AS (SELECT account_id, any_value(user_id) AS user_id FROM txn GROUP BY 1)
"""
_MONEY = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))".format


def query(name: str, sql: str | None = None):
    def keep(f):
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = shipped
        if sql is not None:
            # As in rounded(): sums differ in their last bits, so ties are moved off the half.
            ORACLES[name] = _TXN + sql.replace(", 6)", " + 1e-9, 6)")
        return f

    return keep


def txns(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.from_driver(spark, sf, balances=False).transactions


def posted(spark: SparkSession, sf: str) -> DataFrame:
    """Transactions with the balance after each."""
    return ledger.from_driver(spark, sf).transactions


def truth(spark: SparkSession, sf: str) -> DataFrame:
    """Some rows as schemes: ``id``, ``scheme_id``, ``typology``, ``day``, ``amount``."""
    bad = txns(spark, sf).filter("k >= 95")
    return bad.select(
        F.col("account_id").alias("id"), F.concat(F.lit("S"), F.col("k") % 7).alias("scheme_id"), F.concat(F.lit("T"), F.col("k") % 3).alias("typology"), F.to_date("ts").alias("day"), "amount"
    ).distinct()


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, other numbers of any size as bigint, for comparison."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        column = F.col(f"`{f.name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            column = F.round(column.cast("double") + F.lit(1e-9), digits)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            column = column.cast("bigint")
        out.append(column.alias(f.name))
    return df.select(*out)


# --- rules -----------------------------------------------------------------------------------

_RULES = {
    "structuring_burst": f"""
SELECT account_id, 'structuring_burst' AS rule, concat(count(*), ' deposits of cash, each below Rs 200, add up to Rs ', {_MONEY("sum(amount)::DOUBLE")}) AS reason,
       max(ts) AS ts, sum(amount)::DOUBLE AS amount
FROM txn WHERE direction = 'CR' AND channel = 'CASH' AND amount < 200 GROUP BY account_id HAVING count(*) >= 4 AND sum(amount) >= 100""",
    "rapid_pass_through": f"""
SELECT account_id, 'rapid_pass_through' AS rule, concat('Rs ', {_MONEY("amount")}, ' credited, then largely debited inside 48 hours') AS reason, ts, amount
FROM (SELECT a.account_id, min(a.ts) AS ts, min(a.amount)::DOUBLE AS amount FROM txn a JOIN txn b ON a.account_id = b.account_id AND a.direction = 'CR' AND b.direction = 'DR'
  AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 48 HOUR AND b.amount >= a.amount * 0.85::DOUBLE WHERE a.amount >= 100 GROUP BY 1)""",
    "round_trip": f"""
SELECT account_id, 'round_trip' AS rule, concat('Rs ', {_MONEY("amount")}, ' sent out returned inside 12 days') AS reason, ts, amount
FROM (SELECT a.account_id, min(a.ts) AS ts, min(a.amount)::DOUBLE AS amount FROM txn a JOIN txn b ON a.account_id = b.account_id AND a.direction = 'DR' AND b.direction = 'CR'
  AND a.channel = 'RTGS' AND b.channel = 'RTGS' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 DAY AND b.amount >= a.amount * 0.95::DOUBLE WHERE a.amount >= 20 GROUP BY 1)""",
    "counterparty_concentration": f"""
SELECT account_id, 'counterparty_concentration' AS rule,
       concat(CAST(round_even(part / whole * 100, 0) AS BIGINT), '% of money in is from ', cp, ': Rs ', {_MONEY("part")}) AS reason, ts, part AS amount
FROM (SELECT account_id, cp, sum(amount)::DOUBLE AS part, count(*) AS n, max(ts) AS ts FROM txn WHERE direction = 'CR' GROUP BY 1, 2)
JOIN (SELECT account_id, sum(amount)::DOUBLE AS whole FROM txn WHERE direction = 'CR' GROUP BY 1) USING (account_id)
WHERE part >= 200 AND n >= 3 AND part / whole >= 0.2::DOUBLE""",
    "dormancy_burst": f"""
SELECT account_id, 'dormancy_burst' AS rule, concat('Rs ', {_MONEY("amount")}, ' came after silence; 50% or more went out inside 24 hours') AS reason, ts, amount
FROM (SELECT a.account_id, a.ts, a.amount::DOUBLE AS amount
  FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY account_id ORDER BY ts, txn_id) AS gap FROM txn) a JOIN txn b
    ON a.account_id = b.account_id AND b.direction = 'DR' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR
  WHERE a.direction = 'CR' AND a.gap >= INTERVAL 1 DAY AND a.amount >= 20 GROUP BY a.account_id, a.ts, a.amount HAVING sum(b.amount) >= a.amount * 0.5::DOUBLE)""",
    "high_risk_geography": """
SELECT account_id, 'high_risk_geography' AS rule, concat('international payment naming ', CASE WHEN contains(cp, 'CP1') THEN 'Cp1' ELSE 'Cp9' END) AS reason, ts, amount::DOUBLE AS amount
FROM txn WHERE channel = 'INT' AND (contains(cp, 'CP1') OR contains(cp, 'CP9'))""",
}
_SCENARIO = {
    "structuring_burst": lambda t: rules.structuring_burst(t, **D1),
    "rapid_pass_through": lambda t: rules.rapid_pass_through(t, **D2),
    "round_trip": lambda t: rules.round_trip(t, **D3),
    "counterparty_concentration": lambda t: rules.counterparty_concentration(t, **D4),
    "dormancy_burst": lambda t: rules.dormancy_burst(t, **D5),
    "high_risk_geography": lambda t: rules.high_risk_geography(t, D6),
}
for _name, _sql in _RULES.items():
    query(_name, _sql)(lambda spark, sf, rule=_SCENARIO[_name]: rule(txns(spark, sf)))

_ALL = " UNION ALL ".join(f"SELECT * FROM ({s})" for s in _RULES.values())


def alerts(spark, sf) -> DataFrame:
    return rules.run_all(txns(spark, sf), list(_SCENARIO.values()))


query("run_all_rules", _ALL)(alerts)


@query("rule_hit_counts", f"SELECT rule, count(*) AS n, count(DISTINCT account_id) AS accounts FROM ({_ALL}) GROUP BY rule")
def rule_hit_counts(spark, sf):
    return rounded(alerts(spark, sf).groupBy("rule").agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("accounts")))


# --- ledger ----------------------------------------------------------------------------------

_FIRST = """(SELECT account_id, arg_min(CASE WHEN direction = 'CR' THEN balance - amount ELSE balance + amount END, (ts, txn_id)) AS opening, min(balance) AS low FROM txn GROUP BY 1)"""


@query("table_counts", "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) FROM customer")
def table_counts(spark, sf):
    return ledger.table_counts({t: spark.read.parquet(f"{sf}/{t}.parquet") for t in ("events", "orders", "customer")})


@query("opening_balance", f"SELECT account_id, opening::DOUBLE AS opening FROM {_FIRST}")
def opening_balance(spark, sf):
    return rounded(ledger.opening_balances(posted(spark, sf)))


@query("running_balance", "SELECT txn_id, account_id, balance::DOUBLE AS replayed, balance::DOUBLE AS balance_after FROM txn")
def running_balance(spark, sf):
    return rounded(ledger.running_balances(posted(spark, sf)).select("txn_id", "account_id", "replayed", "balance_after"))


@query("true_minimum", f"SELECT account_id, least(opening, low)::DOUBLE AS minimum FROM {_FIRST}")
def true_minimum(spark, sf):
    return rounded(ledger.true_minimum(posted(spark, sf)))


@query("safe_debit_ceiling", f"SELECT account_id, round(greatest(least(opening, low)::DOUBLE * 0.6, 0), 6) AS ceiling FROM {_FIRST}")
def safe_debit_ceiling(spark, sf):
    return rounded(ledger.safe_debit_ceiling(posted(spark, sf)))


@query("statement_rows", """SELECT row_number() OVER (ORDER BY ts, txn_id) AS line, ts, concat_ws('/', channel, direction, txn_id, cp) AS narration,
  CASE WHEN direction = 'DR' THEN amount::DOUBLE END AS debit, CASE WHEN direction = 'CR' THEN amount::DOUBLE END AS credit, balance::DOUBLE AS balance_after FROM txn WHERE account_id = 'A3'""")
def statement_rows(spark, sf):
    return rounded(ledger.statement(posted(spark, sf), "A3"))


@query("account_summary", """SELECT account_id, count(*) AS n, coalesce(sum(amount) FILTER (direction = 'CR'), 0)::DOUBLE AS total_in,
  coalesce(sum(amount) FILTER (direction = 'DR'), 0)::DOUBLE AS total_out, min(ts) AS first_ts, max(ts) AS last_ts FROM txn GROUP BY 1""")
def account_summary(spark, sf):
    return rounded(cases.account_summary(txns(spark, sf)))


@query("channel_mix", "SELECT account_id, channel, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn GROUP BY 1, 2")
def channel_mix(spark, sf):
    return rounded(cases.channel_mix(txns(spark, sf)))


@query("last_n_transactions", "SELECT account_id, txn_id, amount::DOUBLE AS amount FROM txn QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, txn_id DESC) <= 5")
def last_n(spark, sf):
    by = Window.partitionBy("account_id").orderBy(F.desc("ts"), F.desc("txn_id"))
    return rounded(txns(spark, sf).withColumn("back", F.row_number().over(by)).filter("back <= 5").select("account_id", "txn_id", "amount"))


@query("top_value_annex", "SELECT account_id, txn_id, amount::DOUBLE AS amount, row_number() OVER (PARTITION BY account_id ORDER BY amount DESC, ts, txn_id) AS place FROM txn QUALIFY place <= 10")
def top_value(spark, sf):
    return rounded(cases.top_values(txns(spark, sf)).select("account_id", "txn_id", "amount", "place"))


@query("bulk_update_rewrite", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bulk_update(spark, sf):
    table = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    new = table.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("UPDATED").alias("c_mktsegment"))
    return ledger.bulk_update(table, "c_custkey", "c_mktsegment", new)


@query("bucket_update", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'UPDATED' WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def bucket_update(spark, sf):
    """The same kind of update on files: only the buckets of changed keys are rewritten, and published at once."""
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment")
    table = published.Buckets(spark, shared_folder(spark), "c_custkey", rows.schema)
    table.load(rows)
    table.update("c_mktsegment", rows.filter("c_custkey % 10 < 2").select("c_custkey", F.when(F.col("c_custkey") % 10 == 0, "UPDATED").alias("c_mktsegment")))
    return table.read()


@query("constraint_violations", "SELECT 'transactions' AS table_name, 'balance not negative' AS violated, count(*) AS n FROM txn WHERE balance < 0 HAVING count(*) > 0")
def constraint_violations(spark, sf):
    return rounded(ledger.violations(ledger.from_driver(spark, sf)))


# --- features --------------------------------------------------------------------------------

_GAPS = "(SELECT account_id, (epoch_ms(date_trunc('second', ts)) - epoch_ms(date_trunc('second', lag(ts) OVER (PARTITION BY account_id ORDER BY ts, txn_id)))) / 1000 / 3600.0::DOUBLE AS gap FROM txn)"
_RAPID = """(SELECT account_id, count(*) AS rapid_credits, sum(amount)::DOUBLE AS rapid_amount FROM txn a WHERE direction = 'CR' AND EXISTS (SELECT 1 FROM txn b
  WHERE b.account_id = a.account_id AND b.direction = 'DR' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR AND b.amount::DOUBLE >= a.amount::DOUBLE * 0.7::DOUBLE) GROUP BY 1)"""
_SHARES = "(SELECT account_id, -sum(p * ln(p)) AS entropy, max(p) AS top FROM (SELECT account_id, cp, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY account_id) AS p FROM txn GROUP BY 1, 2) GROUP BY 1)"
_FEATURES = f"""SELECT a.account_id,
  n::DOUBLE AS txn_count, i AS total_in, o AS total_out, round(i - o, 6) AS net_flow, round(mean, 6) AS mean_amount, round(med, 6) AS median_amount, mx AS max_amount, round(sd, 6) AS std_amount,
  coalesce(round(sd / nullif(mean, 0), 6), 0) AS amount_cv, cps::DOUBLE AS distinct_counterparties, round(cps::DOUBLE / n, 6) AS counterparty_ratio, round(entropy, 6) AS counterparty_entropy,
  round(top, 6) AS top_counterparty_share, round(cr::DOUBLE / n, 6) AS credit_ratio, days::DOUBLE AS active_days, round(n::DOUBLE / days, 6) AS txns_per_active_day,
  coalesce(round(gmax, 6), 0) AS max_gap_hours, coalesce(round(gmean, 6), 0) AS mean_gap_hours, bmin AS balance_min, bmax AS balance_max, round(bmean, 6) AS balance_mean, round(bsd, 6) AS balance_std,
  round(rnd::DOUBLE / n, 6) AS round_amount_ratio, round(sub::DOUBLE / n, 6) AS sub_threshold_ratio, round(cash::DOUBLE / n, 6) AS pct_cash, round(upi::DOUBLE / n, 6) AS pct_upi,
  round(wire::DOUBLE / n, 6) AS pct_wire, round(atm::DOUBLE / n, 6) AS pct_atm, round(intl::DOUBLE / n, 6) AS pct_international,
  coalesce(round(rapid_credits::DOUBLE / n, 6), 0) AS rapid_credit_ratio, coalesce(round(rapid_amount / nullif(i, 0), 6), 0) AS rapid_amount_ratio
FROM (SELECT account_id, count(*) AS n, coalesce(sum(amount) FILTER (direction = 'CR'), 0)::DOUBLE AS i, coalesce(sum(amount) FILTER (direction = 'DR'), 0)::DOUBLE AS o,
    avg(amount::DOUBLE) AS mean, median(amount::DOUBLE) AS med, max(amount)::DOUBLE AS mx, stddev_pop(amount::DOUBLE) AS sd, count(DISTINCT cp) AS cps, count(*) FILTER (direction = 'CR') AS cr,
    count(DISTINCT ts::DATE) AS days, min(balance)::DOUBLE AS bmin, max(balance)::DOUBLE AS bmax, avg(balance::DOUBLE) AS bmean, stddev_pop(balance::DOUBLE) AS bsd,
    count(*) FILTER (amount::DOUBLE = round(amount::DOUBLE, -3)) AS rnd, count(*) FILTER (amount BETWEEN 70000 AND 100000) AS sub, count(*) FILTER (channel = 'CASH') AS cash,
    count(*) FILTER (channel = 'UPI') AS upi, count(*) FILTER (channel IN ('NEFT', 'IMPS', 'RTGS')) AS wire, count(*) FILTER (channel = 'ATM') AS atm, count(*) FILTER (channel = 'INT') AS intl
  FROM txn GROUP BY 1) a LEFT JOIN {_SHARES} s USING (account_id) LEFT JOIN (SELECT account_id, max(gap) AS gmax, avg(gap) AS gmean FROM {_GAPS} WHERE gap IS NOT NULL GROUP BY 1) g USING (account_id)
LEFT JOIN {_RAPID} r USING (account_id)"""


@query("account_features", _FEATURES)
def account_features(spark, sf):
    return rounded(features.account_features(posted(spark, sf)))


@query("counterparty_entropy", f"SELECT account_id, round(entropy, 6) AS counterparty_entropy, round(top, 6) AS top_counterparty_share FROM {_SHARES}")
def counterparty_entropy(spark, sf):
    return rounded(features.counterparty_shares(txns(spark, sf)).drop("distinct_counterparties"))


@query("gap_hours", f"SELECT account_id, round(max(gap), 6) AS max_gap_hours, round(avg(gap), 6) AS mean_gap_hours FROM {_GAPS} WHERE gap IS NOT NULL GROUP BY 1")
def gap_hours(spark, sf):
    return rounded(features.gap_hours(txns(spark, sf)))


@query("rapid_credit_ratio", f"SELECT account_id, rapid_credits, round(rapid_amount, 6) AS rapid_amount FROM {_RAPID}")
def rapid_credit_ratio(spark, sf):
    return rounded(features.rapid_credits(txns(spark, sf)))


@query("sequence_last_32", """SELECT account_id, count(*) AS kept, round(sum(CASE WHEN direction = 'CR' THEN amount ELSE -amount END)::DOUBLE, 6) AS net
FROM (SELECT * FROM txn QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY ts DESC, txn_id DESC) <= 32) GROUP BY 1""")
def sequence_last_32(spark, sf):
    s = features.sequences(posted(spark, sf))
    net = F.aggregate("steps", F.lit(0.0), lambda a, x: a + x.amount * x.sign)
    return rounded(s.select("account_id", F.size("steps").alias("kept"), net.alias("net")))


# --- graph -----------------------------------------------------------------------------------

_PATHS = """, paths AS (
  SELECT [src, dst] AS accounts, [amount] AS amounts, [txn_id] AS txns, ts AS started, ts AS ended FROM edges WHERE amount >= 100
  UNION ALL
  SELECT list_append(p.accounts, e.dst), list_append(p.amounts, e.amount), list_append(p.txns, e.txn_id), p.started, e.ts FROM paths p JOIN edges e
    ON e.src = p.accounts[-1] AND e.ts > p.ended AND e.ts <= p.ended + INTERVAL 36 HOUR AND e.amount / p.amounts[-1] BETWEEN 0.8::DOUBLE AND 1.0::DOUBLE AND NOT list_contains(p.accounts, e.dst)),
maximal AS (SELECT * FROM paths WHERE len(txns) >= 2 AND txns NOT IN (SELECT txns[1:-2] FROM paths WHERE len(txns) > 1)),
one AS (SELECT * FROM maximal QUALIFY row_number() OVER (PARTITION BY accounts ORDER BY started, txns) = 1),
chains AS (SELECT * FROM one a WHERE NOT EXISTS (SELECT 1 FROM one b WHERE len(b.accounts) > len(a.accounts) AND contains(concat(',', array_to_string(b.accounts, ','), ','), concat(',', array_to_string(a.accounts, ','), ','))))
"""


def chains(spark, sf) -> DataFrame:
    return graph.find_chains(ledger.edges(spark, sf), **CHAIN)


def _listed(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ",")


@query("paired_transfers", "SELECT src, dst, round(amount, 6) AS amount, ts, 2 * txn_id AS dr_txn, 2 * txn_id + 1 AS cr_txn FROM edges")
def paired_transfers(spark, sf):
    return rounded(graph.paired_transfers(ledger.legs(spark, sf)))


@query("edge_degree", "SELECT account, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS account, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY 1")
def edge_degree(spark, sf):
    return rounded(graph.degrees(ledger.edges(spark, sf)))


@query("chain_frontier_sizes", _PATHS + "SELECT len(txns) AS hops, count(*) AS n FROM maximal GROUP BY 1")
def chain_frontier_sizes(spark, sf):
    return rounded(graph.all_paths(ledger.edges(spark, sf), **CHAIN).filter("hops >= 2").groupBy("hops").agg(F.count("*").alias("n")))


@query("chains_maximal", _PATHS + "SELECT array_to_string(accounts, ',') AS accounts, array_to_string(txns, ',') AS txns, started, ended, len(txns) AS hops FROM chains")
def chains_maximal(spark, sf):
    return rounded(chains(spark, sf).select(_listed("accounts").alias("accounts"), _listed("txns").alias("txns"), "started", "ended", "hops"))


@query("chain_accounts", _PATHS + "SELECT account, count(*) AS n FROM (SELECT unnest(accounts) AS account FROM chains) GROUP BY 1")
def chain_accounts(spark, sf):
    return rounded(chains(spark, sf).select(F.explode("accounts").alias("account")).groupBy("account").agg(F.count("*").alias("n")))


@query("chain_retained", _PATHS + "SELECT array_to_string(accounts, ',') AS accounts, round(amounts[-1] / amounts[1], 6) AS retained FROM chains")
def chain_retained(spark, sf):
    return rounded(chains(spark, sf).select(_listed("accounts").alias("accounts"), "retained"))


@query("neighbour_mean", """, b AS (SELECT src AS account, dst AS other FROM edges UNION SELECT dst, src FROM edges)
SELECT account, round(avg(v), 6) AS mean_value FROM b JOIN (SELECT user_id AS other, sum(amount)::DOUBLE AS v FROM txn GROUP BY 1) USING (other) GROUP BY 1""")
def neighbour_mean(spark, sf):
    values = txns(spark, sf).groupBy(F.substring("account_id", 2, 20).cast("long").alias("account")).agg(F.sum("amount").cast("double").alias("value"))
    return rounded(graph.neighbour_mean(ledger.edges(spark, sf), values))


# --- screening -------------------------------------------------------------------------------

def nations(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/nation.parquet")


def _num(*parts: str) -> str:
    """SQL of world.number."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 13) AS BIGINT)"


def _uni(*parts: str) -> str:
    return f"({_num(*parts)} / 4503599627370496.0::DOUBLE)"


def _pick(options, *parts: str) -> str:
    listed = ", ".join(f"'{x}'" for x in options)
    return f"([{listed}])[1 + CAST(floor({_uni(*parts)} * {len(options)}) AS INTEGER)]"


def _moment(day: str, *parts: str) -> str:
    return f"(TIMESTAMP '{world.START}' + to_days(CAST({day} AS INTEGER)) + to_seconds(floor({_uni(*parts)} * 86399)))"


def _segment(u: str) -> str:
    out, upto = "CASE", 0.0
    for name, share in world.SHARES:
        upto += share
        out += f" WHEN {u} < {round(upto, 4)}::DOUBLE THEN '{name}'"
    return f"{out} ELSE '{world.SHARES[-1][0]}' END"


def _folk(ids: str) -> str:
    """SQL of world.people over rows of ``id``."""
    first, last = _pick(world.FIRST, "id", "42", "'first'"), _pick(world.LAST, "id", "42", "'last'")
    return f"""(SELECT id, format('C{{:08d}}', id) AS customer_id, format('A{{:08d}}', id) AS account_id, {_segment(_uni("id", "42", "'segment'"))} AS segment,
  concat_ws(' ', {first}, {last}) AS full_name, {_pick(world.CITIES, "id", "42", "'city'")} AS city FROM {ids})"""


_FOLK = ", folk AS " + _folk("(SELECT c_custkey::BIGINT AS id FROM customer)")
#: Listed persons, invented, with words of the customers' names among them.
LISTED = (
    ("Aditi Allie", "sanctions"), ("Vihaan Gupte", "pep"), ("Meera Nayar", "pep"), ("Arjun Khaan", "sanctions"), ("Kabeer Sharma", "sanctions"), ("Priya Josh", "pep"), ("Ananya Kulkarnee", "pep"),
    ("Neha Boss", "sanctions"), ("Rohan Mehta", "pep"), ("Sana Reddi", "sanctions"), ("Diya Dass", "pep"), ("Tomasz Zielny", "sanctions"), ("Kavya Patel", "sanctions"), ("Aarav Verma", "pep"), ("Ishan Iyer", "pep"),
)
_LISTED = ", listed(position, name, type) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{n}', '{t}')" for i, (n, t) in enumerate(LISTED)) + ")"


def _spelt(word: str) -> str:
    import re

    for written, other in world.SPELLINGS:
        word = re.sub(written, other, word)
    return word


_CODES = ", codes(word, code) AS (VALUES " + ", ".join(
    f"('{w}', '{names.metaphone(w)}')"
    for w in sorted({x.lower() for t in (*world.FIRST, *world.LAST, "Zeb", *(p for n, _ in LISTED for p in n.split())) for x in (t, _spelt(t), t[0])} | {x.lower() for n, _ in LISTED for x in _spelt(n).split()})
) + ")"


def _similar(subjects: str, entries: str, least: float = names.THRESHOLD, tag: str = "") -> str:
    """SQL of screening.scored_pairs over rows of ``name``, as ``pairs`` with a tag: both of the names' words, of a-z,
    take their best partners in turn. Sound codes of the words that can occur are listed."""
    return f""", {tag}cells AS (
  SELECT name, other, i, j, CASE WHEN t = o THEN 1.0::DOUBLE WHEN len(t) = 1 OR len(o) = 1 THEN CASE WHEN t[1] = o[1] THEN 0.85::DOUBLE ELSE 0 END
         ELSE greatest(jaro_winkler_similarity(t, o), CASE WHEN x.code = y.code AND x.code <> '' THEN 0.92::DOUBLE ELSE 0 END) END AS s
  FROM (SELECT name, unnest(string_split(lower(name), ' ')) AS t, generate_subscripts(string_split(name, ' '), 1) AS i FROM (SELECT DISTINCT name FROM {subjects}))
  CROSS JOIN (SELECT other, unnest(string_split(lower(other), ' ')) AS o, generate_subscripts(string_split(other, ' '), 1) AS j FROM (SELECT DISTINCT name AS other FROM {entries}))
  LEFT JOIN codes x ON x.word = t LEFT JOIN codes y ON y.word = o),
{tag}first AS (SELECT name, other, max(s) AS m1, arg_max(j, (s, -j)) AS j1 FROM {tag}cells WHERE i = 1 GROUP BY 1, 2),
{tag}pairs AS (SELECT name, other, CASE WHEN lower(name) = lower(other) THEN 1.0::DOUBLE ELSE round((m1 + max(s)) / 2, 4) END AS score
  FROM {tag}cells JOIN {tag}first USING (name, other) WHERE i = 2 AND j <> j1 GROUP BY name, other, m1 HAVING CASE WHEN lower(name) = lower(other) THEN 1.0::DOUBLE ELSE round((m1 + max(s)) / 2, 4) END >= {least})"""


def _people(spark, sf) -> DataFrame:
    """A person for each customer of the table."""
    return world.people(spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id")))


def watchlist(spark) -> DataFrame:
    return spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(LISTED)], "position long, name string, type string")


@query("jaro_winkler_pairs", "SELECT a.p_name AS a, b.p_name AS b, round(jaro_winkler_similarity(a.p_name, b.p_name), 6) AS score FROM (SELECT DISTINCT p_name FROM part) a, (SELECT DISTINCT p_name FROM part) b WHERE a.p_name < b.p_name")
def jaro_winkler_pairs(spark, sf):
    n = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    pairs = n.select(F.col("p_name").alias("a")).join(n.select(F.col("p_name").alias("b")), F.col("a") < F.col("b"))
    return rounded(pairs.withColumn("score", names.jaro_winkler_udf("a", "b")))


@query("normalise_names", "SELECT c_custkey, trim(regexp_replace(lower(strip_accents(concat(c_name, ' É.', c_mktsegment))), '[^a-z]+', ' ', 'g')) AS name FROM customer")
def normalise_names(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet")
    return c.select("c_custkey", names.normalise_udf(F.concat("c_name", F.lit(" É."), "c_mktsegment")).alias("name"))


_KINDS = ", ".join(f"'{k}'" for k in world.MATCH_KINDS)
_VARIANT = "replace(name, ' ', ' ')"
for _written, _other in world.SPELLINGS:
    _VARIANT = f"regexp_replace({_VARIANT}, '{_written}', '{_other}', 'g')"
_PLANTED = _FOLK + _LISTED + _CODES + f""", planted AS (
  SELECT customer_id, name AS list_name, type AS list_type, kind AS match_kind,
         CASE kind WHEN 'exact' THEN name WHEN 'reordered' THEN concat(split_part(name, ' ', 2), ' ', split_part(name, ' ', 1)) WHEN 'initials' THEN concat(name[1], ' ', split_part(name, ' ', 2)) ELSE {_VARIANT} END AS full_name
  FROM (SELECT customer_id, nth, ([{_KINDS}])[1 + nth % {len(world.MATCH_KINDS)}] AS kind FROM (
    SELECT customer_id, row_number() OVER (ORDER BY account_id) - 1 AS nth FROM (
      SELECT * FROM folk WHERE segment IN ('salaried', 'student', 'nri') ORDER BY {_num("account_id", "42")}, account_id LIMIT 12))) JOIN listed ON listed.position = nth % {len(LISTED)})"""
_REPORT = "([" + ", ".join(f"'{c}'" for c, _ in world.REPORTS) + f"])[1 + nth % {len(world.REPORTS)}]"
_ARTICLES = _FOLK + _CODES + f""", articles AS (
  SELECT nth AS article_id, CASE WHEN nth BETWEEN 10 AND 19 THEN concat('Zeb ', split_part(full_name, ' ', 2)) ELSE full_name END AS mentioned_name,
         CASE WHEN nth >= 20 THEN 'none' ELSE {_REPORT} END AS category, CASE WHEN nth < 10 THEN customer_id END AS customer_id,
         concat(CASE WHEN nth BETWEEN 10 AND 19 THEN concat('Zeb ', split_part(full_name, ' ', 2)) ELSE full_name END, ' ', ([{", ".join(f"'{t}'" for _, t in world.REPORTS)}])[1 + nth % {len(world.REPORTS)}]) AS headline
  FROM (SELECT *, row_number() OVER (ORDER BY {_num("account_id", "43")}, account_id) - 1 AS nth FROM folk QUALIFY nth < 40))"""
_MEDIA = _ARTICLES + _similar("(SELECT mentioned_name AS name FROM articles WHERE category <> 'none')", "(SELECT full_name AS name FROM folk)") + """, hits AS (
  SELECT article_id, f.customer_id, category, headline, score FROM articles a JOIN pairs p ON p.name = a.mentioned_name JOIN folk f ON f.full_name = p.other WHERE category <> 'none')"""


@query("token_alignment", _FOLK + _LISTED + _CODES + _similar("(SELECT full_name AS name FROM folk)", "listed", 0.6) + " SELECT name, other, score FROM pairs")
def token_alignment(spark, sf):
    return screening.scored_pairs(_people(spark, sf).select(F.col("full_name").alias("name")), watchlist(spark), 0.6)


@query("screen_watchlist", _FOLK + _LISTED + _CODES + _similar("(SELECT full_name AS name FROM folk)", "listed") + " SELECT customer_id, other AS matched_name, type AS list_type, score, position FROM folk JOIN pairs ON full_name = pairs.name JOIN listed ON listed.name = other")
def screen_watchlist(spark, sf):
    return screening.screen_customers(_people(spark, sf), watchlist(spark))


@query("screen_name", _FOLK + _LISTED + _CODES + _similar("(SELECT full_name AS name FROM folk)", "listed") + """ SELECT f.name, n AS matches, best, NULL::VARCHAR AS geography, CASE WHEN n IS NULL THEN 'NO_HIT' ELSE 'REVIEW' END AS decision
FROM (SELECT DISTINCT full_name AS name FROM folk) f LEFT JOIN (SELECT name, count(*) AS n, max(score) AS best FROM pairs GROUP BY 1) USING (name)""")
def screen_name(spark, sf):
    return rounded(screening.screen_names(_people(spark, sf).select(F.col("full_name").alias("name")).distinct(), watchlist(spark)))


@query("plant_entities", _PLANTED + " SELECT * FROM planted")
def plant_entities(spark, sf):
    return world.plant_entities(_people(spark, sf), watchlist(spark), 12)


@query("media_matches", _MEDIA + " SELECT * FROM hits")
def media_matches(spark, sf):
    people = _people(spark, sf)
    return rounded(screening.screen_media(world.plant_media(people).drop("customer_id"), people))


@query("entity_score", _PLANTED + _similar("(SELECT full_name AS name FROM planted)", "listed") + """ SELECT match_kind, count(*) AS planted, count(met) AS found, round(count(met) / count(*), 6) AS recall
FROM planted LEFT JOIN (SELECT DISTINCT name, 1 AS met FROM pairs) ON name = full_name GROUP BY 1""")
def entity_score(spark, sf):
    planted = world.plant_entities(_people(spark, sf), watchlist(spark), 12)
    return rounded(scoring.entity_score(screening.screen_customers(planted.select("customer_id", "full_name"), watchlist(spark)), planted))


@query("media_score", _MEDIA + """, found AS (SELECT DISTINCT article_id, customer_id FROM hits), good AS (SELECT article_id, customer_id FROM articles WHERE customer_id IS NOT NULL),
n AS (SELECT (SELECT count(*) FROM found) AS flagged, (SELECT count(*) FROM found JOIN good USING (article_id, customer_id)) AS hits, (SELECT count(*) FROM good) AS planted)
SELECT *, round(hits / flagged, 6) AS precision, round(hits / planted, 6) AS recall FROM n""")
def media_score(spark, sf):
    people = _people(spark, sf)
    articles = world.plant_media(people)
    return rounded(scoring.media_score(screening.screen_media(articles.drop("customer_id"), people), articles.select("article_id", "customer_id")))


@query("geo_containment", "SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN contains(n_name, '_1') THEN '_1' WHEN contains(n_name, '_2') THEN '_2' END AS hit FROM nation")
def geo_containment(spark, sf):
    return rounded(nations(spark, sf).select("n_nationkey", rules.first_listed(F.col("n_name"), ("_1", "_2")).alias("hit")))


# --- risk and cases --------------------------------------------------------------------------

_HOLDERS = ", folk AS " + _folk("(SELECT DISTINCT user_id // 2 AS id FROM people)")
_SIGNALS = _PATHS + _HOLDERS + _LISTED + _CODES + _similar("(SELECT full_name AS name FROM folk)", "listed") + f""", fired AS (SELECT account_id, rule, min(reason) AS reason FROM ({_ALL}) GROUP BY 1, 2),
ruled AS (SELECT account_id, 'rules' AS source, concat_ws(': ', rule, reason) AS detail, 1 - pow(0.4, count(*) OVER (PARTITION BY account_id)) AS contribution FROM fired),
chained AS (SELECT concat('A', unnest(accounts)) AS account_id, 'graph' AS source, concat('on a chain of ', len(txns), ' hops; Rs ', {_MONEY("amounts[1]")}, ' go in, ',
  {_MONEY("amounts[-1] / amounts[1] * 100")}, '% come out') AS detail, 1 - pow(0.4, len(txns)) AS contribution FROM chains),
hits AS (SELECT id, concat('listed as ', other, ' (', type, ')') AS detail, score FROM folk JOIN pairs ON full_name = pairs.name JOIN listed ON listed.name = other),
screened AS (SELECT account_id, 'screening' AS source, arg_max(detail, (score, detail)) AS detail, max(score) AS contribution
  FROM hits JOIN (SELECT user_id // 2 AS id, min(account_id) AS account_id FROM people GROUP BY 1) USING (id) GROUP BY 1),
signals AS (SELECT * FROM ruled UNION ALL SELECT * FROM screened UNION ALL SELECT * FROM chained),
strongest AS (SELECT account_id, source, max(contribution) AS contribution FROM signals GROUP BY 1, 2),
"""
_WEIGHT = "CASE source WHEN 'rules' THEN 0.35 WHEN 'screening' THEN 0.30 WHEN 'graph' THEN 0.20 WHEN 'ml' THEN 0.15 ELSE 0 END::DOUBLE"
_SCORES = _SIGNALS + f"scores AS (SELECT account_id, round(sum({_WEIGHT} * contribution) * 100, 2) AS score FROM strongest GROUP BY 1)\n"


def holders(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The ledger's accounts, and its customers with names."""
    accounts = ledger.from_driver(spark, sf).accounts
    ids = accounts.select(F.substring("customer_id", 2, 20).cast("long").alias("id")).distinct()
    return accounts, world.people(ids).withColumn("customer_id", F.concat(F.lit("C"), "id"))


def list_hits(spark, people: DataFrame) -> DataFrame:
    hits = screening.screen_customers(people, watchlist(spark))
    return hits.select("customer_id", F.concat(F.lit("listed as "), "matched_name", F.lit(" ("), "list_type", F.lit(")")).alias("detail"), "score")


def signals(spark, sf) -> DataFrame:
    """Evidence of rules, names and chains."""
    found = chains(spark, sf).withColumn("accounts", F.transform("accounts", lambda x: F.concat(F.lit("A"), x.cast("string"))))
    accounts, people = holders(spark, sf)
    screened = risk.screening_signals(list_hits(spark, people), accounts)
    return risk.rule_signals(alerts(spark, sf)).unionByName(screened).unionByName(risk.graph_signals(found))


_ARTICLE_FOLK = ", about AS " + _folk("(SELECT DISTINCT doc_id AS id FROM documents)")
_EVIDENCE = _SIGNALS.rstrip().rstrip(",") + _ARTICLE_FOLK + """, told AS (
  SELECT DISTINCT d.doc_id AS article_id, full_name AS mentioned_name, concat(full_name, ' in ', coalesce(source, '')) AS headline, CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN coalesce(lang, '') ELSE 'none' END AS category
  FROM documents d JOIN about ON id = doc_id)""" + _similar("(SELECT mentioned_name AS name FROM told WHERE category <> 'none')", "(SELECT full_name AS name FROM folk)", tag="m_") + """,
named AS (SELECT f.id, concat('adverse media (', category, ') at ', format('{:.2f}', score), ': ', headline) AS detail, score FROM told a JOIN m_pairs p ON p.name = a.mentioned_name JOIN folk f ON f.full_name = p.other WHERE category <> 'none'),
media AS (SELECT account_id, arg_max(detail, (score, detail)) AS detail, max(score) AS contribution
  FROM named JOIN (SELECT user_id // 2 AS id, min(account_id) AS account_id FROM people GROUP BY 1) USING (id) GROUP BY 1),
evidence AS (SELECT * FROM signals UNION ALL SELECT account_id, 'media', detail, contribution FROM media),
folded AS (SELECT * FROM signals UNION ALL SELECT account_id, 'screening', detail, contribution FROM media)
"""


def articles(spark, sf) -> DataFrame:
    """Each document as an article about the person of its number; those labelled toxic are adverse."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    adverse = spark.read.parquet(f"{sf}/labels.parquet").filter("toxic = 1").select("doc_id").distinct().withColumn("adverse", F.lit(True))
    about = world.people(docs.select(F.col("doc_id").alias("id")).distinct()).select(F.col("id").alias("doc_id"), F.col("full_name").alias("mentioned_name"))
    empty = lambda c: F.coalesce(c, F.lit(""))
    told = docs.join(about, "doc_id").join(adverse, "doc_id", "left")
    return told.select(
        F.col("doc_id").alias("article_id"), "mentioned_name", F.concat("mentioned_name", F.lit(" in "), empty("source")).alias("headline"),
        F.when(F.col("adverse"), empty("lang")).otherwise("none").alias("category"),
    ).distinct()


def evidence(spark, sf, mode: str) -> DataFrame:
    """Evidence of all layers with that of adverse media, in a source of its own or folded into screening."""
    accounts, people = holders(spark, sf)
    hits = screening.screen_media(articles(spark, sf), people)
    detail = F.concat(F.lit("adverse media ("), "category", F.lit(") at "), F.format_number("score", 2), F.lit(": "), "headline")
    return signals(spark, sf).unionByName(risk.media_signals(hits.select("customer_id", detail.alias("detail"), "score"), accounts, mode))


@query("media_evidence", _EVIDENCE + "SELECT account_id, source, detail, round(contribution, 6) AS contribution FROM evidence WHERE source = 'media'")
def media_evidence(spark, sf):
    return rounded(evidence(spark, sf, "separate").filter("source = 'media'"))


@query("risk_scores_with_media", _EVIDENCE + """, best AS (SELECT account_id, source, max(contribution) AS c FROM evidence GROUP BY 1, 2)
SELECT account_id, round(sum(CASE source WHEN 'rules' THEN 0.35 WHEN 'screening' THEN 0.30 WHEN 'graph' THEN 0.20 WHEN 'media' THEN 0.20 END::DOUBLE / 1.2 * c) * 100, 2) AS score FROM best GROUP BY 1""")
def risk_scores_with_media(spark, sf):
    return risk.aggregate(evidence(spark, sf, "separate"), risk.weights_with_media()).select("account_id", "score")


@query("risk_scores_media_folded", _EVIDENCE + f""", best AS (SELECT account_id, source, max(contribution) AS contribution FROM folded GROUP BY 1, 2)
SELECT account_id, round(sum({_WEIGHT} * contribution) * 100, 2) AS score FROM best GROUP BY 1""")
def risk_scores_media_folded(spark, sf):
    return risk.aggregate(evidence(spark, sf, "folded")).select("account_id", "score")


_ARMS = ", ".join(f"('media weight {w:.2f}', {w}::DOUBLE, false)" for w in scoring.MEDIA_WEIGHTS)


@query("media_experiment", _EVIDENCE + f""", arms(label, weight, folds) AS (VALUES ('no media', 0.0::DOUBLE, false), {_ARMS}, ('folded into screening', 0.0::DOUBLE, true)),
bars AS (SELECT *, CASE WHEN weight = 0 THEN 17.5::DOUBLE ELSE round(least(100 * 0.6::DOUBLE * (0.35::DOUBLE / (1 + weight)), 100 * 0.88::DOUBLE * (0.3::DOUBLE / (1 + weight)), 100 * (1 - 0.4::DOUBLE * 0.4) * (0.2::DOUBLE / (1 + weight))) - 0.1, 2) END AS threshold FROM arms),
used AS (SELECT label, weight, threshold, account_id, source, contribution, detail LIKE 'adverse media%' AS is_media FROM bars, evidence WHERE NOT folds AND (weight > 0 OR source <> 'media')
  UNION ALL SELECT label, weight, threshold, account_id, source, contribution, detail LIKE 'adverse media%' FROM bars, folded WHERE folds),
tops AS (SELECT label, weight, threshold, account_id, source, max(contribution) AS c, bool_or(is_media) AS any_media, bool_and(is_media) AS all_media FROM used GROUP BY ALL),
totals AS (SELECT label, weight, threshold, account_id, bool_or(any_media) AS any_media, bool_and(all_media) AS all_media,
  round(sum(CASE source WHEN 'rules' THEN 0.35 WHEN 'screening' THEN 0.30 WHEN 'graph' THEN 0.20 WHEN 'media' THEN weight END::DOUBLE / (1 + weight) * c) * 100, 2) AS score FROM tops GROUP BY 1, 2, 3, 4),
queue AS (SELECT *, account_id IN (SELECT id FROM truth) AS good FROM totals WHERE score >= threshold QUALIFY row_number() OVER (PARTITION BY label ORDER BY score DESC, account_id) <= 50),
t AS (SELECT count(DISTINCT id) AS n FROM truth)
SELECT b.label, b.weight, b.threshold, count(q.account_id) AS queue, count(*) FILTER (good) AS true_positives, count(*) FILTER (NOT good) AS false_positives, any_value(n) - count(*) FILTER (good) AS false_negatives,
  round(coalesce(count(*) FILTER (good) / nullif(count(q.account_id), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (good) / nullif(any_value(n), 0), 0), 6) AS recall,
  count(*) FILTER (any_media) AS media_cases, count(*) FILTER (all_media) AS media_only_cases
FROM bars b CROSS JOIN t LEFT JOIN queue q ON q.label = b.label GROUP BY 1, 2, 3""")
def media_experiment(spark, sf):
    return rounded(scoring.media_experiment(evidence(spark, sf, "separate"), evidence(spark, sf, "folded"), truth(spark, sf)))


def model_signals(spark, sf) -> DataFrame:
    return risk.ml_signals(risk.unsupervised_scores(ml.isolation_scores(features.account_features(posted(spark, sf)))))


def scores(spark, sf) -> DataFrame:
    return risk.aggregate(signals(spark, sf))


@query("corroboration_strength", "SELECT r_regionkey::BIGINT AS n, round(CASE WHEN r_regionkey = 0 THEN 0 ELSE 1 - pow(0.4, r_regionkey) END, 6) AS strength FROM region")
def corroboration_strength(spark, sf):
    r = spark.read.parquet(f"{sf}/region.parquet")
    return rounded(r.select(F.col("r_regionkey").alias("n"), risk.corroboration(F.col("r_regionkey")).alias("strength")))


@query("signals_union", _SIGNALS.rstrip().rstrip(",") + " SELECT account_id, source, detail, round(contribution, 6) AS contribution FROM signals")
def signals_union(spark, sf):
    return rounded(signals(spark, sf))


@query("risk_scores", _SCORES + "SELECT account_id, score, CASE WHEN score >= 60 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 18 THEN 'medium' ELSE 'low' END AS band FROM scores")
def risk_scores(spark, sf):
    return scores(spark, sf)


@query("risk_scores_with_models")
def risk_scores_with_models(spark, sf):
    return risk.aggregate(signals(spark, sf).unionByName(model_signals(spark, sf)))


@query("risk_bands", _SCORES + "SELECT CASE WHEN score >= 60 THEN 'critical' WHEN score >= 40 THEN 'high' WHEN score >= 18 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM scores GROUP BY 1")
def risk_bands(spark, sf):
    return rounded(scores(spark, sf).groupBy("band").agg(F.count("*").alias("n")))


@query("evidence_tier", _SIGNALS.rstrip().rstrip(",") + " SELECT account_id, CASE WHEN bool_or(source = 'graph') THEN 'graph' WHEN bool_or(source = 'rules') THEN 'rules' WHEN bool_or(source = 'screening') THEN 'screening' ELSE 'ml' END AS tier FROM signals GROUP BY 1")
def evidence_tier(spark, sf):
    return risk.evidence_tier(signals(spark, sf))


@query("min_case_score", _SCORES + """SELECT round(least(100 * 0.6 * 0.35, 100 * 0.88 * 0.30, 100 * (1 - 0.4 * 0.4) * 0.20) - 0.1, 2)::DOUBLE AS threshold,
  round(least(100 * 0.6 * 0.35, 100 * 0.88 * 0.30, 100 * (1 - 0.4 * 0.4) * 0.20), 2)::DOUBLE AS quietest, round(100 * 0.15, 2)::DOUBLE AS ml_ceiling,
  count(*) FILTER (score >= round(least(100 * 0.6 * 0.35, 100 * 0.88 * 0.30, 100 * (1 - 0.4 * 0.4) * 0.20) - 0.1, 2)) AS open FROM scores""")
def min_case_score(spark, sf):
    threshold, quietest, ceiling = risk.min_case_score()
    at = F.lit(threshold)
    return rounded(scores(spark, sf).agg(F.count_if(F.col("score") >= at).alias("open")).select(at.alias("threshold"), F.lit(quietest).alias("quietest"), F.lit(ceiling).alias("ml_ceiling"), "open"))


@query("reweighted_queue", _EVIDENCE + """, best AS (SELECT account_id, source, max(contribution) AS c FROM evidence GROUP BY 1, 2),
s AS (SELECT account_id, round(sum(CASE source WHEN 'rules' THEN 0.35 WHEN 'screening' THEN 0.30 WHEN 'graph' THEN 0.20 WHEN 'media' THEN 0.20 END::DOUBLE / 1.2 * c) * 100, 2) AS score FROM best GROUP BY 1)
SELECT * FROM s WHERE score >= 13.9 ORDER BY score DESC, account_id LIMIT 20""")
def reweighted_queue(spark, sf):
    weights = risk.weights_with_media()
    out = risk.aggregate(evidence(spark, sf, "separate"), weights).select("account_id", "score")
    return out.filter(F.col("score") >= risk.min_case_score(weights)[0]).orderBy(F.desc("score"), "account_id").limit(20)


def _case_events(spark, sf) -> DataFrame:
    """A case for each account, up to a step that its number gives; a closed one is confirmed where the account is true."""
    kinds = F.element_at(F.array(*map(F.lit, ("opened", "assigned", "note", "closed", "reopened"))), (F.col("step") + 1).cast("int"))
    found = F.when(F.col("bad"), "true_positive_sar: checked").otherwise("false_positive: checked")
    detail = F.when(kinds == "closed", found).when(kinds == "assigned", "analyst").otherwise("-")
    bad = truth(spark, sf).select(F.col("id").alias("account_id")).distinct().withColumn("bad", F.lit(True))
    people = txns(spark, sf).groupBy("account_id").agg(F.min("ts").alias("t0")).withColumn("case_id", F.substring("account_id", 2, 20).cast("long"))
    rows = people.join(bad, "account_id", "left").withColumn("step", F.explode(F.sequence(F.lit(0), (F.col("case_id") % 5).cast("int"))))
    return rows.select((F.col("case_id") * 10 + F.col("step")).alias("event_id"), "case_id", (F.col("t0") + F.make_dt_interval(F.lit(0), F.col("step"))).alias("ts"), F.lit("x").alias("actor"), kinds.alias("event_type"), detail.alias("detail"))


def _case_states(spark, sf) -> DataFrame:
    return cases.state(_case_events(spark, sf)).withColumn("account_id", F.concat(F.lit("A"), "case_id"))


@query("open_from_queue", _SCORES + "SELECT account_id, score FROM scores WHERE score >= 17.5 AND account_id NOT IN (SELECT account_id FROM people WHERE user_id % 5 <> 3) ORDER BY score DESC, account_id LIMIT 15")
def open_from_queue(spark, sf):
    return cases.to_open(scores(spark, sf), _case_states(spark, sf), limit=15).select("account_id", "score")


_STATES = """SELECT user_id AS case_id, CASE user_id % 5 WHEN 0 THEN 'open' WHEN 3 THEN 'closed' ELSE 'in_review' END AS status,
  CASE WHEN user_id % 5 = 3 THEN CASE WHEN account_id IN (SELECT id FROM truth) THEN 'true_positive_sar' ELSE 'false_positive' END END AS disposition,
  CASE WHEN user_id % 5 >= 1 THEN 'analyst' END AS assigned_to, min(ts) AS opened_at, CASE WHEN user_id % 5 = 3 THEN min(ts) + INTERVAL 3 HOUR END AS closed_at FROM txn GROUP BY user_id, account_id"""


@query("case_state_fold", _STATES)
def case_state_fold(spark, sf):
    return cases.state(_case_events(spark, sf))


@query("case_log_state", _STATES)
def case_log_state(spark, sf):
    """The same states from a log on files: two appends, a snapshot of them, and one more append."""
    log, events = published.Log(spark, shared_folder(spark), cases.EVENTS), _case_events(spark, sf)
    for step, of in enumerate(("opened", "assigned", None)):
        log.append(events.filter(F.col("event_type") == of) if of else events.filter("event_type not in ('opened', 'assigned')"))
        if step == 1:
            log.compact()
    return cases.state(log.read())


@query("case_timeline", "SELECT user_id * 10 + s AS event_id, (['opened', 'assigned', 'note', 'closed', 'reopened'])[s + 1] AS event_type FROM (SELECT user_id, unnest(range(user_id % 5 + 1)) AS s FROM people WHERE user_id = 3)")
def case_timeline(spark, sf):
    return rounded(cases.timeline(_case_events(spark, sf), 3).select("event_id", "event_type"))


@query("case_queue", _SCORES + "SELECT user_id AS case_id, score AS risk_score FROM scores JOIN people USING (account_id) WHERE user_id % 5 <> 3 ORDER BY score DESC, user_id LIMIT 50")
def case_queue(spark, sf):
    held = scores(spark, sf).select(F.substring("account_id", 2, 20).cast("long").alias("case_id"), F.col("score").alias("risk_score"))
    return cases.queue(cases.state(_case_events(spark, sf)).join(held, "case_id")).select("case_id", "risk_score")


# --- scoring ---------------------------------------------------------------------------------

_FLAGGED = f", flagged AS (SELECT DISTINCT account_id AS id FROM ({_ALL}))"


def flagged(spark, sf) -> DataFrame:
    return alerts(spark, sf).select(F.col("account_id").alias("id"))


@query("precision_recall", _FLAGGED + """, a AS (SELECT count(*) AS flagged, count(*) FILTER (id IN (SELECT id FROM truth)) AS hits FROM flagged),
b AS (SELECT count(DISTINCT scheme_id) AS schemes, count(DISTINCT scheme_id) FILTER (id IN (SELECT id FROM flagged)) AS caught FROM truth)
SELECT flagged, hits, round(hits / flagged, 6) AS precision, round((flagged - hits) / flagged, 6) AS false_positive_rate, schemes, caught, round(caught / schemes, 6) AS recall FROM a, b""")
def precision_recall(spark, sf):
    return rounded(scoring.precision_recall(flagged(spark, sf), truth(spark, sf).select("id", "scheme_id").distinct()))


@query("recall_by_typology", _FLAGGED + """ SELECT typology, count(*) AS schemes, count(*) FILTER (met) AS caught, round(count(*) FILTER (met) / count(*), 6) AS recall
FROM (SELECT typology, scheme_id, bool_or(id IN (SELECT id FROM flagged)) AS met FROM truth GROUP BY 1, 2) GROUP BY 1""")
def recall_by_typology(spark, sf):
    return rounded(scoring.recall_by(flagged(spark, sf), truth(spark, sf)))


@query("chain_score", _PATHS + """, m AS (SELECT DISTINCT scheme_id, substr(id, 2) AS account FROM truth), own AS (SELECT DISTINCT txns, unnest(accounts)::VARCHAR AS account FROM chains),
met AS (SELECT txns, scheme_id FROM own JOIN m USING (account) GROUP BY 1, 2 HAVING count(*) >= 2),
n AS (SELECT (SELECT count(*) FROM chains) AS chains, (SELECT count(DISTINCT txns) FROM met) AS true_chains, (SELECT count(DISTINCT scheme_id) FROM met) AS seen, (SELECT count(DISTINCT scheme_id) FROM m) AS schemes)
SELECT *, CASE WHEN chains = 0 THEN 0 ELSE round(true_chains / chains, 6) END AS precision, round(seen / schemes, 6) AS recall FROM n""")
def chain_score(spark, sf):
    t = truth(spark, sf).select(F.substring("id", 2, 20).alias("id"), "scheme_id")
    return rounded(scoring.chain_score(chains(spark, sf), t))


_LABELLED = ", s AS (SELECT doc_id AS id, (doc_id % 97) / 97.0::DOUBLE AS score, quality AS label FROM labels), g AS (SELECT score, sum(label) AS tp, count(*) AS n FROM s GROUP BY 1), w AS (SELECT *, sum(tp) OVER d AS stp, sum(n) OVER d AS sn FROM g WINDOW d AS (ORDER BY score DESC))"


def labelled(spark, sf) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").alias("id"), ((F.col("doc_id") % 97) / F.lit(97.0)).alias("score"), F.col("quality").alias("label"))


@query("average_precision", _LABELLED + " SELECT round(sum(tp * stp / sn) / sum(tp), 6) AS average_precision FROM w")
def average_precision(spark, sf):
    return rounded(scoring.average_precision(labelled(spark, sf)))


@query("roc_auc", _LABELLED + " SELECT round(sum((n - tp) * (stp - tp + tp / 2)) / (sum(tp) * sum(n - tp)), 6) AS roc_auc FROM w")
def roc_auc(spark, sf):
    return rounded(scoring.roc_auc(labelled(spark, sf)))


@query("kpi_budgets", _LABELLED + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM s)
SELECT b AS budget, count(*) AS reviewed, sum(label)::BIGINT AS hits, round(sum(label) / count(*), 6) AS precision, round(sum(label) / (SELECT sum(label) FROM s), 6) AS recall, round(count(*) / nullif(sum(label), 0), 6) AS reviews_per_find
FROM r, (SELECT unnest([10, 25, 50, 100])::BIGINT AS b) WHERE place <= b GROUP BY b""")
def kpi_budgets(spark, sf):
    return rounded(scoring.at_budgets(labelled(spark, sf)))


@query("layer_comparison", _SIGNALS + """top AS (SELECT source, account_id FROM strongest QUALIFY row_number() OVER (PARTITION BY source ORDER BY contribution DESC, account_id) <= 25)
SELECT source, count(*) AS reviewed, count(*) FILTER (account_id IN (SELECT id FROM truth)) AS hits, round(count(*) FILTER (account_id IN (SELECT id FROM truth)) / count(*), 6) AS precision FROM top GROUP BY 1""")
def layer_comparison(spark, sf):
    return rounded(scoring.layer_comparison(signals(spark, sf), truth(spark, sf)))


@query("unique_reach", _SIGNALS.rstrip().rstrip(",") + " SELECT source, count(*) AS n FROM (SELECT account_id, any_value(source) AS source FROM signals GROUP BY 1 HAVING count(DISTINCT source) = 1) GROUP BY 1")
def unique_reach(spark, sf):
    own = signals(spark, sf).groupBy("account_id").agg(F.collect_set("source").alias("s")).filter(F.size("s") == 1)
    return rounded(own.groupBy(F.element_at("s", 1).alias("source")).agg(F.count("*").alias("n")))


@query("marginal_trade", _SIGNALS + f"""before AS (SELECT account_id FROM strongest WHERE source <> 'screening' GROUP BY 1 ORDER BY round(sum({_WEIGHT} * contribution) * 100, 2) DESC, account_id LIMIT 25),
after AS (SELECT account_id FROM strongest GROUP BY 1 ORDER BY round(sum({_WEIGHT} * contribution) * 100, 2) DESC, account_id LIMIT 25), t AS (SELECT DISTINCT id FROM truth),
g AS (SELECT account_id FROM after WHERE account_id NOT IN (FROM before)), l AS (SELECT account_id FROM before WHERE account_id NOT IN (FROM after))
SELECT (SELECT count(*) FROM g) AS gained, (SELECT count(*) FROM g WHERE account_id IN (FROM t)) AS gained_true, (SELECT count(*) FROM l) AS lost, (SELECT count(*) FROM l WHERE account_id IN (FROM t)) AS lost_true""")
def marginal_trade(spark, sf):
    s = signals(spark, sf)
    top = lambda x: risk.aggregate(x).orderBy(F.desc("score"), "account_id").limit(25)
    return scoring.marginal_trade(top(s.filter("source <> 'screening'")), top(s), truth(spark, sf))


@query("tie_noise", _SCORES + ", c AS (SELECT min(score) AS score FROM (SELECT score FROM scores ORDER BY score DESC, account_id LIMIT 25)) SELECT count(*) FILTER (s.score = c.score) AS tied, count(*) FILTER (s.score > c.score) AS above FROM scores s, c")
def tie_noise(spark, sf):
    s = scores(spark, sf)
    last = s.orderBy(F.desc("score"), "account_id").limit(25).agg(F.min("score").alias("edge"))
    return rounded(s.crossJoin(last).agg(F.count_if(F.col("score") == F.col("edge")).alias("tied"), F.count_if(F.col("score") > F.col("edge")).alias("above")))


# --- replay ----------------------------------------------------------------------------------

_PAIRS = "SELECT a.account_id, min(b.ts::DATE) AS day FROM txn a JOIN txn b ON a.account_id = b.account_id AND b.ts > a.ts AND "
_FIRED = {
    "structuring_burst": "SELECT account_id, min(ts::DATE) AS day FROM (SELECT *, count(*) OVER w AS n, sum(amount) OVER w AS t FROM txn WHERE direction = 'CR' AND channel = 'CASH' AND amount < 200 WINDOW w AS (PARTITION BY account_id ORDER BY ts, txn_id ROWS UNBOUNDED PRECEDING)) WHERE n >= 4 AND t >= 100 GROUP BY 1",
    "rapid_pass_through": _PAIRS + "b.ts <= a.ts + INTERVAL 48 HOUR AND b.amount >= a.amount * 0.85::DOUBLE WHERE a.direction = 'CR' AND b.direction = 'DR' AND a.amount >= 100 GROUP BY 1",
    "round_trip": _PAIRS + "b.ts <= a.ts + INTERVAL 12 DAY AND b.amount >= a.amount * 0.95::DOUBLE WHERE a.direction = 'DR' AND b.direction = 'CR' AND a.channel = 'RTGS' AND b.channel = 'RTGS' AND a.amount >= 20 GROUP BY 1",
    "counterparty_concentration": """SELECT account_id, min(day) AS day FROM (SELECT d.account_id, d.day, p.cp, sum(p.amount)::DOUBLE AS part, count(*) AS n, any_value(w.whole) AS whole
  FROM (SELECT DISTINCT account_id, ts::DATE AS day FROM txn) d JOIN txn p ON p.account_id = d.account_id AND p.direction = 'CR' AND p.ts::DATE <= d.day
  JOIN (SELECT d.account_id, d.day, sum(t.amount)::DOUBLE AS whole FROM (SELECT DISTINCT account_id, ts::DATE AS day FROM txn) d JOIN txn t ON t.account_id = d.account_id AND t.direction = 'CR' AND t.ts::DATE <= d.day GROUP BY 1, 2) w
    ON w.account_id = d.account_id AND w.day = d.day GROUP BY 1, 2, 3) WHERE part >= 200 AND n >= 3 AND part / whole >= 0.2::DOUBLE GROUP BY 1""",
    "dormancy_burst": """SELECT account_id, min(day) AS day FROM (SELECT a.account_id, a.ts, a.amount, d.day, sum(b.amount) AS o FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY account_id ORDER BY ts, txn_id) AS gap FROM txn) a
  JOIN (SELECT DISTINCT ts::DATE AS day FROM txn) d ON d.day >= a.ts::DATE AND d.day <= a.ts::DATE + 2 JOIN txn b ON a.account_id = b.account_id AND b.direction = 'DR' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR AND b.ts::DATE <= d.day
  WHERE a.direction = 'CR' AND a.gap >= INTERVAL 1 DAY AND a.amount >= 20 GROUP BY 1, 2, 3, 4) WHERE o >= amount * 0.5::DOUBLE GROUP BY 1""",
    "high_risk_geography": "SELECT account_id, min(ts::DATE) AS day FROM txn WHERE channel = 'INT' AND (contains(cp, 'CP1') OR contains(cp, 'CP9')) GROUP BY 1",
}
_REPLAY = {
    "structuring_burst": lambda t: replay.structuring_burst(t, **D1),
    "rapid_pass_through": lambda t: replay.rapid_pass_through(t, **D2),
    "round_trip": lambda t: replay.round_trip(t, **D3),
    "counterparty_concentration": lambda t: replay.counterparty_concentration(t, **D4),
    "dormancy_burst": lambda t: replay.dormancy_burst(t, **D5),
    "high_risk_geography": lambda t: replay.high_risk_geography(t, D6),
}
for _name, _sql in _FIRED.items():
    query(f"first_fired_{_name}", f"SELECT account_id, '{_name}' AS detector, day FROM ({_sql})")(lambda spark, sf, first=_REPLAY[_name]: first(txns(spark, sf)))


@query("first_fired_chain", _PATHS + "SELECT account::VARCHAR AS account_id, 'chain' AS detector, min(ended::DATE) AS day FROM (SELECT unnest(accounts) AS account, ended FROM paths WHERE len(txns) >= 2) GROUP BY 1")
def first_fired_chain(spark, sf):
    return replay.chains(ledger.edges(spark, sf), **CHAIN)


_LATENCY = ", fired AS (" + " UNION ALL ".join(f"SELECT account_id, day FROM ({s})" for s in _FIRED.values()) + """), sp AS (SELECT scheme_id, typology, min(day) AS started, sum(amount) AS total FROM truth GROUP BY 1, 2),
ca AS (SELECT t.scheme_id, min(f.day) AS caught FROM (SELECT DISTINCT scheme_id, id FROM truth) t JOIN fired f ON f.account_id = t.id JOIN (SELECT scheme_id, min(started) AS s0 FROM sp GROUP BY 1) z ON z.scheme_id = t.scheme_id WHERE f.day >= z.s0 GROUP BY 1),
mo AS (SELECT t.scheme_id, sum(amount) AS moved FROM truth t JOIN ca USING (scheme_id) WHERE t.day <= ca.caught GROUP BY 1),
latency AS (SELECT scheme_id, typology, started, caught, date_diff('day', started, caught) AS days, moved::DOUBLE / total::DOUBLE AS moved_before_alert FROM sp LEFT JOIN ca USING (scheme_id) LEFT JOIN mo USING (scheme_id))
"""


def latencies(spark, sf) -> DataFrame:
    t = txns(spark, sf)
    fired = None
    for first in _REPLAY.values():
        fired = first(t) if fired is None else fired.unionByName(first(t))
    # A scheme of one kind each, so that a scheme has one start.
    schemes = truth(spark, sf).select("scheme_id", "typology", F.col("id").alias("account_id"), "day", "amount")
    schemes = schemes.withColumn("scheme_id", F.concat("scheme_id", "typology"))
    return replay.latency(fired, schemes)


_LATENCY = _LATENCY.replace("FROM truth", "FROM (SELECT * REPLACE (concat(scheme_id, typology) AS scheme_id) FROM truth)")


@query("moved_before_alert", _LATENCY + "SELECT scheme_id, typology, started, caught, days, round(moved_before_alert, 6) AS moved_before_alert FROM latency")
def moved_before_alert(spark, sf):
    return rounded(latencies(spark, sf))


@query("latency_by_typology", _LATENCY + "SELECT typology, count(*) AS schemes, count(*) FILTER (caught IS NULL) AS never, round(median(days), 6) AS median_days, round(median(moved_before_alert), 6) AS median_moved FROM latency GROUP BY 1")
def latency_by_typology(spark, sf):
    return rounded(replay.latency_report(latencies(spark, sf)))


# --- banks -----------------------------------------------------------------------------------

_BANKS = """, legs AS (SELECT txn_id * 2 AS leg, ts, src AS account, 'DR' AS direction, amount, txn_id AS ref, src % 4 AS bank FROM edges UNION ALL SELECT txn_id * 2 + 1, ts, dst, 'CR', amount, txn_id, dst % 4 FROM edges)"""


def banked(spark, sf) -> DataFrame:
    return multibank.split_banks(ledger.legs(spark, sf))


@query("bank_split_counts", _BANKS + " SELECT bank, count(*) AS n, count(DISTINCT account) AS accounts FROM legs GROUP BY 1")
def bank_split_counts(spark, sf):
    return rounded(banked(spark, sf).groupBy("bank").agg(F.count("*").alias("n"), F.count_distinct("account").alias("accounts")))


SECRET = b"consortium"
_INNER, _OUTER = (p.hex() for p in multibank.pads(SECRET))
_TOKEN = f"sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode({{}}::VARCHAR))))".format
_SUSPECTS = f", suspects AS (SELECT DISTINCT CAST(substr(account_id, 2) AS BIGINT) AS account FROM ({_RULES['rapid_pass_through']}))"
_MET = " FROM p a JOIN p b ON a.ref = b.ref AND a.amount = b.amount AND a.ts = b.ts WHERE a.direction = 'DR' AND b.direction = 'CR' AND a.bank <> b.bank"


def suspects(spark, sf) -> DataFrame:
    """Accounts that the pass-through rule flags; a bank holds all rows of its accounts."""
    return _SCENARIO["rapid_pass_through"](txns(spark, sf)).select(F.substring("account_id", 2, 20).cast("long").alias("account"))


@query("fingerprints", _BANKS + _SUSPECTS + f" SELECT bank, {_TOKEN('ref')} AS token, direction, round(amount, 6) AS amount, ts FROM legs WHERE account IN (FROM suspects)")
def fingerprints(spark, sf):
    return rounded(multibank.fingerprints(banked(spark, sf), suspects(spark, sf), multibank.keyed_token(SECRET)))


@query("cross_bank_edges", _BANKS + _SUSPECTS + f""", p AS (SELECT * FROM legs WHERE account IN (FROM suspects))
SELECT a.bank AS from_bank, b.bank AS to_bank, {_TOKEN('a.ref')} AS token, round(a.amount, 6) AS amount, a.ts""" + _MET)
def cross_bank_edges(spark, sf):
    return rounded(multibank.cross_bank_edges(multibank.fingerprints(banked(spark, sf), suspects(spark, sf), multibank.keyed_token(SECRET))))


_HOPS = _PATHS + ", numbered AS (SELECT array_to_string(txns, '-') AS chain, accounts FROM chains), pos AS (SELECT chain, i AS position, accounts[i] % 4 AS bank FROM numbered, range(1, 40) r(i) WHERE i <= len(accounts)), isl AS (SELECT *, position - row_number() OVER (PARTITION BY chain, bank ORDER BY position) AS island FROM pos)"


@query("same_bank_runs", _HOPS + " SELECT chain, bank, min(position) AS first, count(*) AS hops FROM isl GROUP BY chain, bank, island HAVING count(*) >= 2")
def same_bank_runs(spark, sf):
    own = chains(spark, sf).select(F.array_join(F.col("txns").cast("array<string>"), "-").alias("chain"), F.posexplode("accounts").alias("p", "account"))
    return rounded(multibank.same_bank_runs(own.select("chain", (F.col("p") + 1).alias("position"), (F.col("account") % 4).alias("bank"))))


def bank_outcomes(spark, sf) -> DataFrame:
    """Each chain of the pooled rows, as single banks and co-operating banks see it."""
    plant = F.array_join(F.col("txns").cast("array<string>"), "-")
    pooled = chains(spark, sf).withColumn("plant", plant)
    bank = lambda account: account % 4
    alone = graph.find_chains(ledger.edges(spark, sf).filter(bank(F.col("src")) == bank(F.col("dst"))), **CHAIN)
    solo = alone.select(plant.alias("chain"), F.posexplode("accounts").alias("position", "account"))
    prints = multibank.fingerprints(banked(spark, sf), suspects(spark, sf), multibank.keyed_token(SECRET))
    met = multibank.cross_bank_edges(prints).select("token", "amount", "ts").distinct()
    token = multibank.keyed_token(SECRET)(F.col("txn_id").cast("string"))
    recovered = ledger.edges(spark, sf).withColumn("token", token).join(met, ["token", "amount", "ts"], "left_semi")
    return multibank.outcomes(pooled, solo, recovered, bank)


def _renamed(sql: str) -> str:
    """The chains of banks' own rows, beside those of all."""
    for name in ("paths", "maximal", "one", "chains"):
        sql = sql.replace(f"{name} AS (", f"own_{name} AS (").replace(f"FROM {name}", f"FROM own_{name}")
    return sql.replace("FROM edges WHERE", "FROM edges WHERE src % 4 = dst % 4 AND").replace("JOIN edges e\n    ON", "JOIN edges e\n    ON e.src % 4 = e.dst % 4 AND")


_OUTCOMES = _PATHS.rstrip() + _renamed(_PATHS).rstrip() + _SUSPECTS + """, hops AS (SELECT array_to_string(txns, '-') AS plant, accounts[i] AS a, accounts[i + 1] AS b FROM chains, range(1, 60) r(i) WHERE i < len(accounts)),
own_hops AS (SELECT array_to_string(txns, '-') AS chain, accounts[i] AS a, accounts[i + 1] AS b FROM own_chains, range(1, 60) r(i) WHERE i < len(accounts)),
seen AS (SELECT plant, max(n) AS best FROM (SELECT plant, chain, count(*) AS n FROM hops JOIN own_hops USING (a, b) GROUP BY 1, 2) GROUP BY 1),
outcomes AS (SELECT plant, count(*) AS hops, count(*) FILTER (a % 4 = b % 4) AS same_bank, coalesce(any_value(best), 0)::BIGINT AS solo_best,
  count(*) FILTER (a % 4 <> b % 4 AND a IN (FROM suspects) AND b IN (FROM suspects)) AS coop FROM hops LEFT JOIN seen USING (plant) GROUP BY plant)
"""


@query("chain_outcomes", _OUTCOMES + "SELECT * FROM outcomes")
def chain_outcomes(spark, sf):
    return rounded(bank_outcomes(spark, sf))


@query("bank_measure", _OUTCOMES + "SELECT count(*) AS chains, sum(hops)::BIGINT AS pooled, sum(same_bank)::BIGINT AS same_bank, sum(solo_best)::BIGINT AS solo, sum(coop)::BIGINT AS coop FROM outcomes")
def bank_measure(spark, sf):
    o = bank_outcomes(spark, sf)
    return rounded(o.agg(F.count("*").alias("chains"), F.sum("hops").alias("pooled"), F.sum("same_bank").alias("same_bank"), F.sum("solo_best").alias("solo"), F.sum("coop").alias("coop")))


@query("chain_report", _OUTCOMES + """, placed AS (SELECT array_to_string(txns, '-') AS plant, i AS position, accounts[i] AS account, accounts[i] % 4 AS bank FROM chains, range(1, 60) r(i) WHERE i <= len(accounts)),
islands AS (SELECT *, position - row_number() OVER (PARTITION BY plant, bank ORDER BY position) AS island FROM placed),
longest AS (SELECT plant, max(n) AS longest_run FROM (SELECT plant, bank, island, count(*) AS n FROM islands GROUP BY ALL) GROUP BY 1)
SELECT plant, count(*) AS accounts, count(DISTINCT bank) AS banks, count(*) FILTER (account IN (FROM suspects)) AS locally_flagged, any_value(longest_run) AS longest_run FROM placed JOIN longest USING (plant) GROUP BY plant""")
def chain_report(spark, sf):
    own = chains(spark, sf).withColumn("plant", F.array_join(F.col("txns").cast("array<string>"), "-"))
    return rounded(multibank.chain_report(own, suspects(spark, sf), lambda account: account % 4))


@query("privacy_notes", _BANKS + _OUTCOMES + """SELECT (SELECT count(*) FROM legs WHERE account IN (FROM suspects)) AS published, (SELECT count(DISTINCT bank) FROM legs WHERE account IN (FROM suspects)) AS banks,
  sum(hops - same_bank)::BIGINT AS crossing, (sum(hops - same_bank) - sum(coop))::BIGINT AS lost FROM outcomes""")
def privacy_notes(spark, sf):
    prints = multibank.fingerprints(banked(spark, sf), suspects(spark, sf), multibank.keyed_token(SECRET))
    return rounded(multibank.privacy_notes(prints, bank_outcomes(spark, sf)))


# --- models ----------------------------------------------------------------------------------

def _labelled_accounts(spark, sf) -> DataFrame:
    bad = truth(spark, sf).select(F.col("id").alias("account_id")).distinct().withColumn("bad", F.lit(1))
    return txns(spark, sf).select("account_id").distinct().join(bad, "account_id", "left").select("account_id", F.coalesce("bad", F.lit(0)).alias("label"))


@query("stratified_split", f""", l AS (SELECT account_id, CAST(account_id IN (SELECT id FROM truth) AS BIGINT) AS label FROM people)
SELECT account_id, label, row_number() OVER (PARTITION BY label ORDER BY {_num("account_id", "42")}) <= floor(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE) AS test FROM l""")
def stratified_split(spark, sf):
    return rounded(ml.stratified_split(_labelled_accounts(spark, sf)))


@query("gbt_leaderboard")
def gbt_leaderboard(spark, sf):
    f = cut(features.account_features(posted(spark, sf)))  # each model reads it
    split = ml.stratified_split(_labelled_accounts(spark, sf))
    boosted = ml.boosted_scores(f, split)
    test = split.filter("test")
    raw = lambda df: df.join(test, "account_id").select("account_id", F.col("raw").alias("score"), "label")
    near = neighbour_features(spark, sf, f).join(split, "account_id")
    return ml.leaderboard({
        "boosted trees": boosted, "boosted trees with neighbours": ml.boosted_scores(near.drop("label", "test"), split, names=ml.NAMES + tuple(f"near_{n}" for n in ml.NAMES)),
        "isolation forest": raw(ml.isolation_scores(f)), "one-class boundary": raw(ml.one_class_scores(f)), "principal components": raw(ml.reconstruction_errors(f)), "autoencoder": raw(ml.autoencoder_errors(f)),
    })


def neighbour_features(spark, sf, f: DataFrame | None = None) -> DataFrame:
    e = ledger.edges(spark, sf)
    people = e.select(F.col("src").alias("account")).union(e.select("dst")).distinct()
    weights = ml.adjacency(e, people.withColumn("test", F.lit(False)))
    f = (features.account_features(posted(spark, sf)) if f is None else f).withColumn("account", F.substring("account_id", 2, 20).cast("long"))
    return ml.with_neighbours(f, weights).drop("account")


@query("neighbour_features", """, f AS (""" + _FEATURES + """), b AS (SELECT src AS account, dst AS other FROM edges UNION SELECT dst, src FROM edges)
SELECT p.account_id, round(coalesce(avg(n.total_in), 0), 6) AS near_total_in, round(coalesce(avg(n.txn_count), 0), 6) AS near_txn_count
FROM f p LEFT JOIN (SELECT concat('A', account) AS account_id, concat('A', other) AS near FROM b) USING (account_id) LEFT JOIN (SELECT account_id AS near, total_in, txn_count FROM f) n USING (near) GROUP BY 1""")
def near(spark, sf):
    return rounded(neighbour_features(spark, sf).select("account_id", "near_total_in", "near_txn_count"))


@query("pca_reconstruction")
def pca_reconstruction(spark, sf):
    return ml.reconstruction_errors(features.account_features(posted(spark, sf)))


@query("autoencoder_errors")
def autoencoder_errors(spark, sf):
    return ml.autoencoder_errors(features.account_features(posted(spark, sf)))


@query("isolation_scores")
def isolation_scores(spark, sf):
    return ml.isolation_scores(features.account_features(posted(spark, sf)))


@query("unsupervised_scores")
def unsupervised_scores(spark, sf):
    return risk.unsupervised_scores(ml.isolation_scores(features.account_features(posted(spark, sf))))


@query("one_class_scores")
def one_class_scores(spark, sf):
    return ml.one_class_scores(features.account_features(posted(spark, sf)))


@query("adjacency", """, b AS (SELECT src AS account, dst AS other FROM edges UNION SELECT dst, src FROM edges), i AS (SELECT * FROM b WHERE account % 3 = 0 AND other % 3 = 0 OR account % 3 <> 0 AND other % 3 <> 0)
SELECT account, other, round(1.0::DOUBLE / count(*) OVER (PARTITION BY account), 6) AS weight FROM i""")
def adjacency(spark, sf):
    e = ledger.edges(spark, sf)
    people = e.select(F.col("src").alias("account")).union(e.select("dst")).distinct()
    return rounded(ml.adjacency(e, people.withColumn("test", F.col("account") % 3 == 0)))


# --- generated worlds ------------------------------------------------------------------------

DAYS = 14


def _habits(days: int, seed: str = "42") -> str:
    """SQL of world.life_events over ``folk``."""
    parts = []
    for h in world.HABITS:
        key = ("account_id", "k", seed, f"'{h.name}'")
        segments = ", ".join(f"'{x}'" for x in h.segments)
        parts.append(f"""SELECT account_id, {_moment("day", *key, "'ts'")} AS ts, '{h.direction}' AS direction, '{h.channel}' AS channel,
  CAST({h.low} + {_uni(*key, "'amount'")} * {h.high - h.low} AS DECIMAL(15,2)) AS amount, concat('{h.name} ', {_pick(world.LAST, *key, "'cp'")}) AS counterparty_name,
  concat_ws('/', '{h.channel}', '{h.direction}', {_num(*key)} % 1000000, '{h.name}') AS narration
FROM (SELECT *, CAST(k * {h.every} + {h.first} + floor({_uni(*key, "'day'")} * {h.last - h.first + 1}) AS INTEGER) AS day FROM folk, (SELECT unnest(range({-(-days // h.every)})) AS k)
  WHERE segment IN ({segments}) AND {_uni(*key)} < {h.chance}::DOUBLE) WHERE day < {days}""")
    paid = f"""SELECT f.*, g.account_id AS friend, CAST(floor({_uni("f.account_id", seed, "'day'")} * {days}) AS INTEGER) AS day FROM folk f JOIN folk g ON g.id = (f.id + 1) % (SELECT count(*) FROM folk)
  WHERE {_uni("f.account_id", seed, "'p2p'")} < 0.35::DOUBLE AND f.account_id <> g.account_id"""
    for side, me, other in (("DR", "account_id", "friend"), ("CR", "friend", "account_id")):
        parts.append(f"""SELECT {me} AS account_id, {_moment("day", "account_id", seed, "'p2p ts'")} AS ts, '{side}' AS direction, 'UPI' AS channel,
  CAST(100 + {_uni("account_id", seed, "'p2p amount'")} * 2900 AS DECIMAL(15,2)) AS amount, {other} AS counterparty_name, concat_ws('/', 'UPI', '{side}', {_num("account_id", seed)} % 1000000, 'p2p') AS narration FROM ({paid})""")
    return " UNION ALL ".join(parts)


_LIFE = _FOLK + f", life AS ({_habits(DAYS)})"


@query("population", _FOLK + " SELECT * FROM folk")
def population(spark, sf):
    return _people(spark, sf)


@query("life_events", _LIFE + " SELECT * REPLACE (amount::DOUBLE AS amount) FROM life")
def life_events(spark, sf):
    return rounded(world.life_events(_people(spark, sf), DAYS))


@query("posted_world", _LIFE + """, run AS (SELECT *, sum(CASE WHEN direction = 'CR' THEN amount ELSE -amount END) OVER (PARTITION BY account_id ORDER BY ts, narration, amount, direction ROWS UNBOUNDED PRECEDING) AS run,
  row_number() OVER (PARTITION BY account_id ORDER BY ts, narration, amount, direction) AS place FROM life)
SELECT account_id, ts, direction, channel, amount::DOUBLE AS amount, counterparty_name, narration, CAST(substr(account_id, 2) AS BIGINT) * 1000000 + place AS txn_id,
  (run + greatest(-min(run) OVER (PARTITION BY account_id), 0) + 1000)::DOUBLE AS balance_after, NULL::VARCHAR AS counterparty_ref FROM run""")
def posted_world(spark, sf):
    return rounded(world.post(world.life_events(_people(spark, sf), DAYS)))


_USES = ("structuring", "shell", "round_trip", "dormant", "geography")
_POOL = ", pool AS (SELECT *, row_number() OVER (ORDER BY " + _num("account_id", "42") + ", account_id) - 1 AS place FROM people), last AS (SELECT account_id, max(ts) AS last_ts FROM txn GROUP BY 1)"
_SPARE = f", spare AS (SELECT account_id, round(greatest(least(opening, low)::DOUBLE * 0.6, 0), 6) AS ceiling FROM {_FIRST})"


def _pool(spark, sf, use: str) -> DataFrame:
    """Two accounts of the ledger for each use, with what they can spare and when they were last used."""
    t = posted(spark, sf)
    pool = world.partition_pool(t.select("account_id").distinct(), {k: 2 for k in _USES}).filter(F.col("use") == use).select("account_id")
    spare = ledger.safe_debit_ceiling(t).withColumn("ceiling", F.round("ceiling", 6))
    return pool.join(spare, "account_id").join(t.groupBy("account_id").agg(F.max("ts").alias("last_ts")), "account_id")


@query("partition_pool", _POOL + f" SELECT account_id, ([{', '.join(repr(k) for k in _USES)}])[1 + place // 2] AS use, place FROM pool WHERE place < {2 * len(_USES)}")
def partition_pool(spark, sf):
    return rounded(world.partition_pool(txns(spark, sf).select("account_id").distinct(), {k: 2 for k in _USES}))


def _scheme_sql(kind: str, use: str, n: str, extra: str = "") -> str:
    """CTE ``d`` of a kind's steps, over the pool's accounts of that use."""
    at = _USES.index(use)
    return _POOL + _SPARE + f""", base AS (SELECT account_id, concat('{kind}-', account_id) AS scheme_id, CAST({n} AS INTEGER) AS n, ceiling, last_ts FROM pool JOIN spare USING (account_id) JOIN last USING (account_id)
  WHERE place BETWEEN {2 * at} AND {2 * at + 1}), d AS (SELECT *, {_uni("scheme_id", "step", "1", "'part'")} + 0.5::DOUBLE AS part FROM base, range(0, n) r(step)){extra} """


_REF = _num("scheme_id", "step", "1", "'ref'") + " % 1000000"
_D = lambda what: _uni("scheme_id", "step", "1", f"'{what}'")
_ONCE = lambda what: _uni("scheme_id", "1", f"'{what}'")
_N = _uni("account_id", "1", "'n'")
_TS = lambda day: _moment(day, "scheme_id", "step", "1", "'ts'")
_AFTER = "to_seconds(floor(({}) * 3600))".format


def _row_sql(kind: str, direction: str, channel: str, ts: str, amount: str, party: str, source: str = "d") -> str:
    return f"""SELECT account_id, {ts} AS ts, {direction} AS direction, '{channel}' AS channel, CAST(CAST({amount} AS DECIMAL(15,2)) AS DOUBLE) AS amount, {party} AS counterparty_name,
  concat_ws('/', '{channel}', {direction}, {_REF}, 'x') AS narration, scheme_id, '{kind}' AS typology FROM {source}"""


def _split_sql(total: str) -> str:
    return f""", cut AS (SELECT *, CAST(round({total} * part / sum(part) OVER w, 2) AS DECIMAL(15,2)) AS own FROM d WINDOW w AS (PARTITION BY scheme_id)),
shared AS (SELECT *, CASE WHEN step < n - 1 THEN own ELSE CAST({total} AS DECIMAL(15,2)) - coalesce(sum(own) FILTER (step < n - 1) OVER (PARTITION BY scheme_id), 0) END AS paid FROM cut) """


_GAP = f"last_ts + {_AFTER('(3 + ' + _ONCE('gap') + ' * 7) * 24')}"
_HALF = "CASE WHEN {} THEN {} ELSE {} END".format
_INJECTED = {
    "structuring": _scheme_sql("structuring", "structuring", f"27 + floor({_N} * 20)") + _row_sql("structuring", "'CR'", "CASH", _TS(f"floor({_D('day')} * 20)"), f"(0.35::DOUBLE + 0.65::DOUBLE * {_D('amount')}) * 95000", "'SELF'"),
    "shell": _scheme_sql("shell", "shell", f"3 + floor({_N} * 6)", _split_sql("3000000.0::DOUBLE")) + _row_sql("shell", "'CR'", "NEFT", _TS("step * 3"), "paid", "concat('SHELL ', scheme_id)", "shared"),
    "round_trip": _scheme_sql("round_trip", "round_trip", "2") + "SELECT * FROM (" + _row_sql(
        "round_trip", "CASE WHEN step = 1 THEN 'CR' ELSE 'DR' END", "RTGS", f"{_moment('3', 'scheme_id', '1', repr('ts'))} + {_AFTER('CASE WHEN step = 1 THEN (2 + ' + _ONCE('days') + ' * 8) * 24 ELSE 0 END')}",
        _HALF("step = 1", f"round(least(50000, ceiling), 2) * (1.02::DOUBLE + {_ONCE('more')} * 0.08::DOUBLE)", "round(least(50000, ceiling), 2)"), "'OVERSEAS HOLDINGS'") + ") WHERE amount > 0",
    "dormant": _scheme_sql("dormant", "dormant", f"2 + floor({_N} * 3)", _split_sql(f"round(60000 * (0.90::DOUBLE + {_ONCE('share')} * 0.07::DOUBLE), 2)"))
        + _row_sql("dormant", "'DR'", "IMPS", f"{_GAP} + {_AFTER('1 + step * 4 + ' + _D('wait') + ' * 3')}", "paid", "'UNKNOWN SENDER'", "shared") + " UNION ALL "
        + _row_sql("dormant", "'CR'", "IMPS", _GAP, "60000", "'UNKNOWN SENDER'", "(SELECT * REPLACE (-1 AS step) FROM shared WHERE step = 0)"),
    "geography": _scheme_sql("geography", "geography", f"1 + floor({_N} * 3)") + "SELECT * FROM (" + _row_sql(
        "geography", f"CASE WHEN {_D('side')} < 0.5::DOUBLE THEN 'DR' ELSE 'CR' END", "INT", _TS("5 + step"),
        _HALF(f"{_D('side')} < 0.5::DOUBLE", f"floor(least(90000, ceiling) / n * (0.5::DOUBLE + 0.5::DOUBLE * {_D('amount')}))", f"floor(20000 + 60000 * {_D('amount')})"),
        f"concat({_pick(rules.HIGH_RISK, 'scheme_id', 'step', '1', repr('place'))}, ' TRADING LLC')") + ") WHERE amount > 0",
}
_INJECTORS = {
    "structuring": world.structuring, "shell": world.shell_company, "round_trip": world.round_tripping, "dormant": world.dormant_reactivation,
    "geography": lambda a: world.geography(a, rules.HIGH_RISK),
}
for _name, _inject in _INJECTORS.items():
    query(f"inject_{_name}", _INJECTED[_name])(lambda spark, sf, kind=_name, inject=_inject: rounded(inject(_pool(spark, sf, kind))))

_LAYERED = _FOLK + f""", links AS (SELECT id // 4 AS c, list(account_id ORDER BY account_id) AS ids FROM folk GROUP BY 1 HAVING count(*) > 1),
d AS (SELECT concat('layering-L', c) AS scheme_id, ids, len(ids) AS n, step FROM links, range(0, 4) r(step) WHERE step < len(ids)),
e AS (SELECT *, 900000 * exp(sum(CASE WHEN step = 0 THEN 0 ELSE ln(1 - (0.03::DOUBLE + {_D('cut')} * (0.08::DOUBLE - 0.03::DOUBLE))) END) OVER w) AS amount,
  sum(CASE WHEN step = 0 THEN 0 ELSE floor((2 + {_D('gap')} * 28) * 3600) END) OVER w AS wait, {_REF} AS ref FROM d WINDOW w AS (PARTITION BY scheme_id ORDER BY step ROWS UNBOUNDED PRECEDING)),
legs AS (SELECT *, 'CR' AS side, step AS nth, ids[step + 1] AS own, CASE WHEN step = 0 THEN 'CASH IN' ELSE ids[step] END AS other FROM e UNION ALL SELECT *, 'DR', step - 1, ids[step], ids[step + 1] FROM e WHERE step > 0)
SELECT own AS account_id, TIMESTAMP '{world.START}' + to_days(3) + to_seconds(wait) AS ts, side AS direction, 'IMPS' AS channel, CAST(CAST(amount AS DECIMAL(15,2)) AS DOUBLE) AS amount, other AS counterparty_name,
  concat_ws('/', 'IMPS', side, ref, 'x') AS narration, scheme_id, 'layering' AS typology, CASE WHEN nth = 0 THEN 'source' WHEN nth = n - 1 THEN 'sink' ELSE 'mule' END AS role FROM legs"""


@query("inject_layering", _LAYERED)
def inject_layering(spark, sf):
    own = _people(spark, sf).groupBy(F.floor(F.col("id") / 4).alias("c")).agg(F.sort_array(F.collect_list("account_id")).alias("account_ids")).filter(F.size("account_ids") > 1)
    return rounded(world.layering(own.select(F.concat(F.lit("L"), "c").alias("chain_id"), "account_ids")))


@query("assign_banks", _FOLK + f" SELECT account_id, {_num('account_id', '5')} % 4 AS bank FROM folk")
def assign_banks(spark, sf):
    return rounded(world.assign_banks(_people(spark, sf)))


for _placement in ("naive", "deliberate"):
    query(f"plant_chains_{_placement}")(lambda spark, sf, placement=_placement: world.plant_chains(world.assign_banks(_people(spark, sf)), placement=placement))


@query("redteam_decay")
def redteam_decay(spark, sf):
    ids = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("id"))
    return redteam.decay(ids, generations=3)


# --- cases, reports and the log of calls -----------------------------------------------------

@query("case_signals", _SIGNALS.rstrip().rstrip(",") + " SELECT user_id AS case_id, source, detail, CAST(CAST(contribution AS DECIMAL(4,3)) AS DOUBLE) AS contribution FROM signals JOIN people USING (account_id)")
def case_signals(spark, sf):
    held = txns(spark, sf).select("account_id").distinct().withColumn("case_id", F.substring("account_id", 2, 20).cast("long"))
    return rounded(cases.snapshot(signals(spark, sf), held))


@query("entity_totals", """ SELECT 'totals' AS part, count(*) AS n, sum(amount)::DOUBLE AS amount FROM txn WHERE account_id = 'A3'
UNION ALL SELECT 'transactions', count(*), sum(amount)::DOUBLE FROM (SELECT * FROM txn WHERE account_id = 'A3' ORDER BY ts DESC, txn_id DESC LIMIT 20)""")
def entity_totals(spark, sf):
    none = spark.createDataFrame([], "account_id string, status string, accounts array<string>")
    own = cases.entity_360(txns(spark, sf), none, none, "A3")
    totals = own["totals"].select(F.lit("totals").alias("part"), "n", (F.col("total_in") + F.col("total_out")).alias("amount"))
    return rounded(totals.unionByName(own["transactions"].agg(F.count("*").alias("n"), F.sum("amount").cast("double").alias("amount")).select(F.lit("transactions").alias("part"), "n", "amount")))


@query("entity_chains", _PATHS + "SELECT array_to_string(accounts, ',') AS accounts, len(txns) AS hops FROM chains WHERE list_contains(accounts, 3)")
def entity_chains(spark, sf):
    none = spark.createDataFrame([], "account_id string, status string")
    found = cases.entity_360(txns(spark, sf), chains(spark, sf), none, "3")["chains"]
    return rounded(found.select(_listed("accounts").alias("accounts"), "hops"))


def _entity(spark, sf, account_id: str) -> dict[str, DataFrame]:
    accounts, people = holders(spark, sf)
    none = spark.createDataFrame([], "accounts array<string>")
    return cases.entity_360(txns(spark, sf), none, _case_states(spark, sf), account_id, accounts=accounts, customers=people, media=screening.screen_media(articles(spark, sf), people))


@query("entity_profile", _HOLDERS + " SELECT 'A6' AS account_id, concat('C', id) AS customer_id, full_name, segment, city FROM folk WHERE id = 3")
def entity_profile(spark, sf):
    return _entity(spark, sf, "A6")["profile"].select("account_id", "customer_id", "full_name", "segment", "city")


@query("entity_cases", " SELECT user_id AS case_id, CASE WHEN user_id % 5 = 0 THEN 'open' ELSE 'in_review' END AS status FROM people WHERE account_id = 'A6' AND user_id % 5 <> 3")
def entity_cases(spark, sf):
    return rounded(_entity(spark, sf, "A6")["cases"].select("case_id", "status"))


@query("entity_media", _EVIDENCE + ", held AS (SELECT user_id // 2 AS id FROM people WHERE account_id = 'A6') SELECT count(*) AS articles, count(DISTINCT headline) AS headlines, max(score) AS best FROM told a JOIN m_pairs p ON p.name = a.mentioned_name JOIN folk f ON f.full_name = p.other JOIN held USING (id) WHERE category <> 'none'")
def entity_media(spark, sf):
    named = _entity(spark, sf, "A6")["media"]
    return rounded(named.agg(F.count("*").alias("articles"), F.count_distinct("headline").alias("headlines"), F.max("score").alias("best")))


@query("narrative_rows", """ SELECT row_number() OVER (ORDER BY amount DESC, ts, txn_id) AS place, strftime(ts, '%d %b %Y %H:%M') AS at, concat(direction, ' ', format('{:,.2f}', amount::DOUBLE), ' by ', channel, ', ', cp) AS line
FROM txn WHERE account_id = 'A3' QUALIFY place <= 10""")
def narrative_rows(spark, sf):
    return rounded(cases.narrative_rows(txns(spark, sf), "A3"))


@query("audit_log", _PATHS + """ SELECT 'chains' AS tool, '{"min_amount":100.0}' AS params, 'ok' AS outcome, (SELECT count(*) FROM chains) AS hits
UNION ALL SELECT 'account_rows', '{"account_id":"A3"}', 'ok', (SELECT count(*) FROM txn WHERE account_id = 'A3')
UNION ALL SELECT 'account_rows', '{"account_id":"A3","since":"2024-01-15"}', 'ok', (SELECT count(*) FROM txn WHERE account_id = 'A3' AND ts >= TIMESTAMP '2024-01-15')
UNION ALL SELECT 'account_rows', '{"account":"A3"}', 'error: TypeError', NULL""")
def audit_log(spark, sf):
    """Calls of tools that read the tables, one of them wrong, as the log on files has them."""
    log = published.Log(spark, shared_folder(spark), published.CALLS)
    rows = txns(spark, sf)

    def account_rows(account_id: str, since: str = "1970-01-01") -> DataFrame:
        return rows.filter((F.col("account_id") == account_id) & (F.col("ts") >= F.lit(since).cast("timestamp_ntz")))

    published.recorded(log, "chains", lambda min_amount: graph.find_chains(ledger.edges(spark, sf), min_amount=min_amount))(min_amount=100.0)
    tool = published.recorded(log, "account_rows", account_rows)
    tool(account_id="A3")
    tool(account_id="A3", since="2024-01-15")
    try:
        tool(account="A3")
    except TypeError:
        log.compact()
    return log.read().drop("ts")


@query("observed_conversion", """, s AS (SELECT account_id IN (SELECT id FROM truth) AS good FROM people WHERE user_id % 5 = 3)
SELECT count(*) AS closed, count(*) FILTER (good) AS confirmed, round(count(*) FILTER (good) / nullif(count(*), 0), 6) AS conversion FROM s""")
def observed_conversion(spark, sf):
    return rounded(scoring.conversion(cases.state(_case_events(spark, sf))))


@query("review_hours", _LABELLED + """, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS place FROM s)
SELECT b AS budget, count(*) * 0.5::DOUBLE AS hours, round(count(*) * 0.5::DOUBLE / nullif(sum(label), 0), 6) AS hours_per_find, round(sum(label) / count(*), 6) AS ceiling
FROM r, (SELECT unnest([10, 25, 50, 100])::BIGINT AS b) WHERE place <= b GROUP BY b""")
def review_hours(spark, sf):
    return rounded(scoring.review_hours(scoring.at_budgets(labelled(spark, sf))))


@query("combined_comparison", _SIGNALS + f"""l AS (SELECT account_id, CAST(account_id IN (SELECT id FROM truth) AS BIGINT) AS label FROM people),
universe AS (SELECT account_id FROM (SELECT account_id, row_number() OVER (PARTITION BY label ORDER BY {_num("account_id", "42")}) <= floor(count(*) OVER (PARTITION BY label) * 0.3::DOUBLE) AS test FROM l) WHERE test), t AS (SELECT DISTINCT id FROM truth WHERE id IN (FROM universe)),
ranked AS (SELECT source, account_id, contribution AS score FROM strongest UNION ALL SELECT 'combined', account_id, round(sum({_WEIGHT} * contribution) * 100, 2) FROM strongest GROUP BY 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, account_id) AS place FROM ranked WHERE account_id IN (FROM universe))
SELECT source, b AS budget, count(*) AS reviewed, count(*) FILTER (account_id IN (FROM t)) AS hits, round(count(*) FILTER (account_id IN (FROM t)) / count(*), 6) AS precision,
  round(count(*) FILTER (account_id IN (FROM t)) / (SELECT count(*) FROM t), 6) AS recall FROM placed, (SELECT unnest([10, 25, 50])::BIGINT AS b) WHERE place <= b GROUP BY 1, 2""")
def combined_comparison(spark, sf):
    universe = ml.stratified_split(_labelled_accounts(spark, sf)).filter("test").select("account_id")
    return rounded(scoring.combined_comparison(signals(spark, sf), scores(spark, sf), truth(spark, sf), universe))


@query("typology_at_budget", _SCORES + """, top AS (SELECT account_id FROM scores ORDER BY score DESC, account_id LIMIT 25)
SELECT typology, count(*) AS schemes, count(*) FILTER (met) AS caught, round(count(*) FILTER (met) / count(*), 6) AS recall FROM (SELECT typology, scheme_id, bool_or(id IN (FROM top)) AS met FROM truth GROUP BY 1, 2) GROUP BY 1""")
def typology_at_budget(spark, sf):
    top = scores(spark, sf).orderBy(F.desc("score"), "account_id").limit(25).select(F.col("account_id").alias("id"))
    return rounded(scoring.recall_by(top, truth(spark, sf)))


@query("bar_order", "SELECT channel AS label, count(*) AS value, row_number() OVER (ORDER BY count(*) DESC, channel) AS place FROM txn GROUP BY 1")
def bar_order(spark, sf):
    return rounded(scoring.bars(txns(spark, sf).groupBy(F.col("channel").alias("label")).agg(F.count("*").alias("value"))))


@query("banks_apart", _POOL + " SELECT " + _num("account_id", "5") + " % 4 AS bank, count(*) AS n, count(DISTINCT account_id) AS accounts FROM txn GROUP BY 1")
def banks_apart(spark, sf):
    """Banks written as files of their own, each read by itself."""
    bank = ledger.from_driver(spark, sf)
    folder = shared_folder(spark)
    ledger.split_into_banks(bank, world.assign_banks(bank.accounts), folder)
    out = None
    for k in range(4):
        if path_exists(spark, f"{folder}/transactions/bank={k}"):
            own = spark.read.parquet(f"{folder}/transactions/bank={k}")
            row = own.agg(F.count("*").alias("n"), F.count_distinct("account_id").alias("accounts")).select(F.lit(k).alias("bank"), "n", "accounts")
            out = row if out is None else out.unionByName(row)
    return rounded(out)


@query("reloaded_ledger", "SELECT account_id, count(*) AS n, sum(amount)::DOUBLE AS total FROM txn GROUP BY 1")
def reloaded_ledger(spark, sf):
    """The ledger appended to files in two parts, and opened again."""
    rows, folder = posted(spark, sf), shared_folder(spark)
    for part in (0, 1):
        ledger.append(rows.filter(F.col("txn_id") % 2 == part), folder, "transactions")
    again = ledger.open_ledger(spark, folder).transactions
    return rounded(again.groupBy("account_id").agg(F.count("*").alias("n"), F.sum("amount").alias("total")))
