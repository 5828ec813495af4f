"""Generated banks with labelled schemes, from digests: the same (n, seed) is the same world on any
cluster. Uniform draws are digests of ids, so every row is made where it is needed.

Postings never overdraw: an account opens with what its lowest point needs. (Admission of
events one by one, each against both balances, is sequential over all accounts and is not done.)
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ledger import signed

# The segments' shares of the population.
SHARES = (("salaried", 0.50), ("student", 0.20), ("merchant", 0.15), ("business", 0.10), ("nri", 0.05))
FIRST = ("Aarav", "Vivaan", "Aditya", "Ishaan", "Kabir", "Rohan", "Meera", "Ananya", "Diya", "Sana", "Farhan", "Imran", "Priya", "Kavya", "Neha", "Suresh")
LAST = ("Sharma", "Verma", "Gupta", "Iyer", "Nair", "Khan", "Singh", "Patel", "Reddy", "Das", "Mehta", "Joshi", "Kulkarni", "Bose", "Ali", "Rao")
CITIES = ("Mumbai", "Delhi", "Bengaluru", "Chennai", "Pune", "Kolkata")
START = "2024-01-01 00:00:00"


def number(*parts) -> Column:
    """A whole number below 2^52 from a digest of the parts, which any SQL engine can make too."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(c.cast("string") for c in cols))), 1, 13), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """A number in [0, 1) from a digest of the parts."""
    return number(*parts) / F.lit(float(1 << 52))


def pick(options: tuple[str, ...], *parts) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), (F.floor(uniform(*parts) * len(options)) + 1).cast("int"))


def people(ids: DataFrame, seed: int = 42) -> DataFrame:
    """A customer with one account for each ``id``."""
    u, segment, upto = uniform(F.col("id"), seed, "segment"), F.lit(SHARES[-1][0]), 1.0
    for name, share in reversed(SHARES):
        segment = F.when(u < round(upto, 4), name).otherwise(segment)
        upto -= share
    return ids.select(
        F.col("id"), F.format_string("C%08d", "id").alias("customer_id"), F.format_string("A%08d", "id").alias("account_id"), segment.alias("segment"),
        F.concat_ws(" ", pick(FIRST, F.col("id"), seed, "first"), pick(LAST, F.col("id"), seed, "last")).alias("full_name"), pick(CITIES, F.col("id"), seed, "city").alias("city"),
    )


def population(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """n customers with one account each."""
    return people(spark.range(n), seed)


def moment(day: Column, *parts) -> Column:
    """A time of that day by hash."""
    return F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(day.cast("int"), F.lit(0), F.lit(0), F.floor(uniform(*parts) * 86_399).cast("decimal(18,6)"))


@dataclass(frozen=True)
class Habit:
    """Something that customers of some segments do with a chance once in ``every`` days, on a day of
    that period from ``first`` to ``last``."""

    name: str
    segments: tuple[str, ...]
    direction: str
    channel: str
    every: int
    first: int
    last: int
    chance: float
    low: float
    high: float


HABITS = (
    Habit("salary", ("salaried", "nri"), "CR", "NEFT", 30, 0, 2, 1.0, 30_000, 120_000),
    Habit("rent", ("salaried", "student", "nri"), "DR", "IMPS", 30, 2, 5, 0.55, 8_000, 30_000),
    Habit("emi", ("salaried", "business"), "DR", "NACH", 30, 4, 7, 0.40, 5_000, 20_000),
    Habit("atm", ("salaried", "student", "merchant"), "DR", "ATM", 7, 0, 6, 1.0, 500, 6_000),
    Habit("remittance", ("nri",), "CR", "INT", 30, 0, 29, 0.8, 20_000, 90_000),
    Habit("big-ticket", ("salaried", "nri"), "DR", "NEFT", 30, 0, 29, 0.30, 40_000, 150_000),
    Habit("footfall", ("merchant",), "CR", "UPI", 1, 0, 0, 0.9, 100, 4_000),
    Habit("receipts", ("business",), "CR", "NEFT", 1, 0, 0, 0.35, 10_000, 120_000),
    Habit("takings", ("business", "merchant"), "CR", "CASH", 1, 0, 0, 0.4, 10_000, 90_000),
    Habit("shopping", tuple(s for s, _ in SHARES), "DR", "UPI", 1, 0, 0, 0.5, 50, 2_500),
)


def life_events(people: DataFrame, days: int, seed: int = 42) -> DataFrame:
    """Unposted rows of ordinary life."""
    parts = []
    for h in HABITS:
        key = (F.col("account_id"), F.col("k"), F.lit(seed), F.lit(h.name))
        own = people.filter(F.col("segment").isin(*h.segments)).select("account_id", F.explode(F.sequence(F.lit(0), F.lit(-(-days // h.every) - 1))).alias("k"))
        own = own.filter(uniform(*key) < h.chance).withColumn("day", F.col("k") * h.every + h.first + F.floor(uniform(*key, "day") * (h.last - h.first + 1)))
        parts.append(own.filter(F.col("day") < days).select(
            "account_id", moment(F.col("day"), *key, "ts").alias("ts"), F.lit(h.direction).alias("direction"), F.lit(h.channel).alias("channel"),
            (h.low + uniform(*key, "amount") * (h.high - h.low)).cast("decimal(15,2)").alias("amount"), F.concat(F.lit(f"{h.name} "), pick(LAST, *key, "cp")).alias("counterparty_name"),
            F.concat_ws("/", F.lit(h.channel), F.lit(h.direction), number(*key) % 1_000_000, F.lit(h.name)).alias("narration"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.unionByName(friends(people, days, seed))


def friends(people: DataFrame, days: int, seed: int = 42) -> DataFrame:
    """Payments between neighbours on a ring in hash order, both legs. Places on the ring come from
    the ids themselves, which are dense, so no row order over all customers is needed."""
    n = people.agg(F.count("*").alias("n"))
    ring = people.select("id", "account_id")
    pairs = ring.crossJoin(F.broadcast(n)).select("account_id", ((F.col("id") + 1) % F.col("n")).alias("id")).join(ring.withColumnRenamed("account_id", "friend"), "id")
    paid = pairs.withColumn("day", F.floor(uniform(F.col("account_id"), seed, "day") * days)).filter((uniform(F.col("account_id"), seed, "p2p") < 0.35) & (F.col("account_id") != F.col("friend")))
    amount = (100 + uniform(F.col("account_id"), seed, "p2p amount") * 2_900).cast("decimal(15,2)")
    at = moment(F.col("day"), F.col("account_id"), seed, "p2p ts")
    ref = (number(F.col("account_id"), seed) % 1_000_000).cast("string")
    legs = []
    for side, me, other in (("DR", "account_id", "friend"), ("CR", "friend", "account_id")):
        legs.append(paid.select(
            F.col(me).alias("account_id"), at.alias("ts"), F.lit(side).alias("direction"), F.lit("UPI").alias("channel"), amount.alias("amount"),
            F.col(other).alias("counterparty_name"), F.concat_ws("/", F.lit("UPI"), F.lit(side), ref, F.lit("p2p")).alias("narration"),
        ))
    return legs[0].unionByName(legs[1])


def post(rows: DataFrame) -> DataFrame:
    """Rows as transactions: ids in order of each account's time, openings that cover the lowest
    point, and running balances. An id is the account's number times a million, and the row's place."""
    by = Window.partitionBy("account_id").orderBy("ts", "narration", "amount", "direction")
    run = rows.withColumns({"run": F.sum(signed()).over(by.rowsBetween(Window.unboundedPreceding, 0)), "place": F.row_number().over(by)})
    low = F.min("run").over(Window.partitionBy("account_id"))
    return run.withColumns({
        "txn_id": F.substring("account_id", 2, 20).cast("long") * 1_000_000 + F.col("place"),
        "balance_after": (F.col("run") + F.greatest(-low, F.lit(0)) + 1000).cast("decimal(15,2)"),
        "counterparty_ref": F.lit(None).cast("string"),
    }).drop("run", "place")


def partition_pool(people: DataFrame, sizes: dict[str, int], seed: int = 42) -> DataFrame:
    """``account_id``, ``use``, ``place``: disjoint sets of accounts of these sizes; raises if too few."""
    total = sum(sizes.values())
    order = (number(F.col("account_id"), seed), F.col("account_id"))
    chosen = people.orderBy(*order).limit(total)
    if chosen.count() < total:
        raise ValueError(f"{total} accounts are asked for, and there are fewer")
    place = F.row_number().over(Window.orderBy(*order)) - 1  # over the chosen few
    use, start = F.lit(None).cast("string"), 0
    for name, size in sizes.items():
        use = F.when(F.col("at").between(start, start + size - 1), name).otherwise(use)
        start += size
    return chosen.withColumn("at", place).select("account_id", use.alias("use"), F.col("at").alias("place"))


def _steps(accounts: DataFrame, kind: str, seed: int, n: Column) -> DataFrame:
    """accounts with a row for each step of a scheme of theirs."""
    steps = F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("step")
    return accounts.select("*", F.concat(F.lit(f"{kind}-"), "account_id").alias("scheme_id"), n.cast("int").alias("n"), steps).withColumn("seed", F.lit(seed))


def _draw(what: str) -> Column:
    """A draw of a scheme's step."""
    return uniform(F.col("scheme_id"), F.col("step"), F.col("seed"), what)


def _rows(df: DataFrame, kind: str, direction, channel: str, ts: Column, amount: Column, party) -> DataFrame:
    side = direction if isinstance(direction, Column) else F.lit(direction)
    ref = number(F.col("scheme_id"), F.col("step"), F.col("seed"), "ref") % 1_000_000
    return df.select(
        "account_id", ts.alias("ts"), side.alias("direction"), F.lit(channel).alias("channel"), amount.cast("decimal(15,2)").alias("amount"),
        (party if isinstance(party, Column) else F.lit(party)).alias("counterparty_name"), F.concat_ws("/", F.lit(channel), side, ref, F.lit("x")).alias("narration"),
        "scheme_id", F.lit(kind).alias("typology"),
    )


def _uneven(total: Column, least: float = 0.5) -> Column:
    """Shares of a scheme's total, uneven, that sum to it exactly: the last step takes what is left."""
    part = least + _draw("part")
    by = Window.partitionBy("scheme_id")
    own = F.round(total * part / F.sum(part).over(by), 2).cast("decimal(15,2)")
    rest = total.cast("decimal(15,2)") - F.sum(F.when(F.col("step") < F.col("n") - 1, own)).over(by)
    return F.when(F.col("step") < F.col("n") - 1, own).otherwise(rest)


def hours(n: Column) -> Column:
    """An interval of hours, in whole seconds."""
    return F.make_dt_interval(secs=F.floor(n * 3600).cast("decimal(18,6)"))


def structuring(accounts: DataFrame, seed: int = 1, ceiling: float = 95_000, window_days: int = 20, low: int = 27, high: int = 47) -> DataFrame:
    """Cash deposits of 0.35 to 1 of a ceiling, spread over a window."""
    d = _steps(accounts, "structuring", seed, low + F.floor(uniform(F.col("account_id"), seed, "n") * (high - low)))
    return _rows(d, "structuring", "CR", "CASH", moment(F.floor(_draw("day") * window_days), F.col("scheme_id"), F.col("step"), seed, "ts"), (0.35 + 0.65 * _draw("amount")) * ceiling, "SELF")


def layering(chains: DataFrame, seed: int = 1, total: float = 900_000, cut: tuple[float, float] = (0.03, 0.08), gap_hours: tuple[float, float] = (2, 30)) -> DataFrame:
    """(chain_id, account_ids): money enters the first account and is passed on, each hop keeping a cut and
    waiting some hours. ``role`` is source, mule or sink. A chain of fewer than two accounts raises."""
    size = F.size("account_ids")
    hops = F.when(size < 2, F.raise_error(F.lit("a chain needs two accounts")).cast("int")).otherwise(size)
    d = chains.select(F.concat(F.lit("layering-"), "chain_id").alias("scheme_id"), F.lit(seed).alias("seed"), "account_ids", hops.alias("n"), F.explode(F.sequence(F.lit(0), hops - 1)).alias("step"))
    far = Window.partitionBy("scheme_id").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    enters = F.col("step") == 0  # step 0 is the entry, step k the hop from account k - 1 to k
    kept = F.when(enters, 0.0).otherwise(F.log(1 - (cut[0] + _draw("cut") * (cut[1] - cut[0]))))
    wait = F.when(enters, 0.0).otherwise(F.floor((gap_hours[0] + _draw("gap") * (gap_hours[1] - gap_hours[0])) * 3600))
    d = d.withColumns({"amount": F.lit(total) * F.exp(F.sum(kept).over(far)), "wait": F.sum(wait).over(far), "ref": number(F.col("scheme_id"), F.col("step"), seed, "ref") % 1_000_000})
    ts = F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(F.lit(3)) + F.make_dt_interval(secs=F.col("wait").cast("decimal(18,6)"))
    me, before = F.get("account_ids", F.col("step")), F.get("account_ids", F.col("step") - 1)
    legs = []
    for side, own, other, rows in (("CR", me, F.coalesce(before, F.lit("CASH IN")), d), ("DR", before, me, d.filter("step > 0"))):
        at = F.col("step") if side == "CR" else F.col("step") - 1
        role = F.when(at == 0, "source").when(at == F.col("n") - 1, "sink").otherwise("mule")
        legs.append(rows.select(
            own.alias("account_id"), ts.alias("ts"), F.lit(side).alias("direction"), F.lit("IMPS").alias("channel"), F.col("amount").cast("decimal(15,2)").alias("amount"), other.alias("counterparty_name"),
            F.concat_ws("/", F.lit("IMPS"), F.lit(side), "ref", F.lit("x")).alias("narration"), "scheme_id", F.lit("layering").alias("typology"), role.alias("role"),
        ))
    return legs[0].unionByName(legs[1])


def shell_company(accounts: DataFrame, seed: int = 1, total: float = 3_000_000, low: int = 3, high: int = 8) -> DataFrame:
    """Some uneven invoices from one name, which sum to the total exactly."""
    d = _steps(accounts, "shell", seed, low + F.floor(uniform(F.col("account_id"), seed, "n") * (high - low + 1)))
    ts = moment(F.col("step") * 3, F.col("scheme_id"), F.col("step"), seed, "ts")
    return _rows(d, "shell", "CR", "NEFT", ts, _uneven(F.lit(total)), F.concat(F.lit("SHELL "), "scheme_id"))


def round_tripping(accounts: DataFrame, seed: int = 1, amount: float = 50_000, days: tuple[float, float] = (2, 10)) -> DataFrame:
    """RTGS out, and back some days later with 2 to 10 percent more. Accounts may have a ``ceiling``, what
    they can spare: no more leaves them."""
    d = _steps(accounts, "round_trip", seed, F.lit(2))
    out = F.least(F.lit(amount), F.col("ceiling")) if "ceiling" in accounts.columns else F.lit(amount)
    out = F.round(out, 2)
    once = lambda what: uniform(F.col("scheme_id"), seed, what)
    second = F.col("step") == 1
    ts = moment(F.lit(3), F.col("scheme_id"), seed, "ts") + hours(F.when(second, (days[0] + once("days") * (days[1] - days[0])) * 24).otherwise(0.0))
    back = out * (1.02 + once("more") * 0.08)
    return _rows(d, "round_trip", F.when(second, "CR").otherwise("DR"), "RTGS", ts, F.when(second, back).otherwise(out), "OVERSEAS HOLDINGS").filter("amount > 0")


def dormant_reactivation(accounts: DataFrame, seed: int = 1, amount: float = 60_000, gap_days: tuple[float, float] = (3, 10)) -> DataFrame:
    """A credit after quiet days, and within hours two to four uneven debits of 90 to 97 percent of it.
    Accounts may have ``last_ts``, when they were last used; else the ledger's start counts."""
    once = lambda what: uniform(F.col("scheme_id"), seed, what)
    d = _steps(accounts, "dormant", seed, 2 + F.floor(uniform(F.col("account_id"), seed, "n") * 3))
    last = F.col("last_ts") if "last_ts" in accounts.columns else F.lit(START).cast("timestamp_ntz")
    start = last + hours((gap_days[0] + once("gap") * (gap_days[1] - gap_days[0])) * 24)
    paid = _uneven(F.round(F.lit(amount) * (0.90 + once("share") * 0.07), 2))
    debits = _rows(d, "dormant", "DR", "IMPS", start + hours(1 + F.col("step") * 4 + _draw("wait") * 3), paid, "UNKNOWN SENDER")
    credit = _rows(d.filter("step = 0").withColumn("step", F.lit(-1)), "dormant", "CR", "IMPS", start, F.lit(amount), "UNKNOWN SENDER")
    return credit.unionByName(debits)


def geography(accounts: DataFrame, watchlist: tuple[str, ...], seed: int = 1, budget: float = 90_000) -> DataFrame:
    """One to three international legs that name a listed jurisdiction. Debits share one budget evenly, or
    the account's ``ceiling`` where accounts have it."""
    d = _steps(accounts, "geography", seed, 1 + F.floor(uniform(F.col("account_id"), seed, "n") * 3))
    room = F.least(F.lit(budget), F.col("ceiling")) if "ceiling" in accounts.columns else F.lit(budget)
    out = _draw("side") < 0.5
    amount = F.when(out, F.floor(room / F.col("n") * (0.5 + 0.5 * _draw("amount")))).otherwise(F.floor(20_000 + 60_000 * _draw("amount")))
    place = F.concat(pick(watchlist, F.col("scheme_id"), F.col("step"), seed, "place"), F.lit(" TRADING LLC"))
    rows = _rows(d, "geography", F.when(out, "DR").otherwise("CR"), "INT", moment(5 + F.col("step"), F.col("scheme_id"), F.col("step"), seed, "ts"), amount, place)
    return rows.filter("amount > 0")


def name_variant(name: Column, kind: str) -> Column:
    """exact, reordered, initials or transliteration of a name."""
    words = F.split(name, " ")
    if kind == "exact":
        return name
    if kind == "reordered":
        return F.array_join(F.reverse(words), " ")
    if kind == "initials":
        return F.array_join(F.transform(words, lambda w, i: F.when(i < F.size(words) - 1, F.substring(w, 1, 1)).otherwise(w)), " ")
    if kind == "transliteration":
        out = name
        for written, other in SPELLINGS:
            out = F.regexp_replace(out, written, other)
        return out
    raise ValueError(f"unknown kind of variant {kind!r}")


#: Spellings of one sound, first by first.
SPELLINGS = (("aa", "a"), ("ee", "i"), ("oo", "u"), ("sh", "s"), ("ph", "f"), ("kh", "k"), ("v", "w"), ("ay", "ai"), ("ck", "k"), ("y$", "i"), ("th", "t"), ("dh", "d"))
MATCH_KINDS = ("exact", "reordered", "initials", "transliteration")


def plant_entities(people: DataFrame, watchlist: DataFrame, n: int = 15, seed: int = 42) -> DataFrame:
    """``customer_id``, ``list_name``, ``list_type``, ``match_kind``, ``full_name``: n individuals renamed
    after entries, kinds taking turns."""
    chosen = people.filter(F.col("segment").isin("salaried", "student", "nri")).orderBy(number(F.col("account_id"), seed), "account_id").limit(n)
    place = chosen.withColumn("at", F.row_number().over(Window.orderBy("account_id")) - 1)
    entries = watchlist.withColumn("at0", F.row_number().over(Window.orderBy("position")) - 1)
    m = entries.count()
    met = place.join(entries, F.col("at") % m == F.col("at0"))
    kind = F.element_at(F.array(*map(F.lit, MATCH_KINDS)), (F.col("at") % len(MATCH_KINDS) + 1).cast("int"))
    full = F.lit(None).cast("string")
    for k in MATCH_KINDS:
        full = F.when(F.col("match_kind") == k, name_variant(F.col("name"), k)).otherwise(full)
    return met.withColumn("match_kind", kind).select("customer_id", F.col("name").alias("list_name"), F.col("type").alias("list_type"), "match_kind", full.alias("full_name"))


#: Adverse categories, and what an article of each says of its subject.
REPORTS = (("fraud", "charged over a loan fraud"), ("corruption", "named in a bribery inquiry"), ("tax", "searched for undeclared income"), ("smuggling", "held at the port over hidden cargo"))


def plant_media(people: DataFrame, true: int = 10, trap: int = 10, benign: int = 20, seed: int = 42) -> DataFrame:
    """Articles: true ones name a customer, traps a stranger of the same surname, benign ones anyone."""
    order = (number(F.col("account_id"), seed + 1), F.col("account_id"))
    chosen = people.orderBy(*order).limit(true + trap + benign)
    at = chosen.withColumn("at", F.row_number().over(Window.orderBy(*order)) - 1)  # over the chosen few
    kind = F.when(F.col("at") < true, "true").when(F.col("at") < true + trap, "trap").otherwise("benign")
    name = F.when(kind == "trap", F.concat(F.lit("Zeb "), F.substring_index("full_name", " ", -1))).otherwise(F.col("full_name"))
    report = F.element_at(F.array(*(F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in REPORTS)), (F.col("at") % len(REPORTS) + 1).cast("int"))
    told = F.when(kind == "benign", F.concat(name, F.lit(" opens a school library"))).otherwise(F.concat(name, F.lit(" "), report.t))
    return at.select(
        F.col("at").cast("long").alias("article_id"), moment(F.col("at") % 28, F.col("at"), seed, "article").alias("ts"), told.alias("headline"), F.concat(told, F.lit(", the paper reports.")).alias("body"),
        name.alias("mentioned_name"), F.when(kind == "benign", "none").otherwise(report.c).alias("category"), F.when(kind == "true", F.col("customer_id")).alias("customer_id"),
    )


#: A small fixed cast, for a world that can be read by eye.
CAST = (
    ("Asha Rao", "salaried"), ("Bharat Joshi", "business"), ("Chitra Nair", "student"), ("Dev Mehta", "salaried"), ("Esha Khan", "nri"),
    ("Faiz Ali", "merchant"), ("Gita Das", "salaried"), ("Hari Iyer", "business"), ("Indu Patel", "salaried"), ("Jai Singh", "student"),
    ("Kiran Bose", "salaried"), ("Lata Gupta", "merchant"), ("Mohan Reddy", "nri"), ("Nisha Verma", "salaried"), ("Om Sharma", "business"),
    ("Pia Kulkarni", "student"), ("Qadir Khan", "salaried"), ("Ravi Das", "salaried"), ("Sunita Rao", "merchant"), ("Tara Singh", "salaried"),
    ("Uma Nair", "nri"), ("Varun Joshi", "salaried"), ("Waseem Ali", "business"), ("Yash Mehta", "salaried"), ("Zoya Patel", "student"),
)


def cast(spark: SparkSession) -> DataFrame:
    """The cast as customers with one account each, like ``population``."""
    rows = [(i, f"C{i:08d}", f"A{i:08d}", segment, name, CITIES[i % len(CITIES)]) for i, (name, segment) in enumerate(CAST)]
    return spark.createDataFrame(rows, "id long, customer_id string, account_id string, segment string, full_name string, city string")


def assign_banks(accounts: DataFrame, n: int = 4, seed: int = 5) -> DataFrame:
    """``account_id``, ``bank`` by hash."""
    return accounts.select("account_id", (number(F.col("account_id"), seed) % n).cast("int").alias("bank"))


def plant_chains(mapping: DataFrame, chains: int = 12, length: int = 4, placement: str = "naive", banks: int = 4, seed: int = 5) -> DataFrame:
    """``chain_id``, ``account_ids``: naive chains take accounts as they come, deliberate ones change the
    bank with every hop. Accounts serve one chain only; raises if there are too few."""
    if placement not in ("naive", "deliberate"):
        raise ValueError(f"unknown placement {placement!r}")
    spark = mapping.sparkSession
    want = spark.range(chains * length).select((F.col("id") / length).cast("int").alias("c"), (F.col("id") % length).cast("int").alias("p"))
    order = number(F.col("account_id"), seed + 1)
    if placement == "naive":
        need = chains * length
        own = mapping.orderBy(order, "account_id").limit(need).withColumn("i", F.row_number().over(Window.orderBy(order, "account_id")) - 1)
        met = want.withColumn("i", F.col("c") * length + F.col("p")).join(own, "i")
    else:
        by = Window.partitionBy("bank").orderBy(order, "account_id")
        each = -(-length // banks)
        own = mapping.withColumn("i", F.row_number().over(by) - 1).filter(F.col("i") < chains * each)
        met = want.withColumns({"bank": (F.col("c") + F.col("p")) % banks, "i": F.col("c") * each + F.floor(F.col("p") / banks)}).join(own, ["bank", "i"])
    out = met.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "account_id"))), lambda x: x.account_id).alias("account_ids"))
    full = out.filter(F.size("account_ids") == length)
    if full.count() < chains:
        raise ValueError(f"too few accounts for {chains} chains of {length}")
    return full.select(F.concat(F.lit(f"{placement}-"), "c").alias("chain_id"), "account_ids")
