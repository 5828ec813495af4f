"""Prefix tries and source divergence against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, divergence, prefix_trie, queries

# --- prefix trie -----------------------------------------------------------------------------


def plain_trie(rows):
    """rows: (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}"
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(said.encode()).digest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5 * (1 if c >= 0 else -1))
        whole[c] = own.get(base, [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    out = []
    for path, convs in members.items():
        under = [p for p in members if p[: len(path)] == path]
        ends = ",".join(map(str, sorted(c for c in convs if len(whole[c]) == len(path))))
        out.append((
            min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), children[path], sum(children[p] == 0 for p in under),
            sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in under), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def found(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, df.select(names).collect()))


SCHEMA = "conv_id long, turn long, role string, text string, digest string, pos string, fp string, bytes string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def turns():
    rows = [(None, 1, "user", "no conversation"), (7, None, None, None), (7, None, "user", "first of null turns"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, "user", "other tie")]
    for c in range(-12, 40):
        for t in range((c * 7) % 11):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "" if (c + t) % 9 == 0 else f"é text {t % 4} of {(c // 5) % 3 if t < 3 else c % 4}"))
    rows += [(100 + k, 0, "user", "the same turn") for k in range(60)] + [(200, t, "user", f"long {t}") for t in range(700)] + [(201, t, "user", "x" * 50_000) for t in range(2)]
    rows += [(9 * 10**9 + k * 5000, 0, "user", "far apart") for k in range(4)]
    return rows


def test_trie_of_odd_rows(spark):
    rows = turns()
    assert found(prefix_trie.trie(table(spark, rows))) == plain_trie(rows)
    assert found(prefix_trie.trie(table(spark, []))) == []
    assert found(prefix_trie.trie(table(spark, [(None, 1, "a", "b")]))) == []


def test_collisions_are_split(spark, monkeypatch):
    """Moduli so small that unlike prefixes collide: further bases tell them apart."""
    rounds = []
    whole = prefix_trie.fingerprinted
    monkeypatch.setattr(prefix_trie, "fingerprinted", lambda t, bases, primes: (rounds.append(len(bases)), whole(t, bases, primes))[1])
    rows = turns()[:300]
    assert found(prefix_trie.trie(table(spark, rows), primes=(7, 11))) == plain_trie(rows)
    assert len(rounds) > 1


def test_lists_of_ids_cross_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 2)
    rows = [(c, 0, "user", "one turn") for c in range(-40, 130)]
    assert found(prefix_trie.trie(table(spark, rows))) == plain_trie(rows)


def test_query_is_the_trie(spark):
    rows = [tuple(r) for r in common.read(spark, "/root/testdata/sf0.01", "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op12_prefix_trie(spark, "/root/testdata/sf0.01")) == plain_trie(rows)


# --- divergence ------------------------------------------------------------------------------


def plain_audit(rows, min_docs, k):
    """rows: (lang, source, text)."""
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs:
        kept = {t for t, n in docs[lang].items() if n >= min_docs}
        groups = {g: Counter({t: n for t, n in c.items() if t in kept}) for g, c in counts.items() if g[0] == lang}
        whole = sum(groups.values(), Counter())
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        shares, q = {g: share(c) for g, c in groups.items()}, share(whole)
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for g, p in shares.items():
            pairs = [(h[1], sum(f(p[t], shares[h][t]) for t in kept)) for h in shares if h != g]
            terms = [(t, f(p[t], q[t])) for t in kept if groups[g][t] and p[t] > q[t]]
            for part, found_, top in (("pair", pairs, None), ("term", terms, k)):
                ranked = sorted(found_, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(*g, part, item, value, n + 1) for n, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize("block, slice_rows, octave", [(256, 100_000, 4), (2, 7, 1)])
def test_audit_of_odd_rows(spark, monkeypatch, block, slice_rows, octave):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(divergence, "IN_OCTAVE", octave)
    rows = [(None, None, None), ("", "", "empty lang joins null"), ("en", None, "AND and ÀND àñd x1y2z"), ("de", "only", ""), ("xx", "a", "rare words here"), ("xx", "b", "1234 !!"), ("en", "none", "... 12")]
    for k in range(120):
        words = [f"w{chr(97 + (k * j) % 26)}{chr(97 + j % 7)}" for j in range(1 + k % 17)] + ["the"] * (k % 5) + ["Été", "日本"] * (k % 3)
        rows.append((("en", "fr")[k % 2], f"s{k % 6}", " ".join(words) + ("," if k % 4 else "\n")))
    rows += [("en", "s1", "long " * 40_000)] * 3
    schema = "lang string, source string, text string, term string, n string, p string, value string"
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema).repartition(3)
    assert sorted(map(tuple, divergence.audit(df, 3, 4).collect())) == plain_audit(rows, 3, 4)


def test_audit_of_no_rows(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_counts_beyond_a_long(spark):
    """A share's numerator passes 2^63 with ten thousand million occurrences; it is exact all the same."""
    big = 9_300_000_000_001
    got = spark.range(1).select(divergence._share(f"{big}L", f"{3 * big}L", "7L").alias("p")).first().p
    assert got == 1 + 10**9 * (big + 2) // (3 * big + 14)


def test_only_open_buckets_are_evaluated(spark):
    """Buckets whose bound is below the kth value are left out, and the result is that of all terms."""
    rows = [("en", "a", "t" + "abcdefghijklmnopqrstuvwxyz"[i % 26] + "abcdefghij"[i // 26], i, 10 + 50 * i, 5_000_000 // (1 + i)) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "lang string, source string, term string, term_id long, p long, q long").withColumn("n", F.col("term_id")).withColumn("idx", F.lit(0))
    want = sorted(((-((p - q) ** 2 // (p + q)), t) for _, _, t, _, p, q in rows if p > q))[:10]
    assert [(-r.value, r.item) for r in divergence.top_terms(df).orderBy("rank").collect()] == want


def test_query_is_the_audit(spark):
    rows = [tuple(r) for r in common.read(spark, "/root/testdata/sf0.001", "documents").select("lang", "source", "text").collect()]
    assert sorted(map(tuple, queries.op11_divergence(spark, "/root/testdata/sf0.001").collect())) == plain_audit(rows, 10, 10)
