"""Near-duplicate links on whole sets, by rare shingles and by HyperMinHash, against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewell.llm import common, hyperminhash, queries, set_links, simhash, simhash_groups


def roots(sets, linked):
    """The least key of each key's component, all pairs compared."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in sets}


def templates(seed):
    """Families of texts whose own words put many pairs just above and just below 0.8."""
    rng = random.Random(seed)
    texts = []
    for own in (1, 4, 8, 10, 11, 14):
        base = [f"t{own}_{k}" for k in range(150)]
        for _ in range(14):
            words = list(base)
            at = rng.randrange(0, 130)
            words[at : at + rng.choice((own, own + 1))] = [f"u{rng.randrange(400)}" for _ in range(own)]
            texts.append(" ".join(words))
    for k in range(12):  # a line in short pages
        texts.append(f"p{k} all rights are kept by the makers of this site")
        texts.append(f"all rights are kept by the makers of this site {k % 5} q{k}")
    base = [f"c{k}" for k in range(120)]
    for k in range(20):  # a chain: neighbours are near, ends are not
        texts.append(" ".join(base[k * 4 : k * 4 + 40 + k % 3]))
    rng.shuffle(texts)
    return texts + ["", None, " \n", "One two", "one  TWO", "one two three", "x " * 3000]


def stored(spark, tmp_path, rows, schema="doc_id long, text string"):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


@pytest.mark.parametrize("heavy, hot, block", [(1000, 4000, 2000), (1, 4000, 3), (1, 3, 5), (1000, 4000, 3)])
def test_groups_at_the_threshold(spark, tmp_path, monkeypatch, heavy, hot, block):
    monkeypatch.setattr(simhash_groups, "HEAVY_ONE_IN", heavy)
    monkeypatch.setattr(simhash_groups, "HOT_KEY", hot)
    monkeypatch.setattr(set_links, "BLOCK", block)
    d = stored(spark, tmp_path, list(enumerate(templates(heavy + hot))))
    numbered = {r.row: r.text for r in d.select(F.monotonically_increasing_id().alias("row"), "text").collect()}
    sets = {k: simhash_groups.shingles((t or "").encode().lower().split()) for k, t in numbered.items()}
    want = roots(sets, set_links.similar)
    assert {r.row: r.root for r in simhash_groups.groups(d).collect()} == want
    assert 60 < len(set(want.values())) < len(want) - 40


@pytest.mark.parametrize("heavy, most, block", [(1000, 2000, 2000), (1, 2000, 3), (1, 2, 5)])
def test_hyperminhash_at_the_threshold(spark, tmp_path, monkeypatch, heavy, most, block):
    monkeypatch.setattr(hyperminhash, "HEAVY_ONE_IN", heavy)
    monkeypatch.setattr(hyperminhash, "MOST_OF_A_KEY", most)
    monkeypatch.setattr(set_links, "BLOCK", block)
    texts = templates(7)
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(texts)]
    d = stored(spark, tmp_path, rows, "doc_id long, text string, size string, sketch string, component_id string")
    sets = {i: set_links.shingles((t or "").encode().lower().split(), 4) if (t or "").split() else set() for i, t in enumerate(texts)}
    want = roots(sets, lambda a, b: bool(a) and bool(b) and set_links.similar(a, b))
    got = {r.doc_id: r for r in hyperminhash.near_duplicates(d).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), want[i], want[i] == i) for i, s in sets.items()}


def test_hyperminhash_of_odd_rows(spark, tmp_path):
    rows = [(3, "a b c d e"), (1, "A  b\tc d E"), (1, "a b c d e"), (None, "a b c d e"), (None, "only here"), (None, None), (7, None), (7, ""), (9, "é" * 50_000)]
    got = hyperminhash.near_duplicates(stored(spark, tmp_path, rows))
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(3, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True), (7, 0, 7, True), (9, 1, 9, True)], key=str
    )
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "none"))
    assert hyperminhash.near_duplicates(spark.read.parquet(str(tmp_path / "none"))).count() == 0


def test_registers_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(5)
    for n in (3, 40, 300, 5000):
        for shared in (0.3, 0.8, 0.95):
            agree, total, exact = 0, 0, 0.0
            for _ in range(40):
                both = max(1, round(n * shared))
                hashes = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
                a, b = hashes[:n], np.concatenate([hashes[:both], hashes[n : 2 * n - both]])
                x, y = hyperminhash.registers(a), hyperminhash.registers(b)
                agree, total, exact = agree + int((x == y).sum()), total + len(x), exact + both / (2 * n - both) / 40
            estimate = hyperminhash.estimates(np.array([agree / total * hyperminhash.REGISTERS]), n, np.array([n]))[0]
            assert abs(estimate - exact) < 0.03
    assert hyperminhash._stored(np.array([0, 1, 1 << 39, (1 << 40) - 1], np.uint64)).tolist() == [40 << 9, 39 << 9, 0, 511]


def test_texts_of_one_template_do_not_meet(spark, tmp_path):
    """A third of all rows has one line; no pair of it is near, and none is a candidate."""
    rows = [f"the site is made by our good team here u{i}" for i in range(3000)]
    d = stored(spark, tmp_path, list(enumerate(rows)))
    numbered = d.select(F.monotonically_increasing_id().alias("row"), "text")
    known, counts, heavy = simhash_groups.common_shingles(numbered)
    schema = "row long, same binary, size long, low long, high long, bits binary, keys array<long>, n_light long"
    prints = common.cut(numbered.mapInArrow(lambda b: simhash_groups._prints(b, known, counts, heavy), schema))
    assert simhash_groups.candidates(prints).count() == 0


def test_recall_on_documents(spark):
    """Every pair of sf0.01 at or over 0.8, found by comparing all, is in one group."""
    d = common.read(spark, "/root/testdata/sf0.01", "documents")
    numbered = {r.row: r.text for r in d.select(F.monotonically_increasing_id().alias("row"), "text").collect()}
    sets = {k: simhash_groups.shingles((t or "").encode().lower().split()) for k, t in numbered.items()}
    post = {}
    for k, s in sets.items():
        for x in s:
            post.setdefault(x, []).append(k)
    met = {(a, b) for rows in post.values() if len(rows) > 1 for a in rows for b in rows if a < b}
    want = [p for p in met if set_links.similar(sets[p[0]], sets[p[1]])]
    root = {r.row: r.root for r in simhash_groups.groups(d).collect()}
    assert len(want) > 50 and all(root[a] == root[b] for a, b in want)


def test_query_is_the_operator(spark):
    rows = queries.op13_hyperminhash(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in common.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for i, t in texts.items()}
    sets = {i: {" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set() for i, w in words.items()}
    want = roots(sets, lambda a, b: bool(a) and bool(b) and 100 * len(a & b) >= 80 * len(a | b))
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_texts_go_to_python_in_bounded_batches(spark, tmp_path, monkeypatch):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 20)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["n"])

    spark.createDataFrame([(i, "x" * 10_000) for i in range(500)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.unset(key)
    try:
        d = common.read(spark, str(tmp_path), "documents")
        assert sum(found := [r.n for r in d.mapInArrow(sizes, "n long").collect()]) == 500 and max(found) <= 110
        spark.conf.set(key, "2m")
        common.bounded_batches(spark)
        assert spark.conf.get(key) == "2m"
    finally:
        spark.conf.unset(key)


def test_pairs_of_a_large_group_are_not_listed():
    """Of possible pairs that are no links, only a forest leaves; links come as a forest too."""
    n = 300
    one, many = np.arange(n), np.full(n, 100)
    zero = np.zeros(n, np.uint64)
    found = np.concatenate(set_links._block([one, one, many, np.zeros(n, int), zero, zero, np.zeros(n, int)]), axis=1)
    assert found.shape == (2, n - 1)
    sets = [np.sort(np.arange(k, k + 100).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for k in range(n)]
    rng = np.random.default_rng(3)
    for two in (False, True):
        block = np.sort(rng.integers(0, 2, n)) if two else np.zeros(n, int)
        order = rng.permutation(n)
        links = np.concatenate(set_links._links_of(order, order, block, [sets[k] for k in order]), axis=1)
        of = dict(zip(order.tolist(), block.tolist(), strict=True))
        assert links.shape[1] <= n - 1 and all(set_links.similar(set(sets[a].tolist()), set(sets[b].tolist())) for a, b in links.T.tolist())
        want = roots({k: k for k in range(n)}, lambda a, b: abs(a - b) <= 11 and (not two or of[a] != of[b]))
        pairs = {frozenset(p) for p in links.T.tolist()}
        assert roots({k: k for k in range(n)}, lambda a, b: frozenset((a, b)) in pairs) == want


def test_pipeline_stage_takes_candidates_from_simhash(spark, tmp_path, monkeypatch):
    """Close copies meet by their fingerprints' bytes; what differs in more bits is found all the same."""
    rng = random.Random(4)
    texts = []
    for k in range(12):
        words = [f"w{k}_{i}" for i in range(400)]
        near = words[:-1] + ["other"]
        far = words[:-40] + [f"v{k}_{rng.random()}" for _ in range(40)]
        texts += [" ".join(x) for x in (words, near, far)]
    d = stored(spark, tmp_path, list(enumerate(texts)))
    seen, search = [], simhash.links

    def links(prints):
        seen.append(search(prints).count())
        return search(prints)

    monkeypatch.setattr(simhash, "links", links)
    numbered = {r.row: r.text for r in d.select(F.monotonically_increasing_id().alias("row"), "text").collect()}
    sets = {k: simhash_groups.shingles(t.encode().split()) for k, t in numbered.items()}
    assert {r.row: r.root for r in simhash_groups.groups(d).collect()} == roots(sets, set_links.similar)
    prints = common.cut(simhash.fingerprints(d, 5).withColumnRenamed("doc_id", "row"))
    assert len(seen) == 1 and simhash_groups.near_prints(prints).count() >= 10
