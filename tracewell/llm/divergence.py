"""Audit of how sources of a language differ in their terms.

Terms and their counts are taken once, in Arrow steps of many documents; a (language, source, term) row, a
posting, is all that is shuffled. Each group (language, source) and each language give every kept term a smoothed
share p, in whole thousand-millionths, and f(p, q) = floor((p - q)^2 / (p + q)) says how far two shares are apart.

Top terms of a group: its postings are in buckets by count. f grows with the group's share and falls with the
language's, so a bucket's largest share against its least share in the language bounds f for all its terms. Buckets are
taken best bound first: those that hold the first k terms give a kth value, and of the others only buckets
whose bound is not strictly below it are evaluated.

Pairs of sources: f summed over all kept terms, from postings alone. A language's sources are in blocks of at
most BLOCK, its postings in slices by term; a task has one slice of two blocks. Terms that one of the two lacks are
summed against its share of an absent term, terms that both lack are counted.

Defined results: null text, lang and source are empty. Repeated rows are documents like others. A group without terms
has shares of absent terms only; in a language without kept terms all values are zero. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, frequencies, tokens

SCALE = 1_000_000_000
MIN_DOCS, TOP = 10, 10
#: Sources of a block, and postings, about, of a slice.
BLOCK, SLICE_ROWS = 256, 100_000
#: Buckets of counts in an octave.
IN_OCTAVE = 4
#: Bytes of texts to bytes of terms: A-Z to a-z, all others below 128 but letters to a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _grouped(table: pa.Table) -> pa.Table:
    sums = table.group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return sums.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select(["lang", "source", "term", "n", "docs"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of terms and of documents with them, by language and source, of each task's documents."""
    held: list[pa.Table] = []
    for batch in common.steps(batches):
        found, number = tokens.words([x.translate(_TERMS) for x in common.texts_of(batch)])
        coded = found.dictionary_encode()
        words, place = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
        size = max(1, len(words))
        doc = np.repeat(np.arange(batch.num_rows), number)
        pairs, n = np.unique(doc * size + place, return_counts=True)  # a document and a term
        codes: dict[tuple[str, str], int] = {}
        keys = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        group = np.array([codes.setdefault(k, len(codes)) for k in keys], np.int64)
        cells, at = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
        langs, sources = (pa.array([k[i] for k in codes], pa.string()) for i in (0, 1))
        of = pa.array(cells // size)
        held.append(pa.table({
            "lang": langs.take(of), "source": sources.take(of), "term": words.take(pa.array(cells % size)),
            "n": np.bincount(at, n, len(cells)).astype(np.int64), "docs": np.bincount(at, minlength=len(cells)),
        }))
        if len(held) > 1 and sum(t.nbytes for t in held) > frequencies.HELD_BYTES:
            held = [_grouped(pa.concat_tables(held))]
            if held[0].nbytes > frequencies.HELD_BYTES // 2:
                yield from held[0].to_batches()
                held = []
    if held:
        yield from _grouped(pa.concat_tables(held)).to_batches()


def _share(count: str, total: str, kept: str) -> Column:
    """The smoothed share of a term with ``count`` of ``total`` occurrences and ``kept`` terms, exactly."""
    return F.expr(f"case when {kept} = 0 then 1L else 1L + (cast({SCALE} as decimal(20,0)) * ({count} + 2L)) div cast({total} + 2L * {kept} as decimal(20,0)) end")


def _apart(p: str, q: str) -> Column:
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """Groups (``lang``, ``source``, ``idx`` of the source in its language, ``total``, ``n_terms``, ``kept``, ``p0``, the share of an
    absent term, ``n_sources``), and postings (``lang``, ``source``, ``idx``, ``term``, ``term_id``, ``n``, ``p``, ``q``), both cut."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = named.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # Tasks have summed their documents, so a term is few rows for each; one shuffle by it serves both sums.
    counts = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = F.sum("docs").over(Window.partitionBy("lang", "term"))  # a row for each source
    counts = common.cut(counts.withColumn("docs", of_term).filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n"))
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"))
    kept = common.cut(kept.withColumn("term_id", F.monotonically_increasing_id()))
    postings = common.cut(counts.join(kept, ["lang", "term"]))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("of_lang"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    zero = F.lit(0).cast("long")
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, zero).alias(c) for c in ("total", "n_terms", "kept", "of_lang")))
    # All pairs of a language's sources are rows of the result, so its sources are few.
    numbered = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1)
    numbered = numbered.withColumn("n_sources", F.count("*").over(Window.partitionBy("lang")))
    groups = common.cut(numbered.withColumn("p0", _share("0L", "total", "kept")))
    known = common.lookup(postings, groups, ["lang", "source"], ["idx", "total", "kept", "of_lang"], "n_terms", postings.count(), ["term_id"])
    known = known.withColumn("p", _share("n", "total", "kept")).withColumn("q", _share("in_lang", "of_lang", "kept"))
    return groups, common.cut(known.select("lang", "source", "idx", "term", "term_id", "n", "p", "q"))


def top_terms(postings: DataFrame, k: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: the k terms of each group that it has most above its language."""
    key = ["lang", "source", "bucket"]
    placed = postings.withColumn("bucket", F.floor(F.log2("n") * IN_OCTAVE))
    buckets = placed.groupBy(*key).agg(F.max("p").alias("high"), F.min("q").alias("low"), F.count("*").alias("held"))
    buckets = buckets.filter("high > low").withColumn("bound", _apart("high", "low"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket")  # an octave has few buckets
    buckets = common.cut(buckets.withColumn("before", F.coalesce(F.sum("held").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    total = placed.count()

    def evaluated(chosen: DataFrame) -> DataFrame:
        met = common.lookup(placed, chosen.withColumn("chosen", F.lit(True)), key, ["chosen"], "held", total, ["term_id"])
        return met.filter("chosen and p > q").select("lang", "source", F.col("term").alias("item"), _apart("p", "q").alias("value"))

    def ranked(rows: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.withColumn("rank", place).filter(F.col("rank") <= k)

    first = common.cut(ranked(evaluated(buckets.filter(F.col("before") < k))))
    kth = first.filter(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
    open_ = buckets.filter(F.col("before") >= k).join(kth, ["lang", "source"], "left").filter("kth is null or bound >= kth")
    return ranked(first.drop("rank").unionByName(evaluated(open_.select(*key, "held"))))


def _pair_sums(table: pa.Table, block: int) -> pa.Table:
    """Sums over a slice's terms that either source of a pair has, and how many terms both have.

    Rows of term -1 give each source's share of an absent term."""
    lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
    idx, term, p = (table.column(c).to_numpy() for c in ("idx", "term_id", "p"))
    absent = term < 0
    sources, p0 = idx[absent], p[absent]
    order = np.argsort(sources)
    sources, p0 = sources[order], p0[order]
    terms, at = np.unique(term[~absent], return_inverse=True)
    own = np.searchsorted(sources, idx[~absent])
    p = p[~absent]
    left, right = np.flatnonzero(sources // block == lo), np.flatnonzero(sources // block == hi)
    mine = np.isin(own, left)
    g, g_term, g_p = own[mine], at[mine], p[mine]
    g_p0 = p0[g]
    a, b, value, both = [], [], [], []
    for j in right.tolist():
        held = own == j
        dense, has = np.full(len(terms), p0[j]), np.zeros(len(terms), bool)
        dense[at[held]], has[at[held]] = p[held], True
        q, shared = dense[g_term], has[g_term]
        # Shares are at most about 10^9 in all, so sums of their distances are exact as doubles.
        sums = np.bincount(g, _distance(g_p, q) - np.where(shared, _distance(g_p0, q), 0), len(sources))
        sums = sums.astype(np.int64)[left] + _distance(p0[left][:, None], p[held][None, :]).sum(1)
        keep = left != j
        a += sources[left][keep].tolist()
        b += [int(sources[j])] * int(keep.sum())
        value += sums[keep].tolist()
        both += np.bincount(g[shared], minlength=len(sources))[left][keep].tolist()
    lang = pa.array([table.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.table({"lang": lang, "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "value": pa.array(value, pa.int64()), "both": pa.array(both, pa.int64())})


def source_pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``item``, ``value``, ``rank``: how far each other source of the language is from each."""
    sizes = groups.groupBy("lang").agg(F.sum("n_terms").alias("rows"), F.max("n_sources").alias("of"))
    sizes = sizes.select("lang", (F.floor(F.col("rows") / SLICE_ROWS) + 1).alias("slices"), F.ceil(F.col("of") / BLOCK).alias("blocks"))
    held = postings.select("lang", "idx", "term_id", "p")
    few = groups.select("lang", "idx", F.lit(-1).cast("long").alias("term_id"), F.col("p0").alias("p"))
    langs = groups.groupBy("lang").agg(F.sum(F.col("n_terms") + 1).alias("rows"))
    sizes = sizes.join(langs, "lang")
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    met = common.lookup(held.unionByName(few), sizes, ["lang"], ["slices", "blocks"], "rows", total, ["idx", "term_id"])
    slices = F.when(F.col("term_id") < 0, F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).otherwise(F.array(F.pmod("term_id", "slices")))
    met = met.withColumn("slice", F.explode(slices)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    block = F.floor(F.col("idx") / BLOCK)
    met = met.select("lang", "idx", "term_id", "p", "slice", F.least(block, "other").alias("lo"), F.greatest(block, "other").alias("hi"))
    of = BLOCK
    sums = met.groupBy("lang", "lo", "hi", "slice").applyInArrow(lambda table: _pair_sums(table, of), "lang string, a long, b long, value long, both long")
    # Two blocks are met once: each pair of theirs stands for both directions.
    crossed = sums.filter(F.floor(F.col("a") / BLOCK) != F.floor(F.col("b") / BLOCK)).select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value", "both")
    sums = sums.unionByName(crossed).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    columns = ("idx", "source", "n_terms", "p0")
    one = groups.select("lang", "kept", F.col("idx").alias("a"), *(F.col(c).alias(f"{c}_a") for c in columns[1:]))
    two = groups.select("lang", F.col("idx").alias("b"), *(F.col(c).alias(f"{c}_b") for c in columns[1:]))
    rows = sums.join(one, ["lang", "a"]).join(two, ["lang", "b"])
    lacked = F.col("kept") - F.col("n_terms_a") - F.col("n_terms_b") + F.col("both")
    value = F.when(F.col("kept") == 0, 0).otherwise(F.col("value") + lacked * _apart("p0_a", "p0_b")).cast("long")
    rows = rows.select("lang", F.col("source_a").alias("source"), F.col("source_b").alias("item"), value.alias("value"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, k: int = TOP) -> DataFrame:
    """``lang``, ``source``, ``part`` (pair or term), ``item``, ``value``, ``rank``."""
    groups, postings = shares(docs, min_docs)
    pairs = source_pairs(groups, postings).withColumn("part", F.lit("pair"))
    return pairs.unionByName(top_terms(postings, k).withColumn("part", F.lit("term"))).select("lang", "source", "part", "item", "value", "rank")
