"""Benchmark decontamination by winnowing.

Of each text's K-grams the least hash of every WINDOW consecutive ones is kept. Two texts that
share K + WINDOW - 1 = SPAN words share a kept K-gram in them, so joining kept hashes of
documents and items finds every shared span of that length; each match is extended word by word
and counts where it reaches SPAN words. An item of fewer words is one window; for these all
grams of that length are fingerprints. Before the join, documents' hashes pass a Bloom filter
of the items' hashes, whose size is fixed; it only saves rows.

Defined results: null and empty texts have no words, hit nothing and are hit by nothing. Rows
that repeat are judged each for itself; items that repeat count once. Windows of items whose id
is null hit, but such an item is not listed. An empty table of either kind gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

K, WINDOW = 6, 5
SPAN = K + WINDOW - 1
#: Bits of the Bloom filter; more hashes than that only let more rows into the join.
FILTER_BITS = 1 << 24
#: Parts in which the rows of a fingerprint that very many have are dealt out.
DEALS = 64
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Lower-cases A-Z and turns all other ASCII but digits and a-z into spaces.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _PRIME
    return x ^ (x >> np.uint64(29))


def grams(words: list[bytes], lengths: set[int]) -> dict[int, np.ndarray]:
    """Hashes of all grams of these lengths, by length."""
    n = len(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    out, total = {}, np.zeros(n, np.uint64)
    for m in range(1, min(n, max(lengths, default=0)) + 1):
        total = total[: n - m + 1] * _PRIME + h[m - 1 :]
        if m in lengths:
            out[m] = _mixed(total + np.uint64(m))
    return out


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each window; all positions where it ties."""
    n = len(h) - window + 1
    if n < 1:
        return np.zeros(0, np.int64)
    least = h[:n].copy()
    for k in range(1, window):
        np.minimum(least, h[k : k + n], out=least)
    kept = np.zeros(len(h), bool)
    for k in range(window):
        kept[k : k + n] |= h[k : k + n] == least
    return np.flatnonzero(kept)


def prints(words: list[bytes], short: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(gram length, positions, hashes): the winnowed K-grams, then all grams of short lengths."""
    found = grams(words, {K, *short} if len(words) >= SPAN else short)
    if len(words) >= SPAN:
        at = winnow(found[K])
        yield K, at, found[K][at]
    for m in short:
        if m in found:
            yield -m, np.arange(len(found[m])), found[m]


def _context(words: list[bytes], kind: int, at: int) -> tuple[int, bytes]:
    """All that an extension may need: the words before the gram, and the words' text."""
    if kind < 0:
        return 0, b" ".join(words[at : at - kind])
    low = max(0, at - (SPAN - K))
    return at - low, b" ".join(words[low : at + SPAN])


def _probes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(FILTER_BITS - 1)
    return (h & size).astype(np.int64), ((h >> np.uint64(32)) & size).astype(np.int64)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.steps(batches):
        rows = []
        for item, text in zip(batch.column("item_id").to_pylist(), common.texts_of(batch), strict=True):
            words = words_of(text)
            short = {len(words)} if 0 < len(words) < SPAN else set()
            for kind, places, h in prints(words, short):
                first, second = _probes(h)
                for at, x, p, q in zip(places.tolist(), h.view(np.int64).tolist(), first.tolist(), second.tolist()):
                    rows.append((item, kind, x, *_context(words, kind, at), p, q))
        yield _rows(rows, _ITEM)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_ITEM = pa.schema(
    [("item_id", pa.string()), ("kind", pa.int32()), ("print", pa.int64()), ("item_lead", pa.int32()), ("item_context", pa.binary()),
     ("p", pa.int64()), ("q", pa.int64())]
)
_DOC = pa.schema(
    [("row", pa.int64()), ("n_words", pa.int64()), ("kind", pa.int32()), ("print", pa.int64()), ("at", pa.int64()),
     ("lead", pa.int32()), ("context", pa.binary())]
)
_DOC_FIELDS = [
    T.StructField(n, t)
    for n, t in zip(_DOC.names, (T.LongType(), T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType()), strict=True)
]
_HIT = pa.schema([("row", pa.int64()), ("item_id", pa.string()), ("first", pa.int64()), ("end", pa.int64())])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            doc, item, kind, at, lead, context, item_lead, item_context = row
            a, b = context.split(b" "), item_context.split(b" ")
            if kind < 0:
                if a == b:
                    rows.append((doc, item, at, at - kind))
                continue
            if a[lead : lead + K] != b[item_lead : item_lead + K]:
                continue
            left = 0
            while left < min(lead, item_lead) and a[lead - left - 1] == b[item_lead - left - 1]:
                left += 1
            i, j, right = lead + K, item_lead + K, 0
            while i + right < len(a) and j + right < len(b) and a[i + right] == b[j + right]:
                right += 1
            if left + K + right >= SPAN:
                rows.append((doc, item, at - left, at + K + right))
        yield _rows(rows, _HIT)


def spans(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits). Rows: ``row`` and ``n_words`` beside docs' other columns but text. Hits:
    ``row``, ``item_id`` (string), and the words ``first`` to before ``end`` of a shared run."""
    spark = docs.sparkSession
    known = items.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(
        _item_rows, "item_id string, kind int, print long, item_lead int, item_context binary, p long, q long"
    )
    known = common.cut(known.distinct())
    short = {-r.kind for r in known.filter("kind < 0").select("kind").distinct().collect()}  # at most SPAN - 1 rows
    bits = known.select(F.explode(F.array("p", "q")).alias("bit"))
    cells = bits.groupBy(F.shiftright("bit", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("ones"))
    table = np.zeros(FILTER_BITS // 64, np.uint64)
    found = cells.toArrow()  # FILTER_BITS / 64 rows at most
    table[found.column("cell").to_numpy()] = found.column("ones").to_numpy().astype(np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(table)  # FILTER_BITS / 8 bytes, whatever the input

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in common.steps(batches):
            rows = []
            own = batch.schema.field("doc_id").type
            for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), common.texts_of(batch), strict=True):
                words = words_of(text)
                rows.append((doc, row, len(words), None, None, None, None, None))
                for kind, places, h in prints(words, short):
                    p, q = _probes(h)
                    one = np.uint64(1)
                    hit = (table[p >> 6] >> (p & 63).astype(np.uint64)) & (table[q >> 6] >> (q & 63).astype(np.uint64)) & one
                    for i in np.flatnonzero(hit).tolist():
                        at = int(places[i])
                        rows.append((None, row, None, kind, int(h[i : i + 1].view(np.int64)[0]), at, *_context(words, kind, at)))
            yield _rows(rows, pa.schema([pa.field("doc_id", own), *_DOC]))

    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    schema = T.StructType([docs.schema["doc_id"], *_DOC_FIELDS])
    scanned = common.cut(numbered.mapInArrow(scan, schema))
    candidates = scanned.filter("kind is not null").select("row", "kind", "print", "at", "lead", "context")
    # Fingerprints that very many rows have are dealt out, and those items' rows repeated for each deal.
    total = candidates.count()
    often = candidates.groupBy("kind", "print").agg(F.count("*").alias("n")).filter(F.col("n") * common.HOT_ONE_IN > total)
    often = F.broadcast(often.select("kind", "print", F.lit(True).alias("often")))  # HOT_ONE_IN rows at most
    dealt = candidates.join(often, ["kind", "print"], "left").withColumn("deal", F.when(F.col("often"), F.pmod(F.xxhash64("row", "at"), F.lit(DEALS))).otherwise(0)).drop("often")
    deals = F.when(F.col("often"), F.sequence(F.lit(0), F.lit(DEALS - 1))).otherwise(F.array(F.lit(0)))
    items = known.drop("p", "q").distinct().join(often, ["kind", "print"], "left").withColumn("deal", F.explode(deals)).drop("often")
    met = dealt.join(items.withColumn("deal", F.col("deal").cast("long")), ["kind", "print", "deal"])
    hits = met.select("row", "item_id", "kind", "at", "lead", "context", "item_lead", "item_context").mapInArrow(
        _verify, "row long, item_id string, first long, end long"
    )
    return scanned.filter("kind is null").select("doc_id", "row", "n_words"), common.cut(hits.distinct())


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """For each row ``doc_id``, ``row``, ``n_words``, ``n_hit`` (words in a shared window),
    ``n_items``, ``items_sha256`` (of the ids sorted as strings, joined by commas) and
    ``contaminated``. ``row`` is docs' monotonically increasing id."""
    rows, hits = spans(docs, items)
    # A row's distinct runs and items are at most as many as its words and the items.
    runs = hits.select("row", "first", "end").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "end"))).alias("runs"))
    covered = """aggregate(runs, named_struct('n', 0L, 'to', 0L), (a, r) ->
        named_struct('n', a.n + greatest(0L, r.end - greatest(a.to, r.first)), 'to', greatest(a.to, r.end)), a -> a.n)"""
    words = runs.select("row", F.expr(covered).alias("n_hit"))
    ids = hits.filter("item_id is not null").select("row", "item_id").distinct().groupBy("row").agg(F.sort_array(F.collect_list("item_id")).alias("ids"))
    joined = rows.join(words.join(ids, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "doc_id", "row", "n_words", n_hit.alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that no window of an item hits. docs must be read from files or a
    checkpoint, so that its rows are numbered alike when read again."""
    own = common.own_name(docs.columns, "__row")
    dirty = contamination(docs, items).filter("contaminated").select(F.col("row").alias(own))
    numbered = docs.withColumn(own, F.monotonically_increasing_id())
    return numbered.join(dirty, own, "left_anti").select(common.quoted(docs.columns))
