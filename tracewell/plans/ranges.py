"""Plan helpers: joins on a key and a time window, scans along a key's rows, and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


def seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970 of a timestamp without zone. Differences of two count the
    boundaries of seconds between them."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), column)


def window_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, width_s: int, condition: Column, how: str = "inner") -> DataFrame:
    """left joined to right on keys where ``right_ts`` lies in (left_ts, left_ts + width_s].

    Time is dealt into cells of the window's width. A left row probes its own cell and the next,
    a right row has one, so each pair meets once and a busy key's rows are spread over its
    cells instead of gathering in one task. ``condition`` is any residual; right's key columns
    are dropped. With ``left_semi``, left's distinct rows are returned.
    """
    cell = F.floor(seconds(left_ts) / width_s)
    probing = left.withColumn("__cell", F.explode(F.array(cell, cell + 1)))
    held = right.withColumn("__cell", F.floor(seconds(right_ts) / width_s))
    for k in keys:
        held = held.withColumnRenamed(k, f"__{k}")
    within = (F.col(right_ts) > F.col(left_ts)) & (F.col(right_ts) <= F.col(left_ts) + F.make_dt_interval(secs=F.lit(width_s)))
    same = held["__cell"] == probing["__cell"]
    for k in keys:
        same = same & (F.col(k) == F.col(f"__{k}"))
    joined = probing.join(held, same & within & condition, how)
    return joined.drop("__cell", *(f"__{k}" for k in keys))


def _micros(ts: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))


def _cell(at: Column, width: int) -> Column:
    """The cell of so many units that a long is in, exactly."""
    return ((at - F.pmod(at, F.lit(width))) / width).cast("long")


def window_after(df: DataFrame, keys: list[str], ts: str, width_s: int, probes: Column, counted: Column, back: bool = False, **measures: Column) -> DataFrame:
    """df's rows that ``probes`` selects, with aggregates over the rows of the same keys that ``counted`` selects and
    whose ``ts`` lies in (ts, ts + width_s], or with ``back`` in [ts - width_s, ts). measures: names and columns,
    prefixed max_, min_ or sum_.

    No pair of rows is made. Time is dealt into cells of the window's width, so the window is what is left of a
    row's cell and the beginning of the next: a running aggregate against time over the cell's own rows, and
    one along time over the next cell's, which are dealt to this cell too. A busy key's rows are spread over
    its cells. Nulls in ts are counted nowhere and find nothing.
    """
    how = {"max": (F.max, F.greatest), "min": (F.min, F.least), "sum": (F.sum, lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b))}
    width = width_s * 1_000_000
    counted = F.coalesce(counted, F.lit(False)) & F.col(ts).isNotNull()
    marked = df.withColumns({"__probe": F.coalesce(probes, F.lit(False)), "__counted": counted, "__at": -_micros(ts) if back else _micros(ts)}).filter("__probe or __counted")
    cell = _cell(F.col("__at"), width)
    own, ahead = F.struct(cell.alias("cell"), F.lit(False).alias("ahead")), F.struct((cell - 1).alias("cell"), F.lit(True).alias("ahead"))
    dealt = marked.withColumn("__in", F.explode(F.when(F.col("__counted"), F.array(own, ahead)).otherwise(F.array(own))))
    place = [*keys, F.col("__in.cell")]
    against = Window.partitionBy(*place).orderBy(-F.col("__at")).rangeBetween(Window.unboundedPreceding, -1)
    # The next cell's rows come by their time, a probe by its window's end.
    end = F.when(F.col("__in.ahead"), F.col("__at")).otherwise(F.col("__at") + width)
    along = Window.partitionBy(*place).orderBy(end).rangeBetween(Window.unboundedPreceding, 0)
    found = {}
    for name, value in measures.items():
        each, both = how[name.partition("_")[0]]
        here = each(F.when(F.col("__counted") & ~F.col("__in.ahead"), value)).over(against)
        there = each(F.when(F.col("__in.ahead"), value)).over(along)
        found[name] = both(here, there)
    out = dealt.withColumns(found).filter(F.col("__probe") & ~F.col("__in.ahead"))
    return out.select(*df.columns, *found)


#: Cells of a key's rows, in seconds, between which sums and last rows are carried.
CELL_S = 86_400


def _by_cells(df: DataFrame, key: str, ts: str, carried: dict[str, Column], over: Callable[[str], Column], own: dict[str, Column]) -> DataFrame:
    """df with ``own`` columns of each cell's rows, and ``carried`` aggregates of a key's cells, windowed by ``over``, joined back."""
    dealt = df.withColumn("__cell", _cell(seconds(ts), CELL_S))
    cells = dealt.groupBy(key, "__cell").agg(*(c.alias(n) for n, c in carried.items()))
    cells = cells.select(F.col(key).alias("__key"), F.col("__cell").alias("__of"), *(over(n).alias(n) for n in carried))
    same = (F.col(key) == F.col("__key")) & F.col("__cell").eqNullSafe(F.col("__of"))
    return dealt.withColumns(own).join(cells, same, "left").drop("__key", "__of")


def running_total(df: DataFrame, key: str, ts: str, tie: str, value: Column, name: str) -> DataFrame:
    """df with ``name``, the sum of ``value`` over the key's rows up to this one, by time and ``tie``.

    Rows are summed in cells of CELL_S; a key's cells, not its rows, are in one window."""
    own = Window.partitionBy(key, "__cell").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    met = _by_cells(df, key, ts, {"__before": F.sum(value)}, lambda n: F.sum(n).over(before), {"__own": F.sum(value).over(own)})
    return met.withColumn(name, F.col("__own") + F.coalesce("__before", F.lit(0))).select(*df.columns, name)


def with_previous(df: DataFrame, key: str, ts: str, tie: str, name: str) -> DataFrame:
    """df with ``name``, the time of the key's row before this one, by time and ``tie``; null for the first.

    Within a cell of CELL_S that is the row before; for a cell's first it is the latest of the key's last cell."""
    own = Window.partitionBy(key, "__cell").orderBy(ts, tie)
    before = Window.partitionBy(key).orderBy("__cell")
    met = _by_cells(df, key, ts, {"__before": F.max(ts)}, lambda n: F.lag(n).over(before), {"__own": F.lag(ts).over(own), "__place": F.row_number().over(own)})
    return met.withColumn(name, F.when(F.col("__place") == 1, F.col("__before")).otherwise(F.col("__own"))).select(*df.columns, name)


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint in ``spark.checkpoint.dir``
    (a temporary folder where that is unset on one machine, as in tests)."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master + "[").startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tracewell-"))
    return df.checkpoint(eager=True)


def sums_down(df: DataFrame, order: str, sums: dict[str, str]) -> DataFrame:
    """df with running sums, named by the keys, of columns, by falling ``order``, which has no equal values.

    Rows are dealt by ranges of the order; each range's sums start from those of the ranges
    above. So no window holds more than a range, but for one over the ranges' totals."""
    dealt = cut(df.repartitionByRange(F.desc(order)).withColumn("__range", F.spark_partition_id()))
    totals = dealt.groupBy("__range").agg(*(F.sum(c).alias(f"__{c}") for c in set(sums.values())))
    above = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    totals = totals.select("__range", *(F.coalesce(F.sum(f"__{c}").over(above), F.lit(0)).alias(f"__{c}") for c in set(sums.values())))
    own = Window.partitionBy("__range").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.join(F.broadcast(totals), "__range")
    return met.select(*df.columns, *((F.sum(c).over(own) + F.col(f"__{c}")).alias(n) for n, c in sums.items()))


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))


def _along(values: np.ndarray, starts: np.ndarray, before: int) -> np.ndarray:
    """Running sums within runs; the first run's start at ``before``."""
    total = np.cumsum(values) + before
    first = np.concatenate([[0], total[starts[1:] - 1]])
    return total - np.repeat(first, np.diff(np.append(starts, len(values))))


def running_sums(
    df: DataFrame, key: str, order: list[str | Column], sums: dict[str, str], moduli: dict[str, int] | None = None,
    terms: Callable[[pa.RecordBatch], dict[str, np.ndarray]] | None = None, added: dict[str, T.DataType] | None = None,
) -> DataFrame:
    """df with running sums, named by the keys of ``sums``, of long columns along each key's rows in ``order``.

    A segmented scan: rows are dealt by ranges of key and order, so that a key of very many rows has
    several ranges; tasks sum along their sorted rows, and the sums that a range's first key has in the
    ranges before it, at most a row for each range, are added by a broadcast. Sums of a name in
    ``moduli`` are taken by it (values must be below 2^31). ``terms`` makes further columns, of the types
    in ``added``, from each batch in a task. key has no nulls; the result is cut.
    """
    moduli, added = moduli or {}, added or {}
    fields = [*df.schema.fields, *(T.StructField(n, t) for n, t in added.items()), *(T.StructField(n, T.LongType()) for n in (*sums, "__range"))]
    schema = T.StructType([*fields, T.StructField("__head", T.BooleanType())])
    names = df.columns
    place = names.index(key)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        first = last = None
        held = dict.fromkeys(sums, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(place).to_numpy(zero_copy_only=False)
            starts = _runs(own)
            first = own[0] if first is None else first
            goes_on = last is not None and own[0] == last
            columns = dict(zip(names, batch.columns, strict=True)) | (terms(batch) if terms else {})
            for name, of in sums.items():
                values = columns[of] if isinstance(columns[of], np.ndarray) else columns[of].to_numpy()
                found = _along(values, starts, held[name] if goes_on else 0)
                columns[name] = found % moduli[name] if name in moduli else found
                held[name] = int(columns[name][-1])
            last = own[-1]
            columns |= {"__range": np.full(len(own), part), "__head": own == first}
            arrays = [x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[f.name] for f in schema)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    ship(df.sparkSession)
    dealt = cut(df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).mapInArrow(scan, schema))
    heads = dealt.filter("__head").select(key).distinct()  # one for each range at most
    steps = [F.sum(c) if n not in moduli else F.sum(F.col(c)) % moduli[n] for n, c in sums.items()]
    parts = dealt.join(F.broadcast(heads), key, "left_semi").groupBy(key, "__range").agg(*(s.alias(f"__{n}") for s, n in zip(steps, sums, strict=True)))
    earlier = Window.partitionBy(key).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carried = parts.select(key, "__range", F.lit(True).alias("__head"), *(F.sum(f"__{n}").over(earlier).alias(f"__{n}") for n in sums))
    met = dealt.join(F.broadcast(carried), [key, "__range", "__head"], "left")
    whole = {n: F.col(n) + F.coalesce(f"__{n}", F.lit(0)) for n in sums}
    return met.select(*df.columns, *added, *((x % moduli[n] if n in moduli else x).alias(n) for n, x in whole.items()))


def shared_folder(spark) -> str:
    """URI of a new folder under the checkpoint folder, for one query's files."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        cut(spark.range(0))
    return f"{context._jsc.sc().getCheckpointDir().get().rstrip('/')}/{uuid.uuid4().hex}"


def path_exists(spark, uri: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
