"""Shared plumbing of the text operators: shared-folder files, lineage cuts, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Characters of text that one step of a Python operator holds at a time (one text at least).
STEP_CHARS = 4_000_000
#: Bytes of an Arrow batch on its way to Python. An executor holds several copies of one for each task, outside its heap, and Spark's own limit is 64 MB.
BATCH_BYTES = 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """URI of a new folder, seen by the driver and all executors, for one operator's files.

    It lies in ``spark.checkpoint.dir``. Only where that is unset and all runs on one machine (tests)
    is a temporary folder made and set as the checkpoint folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not (sc.master + "[").startswith("local["):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all machines share")
        base = current.get() if current.isDefined() else tempfile.mkdtemp(prefix="tracewell-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tracewell-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what goes to Python at a time, unless the session says how much may."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame) -> DataFrame:
    """The same rows with the lineage cut by a reliable checkpoint in the shared folder."""
    ship(df.sparkSession)
    bounded_batches(df.sparkSession)
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (a bare path is a file on a shared mount)."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def publish(uri: str, write: Callable[[pa.NativeFile], None]) -> None:
    """Write a file under a private name, then move it into place: a task that is run again
    replaces the file by an equal one, and a lost task leaves no torn file behind."""
    store, path = filesystem(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(own) as out:
        write(out)
    store.move(own, path)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", chars: int = STEP_CHARS) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``chars`` of text, to bound what Python holds."""
    for batch in batches:
        size = max(1, batch.num_rows)
        per_row = max(1, batch.column(batch.schema.get_field_index(text)).nbytes // size)
        rows = max(1, chars // per_row)
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def quoted(names: list[str]) -> list[str]:
    """Names as Spark resolves them literally, dots included."""
    return [f"`{n.replace('`', '``')}`" for n in names]


def positional(names: list[str]):
    """The columns under plain names, which Python functions on batches need."""
    return [F.col(q).alias(f"__c{i}") for i, q in enumerate(quoted(names))]


def without(names: list[str], taken: list[str]) -> list[str]:
    """The names that do not clash with taken ones, by Spark's case-blind rule."""
    return [n for n in names if n.lower() not in {t.lower() for t in taken}]


def held_out(doc_id, modulus: int):
    """Whether crc32 of the id as text leaves remainder 1. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == 1, F.lit(False))


def learnable(doc_id, modulus: int):
    """Whether a row may be learned from: its id is known and it is not held out."""
    return doc_id.isNotNull() & ~held_out(doc_id, modulus)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Keys of more than one in so many rows are hot: there are at most as many of them.
HOT_ONE_IN = 1000


def lookup(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str], n: str, total: int, spread: list[str]) -> DataFrame:
    """rows with ``values`` of table, null where it has none.

    table has a row for each key, with the number ``n`` of rows of that key. Hot keys among the
    ``total`` rows, HOT_ONE_IN at most, are broadcast, and their rows dealt by the columns ``spread``,
    so that no key gathers in one task; all others meet the table in a join."""
    hot = F.col(n) * HOT_ONE_IN > F.lit(total)
    few = table.filter(hot).select(*keys, *(F.col(v).alias(f"__hot_{v}") for v in values), F.lit(True).alias("__hot"))
    others = table.filter(~hot).select(*keys, *values, F.lit(0).cast("long").alias("__salt"))
    salt = F.when(F.col("__hot"), 1 + F.pmod(F.xxhash64(*spread), F.lit(1 << 20))).otherwise(F.lit(0).cast("long"))
    met = rows.join(F.broadcast(few), keys, "left").withColumn("__salt", salt).join(others, [*keys, "__salt"], "left")
    return met.select(*rows.columns, *(F.coalesce(f"__hot_{v}", v).alias(v) for v in values))


def own_name(names: list[str], like: str) -> str:
    """A name that none of the names is, by Spark's case-blind rule."""
    taken = {n.lower() for n in names}
    while like.lower() in taken:
        like = f"_{like}"
    return like
