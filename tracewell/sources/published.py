"""Versions of a table that appear whole or not at all, append-only logs, and updates of buckets.

A folder ``versions`` holds one small JSON file for each version, which names the folders of the table's
files. A version is written under a private name and published by a move that fails where another writer has
published that version: the loser reads the winner's and tries again. Rows are written before the version that names
them, by Spark's own writers, so a lost executor or writer leaves files that nothing names, and no torn table.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


class Conflict(RuntimeError):
    """A version could not be published, however often it was tried."""


class Versions:
    """The versions of one folder, numbered from 1."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def latest(self) -> tuple[int, dict]:
        """The last version's number and content; 0 and nothing for a new folder."""
        folder = self._path("versions")
        fs = folder.getFileSystem(self._conf)
        if not fs.exists(folder):
            return 0, {}
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return 0, {}
        stream = fs.open(self._path("versions", f"{max(numbers):012d}.json"))
        try:
            return max(numbers), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> bool:
        """Whether this writer published the version; false where it is there already."""
        folder, own = self._path("versions"), self._path("versions", f".{uuid.uuid4().hex}")
        fs = folder.getFileSystem(self._conf)
        fs.mkdirs(folder)
        target = self._path("versions", f"{number:012d}.json")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":  # moves there replace silently; links do not
                os.link(urlparse(own.toString()).path, urlparse(target.toString()).path)
                return True
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(own.toUri(), self._conf)
            context.rename(own, target, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            fs.delete(own, False)

    def change(self, step: Callable[[dict], dict], tries: int = 50) -> dict:
        """Publish what ``step`` makes of the last version's content; again where another came first."""
        for attempt in range(tries):
            number, content = self.latest()
            made = step(dict(content))
            if self.publish(number + 1, made):
                return made
            time.sleep(0.01 * (attempt + 1))
        raise Conflict(f"{self.path}: version {number + 1} was always taken")


class Log:
    """An append-only log of rows of one schema: parts as they came, and a snapshot of those before."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.schema = spark, T._parse_datatype_string(schema)
        self.versions = Versions(spark, path)

    def _write(self, rows: DataFrame) -> str:
        name = f"rows/{uuid.uuid4().hex}"
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).write.parquet(f"{self.versions.path}/{name}")
        return name

    def append(self, rows: DataFrame) -> None:
        part = self._write(rows)
        self.versions.change(lambda now: now | {"parts": [*now.get("parts", []), part]})

    def append_after(self, number: int, rows: DataFrame) -> bool:
        """Append where the last version still is ``number``: what was decided on its rows still holds then."""
        latest, now = self.versions.latest()
        if latest != number:
            return False
        return self.versions.publish(number + 1, now | {"parts": [*now.get("parts", []), self._write(rows)]})

    def read(self) -> DataFrame:
        """All rows of the last version: the snapshot's and those appended since."""
        return self.read_version(self.versions.latest()[1])

    def read_version(self, now: dict) -> DataFrame:
        folders = [f"{self.versions.path}/{p}" for p in (*now.get("snapshot", []), *now.get("parts", []))]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def compact(self, fold: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Put the parts there are now into one snapshot, kept or thinned by ``fold``; parts that others append
        meanwhile stay parts. Another's compaction in between makes this one void."""
        _, seen = self.versions.latest()
        done = seen.get("parts", [])
        if not done:
            return
        snapshot = self._write(fold(self.read()))

        def step(now: dict) -> dict:
            if now.get("snapshot", []) != seen.get("snapshot", []):
                return now
            return {"snapshot": [snapshot], "parts": [p for p in now["parts"] if p not in done]}

        self.versions.change(step)


class Buckets:
    """A table whose rows lie in buckets by a hash of their key, each a folder of its own. An update
    reads and rewrites the buckets that it touches, and no others."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str | T.StructType, buckets: int = 64):
        self.spark, self.key, self.buckets = spark, key, buckets
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.versions = Versions(spark, path)

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Folders of the rows' buckets. Large buckets are dealt to several tasks by the writer's own skew handling."""
        name = f"rows/{uuid.uuid4().hex}"
        rows.hint("rebalance", "__bucket").write.partitionBy("__bucket").parquet(f"{self.versions.path}/{name}")
        folder = self.versions._path(name)
        found = [s.getPath().getName() for s in folder.getFileSystem(self.versions._conf).listStatus(folder)]
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith("__bucket=")}

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.versions.path}/{f}" for f in folders))

    def load(self, rows: DataFrame) -> None:
        """Replace the table by rows."""
        held = self._write(self._bucketed(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema))))
        self.versions.change(lambda now: {"buckets": held})

    def read(self) -> DataFrame:
        return self._read(sorted(self.versions.latest()[1].get("buckets", {}).values()))

    def update(self, column: str, updates: DataFrame, tries: int = 20) -> int:
        """Set ``column`` for the keys of updates (key, column), null included; the number of buckets rewritten.

        Where another writer changed a touched bucket meanwhile, the update is made again on what that left."""
        new = self._bucketed(updates.select(self.key, F.col(column).alias("__new"), F.lit(True).alias("__met")))
        touched = {str(r["__bucket"]) for r in new.select("__bucket").distinct().collect()}  # a row for each bucket at most
        for _ in range(tries):
            number, seen = self.versions.latest()
            held = {b: f for b, f in seen.get("buckets", {}).items() if b in touched}
            if not held:
                return 0
            met = self._bucketed(self._read(sorted(held.values()))).join(new, ["__bucket", self.key], "left")
            changed = met.withColumn(column, F.when(F.col("__met"), F.col("__new")).otherwise(F.col(column)))
            made = self._write(changed.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), "__bucket"))
            now_number, now = number, seen
            while all(now["buckets"].get(b) == f for b, f in held.items()):
                if self.versions.publish(now_number + 1, now | {"buckets": now["buckets"] | made}):
                    return len(made)
                now_number, now = self.versions.latest()
        raise Conflict(f"{self.versions.path}: its buckets changed each time")


#: Rows of the log of calls.
CALLS = "ts timestamp_ntz, tool string, params string, outcome string, hits long"


def recorded(log: Log, tool: str, call: Callable[..., DataFrame], clock: Callable[[], object] | None = None) -> Callable[..., DataFrame]:
    """``call`` with each of its calls in the log: the tool, what was asked as JSON with its keys in order, ``ok`` and the
    number of rows found, or the kind of error, which is raised all the same. The log's row is published before
    the answer is handed out."""
    ship(log.spark)

    def run(*args, **asked) -> DataFrame:
        if args:
            raise TypeError(f"{tool} takes named arguments only")
        params = json.dumps(asked, sort_keys=True, separators=(",", ":"), default=str)
        hits, outcome, failure, answer = None, "ok", None, None
        try:
            answer = call(**asked)
            hits = answer.count()
        except Exception as e:
            kind = type(e).__name__ if not isinstance(e, PySparkException) else "query failed"
            outcome, failure = f"error: {kind}", e
        at = F.lit(clock()).cast("timestamp_ntz") if clock else F.current_timestamp().cast("timestamp_ntz")
        row = log.spark.range(1).select(at.alias("ts"), F.lit(tool).alias("tool"), F.lit(params).alias("params"), F.lit(outcome).alias("outcome"), F.lit(hits).cast("long").alias("hits"))
        log.append(row)
        if failure is not None:
            raise failure
        return answer

    return run
