"""Immutable index generations as Parquet folders, published by one pointer.

A generation is written under gen=N, validated, and becomes active when a pointer file that names it is
renamed into place; readers resolve the pointer once and keep their generation. Paths go through Hadoop's
file system, so the store can live wherever Spark can write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import budget
from .shared import materialize

#: A lock that old is a dead writer's.
LOCK_SECONDS = 24 * 3600


class Busy(RuntimeError):
    """Another writer holds the store."""


class Invalid(ValueError):
    """The new generation failed validation and was not published."""


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def generations(self) -> list[int]:
        if not self._fs.exists(self._path(self.root)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.root))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and n[4:].isdigit())

    def active(self) -> int | None:
        """The published generation: that of the newest pointer whose folder is there."""
        return max((g for g in self.generations() if self._exists(f"_active-{g}")), default=None)

    def read(self, table: str, generation: int | None = None) -> DataFrame:
        g = self.active() if generation is None else generation
        if g is None:
            raise FileNotFoundError("no active generation")
        return self.spark.read.parquet(f"{self.root}/gen={g}/{table}")

    def publish(self, tables: dict[str, DataFrame], validate=None) -> int:
        """Write tables as a new generation, validate it (a function of a reader, giving complaints) and make it active."""
        lock = self._path(f"{self.root}/_lock")
        if not self._fs.createNewFile(lock):
            age = self._now() - self._fs.getFileStatus(lock).getModificationTime() / 1000
            if age < LOCK_SECONDS or not self._fs.delete(lock, False) or not self._fs.createNewFile(lock):
                raise Busy(self.root)
        g = max([0, *self.generations()]) + 1
        folder, done = self._path(f"{self.root}/gen={g}"), False
        try:
            for name, df in tables.items():
                df.write.mode("errorifexists").parquet(f"{self.root}/gen={g}/{name}")
            complaints = list(validate(lambda t: self.read(t, g))) if validate else []
            if complaints:
                raise Invalid("; ".join(complaints))
            draft = self._path(f"{self.root}/_draft-{g}")
            self._fs.createNewFile(draft)
            if not self._fs.rename(draft, self._path(f"{self.root}/_active-{g}")):
                raise OSError(f"the pointer to generation {g} could not be put in place")
            done = True
            return g
        finally:
            if not done:  # nothing points to it
                self._fs.delete(folder, True)
            self._fs.delete(lock, False)

    def _now(self) -> float:
        """The file system's own clock, in seconds: that of a file made now."""
        probe = self._path(f"{self.root}/_clock-{uuid.uuid4().hex}")
        self._fs.createNewFile(probe)
        try:
            return self._fs.getFileStatus(probe).getModificationTime() / 1000
        finally:
            self._fs.delete(probe, False)

    def clean_up(self, keep: int = 2) -> list[int]:
        """Delete all but the newest published generations."""
        done = [g for g in self.generations() if self._exists(f"_active-{g}")]
        gone = [g for g in done[:-keep]]
        for g in gone:
            self._fs.delete(self._path(f"{self.root}/_active-{g}"), False)
            self._fs.delete(self._path(f"{self.root}/gen={g}"), True)
        return gone


def violations(files: DataFrame, symbols: DataFrame, imports: DataFrame, resolved: DataFrame, edges: DataFrame) -> DataFrame:
    """(check, violations): counts that must be 0 in a sound generation, from anti-joins and conditions."""
    paths = files.select("path")
    checks = {
        "symbol_without_file": symbols.join(paths, "path", "left_anti"),
        "import_without_file": imports.join(paths, "path", "left_anti"),
        "import_not_resolved": imports.join(resolved, ["path", "ordinal"], "left_anti"),
        "edge_without_source": edges.join(paths.withColumnRenamed("path", "source_path"), "source_path", "left_anti"),
        "edge_without_target": edges.join(paths.withColumnRenamed("path", "target_path"), "target_path", "left_anti"),
        "confidence_out_of_range": edges.filter(~F.col("confidence").between(0, 1)),
        "duplicate_edge": edges.groupBy("kind", "source_path", "target_path").count().filter("count > 1"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def freshness(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """(path, change) of files that differ between an index and the present state, both (path, hash)."""
    both = indexed.select("path", F.col("hash").alias("a")).join(current.select("path", F.col("hash").alias("b")), "path", "full_outer")
    change = F.when(F.col("a").isNull(), "ADDED").when(F.col("b").isNull(), "DELETED").when(F.col("a") != F.col("b"), "CHANGED")
    return both.select("path", change.alias("change")).filter("change is not null")


def reuse(previous: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a previous analysis whose (path, hash) is still there, and the current files left to analyse."""
    keys = ["path", "hash"]
    return previous.join(current.select(*keys), keys, "left_semi"), current.join(previous.select(*keys), keys, "left_anti")


#: Saved capsules, their bytes in all, and of one (fixed values).
MAX_ENTRIES, MAX_STORED, MAX_CAPSULE = 2000, 256 << 20, 8 << 20


def save(history: DataFrame, capsules: DataFrame, most_entries: int = MAX_ENTRIES, most_bytes: int = MAX_STORED, most_each: int = MAX_CAPSULE) -> DataFrame:
    """capsules (id, saved_at, body and more) with outcome: SAVED, KNOWN (the id is in history (id, bytes), or comes up earlier),
    TOO_LARGE, or FULL: it would exceed the entries or bytes that are left. First come, first saved, by saved_at and id.

    Ids are hashes of contents, so saving again changes nothing; what is SAVED is to be appended to the history."""
    bytes_ = F.coalesce(F.octet_length("body"), F.lit(0)).cast("long")
    first = F.row_number().over(Window.partitionBy("id").orderBy("saved_at", F.xxhash64("body"))) == 1
    rows = capsules.withColumn("bytes", bytes_).withColumn("first", first).join(history.select("id", F.lit(True).alias("known")).distinct(), "id", "left")
    state = F.when(F.col("known").isNotNull() | ~F.col("first"), "KNOWN").when(F.col("bytes") > most_each, "TOO_LARGE")
    rows = materialize(rows.withColumn("outcome", state))
    held = history.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    fresh = rows.filter("outcome is null").select(F.lit(0).alias("task_id"), F.col("id").alias("path"), F.unix_micros("saved_at").alias("turn"), F.col("bytes").alias("size"))
    fits = budget.within(fresh, max(0, most_entries - held["n"]), max(0, most_bytes - held["bytes"])).filter("taken").select(F.col("path").alias("id"), F.lit(True).alias("fits"))
    out = rows.join(fits, "id", "left")
    return out.withColumn("outcome", F.coalesce("outcome", F.when(F.col("fits"), "SAVED").otherwise("FULL"))).select(*capsules.columns, "bytes", "outcome")


def prune(history: DataFrame, keep: int, most_bytes: int | None = None) -> DataFrame:
    """The newest rows of a history (saved_at, id, bytes): `keep` of them, and no more than most_bytes in all (a row that does not
    fit is passed over)."""
    if most_bytes is None:
        return history.orderBy(F.desc("saved_at"), "id").limit(keep)
    rows = history.select(F.lit(0).alias("task_id"), F.col("id").alias("path"), (-F.unix_micros("saved_at")).alias("turn"), F.col("bytes").alias("size"))
    return history.join(budget.within(rows, keep, most_bytes).filter("taken").select(F.col("path").alias("id")), "id", "left_semi")


def stats(history: DataFrame) -> DataFrame:
    """(count, bytes) of a history."""
    return history.agg(F.count("*").alias("count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def page(history: DataFrame, limit: int, offset: int) -> DataFrame:
    return history.orderBy(F.desc("saved_at"), "id").offset(offset).limit(limit)
