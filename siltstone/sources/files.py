"""Trees of files as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policies as P
from ..operators import ignore

MAX_BYTES = 1 << 20


class ScanLimit(ValueError):
    pass


def ignore_files(spark: SparkSession, root: str, families: tuple[str, ...] = ignore.FAMILIES, most: int = 10_000) -> DataFrame:
    """(path, content) of the ignore files under a folder. Spark's readers skip names that begin with a dot, so the driver
    reads them: each has MAX_RULE_BYTES at most, and more than `most` of them are an error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(at).toString().rstrip("/")
    found, listed = [], fs.listFiles(at, True)
    while listed.hasNext():
        file = listed.next()
        if file.getPath().getName() in families and file.getLen() <= ignore.MAX_RULE_BYTES:
            stream = fs.open(file.getPath())
            try:
                content = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)
            finally:
                stream.close()
            found.append((file.getPath().toString()[len(top) + 1 :], bytearray(content)))
            if len(found) > most:
                raise ScanLimit(f"more than {most} ignore files")
    return spark.createDataFrame(found, "path string, content binary")


def scan(spark: SparkSession, root: str, max_bytes: int = MAX_BYTES, max_entries: int = 100_000) -> DataFrame:
    """(path, size, modified, category, language, status, hash, text) of the files under a folder; sensitive files, and those
    that the built-in list or ignore files name, are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    top = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    rows = files.withColumn("path", F.expr(f"substring(path, {len(top.rstrip('/')) + 2})"))
    rows = rows.filter(~P.is_ignored(F.col("path")) & ~P.is_sensitive(F.col("path")))
    named = ignore.ignored(rows.select("path"), ignore.rules(ignore_files(spark, root)))
    rows = rows.join(named.select("path"), "path", "left_anti")
    if rows.select("path").count() > max_entries:
        raise ScanLimit(f"more than {max_entries} files")
    # the contents of larger files are not read: the reader skips them by their length
    small, large = rows.filter(F.col("length") <= max_bytes), rows.filter(F.col("length") > max_bytes)
    rows = small.unionByName(large.withColumn("content", F.lit(None).cast("binary")))
    status = P.content_status(F.col("path"), F.col("length"), F.col("content"), max_bytes)
    rows = rows.withColumn("status", status)
    text = F.when(F.col("status") == "text", F.decode("content", "UTF-8"))
    return rows.select(
        "path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), P.category_of(F.col("path")).alias("category"), P.language_of(F.col("path")).alias("language"),
        "status", F.when(F.col("status") == "text", F.sha2("content", 256)).alias("hash"), text.alias("text"),
    )


def exclusions(paths: DataFrame, rules: DataFrame | None = None, families: tuple[str, ...] = ignore.FAMILIES) -> DataFrame:
    """(path, reason) of paths that a scan leaves out; rules: see `ignore.rules`."""
    reason = F.when(P.is_sensitive(F.col("path")), "sensitive").when(P.is_ignored(F.col("path")), "ignored_builtin")
    if rules is not None:
        name = F.element_at(F.array(*[F.lit(x) for x in families]), F.col("family") + 1)
        paths = paths.select("path").join(ignore.ignored(paths, rules).select("path", F.concat(F.lit("ignored by "), name).alias("named")), "path", "left")
        reason = F.coalesce(reason, F.col("named"))
    return paths.withColumn("reason", reason).filter("reason is not null").select("path", "reason")


def read_capsules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Saved capsules (JSON); a malformed one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)
