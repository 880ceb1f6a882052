"""A hash of a tree of files, folder by folder: a changed file alters its folders' hashes and no others.

A folder's hash is that of its children's names, kinds and hashes in order of name. Children are first put into
buckets by the hash of their name, and a folder hashes its buckets, so that no task gathers a large folder whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import materialize

#: Hexadecimal digits of a name's hash that name its bucket: a folder has at most 16^DIGITS buckets.
DIGITS = 3


def folders(files: DataFrame) -> DataFrame:
    """(path, depth, files, hash) of every folder above files (path, hash); the root is ''. Of a path that is there twice the least
    hash counts; rows without a path or hash take no part."""
    rows = files.filter("path is not null and hash is not null").groupBy("path").agg(F.min("hash").alias("hash"))
    rows = materialize(rows.withColumn("depth", F.size(F.split("path", "/"))))
    deepest = rows.agg(F.max("depth")).first()[0] or 0
    below = rows.limit(0).select("path", F.lit(0).cast("long").alias("files"), "hash")
    out = None
    for depth in range(deepest, 0, -1):  # a pass per level of folders
        children = rows.filter(F.col("depth") == depth).select("path", F.lit("file").alias("kind"), F.lit(1).cast("long").alias("files"), "hash")
        children = children.unionByName(below.select("path", F.lit("folder").alias("kind"), "files", "hash"))
        name, parent = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", "/?[^/]*$", "")
        children = children.select(parent.alias("path"), F.substring(F.sha2(name, 256), 1, DIGITS).alias("bucket"), F.struct(name.alias("name"), "kind", "hash").alias("x"), "files")
        lines = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat_ws("\x00", x["name"], x["kind"], x["hash"])), "\n")
        buckets = children.groupBy("path", "bucket").agg(F.sum("files").alias("files"), F.sha2(lines, 256).alias("hash"))
        lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "hash"))), lambda x: F.concat_ws("\x00", x["bucket"], x["hash"])), "\n")
        below = materialize(buckets.groupBy("path").agg(F.sum("files").alias("files"), F.sha2(lines, 256).alias("hash")))
        level = below.select("path", F.lit(depth - 1).alias("depth"), "files", "hash")
        out = level if out is None else out.unionByName(level)
    return out if out is not None else rows.limit(0).select("path", "depth", F.lit(0).cast("long").alias("files"), "hash")
