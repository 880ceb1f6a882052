"""WARC archives compressed with Zstandard and a shared dictionary: a writer and a validating reader.

An archive starts with a skippable frame that holds the dictionary; every record after it is a frame of
its own, so a reader can start at any record.  The writer keeps one `response` per payload (that with the
largest page id) and makes the others `revisit` records without payload that refer to it.  The reader
takes the dictionary from the leading frame, walks the frames block by block, decodes one frame per
record and validates version line, headers, lengths and the payload's digest.

Tasks write archives to the shared folder, each under a name of its own attempt, and list what they
finished; only listed archives are read, so files left by lost executors do no harm.

Defined cases: a null html is an empty payload; a null url has no target header; rows with a null id are
responses of their own and nothing refers to them; a repeated row is a response like the first; payloads
shorter than `least` bytes are all responses; an empty table gives no archive and an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = 0x184D2A5D
#: Payloads from which the dictionary is trained (by least hash; longer ones are left out), and its size.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 16, 1 << 15
#: A task starts a new archive after so many compressed bytes.
ARCHIVE_BYTES = 32 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class InvalidArchive(ValueError):
    pass


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to) -> bytes:
    """A WARC record; payload None: a revisit of refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    name = f"page:{page_id}" if page_id is not None else f"uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}"
    head = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: <urn:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of a record; raises InvalidArchive if it isn't sound."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] != "WARC/1.1":
        raise InvalidArchive("no WARC/1.1 header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    if missing := {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"} - fields.keys():
        raise InvalidArchive(f"no {sorted(missing)[0]}")
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise InvalidArchive(f"Content-Length is {size}, the record holds {len(rest) - 4}")
    http, found, payload = rest[:size].partition(b"\r\n\r\n")
    stated = re.search(rb"\r\nContent-Length: (\d+)", http)
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not found or not stated or kind not in ("response", "revisit"):
        raise InvalidArchive("no HTTP header or an unknown type")
    if kind == "response" and (int(stated[1]) != len(payload) or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise InvalidArchive("the payload differs from its length or digest")
    page = lambda x: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(x, ""))) else None
    return {"page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(stated[1]), "payload_digest": digest, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


def frames(data: bytes) -> Iterator[tuple[int, int]]:
    """(start, end) of each frame after the dictionary."""
    at, view = 8 + struct.unpack_from("<I", data, 4)[0], memoryview(data)
    while at < len(data):
        try:
            facts = zstandard.get_frame_parameters(view[at : at + 18])
            end, last = at + zstandard.frame_header_size(view[at : at + 18]), 0
        except zstandard.ZstdError as e:
            raise InvalidArchive(f"no frame at {at}: {e}") from e
        while not last:
            if end + 3 > len(data):
                raise InvalidArchive("the last frame is cut off")
            head = int.from_bytes(view[end : end + 3], "little")
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            end += 3 + (1 if kind == 1 else size)
        end += 4 * facts.has_checksum
        if end > len(data):
            raise InvalidArchive("the last frame is cut off")
        yield at, end
        at = end


def read(data: bytes) -> Iterator[dict]:
    """The records of an archive, in order."""
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != MAGIC:
        raise InvalidArchive("no leading dictionary frame")
    size = struct.unpack_from("<I", data, 4)[0]
    stored = data[8 : 8 + size]
    if len(stored) != size:
        raise InvalidArchive("the dictionary is cut off")
    if stored[:4] == b"\x28\xb5\x2f\xfd":  # it may be compressed itself
        stored = zstandard.ZstdDecompressor().decompress(stored)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(stored))
    for start, end in frames(data):
        try:
            raw = reader.decompress(data[start:end])
        except zstandard.ZstdError as e:
            raise InvalidArchive(f"frame at {start}: {e}") from e
        yield parse(raw)


def train(payloads: list[bytes]) -> bytes:
    """A dictionary from sample payloads; the samples themselves if they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, payloads).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b" " + b"".join(payloads)[:DICTIONARY_BYTES] + b" " * 8


def with_types(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, sha1, refers_to); payload is null for a revisit."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("sha1"))
    # a table of its own, so that Spark can split the rows of a payload that many pages share
    kept = common.materialize(rows.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("keep")))
    rows = rows.join(kept, ["sha1", "payload_bytes"])
    again = F.col("page_id").isNotNull() & (F.col("page_id") != F.col("keep")) & (F.col("payload_bytes") >= least)
    return rows.select("page_id", "url", F.when(~again, F.col("html").cast("binary")).alias("payload"), "payload_bytes", "sha1", F.when(again, F.col("keep")).alias("refers_to"))


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder as the URI that executors open: on the cluster's default file system if it names none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^s3[an]://", "s3://", re.sub(r"^file:/+", "file:///", uri))


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write archives of pages (page_id, url, html) to a shared folder; returns (name, records) of each."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    folder = qualified(spark, folder)
    sample = pages.filter(F.octet_length("html").between(1, SAMPLE_BYTES)).select("html").orderBy(F.xxhash64("html"), "html").limit(SAMPLES)
    dictionary = train([r["html"].encode() for r in sample.collect()])
    shared = spark.sparkContext.broadcast(dictionary)
    run = uuid.uuid4().hex

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(path, recursive=True)
        packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(shared.value), write_checksum=True, write_content_size=True)
        task = TaskContext.get()
        out, name, records, size, done = None, "", 0, 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name = f"{run}-{task.partitionId():06d}-{task.taskAttemptId()}-{len(done):04d}.warc.zst"
                    out, records, size = fs.open_output_stream(f"{path}/{name}", compression=None), 0, 0
                    out.write(struct.pack("<II", MAGIC, len(shared.value)) + shared.value)
                digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                frame = packer.compress(record(row["page_id"], row["url"], row["payload"], row["payload_bytes"], digest, row["refers_to"]))
                out.write(frame)
                records, size = records + 1, size + len(frame)
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, records))
                    out = None
        if out is not None:
            out.close()
            done.append((name, records))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["name", "records"])

    return common.materialize(with_types(pages, least).mapInArrow(pack, "name string, records long"))


def load(spark: SparkSession, folder: str, listed: DataFrame, keep_payload: bool = True) -> DataFrame:
    """The records of the listed archives (FIELDS; payload left out if not asked for)."""
    names = [x.split()[0] for x in FIELDS.split(", ")][: None if keep_payload else -1]
    kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, records in zip(batch.column("content"), batch.column("records").to_pylist(), strict=True):
                rows, n = [], 0
                for x in read(data.as_py()):
                    rows.append({k: x[k] for k in names})
                    n += 1
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_pylist(rows, pa.schema([kinds.field(k) for k in names]))
                        rows = []
                if n != records:
                    raise InvalidArchive(f"{n} records, {records} were written")
                yield pa.RecordBatch.from_pylist(rows, pa.schema([kinds.field(k) for k in names]))

    if not listed.head(1):
        return spark.createDataFrame([], ", ".join(FIELDS.split(", ")[: len(names)]))
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "content")
    return files.join(listed, "name").select("content", "records").mapInArrow(unpack, ", ".join(FIELDS.split(", ")[: len(names)]))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{common.shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    listed = write(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return load(spark, folder, listed, keep_payload=False).drop("url")


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, html, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS keep FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                CAST(1 + (CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) % 32 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> keep THEN keep END AS refers_to
FROM k
"""
