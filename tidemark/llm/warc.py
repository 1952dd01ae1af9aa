"""WARC archives as tables of record chunks: payloads are cut, written, read and digested chunk by chunk.

Records are rows (record id, chunk number, bytes) of at most CHUNK bytes each, cut where the payload is read and
with a digest carried from chunk to chunk; nothing longer is shuffled. A writing task streams
them, in record order, into gzip members of one archive file; a reading task streams a file into such rows
again, so that no task holds a whole payload of an oversized record beside the input row.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import shared_dir, small_batches, written

#: Bytes of a payload in a row.
CHUNK = 1 << 20


def shared_uri(spark: SparkSession, folder: str) -> str:
    """folder with the scheme and the authority that Spark gives it: a path without a scheme is one of the default file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a folder that all executors share, as shared_uri names it, and the path there."""
    uri = re.sub(r"^s3[an]:", "s3:", uri)
    return pa.fs.FileSystem.from_uri(uri if "://" in uri else uri.replace(":", "://", 1))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def chunked(records: DataFrame, id_col: str, payload_col: str, size: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (record_id, chunk, last, data, and the columns keep) of each record's payload in UTF-8; a null or empty one has one empty chunk."""
    data = F.coalesce(F.encode(F.col(payload_col).cast("string"), "utf-8"), F.lit(b""))
    n = F.greatest(F.ceil(F.octet_length(data) / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * size + 1, F.lit(size)))
    rows = records.select(F.col(id_col).cast("long").alias("record_id"), *keep, n.alias("n"), F.posexplode(cut).alias("chunk", "data"))
    return rows.select("record_id", F.col("chunk").cast("long").alias("chunk"), (F.col("chunk") == F.col("n") - 1).alias("last"), "data", *keep)


def digested(chunks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of records, those of one following each other in order, with the payload's bytes and digest (in hex) up to and with each chunk."""
    sha, n = hashlib.sha1(), 0
    for batch in chunks:
        sizes, digests = [], []
        for last, data in zip(batch["last"].to_pylist(), batch["data"], strict=True):
            data = data.as_buffer()
            sha.update(data)
            n += data.size
            sizes.append(n)
            digests.append(sha.hexdigest())
            if last:
                sha, n = hashlib.sha1(), 0
        yield batch.append_column("payload_bytes", pa.array(sizes, pa.int64())).append_column("payload_digest", pa.array(digests, pa.string()))


def with_targets(digests: DataFrame, least_bytes: int = 0) -> DataFrame:
    """digests with refers_to: of equal payloads of at least least_bytes, the largest record id; null for that record itself and for smaller payloads.

    Payloads are equal if their lengths and digests are. Repeated rows with one id refer to nothing.
    """
    first = digests.groupBy("payload_bytes", "payload_digest").agg(F.max("record_id").alias("first"))
    both = digests.join(first, ["payload_bytes", "payload_digest"])
    return both.withColumn("refers_to", F.when((F.col("payload_bytes") >= least_bytes) & (F.col("record_id") < F.col("first")), F.col("first"))).drop("first")


def header(kind: str, rid: int | None, uri: str | None, length: int, digest: str, refers_to: int | None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if rid is None else rid}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: text/html"]
    if uri:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]", "", uri))
    lines.append(f"WARC-Payload-Digest: sha1:{base32(bytes.fromhex(digest))}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {length}", "", ""]).encode()


def write_archives(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes rows (record_id, chunk, last, data, uri, payload_bytes, payload_digest, refers_to), in order within their tasks, as .warc.gz files.

    Returns (file, records). Each task writes a file of its own under a name that is not used again, and
    gives it its final name when it is whole; only files that the returned rows name count, so that a task run twice does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        fs.create_dir(top, recursive=True)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        records, out, member = 0, None, None
        for batch in batches:
            meta = batch.drop_columns(["data"]).to_pylist()
            for row, data in zip(meta, batch["data"], strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{top}/{name}.part", compression=None)
                if row["chunk"] == 0:
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    revisit = row["refers_to"] is not None
                    out.write(member.compress(header("revisit" if revisit else "response", row["record_id"], row["uri"], 0 if revisit else row["payload_bytes"], row["payload_digest"], row["refers_to"])))
                if row["refers_to"] is None:
                    out.write(member.compress(data.as_buffer()))
                if row["last"]:
                    out.write(member.compress(b"\r\n\r\n") + member.flush())
                    records += 1
        if out is not None:
            out.close()
            fs.move(f"{top}/{name}.part", f"{top}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([records], pa.int64())], ["file", "records"])

    return chunks.mapInArrow(run, "file string, records long")


FIELD = re.compile(rb"^([!-9;-~]+):[ \t]*(.*?)[ \t]*$")
RECORD_ROWS = "record_id long, record_type string, uri string, refers_to long, stated_digest string, chunk long, last boolean, data binary, bytes_so_far long, digest_so_far string"


def _records(stream: gzip.GzipFile, size: int) -> Iterator[dict]:
    """The chunks of a file's records in order. A record cut short raises ValueError."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            if m := FIELD.match(line.rstrip(b"\r\n")):
                fields[m[1].lower()] = m[2].decode("utf-8", "replace")
        number = lambda key: int(m[1]) if (m := re.search(r"(-?\d+)>$", fields.get(key, ""))) else None
        rest, k, n, sha = int(fields[b"content-length"]), 0, 0, hashlib.sha1()
        while k == 0 or rest:
            data = stream.read(min(size, rest))
            if rest and not data:
                raise ValueError("the archive ends inside a record")
            sha.update(data)
            rest, n = rest - len(data), n + len(data)
            yield {"record_id": number(b"warc-record-id"), "record_type": fields.get(b"warc-type"), "uri": fields.get(b"warc-target-uri"), "refers_to": number(b"warc-refers-to"), "stated_digest": fields.get(b"warc-payload-digest", "").removeprefix("sha1:"), "chunk": k, "last": not rest, "data": data, "bytes_so_far": n, "digest_so_far": base32(sha.digest())}
            k += 1


def read_archives(spark: SparkSession, files: DataFrame, folder: str, size: int = CHUNK, data: bool = True) -> DataFrame:
    """Chunk rows (RECORD_ROWS) of the archives that files (file) names, one task per part of files. data=False leaves the bytes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = opened(folder)
        names = [f.name for f in SCHEMA_ROWS]
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows: list[dict] = []
                held = 0
                with fs.open_input_stream(f"{top}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in _records(stream, size):
                        held += len(row["data"]) + 200
                        if not data:
                            row["data"] = None
                        rows.append(row)
                        if held >= 4 * CHUNK:
                            yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA_ROWS).select(names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=SCHEMA_ROWS).select(names)

    folder = shared_uri(spark, folder)
    return files.select("file").mapInArrow(run, RECORD_ROWS)


SCHEMA_ROWS = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("uri", pa.string()), ("refers_to", pa.int64()), ("stated_digest", pa.string()), ("chunk", pa.int64()), ("last", pa.bool_()), ("data", pa.binary()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string())])


def archive(pages: DataFrame, folder: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per row of pages into .warc.gz files in folder; returns the table (file, records) of the files.

    Payloads are cut into chunks as they are read, which are written once with the digest carried along; from then on only these
    chunks move, and only those of oversized payloads, which are brought together by record. The last chunk of each record has its length and digest, by which it finds its response.
    A null payload is an empty one. A null id is written without a number. Repeated rows are records of their own.
    """
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("record_id"), F.col(uri_col).cast("string").alias("uri"), F.col(payload_col).alias("payload"))
    cut = chunked(own, "record_id", "payload", keep=("row", "uri"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", payload_bytes long, payload_digest string"
    chunks = written(cut.mapInArrow(digested, kinds), "chunks", compression="zstd")
    targets = with_targets(chunks.filter("last").select("row", "record_id", "payload_bytes", "payload_digest"), least_bytes)
    known = written(targets.drop("record_id"), "digests")
    both = chunks.drop("payload_bytes", "payload_digest").join(known, "row")
    whole = (F.col("chunk") == 0) & F.col("last")  # a file of chunks may be read in several splits: only records of one chunk may stay where they are
    rows = both.filter(whole).unionByName(both.filter(~whole).repartition("row").sortWithinPartitions("row", "chunk"))
    rows = rows.select("record_id", "chunk", "last", F.when(F.col("refers_to").isNull(), F.col("data")).alias("data"), "uri", "payload_bytes", "payload_digest", "refers_to")
    return written(write_archives(rows, shared_uri(spark, folder)), "archives")


def round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Archives pages and reads the archives back: (id, payload_bytes, payload_digest, record_type, refers_to) per record.

    Length and digest are those of the bytes read; a revisit has those of the response that it refers to.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = archive(pages, folder, id_col, uri_col, payload_col, least_bytes)
    n = files.count()
    chunks = read_archives(spark, files.repartition(max(n, 1)), folder, data=False)
    records = written(chunks.filter("last").select("record_id", "record_type", "refers_to", "bytes_so_far", "digest_so_far"), "records")
    full = records.filter("record_type = 'response'").select(F.col("record_id").alias("refers_to"), F.col("bytes_so_far").alias("n"), F.col("digest_so_far").alias("d")).dropDuplicates(["refers_to"])
    own = records.filter("record_type = 'response'").withColumnsRenamed({"bytes_so_far": "n", "digest_so_far": "d"})
    again = records.filter("record_type = 'revisit'").drop("bytes_so_far", "digest_so_far").join(full, "refers_to")
    return own.unionByName(again).select(F.col("record_id").alias(id_col), F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"), "record_type", "refers_to")
