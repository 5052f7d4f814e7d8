"""WARC archives: written with an index first, read back by coalesced byte ranges.

Writing: each task writes its records, each a gzip member of its own, to files of its own in the
shared folder, and returns the index rows (file, offset, length, url, digest and type).  The index is a table that Spark
commits; files of failed attempts are in no index row.  Reading: the selected index rows are
sorted by file and offset, ranges that lie close together are read as one, and each record is cut
from the bytes, decompressed, parsed and checked against its digest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, ready, scratch, staged

#: Compressed bytes after which a writer begins a new file.
FILE_BYTES = 64 << 20
#: Bytes between two ranges that are read along, and the most bytes of one read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"
INDEX = "file string, offset long, length long, url string, payload_digest string, record_type string, page_id string"
RECORD = "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}') if page_id is not None else uuid.uuid4()}>"


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%-._~"))
    if page_id is not None:
        head.append("X-Page-ID: " + quote(page_id))
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", "X-Refers-To-Page-ID: " + quote(refers_to)]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The named fields of a record, its payload (None for a revisit) and the payload's full length."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record's length is wrong")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    full = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    return fields | {"payload": payload if fields["warc-type"] == "response" else None, "payload-bytes": full}


def _filesystem(path: str):
    """Filesystem and path for a URI or an absolute path, on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _qualified(spark, path: str) -> str:
    """``path`` with its filesystem: one without a scheme means the cluster's default, not the executor's disk."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = found.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(found).toString()
    return "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, path: str | None = None, level: int = 3) -> DataFrame:
    """Write one record for each row of ``pages`` and return the index, a table in the shared folder.

    Of equal payloads of at least ``min_bytes`` bytes the row with the smallest id is the response and
    the others are revisits of it.  A null payload is empty.  Rows that repeat the smallest id of their
    payload are all responses; rows with a null id are revisits where any row of the payload has an id,
    and responses otherwise.  A null url is left out.  An empty table gives an empty index.
    """
    spark = ready(pages.sparkSession)
    path = _qualified(spark, path or scratch(spark, "warc"))
    body = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).withColumn("sha", F.sha1("body"))
    same = rows.filter(F.length("body") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    same = staged(same.filter("n > 1 and first is not null").select(F.col("sha").alias("of_sha"), "first"), "payloads")
    joined = rows.join(same, F.col("sha") == F.col("of_sha"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")), F.col("first"))
    records = joined.select(F.col("id").cast("string").alias("id"), "url", "body", refers.cast("string").alias("refers"))

    def run(batches):
        filesystem, folder = _filesystem(path)
        filesystem.create_dir(folder, recursive=True)
        name, out, at = None, None, 0
        try:
            for batch in batches:
                got = []
                for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = filesystem.open_output_stream(f"{folder}/{name}", compression=None)
                    digest = base32_sha1(payload)
                    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = squeeze.compress(record(page_id, url, payload, digest, refers_to)) + squeeze.flush()
                    out.write(member)
                    got.append((f"{path}/{name}", at, len(member), url, digest, "response" if refers_to is None else "revisit", page_id))
                    at += len(member)
                if got:
                    kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 4]
                    names = ["file", "offset", "length", "url", "payload_digest", "record_type", "page_id"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)
        finally:
            if out is not None:
                out.close()

    return staged(records.mapInArrow(run, INDEX), "index")


def ranges(rows: list[tuple[int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> list[tuple[int, int, list[int]]]:
    """(start, end, positions) of the reads that cover sorted (offset, length) rows."""
    out: list[tuple[int, int, list[int]]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][1] <= gap and max(offset + length, out[-1][1]) - out[-1][0] <= most:
            start, end, own = out.pop()
            own.append(i)
            out.append((start, max(end, offset + length), own))
        else:
            out.append((offset, offset + length, [i]))
    return out


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the index rows: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    payload is null for revisits, and for all where ``payloads`` is false (responses are still read in full and their
    digests checked).  A record that does not match its index row raises.
    """
    spark = ready(index.sparkSession)

    def run(batches):
        for batch in batches:
            files, starts, lengths, _, digests, types, _ = (c.to_pylist() for c in batch.columns)
            got = []
            first = 0
            while first < len(files):
                last = first
                while last < len(files) and files[last] == files[first]:
                    last += 1
                filesystem, name = _filesystem(files[first])
                with filesystem.open_input_file(name) as source:
                    for start, end, own in ranges(list(zip(starts[first:last], lengths[first:last], strict=True))):
                        data = source.read_at(end - start, start)
                        for i in (first + k for k in own):
                            one = parse(zlib.decompress(data[starts[i] - start : starts[i] - start + lengths[i]], 31))
                            digest = one["warc-payload-digest"].removeprefix("sha1:")
                            payload = one["payload"]
                            if digest != digests[i] or one["warc-type"] != types[i] or payload is not None and base32_sha1(payload) != digest:
                                raise ValueError(f"{files[i]} at {starts[i]} is not what the index says")
                            got.append((_unquoted(one.get("x-page-id")), one.get("warc-target-uri"), payload if payloads else None, one["payload-bytes"], digest, types[i], _unquoted(one.get("x-refers-to-page-id"))))
                first = last
            if got:
                kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
                names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)], names=names)

    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets(size, FILE_BYTES))
    piece = F.floor(F.col("offset") / (FILE_BYTES // 16))
    wanted = index.select("file", "offset", "length", "url", "payload_digest", "record_type", "page_id")
    return wanted.repartition(parts, "file", piece).sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def _unquoted(value: str | None) -> str | None:
    from urllib.parse import unquote

    return None if value is None else unquote(value)
