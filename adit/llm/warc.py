"""WARC archives: a sequential writer and reader, one gzip member per record.

The writer is one task a partition; it rolls over to a new file at ``max_bytes``.
Every file has a name of its own, so that a repeated task never writes over another's
file; the returned rows name the files of the tasks that counted, and only these are read, so
what a lost task left behind does no harm. The
reader is one task a file: it feeds blocks of the file to zlib, member after
member, cuts records by Content-Length, and computes block and payload digests while
the bytes pass; a record needs memory for its headers only, unless its payload is asked for.
A record that breaks its framing or digests is an error, or with ``strict=False`` a row that is not ``verified``.

Payloads stay where they are: which of them repeat is found from digests and sizes alone.
Rows of payloads that surely do not repeat need no join (a bitmap of fixed size tells them), of the others only
the one that becomes the response moves with its payload.

Files are reached through pyarrow's file systems (local, HDFS, S3, GCS), at any
URI that these know.

Defined cases: a null html is an empty payload; a null url leaves out
WARC-Target-URI; rows with a null id are responses; of repeated rows with the
smallest id of their payload each is a response; control signs in urls are percent-encoded; a payload of any
length is one record; an empty table makes no files, and none give no rows; extra columns are not read.
"""

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adit.llm.store import KeyFilter, split_join, written

READ = 1 << 20


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, seen: tuple[int, str] | None = None) -> bytes:
    """One record as a gzip member. With ``refers_to`` a revisit, which has the headers of the payload but not the payload.

    ``seen``: length and SHA-1 (base32) of a payload that is not at hand, for a revisit.
    """
    size, digest = seen or (len(payload), _sha1(payload))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    kind = "revisit" if refers_to is not None else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/http;msgtype=response", f"WARC-Block-Digest: sha1:{_sha1(block)}", f"WARC-Payload-Digest: sha1:{digest}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def _members(stream):
    """For each gzip member a generator of its decompressed pieces."""
    left = stream.read(READ)
    while left:
        z, first = zlib.decompressobj(31), left

        def pieces(z=z):
            nonlocal left
            data = first
            while True:
                out = z.decompress(data, READ)
                if out:
                    yield out
                if z.eof:
                    left = z.unused_data or stream.read(READ)
                    return
                data = z.unconsumed_tail or stream.read(READ)
                if not data:
                    raise ValueError("the archive ends within a record")

        yield pieces()


def records(stream, keep_payload: bool = False):
    """(headers, payload bytes and digest, payload or None, framing and digests hold?) of each record, in order.

    Bytes and digest are counted and computed, but for a revisit, whose payload is elsewhere: there they are as stated.
    """
    for pieces in _members(stream):
        buffer = b""
        while b"\r\n\r\n" not in buffer:
            buffer += next(pieces)
        head, _, buffer = buffer.partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record: {version[:40]!r}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        left = int(headers["content-length"])
        whole, inner, http, stated, kept, size = hashlib.sha1(), hashlib.sha1(), b"", None, [], 0
        while True:
            part, buffer = buffer[:left], buffer[left:]
            left -= len(part)
            whole.update(part)
            if stated is None:
                http += part
                if b"\r\n\r\n" in http:
                    top, _, part = http.partition(b"\r\n\r\n")
                    stated = next((int(x.partition(b":")[2]) for x in top.split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
                else:
                    part = b""
            if part and stated is not None:
                inner.update(part)
                size += len(part)
                if keep_payload:
                    kept.append(part)
            if not left:
                break
            buffer = next(pieces)
        tail = buffer + b"".join(pieces)
        digest = lambda h: base64.b32encode(h.digest()).decode()
        good = tail == b"\r\n\r\n" and headers.get("warc-block-digest") == f"sha1:{digest(whole)}"
        if headers["warc-type"] == "response":
            good = good and headers.get("warc-payload-digest") == f"sha1:{digest(inner)}" and size == stated
            yield headers, size, digest(inner), b"".join(kept) if keep_payload else None, good
        else:
            told = headers.get("warc-payload-digest", "").removeprefix("sha1:")
            yield headers, stated or 0, told, b"" if keep_payload else None, good and size == 0 and stated is not None and len(told) == 32


def with_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, payload, size, sha1, refers_to): of equal payloads of ``min_bytes`` or more all but the smallest id refer to that one.

    A row that refers to another may have a null payload; size and sha1 (20 bytes) are those of the payload all the same.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    light = written(rows.select("sha1", "size", "id"), "payloads")
    again = light.where(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.min("id").alias("first"), F.count("id").alias("n")).where("n > 1").drop("n")
    again = written(again, "repeated")
    repeats = KeyFilter(again, "sha1", "size")
    maybe = repeats.marked(light, "repeats", F.col("sha1"), F.col("size")).where("repeats").drop("repeats")
    # the rows among these that keep their payload: all but those that surely refer to another
    keep = split_join(maybe, again, ["sha1", "size"], how="left").where("first is null or id <= first").select("sha1", "id")
    flagged = repeats.marked(rows, "repeats", F.col("sha1"), F.col("size"))
    flagged = KeyFilter(keep, "sha1", "id").marked(flagged, "keeps", F.col("sha1"), F.col("id"))
    nowhere = F.lit(None).cast("long").alias("refers_to")
    alone = flagged.where(~F.col("repeats") | F.col("id").isNull()).select("id", "url", "payload", "size", "sha1", nowhere)
    some = flagged.where(F.col("repeats") & F.col("id").isNotNull()).select("id", "url", F.when(F.col("keeps"), F.col("payload")).alias("payload"), "sha1", "size")
    met = split_join(some, again, ["sha1", "size"], light.select("sha1", "size"), "left")
    met = met.select("id", "url", "payload", "size", "sha1", F.when(F.col("id") > F.col("first"), F.col("first")).alias("refers_to"))
    return alone.unionByName(met)


def write_archives(rows: DataFrame, path: str, max_bytes: int = 1 << 28) -> DataFrame:
    """Write the rows of with_revisits() to files under ``path``; returns (path, records, bytes) of each file, when run.

    Keep what it returns as a table (store.written()): a second run of the frame writes all files again.
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(path)
        store.create_dir(root, recursive=True)
        part, k, out, done = TaskContext.get().partitionId(), 0, None, []

        def close():
            nonlocal out, k
            if out is None:
                return
            stream, name, n, size = out
            stream.close()
            final = f"{root}/part-{part:05d}-{k:05d}-{name.rsplit('-', 1)[1]}.warc.gz"
            store.move(name, final)
            done.append((f"{path.rstrip('/')}/{final.rsplit('/', 1)[1]}", n, size))
            out, k = None, k + 1

        for batch in batches:
            for r in range(len(batch)):
                page, url, payload, size, sha1, refers = (batch.column(c)[r].as_py() for c in ("id", "url", "payload", "size", "sha1", "refers_to"))
                if out is None:
                    name = f"{root}/.writing-{uuid.uuid4().hex}"
                    out = [store.open_output_stream(name, compression=None), name, 0, 0]
                data = record(page, url, payload, refers, (size, base64.b32encode(sha1).decode()) if refers is not None else None)
                out[0].write(data)
                out[2] += 1
                out[3] += len(data)
                if out[3] >= max_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "records", "bytes"), d)) for d in done], schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return rows.mapInArrow(write, "path string, records long, bytes long")


def read_archives(files: DataFrame, keep_payload: bool = False, strict: bool = True) -> DataFrame:
    """The records of the files that ``files`` names in ``path``, one task a few files.

    page_id, url, payload_bytes and payload_digest (of the full payload: counted and computed for
    responses, as stated by revisits), record_type, refers_to, verified (framing and digests hold; with ``strict``
    an error, if not) and payload (null unless kept).
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("verified", pa.bool_()), ("payload", pa.binary())]
    schema = pa.schema(kinds)

    def number(value: str | None) -> int | None:
        text = (value or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def read(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    held, size = [], 0
                    for headers, n, digest, payload, good in records(stream, keep_payload):
                        if strict and not good:
                            raise ValueError(f"{path}: the digests of {headers.get('warc-record-id')} don't hold")
                        held.append((number(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, headers["warc-type"], number(headers.get("warc-refers-to")), good, payload))
                        size += len(payload or b"") + 200
                        if size > 1 << 22:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), kinds)], schema=schema)

    n = files.count()
    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, verified boolean, payload binary"
    return files.select("path").repartition(max(n, 1)).mapInArrow(read, ddl)
