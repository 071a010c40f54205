"""WARC archives: write captures as linked records, read records back, assemble them into one row per capture.

``write_archives`` gives every capture a request, a response or revisit, and a metadata record; the last two name
the request in WARC-Concurrent-To.  Of captures with equal payloads the one with the least id is the response, the
others are revisits that refer to it.  Which id is the least per payload comes from a partially combined minimum by
SHA-256, published as sorted arrays, so payloads are not shuffled to be written.  Tasks write files of bounded
size, one gzip member per record, under another name until they are whole; the manifest names the files that count.

``read_records`` streams archives (gzip or plain, any members) and holds one record at a time.  ``captures`` joins
the records: each has its own id and those it is concurrent to as hubs, and records with a common hub belong
together (a metadata record may also hang on the capture's request).  A hub is reduced to its least request and its
least metadata record with their numbers before the join, so no hub makes pairs; look-ups of ids that very many
records name (the response of many revisits) go by (id, salt), and only as many of these are made as occur.

Defined results: null payload counts as empty; a null or repeated url has no meaning for the links; a null id is
never the least (rows with null ids only are responses); repeated rows of the least id are all responses; every
row is a capture; a refers-to whose response is not there gives null; a broken archive raises an error that names
the file; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

from .arrays import SortedArrays, shard_bits, shard_of, shared_folder, write_arrays
from .common import partitions, u64

# FIXED VALUES of the format
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: compressed bytes after which a task starts another file; bytes read at once (what follows a gzip member in them
#: is copied, so not many); salts of a look-up
FILE_BYTES, READ_BYTES, SALTS = 64 << 20, 1 << 15, 64
DATE = "1970-01-01T00:00:00Z"
PRINCIPAL = ("response", "revisit", "resource")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(':'.join(map(str, parts)).encode()).digest()[:16], version=5)}>"


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record; headers without a value are left out."""
    lines = [VERSION, *[f"{k}: {v}" for k, v in headers if v is not None], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ------------------------------------------------------------------ writing
class _Files:
    """Files of a task: written under another name, renamed when whole."""

    def __init__(self, folder: str, limit: int):
        context = TaskContext.get()
        self.folder, self.limit, self.part = folder, limit, context.partitionId() if context else 0
        self.attempt = context.taskAttemptId() if context else os.getpid()
        self.done, self.out = [], None

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.path = f"{self.folder}/part-{self.part:06d}-{len(self.done):04d}.warc.gz"
            self.out, self.size, self.records = open(f"{self.path}.{self.attempt}.part", "wb"), 0, 0  # noqa: SIM115
            info = f"software: ledgerlens\r\nformat: {VERSION}\r\n".encode()
            head = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", self.path)), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")]
            self._put(record(head, info))
        self._put(data)

    def _put(self, data: bytes) -> None:
        z = member(data)
        self.out.write(z)
        self.size += len(z)
        self.records += 1

    def end(self) -> None:
        """Close the file if one is open."""
        if self.out is not None:
            self.out.close()
            os.replace(f"{self.path}.{self.attempt}.part", self.path)
            self.done.append((self.path, self.records, self.size))
            self.out = None

    def full(self) -> bool:
        return self.out is not None and self.size >= self.limit


def transaction(capture, url: str | None, payload: bytes, first, marks: tuple[int, int], place: tuple, date: str) -> list[bytes]:
    """The request, response or revisit (``first`` is the least id of the payload) and metadata record of a capture."""
    uri = None if url is None else quote(url, safe="!#$%&'()*+,/:;=?@[]~")
    rest = (uri or "").partition("://")[2]
    host, slash, path = rest.partition("/")
    asked = record_id("request", *place)
    common = [("WARC-Target-URI", uri), ("WARC-Date", date)]
    get = f"GET /{path if slash else ''} HTTP/1.1\r\nHost: {host}\r\n\r\n".encode()
    out = [record([("WARC-Type", "request"), ("WARC-Record-ID", asked), *common, ("Content-Type", "application/http;msgtype=request")], get)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    again = first is not None and capture != first
    head = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", record_id("revisit", *place) if again else record_id("response", capture, *marks)), *common,
            ("WARC-Concurrent-To", asked), ("WARC-Payload-Digest", f"sha1:{payload_digest(payload)}"), ("Content-Type", "application/http;msgtype=response")]
    if again:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", first, *marks))]
    out.append(record(head, http if again else http + payload))
    fields = b"" if capture is None else f"capture-id: {capture}\r\n".encode()
    out.append(record([("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", *place)), *common, ("WARC-Concurrent-To", asked), ("Content-Type", "application/warc-fields")], fields))
    return out


def _least(arrays: SortedArrays, one: np.ndarray, two: np.ndarray) -> list:
    """The least id of each payload that several captures have, by both marks of the payload; None for others."""
    found = arrays.find_any(one, {"rank": np.int64(0)})
    out = [None] * len(one)
    for i in np.flatnonzero(found["found"]).tolist():
        shard, at = int(shard_of(one[i : i + 1], arrays.bits)[0]), int(found["rank"][i])
        keys, other = arrays.column(shard, "key"), arrays.column(shard, "other")
        while at < len(keys) and keys[at] == one[i]:
            if other[at] == two[i]:
                out[i] = int(arrays.column(shard, "first")[at])
                break
            at += 1
    return out


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   least_bytes: int = 0, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Write the archives of ``pages`` into ``folder``; returns their manifest ``path, records, bytes``."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    text = F.sha2("payload", 256)
    rows = rows.withColumn("sha", text).select("id", "url", "payload", F.xxhash64("sha").alias("one"), F.xxhash64(F.lit("other"), "sha").alias("two"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy(F.col("one").alias("key"), F.col("two").alias("other")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    arrays = shared_folder(spark, "warc-first")
    bits = shard_bits(partitions(rows))
    write_arrays(same.where("n > 1 AND first IS NOT NULL"), arrays, bits, ["other", "first"])
    held = SortedArrays(arrays, bits)
    run_id = os.path.basename(folder.rstrip("/"))

    def run(batches):
        files, n = _Files(folder, file_bytes), 0
        for b in batches:
            firsts = _least(held, u64(b.column("one")), np.asarray(b.column("two")))
            columns = [b.column(c) for c in ("id", "url", "payload", "one", "two")]
            for i, first in enumerate(firsts):
                capture, url, data, one, two = (c[i].as_py() for c in columns)
                for data_ in transaction(capture, url, data, first if len(data) >= least_bytes else None, (one, two), (run_id, files.part, n), date):
                    files.write(data_)
                n += 1
                if files.full():
                    files.end()
        files.end()
        if files.done:
            path, records, size = zip(*files.done, strict=True)
            yield pa.RecordBatch.from_pydict({"path": pa.array(path), "records": pa.array(records, pa.int64()), "bytes": pa.array(size, pa.int64())})

    return rows.mapInArrow(run, "path string, records long, bytes long").checkpoint()


# ------------------------------------------------------------------ reading
def _blank_line(held: bytearray) -> tuple[int, int] | None:
    """Where the first empty line's mark starts, and its size."""
    at = held.find(b"\r\n\r\n")
    bare = held.find(b"\n\n", 0, at if at >= 0 else len(held))
    return (bare, 2) if bare >= 0 else (at, 4) if at >= 0 else None


class _Stream:
    """The bytes of an archive: plain, or gzip members one after the other."""

    def __init__(self, path: str):
        self.path, self.file, self.held, self.z, self.ended = path, open(path, "rb"), bytearray(), None, False  # noqa: SIM115
        start = self.file.read(2)
        self.file.seek(0)
        self.gzip = start == b"\x1f\x8b"

    def _more(self) -> bool:
        data = self.file.read(READ_BYTES)
        if not data:
            if not self.ended and self.z is not None and not self.z.eof:
                raise ValueError(f"{self.path}: the last gzip member is cut off")
            self.ended = True
            return False
        if not self.gzip:
            self.held += data
            return True
        while data:
            if self.z is None or self.z.eof:
                self.z = zlib.decompressobj(31)
            try:
                self.held += self.z.decompress(data)
            except zlib.error as e:
                raise ValueError(f"{self.path}: {e}") from e
            data = self.z.unused_data
        return True

    def lines(self) -> list[str] | None:
        """The lines up to an empty one; None at the end of the archive.  Empty lines before them are skipped."""
        while True:
            skip = 0
            while self.held[skip : skip + 1] in (b"\r", b"\n"):
                skip += 1
            del self.held[:skip]
            if (found := _blank_line(self.held)) is not None:
                at, size = found
                head = bytes(self.held[:at]).decode("utf-8", "replace")
                del self.held[: at + size]
                return head.splitlines()
            if not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError(f"{self.path}: the last record is cut off")
                return None

    def read(self, n: int):
        """The next n bytes, in pieces."""
        while n:
            if not self.held and not self._more():
                raise ValueError(f"{self.path}: the last record is cut off")
            piece = bytes(self.held[:n])
            del self.held[:n]
            n -= len(piece)
            yield piece


def _headers(lines: list[str]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for line in lines:
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}".strip())
        elif ":" in line:
            k, _, v = line.partition(":")
            out.append((k.strip().lower(), v.strip()))
    return out


def _split(pieces_):
    """The HTTP head of a block as lines, and its payload in pieces."""
    held = bytearray()
    source = iter(pieces_)
    for piece in source:
        held += piece
        if (found := _blank_line(held)) is not None:
            at, size = found
            rest = bytes(held[at + size :])

            def payload(rest=rest):
                if rest:
                    yield rest
                yield from source

            return bytes(held[:at]).decode("utf-8", "replace").splitlines(), payload()
    return bytes(held).decode("utf-8", "replace").splitlines(), iter(())


def parse(path: str, payloads: bool):
    """The records of an archive as dicts."""
    stream, n = _Stream(path), 0
    while (lines := stream.lines()) is not None:
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{path}: record {n} has no version line")
        head = _headers(lines[1:])
        first = dict(reversed(head))
        size = first.get("content-length", "")
        if not size.isdigit():
            raise ValueError(f"{path}: record {n} has no length")
        block = stream.read(int(size))
        kind, content = first.get("warc-type", ""), first.get("content-type", "")
        out = {"file": path, "place": n, "record_id": first.get("warc-record-id"), "type": kind, "concurrent_to": [v for k, v in head if k == "warc-concurrent-to"],
               "refers_to": first.get("warc-refers-to"), "uri": first.get("warc-target-uri"), "date": first.get("warc-date"),
               "declared": (first.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "line": None, "fields": [],
               "payload": None, "payload_bytes": None, "payload_digest": None}
        if content.startswith("application/http"):
            lines, rest = _split(block)
            out["line"], out["fields"] = lines[0] if lines else None, _headers(lines[1:])
        elif content.startswith("application/warc-fields"):
            out["fields"], rest = _headers(b"".join(block).decode("utf-8", "replace").splitlines()), iter(())
        else:
            rest = block
        if kind in PRINCIPAL:
            digest, length, held = hashlib.sha1(), 0, []
            for piece in rest:
                digest.update(piece)
                length += len(piece)
                if payloads:
                    held.append(piece)
            if kind == "revisit":  # the full payload is the referred response's
                told = dict(reversed(out["fields"])).get("content-length", "")
                out["payload_bytes"], out["payload_digest"] = int(told) if told.isdigit() else None, out["declared"]
            else:
                out["payload_bytes"], out["payload_digest"] = length, base64.b32encode(digest.digest()).decode()
                out["payload"] = b"".join(held) if payloads else None
        else:
            for _ in rest:
                pass
        out["fields"] = list(dict(reversed(out["fields"])).items())
        yield out
        n += 1


_RECORD = ("at long, file string, place long, record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, declared string, line string, "
           "fields map<string,string>, payload binary, payload_bytes long, payload_digest string")
_RECORD_ARROW = pa.schema([("at", pa.int64()), ("file", pa.string()), ("place", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
                           ("uri", pa.string()), ("date", pa.string()), ("declared", pa.string()), ("line", pa.string()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_records(files: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the archives in ``files(path)``; a task streams whole files.  ``at`` numbers the records."""

    def run(batches):
        for b in batches:
            for path, number in zip(b.column("path").to_pylist(), b.column("number").to_pylist(), strict=True):
                held, size = [], 0
                for r in parse(path, payloads):
                    held.append(r | {"at": number << 32 | r["place"]})
                    size += 512 + len(r["payload"] or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, _RECORD_ARROW)

    # the list of files is short (one row per FILE_BYTES): numbered in order, and dealt evenly from one partition
    paths = files.select(F.col("path").cast("string").alias("path")).distinct().coalesce(1).sortWithinPartitions("path")
    paths = paths.withColumn("number", F.monotonically_increasing_id())
    return paths.repartition(max(1, paths.count())).mapInArrow(run, _RECORD)


# ------------------------------------------------------------------ assembly
def look_up(rows: DataFrame, found: DataFrame, key: str, spread: str, salts: int = SALTS) -> DataFrame:
    """Left join of ``rows`` with the unique ``found`` on ``key``, of which very many rows may have the same."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    seen = rows.where(F.col(key).isNotNull()).select(key, "_salt").distinct().join(found, key)
    return rows.join(seen, [key, "_salt"], "left").drop("_salt")


def captures(records: DataFrame, salts: int = SALTS) -> DataFrame:
    """One nested row per response, revisit or resource record, with its request, metadata and referred capture.

    ``verified``: the payload of a response has the digest that its record declares; a revisit declares that of
    the response it refers to (null if nothing is declared or the response is not there).
    """
    path = scratch_path(records.sparkSession, "warc-records")
    records.write.parquet(path)
    records = records.sparkSession.read.parquet(path)
    principal, kind = F.col("type").isin(*PRINCIPAL), F.col("type")
    linked = F.array_distinct(F.concat(F.array("record_id"), F.coalesce("concurrent_to", F.array().cast("array<string>"))))
    hubs = records.where(principal | kind.isin("request", "metadata")).select("at", "record_id", "type", F.explode(linked).alias("hub")).where("hub IS NOT NULL")
    q, m = F.when(kind == "request", F.col("record_id")), F.when(kind == "metadata", F.col("record_id"))
    held = hubs.where(~principal).groupBy("hub").agg(F.min(q).alias("q"), F.count(q).alias("nq"), F.min(m).alias("m"), F.count(m).alias("nm"))
    mine = look_up(hubs.where(principal).select("at", "hub"), held, "hub", "at", salts)
    mine = mine.groupBy("at").agg(F.min("q").alias("q"), F.max("nq").alias("nq"), F.min("m").alias("m"), F.max("nm").alias("nm")).checkpoint()
    # a request's own hubs lead to metadata that hangs on it
    through = look_up(hubs.where(kind == "request").select("at", F.col("record_id").alias("q"), "hub"), held.select("hub", "m", "nm"), "hub", "at", salts)
    through = through.where("m IS NOT NULL").groupBy("q").agg(F.min("m").alias("via"), F.max("nm").alias("nvia"))
    mine = look_up(mine, through, "q", "at", salts).select("at", "q", "nq", F.coalesce("m", "via").alias("m"), F.when(F.col("m").isNotNull(), F.col("nm")).otherwise(F.col("nvia")).alias("nm"))

    def one(type_: str, name: str) -> DataFrame:
        rows = records.where(kind == type_).groupBy("record_id").agg(F.min_by(F.struct("record_id", "uri", "date", "line", "fields"), F.struct("file", "place")).alias(type_))
        return rows.withColumnRenamed("record_id", name)

    rows = records.where(principal).select("at", "record_id", "type", "refers_to", "payload_digest", "declared").join(mine, "at", "left").checkpoint()
    rows = look_up(look_up(rows, one("request", "q"), "q", "at", salts), one("metadata", "m"), "m", "at", salts).drop("q", "m")
    rows = rows.withColumn("capture_id", F.element_at("metadata.fields", "capture-id")).checkpoint()
    target = rows.where("type <> 'revisit'").groupBy(F.col("record_id").alias("refers_to")).agg(F.min("capture_id").alias("_id"), F.min("payload_digest").alias("_digest"))
    rows = look_up(rows, target, "refers_to", "at", salts)
    compared = F.when(kind == "revisit", F.col("_digest")).otherwise(F.col("payload_digest"))
    rows = rows.select("at", "capture_id", (compared == F.col("declared")).alias("verified"),
                       F.when(F.col("refers_to").isNotNull(), F.struct(F.col("refers_to").alias("record_id"), F.col("_id").alias("capture_id"))).alias("refers_to"),
                       "request", "metadata", F.coalesce("nq", F.lit(0)).alias("n_requests"), F.coalesce("nm", F.lit(0)).alias("n_metadata"))
    bodies = records.where(principal).select("at", "record_id", "type", "uri", "date", "payload_digest", "payload_bytes", "payload", F.struct("line", "fields").alias("http"), "file", "place")
    return rows.join(bodies, "at").select("capture_id", "record_id", "type", "uri", "date", "payload_digest", "payload_bytes", "payload", "verified", "refers_to", "http",
                                          "request", "metadata", "n_requests", "n_metadata", "file", "place")


def round_trip(pages: DataFrame, payloads: bool = False, **options) -> DataFrame:
    """The captures of ``pages`` after they were written as archives in the shared folder and read back."""
    manifest = write_archives(pages, shared_folder(pages.sparkSession, "warc"), **options)
    return captures(read_records(manifest, payloads))
