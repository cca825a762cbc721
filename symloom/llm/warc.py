"""WARC archives: a writer that refers repeats to their first copy, and a sequential reader.

Every record is a gzip member of its own. The reader takes any byte stream in blocks of BLOCK bytes and inflates one member
after another, at most BLOCK bytes at a time; Content-Length frames the record's block, and both digests grow with each
piece, so a payload that isn't asked for is never held. Of payloads that are equal (by SHA-1), the one with the smallest page_id is written as
``response``, the others as ``revisit`` records without payload that name it.

The set of repeated payloads comes from a combinable minimum for each digest; only groups of two or more are joined
back, broadcast while they fit; otherwise pages are shuffled by digest and one of SALTS, so a payload that fills a third
of all rows is split. What is read back is checked as well: the record that a revisit names is there, with its length
and digest. Each writing task makes its own files (rolled at FILE_BYTES),
named at random; the reader only visits files that finished tasks listed, so retried or lost tasks leave no trace.

Defined results: null html counts as empty. Rows that repeat the smallest id of a group are all responses. A null id
sorts last. Payloads shorter than ``min_bytes`` (0) are always responses. A digest or framing error raises. Only page_id,
url and html are read; other columns, of any name, don't matter. An empty table makes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symloom.llm.common import drop_at_exit, fresh_path, materialize, prepare, small

FILE_BYTES = 256 << 20
BLOCK = 1 << 16
SALTS = 32
#: Bytes of headers that a record may have.
HEAD = 1 << 20
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    headers: dict[str, str]
    http: bytes
    payload: bytes | None  # None if it wasn't asked for
    length: int  # of the payload as read


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%%%02X" % ord(c) for c in value)


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    sha = digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    named = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
    head = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": named(page_id), "WARC-Date": "2000-01-01T00:00:00Z",
        "WARC-Target-URI": _line(url or ""), "X-Page-ID": "" if page_id is None else str(page_id), "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha}", "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        head |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": named(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(text.encode("utf-8", "replace") + block + b"\r\n\r\n") + z.flush()


def members(stream: BinaryIO) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as its inflated pieces of at most BLOCK bytes, to be taken in order."""
    rest = stream.read(BLOCK)
    while rest:
        z = zlib.decompressobj(31)

        def pieces(z=z) -> Iterator[bytes]:
            nonlocal rest
            while not z.eof:
                if not rest and not (rest := stream.read(BLOCK)):
                    raise ValueError("the archive ends inside a record")
                piece = z.decompress(rest, BLOCK)
                rest = z.unused_data if z.eof else z.unconsumed_tail
                if piece:
                    yield piece

        yield pieces()
        if not z.eof:
            raise ValueError("a member wasn't read to its end")
        rest = rest or stream.read(BLOCK)


class _Pieces:
    """Reads inflated pieces by delimiter or length."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def head(self, what: str) -> bytes:
        """What is in front of the next empty line."""
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            piece = next(self.pieces, b"")
            if not piece or len(self.held) > HEAD:
                raise ValueError(f"no {what}")
            self.held += piece
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes."""
        while n:
            piece = self.held or next(self.pieces, b"")
            if not piece:
                raise ValueError("the block isn't framed by its Content-Length")
            self.held = piece[n:]
            piece = piece[:n]
            n -= len(piece)
            yield piece


def parse(pieces: Iterator[bytes], bodies: bool = True) -> Record:
    """Frames one record by its Content-Length and checks its digests."""
    r = _Pieces(pieces)
    lines = r.head("WARC record").split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    headers = {}
    for x in lines[1:]:
        k, _, v = x.partition(b":")
        headers[k.decode()] = v.strip().decode("utf-8", "replace")
    whole, own = hashlib.sha1(), hashlib.sha1()
    http, payload, length = b"", [], 0
    inside = False
    for piece in r.body(int(headers["Content-Length"])):
        whole.update(piece)
        if not inside:
            http += piece
            if len(http) > HEAD + 2 * BLOCK and b"\r\n\r\n" not in http:
                raise ValueError("no HTTP header")
            http, sep, piece = http.partition(b"\r\n\r\n")
            inside = bool(sep)
        if inside:
            own.update(piece)
            length += len(piece)
            if bodies:
                payload.append(piece)
    tail = r.held + b"".join(pieces)
    if tail != b"\r\n\r\n":
        raise ValueError("the block isn't framed by its Content-Length")
    if headers["WARC-Block-Digest"] != f"sha1:{base64.b32encode(whole.digest()).decode()}":
        raise ValueError("block digest")
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != f"sha1:{base64.b32encode(own.digest()).decode()}":
        raise ValueError("payload digest")
    return Record(headers, http, b"".join(payload) if bodies else None, length)


def read(stream: BinaryIO, bodies: bool = True) -> Iterator[Record]:
    return (parse(m, bodies) for m in members(stream))


def write(pages: DataFrame, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Writes the archives to the shared folder: (path, records) of each file, and the folder."""
    spark = pages.sparkSession
    prepare(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode(F.col("html").cast("string"), "UTF-8"), F.lit("").cast("binary")).alias("body"))
    p = p.withColumn("sha", F.unhex(F.sha1("body")))
    groups = p.where(F.length("body") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("sha", "first")
    groups = materialize(groups, "repeats")
    n = groups.count()
    side = small(groups, 128, n)
    if side is groups:  # too many to broadcast
        p = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        side = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    p = p.join(side, [c for c in ("sha", "salt") if c in side.columns], "left").select("page_id", "url", "body", F.when(F.length("body") >= min_bytes, F.col("first")).alias("first"))
    home = fresh_path(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pafs.FileSystem.from_uri(home)
        fs.create_dir(at, recursive=True)
        out, name, n, size = None, "", 0, 0
        for b in batches:
            for page, url, body, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "body", "first"))):
                if out is None:
                    name, n, size = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                data = encode(page, url, body, first, first is not None and page != first)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    made = materialize(p.mapInArrow(run, "path string, records long"), "archives")
    if made.limit(1).count():
        drop_at_exit(spark, home)
    return made, home


def scan(archives: DataFrame, home: str, bodies: bool = True) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of all records; without ``bodies`` the payload
    is read and checked, but not returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(home)
        for b in batches:
            for path, told in zip(b.column("path").to_pylist(), b.column("records").to_pylist()):
                n, rows = 0, []
                with fs.open_input_stream(path, compression=None) as f:
                    for r in read(f, bodies):
                        n += 1
                        h, full = r.headers, r.headers["WARC-Type"] == "response"
                        length = r.length if full else int(dict(x.split(b": ", 1) for x in r.http.split(b"\r\n")[1:])[b"Content-Length"])
                        rows.append((int(h["X-Page-ID"]) if h["X-Page-ID"] else None, h["WARC-Target-URI"], r.payload if full else None, length, h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], int(h["X-Refers-To-Page-ID"]) if not full else None))
                        if len(rows) == 256:
                            yield _batch(rows)
                            rows = []
                if n != told:
                    raise ValueError(f"{path}: {n} records, {told} were written")
                if rows:
                    yield _batch(rows)

    files = archives.repartitionByRange(max(1, min(archives.count(), 4096)), "path")
    return files.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def checked(records: DataFrame) -> DataFrame:
    """``records`` (written down), after each revisit was held against the response that it names. Only ids, lengths and
    digests meet; what equal revisits say is one row."""
    about = ["payload_bytes", "payload_digest"]
    said = records.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), *about).distinct()
    if said.join(records.where("record_type = 'response'").select("page_id", *about), ["page_id", *about], "left_anti").limit(1).count():
        raise ValueError("a revisit names no record of its payload")
    return records


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives and reads them back, without the payloads' bytes."""
    made, home = write(pages)
    return checked(materialize(scan(made, home, bodies=False).drop("payload", "url"), "records"))
