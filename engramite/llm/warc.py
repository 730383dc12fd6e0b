"""WARC archives written and read as chunked record tables.

A payload is never handled whole: it travels as (record, chunk number) rows, is written chunk by chunk into one gzip
member per record, and is read back as chunk rows that carry the SHA-1 of the payload up to and including the chunk.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir, sliced

CHUNK = 1 << 20
ROTATE = 256 << 20
#: Groups of equal payloads up to which their table is broadcast (about 60 bytes each); beyond it both sides shuffle.
BROADCAST_ROWS = 200_000
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """``(page_id, url, payload, n_bytes, sha1, refers_to)``: of equal payloads of ``min_bytes`` or more, all but the
    one with the largest id refer to it. A null body is an empty payload; a row with a null id may refer, never be referred to."""
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.encode(F.coalesce(F.col(f"`{body_col}`").cast("string"), F.lit("")), "utf-8").alias("payload"))
    rows = rows.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1("payload").alias("sha1"))
    same = cut(rows.where(F.col("n_bytes") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).where("n > 1 and top is not null").select("sha1", "top"))
    same = F.broadcast(same) if same.count() <= BROADCAST_ROWS else same
    return rows.join(same, "sha1", "left").withColumn("refers_to", F.when((F.col("n_bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("top")), F.col("top"))).drop("top")


def chunks(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """One row per record and chunk; a record without a payload to store has one empty chunk."""
    stored = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    numbered = found.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((stored - 1) / size)))).alias("chunk_no"))
    part = F.when(F.col("refers_to").isNull(), F.substring("payload", (F.col("chunk_no") * size + 1).cast("int"), F.lit(size))).otherwise(F.lit(b""))
    return numbered.select("page_id", "url", "n_bytes", "sha1", "refers_to", "chunk_no", part.alias("data"))


def _urn(page) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def _header(page, url, n, sha1, refers) -> bytes:
    head = HTTP.format(n=n)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {''.join(c if 32 < ord(c) < 127 else ''.join(f'%{b:02X}' for b in c.encode('utf-8', 'replace')) for c in url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", f"WARC-Payload-Length: {n}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(head) + (n if refers is None else 0)}",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: {_urn(refers)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join(lines) + "\r\n\r\n" + head).encode()


def write(found: DataFrame, folder: str, rotate: int = ROTATE) -> DataFrame:
    """Writes the records below ``folder`` (any URI that Arrow opens) and returns the manifest ``(path, n_records)``.

    Every attempt of a task writes under names of its own; only files of the attempt that ended are in the manifest,
    which is itself written to the shared folder before anything reads it.
    """

    def run(batches):
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, gz, path, n, done = None, None, "", 0, []
        for b in batches:
            for page, url, size, sha1, refers, no, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if no == 0:
                    if gz:
                        out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                    if out and out.tell() > rotate:
                        out.close()
                        done.append((path, n))
                        out = None
                    if not out:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, path, n = store.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
                    gz, n = zlib.compressobj(6, zlib.DEFLATED, 31), n + 1
                    out.write(gz.compress(_header(page, url, size, sha1, refers)))
                out.write(gz.compress(data))
        if out:
            out.write(gz.compress(b"\r\n\r\n") + gz.flush())
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": [x[0] for x in done], "n_records": [x[1] for x in done]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return cut(chunks(found).mapInArrow(sliced(run), "path string, n_records long"))


class _Stream:
    """Bytes of a multi-member gzip file, read and inflated a piece at a time."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.z, self.have, self.left = raw, piece, zlib.decompressobj(31), b"", b""
        self.inside = False  # a member has begun and not ended

    def more(self) -> bool:
        if self.z.eof:
            self.z, self.left = zlib.decompressobj(31), self.z.unused_data  # the unconsumed tail may repeat it
        source = self.left or self.raw.read(self.piece)
        if not source:
            return False
        got = self.z.decompress(source, self.piece)
        self.left, self.inside = self.z.unconsumed_tail, not self.z.eof
        self.have += got
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.have.find(mark)) < 0:
            if not self.more():
                return None
        found, self.have = self.have[:at], self.have[at + len(mark) :]
        return found

    def take(self, most: int) -> bytes:
        while len(self.have) < most and self.more():
            pass
        found, self.have = self.have[:most], self.have[most:]
        return found


CHUNKS = "page_id long, record_type string, refers_to long, chunk_no long, chunk_bytes long, bytes_so_far long, sha1_so_far string, last boolean, payload_bytes long, payload_digest string"


def read(manifest: DataFrame, size: int = CHUNK, data: bool = False) -> DataFrame:
    """Chunk rows of the archives: ``CHUNKS``, and ``data`` if asked for. ``bytes_so_far`` and ``sha1_so_far`` run over the
    payload up to the chunk; ``payload_bytes`` and ``payload_digest`` are what the record's header declares. An archive that
    ends early, or holds another number of records than the manifest's ``n_records``, is an error."""
    names = [x.split()[0] for x in CHUNKS.split(", ")] + ["data"] * data
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.string()] + [pa.binary()] * data
    schema = pa.schema(list(zip(names, kinds, strict=True)))
    number = lambda urn: None if urn is None or urn.endswith(":none>") else int(urn[len("<urn:page:") : -1])

    def rows(path, records):
        store, at = pafs.FileSystem.from_uri(path)
        n = 0
        with store.open_input_stream(at, compression=None) as raw:
            s = _Stream(raw)
            while (head := s.until(b"\r\n\r\n")) is not None:
                h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                http = s.until(b"\r\n\r\n")
                left, done, no, sha = int(h["Content-Length"]) - len(http) - 4, 0, 0, hashlib.sha1()
                declared = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                while True:
                    part = s.take(min(size, left))
                    if len(part) < min(size, left):
                        raise ValueError(f"{path} ends inside a record")
                    left, done = left - len(part), done + len(part)
                    sha.update(part)
                    yield (number(h["WARC-Record-ID"]), h["WARC-Type"], number(h.get("WARC-Refers-To")), no, len(part), done, sha.hexdigest(), left == 0, int(h["WARC-Payload-Length"]), declared, *[part] * data)
                    no += 1
                    if not left:
                        break
                if s.take(4) != b"\r\n\r\n":
                    raise ValueError(f"{path}: no end of record")
                n += 1
            if s.have or s.inside or records is not None and n != records:
                raise ValueError(f"{path} is cut off: {n} whole records of {records}")

    def run(batches):
        for b in batches:
            for path, records in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held, weight = [], 0
                for row in rows(path, records):
                    held.append(row)
                    weight += 200 + row[4] * data
                    if weight > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)
                        held, weight = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)], schema=schema)

    # a task reads what one task wrote: dealing the few short paths anew would let them be merged into one task
    known = F.col("n_records") if "n_records" in manifest.columns else F.lit(None).cast("long").alias("n_records")
    return manifest.select("path", known).mapInArrow(sliced(run), CHUNKS + ", data binary" * data)


def archive(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Writes ``pages`` and reads the archives back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A response's length and digest are those of the payload as read; a revisit, which stores none, has its header's.
    Repeated rows are records each, under the same record id; an empty table gives no rows; columns other than the three
    are not read, whatever their names. A payload is a cell of the table when it is written, so its length and digest are
    taken of the cell; from there on it travels in chunks.
    """
    folder = folder or shared_dir(pages.sparkSession, "warc")
    ends = read(write(records(pages, id_col, url_col, body_col), folder)).where("last")
    stored = F.col("record_type") == "response"
    return ends.select("page_id", F.when(stored, F.col("bytes_so_far")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(stored, F.col("sha1_so_far")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to")
