"""WARC archives written and read as chunk rows.

Writing. Payload digests and lengths come from the scan; payloads that occur more than once (of at
least `min_bytes`) get one response, that of the largest id, and the others are revisits of it. Only
the table of repeated digests is joined to the pages; it is written first, and broadcast if it has
BROADCAST_ROWS rows at most. Beyond that pages are dealt by digest, where adaptive execution splits
a digest that very many share. Each task writes archives of about `archive_bytes`, a
gzip member for each record, streaming slices of the payload. A file's name is new in each attempt
and counts only through the manifest row of the attempt that ended, so lost tasks leave no records.

Reading. Each archive is inflated as a stream. A payload becomes rows of (record id, chunk number)
with at most `chunk_bytes` each, and every row carries the payload's bytes and SHA-1 up to its own
end, so nothing holds a whole record. A revisit gives one empty chunk with its headers' digest and
length.

Chunk rows name their archive and the record's number in it, so that records stay apart whatever
their ids are. Null payloads are empty ones. A null id gives a record id of its own and is never
referred to; rows that share the largest id are all responses. Line ends in urls are escaped in headers.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, small_side

CHUNK_SCHEMA = "archive string, record_no long, record_id string, chunk_no int, id long, url string, record_type string, refers_to long, bytes_so_far long, digest_so_far string, last boolean, payload binary"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _urn(number) -> str:
    return f"<urn:record:{uuid.uuid4() if number is None else number}>"


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:record:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def record_head(number, url: str | None, payload_bytes: int, digest: str, refers_to, date: str) -> bytes:
    """The WARC header and the HTTP header of a record."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    body = payload_bytes if refers_to is None else 0
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_urn(number)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {payload_bytes}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(_HTTP) + body}",
    ]
    if refers_to is not None:
        lines[5:5] = [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + _HTTP


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0, archive_bytes: int = 256 << 20, level: int = 1, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages to archives below folder; (path, records, bytes) of each archive."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    base = base.withColumn("sha1", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    again = base.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null")
    again = scratch.save(again.select("sha1", "first_id"), "repeated")
    refers = F.when((F.col("size") >= min_bytes) & ~F.col("first_id").eqNullSafe(F.col("id")), F.col("first_id"))
    planned = base.join(small_side(again), "sha1", "left").select("id", "url", "payload", "sha1", "size", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        done, out = [], None

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, records, size))
                out = None

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "payload", "sha1", "size", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    path, records, size = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                number, url, refers = columns[0][i].as_py(), columns[1][i].as_py(), columns[5][i].as_py()
                digest = base64.b32encode(columns[3][i].as_py()).decode()
                member = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(member.compress(record_head(number, url, columns[4][i].as_py(), digest, refers, date)))
                if refers is None:
                    view = memoryview(columns[2][i].as_buffer())
                    for at in range(0, len(view), 1 << 20):
                        out.write(member.compress(view[at : at + (1 << 20)]))
                    size += len(view)
                out.write(member.compress(b"\r\n\r\n") + member.flush())
                records += 1
                if size >= archive_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "records", "bytes"])

    return scratch.save(planned.mapInArrow(run, "path string, records long, bytes long"), "manifest")


class Inflated:
    """A stream over gzip members that gives bounded pieces."""

    def __init__(self, raw, piece: int = 1 << 18):
        self.raw, self.piece, self.held, self.at = raw, piece, b"", 0
        self.member, self.rest, self.over = None, b"", False

    def _more(self) -> bool:
        while not self.over:
            if not self.rest:
                self.rest = self.raw.read(self.piece)
                if not self.rest:
                    if self.member is not None:
                        raise EOFError("an archive ends within a member")
                    self.over = True
                    return False
            if self.member is None:
                self.member = zlib.decompressobj(31)
            got = self.member.decompress(self.rest, self.piece)
            self.rest = self.member.unconsumed_tail
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            if got:
                self.held, self.at = self.held[self.at :] + got, 0
                return True
        return False

    def line(self) -> bytes | None:
        """Up to and without the next CRLF; None at the end."""
        while (end := self.held.find(b"\r\n", self.at)) < 0:
            if not self._more():
                return None
        out, self.at = self.held[self.at : end], end + 2
        return out

    def take(self, n: int) -> bytes:
        """n bytes at most, at least one unless the stream ends."""
        if self.at >= len(self.held) and not self._more():
            return b""
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def read_records(raw, chunk_bytes: int) -> Iterator[tuple]:
    """The chunk rows (CHUNK_SCHEMA from record_no on) of one archive."""
    source, place = Inflated(raw), -1
    while True:
        place += 1
        opening = source.line()
        while opening == b"":
            opening = source.line()
        if opening is None:
            return
        if not opening.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = {}
        while line := source.line():
            name, _, value = line.partition(b":")
            head[name.decode().lower()] = value.strip().decode()
        left = int(head["content-length"])
        while line := source.line():
            left -= len(line) + 2
        left -= 2
        urn, kind = head["warc-record-id"], head["warc-type"]
        common = (_number(urn), head.get("warc-target-uri"), kind)
        declared = head["warc-payload-digest"].removeprefix("sha1:")
        if kind == "revisit":
            yield place, urn, 0, *common, _number(head["warc-refers-to"]), int(head["warc-payload-length"]), declared, True, b""
            continue
        sha, total, number = hashlib.sha1(), 0, 0
        while True:
            chunk = b""
            parts, size = [], 0
            while size < chunk_bytes and left:
                got = source.take(min(left, chunk_bytes - size))
                if not got:
                    raise EOFError("an archive ends within a record")
                parts.append(got)
                size += len(got)
                left -= len(got)
            chunk = b"".join(parts)
            sha.update(chunk)
            total += size
            digest = base64.b32encode(sha.digest()).decode()
            if not left and digest != declared:
                raise ValueError(f"{urn}: the payload does not have its declared digest")
            yield place, urn, number, *common, None, total, digest, not left, chunk
            number += 1
            if not left:
                break


def read_archives(manifest: DataFrame, chunk_bytes: int = 1 << 20, flush_bytes: int = 4 << 20) -> DataFrame:
    """The chunk rows of all archives in manifest (column path)."""
    fields = [("archive", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("chunk_no", pa.int32()), ("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("bytes_so_far", pa.int64()), ("digest_so_far", pa.string()), ("last", pa.bool_()), ("payload", pa.binary())]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(name, compression=None) as raw:
                    for row in read_records(raw, chunk_bytes):
                        rows.append((path, *row))
                        size += len(row[-1])
                        if size >= flush_bytes or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, CHUNK_SCHEMA)


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: (id_col, payload_bytes, payload_digest, record_type, refers_to).

    The bytes of responses are counted from their chunk rows; revisits have what their headers say.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    manifest = write_archives(pages, scratch.path("archives"), scratch, id_col, url_col, payload_col, min_bytes)
    chunks = read_archives(manifest).select("archive", "record_no", "id", "record_type", "refers_to", "bytes_so_far", "digest_so_far", "last", F.octet_length("payload").cast("long").alias("held"))
    final = lambda c: F.max(F.when(F.col("last"), F.col(c)))
    size = F.when(F.col("record_type") == "response", F.sum("held")).otherwise(final("bytes_so_far")).alias("payload_bytes")
    records = chunks.groupBy("archive", "record_no", "id", "record_type", "refers_to").agg(size, final("digest_so_far").alias("payload_digest"))
    return records.select(F.col("id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
