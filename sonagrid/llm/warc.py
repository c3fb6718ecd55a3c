"""WARC archives as chunked record tables.

A payload longer than a chunk is written as WARC segments, each a record of its own: a first record and continuation
records that carry its id and their number. The separator after every WARC record, two line ends, is the text sink's
row separator, so Spark's own commit protocol writes the archives to any store, and a task that is lost is run again.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, prepare, released

SEP = b"\r\n\r\n"
CHUNK = 1 << 20
#: Payloads below this many bytes are never deduplicated.
LEAST = 100
#: Parts into which the rows of one digest are dealt.
SALTS = 16
DATE = "1970-01-01T00:00:00Z"
CHUNKS = "page_id long, record_id string, record_type string, refers_to long, chunk_no int, chunk binary, payload_bytes long, payload_digest string, last boolean, digest_ok boolean"


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest and first: the smallest page_id of equal payloads of ``least`` bytes or more.

    Digests are grouped with map-side sums; only those that repeat are joined back, and both sides are dealt by digest
    and a salt, so that the copies of one payload don't meet in one task.
    """
    rows = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.where("n > 1").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return salted.join(firsts, ["digest", "salt"], "left").drop("salt")


def _header(fields: list[tuple[str, object]]) -> bytes:
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields)]).encode() + SEP


def records(page_id: int | None, url: str | None, payload: memoryview, digest: str, first: int | None, chunk: int) -> Iterator[bytes]:
    """The WARC records of one page, without their closing separator; none holds more than ``chunk`` payload bytes."""
    own = record_id(page_id)
    revisit = first is not None and page_id != first
    fields: list[tuple[str, object]] = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", own), ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~")), ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", len(payload)), ("X-Page-ID", "" if page_id is None else page_id), ("Content-Type", "application/http; msgtype=response"),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d" % len(payload) + SEP
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(first)), ("X-Refers-To-Page", first), ("Content-Length", 0)]
        yield _header(fields)
        return
    parts = range(0, len(payload), chunk) if len(payload) > chunk else [0]
    for k, at in enumerate(parts):
        block = payload[at : at + chunk]
        if k == 0:
            more = [("WARC-Segment-Number", 1)] if len(parts) > 1 else []
            yield b"".join([_header([*fields, *more, ("Content-Length", len(http) + len(block))]), http, block])
        else:
            more = [("WARC-Segment-Total-Length", len(http) + len(payload))] if k == len(parts) - 1 else []
            segment = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{k + 1}')}>"
            yield b"".join([_header([("WARC-Type", "continuation"), ("WARC-Record-ID", segment), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k + 1), *more, ("Content-Length", len(block))]), block])


def write_warc(pages: DataFrame, path: str, *, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzipped WARC files under ``path``.

    A null html is an empty payload, a null url an empty one, a null page_id stays null and comes after all others;
    rows that repeat the smallest page_id of equal payloads are responses too. Other columns are ignored.
    """
    prepare(pages.sparkSession)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes] = []
            held = 0
            for page_id, url, payload, digest, first in zip(*batch.columns, strict=True):
                view = memoryview(payload.as_buffer())
                for r in records(page_id.as_py(), url.as_py(), view, digest.as_py(), first.as_py(), chunk):
                    out.append(r)
                    held += len(r)
                    if held >= 4 * chunk:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = marked(pages, least).select("page_id", "url", "payload", "digest", "first").mapInArrow(run, "value binary")
    lines.select(F.col("value").cast("string")).write.option("lineSep", SEP.decode()).option("compression", "gzip").text(path)


class Parser:
    """Incremental WARC reader: takes bytes as they come, gives chunk rows, and holds at most one chunk.

    The running SHA-256 and length of a payload go on through its segments; each row carries them as they stand.
    """

    def __init__(self, chunk: int):
        self.chunk, self.buffer, self.at, self.left = chunk, bytearray(), "head", 0
        self.fields: dict[str, str] = {}
        self.origin: dict[str, str] | None = None
        self.sha, self.total, self.number, self.skip = hashlib.sha256(), 0, 0, False

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while True:
            if self.at == "head":
                end = self.buffer.find(SEP)
                if end < 0:
                    if len(self.buffer) > 1 << 20:
                        raise ValueError("no end of a WARC header within 1 MiB")
                    return
                self._begin(bytes(self.buffer[:end]).decode("utf-8", "replace"))
                del self.buffer[: end + 4]
                self.at = "block"
            if self.at == "block":
                take = min(self.left, len(self.buffer), self.chunk + 4096)
                if take < self.left and len(self.buffer) < self.chunk + 4096:
                    return
                piece = bytes(self.buffer[:take])
                del self.buffer[:take]
                self.left -= take
                yield from self._piece(piece)
                if self.left:
                    continue
                self.at = "tail"
            if len(self.buffer) < 4:
                return
            if self.buffer[:4] != SEP:
                raise ValueError("a WARC record does not end after its Content-Length")
            del self.buffer[:4]
            self.at = "head"

    def _begin(self, head: str) -> None:
        first, *lines = head.split("\r\n")
        if not re.fullmatch(r"WARC/1\.\d", first):
            raise ValueError(f"no WARC record: {first[:60]!r}")
        self.fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        self.left = int(self.fields["content-length"])
        if self.fields["warc-type"] == "continuation":
            if self.origin is None or self.origin["warc-record-id"] != self.fields["warc-segment-origin-id"] or int(self.fields["warc-segment-number"]) != self.number + 1:
                raise ValueError("a WARC segment is missing")
            self.number += 1
        else:
            self.origin, self.number = self.fields, 1
            self.sha, self.total, self.row = hashlib.sha256(), 0, 0
            self.skip = self.fields.get("content-type", "").startswith("application/http")

    def _piece(self, piece: bytes) -> Iterator[tuple]:
        top = self.origin
        if top["warc-type"] not in ("response", "revisit"):
            return
        if self.skip and piece:
            piece = piece[piece.index(SEP) + 4 :]
            self.skip = False
        self.sha.update(piece)
        self.total += len(piece)
        self.row += 1
        open_segments = "warc-segment-number" in top and "warc-segment-total-length" not in self.fields
        last = not self.left and not open_segments
        said = top.get("warc-payload-digest", "").removeprefix("sha256:")
        revisit = top["warc-type"] == "revisit"
        got, size = self.sha.copy().hexdigest(), self.total
        if revisit:
            got, size = said, int(top.get("x-payload-length") or 0)
        page, refers = top.get("x-page-id"), top.get("x-refers-to-page")
        yield (int(page) if page else None, top["warc-record-id"], top["warc-type"], int(refers) if refers else None, self.row, piece, size, got, last, (got == said or not said) if last else None)


def read_warc(spark: SparkSession, path: str, *, chunk: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The chunked record table of gzipped WARC files under ``path``.

    A row for each chunk of each response or revisit record: page_id, record_id, record_type, refers_to, chunk_no (from
    1), chunk (null without ``payloads``), payload_bytes and payload_digest up to and with this chunk, last, and in the
    last chunk digest_ok: whether the payload has the digest that its header states. A file is read front to back by
    one task (gzip doesn't split) in rows of at most a segment. A revisit has one row, with the length and digest of
    the full payload. An empty payload has one empty chunk. No files give no rows.
    """
    prepare(spark)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(chunk)
        schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("chunk_no", pa.int32()), ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()), ("digest_ok", pa.bool_())])
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for value in batch.column(0):
                for data in (value.as_buffer().to_pybytes(), SEP):
                    for row in parser.feed(data):
                        rows.append(row if payloads else (*row[:5], None, *row[6:]))
                        held += len(row[5]) if payloads else 100
                if held >= 4 * chunk:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        if parser.at != "head" or parser.buffer:
            raise ValueError("a WARC file ends inside a record")

    lines = spark.read.schema("value string").option("lineSep", SEP.decode()).text(path)
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, CHUNKS)
