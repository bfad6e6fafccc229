"""WARC archives without repeated payloads: write, and read back.

Only headers are shuffled to find repeats: page id, payload digest and length. An archive starts with a warcinfo record,
and each record is a gzip member of its own. Spark's text writer writes them, so through its commit protocol and to any
store that it knows, in files of about ``archive_bytes`` of records. Reading goes by Content-Length, so a payload may hold
any text, and inflates and parses as it goes.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import body, shared_path
from .tokens import slices

#: Fixed values of the base32 alphabet (RFC 4648), and of the digits that conv() uses for base 32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
RECORD_SCHEMA = "record_id string, page_id bigint, url string, record_type string, refers_to_id string, header_digest string, payload_bytes bigint, payload_digest string, intact boolean, payload binary"
#: Bytes of a gzip member at most. Its last byte, the highest of its length, is thus 0, which is the line end of the writer.
MEMBER = 8 << 20


def sha1_base32(data: Column) -> Column:
    """The bare upper-case base32 SHA-1 of a binary column: 160 bits are 32 digits, taken 20 bits at a time."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), DIGITS, BASE32)


def record_types(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Headers of ``pages``: each page's digest, length, and whether it repeats another page's payload.

    Columns: page_id, url, payload_bytes, payload_digest, refers_to (null for a response). Pages with equal payloads of
    at least ``min_bytes`` revisit that with the largest id; equality is by SHA-256 and length. Rows that repeat the
    largest id are responses alike. Null payloads are empty; a null id is a response only when its payload has no
    other. The join back deals a hot payload's pages by Spark's skew handling; no step gathers them.
    """
    payload = body(text_col).cast("binary")
    heads = pages.select(
        F.col(id_col).alias("page_id"), F.octet_length(payload).cast("bigint").alias("payload_bytes"),
        sha1_base32(payload).alias("payload_digest"), F.unhex(F.sha2(payload, 256)).alias("content"),
    )
    first = heads.groupBy("content", "payload_bytes").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
    # substring() gives this side an exchange of its own, without which Spark can't split a hot digest on the other side.
    repeated = first.where((F.col("n") > 1) & (F.col("payload_bytes") >= min_bytes)).select(F.substring("content", 1, 32).alias("of"), "best")
    joined = heads.join(repeated, heads["content"] == repeated["of"], "left")
    return joined.select("page_id", "payload_bytes", "payload_digest", "content", F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best")).alias("refers_to"))


def _record_id(page: Column, content_digest: Column) -> Column:
    """A stable urn:uuid for a page's record, from its id and digest."""
    h = F.sha2(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), content_digest).cast("binary"), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), parts[0], F.lit("-"), parts[1], F.lit("-5"), parts[2], F.lit("-8"), parts[3], F.lit("-"), parts[4], F.lit(">"))


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html",
    min_bytes: int = 0, date: str = "2020-01-01T00:00:00Z", archive_bytes: int = 32 << 20,
) -> None:
    """Write ``pages`` as WARC archives under ``path``: a response record for each payload, revisit records for repeats.

    Null html is an empty payload, a null url an empty target. ``date`` is the capture date that every record states.
    An empty table writes no records but warcinfo. Other columns are not read.
    """
    payload = body(text_col)
    total = pages.agg(F.sum(F.octet_length(payload) + F.lit(600)).alias("b")).first()["b"] or 1
    files = max(1, math.ceil(total / archive_bytes))
    # Payloads are dealt to archives by the hash on which headers join them, so they are shuffled once.
    key = lambda page, content: F.xxhash64(page, content)
    heads = record_types(pages, id_col, text_col, min_bytes).select(
        key("page_id", "content").alias("__key"), F.col("page_id").alias("__page"), F.col("content").alias("__content"), "payload_digest", "refers_to"
    ).distinct()
    rows = pages.select(F.col(id_col).alias("page_id"), body(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("content", F.unhex(F.sha2(F.col("payload").cast("binary"), 256))).withColumn("key", key("page_id", "content"))
    joined = rows.repartition(files, "key").join(heads, F.col("key") == F.col("__key"))
    joined = joined.where(F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("content") == F.col("__content")))
    crlf = "\r\n"
    is_revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload")
    http = F.concat(F.lit(HTTP_HEAD), F.lit("Content-Length: "), size.cast("string"), F.lit(crlf + crlf))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(is_revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("payload_digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", " ")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("X-Page-ID: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.when(is_revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("payload_digest")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    record = F.concat(F.concat_ws(crlf, *fields), F.lit(crlf + crlf), block, F.lit(crlf + crlf))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([_member(_info(date))[:-1]], pa.binary())], names=["value"])
        for batch in batches:
            for at, n in slices(batch.column(0)):
                packed = [_member(x)[:-1] for x in batch.column(0).slice(at, n).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], names=["value"])

    # A string column takes the bytes as they are; each line's end completes its member.
    packed = joined.select(record.alias("value")).mapInArrow(members, "value binary").select(F.col("value").cast("string"))
    packed.write.option("lineSep", "\0").text(path)


def _member(record: bytes) -> bytes:
    """A record as a gzip member, or several where it is longer than MEMBER."""
    out = []
    for at in range(0, max(1, len(record)), MEMBER):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out += [packer.compress(record[at : at + MEMBER]), packer.flush()]
    return b"".join(out)


def _info(date: str) -> bytes:
    fields = b"software: cadenza\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{uuid.uuid4().urn}>\r\nWARC-Date: {date}\r\n"
    return f"{head}Content-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n".encode() + fields + b"\r\n\r\n"


def inflate(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of an archive of any number of gzip members, or of a plain one, piece by piece. Raises where it is cut off
    or something else follows a member."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + (1 << 20)] for at in range(0, len(data), 1 << 20))
        return
    at = 0
    while at < len(data):
        unpacker = zlib.decompressobj(31)
        while not unpacker.eof:
            fed = unpacker.unconsumed_tail or data[at : at + step]
            if not unpacker.unconsumed_tail:
                at += len(fed)
            if not fed:
                raise ValueError("the archive is cut off")
            yield unpacker.decompress(fed, 1 << 20)
        at -= len(unpacker.unused_data)


class _Source:
    """Bytes asked for by number or up to a mark, from an iterator of pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.at = pieces, bytearray(), 0

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is not None:
            if self.at > 1 << 20:
                del self.held[: self.at]
                self.at = 0
            self.held += piece
        return piece is not None

    def ended(self) -> bool:
        while self.at >= len(self.held):
            if not self.more():
                return True
        return False

    def take(self, n: int) -> bytes:
        while len(self.held) - self.at < n:
            if not self.more():
                raise ValueError("the archive is cut off")
        self.at += n
        return bytes(self.held[self.at - n : self.at])

    def until(self, mark: bytes) -> bytes:
        seen = 0
        while (found := self.held.find(mark, self.at + max(0, seen - len(mark)))) < 0:
            seen = len(self.held) - self.at
            if not self.more():
                raise ValueError("the archive is cut off")
        return self.take(found - self.at + len(mark))


def parse_records(data: bytes) -> Iterator[dict]:
    """The records of one archive, in order, of every type. Payloads are those of responses, as they were transferred."""
    source = _Source(inflate(data))
    while not source.ended():
        lines = source.until(b"\r\n\r\n").decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        head = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:] if line)}
        block = source.take(int(head["content-length"]))
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("a record is longer than its Content-Length")
        full, stated = head["warc-type"] == "response", stated_digest(head.get("warc-payload-digest"))
        payload = block[block.find(b"\r\n\r\n") + 4 :] if full and b"\r\n\r\n" in block else b""
        own = _digest(payload) if full else None
        page = head.get("x-page-id")
        yield {
            "record_id": head.get("warc-record-id"), "page_id": int(page) if page else None, "url": head.get("warc-target-uri"),
            "record_type": head["warc-type"], "refers_to_id": head.get("warc-refers-to"), "header_digest": stated,
            "payload_bytes": len(payload) if full else None, "payload_digest": own,
            "intact": stated == own if full and stated and ":" not in stated else None, "payload": payload if full else None,
        }


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def stated_digest(field: str | None) -> str | None:
    """The value of a digest field: a SHA-1 as bare upper-case base32, whether written in base32 or in hexadecimal digits, in
    any case; another algorithm's as it stands, its name in lower case; null for none."""
    name, _, value = (field or "").partition(":")
    name, value = name.strip().lower(), value.strip()
    if not value:
        return None
    if name != "sha1":
        return f"{name}:{value}"
    if len(value) == 40:
        try:
            return base64.b32encode(bytes.fromhex(value)).decode()
        except ValueError:
            pass
    return value.upper()


def read_archives(spark, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under ``path``, by any writer, of any number of gzip members or none.

    Digests and lengths come from the payloads read; ``intact`` tells whether a response has the SHA-1 that its header
    states (null where it states none). Without ``payloads`` that column is null, which spares shipping it. Each archive is
    held whole, as it is stored, by one task; a broken one stops the job.
    """
    names = [f.split()[0] for f in RECORD_SCHEMA.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    schema = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in RECORD_SCHEMA.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: dict[str, list] = {n: [] for n in names}
                for record in parse_records(content.as_py()):
                    for n in names:
                        rows[n].append(None if n == "payload" and not payloads else record[n])
                    if len(rows["page_id"]) == 2000:
                        yield pa.RecordBatch.from_pydict(rows, schema=schema)
                        rows = {n: [] for n in names}
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(parse, RECORD_SCHEMA)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Every record with its full payload's length and digest: a revisit has those of the response it refers to.

    Columns: page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page id, null for responses).
    A revisit finds its response by the record id that it refers to; one that names no record id, by the payload digest that
    it states (of responses with that payload, the one with the largest page id). Where neither leads to a response among
    ``records``, length, digest and refers_to are null. Records of other types are left out. A response that is not what its
    header states stops the job.
    """
    whole = F.when(F.col("intact") == F.lit(False), F.raise_error(F.concat(F.lit("another payload than stated: "), F.coalesce("record_id", F.lit("a record without id")))).cast("string")).otherwise(F.col("record_type"))
    records = records.where("record_type IN ('response', 'revisit')").withColumn("record_type", whole)
    by_digest = lambda c: F.concat(F.lit("digest:"), F.col(c))
    # A response has a key for each way to it; the digest that it states only where that is of another algorithm.
    other = F.when(F.col("header_digest").contains(":"), by_digest("header_digest"))
    keys = F.array_compact(F.array(F.col("record_id"), by_digest("payload_digest"), other))
    # A response looks itself up, so that its row has a key of its own in the join; substring() gives the answers an
    # exchange of their own, so that Spark can split the revisits of a hot payload.
    answers = records.where("record_type = 'response'").select(F.explode(keys).alias("way"), "page_id", "payload_bytes", "payload_digest").groupBy("way").agg(
        F.max("page_id").alias("__page"), F.max("payload_bytes").alias("__bytes"), F.max("payload_digest").alias("__digest")
    ).withColumn("__of", F.substring("way", 1, 256))
    key = F.when(F.col("record_type") == "response", F.col("record_id")).otherwise(F.coalesce("refers_to_id", by_digest("header_digest")))
    joined = records.withColumn("__key", F.substring(key, 1, 256)).join(answers.drop("way"), F.col("__key") == F.col("__of"), "left")
    return joined.select(
        "page_id", F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"), F.coalesce("payload_digest", "__digest").alias("payload_digest"), "record_type",
        F.when(F.col("record_type") == "revisit", F.col("__page")).alias("refers_to"),
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to new archives in the shared folder, read them back and resolve the revisits."""
    path = shared_path(pages.sparkSession, "warc")
    write_archives(pages, path, **options)
    return resolve_revisits(read_archives(pages.sparkSession, path, payloads=False))
