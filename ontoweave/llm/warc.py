"""WARC archives of captures: written by Spark, read back, and assembled into transactions.

A capture is three records: a request, a response (or a revisit of an equal payload) and a
metadata record. Request and metadata name the response's record in WARC-Concurrent-To, and
assembly joins the three kinds by that name into one nested row per capture.

Archives are Spark text output whose line separator is the blank line that ends a WARC
record, gzip-compressed, so a lost executor leaves no half archive: the commit protocol
publishes whole files only. Reading follows Content-Length, never the separator, because a
payload may hold anything.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the format.
VERSION = "WARC/1.1"
END = "\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURED = "2024-01-01T00:00:00Z"
GZIP = b"\x1f\x8b"

RECORDS = (
    "record_id string, type string, concurrent_to string, target_uri string, date string, "
    "payload_digest string, content_type string, http_head string, payload binary"
)
LEAST_BYTES = 100


def mark_revisits(captures: DataFrame, payload: str = "payload", least: int = LEAST_BYTES) -> DataFrame:
    """Adds ``__digest``, ``__bytes`` and ``__keeper``: for payloads of at least ``least``
    bytes the smallest page_id (and its url) that has the same payload, else null.

    Minima combine before the shuffle, so a payload that a third of all pages share is one
    row per task there; the join back is by digest, where the adaptive skew join splits.
    """
    marked = captures.withColumns({"__digest": F.sha2(payload, 256), "__bytes": F.octet_length(payload).cast("bigint")})
    keepers = (
        marked.where((F.col("__bytes") >= least) & F.col("page_id").isNotNull())
        .groupBy(F.col("__digest").alias("__of"))
        .agg(F.min(F.struct("page_id", "url")).alias("__keeper"), F.count(F.lit(1)).alias("__n"))
        .where("__n > 1")
        .drop("__n")
    )
    return marked.join(keepers, F.col("__digest") == F.col("__of"), "left").drop("__of")


def header_uri(url: Column) -> Column:
    """The url with percent-encoded blanks and controls, which would break its header line or the
    request line; all else stays as it is, what was encoded before too."""
    breaks = r"[\x00-\x20\x7f]"
    encoded = lambda c: F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c).cast("bigint")), 2, "0"))
    letters = F.transform(F.split(url, ""), lambda c: F.when(c.rlike(breaks), encoded(c)).otherwise(c))
    return F.when(url.rlike(breaks), F.array_join(letters, "")).otherwise(url)


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _record(kind: str, record_id: Column, headers: list[Column], block: Column) -> Column:
    head = [F.lit(f"{VERSION}{END}WARC-Type: {kind}{END}WARC-Date: {CAPTURED}{END}"), _header("WARC-Record-ID", record_id)]
    length = _header("Content-Length", F.octet_length(block).cast("string"))
    return F.concat(*head, *headers, length, F.lit(END), block)


def write_archives(pages: DataFrame, path: str, per_file: int = 2000) -> None:
    """Writes three records per page to gzip-compressed archives under ``path``.

    The payload is the html in UTF-8; a null html is empty. Of pages with equal payloads of
    at least 100 bytes, the one with the smallest page_id is written whole and the others as
    revisits without payload; a row that repeats the smallest page_id with the same payload
    is written whole as well, and so is a row without page_id. Line breaks, other controls
    and spaces in a url are percent-encoded and nothing else is; a null url leaves its header out. Other columns
    are not read. An empty table gives an archive folder without records.
    """
    captures = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    marked = mark_revisits(captures)
    revisit = F.coalesce(F.col("__keeper.page_id") != F.col("page_id"), F.lit(False))
    ids = {f"__{k}": F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")) for k in ("request_id", "response_id", "metadata_id")}
    named = marked.withColumns({**ids, "__uri": header_uri(F.col("url")), "__keeper_uri": header_uri(F.col("__keeper.url"))})
    target = _header("WARC-Target-URI", F.col("__uri"))
    together = _header("WARC-Concurrent-To", F.col("__response_id"))
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("__digest")))
    http = _header("Content-Type", F.lit("application/http; msgtype=response"))
    status = F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}")
    body = F.concat(status, _header("Content-Length", F.col("__bytes").cast("string")), F.lit(END), F.col("payload"))
    whole = _record("response", F.col("__response_id"), [target, digest, http], body)
    profile = _header("WARC-Profile", F.lit(IDENTICAL))
    refers = [_header("WARC-Refers-To-Target-URI", F.col("__keeper_uri")), _header("WARC-Refers-To-Date", F.lit(CAPTURED))]
    again = _record("revisit", F.col("__response_id"), [target, digest, profile, *refers, http], F.concat(status, F.lit(END)))
    asked = F.concat(F.lit("GET "), F.coalesce("__uri", F.lit("/")), F.lit(f" HTTP/1.1{END}{END}"))
    asking = _header("Content-Type", F.lit("application/http; msgtype=request"))
    request = _record("request", F.col("__request_id"), [target, together, asking], asked)
    fields = _header("Content-Type", F.lit("application/warc-fields"))
    about = _record("metadata", F.col("__metadata_id"), [target, together, fields], _header("pageId", F.col("page_id").cast("string")))
    records = F.array(request, F.when(revisit, again).otherwise(whole), about)
    (
        named.select(F.explode(records).alias("value"))
        .write.option("lineSep", END * 2)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * per_file)
        .text(path)
    )


def _chunks(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """The plain bytes of an archive, of one gzip member or many, or not compressed at all."""
    view = memoryview(data)
    if bytes(view[:2]) != GZIP:
        yield data
        return
    at = 0
    while bytes(view[at : at + 2]) == GZIP:
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            part = unpack.unconsumed_tail
            if not part:
                part, at = view[at : at + step], min(at + step, len(view))
                if not part:
                    raise ValueError("An archive's compression ends too early")
            yield unpack.decompress(part, 4 * step)
        at -= len(unpack.unused_data)


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")


def parse(data: bytes, kinds: frozenset[str] | None = None) -> Iterator[tuple[dict, bytes]]:
    """The headers and block of each record of one archive, of the given kinds only."""
    buffer, source, wanted = bytearray(), _chunks(data), kinds and {k.encode() for k in kinds}

    def fill(size: int) -> bool:
        while len(buffer) < size:
            part = next(source, None)
            if part is None:
                return False
            buffer.extend(part)
        return True

    while True:
        while fill(2) and buffer[:2] == b"\r\n":
            del buffer[:2]
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not fill(len(buffer) + 1):
                if buffer.strip():
                    raise ValueError("An archive ends inside a record's headers")
                return
            end = buffer.find(b"\r\n\r\n")
        found = HEADER.findall(bytes(buffer[: end + 2]))
        headers = {name.lower(): value for name, value in found}
        length = int(headers[b"content-length"])
        if not fill(end + 4 + length):
            raise ValueError("An archive ends inside a record's block")
        if not wanted or headers[b"warc-type"] in wanted:
            yield headers, bytes(buffer[end + 4 : end + 4 + length])
        del buffer[: end + 4 + length]


def read_records(spark: SparkSession, path: str, kinds: tuple[str, ...] = ()) -> DataFrame:
    """The records under ``path``, of the given kinds: headers, HTTP head and payload.

    A task holds one archive in memory (they are bounded when written) and unpacks it as it
    goes. A damaged archive is an error, not a shorter result.
    """
    wanted, names = frozenset(kinds), [f.strip().split()[0] for f in RECORDS.split(",")]
    types = [pa.binary() if n == "payload" else pa.string() for n in names]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def row(headers: dict, block: bytes) -> tuple:
        text = lambda name: headers[name].decode() if name in headers else None
        head, payload = None, block
        if headers.get(b"content-type", b"").startswith(b"application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            head = head.decode("utf-8", "replace")
        keys = (b"warc-record-id", b"warc-type", b"warc-concurrent-to", b"warc-target-uri", b"warc-date", b"warc-payload-digest", b"content-type")
        return (*map(text, keys), head, payload)

    def run(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, size = [], 0
                for headers, block in parse(data.as_py(), wanted):
                    rows.append(row(headers, block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)


def assemble(spark: SparkSession, path: str) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``request``, ``response`` and ``metadata``.

    Joined by the response's record id, which the others name in WARC-Concurrent-To; ids are
    unique, so no key is hot. A capture whose request or metadata is missing has null there.
    """
    inside = lambda *c: F.struct(*c)
    response = read_records(spark, path, ("response", "revisit")).select(
        F.col("record_id").alias("capture_id"),
        inside(
            "type", "target_uri", "date", "payload_digest", "http_head", "payload",
            # Taken here, so that a caller who needs no payload does not shuffle it.
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.sha2("payload", 256).alias("payload_sha256"),
        ).alias("response"),
    )
    request = read_records(spark, path, ("request",)).select(
        F.col("concurrent_to").alias("capture_id"), inside("record_id", "target_uri", "http_head").alias("request")
    )
    metadata = read_records(spark, path, ("metadata",)).select(
        F.col("concurrent_to").alias("capture_id"),
        inside("record_id", F.col("payload").cast("string").alias("fields")).alias("metadata"),
    )
    joined = response.join(request, "capture_id", "left").join(metadata, "capture_id", "left")
    return joined.select("capture_id", "request", "response", "metadata")


def resolve(captures: DataFrame) -> DataFrame:
    """Adds ``page_id``, ``refers_to``, and of the full payload ``payload_bytes`` and
    ``payload_sha256``.

    A revisit's payload is that of the response with the same payload digest; of several,
    the one with the smallest page_id. The index of digests is one row per payload, and the
    join to it carries payloads only where the caller keeps them.
    """
    page = F.regexp_extract(F.col("metadata.fields"), r"(?m)^pageId: (-?\d+)\r?$", 1)
    known = captures.select(
        "*",
        F.when(page != "", page).cast("bigint").alias("page_id"),
        F.col("response.type").alias("__type"),
        F.col("response.payload_digest").alias("__digest"),
        F.col("response.payload_bytes").alias("__bytes"),
        F.col("response.payload_sha256").alias("__sha256"),
    )
    index = (
        known.where("__type = 'response'")
        .groupBy(F.col("__digest").alias("__of"))
        .agg(
            F.min("page_id").alias("refers_to"),
            F.max("__bytes").alias("__full_bytes"),
            F.max("__sha256").alias("__full_sha256"),
        )
    )
    joined = known.join(index, (F.col("__type") == "revisit") & (F.col("__digest") == F.col("__of")), "left")
    full = {"payload_bytes": F.coalesce("__full_bytes", "__bytes"), "payload_sha256": F.coalesce("__full_sha256", "__sha256")}
    return joined.withColumns(full).drop(
        "__type", "__digest", "__bytes", "__sha256", "__of", "__full_bytes", "__full_sha256"
    )
