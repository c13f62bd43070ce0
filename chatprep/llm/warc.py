"""WARC archives: write, read, and resolve repeated payloads to revisit records.

Records are rows. Archives are written by Spark's own text writer, through its commit
protocol, so that they land in any store Spark knows and a lost executor leaves no half
archive. Each record is a gzip member of its own. A member ends with the high byte of its
length, which is zero below 16 MiB, and that byte is the writer's line separator;
a longer record is followed by an empty member, which ends in zero as well.

Deduplication moves headers first: they are shuffled by payload digest, each digest's
original is found, and all other records of the digest, revisits that were there before
included, are joined to it. Payloads move once, and only originals are written with one.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chatprep.llm.common import written

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_MESSAGE = "application/http; msgtype=response"
#: Most records of a file that is written, so that a file is one task's work to read.
RECORDS_PER_FILE = 10_000
#: Bytes of payload that leave a reader at once.
FLUSH_BYTES = 1 << 22

RECORD = (
    "archive string, number long, record_id string, record_type string, target_uri string, date string, "
    "content_type string, payload_digest string, payload_bytes long, refers_to string, refers_to_uri string, "
    "refers_to_date string, fields map<string,string>, head binary, payload binary"
)
_NAMED = {
    "warc-record-id": "record_id",
    "warc-type": "record_type",
    "warc-target-uri": "target_uri",
    "warc-date": "date",
    "content-type": "content_type",
    "warc-refers-to": "refers_to",
    "warc-refers-to-target-uri": "refers_to_uri",
    "warc-refers-to-date": "refers_to_date",
}
_MADE = {"content-length", "warc-payload-digest", "warc-block-digest", "warc-profile"}


def sha1_base32(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: twenty bits at a time, as four digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, url_col: str, body_col: str, fields: dict[str, str], date: str | None = None) -> DataFrame:
    """A response record for each page, its payload the body in UTF-8 (null: empty).

    ``fields`` names columns that are written as header fields of their own.
    """
    now = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = F.coalesce(F.col(body_col).cast("binary"), F.lit(b""))
    size = F.octet_length(body)
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=UTF-8{CRLF}Content-Length: "),
        size.cast("string"),
        F.lit(CRLF + CRLF),
    )
    extra = [part for name, column in fields.items() for part in (F.lit(name), F.col(column).cast("string"))]
    none = F.lit(None).cast("string")
    return pages.select(
        none.alias("archive"),
        F.lit(None).cast("long").alias("number"),
        F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")).alias("record_id"),
        F.lit("response").alias("record_type"),
        F.col(url_col).cast("string").alias("target_uri"),
        F.lit(now).alias("date"),
        F.lit(HTTP_MESSAGE).alias("content_type"),
        sha1_base32(body).alias("payload_digest"),
        size.cast("long").alias("payload_bytes"),
        none.alias("refers_to"),
        none.alias("refers_to_uri"),
        none.alias("refers_to_date"),
        (F.create_map(*extra) if extra else F.create_map().cast("map<string,string>")).alias("fields"),
        head.cast("binary").alias("head"),
        body.alias("payload"),
    )


def _line(name: str | Column, value: Column) -> Column:
    """A header line, or nothing for null. Line breaks in a value would end it: they are percent-encoded."""
    name = F.lit(name) if isinstance(name, str) else name
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(name, F.lit(": "), safe, F.lit(CRLF)), F.lit(""))


def _record_text(records: DataFrame) -> Column:
    """A whole record without its closing empty lines, as text whose bytes are the record's."""
    block = F.concat(
        F.coalesce(F.col("head"), F.lit(b"")).cast("string"), F.coalesce(F.col("payload"), F.lit(b"")).cast("string")
    )
    others = F.map_filter("fields", lambda name, value: value.isNotNull())
    lines = F.transform(F.array_sort(F.map_entries(others)), lambda e: _line(e["key"], e["value"]))
    has_payload = F.col("record_type").isin("response", "revisit") & F.col("payload_digest").isNotNull()
    return F.concat(
        F.lit(VERSION + CRLF),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.col("record_id")),
        _line("WARC-Date", F.col("date")),
        _line("WARC-Target-URI", F.col("target_uri")),
        _line("WARC-Payload-Digest", F.when(has_payload, F.concat(F.lit("sha1:"), F.col("payload_digest")))),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        _line("WARC-Refers-To", F.col("refers_to")),
        _line("WARC-Refers-To-Target-URI", F.col("refers_to_uri")),
        _line("WARC-Refers-To-Date", F.col("refers_to_date")),
        F.array_join(lines, ""),
        _line("Content-Type", F.col("content_type")),
        _line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF),
        block,
    )


def member(record: bytes) -> bytes:
    """A gzip member that ends in a zero byte, with an empty one behind it if need be."""
    packed = gzip.compress(record, 6, mtime=0)
    return packed if packed[-1] == 0 else packed + gzip.compress(b"", 6, mtime=0)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    end = (CRLF + CRLF).encode()
    packed: list[bytes] = []
    held = 0
    for batch in batches:
        for value in batch.column(0):
            # The writer puts the last zero byte itself.
            packed.append(member(value.as_py() + end)[:-1])
            held += len(packed[-1])
            if held >= FLUSH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])
                packed, held = [], 0
    if packed:
        yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary())], ["value"])


def write_archive(records: DataFrame, path: str, compress: bool = True, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write records as archive files below ``path``: gzip, a member for each record, or plain.

    ``record_id, record_type, target_uri, date, content_type, payload_digest, refers_to,
    refers_to_uri, refers_to_date, fields, head, payload`` are read; lengths are made anew.
    Null values have no header line. Spark names the files ``part-...txt``.
    """
    text = records.select(_record_text(records).alias("value"))
    writer = text.write
    if compress:
        packed = text.select(F.col("value").cast("binary")).mapInArrow(_members, "value binary")
        writer = packed.select(F.col("value").cast("string")).write.option("lineSep", "\0")
    else:
        writer = writer.option("lineSep", CRLF + CRLF)
    writer.option("maxRecordsPerFile", records_per_file).text(path)


class Damaged(ValueError):
    """A place in an archive where no record begins or ends as it should."""


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of a stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged(f"no record begins with {line[:40]!r}")
        fields: list[tuple[str, str]] = []
        while (line := stream.readline()).strip():
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and fields:
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {text.strip()}")
            else:
                name, _, value = text.partition(":")
                fields.append((name.strip(), value.strip()))
        sizes = [value for name, value in fields if name.lower() == "content-length"]
        if not sizes or not sizes[0].isascii() or not sizes[0].isdigit():
            raise Damaged("a record without a length")
        size = int(sizes[0])
        block = stream.read(size)
        if len(block) < size:
            raise Damaged("a record that ends early")
        yield fields, block


def _row(fields: list[tuple[str, str]], block: bytes, payload: bool) -> dict:
    row: dict = {"fields": []}
    stated = None
    for name, value in fields:
        low = name.lower()
        if low in _NAMED:
            row.setdefault(_NAMED[low], value)
        elif low == "warc-payload-digest":
            stated = value.rpartition(":")[2].upper()
        elif low not in _MADE and name not in dict(row["fields"]):
            row["fields"].append((name, value))
    head = b""
    if row.get("content_type", "").lower().startswith("application/http") and row.get("record_type") != "request":
        at = block.find(b"\r\n\r\n")
        head, block = (block[: at + 4], block[at + 4 :]) if at >= 0 else (block, b"")
    if row.get("record_type") == "revisit":
        row["payload_digest"] = stated
    else:
        row["payload_digest"] = base64.b32encode(hashlib.sha1(block).digest()).decode()
        row["payload_bytes"] = len(block)
    if payload:
        row["head"], row["payload"] = head, block
    return row


def _arrow_schema() -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "map<string,string>": pa.map_(pa.string(), pa.string())}
    return pa.schema([pa.field(name, types[kind]) for name, kind in (part.split(" ") for part in RECORD.split(", "))])


def read_records(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all archives below a folder, plain or gzip, as rows; without payloads if not asked for.

    ``archive`` and ``number`` tell the place of a record. Digest and size are made from
    the payload (what follows the HTTP head of an HTTP message); a revisit has the digest
    that it states, and no size. Where an archive is damaged its rest is one row of the
    type ``damaged``, with the reason among its ``fields``. Names don't matter, but Spark
    passes over those that begin with a dot or an underscore. A file is read by one task,
    and has less than 2 GiB.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    schema = _arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                raw = io.BytesIO(content.as_buffer())
                packed = raw.getbuffer()[:2] == b"\x1f\x8b"
                found = parse_records(io.BufferedReader(gzip.GzipFile(fileobj=raw)) if packed else raw)
                number = 0
                while True:
                    place = {"archive": name.as_py(), "number": number}
                    try:
                        row = _row(*next(found), payload)
                    except StopIteration:
                        break
                    except (Damaged, EOFError, OSError) as reason:
                        rows.append(place | {"record_type": "damaged", "fields": [("Reason", str(reason))]})
                        break
                    rows.append(place | row)
                    number += 1
                    held += 1000 + (len(row["payload"]) if payload else 0)
                    if held >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORD)


def resolve(headers: DataFrame, order: Column, min_bytes: int = 0) -> DataFrame:
    """The records that repeat another's payload: place, and the ``refers_to`` columns of the original.

    ``headers`` are records, and are read several times. Of responses with equal
    payloads of at least ``min_bytes`` bytes the one with the largest ``order`` is the
    original; null comes first, of equal ones that with the largest record id and place.
    Revisits go to the original with the digest they state; those without one are not in
    the result.
    """
    rows = headers.where(F.col("record_type").isin("response", "revisit") & F.col("payload_digest").isNotNull())
    rows = rows.where((F.col("record_type") == "revisit") | (F.col("payload_bytes") >= min_bytes))
    is_response = F.col("record_type") == "response"
    place = [F.col("archive"), F.col("number")]
    own = F.struct(order.alias("order"), F.col("record_id"), *place, F.col("target_uri"), F.col("date"))
    # Equal payloads are one row before the shuffle; the originals then are a table, so
    # that a digest with very many records is split when it is joined.
    groups = rows.groupBy("payload_digest").agg(
        F.max(F.when(is_response, own)).alias("best"), F.count(F.lit(1)).alias("n")
    )
    originals = written(groups.where("n > 1 AND best IS NOT NULL").drop("n"), "originals").hint("merge")
    joined = rows.select("payload_digest", *place).join(originals, "payload_digest")
    other = ~(F.col("archive").eqNullSafe(F.col("best.archive")) & F.col("number").eqNullSafe(F.col("best.number")))
    return joined.where(other).select(
        *place,
        F.col("best.record_id").alias("refers_to"),
        F.col("best.target_uri").alias("refers_to_uri"),
        F.col("best.date").alias("refers_to_date"),
    )


def deduplicate(
    spark: SparkSession, path: str, out: str, order: Column, min_bytes: int = 0, compress: bool = True
) -> None:
    """Write the archives below ``path`` anew with each payload once, see ``resolve`` and ``write_archive``.

    Records keep their ids, so that records which name them stay right. A record that
    repeats a payload becomes, or stays, a revisit: no payload, the HTTP head, the digest,
    and who has it. Revisits whose original is not there, and records of all other types,
    are written as they are, damaged rests not at all. No archive, no records and empty
    payloads are nothing special: empty payloads are equal.
    """
    headers = read_records(spark, path, payload=False).drop("head", "payload")
    headers = written(headers, "headers")
    links = written(resolve(headers, order, min_bytes), "links")
    renamed = {name: f"_{name}" for name in links.columns}
    records = read_records(spark, path).where("record_type <> 'damaged'")
    found = records.join(
        links.withColumnsRenamed(renamed),
        (F.col("archive") == F.col("_archive")) & (F.col("number") == F.col("_number")),
        "left",
    )
    again = F.col("_archive").isNotNull()
    changed = {name: F.when(again, F.col(f"_{name}")).otherwise(F.col(name)) for name in renamed if name.startswith("refers")}
    changed["record_type"] = F.when(again, "revisit").otherwise(F.col("record_type"))
    changed["payload"] = F.when(~again, F.col("payload"))
    write_archive(found.withColumns(changed).drop(*renamed.values()), out, compress)


def with_originals(headers: DataFrame) -> DataFrame:
    """Records with ``original``, for revisits: record id, size, digest and fields of what they refer to.

    ``headers`` is read twice. Where several records have an id, one of them is taken. It
    is null where the record that a revisit names is not there.
    """
    there = headers.where("record_type <> 'revisit' AND record_id IS NOT NULL")
    known = F.struct("record_id", "payload_bytes", "payload_digest", "fields").alias("original")
    # Only those that are named: the rest need not move.
    named = headers.where("record_type = 'revisit'").select(F.col("refers_to").alias("_named")).distinct()
    there = there.join(named, F.col("record_id") == F.col("_named"), "left_semi").select("record_id", known)
    there = written(there.dropDuplicates(["record_id"]), "originals").withColumnRenamed("record_id", "_named")
    revisits = headers.where("record_type = 'revisit'")
    rest = headers.where("record_type <> 'revisit' OR record_type IS NULL")
    found = revisits.join(there.hint("merge"), F.col("refers_to") == F.col("_named"), "left").drop("_named")
    return found.unionByName(rest.withColumn("original", F.lit(None).cast(found.schema["original"].dataType)))
