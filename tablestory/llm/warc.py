"""WARC archives: writing, reading, and turning repeated payloads into revisit records.

An archive is a run of WARC/1.1 records of bounded size, written by Spark's text writer with the
bytes as they are, one archive a file, compressed as a whole. It is read as a binary file and
walked by ``Content-Length``, so payloads may hold anything. Spark's commit protocol makes a
write whole or absent when executors are lost.
"""

from __future__ import annotations

import datetime
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

ARCHIVE_BYTES = 8 << 20
LEAST_PAYLOAD = 100
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEADS = ["key", "uri", "payload_digest", "payload_bytes", "record_type", "refers_to", "refers_uri"]
RECORDS = ("record_id string, record_type string, key bigint, uri string, date string, payload_digest string, "
           "payload_bytes bigint, refers_to bigint, refers_to_id string, refers_to_uri string, content_bytes bigint, payload binary")


def headers(records: DataFrame, key: str, payload: str, uri: str) -> DataFrame:
    """``key``, ``uri``, digest and size of each payload: all that resolution needs to shuffle."""
    return records.select(F.col(key).cast("bigint").alias("key"), F.col(uri).alias("uri"), F.sha2(payload, 256).alias("payload_digest"),
                          F.length(payload).cast("bigint").alias("payload_bytes"))


def resolve(heads: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """``(key, payload_digest, refers_to, refers_uri)`` of the records that repeat the payload of another one with a smaller key.

    Payloads under ``least`` bytes and records without a key repeat nothing. Equal keys are one record; of its URIs
    the smallest is named.
    """
    large = heads.where((F.col("payload_bytes") >= least) & F.col("key").isNotNull())
    same = ["payload_digest", "payload_bytes"]
    originals = large.groupBy(*same).agg(
        F.min(F.struct("key", "uri")).alias("first"), F.max("key").alias("other")).where("first.key <> other")
    originals = originals.select(*same, F.col("first.key").alias("refers_to"), F.col("first.uri").alias("refers_uri"))
    return large.join(originals, same).where("key <> refers_to").select("key", "payload_digest", "refers_to", "refers_uri").distinct()


def _clean(value) -> str:
    return "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in value or "")


def write_archives(records: DataFrame, folder: str, date: str | None = None, size: int = ARCHIVE_BYTES) -> None:
    """Write records (``key``, ``uri``, ``payload`` and what ``resolve`` found) with fresh headers, of this moment or of ``date``.

    A revisit carries no payload, but the digest and the length of the one it stands for, and the id, URI and
    date of its record, by which any reader finds it. An archive
    closes at ``size`` bytes; a longer record has one for itself.
    """
    date = date or datetime.datetime.now(datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        filled = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)[:-len(_END)]], pa.binary())], ["archive"])

        for batch in batches:
            for *row, payload in zip(*(batch.column(c).to_pylist() for c in [*_HEADS, "payload"])):
                record = _record(dict(zip(_HEADS, row)), payload, date)
                if held and filled + len(record) > size:
                    yield flush()
                    held, filled = [], 0
                held.append(record)
                filled += len(record)
        if held:
            yield flush()

    made = records.select(*_HEADS, "payload").mapInArrow(pack, "archive binary")
    writer = made.select(F.col("archive").cast("string")).write.option("lineSep", _END.decode())
    writer.option("compression", "gzip").option("maxRecordsPerFile", 1).text(folder)


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{"null" if key is None else key} {digest}')}>"


def _record(head: dict, payload: bytes | None, date: str) -> bytes:
    revisit = head["record_type"] == "revisit"
    content = b"" if revisit else payload or b""
    number = "null" if head["key"] is None else str(head["key"])
    lines = [
        "WARC/1.1", f"WARC-Type: {head['record_type']}",
        f"WARC-Record-ID: {_record_id(head['key'], head['payload_digest'])}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {_clean(head['uri'])}", f"WARC-Payload-Digest: sha256:{head['payload_digest']}",
        f"Source-Key: {number}", f"Payload-Length: {head['payload_bytes']}",
    ]
    if revisit:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_record_id(head['refers_to'], head['payload_digest'])}",
                  f"WARC-Refers-To-Target-URI: {_clean(head['refers_uri'])}", f"WARC-Refers-To-Date: {date}", f"WARC-Refers-To-Key: {head['refers_to']}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(content)}"]
    return "\r\n".join(lines).encode() + _END + content + _END


def _walk(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    at = 0
    while at < len(archive):
        to = archive.index(_END, at)
        first, *rest = archive[at:to].decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {name.lower(): value for name, _, value in (x.partition(": ") for x in rest)}
        start = to + len(_END)
        end = start + int(head["content-length"])
        if len(archive) < end or archive[end:end + len(_END)] != _END:
            raise ValueError(f"a WARC record at byte {at} is cut off")
        yield head, archive[start:end]
        at = end + len(_END)


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """All records of a folder, one row each; digest and size of a response are those of the bytes read."""
    names = [c.split()[0] for c in RECORDS.split(", ")]

    def whole(head: dict[str, str], content: bytes) -> tuple:
        response = head["warc-type"] == "response"
        key, refers = head.get("source-key", "null"), head.get("warc-refers-to-key")
        digest = hashlib.sha256(content).hexdigest() if response else head["warc-payload-digest"].partition(":")[2]
        return (head["warc-record-id"], head["warc-type"], None if key == "null" else int(key), head.get("warc-target-uri"),
                head.get("warc-date"), digest, len(content) if response else int(head["payload-length"]),
                int(refers) if refers else None, head.get("warc-refers-to"), head.get("warc-refers-to-target-uri"), len(content), content if response else None)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for row in range(batch.num_rows):
                content = batch.column(0)[row].as_py()
                content = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                columns = zip(*(whole(*r) for r in _walk(content)))
                arrays = [pa.array(c, t) for c, t in zip(columns, types)]
                if arrays:
                    yield pa.RecordBatch.from_arrays(arrays, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(unpack, RECORDS)


def restore(records: DataFrame) -> DataFrame:
    """Revisits with digest, size and payload of the response they refer to by its record id; responses as they are."""
    revisits = records.where("record_type = 'revisit'").drop("payload")
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), "payload").distinct()
    return records.where("record_type <> 'revisit'").unionByName(revisits.join(originals, "refers_to_id", "left"))


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", uri: str = "url", text: str = "html",
                  least: int = LEAST_PAYLOAD, size: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record per page, repeated payloads as revisits, and return the records read back.

    The payload is the text in UTF-8, empty for null. Of equal payloads of at least ``least`` bytes,
    the one with the smallest key is the response. Only headers are shuffled to find them; the pages
    then meet what was found by their own key and digest, so a payload that a third of all pages share is no
    hot key. Pages without a key are responses; repeated rows are written each.
    """
    records = pages.select(F.col(key).cast("bigint").alias("key"), F.col(uri).cast("string").alias("uri"),
                           F.coalesce(F.col(text), F.lit("")).cast("binary").alias("payload"))
    records = records.withColumn("payload_digest", F.sha2("payload", 256))
    found = resolve(headers(records, "key", "payload", "uri"), least)
    out = records.join(found, ["key", "payload_digest"], "left").select(
        "key", "uri", "payload_digest", F.length("payload").cast("bigint").alias("payload_bytes"),
        F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"), "refers_to", "refers_uri",
        F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))
    write_archives(out, folder, size=size)
    return read_archives(pages.sparkSession, folder)
