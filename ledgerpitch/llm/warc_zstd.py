"""WARC archives in Zstandard: one frame per record behind a dictionary in a skippable frame.

An archive starts with a skippable frame that holds the dictionary; each record is one frame
compressed with it. Archives are written by Spark's text writer, so the commit protocol, retries
and every file system Spark knows apply: a row is the raw bytes of one frame and the line
separator is an empty skippable frame, which any Zstandard reader passes over.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerpitch.llm.common import arrow_map, durable, mb_partitions

FRAME_MAGIC = 0xFD2FB528
#: The skippable frame that holds the dictionary, by the published Zstandard profile of WARC.
DICTIONARY_MAGIC = 0x184D2A5D
#: The empty skippable frame 0x184D2A50; its eight bytes are ASCII, so it can separate lines.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
MIN_REVISIT_BYTES = 100
#: Bounds of the sample that trains an archive's dictionary: records, bytes of each, size of the result.
SAMPLE_RECORDS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 16384
#: An archive is read in one piece, so pages are dealt to archives of about this size.
ARCHIVE_MB = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """Bytes that are not a valid archive of this kind."""


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at ``at`` ends, by its own headers."""
    if at + 8 > len(data):
        raise ArchiveError(f"frame header cut off at {at}")
    (magic,) = struct.unpack_from("<I", data, at)
    if magic & 0xFFFFFFF0 == 0x184D2A50:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == FRAME_MAGIC:
        described = data[at + 4]
        single = described >> 5 & 1
        sizes = (1 if single else 0, 2, 4, 8)
        end = at + 5 + (not single) + (0, 1, 2, 4)[described & 3] + sizes[described >> 6]
        last = False
        while not last:
            if end + 3 > len(data):
                raise ArchiveError(f"block header cut off at {end}")
            block = int.from_bytes(data[end : end + 3], "little")
            last = bool(block & 1)
            end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        end += 4 * (described >> 2 & 1)
    else:
        raise ArchiveError(f"no frame starts at {at}")
    if end > len(data):
        raise ArchiveError(f"frame at {at} is cut off")
    return end


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    block: bytes


def _header_value(text: str) -> str:
    """A header value on one line: controls, blanks and non-ASCII signs are percent-encoded."""
    return re.sub(
        r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), text
    )


def write_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in headers.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("ascii") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """One record; its version, header lines, named fields, lengths and digest are checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("ascii", "strict").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.1", "WARC/1.0"):
        raise ArchiveError("the record has no WARC header")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or not re.fullmatch(r"[A-Za-z0-9-]+", name) or name.lower() in headers:
            raise ArchiveError(f"bad header line {line[:60]!r}")
        headers[name.lower()] = value
    for needed in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if needed not in headers:
            raise ArchiveError(f"{needed} is missing")
    if not headers["content-length"].isdigit():
        raise ArchiveError("the content length is not a number")
    length = int(headers["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ArchiveError(f"the block has {len(rest) - 4} bytes, {length} are announced")
    block = rest[:length]
    digest = headers.get("warc-payload-digest", "")
    if headers["warc-type"] == "response" and digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ArchiveError("the payload does not have its digest")
    return Record(headers, block)


def read_archive(data: bytes) -> Iterator[Record]:
    """The records of one archive, one frame at a time.

    An archive without any frame but the dictionary has no records. A frame that is not exactly
    one record, a dictionary that is not in the leading frame, or a wrong length raises.
    """
    view = memoryview(data)
    if len(view) < 8 or struct.unpack_from("<I", view, 0)[0] != DICTIONARY_MAGIC:
        raise ArchiveError("the archive does not start with a dictionary")
    at = frame_end(view, 0)
    stored = bytes(view[8:at])
    if stored[:4] == FRAME_MAGIC.to_bytes(4, "little"):
        stored = zstandard.ZstdDecompressor().decompress(stored)
    options = {"dict_data": zstandard.ZstdCompressionDict(stored)} if stored else {}
    reader = zstandard.ZstdDecompressor(**options)
    while at < len(view):
        end = frame_end(view, at)
        if struct.unpack_from("<I", view, at)[0] == FRAME_MAGIC:
            size = zstandard.frame_content_size(view[at:end])
            record = reader.decompress(view[at:end], allow_extra_data=False)
            if size != len(record):
                raise ArchiveError(f"the frame at {at} announces {size} bytes and holds {len(record)}")
            yield parse_record(record)
        at = end


def _dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary, or none where the sample is too small to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s[:SAMPLE_BYTES] for s in sample]).as_bytes()
    except zstandard.ZstdError:
        return b""


def pack_frames(records: Iterator[bytes]) -> Iterator[bytes]:
    """The dictionary frame, then one frame per record; nothing at all without records."""
    sample: list[bytes] = []
    for record in records:
        sample.append(record)
        if len(sample) == SAMPLE_RECORDS:
            break
    if not sample:
        return
    trained = _dictionary(sample)
    yield struct.pack("<II", DICTIONARY_MAGIC, len(trained)) + trained
    options = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    writer = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=True, **options)
    while sample:
        yield writer.compress(sample.pop(0))
    for record in records:
        yield writer.compress(record)


def deduplicated(pages: DataFrame, archives: int, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(page_id, url, html, digest, refers_to), dealt to ``archives`` partitions.

    Of the rows with one payload of at least 100 bytes, those with the smallest id are responses,
    and their ``refers_to`` is null. A null id counts as larger than every other; rows that all
    lack an id are all responses, and so are rows that repeat the smallest id. The smallest id per
    digest is combined map-side and joined with (id, digest) only, so that a payload with very many
    copies moves few bytes; payloads move once, by id, which no payload makes hot.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
    ).withColumns({
        "digest": F.sha2(F.col("html").cast("binary"), 256),
        "key": F.xxhash64(F.coalesce(F.col("page_id").cast("string"), F.lit("none"))),
    })
    large = rows.filter(F.octet_length("html") >= MIN_REVISIT_BYTES).select("page_id", "key", "digest")
    first = (
        large.groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("copies"))
        .filter("copies > 1 and first_id is not null")
        .drop("copies")
    )
    revisits = (
        large.join(first, "digest")
        .filter(~F.col("page_id").eqNullSafe(F.col("first_id")))
        .groupBy("key", "digest")
        .agg(F.min("first_id").alias("refers_to"))
    )
    return rows.repartition(archives, "key", "digest").join(revisits, ["key", "digest"], "left").select(
        "page_id", "url", "html", "digest", "refers_to"
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> None:
    """Write one record per row to zstandard archives in ``folder``, each with its own dictionary.

    A response carries the payload in UTF-8 (null: empty). A revisit carries none; it names the
    digest and the page it repeats. Extra columns are not written. An empty table writes no record.
    """
    size = pages.agg(F.sum(F.octet_length(F.col(html_col).cast("string")))).first()[0] or 0
    archives = mb_partitions(pages.sparkSession, size, ARCHIVE_MB)
    rows = deduplicated(pages, archives, id_col, url_col, html_col)
    # A revisit does not carry its payload on to the archive.
    dealt = rows.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))

    def one(page: int | None, url: str, html: str | None, digest: str, refers: int | None) -> bytes:
        headers = {
            "WARC-Type": "response" if refers is None else "revisit",
            "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page} {url}')}>",
            "WARC-Date": date,
            "WARC-Target-URI": _header_value(url),
            "WARC-Page-ID": "" if page is None else str(page),
            "WARC-Payload-Digest": f"sha256:{digest}",
            "Content-Type": "text/html",
        }
        if refers is not None:
            headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Page-ID": str(refers)}
        return write_record(headers, (html or "").encode())

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def records() -> Iterator[bytes]:
            for batch in batches:
                names = ("page_id", "url", "html", "digest", "refers_to")
                for row in zip(*[batch.column(n).to_pylist() for n in names], strict=True):
                    yield one(*row)

        for frame in pack_frames(records()):
            yield {"frame": [frame]}

    (
        arrow_map(dealt, frames, "frame binary")
        .select(F.col("frame").cast("string").alias("value"))
        .write.option("lineSep", SEPARATOR)
        .option("compression", "none")
        .option("maxRecordsPerFile", 0)
        .text(folder)
    )


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_digest, payload), one row per record.

    Archives are binary files, one row each, decoded frame by frame. ``payload`` is null for a
    revisit and empty where the page had no html. Records come back as often as they were written.
    Damaged archives raise.
    """
    files = spark.read.format("binaryFile").load(folder).select("content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload")
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for record in read_archive(data.as_py()):
                    h = record.headers
                    kind = h["warc-type"]
                    rows.append((
                        int(h["warc-page-id"]) if h["warc-page-id"] else None,
                        h["warc-target-uri"],
                        kind,
                        int(h["warc-refers-to-page-id"]) if kind == "revisit" else None,
                        h["warc-payload-digest"].removeprefix("sha256:"),
                        None if kind == "revisit" else record.block,
                    ))
                    held += len(record.block)
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield dict(zip(names, zip(*rows, strict=True), strict=True))
                        rows, held = [], 0
                if rows:
                    yield dict(zip(names, zip(*rows, strict=True), strict=True))

    return arrow_map(
        files,
        records,
        "page_id long, url string, record_type string, refers_to long, payload_digest string, payload binary",
    )


def page_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of records read back.

    A revisit takes its payload size from the response it refers to, found by page and digest.
    Every record gives one row, so repeated page ids stay repeated; no records give no rows.
    """
    slim = durable(
        records.select(
            "page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").alias("own_bytes")
        )
    )
    responses = (
        slim.filter("record_type = 'response' and page_id is not null")
        .groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.max("own_bytes").alias("their_bytes"))
    )
    return slim.join(responses, ["refers_to", "payload_digest"], "left").select(
        "page_id",
        F.coalesce("own_bytes", "their_bytes").cast("long").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
