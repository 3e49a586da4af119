"""WARC archives in Zstandard: one frame per record, a dictionary in a leading skippable frame.

File layout. The first frame may be a skippable frame (magic 0x184D2A5D, four bytes of length) that holds the
dictionary, plain or itself a Zstandard frame. Every frame after it is one whole record, compressed with that
dictionary, so a record can be read alone. The reader goes through a file frame by frame and holds one record at a
time; it checks the version line, the mandatory headers, the block length, the blank lines after the block, the HTTP
length, and the payload digest of every response.

Writing. Each task writes its rows into archives of bounded size below a shared folder and returns a manifest of what
it wrote. The manifest is stored as a table, which keeps the rows of successful task attempts only; files that a lost
attempt has left behind are not in it and are not read. File names are never used twice.

Equal payloads. A payload of ``REVISIT_BYTES`` bytes or more is stored once, in the record of the smallest page_id;
the others become revisit records: the response's headers with the digest, but no payload.

Defined results: a null html is an empty payload. A null page_id is written as an empty id and read as null; it never
is the smallest if there is another. Rows that repeat both page_id and payload of a response are responses too. A page
of any size is one record; its length is not limited. Archives without records have no files; an empty table gives an
empty result. Only the named columns are read, so other columns cannot clash. A damaged archive raises ``WarcError``
with the file and the record's number.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import zstandard as zstd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import llm_query, table
from pulsegrid.session import freeze, scratch_path

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

REVISIT_BYTES = 100
MOST_READERS = 1 << 16  # tasks of a reading job
ARCHIVE_BYTES = 64 << 20  # payload bytes after which a new archive is begun
SAMPLE_BYTES, SAMPLE_RECORDS = 4 << 20, 2000  # of the first records of a task, to train the dictionary
DICTIONARY_BYTES = 64 << 10
READ_BYTES = 1 << 18


class WarcError(ValueError):
    """An archive that does not follow the format."""


def encode_record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """A response record, or a revisit record without the payload if ``refers_to`` is given."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        VERSION.decode(),
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",  # pages carry no time
        f"WARC-Target-URI: {' '.join(url.split())}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    found = {}
    for line in lines:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name.strip():
            raise WarcError(f"not a header line: {line[:60]!r}")
        found[name.strip().lower()] = value.strip()
    return found


def _number(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not value.isdigit():
        raise WarcError(f"{name} is missing or not a number")
    return int(value)


def _urn(value: str, name: str) -> str:
    if not (value.startswith("<urn:page:") and value.endswith(">")):
        raise WarcError(f"{name} is not a page: {value[:60]!r}")
    return value[len("<urn:page:") : -1]


def decode_record(record: bytes) -> dict:
    """Parts of a record, after checking its headers, lengths and digest."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not blank or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("no WARC version line")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"{name} is missing")
    length = _number(headers, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"the block has {len(rest) - 4} bytes, not {length}")
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise WarcError(f"unknown record type {kind[:30]!r}")
    block = rest[:length]
    http, blank, payload = block.partition(b"\r\n\r\n")
    http_lines = http.split(b"\r\n")
    if not blank or not http_lines[0].startswith(b"HTTP/"):
        raise WarcError("no HTTP header in the block")
    size = _number(_headers(http_lines[1:]), "content-length")
    algorithm, _, digest = headers.get("warc-payload-digest", "").partition(":")
    if algorithm != "sha256" or len(digest) != 64:
        raise WarcError("no SHA-256 payload digest")
    refers_to = None
    if kind == "revisit":
        if headers.get("warc-profile") != REVISIT_PROFILE or payload:
            raise WarcError("not an identical-payload revisit")
        refers_to = _urn(headers.get("warc-refers-to", ""), "warc-refers-to")
    else:
        if len(payload) != size:
            raise WarcError(f"the payload has {len(payload)} bytes, not {size}")
        if hashlib.sha256(payload).hexdigest() != digest:
            raise WarcError("the payload does not match its digest")
    return {
        "page_id": _urn(headers["warc-record-id"], "warc-record-id") or None,
        "url": headers.get("warc-target-uri", ""),
        "payload": payload if kind == "response" else None,
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": refers_to,
    }


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary from sample records; none if they are too few or too small to train one."""
    if len(samples) < 16 or sum(map(len, samples)) < 16 * DICTIONARY_BYTES:
        return b""
    return zstd.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


class Archive:
    """One archive being written."""

    def __init__(self, stream, dictionary: bytes):
        self.stream, self.payload_bytes, self.records = stream, 0, 0
        trained = zstd.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstd.ZstdCompressor(level=3, dict_data=trained, write_checksum=True, write_content_size=True)
        if dictionary:
            packed = zstd.ZstdCompressor(level=9).compress(dictionary)
            self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)

    def add(self, record: bytes) -> None:
        self.stream.write(self.compress.compress(record))
        self.payload_bytes += len(record)
        self.records += 1

    def close(self) -> None:
        self.stream.close()


def read_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one frame at a time. ``stream`` has ``read(n)``."""
    buffer = stream.read(8)
    dictionary = None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == SKIPPABLE_MAGIC:
        size = struct.unpack("<I", buffer[4:])[0]
        raw = stream.read(size)
        if len(raw) != size:
            raise WarcError("the dictionary is cut short")
        if raw[:4] == FRAME_MAGIC:
            raw = zstd.ZstdDecompressor().decompressobj().decompress(raw)
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_FULLDICT)
        buffer = b""
    decompressor = zstd.ZstdDecompressor(dict_data=dictionary) if dictionary else zstd.ZstdDecompressor()
    while True:
        buffer = buffer or stream.read(READ_BYTES)
        if not buffer:
            return
        frame, parts = decompressor.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(buffer))
            except zstd.ZstdError as error:
                raise WarcError(f"not a Zstandard frame: {error}") from error
            if frame.eof:
                buffer = frame.unused_data
                break
            buffer = stream.read(READ_BYTES)
            if not buffer:
                raise WarcError("the last frame is cut short")
        yield b"".join(parts)


def _open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


RECORD_SCHEMA = "page_id string, url string, html binary, digest string, refers_to string"


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write rows of ``RECORD_SCHEMA`` as archives below ``folder``; the manifest (file, records) of what was written."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open_folder(folder)
        system.create_dir(base, recursive=True)
        archive, name, waiting, waiting_bytes, dictionary = None, "", [], 0, None
        written: list[tuple[str, int]] = []

        def store(record: bytes) -> None:
            nonlocal archive, name
            if archive is None:
                name = f"{uuid.uuid4().hex}.warc.zst"
                archive = Archive(system.open_output_stream(f"{base}/{name}", compression=None), dictionary)
            archive.add(record)
            if archive.payload_bytes >= ARCHIVE_BYTES:
                close()

        def close() -> None:
            nonlocal archive
            if archive is not None:
                archive.close()
                written.append((name, archive.records))
                archive = None

        def settle() -> None:
            nonlocal dictionary, waiting
            dictionary = train_dictionary(waiting)
            for record in waiting:
                store(record)
            waiting = []

        for batch in batches:
            for row in batch.itertuples(index=False):
                page_id, refers_to = (None if pd.isna(v) else v for v in (row.page_id, row.refers_to))
                record = encode_record(page_id, row.url, bytes(row.html), row.digest, refers_to)
                if dictionary is not None:
                    store(record)
                    continue
                waiting.append(record)
                waiting_bytes += len(record)
                if waiting_bytes >= SAMPLE_BYTES or len(waiting) >= SAMPLE_RECORDS:
                    settle()
        if waiting:
            settle()
        close()
        if written:
            yield pd.DataFrame(written, columns=["file", "records"])

    return freeze(records.mapInPandas(write, "file string, records long"))


READ_SCHEMA = (
    "page_id string, url string, payload binary, payload_bytes long, payload_digest string, record_type string,"
    " refers_to string"
)


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the archives in ``manifest`` (file, records), checked one by one; many files are read at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _open_folder(folder)
        for batch in batches:
            for file, expected in zip(batch["file"], batch["records"]):
                rows, size, number = [], 0, 0
                with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    try:
                        for record in read_archive(stream):
                            row = decode_record(record)
                            number += 1
                            size += len(row["payload"] or b"") if payloads else 0
                            if not payloads:
                                row["payload"] = None
                            rows.append(row)
                            if len(rows) >= 4096 or size >= 8 << 20:
                                yield pd.DataFrame(rows)
                                rows, size = [], 0
                    except WarcError as error:
                        raise WarcError(f"{file}, record {number}: {error}") from error
                if number != expected:
                    raise WarcError(f"{file}: {number} records, not {expected}")
                if rows:
                    yield pd.DataFrame(rows)

    # A task reads some of the files, each from its start to its end. Their number is stated: a manifest is a few bytes a
    # file, which Spark would put into a single task.
    files = manifest.repartition(min(max(manifest.count(), 1), MOST_READERS), "file")
    return files.mapInPandas(read, READ_SCHEMA)


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows of ``RECORD_SCHEMA`` with the page that a repeated payload refers to.

    The smallest page per payload is found by a map-side combined aggregation over the digests of repeated size;
    the join back splits uneven partitions and moves the pages once.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    read = pages.select(
        F.col(key).alias("_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("html"),
        F.sha2(body, 256).alias("digest"),
    )
    firsts = (
        read.where(F.octet_length("html") >= REVISIT_BYTES)
        .groupBy(F.col("digest").alias("_digest"))
        .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
    )
    joined = read.join(firsts, (F.col("digest") == F.col("_digest")) & (F.octet_length("html") >= REVISIT_BYTES), "left")
    refers_to = F.when(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("_id")), F.col("_first"))
    return joined.select(
        F.col("_id").cast("string").alias("page_id"), "url", "html", "digest", refers_to.cast("string").alias("refers_to")
    )


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, str]:
    """Write one record per page; the manifest and the folder of the archives."""
    folder = folder or scratch_path(pages.sparkSession, "warc")
    return write_archives(plan_records(pages, **columns), folder), folder


_SQL = """
WITH pages_ AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM pages_
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM firsts"""


@llm_query("op8_warc_round_trip", _SQL)
def op8_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages = table(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType
    manifest, folder = archive_pages(pages)
    read = read_archives(manifest, folder, payloads=False)
    return read.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
