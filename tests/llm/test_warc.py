from __future__ import annotations

import hashlib
import io
import struct
from collections import defaultdict

import pytest
import zstandard
from pyspark.sql import functions as F

from pulsegrid.llm import warc as W

PAGES = "page_id long, url string, html string"


def page_rows():
    same = "<html>" + "same " * 60 + "</html>"
    return [
        (5, "u", same), (3, "u", same), (9, None, same), (4, "u\r\nX: y", "short"), (2, "u", "short"),
        (1, "u", None), (0, "u", ""), (7, "u", "é\r\n\r\n\x00" * 60), (None, "u", same), (None, None, "only " * 50),
        (3, "u", same), (11, "u", "x" * 3_000_000),
    ]


def brute(rows):
    groups = defaultdict(list)
    for page_id, _, html in rows:
        if page_id is not None:
            groups[html or ""].append(page_id)
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        first = min(groups[html or ""], default=None)
        revisit = len(body) >= 100 and first is not None and page_id != first
        out.append((page_id, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def round_trip(pages, **options):
    manifest, folder = W.archive_pages(pages)
    return W.read_archives(manifest, folder, **options), manifest, folder


def test_round_trip_equals_brute_force(spark, sf_dir):
    for pages in (
        spark.createDataFrame(page_rows(), PAGES),
        spark.read.parquet(f"{sf_dir}/pages.parquet"),
        spark.createDataFrame(page_rows(), PAGES).withColumns({"digest": F.lit(1), "_id": F.lit(2), "_first": F.lit(3)}),
    ):
        read, _, _ = round_trip(pages)
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        number = lambda v: None if v is None else int(v)
        found = [(number(r[0]), r[1], r[2], r[3], number(r[4])) for r in read.select(*names).collect()]
        assert sorted(found, key=str) == brute([(r["page_id"], r["url"], r["html"]) for r in pages.collect()])
        for r in read.where("record_type = 'response'").collect():
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"]


def test_many_archives_are_read_by_many_tasks(spark):
    from pyspark import TaskContext

    pages = spark.range(400).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").repartition(40)
    manifest, folder = W.archive_pages(pages)
    files = manifest.count()
    task = F.udf(lambda _: TaskContext.get().partitionId(), "int")
    used = W.read_archives(manifest, folder).select(task("page_id").alias("t")).distinct().count()
    assert files >= 4 and used > files / 3


def test_empty_table(spark):
    read, _, _ = round_trip(spark.createDataFrame([], PAGES))
    assert read.count() == 0


def archive(records, dictionary=b""):
    stream = io.BytesIO()
    file = W.Archive(stream, dictionary)
    for r in records:
        file.add(r)
    return stream.getvalue()


def record(payload=b"<p>text</p>", **changes):
    return W.encode_record(1, "http://a", payload, hashlib.sha256(payload).hexdigest(), changes.get("refers_to"))


def test_dictionary_leads_in_a_skippable_frame_and_records_are_frames():
    samples = [record(f"<html><body><p>page {i} {'common words here ' * 90}</p></body></html>".encode()) for i in range(900)]
    dictionary = W.train_dictionary(samples)
    assert dictionary
    data = archive(samples[:5], dictionary)
    magic, size = struct.unpack("<II", data[:8])
    assert magic == W.SKIPPABLE_MAGIC
    assert zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]) == dictionary
    rest = data[8 + size :]
    assert rest.count(W.FRAME_MAGIC) == 5
    assert list(W.read_archive(io.BytesIO(data))) == samples[:5]
    with pytest.raises(W.WarcError):  # without its dictionary a frame cannot be read
        list(W.read_archive(io.BytesIO(rest)))
    plain = struct.pack("<II", W.SKIPPABLE_MAGIC, len(dictionary)) + dictionary + rest
    assert list(W.read_archive(io.BytesIO(plain))) == samples[:5]


def test_no_dictionary_for_few_samples_and_no_records():
    assert W.train_dictionary([record()]) == b""
    assert list(W.read_archive(io.BytesIO(archive([record()])))) == [record()]
    assert list(W.read_archive(io.BytesIO(b""))) == []


@pytest.mark.parametrize(
    "broken",
    [
        lambda r: r.replace(b"WARC/1.1", b"WARP/1.1"),
        lambda r: r.replace(b"WARC-Date", b"WARC-Data"),
        lambda r: r.replace(b"<p>text</p>", b"<p>texT</p>"),
        lambda r: r.replace(b"<p>text</p>", b"<p>text</p>more"),
        lambda r: r[:-1],
        lambda r: r.replace(b"Content-Length: 11", b"Content-Length: 12"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"),
        lambda r: r.replace(b"sha256:", b"md5:"),
        lambda r: r.replace(b"<urn:page:1>", b"page 1"),
        lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    ],
)
def test_damaged_records_are_refused(broken):
    assert W.decode_record(record())["payload"] == b"<p>text</p>"
    with pytest.raises(W.WarcError):
        W.decode_record(broken(record()))


def test_cut_archives_are_refused():
    data = archive([record(), record(b"y" * 500)])
    with pytest.raises(W.WarcError):
        list(W.read_archive(io.BytesIO(data[:-3])))
    with pytest.raises(W.WarcError):
        list(W.read_archive(io.BytesIO(data + b"junk junk junk")))
