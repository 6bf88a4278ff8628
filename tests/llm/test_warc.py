import hashlib
import struct
from urllib.parse import urlparse

import zstandard
from pyspark.sql import functions as F

from lexis.llm import warc
from lexis.llm.common import new_path

from .data import CLASHES

PAGES = "page_id long, url string, html string"


def pages(spark, rows, extra=False):
    df = spark.createDataFrame(rows, PAGES)
    return df.select("*", *[F.lit(1).alias(c) for c in CLASHES]) if extra else df


def html(i, n=1500):
    return f"<html><body>{i} " + "é lorem ipsum " * (n // 14) + "</body></html>"


ROWS = (
    [(i, f"http://x.example/{i}", html(i)) for i in range(40)]
    + [(100 + i, f"http://y.example/{i}", html("same")) for i in range(9)]
    + [(200, None, None), (201, "", ""), (202, "http://a b\n/", "x" * 999), (203, "http://c", "x" * 999), (204, "u", "y" * 1000), (205, "u", "y" * 1000), (None, "v", "y" * 1000), (206, "w", "z" * 5000), (206, "w", "z" * 5000), (None, None, html("null")), (None, "q", html("null"))]
)


def brute(rows):
    out = []
    for page_id, _, text in rows:
        payload = (text or "").encode()
        same = [p for p, _, t in rows if (t or "").encode() == payload and p is not None]
        first = max(same) if len(payload) >= 1000 and same else page_id
        revisit = first != page_id
        out.append((page_id, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.archived(pages(spark, ROWS, extra=True))
    assert got.columns[:5] == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS)
    assert warc.archived(pages(spark, [])).count() == 0


def test_file_format(spark):
    """The files are what the format says: a skippable frame with the dictionary, then one frame a record."""
    manifest = warc.write_archives(pages(spark, ROWS).repartition(3), new_path(spark, "t"), roll=2000).collect()
    assert len(manifest) > 3 and sum(m.records for m in manifest) == len(ROWS)
    for m in manifest:
        with open(urlparse(m.uri).path, "rb") as f:
            data = f.read()
        assert len(data) == m.bytes
        magic, size = struct.unpack("<II", data[:8])
        assert magic == 0x184D2A5D and size > 0
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
        rest, n = data[8 + size :], 0
        while rest:
            frame = reader.decompressobj()
            text = frame.decompress(rest)
            assert text.startswith(b"WARC/1.1\r\nWARC-Type: ") and text.endswith(b"\r\n\r\n")
            rest, n = frame.unused_data, n + 1
        assert n == m.records


def test_dictionary_helps_and_falls_back():
    rng = [f"<html><head><title>{i}</title></head><body class='main'>{'abc' * (i % 7)}</body></html>".encode() for i in range(2000)]
    shared = warc.dictionary(rng, 4096)
    plain = len(zstandard.compress(rng[5]))
    assert len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(shared)).compress(rng[5])) < plain
    assert warc.dictionary([b"one"]) == b"one" and warc.dictionary([]) == b"" and warc.dictionary([b""]) == b""


def test_large_groups_and_long_pages(spark):
    """Groups that are broadcast and groups that are met give the same; an html longer than the sample's bound is written whole."""
    rows = ROWS + [(300 + i, "u", html("huge", 200_000)) for i in range(3)]
    for hot in (10_000, 2, 0.5):  # all groups large, some, none
        planned = warc.planned(pages(spark, rows), hot=hot).collect()
        assert sorted(((r.page_id, r.refers_to) for r in planned), key=str) == sorted(((r[0], r[4]) for r in brute(rows)), key=str)
    manifest = warc.write_archives(pages(spark, rows).repartition(3), new_path(spark, "t"), sample_bytes=100)
    assert sorted(map(tuple, warc.read_archives(manifest).collect()), key=str) == brute(rows)


def test_archives_are_read_by_many_tasks(spark):
    manifest = warc.write_archives(pages(spark, ROWS), new_path(spark, "t"), roll=500)
    n = manifest.count()
    assert n > 20 and warc.read_archives(manifest, task_bytes=1000).rdd.getNumPartitions() > 10
    assert warc.read_archives(manifest, task_bytes=1).rdd.getNumPartitions() == n
