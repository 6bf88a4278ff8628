"""Operator 2: WARC archives of individually compressed records under an embedded Zstandard dictionary."""

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least_hashed, materialise, new_path

#: The skippable frame that carries the dictionary, as the public .warc.zst convention has it.
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def dictionary(samples: list[bytes], size: int = 112_640) -> bytes:
    """A trained dictionary; too few samples to train on serve as raw content; none gives no dictionary."""
    samples = [s for s in samples if s]
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def record_id(page_id: int | None, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url if page_id is None else ""}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the HTTP header alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else None
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, url)), ("WARC-Date", DATE), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("X-Page-ID", page_id), ("X-Payload-Length", len(payload)),
        ("WARC-Profile", PROFILE if refers_to is not None else None), ("WARC-Refers-To", record_id(refers_to, None) if refers_to is not None else None), ("X-Refers-To-Page-ID", refers_to),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


class Writer:
    """An archive: the dictionary in a leading skippable frame, then a frame for each record."""

    def __init__(self, uri: str, shared: bytes, level: int = 3):
        system, path = fs.FileSystem.from_uri(uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.uri, self.file, self.records, self.size = uri, system.open_output_stream(path, compression=None), 0, 0
        known = zstandard.ZstdCompressionDict(shared) if shared else None
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True, write_checksum=True)
        self.put(struct.pack("<II", SKIPPABLE, len(shared)) + shared)

    def put(self, data: bytes) -> None:
        self.file.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> None:
        self.put(self.compressor.compress(data))
        self.records += 1


def read_records(uri: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of every record of an archive, one at a time."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path, compression=None) as file:
        magic, size = struct.unpack("<II", file.read(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{uri}: no dictionary frame")
        shared = file.read(size)
        known = zstandard.ZstdCompressionDict(shared) if shared else None
        stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=known).stream_reader(file, read_across_frames=True), 1 << 20)
        while line := stream.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"{uri}: not a record: {line[:40]!r}")
            head = {}
            while (line := stream.readline()) != b"\r\n":
                name, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
                head[name.lower()] = value.removesuffix("\r\n")
            block = stream.read(int(head["content-length"]))
            stream.read(4)
            yield head, block


def planned(pages: DataFrame, least: int = 1000, hot: int = 10_000) -> DataFrame:
    """Pages with payload, digest, and the page that a revisit refers to.

    Groups of equal payloads come as one row each from partial aggregates. Those with one in `hot` of the grouped rows
    or more, at most `hot` groups, are broadcast, so that their copies stay where they are, however many; all other
    pages meet their groups in an exchange, in which no key is large.
    """
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    groups = materialise(groups, "warc-groups")
    bound = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] / hot
    large, small = groups.where(F.col("n") >= bound).drop("n"), groups.where(F.col("n") < bound).drop("n")
    of_large = rows.join(F.broadcast(large), "digest")
    others = rows.join(F.broadcast(large.select("digest")), "digest", "left_anti").join(small, "digest", "left")
    refers = F.when(F.col("first").eqNullSafe(F.col("page_id")), None).otherwise(F.col("first"))
    return of_large.unionByName(others).withColumn("refers_to", refers)


def write_archives(pages: DataFrame, folder: str, roll: int = 256_000_000, samples: int = 500, sample_bytes: int = 65_536) -> DataFrame:
    """Write every page as a record to archives under `folder`; returns the manifest (`uri`, `records`, `bytes`).

    The dictionary comes from the `samples` pages with the smallest hashes among those of at most `sample_bytes`, whole:
    that bounds what reaches the driver. If all pages are longer, records are compressed without a dictionary. Each attempt of a task writes files of its own name; only the manifest, which has those
    of the attempts that counted, says what belongs to the archive, so repeated tasks do no harm.
    """
    short = pages.where(F.octet_length("html") <= sample_bytes).select("html", "page_id", "url")
    taken = least_hashed(short, samples, "page_id", "url").collect()
    shared = pages.sparkSession.sparkContext.broadcast(dictionary([record(r.page_id, None, r.html.encode(), "00" * 20, None) for r in taken]))

    def write(batches):
        out = None
        done = []
        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for row in zip(*columns):
                if out is None or out.size > roll:
                    if out is not None:
                        out.file.close()
                    out = Writer(f"{folder}/part-{uuid.uuid4().hex}.warc.zst", shared.value)
                    done.append(out)
                out.add(record(*row))
        if out is not None:
            out.file.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([w.uri for w in done]), pa.array([w.records for w in done], pa.int64()), pa.array([w.size for w in done], pa.int64())], ["uri", "records", "bytes"])

    rows = planned(pages).select("page_id", "url", "payload", "digest", "refers_to")
    return materialise(rows.mapInArrow(write, "uri string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, task_bytes: int = 64_000_000) -> DataFrame:
    """One row per record: `page_id`, `payload_bytes`, `payload_digest`, `record_type`, `refers_to`.

    A response's payload is hashed again and must agree with its header; a revisit has the full payload's figures
    from its header. Archives are dealt to as many tasks as there are cores, and beyond that to one for each
    `task_bytes`.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))))

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def parsed(uri: str) -> Iterator[tuple]:
        for head, block in read_records(uri):
            digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
            size = int(head["x-payload-length"])
            if head["warc-type"] == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"{uri}: damaged record {head['warc-record-id']}")
            yield number(head.get("x-page-id")), size, digest, head["warc-type"], number(head.get("x-refers-to-page-id"))

    def read(batches):
        for b in batches:
            for uri in b.column(0).to_pylist():
                held = []
                for row in parsed(uri):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)
                        held = []
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema)

    held = manifest.agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    tasks = max(manifest.sparkSession.sparkContext.defaultParallelism, -(-held.bytes // task_bytes))
    return manifest.select("uri").repartition(max(1, min(held.n, tasks))).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder, read them back, and return a row per record.

    Payload: the html in UTF-8 (null: empty). Among equal payloads of at least 1000 bytes, the rows of the largest
    page_id are responses and the others revisits of it; smaller ones are all responses. A null page_id is less than
    any other; if a group has no other, its rows are responses. Repeated rows are records each. Null and odd urls are
    left out or percent-encoded; long payloads are written whole. Empty tables give no rows; other columns are ignored.
    """
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc")))
