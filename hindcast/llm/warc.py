"""WARC archives with a shared Zstandard dictionary, and their reader.

Writer: rows go through Spark to tasks; each task writes archives of at most ARCHIVE_BYTES of records to a folder
that all executors share. An archive trains a dictionary on its own records (at most SAMPLE_BYTES of them, spread
evenly over the archive), embeds it in a leading skippable frame and compresses every record as a frame of its own,
so a reader can start at any record. Files are written under a name of their attempt; only the manifest, which
Spark commits once, says which files count, so lost executors and repeated tasks leave no doubt.

Equal payloads: of those of at least REVISIT_BYTES the record with the largest page_id is the response, the
others are revisit records without a payload. The largest id is found by an aggregate that is summed before the
shuffle; digests that occur once are left out of it, and while no more than BROADCAST_ROWS are left they are broadcast, so
that no payload is shuffled. Beyond that the join back shuffles payloads by digest, hot digests dealt over several tasks.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hindcast.llm.common import BROADCAST_ROWS, checkpointed, small_batches, spread_join, text_of

#: Fixed values of the formats: the magic number of the frame that holds a dictionary, and that of a plain dictionary.
SKIPPABLE_MAGIC, DICTIONARY_MAGIC = 0x184D2A5D, 0xEC30A437
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 8 << 20
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"

MANIFEST = "path string, records long"
RECORDS = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def with_types(pages: DataFrame) -> DataFrame:
    """page_id, url, html (UTF-8), digest (SHA-1, hex) and refers_to, null for responses.

    A null html is an empty payload. Of rows alike in payload and page_id none revisits another; rows without a
    page_id are responses. Columns beyond page_id, url and html are not read.
    """
    html = text_of("html").cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    large = F.octet_length("html") >= REVISIT_BYTES
    last = checkpointed(rows.where(large).groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "last", "n"))
    count, total = last.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if count <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(last), F.col("digest") == F.col("of"), "left")
    else:
        joined = spread_join(rows, last, "digest", "of", "n", total, "left")
    return joined.select("page_id", "url", "html", "digest", F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _lines(head: list[tuple[str, str]]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in head)


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; the URI is percent-encoded, so nothing in it can end a header line."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\n" + _lines([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n"
    block = http if revisit else http + payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    head += [("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=~"))] if url is not None else []
    head += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest)), ("Page-Refers-To", str(refers_to))]
    head += [("Page-ID", str(page_id))] if page_id is not None else []
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + _lines(head) + b"\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> tuple | None:
    """The row of RECORDS that a record holds (None for warcinfo); raises if a payload and its digest disagree."""
    top, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = top.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines)
    if head["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(head["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    if head["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['WARC-Record-ID']} is damaged")
    number = lambda k: int(head[k]) if k in head else None
    return number("Page-ID"), unquote(head["WARC-Target-URI"]) if "WARC-Target-URI" in head else None, head["WARC-Type"], size, digest, number("Page-Refers-To"), payload


def build_dictionary(records: list[bytes]) -> bytes:
    """A Zstandard dictionary of at most SAMPLE_BYTES of the records, evenly spread; empty if they are too few to train on."""
    step = max(1, -(-sum(map(len, records)) // SAMPLE_BYTES))
    sample = [x[: SAMPLE_BYTES // 8] for x in records[::step]]
    if len(sample) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b""


def encode_archive(records: list[bytes]) -> bytes:
    """The dictionary in a skippable frame (of length 0 if there is none), a warcinfo record, then a frame for each record."""
    trained = build_dictionary(records)
    body = b"software: hindcast\r\nformat: WARC File Format 1.1\r\n"
    info = b"WARC/1.1\r\n" + _lines([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(None, hashlib.sha1(trained).hexdigest())), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]) + b"\r\n" + body + b"\r\n\r\n"
    packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, **({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    return b"".join([struct.pack("<II", SKIPPABLE_MAGIC, len(trained)), trained, packer.compress(info), *map(packer.compress, records)])


def decode_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame after another, from a readable file."""
    magic, n = struct.unpack("<II", source.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    trained = source.read(n)
    unpacker = zstandard.ZstdDecompressor(**({"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}))
    one, out, held, within = unpacker.decompressobj(), [], b"", False
    while chunk := held or source.read(1 << 16):
        held, within = b"", True
        out.append(one.decompress(chunk))
        if one.eof:
            yield b"".join(out)
            held, one, out, within = one.unused_data, unpacker.decompressobj(), [], False
    if within:
        raise ValueError("the archive ends within a record")


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Writes pages (page_id, url, html) as archives below folder, a URI that every executor reaches; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pafs.FileSystem.from_uri(folder)
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name = f"{top}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(name) as f:
                f.write(encode_archive(held))
            return pa.RecordBatch.from_pydict({"path": [name], "records": [len(held)]}, schema=pa.schema([("path", pa.string()), ("records", pa.int64())]))

        fs.create_dir(top, recursive=True)
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                held.append(encode_record(*row))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    small_batches(pages.sparkSession, 4)
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    manifest = f"{folder}/manifest"
    with_types(pages).mapInArrow(write, MANIFEST).write.parquet(manifest)
    return pages.sparkSession.read.parquet(manifest).withColumn("folder", F.lit(folder))


def read_warc(spark: SparkSession, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of a manifest's archives as RECORDS; payloads=False verifies them but leaves them out."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def pack(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for path, folder in zip(batch.column("path").to_pylist(), batch.column("folder").to_pylist(), strict=True):
                fs, _ = pafs.FileSystem.from_uri(folder)
                rows, size = [], 0
                with fs.open_input_stream(path) as f:
                    for record in decode_archive(f):
                        if row := decode_record(record):
                            rows.append(row if payloads else (*row[:-1], None))
                            size += len(record) if payloads else 100
                        if size >= 4 << 20:
                            yield pack(rows)
                            rows, size = [], 0
                if rows:
                    yield pack(rows)

    files = manifest.select("path", "folder")
    return files.repartition(max(1, min(files.count(), 10_000)), "path").mapInArrow(read, RECORDS)
