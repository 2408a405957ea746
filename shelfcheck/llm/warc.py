"""WARC archives of pages, compressed with a dictionary that each archive carries.

Each task writes one ``.warc.zst`` file: a Zstandard dictionary built from the first of its own records (at most
``SAMPLE`` bytes of them), embedded in a leading skippable frame, then every record as a frame of its own, a
warcinfo record first. Pages are dealt by payload digest; of pages with equal payloads of at least ``least`` bytes
the one with the largest id (of equal ids the largest url) is written as a response and the others as revisits of
it. Files are named by attempt and listed in a manifest that Spark commits, so tasks that run again leave no double.

A null payload is empty. Null ids come below all others. Rows repeated as a whole are each written, those equal to
the response as responses. An empty table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, saved, shared_folder

# Fixed values of the formats: the skippable frame that holds a dictionary, and the profile of revisits.
DICT_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
SAMPLE, DICT_SIZE, LEVEL = 4 << 20, 64 << 10, 3
_READ = 1 << 17


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: dict[str, str], block: bytes) -> bytes:
    """One WARC 1.1 record."""
    head = {"WARC-Type": kind, **fields, "Content-Length": str(len(block))}
    lines = ["WARC/1.1", *[f"{k}: {v}" for k, v in head.items()], "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, block) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]}")
    fields = dict(x.split(": ", 1) for x in lines)
    return fields, rest[: int(fields["Content-Length"])]


def _line(text) -> str:
    return "" if text is None else str(text).replace("\r", "%0D").replace("\n", "%0A")


def page_record(page_id, url: str | None, payload: bytes, refers_to, is_response: bool, date: str, place: str = "") -> bytes:
    """Response or revisit record of a page. Ids stand in fields of their own beside the record's URN.

    A response's URN is made from page id and payload, so that revisits can name it; a revisit's also from its place
    (archive and number), so that repeated rows differ. Repeated rows that are all responses share a URN.
    """
    digest = payload_digest(payload)
    name = lambda x, at="": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}:{digest}:{at}')}>"
    fields = {
        "WARC-Record-ID": name(page_id) if is_response else name(page_id, place), "WARC-Date": date, "WARC-Target-URI": _line(url),
        "WARC-Payload-Digest": f"sha1:{digest}", "Content-Type": "application/http; msgtype=response",
        "X-Page-ID": _line(page_id), "X-Payload-Length": str(len(payload))}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if is_response:
        return record("response", fields, http + payload)
    return record("revisit", fields | {
        "WARC-Profile": PROFILE, "WARC-Refers-To": name(refers_to), "X-Refers-To-Page-ID": _line(refers_to)}, http)


def write_archive(out, records: Iterator[bytes], date: str, archive: str = "") -> tuple[int, int]:
    """Write records to a binary stream; returns (records, bytes) written, the warcinfo left out of the first.

    The dictionary is learned from the first ``SAMPLE`` bytes of records, of each its first 128 KiB; all are written
    whole. The warcinfo's URN is made from the archive's name.
    """
    import zstandard as zstd

    held, size = [], 0
    for x in records:
        held.append(x)
        size += len(x)
        if size >= SAMPLE:
            break
    try:
        trained = zstd.train_dictionary(DICT_SIZE, [x[: 128 << 10] for x in held], k=200, d=8)
    except zstd.ZstdError:  # too few records to learn from: their own bytes are the dictionary
        trained = zstd.ZstdCompressionDict(b"".join(held)[:DICT_SIZE].ljust(8, b"\0"), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    content = trained.as_bytes()
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)
    total = out.write(struct.pack("<II", DICT_FRAME, len(content)) + content)
    info = record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{archive}')}>",
                               "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
    total += out.write(packer.compress(info))
    n = 0
    for part in (held, records):
        for x in part:
            total += out.write(packer.compress(x))
            n += 1
    return n, total


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a binary stream, one frame at a time."""
    import zstandard as zstd

    kind, size = struct.unpack("<II", source.read(8))
    if kind != DICT_FRAME:
        raise ValueError("no leading dictionary frame")
    unpacker = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(source.read(size)))
    rest = source.read(_READ)
    while rest:
        frame, parts = unpacker.decompressobj(), []
        while not frame.eof:
            if not rest:
                raise ValueError("the archive ends within a record")
            parts.append(frame.decompress(rest))
            rest = frame.unused_data if frame.eof else source.read(_READ)
        rest = rest or source.read(_READ)
        yield parsed(b"".join(parts))


def _write(folder: str, date: str):
    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        path = f"{folder}/pages-{context.partitionId():06d}-{context.taskAttemptId()}.warc.zst"

        def records() -> Iterator[bytes]:
            n = 0
            for batch in batches:
                for page_id, url, html, refers_to, first in zip(*batch.columns, strict=True):
                    yield page_record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), first.as_py(), date, f"{path}:{n}")
                    n += 1

        rows = records()
        start = next(rows, None)
        if start is None:
            return
        store, local = filesystem(path)
        store.create_dir(os.path.dirname(local), recursive=True)

        def every() -> Iterator[bytes]:
            yield start
            yield from rows

        with store.open_output_stream(local, compression=None) as out:
            n, size = write_archive(out, every(), date, path)
        yield pa.RecordBatch.from_pydict({"path": [path], "n_records": pa.array([n], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    return run


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", date: str = "2026-01-01T00:00:00Z") -> DataFrame:
    """Write all pages; returns the manifest, one row for each archive."""
    folder = folder or shared_folder(pages.sparkSession, "archives")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary")))
    key = F.struct(F.col("id").isNotNull().alias("k"), F.col("id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    firsts = rows.groupBy("digest").agg(F.max(key).alias("first"))
    alone = F.octet_length("html") < least
    marked = rows.join(firsts, "digest").select(
        "id", "url", "html", F.col("first.id").alias("refers_to"), (alone | key.eqNullSafe(F.col("first"))).alias("is_first"))
    return saved(marked.mapInArrow(_write(folder, date), MANIFEST), "archive-manifest")


def read_archives(spark: SparkSession, manifest: DataFrame, id_type: str = "long") -> DataFrame:
    """Per page record: page_id, url, record_type, payload_bytes, payload_digest, refers_to and html (null for revisits)."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, local = filesystem(path)
                rows: list[tuple] = []
                size = 0
                with store.open_input_stream(local, compression=None) as source:
                    for fields, block in read_archive(source):
                        kind = fields["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        whole = kind == "response"
                        n, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if whole and (len(payload) != n or payload_digest(payload) != digest):
                            raise ValueError(f"damaged record in {path}")
                        rows.append((fields["X-Page-ID"] or None, fields["WARC-Target-URI"], kind, n, digest,
                                     fields.get("X-Refers-To-Page-ID") or None, payload.decode() if whole else None))
                        size += len(payload)
                        if size > _READ * 16 or len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    import pyarrow as pa

    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
    read = manifest.select("path").repartition(max(1, manifest.count()), "path").mapInArrow(
        run, "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, html string")
    return read.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
