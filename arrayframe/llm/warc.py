"""Operator 7, WARC: archives of Zstandard frames, written and read back.

An archive begins with a skippable frame that holds the compression dictionary
(absent when there was too little to train one), then has one frame for each
record. The reader loads the dictionary, decodes frame after frame, and checks
the version line, the required headers, the block's length against
Content-Length, the end of the record and, for responses, payload length and
digest; anything amiss raises ``WarcError``.

Archives are written to the shared folder by the tasks, each attempt under a
name of its own; only files in the committed manifest are read, so lost
executors and repeated attempts leave no doubled records.

Null html is an empty payload; null urls are left out. Equal payloads of at
least ``REVISIT_BYTES``: the largest page_id is the response, and all rows that
repeat it are; rows with a null page_id revisit it, or are responses where no
id is known. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, keep, shared_dir, stored

REVISIT_BYTES = 1000
#: Bytes at which an archive is closed, pages from which the dictionary is trained (at most), its size and the level.
ARCHIVE_BYTES, SAMPLE_PAGES, DICTIONARY_BYTES, LEVEL = 32 << 20, 200, 16 << 10, 3
#: Tasks that read archives, at most; beyond it a task reads several.
READERS = 50_000
#: Fixed values of the formats.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for the samples; empty if they are too few or too small."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def leading_frame(dictionary: bytes) -> bytes:
    return SKIPPABLE + len(dictionary).to_bytes(4, "little") + dictionary if dictionary else b""


def _line(text: str) -> str:
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One record; a revisit holds the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{url}')}>"),
        ("WARC-Date", DATE),
        *([("WARC-Target-URI", _line(url))] if url is not None else []),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", PROFILE)] if kind == "revisit" else []),
        *([("X-Page-Id", str(page_id))] if page_id is not None else []),
        *([("X-Refers-To-Page-Id", str(refers_to))] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = VERSION.decode() + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields)
    return lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, or ``WarcError``."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not first.startswith(b"WARC/1."):
        raise WarcError(f"no WARC record: {data[:40]!r}")
    fields: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise WarcError(f"no header: {line!r}")
        fields[name.strip().lower()] = value.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise WarcError(f"missing headers: {missing}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {fields['content-length']} and {len(rest) - 4} bytes")
    return fields, rest[:-4]


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of an archive."""
    at, dictionary = 0, None
    if data[:4] == SKIPPABLE:
        size = int.from_bytes(data[4:8], "little")
        if len(data) < 8 + size:
            raise WarcError("the dictionary's frame is cut")
        raw = data[8 : 8 + size]
        raw = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == FRAME else raw
        dictionary = zstandard.ZstdCompressionDict(raw)
        at = 8 + size
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    view, step = memoryview(data), 1 << 14
    while at < len(data):
        if data[at : at + 4] != FRAME:
            raise WarcError(f"no Zstandard frame at {at}")
        one, parts = decoder.decompressobj(), []
        while not one.eof:
            piece = view[at : at + step]
            if not len(piece):
                raise WarcError("the last frame is cut")
            try:
                parts.append(one.decompress(piece))
            except zstandard.ZstdError as e:
                raise WarcError(str(e)) from e
            at += len(piece) - len(one.unused_data)
        yield b"".join(parts)


def described(data: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of a record, with its checks."""
    fields, block = parse(data)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
    head, gap, payload = block.partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if not gap or length is None or kind not in ("response", "revisit"):
        raise WarcError(f"no HTTP response: {head[:60]!r}")
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise WarcError("payload and headers differ")
    if kind == "revisit" and payload:
        raise WarcError("a revisit with a payload")
    page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
    return (int(page) if page else None, length, digest, kind, int(to) if to else None)


def _written(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        options = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        out, size, count, name, done = None, 0, 0, "", []
        for batch in batches:
            encoder = zstandard.ZstdCompressor(level=LEVEL, **options)
            columns = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to")]
            for values in zip(*columns, strict=True):
                page_id, url, payload, digest, kind, refers_to = (v.as_py() for v in values)
                if out is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    out, size, count = fs.open_output_stream(name), 0, 0
                    size += out.write(leading_frame(dictionary)) or 0
                frame = encoder.compress(record(page_id, url, payload, digest, kind, refers_to))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((name, count))
                    out = None
        if out is not None:
            out.close()
            done.append((name, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n.rsplit('/', 1)[1]}" for n, _ in done], pa.string()), pa.array([c for _, c in done], pa.int64())], names=["path", "records"])

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    for batch in batches:
        for path, records in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
            fs, place = pafs.FileSystem.from_uri(path)
            with fs.open_input_stream(place) as f:
                rows = [described(x) for x in frames(f.read())]
            if len(rows) != records:
                raise WarcError(f"{path}: {len(rows)} records, not {records}")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to ``folder``; the manifest (path, records)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    text = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", text.cast("binary").alias("payload"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("bytes"))
    hashed = pages.select("page_id", F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("bytes")).where(F.col("bytes") >= REVISIT_BYTES)
    # groups of one need no keeper
    keepers = hashed.groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null").drop("n")
    # small payloads never meet: they stay out of the join, where all empty pages would share a key
    joined = rows.where(F.col("bytes") >= REVISIT_BYTES).join(keepers, ["digest", "bytes"], "left")
    joined = joined.unionByName(rows.where(F.col("bytes") < REVISIT_BYTES).withColumn("keeper", F.lit(None).cast("long")))
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    planned = joined.select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("keeper")).alias("refers_to"))
    sample = [bytes(r[0]) for r in pages.select(F.substring(text, 1, 20_000).cast("binary")).limit(SAMPLE_PAGES).collect()]
    return stored(in_batches(planned, _written(folder, train_dictionary(sample)), "path string, records bigint", keeps=True), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the manifest's archives: a task for each archive, up to ``READERS`` tasks."""
    tasks = max(1, min(READERS, manifest.count()))
    return in_batches(manifest.repartition(tasks), _read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint", keeps=True)


def round_trip(pages: DataFrame) -> DataFrame:
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    keep(folder)
    return read_archives(write_archives(pages, folder))
