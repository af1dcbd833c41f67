"""WARC archives of web pages, compressed with Zstandard: a dictionary first, then one frame for each record."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, small_batches, staged

#: Fixed values of the format: the skippable frame that holds the dictionary, Zstandard's own frames, a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: An archive is closed once it holds so many bytes; a dictionary learns from the records that fit into SAMPLE_BYTES.
ARCHIVE_BYTES = 16 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
#: Tasks that archives are dealt out to at most; a task reads one archive after the other.
MOST_TASKS = 20_000

RECORD = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, error string"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    revisit = refers_to is not None
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {re.sub('[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url or 'urn:page:none')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records; the first ones, up to SAMPLE_BYTES, wait until they have trained the archive's dictionary."""

    def __init__(self) -> None:
        self.waiting: list[bytes] = []
        self.out: list[bytes] = []
        self.size = self.records = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._frame(record)
        else:
            self.waiting.append(record)
            self.size += len(record)
            if self.size >= SAMPLE_BYTES:
                self._start()

    def close(self) -> bytes:
        if not self.compressor:
            self._start()
        return b"".join(self.out)

    def _frame(self, record: bytes) -> None:
        self.out.append(self.compressor.compress(record))
        self.size += len(self.out[-1])

    def _start(self) -> None:
        self.size = 0
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, self.waiting) if len(self.waiting) >= 8 else None
        except zstandard.ZstdError:  # too few or too uniform records: the archive has no dictionary
            trained = None
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=trained, write_checksum=True)
        if trained:
            body = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
            self.out.append(DICTIONARY_FRAME.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
        for r in self.waiting:
            self._frame(r)
        self.waiting = []


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at `at` ends, by its block headers."""
    end = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if end + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[end : end + 3], "little")
        last = block & 1
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    end += 4 * (data[at + 4] >> 2 & 1)
    if end > len(data):
        raise ValueError("truncated frame")
    return end


def frames(archive: bytes) -> Iterator[bytes]:
    """The records of an archive: the dictionary of the leading skippable frame, if there is one, decodes every later frame."""
    data, at = memoryview(archive), 0
    decompressor = zstandard.ZstdDecompressor()
    while at < len(data):
        if len(data) - at < 8:
            raise ValueError("truncated frame")
        magic, size = int.from_bytes(data[at : at + 4], "little"), int.from_bytes(data[at + 4 : at + 8], "little")
        if magic >> 4 == 0x184D2A5:
            if at + 8 + size > len(data):
                raise ValueError("truncated frame")
            if magic == DICTIONARY_FRAME and at == 0:
                body = bytes(data[8 : 8 + size])
                if int.from_bytes(body[:4], "little") == FRAME:
                    body = zstandard.ZstdDecompressor().decompress(body)
                if int.from_bytes(body[:4], "little") != DICTIONARY:
                    raise ValueError("the leading frame holds no dictionary")
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == FRAME:
            end = frame_end(data, at)
            yield decompressor.decompress(data[at:end], max_output_size=0 if zstandard.frame_content_size(data[at:end]) >= 0 else 1 << 31)
            at = end
        else:
            raise ValueError(f"no frame starts at byte {at}")


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _page(uri: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d*)>", uri)
    if not found:
        raise ValueError(f"not a page's id: {uri[:80]}")
    return int(found[1]) if found[1] else None


def parse_record(record: bytes) -> tuple:
    """A row of RECORD. Raises ValueError where a header is missing or a length or digest does not hold."""
    head, gap, rest = record.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    h = _fields(head)
    if missing := [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in h]:
        raise ValueError(f"missing header {missing[0]}")
    if not h["content-length"].isdigit() or len(rest) != int(h["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("wrong Content-Length")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    inner = _fields(http)
    if not gap or not http.startswith(b"HTTP/") or not inner.get("content-length", "").isdigit():
        raise ValueError("no HTTP header")
    size, digest, kind = int(inner["content-length"]), h.get("warc-payload-digest", "").removeprefix("sha256:"), h["warc-type"]
    if kind == "response":
        if size != len(payload) or digest != hashlib.sha256(payload).hexdigest():
            raise ValueError("the payload does not match its length or digest")
    elif kind != "revisit" or payload or "warc-refers-to" not in h or len(digest) != 64:
        raise ValueError(f"not a whole {kind} record")
    refers = _page(h["warc-refers-to"]) if kind == "revisit" else None
    return _page(h["warc-record-id"]), h.get("warc-target-uri"), kind, refers, payload if kind == "response" else None, size, digest, None


def with_revisits(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, html, digest, size, refers_to.

    Of rows with equal payloads of at least `least_bytes`, those with the smallest page_id stay
    responses; the others refer to it. A null html is an empty payload. A row without page_id
    comes after all others; if none of its group has one, all are responses.
    """
    p = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("size", F.octet_length("html").cast("long"))
    shared = p.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return p.join(shared, "digest", "left").select("page_id", "url", "html", "digest", "size", F.expr("case when coalesce(page_id > first, first is not null) then first end").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the rows of with_revisits() into archives below the shared folder; (path, records) of each.

    The listing is written down as the archives are, so it names the files of the attempts that
    succeeded; what a lost executor left behind is in no listing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def put(w: ArchiveWriter) -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(w.close())
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([w.records], pa.int64())], ["path", "records"])

        w = ArchiveWriter()
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                page_id, url, html, digest, size, refers_to = row
                w.add(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, size, refers_to, date))
                if w.compressor and w.size >= ARCHIVE_BYTES:
                    yield put(w)
                    w = ArchiveWriter()
        if w.records:
            yield put(w)

    small_batches(pages.sparkSession)
    return staged(pages.mapInArrow(run, "path string, records long"))


def _records(archive: bytes, path: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    """Batches of RECORD. A damaged record is a row with an error; what follows a damaged frame cannot be read."""
    rows: list[tuple] = []
    held = 0
    found = frames(archive)
    while True:
        try:
            row = parse_record(next(found))
        except StopIteration:
            break
        except (ValueError, zstandard.ZstdError) as e:
            row = (*[None] * 7, f"{path}: {e}")
        rows.append(row if payloads else (*row[:4], None, *row[5:]))
        held += len(row[4] or b"")
        if len(rows) >= 256 or held > 4 << 20:
            yield _batch(rows)
            rows, held = [], 0
    if rows:
        yield _batch(rows)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """archives(path) -> a row of RECORD for each record. Where an archive or a record is broken, error says how.

    An archive is one task's work at a time and holds about ARCHIVE_BYTES. The archives are dealt
    out by their number: the listing itself is far too small for Spark to spread it by its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                with store.open_input_stream(at, compression=None) as f:
                    archive = f.read()
                yield from _records(archive, path, payloads)

    spread = archives.select("path").repartition(min(max(1, archives.count()), MOST_TASKS), "path")
    return spread.mapInArrow(run, RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.string())
    names = [x.split()[0] for x in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_files(spark: SparkSession, glob: str, payloads: bool = True) -> DataFrame:
    """Rows of RECORD, as read_archives() has them, of archives in a store that only Spark's readers open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, archive in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from _records(archive.as_py(), path, payloads)

    small_batches(spark, 1)
    return spark.read.format("binaryFile").load(glob).select("path", "content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back: the rows of RECORD, without the payloads.

    One row for each row of pages; nulls, empty payloads and repeated rows as with_revisits() has
    them. Without pages there is no archive and no row. Other columns of pages are not archived.
    """
    folder = f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(with_revisits(pages), folder), payloads=False)
