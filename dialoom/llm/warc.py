"""WARC archives in Zstandard form: a dictionary in a leading skippable frame, then one frame per record.

Writing: each partition trains a dictionary on its first records and writes archives
of bounded size to the shared folder. A file counts only once its task's row in the
manifest is committed, so files of lost or repeated attempts are never read.
Reading: Spark reads the files; each frame is decoded with the file's dictionary,
and the record's version, headers, lengths and digests are checked.

A page whose payload (at least ``revisit_bytes`` long) a page of smaller id has too
becomes a revisit of the smallest such id. Null html: an empty payload. A null id is
larger than all ids; pages that repeat both id and payload are all responses, and so
are equal payloads none of which has an id. Null urls are written as ``urn:unknown``.
Empty tables give no archive. Payloads are held whole, one record at a time.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import struct
import urllib.parse
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import remove
from .common import BROADCAST_ROWS, Scratch, as_bytes, slices, small_side

#: Fixed values of the Zstandard formats.
DICTIONARY_FRAME = 0x184D2A5D
DATA_FRAME = 0xFD2FB528
#: Bytes of records that a dictionary is trained on, and its own size at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 1 << 15
#: An archive is closed when it has so many bytes.
ARCHIVE_BYTES = 32 << 20
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _uri(page: object) -> str:
    return f"<urn:page:{urllib.parse.quote(str(page), safe='')}>"


def make_record(page: object, url: str | None, payload: bytes, refers_to: object, revisit: bool, date: str) -> bytes:
    """A response, or a revisit without the payload; both name the full payload's length and digest."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_uri(page) if page is not None else f'<urn:uuid:{uuid.uuid4()}>'}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {urllib.parse.quote(url, safe=SAFE) if url else 'urn:unknown'}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_uri(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: What a URL keeps as it is: all printable ASCII but the characters that would break a header.
SAFE = "".join(chr(c) for c in range(33, 127))


class ArchiveError(ValueError):
    """A record or frame that breaks the format."""


def _headers(lines: list[bytes]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise ArchiveError(f"no header: {line[:80]!r}")
        out[name.strip().decode()] = value.strip().decode()
    return out


def _length(headers: dict, of: int) -> int:
    value = headers.get("Content-Length", "")
    if not value.isdigit() or int(value) > of:
        raise ArchiveError(f"Content-Length {value!r} of {of} bytes")
    return int(value)


def parse_record(data: bytes) -> tuple[dict[str, str], int, str, bytes | None]:
    """(headers, payload length, payload digest, payload or None for a revisit), after all checks."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if version not in (b"WARC/1.0", b"WARC/1.1") or not gap:
        raise ArchiveError(f"no WARC version line: {version[:40]!r}")
    headers = _headers(lines)
    if missing := [n for n in NEEDED if n not in headers]:
        raise ArchiveError(f"missing {missing}")
    n = _length(headers, len(rest) - 4)
    block = rest[:n]
    if rest[n:] != b"\r\n\r\n":
        raise ArchiveError("the block is not followed by two line ends, or not as long as it says")
    if headers.get("WARC-Block-Digest", f"sha1:{digest(block)}") != f"sha1:{digest(block)}":
        raise ArchiveError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    status, *lines = http.split(b"\r\n")
    if not status.startswith(b"HTTP/") or not gap:
        raise ArchiveError("no HTTP status line")
    revisit = headers["WARC-Type"] == "revisit"
    said = headers.get("WARC-Payload-Digest", "")
    size = _length(_headers(lines), 1 << 62 if revisit else len(payload))
    if revisit:
        if payload or "WARC-Refers-To" not in headers:
            raise ArchiveError("a revisit with a payload or without a target")
        return headers, size, said.removeprefix("sha1:"), None
    if size != len(payload) or said != f"sha1:{digest(payload)}":
        raise ArchiveError("payload length or digest differs")
    return headers, size, said.removeprefix("sha1:"), payload


def train(samples: list[bytes]) -> bytes:
    """A dictionary; of few or tiny samples, their own bytes."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def leading_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
    data = packed if len(packed) < len(dictionary) else dictionary
    return struct.pack("<II", DICTIONARY_FRAME, len(data)) + data


def _frame_end(data: memoryview, at: int) -> int:
    """Where the data frame at ``at`` ends, by its block headers."""
    parameters = zstandard.get_frame_parameters(data[at : at + 18])
    here = at + zstandard.frame_header_size(data[at : at + 18])
    last = False
    while not last:
        if here + 3 > len(data):
            raise ArchiveError("a frame is cut off")
        head = int.from_bytes(data[here : here + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        here += 3 + (1 if kind == 1 else size)
    here += 4 * parameters.has_checksum
    if here > len(data):
        raise ArchiveError("a frame is cut off")
    return here


def read_frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of one archive."""
    view, at, dictionary = memoryview(data), 0, None
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICTIONARY_FRAME:
        at = 8 + struct.unpack_from("<I", data, 4)[0]
        raw = data[8:at]
        if at > len(data):
            raise ArchiveError("the dictionary is cut off")
        if raw[:4] == struct.pack("<I", DATA_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        dictionary = zstandard.ZstdCompressionDict(raw) if raw else None
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(data):
        magic = struct.unpack_from("<I", data, at)[0] if at + 8 <= len(data) else 0
        if magic >> 4 == DICTIONARY_FRAME >> 4:  # another skippable frame
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            continue
        if magic != DATA_FRAME:
            raise ArchiveError("no frame begins where the last one ended")
        try:
            end = _frame_end(view, at)
            record = decoder.decompress(view[at:end])
        except zstandard.ZstdError as error:
            raise ArchiveError(f"a frame cannot be decoded: {error}") from error
        yield record
        at = end


class _Archive:
    """A file in the shared folder, filled through pyarrow's file systems."""

    def __init__(self, root: str, dictionary: bytes) -> None:
        from pyarrow import fs

        self.name = f"{uuid.uuid4().hex}.warc.zst"
        # Hadoop's names of a store that pyarrow knows by one name
        system, path = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", f"{root}/{self.name}"))
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.records = system.open_output_stream(path, compression=None), 0
        self.out.write(leading_frame(dictionary))
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)

    def add(self, record: bytes) -> int:
        self.out.write(self.coder.compress(record))
        self.records += 1
        return self.out.tell()


def plan_records(pages: DataFrame, revisit_bytes: int, id_col: str, url_col: str, html_col: str, few: int = BROADCAST_ROWS) -> DataFrame:
    """(_id, _url, _html, _first): the pages with the smallest id among equal payloads, where there are several.

    Payloads meet by digest and length, never as texts; counts and least ids are
    combined before the shuffle. The groups of several join by broadcast while they
    are ``few``. Beyond that, those with more than their rows' ``few``-th part, which
    are fewer than ``few``, still do, so that no payload with many copies is a key of
    the shuffle that joins the others.
    """
    raw = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("_url"), raw.alias("_html"))
    rows = rows.withColumn("_sha", F.sha1("_html")).withColumn("_n", F.length("_html"))
    groups = rows.groupBy("_sha", "_n").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    groups = Scratch(pages.sparkSession, "warc").write(groups.where(F.col("_rows") > 1), "groups")
    number, copies = groups.agg(F.count("*"), F.sum("_rows")).first()
    keys, out = ["_sha", "_n"], ["_id", "_url", "_html", "_first"]
    first = F.when(F.col("_n") >= revisit_bytes, F.col("_first")).alias("_first")
    if number <= few:
        return rows.join(F.broadcast(groups.select(*keys, first)), keys, "left").select(*out)
    large = F.broadcast(groups.where(F.col("_rows") * few > copies).select(*keys, first))
    small = groups.where(F.col("_rows") * few <= copies).select(*keys, first)
    others = rows.join(large, keys, "left_anti").join(small, keys, "left")
    return rows.join(large, keys).select(*out).union(others.select(*out))


def write_archives(
    pages: DataFrame,
    root: str | None = None,
    revisit_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> tuple[str, DataFrame]:
    """Writes the pages; returns the folder and the manifest (file, records), which names the files that count."""
    scratch = Scratch(pages.sparkSession, "archives")
    folder = root or scratch.path("files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[bytes]:
            for batch in slices(batches, 64):
                for page, url, html, first in zip(*(batch.column(k).to_pylist() for k in range(4))):
                    yield make_record(page, url, html, first, first is not None and page != first, date)

        stream = records()
        samples: list[bytes] = []
        while sum(map(len, samples)) < SAMPLE_BYTES and (record := next(stream, None)) is not None:
            samples.append(record)
        if not samples:
            return
        dictionary, archive, done = train([s[:65536] for s in samples]), None, []
        for record in itertools.chain(samples, stream):
            archive = archive or _Archive(folder, dictionary)
            if archive.add(record) >= archive_bytes:
                archive.out.close()
                done.append(archive)
                archive = None
        if archive:
            archive.out.close()
            done.append(archive)
        yield pa.RecordBatch.from_arrays([pa.array([a.name for a in done]), pa.array([a.records for a in done], pa.int64())], names=["file", "records"])

    planned = plan_records(pages, revisit_bytes, id_col, url_col, html_col)
    manifest = scratch.write(planned.mapInArrow(run, "file string, records long"), "manifest")
    if not root:  # a folder that others name may hold others' archives
        _remove_strays(folder, manifest)
    return folder, manifest


def _remove_strays(folder: str, manifest: DataFrame) -> None:
    """Deletes the files of attempts that were lost or came second. Files are listed, not read."""
    spark = manifest.sparkSession
    if not manifest.head(1):
        return
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", F.substring_index("path", "/", -1).alias("file"))
    for r in files.join(manifest, "file", "left_anti").select("path").toLocalIterator():
        remove(spark, r.path)


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = False) -> DataFrame:
    """(page, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) for each record; ids as text.

    A record that breaks the format fails the query, with the file's name. Files
    that the manifest does not name are left out.
    """
    if manifest is not None and not manifest.head(1):
        return spark.createDataFrame([], SCHEMA + ", payload binary" * payloads)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select("content", F.substring_index("path", "/", -1).alias("file"))
    if manifest is not None:
        files = files.join(small_side(manifest.select("file"), manifest.count()), "file", "left_semi")

    def page(uri: str | None) -> str | None:
        if uri is None or not uri.startswith("<urn:page:"):
            return None
        return urllib.parse.unquote(uri[len("<urn:page:") : -1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, name in enumerate(batch.column(1).to_pylist()):
                rows = []
                try:
                    for data in read_frames(batch.column(0)[k].as_py()):
                        headers, size, sha, payload = parse_record(data)
                        kind = headers["WARC-Type"]
                        rows.append((page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, sha, kind, page(headers.get("WARC-Refers-To")), payload))
                        if len(rows) >= (64 if payloads else 4096):
                            yield _batch(rows, payloads)
                            rows = []
                except ArchiveError as error:
                    raise ArchiveError(f"{name}: {error}") from error
                if rows:
                    yield _batch(rows, payloads)

    return files.select("content", "file").mapInArrow(run, SCHEMA + ", payload binary" * payloads)


SCHEMA = "page string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string"


def _batch(rows: list[tuple], payloads: bool) -> pa.RecordBatch:
    kinds = [pa.string()] * 2 + [pa.int64()] + [pa.string()] * 3 + [pa.binary()]
    names = ["page", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    n = 7 if payloads else 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows))[:n], kinds)], names=names[:n])


__all__ = ["ArchiveError", "as_bytes", "parse_record", "read_archives", "read_frames", "write_archives"]
