"""Operator 7: payloads stored losslessly as images in archives, read back through a custom data source.

Each payload is written as an 8-bit greyscale PNG, 576 samples a row. A task
packs its images into archives in the shared folder: members one after the other,
then a directory (id, offset, length, payload length, checksum of each member),
then a trailer that tells where the directory is. The data source plans
partitions as byte ranges of archives; a range reads the directory and the members
that begin in it, and hands them over in Arrow batches. A member whose read fails or
whose checksum differs is read again by its own offset, some times; the others
are not touched.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import kernel as K
from .common import prepare, shared_folder

UNIT = 576
MAGIC = b"QFARCH01"
#: id, whether the id is null, offset, length, bytes of the payload before padding, crc32 of the member.
ENTRY = np.dtype([("id", "<i8"), ("none", "u1"), ("offset", "<u8"), ("length", "<u8"), ("payload", "<u8"), ("crc", "<u4")])
TRAILER = "<QQ8s"
TRAILER_BYTES = struct.calcsize(TRAILER)
INDEX = "archive string, bytes long, members long"
MEMBER = "doc_id long, n_bytes long, media binary, attempts int"


# -- images ------------------------------------------------------------------------------------


def padded(raw: bytes) -> bytes:
    """The payload: raw and bytes 255 up to a positive multiple of UNIT."""
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def to_png(payload: bytes, level: int = 1) -> bytes:
    rows = len(payload) // UNIT
    lines = np.zeros((rows, UNIT + 1), np.uint8)  # each line after the number of its filter, 0
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, UNIT)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, rows, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> bytes:
    """The samples of an image that to_png has written."""
    at, body, shape = 8, [], None
    while at < len(media):
        size = struct.unpack_from(">I", media, at)[0]
        kind = media[at + 4 : at + 8]
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", media, at + 8)
        elif kind == b"IDAT":
            body.append(media[at + 8 : at + 8 + size])
        at += size + 12
    width, rows = shape
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(rows, width + 1)
    if lines[:, 0].any():
        raise ValueError("a line with a filter")
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, number of distinct samples, and a 64-bit average hash over equal stretches."""
    x = np.frombuffer(payload, np.uint8)
    cuts = np.arange(65) * len(x) // 64
    sums = np.add.reduceat(x, cuts[:-1], dtype=np.int64)
    above = sums * len(x) > x.sum(dtype=np.int64) * np.diff(cuts)
    return f"{int(x.sum(dtype=np.int64)) * 1000 // len(x)}:{np.count_nonzero(np.bincount(x, minlength=256))}:{int.from_bytes(np.packbits(above).tobytes(), 'big'):016x}"


# -- archives ----------------------------------------------------------------------------------


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 1 << 26) -> DataFrame:
    """Writes the texts of docs(doc_id, text) as archives below a folder; returns their index, a row for each archive.

    Files have names of their own for each attempt of a task; only those that the index names count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _filesystem(folder)
        system.create_dir(path, recursive=True)
        out, entries, at, name = None, [], 0, ""

        def close():
            directory = np.array(entries, ENTRY).tobytes()
            out.write(directory)
            out.write(struct.pack(TRAILER, at, len(directory), MAGIC))
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([at + len(directory) + TRAILER_BYTES]), pa.array([len(entries)])], ["archive", "bytes", "members"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), K.plain(batch.column(1)), strict=True):
                if out is None:
                    name, entries, at = f"{uuid.uuid4().hex}.qfa", [], 0
                    out = system.open_output_stream(f"{path}/{name}")
                raw = text.as_buffer().to_pybytes()
                media = to_png(padded(raw))
                out.write(media)
                entries.append((doc or 0, doc is None, at, len(media), len(raw), zlib.crc32(media)))
                at += len(media)
                if at >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, INDEX)


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int, size: int):
        self.archive, self.start, self.end, self.size = archive, start, end, size


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.index = options["path"]
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 1 << 25)))
        self.batch_bytes = int(options.get("batchbytes", options.get("batchBytes", 1 << 23)))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[InputPartition]:
        system, path = _filesystem(self.index)
        files = [f.path for f in system.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet")]
        found = []
        for f in sorted(files):
            t = pq.read_table(f, filesystem=system, columns=["archive", "bytes"])
            for archive, size in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), strict=True):
                found += [Range(archive, a, min(a + self.range_bytes, size), size) for a in range(0, size, self.range_bytes)]
        return found or [Range("", 0, 0, 0)]

    def _open(self, archive: str):
        system, path = _filesystem(archive)
        return system.open_input_file(path)

    def _directory(self, f, partition: Range) -> np.ndarray:
        """The directory at an archive's end, read by f or, where that fails or gives what can't be one, with new handles."""
        why = None
        for attempt in range(self.attempts):
            try:
                with nullcontext(f) if not attempt else self._open(partition.archive) as own:
                    start, size, magic = struct.unpack(TRAILER, own.read_at(TRAILER_BYTES, partition.size - TRAILER_BYTES))
                    raw = own.read_at(size, start) if magic == MAGIC else b""
                if magic == MAGIC and len(raw) == size:
                    return np.frombuffer(raw, ENTRY)
                why = ValueError(f"{partition.archive} is no archive")
            except (OSError, struct.error) as x:
                why = x
        raise OSError(f"{partition.archive}: its directory can't be read") from why

    def _again(self, archive: str, e) -> tuple[bytes, int]:
        """A member read by its offset alone, with a new handle each time."""
        why = None
        for attempt in range(2, self.attempts + 1):
            try:
                with self._open(archive) as f:
                    media = f.read_at(int(e["length"]), int(e["offset"]))
                if zlib.crc32(media) == e["crc"]:
                    return media, attempt
            except OSError as x:
                why = x
        raise OSError(f"{archive}: member at {int(e['offset'])} can't be read") from why

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("attempts", pa.int32())])
        if partition is None or not partition.archive:
            return
        with self._open(partition.archive) as f:
            entries = self._directory(f, partition)
            entries = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]
            rows, held = [], 0
            for e in entries:
                try:
                    media, attempt = f.read_at(int(e["length"]), int(e["offset"])), 1
                    good = zlib.crc32(media) == e["crc"]
                except OSError:
                    good = False
                if not good:
                    media, attempt = self._again(partition.archive, e)
                rows.append((None if e["none"] else int(e["id"]), int(e["payload"]), media, attempt))
                held += len(media)
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(index), index being a folder of Parquet that write_archives() gave."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEMBER

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def media_columns(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, attempts): the texts of docs stored as images and read back, a row for each row.

    A null text is empty; an empty one has a payload of UNIT bytes 255. Repeated
    rows are stored each; extra columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    prepare(spark)
    spark.dataSource.register(ArchiveSource)
    folder = shared_folder(spark, "media")
    index = f"{folder}/index"
    write_archives(docs, f"{folder}/archives").write.parquet(index)
    return spark.read.format("media_archive").load(index)


def media_digests(stored: DataFrame) -> DataFrame:
    """What the stored bytes hold: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(2):
                media = media.as_buffer().to_pybytes()
                payload = from_png(media)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
