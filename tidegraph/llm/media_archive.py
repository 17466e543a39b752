"""Media columns: an archive of images in a shared folder and a Spark data source that reads it by byte ranges.

A payload is stored as an 8-bit grey PNG of 64 samples a row, uncut; its true length stands in a ``tEXt`` chunk.
Members are stored in zip archives, whose central directory gives their offsets. The data source plans ranges of
bytes over the archives of a folder; a range owns the members whose entries start in it. Batches leave as Arrow; a
member that can't be read is tried again by its own offset and, if that keeps failing, comes as a row with an error.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidegraph.llm.workspace import Workspace

ROW = 64
MAGIC = b"\x89PNG\r\n\x1a\n"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
SCHEMA_DDL = "doc_id long, archive string, offset long, media binary, error string"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(data: bytes, level: int = 4) -> bytes:
    """A PNG of the bytes, padded with zeros to a positive multiple of ``ROW``."""
    size = max(ROW, -(-len(data) // ROW) * ROW)
    grid = np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, ROW)
    lines = np.concatenate([np.zeros((len(grid), 1), np.uint8), grid], 1)  # each line starts with filter 0
    head = struct.pack(">IIBBBBB", ROW, len(grid), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"bytes\0%d" % len(data)) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> tuple[bytes, int]:
    """The samples of a PNG written by ``to_image``, with padding, and the number of bytes before padding."""
    if image[:8] != MAGIC:
        raise ValueError("no PNG")
    at, data, size, n = 8, [], (0, 0), -1
    while at < len(image):
        (length,) = struct.unpack_from(">I", image, at)
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        if zlib.crc32(image[at + 4 : at + 8 + length]) != struct.unpack_from(">I", image, at + 8 + length)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + length
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    return lines[:, 1:].tobytes(), n


def write_archives(docs: DataFrame, folder: str, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes the texts of ``docs(doc_id, text)`` as images into zip archives under ``folder``; one row per archive: name, members, bytes.

    Each attempt of a task writes files of its own; only those in the returned rows count.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        buffer, members = io.BytesIO(), 0
        archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        def flush() -> None:
            nonlocal buffer, members, archive
            archive.close()
            if members:
                name = f"{uuid.uuid4().hex}.zip"
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write(buffer.getbuffer())
                done.append((name, members, buffer.tell()))
            buffer, members = io.BytesIO(), 0
            archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_STORED)

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                name = f"{members}-{'' if doc.as_py() is None else doc.as_py()}.png"
                archive.writestr(zipfile.ZipInfo(name), to_image((text.as_py() or "").encode()))
                members += 1
                if buffer.tell() >= archive_bytes:
                    flush()
        flush()
        yield pa.RecordBatch.from_pydict({"name": [x[0] for x in done], "members": [x[1] for x in done], "bytes": [x[2] for x in done]}, pa.schema([("name", pa.string()), ("members", pa.int64()), ("bytes", pa.int64())]))

    return docs.select("doc_id", "text").mapInArrow(write, "name string, members long, bytes long")


@dataclass
class ByteRange(InputPartition):
    archive: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.manifest = options.get("manifest")
        self.range_bytes = int(options.get("rangebytes", 8 << 20))
        self.batch_bytes = int(options.get("batchbytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[InputPartition]:
        """Ranges of ``rangeBytes`` over the archives that the manifest lists, or over all of the folder."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        if self.manifest:
            import pyarrow.parquet as pq

            mfs, mroot = pafs.FileSystem.from_uri(self.manifest)
            found = pq.read_table(mroot, filesystem=mfs, columns=["name", "bytes"]).to_pylist()
            sizes = sorted((x["name"], x["bytes"]) for x in found)
        else:
            infos = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
            sizes = sorted((x.base_name, x.size) for x in infos if x.extension == "zip")
        return [ByteRange(name, lo, min(lo + self.range_bytes, size)) for name, size in sizes for lo in range(0, size, self.range_bytes)]

    def _member(self, path: str, offset: int, size: int, crc: int) -> bytes:
        """A member's data by its own offset: the local header tells where the data starts."""
        fs, root = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_file(f"{root}/{path}") as file:
            head = file.read_at(30, offset)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("no member starts here")
            skip = 30 + sum(struct.unpack_from("<HH", head, 26))
            data = file.read_at(size, offset + skip)
        if zlib.crc32(data) != crc:
            raise ValueError("checksum differs")
        return data

    def _retried(self, path: str, offset: int, size: int, crc: int) -> tuple[bytes | None, str | None]:
        error = None
        for k in range(self.tries):
            time.sleep(0.05 * (4**k - 1))
            try:
                return self._member(path, offset, size, crc), None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error

    def read(self, partition: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where nothing is planned
            return
        fs, root = pafs.FileSystem.from_uri(self.folder)
        rows: list[tuple] = []
        size = 0
        with fs.open_input_file(f"{root}/{partition.archive}") as file, zipfile.ZipFile(file) as archive:
            for info in archive.infolist():
                if not partition.start <= info.header_offset < partition.end:
                    continue
                doc = info.filename.split("-", 1)[1].removesuffix(".png")
                try:
                    data, error = archive.read(info), None
                except (OSError, ValueError, zipfile.BadZipFile):
                    data, error = self._retried(partition.archive, info.header_offset, info.compress_size, info.CRC)
                rows.append((int(doc) if doc else None, partition.archive, info.header_offset, data, error))
                size += info.compress_size
                if size >= self.batch_bytes:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


class ArchiveSource(DataSource):
    """``spark.read.format("image_archive").load(folder)``; options ``manifest``, ``rangeBytes``, ``batchBytes``, ``tries``."""

    @classmethod
    def name(cls) -> str:
        return "image_archive"

    def schema(self) -> str:
        return SCHEMA_DDL

    def reader(self, schema) -> DataSourceReader:
        return ArchiveReader(dict(self.options))


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("image_archive").options(**options).load(folder)


def image_feature(samples: bytes) -> str:
    """Rows, lowest and highest sample, mean, deviation and entropy of the samples."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, at = counts.sum(), np.arange(256)
    mean = float(counts @ at / n)
    deviation = float(np.sqrt(max(0.0, counts @ (at * at) / n - mean * mean)))
    p = counts[counts > 0] / n
    seen = np.flatnonzero(counts)
    return f"rows={n // ROW};min={seen[0]};max={seen[-1]};mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f}"


def media_features(media: DataFrame, strict: bool = False) -> DataFrame:
    """Checks and features of stored images: ``doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature``.

    All but doc_id are null for a member that couldn't be read; with ``strict`` it fails the query. Equal media give
    equal values, repeated rows stay.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, (doc, image) in enumerate(zip(batch["doc_id"].to_pylist(), batch["media"], strict=True)):
                image = image.as_py()
                if image is None:
                    if strict:
                        raise RuntimeError(f"{batch['archive'][k]} at {batch['offset'][k]}: {batch['error'][k]}")
                    rows.append((doc, *[None] * 7))
                    continue
                payload, n = from_image(image)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest(), image_feature(payload)))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return media.select("doc_id", "media", "archive", "offset", "error").mapInArrow(look, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def archive_and_inspect(docs: DataFrame) -> DataFrame:
    """Stores every text of ``docs(doc_id, text)``, reads the archives back and returns ``media_features``.

    A null or empty text is stored as 64 bytes 0; texts are stored whole. Rows that repeat a doc_id, or have none, are
    members of their own; an empty table gives no row. Only the two columns are read. A member that can't be read back fails the query.
    """
    space = Workspace(docs.sparkSession, "media")
    folder = space.path("archives")
    space.keep(write_archives(docs, folder), "manifest")
    return media_features(read_archives(docs.sparkSession, folder, manifest=space.path("manifest")), strict=True)
