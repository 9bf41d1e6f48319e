"""Lossless media columns: documents as PNG images in archives, read by a custom Spark data source.

A payload is a text's UTF-8 padded with bytes 0 to a multiple of 64; its image is
64 samples wide, 8-bit grey. Writers put images into ZIP archives (stored, not
deflated again) in the shared folder, one set per task under names that a rerun
of the task replaces. The data source plans byte ranges over the archives of a
directory; a reader finds the members that start in its range in the archive's
central directory, streams them as Arrow batches, and retries each member on its
own by seeking to its offset again.
"""

from __future__ import annotations

import hashlib
import struct
import time
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import shared_dir, written

WIDTH = 64
#: Fixed values of the PNG format.
PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
LENGTH_CHUNK = b"voLn"


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def to_png(text: bytes, level: int = 1) -> bytes:
    """An 8-bit grey image of the padded text; a private chunk holds the unpadded length."""
    rows = np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row starts with filter 0
    raw[:, 1:] = rows

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG_SIGNATURE + chunk(b"IHDR", head) + chunk(LENGTH_CHUNK, struct.pack(">Q", len(text))) + chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + chunk(b"IEND", b"")


def from_png(image: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of an image made by ``to_png``; ValueError on a damaged one."""
    if image[:8] != PNG_SIGNATURE:
        raise ValueError("not a PNG image")
    at, body, length, height = 8, [], 0, 0
    while at < len(image):
        size, kind = struct.unpack_from(">I4s", image, at)
        part = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", image, at + 8 + size)[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            height = struct.unpack_from(">II", part)[1]
        elif kind == LENGTH_CHUNK:
            length = struct.unpack(">Q", part)[0]
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, WIDTH + 1)
    return raw[:, 1:].tobytes(), length


def _open(path: str):
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_archives(docs: DataFrame, path: str, archive_bytes: int = 64 << 20) -> DataFrame:
    """Writes ``(doc_id, text)`` rows as archives under ``path``; ``(archive, members)`` rows of what was written.

    Null texts count as empty. Repeated rows and ids are members of their own.
    """

    def write(batches):
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        made, out, stream, name, temp, members, size = [], None, None, "", "", 0, 0

        def close():
            out.close()
            stream.close()
            fs.move(temp, name)  # a rerun replaces the archive whole
            made.append((name, members))

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                image = to_png((text or "").encode())
                if out is not None and size + len(image) > archive_bytes:
                    close()
                    out = None
                if out is None:
                    name = f"{root}/part-{part:06d}-{len(made):04d}.zip"
                    temp, members, size = f"{name}.{uuid.uuid4().hex}.tmp", 0, 0
                    stream = fs.open_output_stream(temp)
                    out = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                out.writestr(zipfile.ZipInfo(str(members) if doc is None else f"{members}:{doc}"), image)
                members, size = members + 1, size + len(image)
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64())], names=["archive", "members"])

    return written(docs.select("doc_id", "text").mapInArrow(write, "archive string, members long"), "manifest")


@dataclass
class ByteRange(InputPartition):
    archive: str
    first: int
    last: int


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(directory)``: name, offset and bytes of each archive member.

    Options: ``range_bytes`` (planned size of a partition), ``batch_bytes`` (of an
    Arrow batch), ``retries`` (attempts for each member before the task fails).
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "archive string, offset long, name string, media binary"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 32 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self):
        fs, root = _open(self.path)
        found = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if f.is_file and f.path.endswith(".zip"))
        return [ByteRange(p, at, min(size, at + self.range_bytes)) for p, size in found for at in range(0, size, self.range_bytes)] or [ByteRange("", 0, 0)]

    def open(self, archive: str):
        return _open(self.path)[0].open_input_file(archive)

    def member(self, archive: str, info: zipfile.ZipInfo, stream) -> bytes:
        """One member by its offset; ``stream`` is tried first, then a new one each time."""
        for attempt in range(self.retries):
            try:
                source = stream if attempt == 0 else self.open(archive)
                source.seek(info.header_offset)
                head = source.read(30)
                name, extra = struct.unpack("<HH", head[26:30])
                source.seek(info.header_offset + 30 + name + extra)
                media = source.read(info.compress_size)
                if head[:4] != b"PK\x03\x04" or len(media) != info.compress_size or zlib.crc32(media) != info.CRC:
                    raise OSError(f"damaged read of {info.filename} at {info.header_offset}")
                return media
            except (OSError, struct.error):
                if attempt + 1 == self.retries:
                    raise
                time.sleep(0.05 * 2**attempt)
        raise OSError("no attempt allowed")

    def read(self, partition: ByteRange):
        kinds = pa.schema({"archive": pa.string(), "offset": pa.int64(), "name": pa.string(), "media": pa.binary()})
        if not partition.archive:
            return
        with self.open(partition.archive) as stream:
            with zipfile.ZipFile(stream) as directory:
                members = [x for x in directory.infolist() if partition.first <= x.header_offset < partition.last]
            with self.open(partition.archive) as again:
                rows, size = [], 0
                for info in sorted(members, key=lambda x: x.header_offset):
                    media = self.member(partition.archive, info, again)
                    rows.append((partition.archive, info.header_offset, info.filename, media))
                    size += len(media)
                    if size >= self.batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds, strict=True)], schema=kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds, strict=True)], schema=kinds)


def read_archives(spark, path: str, **options) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**{k: str(v) for k, v in options.items()}).load(path)


def image_features(members: DataFrame) -> DataFrame:
    """Lengths, digests and features of stored images; the feature holds height, mean sample and a histogram of 16 levels."""

    def measure(batches):
        for batch in batches:
            rows = []
            for name, media in zip(batch.column("name").to_pylist(), batch.column("media").to_pylist(), strict=True):
                raw, length = from_png(media)
                sample = np.frombuffer(raw, np.uint8)
                level = np.bincount(sample >> 4, minlength=16)
                feature = f"{len(raw) // WIDTH}x{WIDTH} mean {int(sample.sum(dtype=np.int64)) / len(raw):.4f} levels {' '.join(map(str, level.tolist()))}"
                _, given, doc = name.partition(":")
                rows.append((doc if given else None, length, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return members.mapInArrow(measure, "doc_id string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_columns(docs: DataFrame, range_bytes: int = 32 << 20) -> DataFrame:
    """Stores the texts of ``docs`` and reads them back: one row per row of ``docs``, doc_id as it was.

    Null text: empty, a payload of 64 bytes 0. Equal texts have equal values. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_archives(docs, path)
    kind = docs.schema["doc_id"].dataType
    return image_features(read_archives(spark, path, range_bytes=range_bytes)).withColumn("doc_id", F.col("doc_id").cast(kind))
