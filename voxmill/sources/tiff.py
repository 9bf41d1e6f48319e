"""Reader of uncompressed multi-page grey TIFF volumes, by strips: only the page directory is read to plan, and only strips in the box asked for are read at all."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Tags of the format, and the width and code of its whole-number field types.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 273, 278, 279
FIELDS = {1: (1, "B"), 3: (2, "H"), 4: (4, "I"), 16: (8, "Q")}
#: Bytes of strips in one task, and voxels in one batch, at most (or one strip, and one row).
TASK_BYTES, BATCH_VOXELS = 16 << 20, 1 << 20
SCHEMA = "path string, i int, j int, k int, value int"


@dataclass(frozen=True)
class Page:
    width: int
    height: int
    bits: int
    strip_rows: int
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


class Directory:
    """The pages of a file that ``at(offset, size)`` reads from, one after the other; files beyond 4 GB have wider fields."""

    def __init__(self, at):
        head = at(0, 16)
        self.at, self.order = at, {b"II": "<", b"MM": ">"}.get(head[:2])
        kind = self.order and struct.unpack_from(self.order + "H", head, 2)[0]
        if kind not in (42, 43):
            raise ValueError("not a TIFF file")
        self.wide = kind == 43
        self.first = struct.unpack_from(self.order + ("Q" if self.wide else "I"), head, 8 if self.wide else 4)[0]

    def pages(self, first: int = 0, last: int | None = None):
        """(number, Page) of the pages from ``first`` up to ``last``; of others only where the next one is."""
        count, entry, place = ("Q", "HHQQ", "Q") if self.wide else ("H", "HHII", "I")
        count, entry, place = (self.order + x for x in (count, entry, place))
        size, step, held = struct.calcsize(count), struct.calcsize(entry), struct.calcsize(place)
        where, k = self.first, 0
        while where and (last is None or k < last):
            n = struct.unpack(count, self.at(where, size))[0]
            body = self.at(where + size, n * step + held)
            if k >= first:
                yield k, self.page([(*struct.unpack_from(entry, body, m * step)[:3], body[(m + 1) * step - held : (m + 1) * step]) for m in range(n)], held)
            where, k = struct.unpack_from(place, body, n * step)[0], k + 1

    def page(self, entries, held: int) -> Page:
        tags = {}
        for tag, kind, n, value in entries:
            if kind in FIELDS and tag in (WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, STRIP_ROWS, STRIP_BYTES):
                width, code = FIELDS[kind]
                raw = value if n * width <= held else self.at(struct.unpack(self.order + ("Q" if held == 8 else "I"), value)[0], n * width)
                tags[tag] = struct.unpack_from(f"{self.order}{n}{code}", raw)
        bits = tags.get(BITS, (1,))[0]
        if tags.get(COMPRESSION, (1,))[0] != 1 or bits not in (8, 16):
            raise ValueError("only uncompressed 8- and 16-bit grey pages are read")
        height = tags[HEIGHT][0]
        return Page(tags[WIDTH][0], height, bits, min(tags.get(STRIP_ROWS, (height,))[0], height), tags[STRIPS], tags[STRIP_BYTES])


@dataclass
class Strips(InputPartition):
    """Strips of one file: (page, first row, rows, offset, bytes) each, of pages of one shape."""

    path: str
    width: int
    kind: str
    strips: tuple[tuple[int, int, int, int, int], ...]

    def __post_init__(self):
        InputPartition.__init__(self, None)


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; ValueError or OSError for one that pyarrow can't open."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


class TiffVoxels(DataSource):
    """``spark.read.format("tiff_voxels").load(path)``: every voxel of a file or a folder of ``.tif`` and ``.tiff`` files.

    Options: ``box``, [[lo, hi], ...] of i, j and k (hi left out, null for no limit); ``task_bytes``.
    """

    @classmethod
    def name(cls) -> str:
        return "tiff_voxels"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TiffReader(self.options)


class TiffReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.task_bytes = options["path"], int(options.get("task_bytes", TASK_BYTES))
        self.box = [(lo or 0, hi) for lo, hi in json.loads(options.get("box", "[[0, null], [0, null], [0, null]]"))]

    def partitions(self):
        fs, root = store(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [root] if info.is_file else sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.is_file and f.path.endswith((".tif", ".tiff")))
        out = []
        for path in files:
            with fs.open_input_file(path) as f:
                out += self.planned(path, lambda offset, size: f.read_at(size, offset))  # noqa: B023
        return out or [Strips("", 0, "<u1", ())]

    def planned(self, path: str, at) -> list[Strips]:
        """The strips that meet the box, in file order, in tasks of about ``task_bytes``."""
        out, held, size, shape = [], [], 0, None
        (_, _), (low, high), (first, last) = self.box
        directory = Directory(at)
        for k, page in directory.pages(first, last):
            now = (page.width, f"{directory.order}u{page.bits // 8}")
            for n, (offset, length) in enumerate(zip(page.offsets, page.sizes, strict=True)):
                row = n * page.strip_rows
                rows = min(page.strip_rows, page.height - row)
                if rows < 1 or row + rows <= low or (high is not None and row >= high):
                    continue
                if held and (shape != now or size + length > self.task_bytes):
                    out.append(Strips(path, *shape, tuple(held)))
                    held, size = [], 0
                shape, size = now, size + length
                held.append((k, row, rows, offset, length))
        return [*out, Strips(path, *shape, tuple(held))] if held else out

    def read(self, partition: Strips):
        (left, right), (low, high), _ = self.box
        if not partition.strips:
            return
        fs, _ = store(self.path)
        with fs.open_input_file(partition.path) as f:
            for k, row, rows, offset, length in partition.strips:
                raw = f.read_at(length, offset)
                values = np.frombuffer(raw, np.dtype(partition.kind), rows * partition.width).reshape(rows, partition.width)
                top, bottom = max(low - row, 0), rows if high is None else min(rows, high - row)
                yield from batches(partition.path, values[top:bottom, left:right], left, row + top, k)


def batches(path: str, values: np.ndarray, left: int, row: int, k: int):
    """Rows of a part of a page whose corner is at (left, row)."""
    step = max(1, BATCH_VOXELS // max(1, values.shape[1]))
    for lo in range(0, len(values), step):
        part = values[lo : lo + step]
        if n := part.size:
            j, i = np.indices(part.shape, dtype=np.int32)
            columns = [pa.array([path], pa.string()).take(pa.array(np.zeros(n, np.int32))), pa.array(i.ravel() + np.int32(left)), pa.array(j.ravel() + np.int32(row + lo)), pa.array(np.full(n, k, np.int32)), pa.array(part.ravel().astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "i", "j", "k", "value"])


def _whole_files(spark: SparkSession, path: str, box) -> DataFrame:
    """For stores that only Spark opens: a file is one row, of 2 GB at most."""
    reader = TiffReader({"path": path, "box": json.dumps(box)})

    def decode(files):
        for batch in files:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                raw = memoryview(raw.as_buffer())
                (left, right), (low, high), _ = reader.box
                for task in reader.planned(name, lambda offset, size: bytes(raw[offset : offset + size])):  # noqa: B023
                    for k, row, rows, offset, length in task.strips:
                        values = np.frombuffer(raw[offset : offset + length], np.dtype(task.kind), rows * task.width).reshape(rows, task.width)
                        top, bottom = max(low - row, 0), rows if high is None else min(rows, high - row)
                        yield from batches(name, values[top:bottom, left:right], left, row + top, k)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, SCHEMA)


def read_tiff(spark: SparkSession, path: str, box: list | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``path, i, j, k, value`` of every voxel in ``box``: i along a row, j down a page, k over pages.

    ``box`` is [[lo, hi], ...] of i, j and k, hi left out, null for no limit. Pages and strips outside it are not read.
    """
    box = box or [[0, None]] * 3
    try:
        store(path)
    except (ValueError, OSError):
        return _whole_files(spark, path, box)
    spark.dataSource.register(TiffVoxels)
    return spark.read.format("tiff_voxels").option("box", json.dumps(box)).option("task_bytes", str(task_bytes)).load(path)
