"""Volumes by strips: what is planned, what is read, and files beyond 2 and 4 GB."""

import struct

import numpy as np
import pytest

from voxmill.sources import dumps, tiff


def write(path, pages, strip_rows, order="<", wide=False, gap=0):
    """A volume with strips; ``gap`` bytes that are never written lie before each page's samples."""
    place, width = ("Q", 8) if wide else ("I", 4)
    with open(path, "wb") as f:
        f.write((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if wide else struct.pack(order + "HI", 42, 0)))
        link = 8 if wide else 4
        for page in pages:
            f.seek(gap, 1)
            offsets, sizes = [], []
            for lo in range(0, len(page), strip_rows):
                offsets.append(f.tell())
                sizes.append(f.write(page[lo : lo + strip_rows].astype(page.dtype.newbyteorder(order)).tobytes()))
            lists = []
            for values in (offsets, sizes):
                lists.append(f.tell())
                f.write(struct.pack(f"{order}{len(values)}{place}", *values))
            here, kind = f.tell(), 16 if wide else 4
            tags = [(256, 3, 1, page.shape[1]), (257, 3, 1, page.shape[0]), (258, 3, 1, page.dtype.itemsize * 8), (259, 3, 1, 1), (278, 3, 1, strip_rows), (273, kind, len(offsets), lists[0] if len(offsets) > 1 else offsets[0]), (279, kind, len(sizes), lists[1] if len(sizes) > 1 else sizes[0])]
            f.write(struct.pack(order + ("Q" if wide else "H"), len(tags)))
            for tag, code, n, value in tags:
                held = struct.pack(order + ("H" if code == 3 else place), value).ljust(width, b"\0")
                f.write(struct.pack(order + ("HHQ" if wide else "HHI"), tag, code, n) + held)
            end = f.tell()
            f.write(b"\0" * width)
            f.seek(link)
            f.write(struct.pack(order + place, here))
            f.seek(end + width)
            link = end


def volume(dtype, shape=(5, 23, 11)):
    return [np.random.default_rng(k).integers(0, 200, shape[1:]).astype(dtype) * (250 if np.dtype(dtype).itemsize > 1 else 1) for k in range(shape[0])]


def cells(pages, box):
    (a, b), (c, d), (e, f) = ((lo, hi if hi is not None else 10**9) for lo, hi in box)
    return {(i, j, k, int(p[j, i])) for k, p in enumerate(pages) for j in range(p.shape[0]) for i in range(p.shape[1]) if a <= i < b and c <= j < d and e <= k < f}


@pytest.mark.parametrize("dtype,strip_rows,order,wide", [("u1", 4, "<", False), ("u2", 23, ">", False), ("u1", 1, ">", True), ("u2", 7, "<", True)])
def test_strips(spark, tmp_path, dtype, strip_rows, order, wide):
    pages, path = volume(dtype), str(tmp_path / "v.tif")
    write(path, pages, strip_rows, order, wide)
    for box in ([[0, None]] * 3, [[2, 9], [5, 13], [1, 4]], [[0, 3], [22, None], [4, 9]], [[20, 30], [0, None], [0, None]]):
        got = tiff.read_tiff(spark, path, box, task_bytes=60)
        assert {(r.i, r.j, r.k, r.value) for r in got.collect()} == cells(pages, box)
        whole = tiff._whole_files(spark, path, box)
        assert {(r.i, r.j, r.k, r.value) for r in whole.collect()} == cells(pages, box)
    assert tiff.read_tiff(spark, path, task_bytes=60).rdd.getNumPartitions() > 4


def test_only_what_the_box_needs_is_planned(tmp_path):
    path = str(tmp_path / "v.tif")
    write(path, volume("u1", (40, 64, 16)), 8)
    reader = tiff.TiffReader({"path": path, "box": "[[0, null], [16, 24], [10, 12]]"})
    assert [s[:3] for p in reader.partitions() for s in p.strips] == [(10, 16, 8), (11, 16, 8)]
    read = []

    def at(offset, size):
        read.append(size)
        with open(path, "rb") as f:
            f.seek(offset)
            return f.read(size)

    list(reader.planned(path, at))
    assert sum(read) < 12 * 200  # directories, and no samples


@pytest.mark.parametrize("wide,gap", [(False, 1_100_000_000), (True, 2_300_000_000)])
def test_files_beyond_two_and_four_gigabytes(spark, tmp_path, wide, gap):
    pages, path = volume("u1", (3, 9, 5)), tmp_path / "large.tif"
    write(path, pages, 3, "<", wide, gap)
    assert path.stat().st_size > (1 << 31) * (3 if wide else 1)
    got = tiff.read_tiff(spark, str(path), [[0, None], [2, 7], [1, 3]])
    assert {(r.i, r.j, r.k, r.value) for r in got.collect()} == cells(pages, [[0, None], [2, 7], [1, 3]])


def test_slices_and_errors(spark, tmp_path):
    pages, path = [(p % 2).astype("u1") for p in volume("u1", (6, 20, 20))], str(tmp_path / "v.tif")
    write(path, pages, 6)
    got, _ = dumps.sliced_voxels(spark, path, 8, 10, 1, 6, 1.0, height=3)
    want = {(float(k - 1), float(j - 7), float(i - 5)) for i, j, k, v in cells(pages, [[5, 11], [7, 13], [1, 4]]) if v == 1}
    assert {(r.x, r.y, r.z) for r in got.collect()} == want
    (tmp_path / "bad.tif").write_bytes(b"nothing here, of some length")
    with pytest.raises(Exception, match="not a TIFF file"):
        tiff.read_tiff(spark, str(tmp_path / "bad.tif")).count()
