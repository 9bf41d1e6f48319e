"""Readers and writers on small literal files, the converter, and the streaming extension."""

import zipfile

import pytest
from pyspark.sql import functions as F

from voxmill import config, convert
from voxmill.sources import dumps, sinks, tiff
from voxmill.streaming import windows

FLOW = """ITEM: TIMESTEP
{t}
ITEM: NUMBER OF CELLS
2
ITEM: BOX BOUNDS
0 2
0 1
0 1
ITEM: CELLS id xlo ylo zlo xhi yhi zhi f1 f2
1 0 0 0 1 1 1 0.5 7
2 1 0 0 2 1 1 1.5 8
ITEM: TIMESTEP
999
"""
SURFACE = """surface

3 points
1 triangles

Points

1 0 0 0
2 1 0 0
3 0 1 0

Triangles

1 1 2 3
"""
SURFS = """ITEM: TIMESTEP
{t}
ITEM: NUMBER OF SURFS
2
ITEM: BOX BOUNDS
0 1
0 1
0 1
ITEM: SURFS id p
1 2.5
9 4.5
"""
SOLID = "header\nITEM: SOLID TIMESTEP\n{t}\nid,x,y,z,heat\n0,0.5,0.5,0.5,3\n1,1.5,0.5,0.5,4\n"


@pytest.fixture()
def folders(tmp_path):
    for kind, name, text in (("flow", "flow.{t}.dat", FLOW), ("geometry", "shape.out.{t}.txt", SURFACE), ("data", "surf.{t}.dat", SURFS), ("solid", "solid_{t}.csv", SOLID)):
        (tmp_path / kind).mkdir()
        for t in (2, 10):
            (tmp_path / kind / name.format(t=t)).write_text(text.format(t=t))
    return tmp_path


def test_flow(spark, folders):
    rows = dumps.read_flow(spark, str(folders / "flow"))
    assert sorted((r.timestep, r.id, r.xhi, r.f2) for r in rows.collect()) == [(2, 1, 1.0, 7.0), (2, 2, 2.0, 8.0), (10, 1, 1.0, 7.0), (10, 2, 2.0, 8.0)]
    (folders / "flow" / "bad.dat").write_text("ITEM: TIMESTEP\n1\nITEM: CELLS id xlo\n1 2\n")
    with pytest.raises(dumps.DumpError):
        dumps.read_flow(spark, str(folders / "flow" / "bad.dat"))


def test_surface_and_attachment(spark, folders):
    points, triangles = dumps.read_surface(spark, str(folders / "geometry"))
    assert {r.timestep for r in points.collect()} == {2, 10} and points.count() == 6
    one = triangles.where("timestep = 2")
    assert [(r.tid, r.a, r.b, r.c) for r in one.collect()] == [(0, 0, 1, 2)]
    data = dumps.read_surface_data(spark, str(folders / "data" / "surf.2.dat")).select((F.col("id") - 1).alias("sid"), "p")
    joined, spare = dumps.attach(one.select("tid"), data)
    assert joined.first().p == 2.5 and [r.tid for r in spare.collect()] == [8]
    lonely, _ = dumps.attach(one.select((F.col("tid") + 5).alias("tid")), data)
    assert dumps.non_nan_counts(lonely, ["p"]).first().p == 0


def test_solid(spark, folders):
    assert {(r.timestep, r.id, r.heat) for r in dumps.read_solid(spark, str(folders / "solid")).collect()} == {(2, 0.0, 3.0), (2, 1.0, 4.0), (10, 0.0, 3.0), (10, 1.0, 4.0)}
    for text in ("no marker\n1,2\n", "ITEM: SOLID TIMESTEP\n1\nid,x,y\n1,2,3\n", "ITEM: SOLID TIMESTEP\n1\nid,x,y,z\n"):
        (folders / "bad.csv").write_text(text)
        with pytest.raises(dumps.DumpError):
            dumps.read_solid(spark, str(folders / "bad.csv"))


def test_listing(spark, folders):
    assert [r.path.rsplit("/", 1)[1] for r in dumps.list_files(spark, str(folders / "flow"), 2).collect()] == ["flow.2.dat"]
    with pytest.raises(ValueError):
        dumps.list_files(spark, str(folders / "flow"), 0)
    assert sorted(r.timestep for r in dumps.output_steps(spark, str(folders / "solid"), "solid").collect()) == [2, 10]


def test_reactions(spark, tmp_path):
    head = "ITEM: TIMESTEP\n{}\n" + "x\n" * 7
    (tmp_path / "r.dat").write_text(head.format(1) + "1 5\n" + head.format(2) + "7 30\n3 10\n")
    got = dumps.read_reactions(spark, str(tmp_path / "r.dat"), scale=2.0)
    assert sorted((r.elem_id, r.scalar) for r in got.collect()) == [(0, 20.0), (1, 60.0)]
    assert dumps.reaction_scale(2.0, 3.0, 6.0, 1.0) == pytest.approx(0.012)


def test_weights_round_trip(spark, tmp_path):
    elements = spark.createDataFrame([(0,), (1,), (2,)], "elem_id long")
    weights = spark.createDataFrame([(0, 4, 0.25), (0, 7, 0.75), (2, 1, 1.0)], "elem_id long, oid long, frac double")
    sinks.save(sinks.weight_lines(elements, weights), str(tmp_path / "w"))
    path = sinks.merged(str(tmp_path / "w"), str(tmp_path / "w.dat"))
    text = open(path).read().splitlines()
    assert text[:5] == ["3 total triangles", "start 1 2", "    4 0.25", "    7 0.75", "end 1 2"] and "start 2 0" in text
    assert sorted(map(tuple, dumps.read_weights(spark, path).collect())) == sorted(map(tuple, weights.collect()))
    (tmp_path / "bad.dat").write_text("1 total triangles\nstart 1 2\n 4 0.5\n 4 0.5\nend 1 2\n")
    with pytest.raises(dumps.DumpError):
        dumps.read_weights(spark, str(tmp_path / "bad.dat"))
    (tmp_path / "bad.dat").write_text("1 total triangles\nstart 1 1\n 4 0.5\nend 1 1\n 5 1\n")
    with pytest.raises(dumps.DumpError):
        dumps.read_weights(spark, str(tmp_path / "bad.dat"))


def test_surface_round_trip(spark, tmp_path):
    vertices = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 1.0, 0.0)], "vid long, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 1, 2)], "elem_id long, a long, b long, c long")
    sinks.save(sinks.surface_lines(vertices, faces), str(tmp_path / "s"))
    path = sinks.merged(str(tmp_path / "s"), str(tmp_path / "a.surf"))
    points, triangles = dumps.read_surface(spark, path)
    assert points.count() == 3 and [(r.timestep, r.a, r.b, r.c) for r in triangles.collect()] == [(0, 0, 1, 2)]
    flat = sinks.surface_lines(vertices.drop("z"), faces.drop("c"))
    assert flat.where("section = 4").first().line == "1 2 1"  # ends of lines are swapped
    shapes = spark.createDataFrame([(0,)], "elem_id long").select("elem_id", *(F.struct(F.lit(float(n)).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z")).alias(f"t{n}") for n in range(3)), *(F.lit(1.0).alias(f"n{x}") for x in "xyz"))
    assert "outer loop" in sinks.stl_lines(shapes).where("section = 1").first().line


def test_volume_and_phases(spark, tmp_path):
    (tmp_path / "v.dat").write_text("a\nb\n1 1 1 1\n2 1 1 0\n3 2 1 1\n")
    volume = dumps.read_volume(spark, str(tmp_path / "v.dat"))
    assert sorted((r.i, r.j, r.k, r.value) for r in volume.collect()) == [(0, 0, 0, 1), (1, 0, 0, 0), (2, 1, 0, 1)]
    assert dumps.slice_volume(volume, 1, 1, 0, 1).count() == 1
    assert {r.phase for r in dumps.label_phases(volume).collect()} == {"Matrix", "Fiber"}


def test_block_of_a_volume(spark, tmp_path):
    rows = [(a, b, c) for a in range(1, 7) for b in range(1, 6) for c in range(1, 5) if (a + b + c) % 2]
    (tmp_path / "v.dat").write_text("a\nb\n" + "\n".join(f"{a} {b} {c} 1" for a, b, c in rows) + "\n")
    got, limits = dumps.sliced_voxels(spark, str(tmp_path / "v.dat"), 2, 3, 1, 2, 0.5, 1.0, 3)
    want = {((a - 2) * 0.5, (b - 3) * 0.5, (c - 2) * 0.5) for a, b, c in rows if 2 <= a < 5 and 3 <= b < 5 and 2 <= c < 4}
    assert {(r.x, r.y, r.z) for r in got.collect()} == want and got.select("oid").distinct().count() == len(want)
    assert limits == [[-0.5] * 3, [2.0, 1.5, 1.5]]
    with pytest.raises(ValueError):
        dumps.sliced_voxels(spark, "v.png", 0, 0, 0, 2, 1.0)


def test_tiff(spark, tmp_path):
    import struct

    pages = [[[1, 0], [2, 3], [4, 5]], [[6, 7], [8, 9], [1, 1]]]
    raw, at = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        body = bytes(v for row in page for v in row)
        data, ifd = len(raw), len(raw) + len(body)
        raw += body
        struct.pack_into("<I", raw, at, ifd)
        tags = [(256, 2), (257, 3), (258, 8), (259, 1), (273, data), (279, len(body))]
        raw += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags)
        at = len(raw)
        raw += b"\0\0\0\0"
    (tmp_path / "v.tif").write_bytes(bytes(raw))
    got = {(r.i, r.j, r.k): r.value for r in tiff.read_tiff(spark, str(tmp_path / "v.tif")).collect()}
    assert got == {(i, j, k): v for k, p in enumerate(pages) for j, row in enumerate(p) for i, v in enumerate(row)}


def test_converter(spark, folders):
    (folders / "c.toml").write_text(
        f"""[flow]
input_dir = "{folders}/flow"
output_dir = "{folders}/out/flow"
[surface]
geometry_dir = "{folders}/geometry"
data_dir = "{folders}/data"
output_dir = "{folders}/out/surface"
[solid]
input_dir = "{folders}/solid"
output_dir = "{folders}/out/solid"
stride = 2
[postprocess]
archive = true
output_dir = "{folders}/out"
"""
    )
    done = convert.run(spark, config.load(folders / "c.toml"))
    assert done == {"flow": [2, 10], "surface": [2, 10], "solid": [2]}
    assert 'NumberOfCells="2"' in (folders / "out/flow/flow_2.vtu").read_text()
    synced = (folders / "out/synced.pvd").read_text()
    assert synced.count("DataSet") == 3 and 'group="flow" part="0" file="flow/flow_2.vtu"' in synced and "_10" not in synced
    (folders / "out/synced.pvd").unlink()
    (folders / "out/results.zip").unlink()
    (folders / "out/surface/surface_2.vtp").unlink()
    (folders / "out/flow/flow_notes.txt").write_text("not an output")
    with pytest.raises(ValueError):  # no timestep that all have
        convert.run(spark, config.load(folders / "c.toml"), "ONLY")
    (folders / "out/surface/surface_2.vtp").write_text("again")
    assert convert.run(spark, config.load(folders / "c.toml"), "ONLY") == {"flow": [2, 10], "surface": [2, 10], "solid": [2]}
    assert (folders / "out/synced.pvd").read_text() == synced
    with zipfile.ZipFile(folders / "out/results.zip") as z:
        assert "flow/flow_2.vtu" in z.namelist() and "flow.pvd" in z.namelist()
    with pytest.raises(ValueError):
        sinks.collection([])


def test_settings_by_their_older_names(tmp_path):
    (tmp_path / "c.toml").write_text('[flow]\nflow_dir = "a"\nflow_dt = 1e-9\nstep = 3\n[solid]\nsolid_dir = "b"\nsolid_dt = 1e-10\nvoxel_size = 1e-6\n[surface]\nsurf_data_dir = "c"\nsurf_geom_dir = "d"\nsurface_dt = 1e-9\nstep = 1\n[postprocess]\narchive = true\nsync_enabled = true\n')
    c = config.load(tmp_path / "c.toml")
    assert (c.flow.input_dir, c.flow.stride, c.flow.dt, c.flow.output_dir) == ("a", 3, 1e-9, "flow_output")
    assert (c.solid.input_dir, c.solid.voxel_size) == ("b", 1e-6) and (c.surface.data_dir, c.surface.geometry_dir) == ("c", "d")
    assert c.postprocess.archive and c.postprocess.sync
    (tmp_path / "c.toml").write_text('[flow]\nflow_dir = "a"\ninput_dir = "b"\n')
    with pytest.raises(config.ConfigError):
        config.load(tmp_path / "c.toml")


def test_config_errors(tmp_path):
    for text in ("", "[other]\na = 1\n", "[flow]\ninput_dir = 3\noutput_dir = 'x'\n", "[flow]\noutput_dir = 'x'\n", "[flow]\ninput_dir = 'x'\nflow_dt = -1.0\n", "[flow]\ninput_dir = 'x'\noutput_dir = 'y'\nstride = 0\n"):
        (tmp_path / "c.toml").write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(tmp_path / "c.toml")


def test_window_lattice_streams_as_it_batches(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    axes = {"i": "user_id % 16", "j": "hour(ts)"}
    batch = sorted(map(tuple, windows.window_lattice(events, axes, "1 day").collect()))
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.window_lattice(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), axes, "1 day")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("lattice").start()
    run.processAllAvailable()
    run.stop()
    assert sorted(map(tuple, spark.table("lattice").collect())) == batch


def test_arriving_files(spark, folders):
    seen = []
    run = windows.arriving_files(spark, str(folders / "flow"), lambda df, n: seen.extend(r.path for r in df.collect())).option("checkpointLocation", str(folders / "ck")).start()
    run.processAllAvailable()
    run.stop()
    assert len(seen) == 2
