"""Text dumps that are cut into many byte ranges, and the carry over chunks of lines."""

import random

import pytest
from pyspark.sql import functions as F

from voxmill.functions import carry
from voxmill.sources import dumps


@pytest.fixture()
def small_ranges(spark, monkeypatch):
    """Byte ranges of 64 kB and chunks of 500 lines."""
    names = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "1k"}
    held = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    monkeypatch.setattr(carry, "CHUNK", 500)
    yield
    for k, v in held.items():
        spark.conf.set(k, v)


def test_carry_is_a_running_window(spark):
    draw = random.Random(2)
    rows = [(p, n, draw.choice([None, 1, 2, -1]), draw.choice([None, None, None, f"{p}{n}"])) for p in ("a", "b", "c") for n in range(1, 400 if p == "a" else 30)]
    table = spark.createDataFrame(rows, "path string, n long, v int, s string").repartition(7)
    made = carry.carried(table, ["path"], "n", {"total": F.col("v")}, {"latest": F.col("s")}, chunk=16)
    got = {(r.path, r.n): (r.total, r.latest) for r in made.collect()}
    total, latest, want = {}, {}, {}
    for p, n, v, s in rows:
        total[p], latest[p] = total.get(p, 0) + (v or 0), s or latest.get(p)
        want[p, n] = (total[p], latest[p])
    assert got == want
    assert carry.carried(table.limit(0), ["path"], "n", {"total": F.col("v")}).count() == 0


def test_lines_are_numbered_over_ranges(spark, small_ranges, tmp_path):
    draw = random.Random(1)
    want = {}
    for name, end, n in (("long.txt", "\n", 9000), ("dos.txt", "\r\n", 4000), ("short.txt", "\n", 3), ("empty.txt", "\n", 0)):
        body = [f"{k} " + "x" * draw.randint(0, 60) if k % 11 else "" for k in range(n)]
        (tmp_path / name).write_bytes(end.join([*body, ""]).encode() if n else b"")
        want |= {(name, k): line for k, line in enumerate(body, 1)}
    read = dumps.lines(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.n): r.line for r in read.collect()}
    assert got == want
    assert spark.read.text(str(tmp_path / "long.txt")).rdd.getNumPartitions() > 4


def test_one_large_file_of_each_kind(spark, small_ranges, tmp_path):
    n = 20_000
    flow = ["ITEM: TIMESTEP", "7", "ITEM: NUMBER OF CELLS", str(n), "ITEM: BOX BOUNDS", "0 2", "0 1", "ITEM: CELLS id xlo ylo xhi yhi v", *(f"{k} 0 0 1 1 {k % 97}.5" for k in range(n)), "ITEM: TIMESTEP", "8", "ITEM: CELLS id xlo ylo xhi yhi v", "1 0 0 0 0 0"]
    (tmp_path / "flow.txt").write_text("\n".join(flow) + "\n")
    got = dumps.read_flow(spark, str(tmp_path / "flow.txt")).agg(F.count("*").alias("n"), F.sum("id").alias("id"), F.sum("v").alias("v"), F.min("timestep").alias("a"), F.max("timestep").alias("b")).first()
    assert (got.n, got.id, got.v, got.a, got.b) == (n, n * (n - 1) // 2, sum(k % 97 + 0.5 for k in range(n)), 7, 7)

    weights = ["weights"]
    for k in range(1, 6001):
        weights += [f"start {k} 2", f"  {k} 0.25", f"  {k + 1} 0.75", f"end {k} 2"]
    (tmp_path / "weights.txt").write_text("\n".join(weights))
    got = dumps.read_weights(spark, str(tmp_path / "weights.txt"))
    assert got.count() == 12_000 and got.where("frac <> if(oid = elem_id + 1, 0.25, 0.75)").count() == 0
    (tmp_path / "broken.txt").write_text("\n".join([*weights, "stray 1"]))
    with pytest.raises(dumps.DumpError):
        dumps.read_weights(spark, str(tmp_path / "broken.txt"))

    shape = ["surface", "", "9000 points", "9000 lines", "Points", "", *(f"{k} {k}.5 0" for k in range(1, 9001)), "", "Lines", "", *(f"{k} {k} {k % 9000 + 1}" for k in range(1, 9001))]
    (tmp_path / "shape.out.5.txt").write_text("\n".join(shape))
    points, elements = dumps.read_surface(spark, str(tmp_path / "shape.out.5.txt"))
    assert points.where("x = pid + 1.5 and timestep = 5").count() == elements.where("a = tid and b = (tid + 1) % 9000").count() == 9000

    solid = ["made", "", "ITEM: SOLID TIMESTEP", "12", "id,x,y,z,heat", *(f"{k},0,1,2,{k}.25" for k in range(n))]
    (tmp_path / "solid.csv").write_text("\n".join(solid))
    got = dumps.read_solid(spark, str(tmp_path / "solid.csv"))
    assert got.where("timestep = 12 and heat = id + 0.25").count() == n == got.count()

    reactions = [x for t in (1, 2) for x in ("ITEM: TIMESTEP", str(t), *"1234567", *(f"{n - k} {k * t}" for k in range(n)))]
    (tmp_path / "reactions.txt").write_text("\n".join(reactions))
    got = dumps.read_reactions(spark, str(tmp_path / "reactions.txt"), 2.0)
    assert got.count() == n and got.where(f"scalar <> 4 * ({n} - 1 - elem_id)").count() == 0

    volume = ["a", "b", *(f"{1 + k % 30} {1 + k // 30 % 30} {1 + k // 900} {k % 3}" for k in range(n))]
    (tmp_path / "volume.txt").write_text("\n".join(volume))
    assert dumps.read_volume(spark, str(tmp_path / "volume.txt")).where("value = (i + 30 * j + 900 * k) % 3").count() == n


def test_several_files_of_a_timestep(spark):
    outputs = spark.createDataFrame([("b_1.vtu", 1), ("a_1.vtu", 1), ("a_2.vtu", 2)], "path string, timestep int")
    with pytest.warns(UserWarning, match="2 outputs"):
        assert dumps.file_for_step(outputs, 1) == "a_1.vtu"
    assert dumps.file_for_step(outputs, 2) == "a_2.vtu"
    with pytest.raises(dumps.DumpError):
        dumps.file_for_step(outputs, 3)
