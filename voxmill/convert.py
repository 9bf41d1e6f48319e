"""Conversion of solver dumps to VTK files and collections: ``python -m voxmill.convert config.toml``."""

from __future__ import annotations

import argparse
import logging
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as settings
from .sources import dumps, sinks

log = logging.getLogger("voxmill.convert")


def listing(spark: SparkSession, folder: str, stride: int) -> list[str]:
    """Paths of every stride-th file, in order; an error if the folder is missing."""
    return [r.path for r in dumps.list_files(spark, folder, stride).orderBy("nth").collect()]


def _each_step(rows: DataFrame, output_dir: str, solver: str, ending: str, text: Callable[[DataFrame], DataFrame]) -> list[int]:
    """One file for each timestep of a parsed table; gives the timesteps."""
    os.makedirs(output_dir, exist_ok=True)
    steps = sorted(r.timestep for r in rows.select("timestep").distinct().collect() if r.timestep is not None)
    for t in steps:
        parts = os.path.join(output_dir, f".{solver}_{t}")
        sinks.save(text(rows.where(F.col("timestep") == t)), parts)
        sinks.merged(parts, os.path.join(output_dir, f"{solver}_{t}.{ending}"))
        log.info("wrote %s at %s", solver, t)
    return steps


def write_collection(output_dir: str, solver: str, ending: str, steps: list[int]) -> str:
    path = os.path.join(output_dir, f"{solver}.pvd")
    with open(path, "w") as f:
        f.write(sinks.collection([(t, f"{solver}_{t}.{ending}") for t in steps]))
    return path


def convert_flow(spark: SparkSession, c: settings.FlowConfig) -> list[int]:
    rows = dumps.read_flow(spark, listing(spark, c.input_dir, c.stride))
    flat = "zlo" not in rows.columns
    fields = [x for x in rows.columns if x not in ("path", "timestep", "n", *dumps.FLOW_COLUMNS)]

    def text(step: DataFrame) -> DataFrame:
        points, _ = dumps.boxes_to_points(step, flat=flat)
        return sinks.grid_lines(points, step, fields)

    steps = _each_step(rows, c.output_dir, "flow", "vtu", text)
    write_collection(c.output_dir, "flow", "vtu", steps)
    return steps


def convert_solid(spark: SparkSession, c: settings.SolidConfig) -> list[int]:
    rows = dumps.read_solid(spark, listing(spark, c.input_dir, c.stride))
    names = [x for x in rows.columns if x not in ("path", "timestep")]
    key, x, y, z = names[:4]
    half = c.voxel_size / 2

    def text(step: DataFrame) -> DataFrame:
        boxes = step.select(F.col(key).alias("id"), *(e.alias(f"{a}{n}") for a, v in zip("xyz", (x, y, z), strict=True) for n, e in (("lo", F.col(v) - half), ("hi", F.col(v) + half))))
        points, _ = dumps.boxes_to_points(boxes)
        return sinks.grid_lines(points, step.withColumnRenamed(key, "id"), names[4:], cell_type=sinks.VTK_HEXAHEDRON)

    steps = _each_step(rows, c.output_dir, "solid", "vtu", text)
    write_collection(c.output_dir, "solid", "vtu", steps)
    return steps


def convert_surface(spark: SparkSession, c: settings.SurfaceConfig) -> list[int]:
    """The n-th geometry file goes with the n-th data file; the data's timestep names the output."""
    geometry, data = listing(spark, c.geometry_dir, c.stride), listing(spark, c.data_dir, c.stride)
    if len(geometry) != len(data):
        log.warning("%d geometry files and %d data files: the shorter list counts", len(geometry), len(data))
    steps = []
    os.makedirs(c.output_dir, exist_ok=True)
    for shape, values in zip(geometry, data, strict=False):
        points, triangles = dumps.read_surface(spark, shape)
        rows = dumps.read_surface_data(spark, values)
        step = rows.first().timestep
        fields = [x for x in rows.columns if x not in ("path", "timestep", "n", "id")]
        own = rows.select((F.col("id") - 1).alias("sid"), *fields)
        joined, spare = dumps.attach(triangles.select("tid", "a", "b", "c"), own)
        if n := spare.count():
            log.warning("%d data rows of step %s have no element", n, step)
        parts = os.path.join(c.output_dir, f".surface_{step}")
        sinks.save(sinks.polydata_lines(points, joined, fields), parts)
        sinks.merged(parts, os.path.join(c.output_dir, f"surface_{step}.vtp"))
        steps.append(step)
    write_collection(c.output_dir, "surface", "vtp", sorted(steps))
    return sorted(steps)


CONVERTERS = {"flow": (convert_flow, "vtu"), "surface": (convert_surface, "vtp"), "solid": (convert_solid, "vtu")}


def postprocess(spark: SparkSession, c: settings.Config, done: dict[str, list[int]]) -> None:
    """Archives the outputs and lists the timesteps that all solvers share, as the settings ask."""
    if c.postprocess.plots:
        log.warning("plots are not made")
    folders = {name: getattr(c, name).output_dir for name in done}
    os.makedirs(c.postprocess.output_dir, exist_ok=True)
    if c.postprocess.archive:
        extra = [path for n, f in folders.items() if os.path.exists(path := os.path.join(f, f"{n}.pvd"))]
        sinks.archive(list(folders.values()), extra, os.path.join(c.postprocess.output_dir, "results.zip"))
    if c.postprocess.sync:
        steps = spark.createDataFrame([(n, t) for n, ts in done.items() for t in ts], "solver string, timestep int")
        common = sorted(r.timestep for r in dumps.common_steps(steps, list(done)).collect())
        pattern = {n: os.path.relpath(os.path.join(f, f"{n}_{{}}.{CONVERTERS[n][1]}"), c.postprocess.output_dir) for n, f in folders.items()}
        with open(os.path.join(c.postprocess.output_dir, "synced.pvd"), "w") as out:
            out.write(sinks.synced_collection(common, pattern))


def existing(spark: SparkSession, c: settings.Config) -> dict[str, list[int]]:
    """Timesteps of outputs that earlier runs left, by solver; a warning for a folder that is missing."""
    done = {}
    for name in CONVERTERS:
        if (section := getattr(c, name)) and os.path.isdir(section.output_dir):
            done[name] = sorted(r.timestep for r in dumps.output_steps(spark, section.output_dir, name).select("timestep").distinct().collect())
        elif section:
            log.warning("no folder %s", section.output_dir)
    return done


def run(spark: SparkSession, c: settings.Config, post: str = "ON") -> dict[str, list[int]]:
    """Converts every section, then archives and lists the timesteps all solvers share; ``post`` is ON, OFF, or ONLY to convert nothing."""
    done = existing(spark, c) if post == "ONLY" else {name: convert(spark, getattr(c, name)) for name, (convert, _) in CONVERTERS.items() if getattr(c, name)}
    if post != "OFF":
        postprocess(spark, c, done)
    return done


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("config", nargs="?", default="config.toml")
    parser.add_argument("--logging", default="INFO", choices=["DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"])
    parser.add_argument("--postprocessing", choices=["ON"], help="only post-process what earlier runs have converted")
    parser.add_argument("--no-postprocessing", action="store_true", help="only convert")
    given = parser.parse_args(argv)
    logging.basicConfig(level=given.logging)
    run(SparkSession.builder.appName("voxmill-convert").getOrCreate(), settings.load(given.config), "ONLY" if given.postprocessing else "OFF" if given.no_postprocessing else "ON")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
