"""Readers of text dumps: lines with their numbers, sections by running counts, rows by splitting.

Spark cuts files into byte ranges at line ends, so one large file is read by many
tasks. Line numbers come from the lines of each range, and what a line's meaning
depends on, the header above it, is carried from chunk to chunk of lines.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.carry import carried
from ..functions.numbering import ensure_checkpoints, numbered, ranked
from .tiff import read_tiff

FLOW_COLUMNS = ("id", "xlo", "ylo", "zlo", "xhi", "yhi", "zhi")
FLAT_FLOW_COLUMNS = ("id", "xlo", "ylo", "xhi", "yhi")


class DumpError(ValueError):
    """A file that lacks what its format needs."""


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path, n, line`` (n from 1) of text files; lines end at \\n, \\r\\n or \\r.

    The lines of a byte range follow each other in one partition, so a line's
    number is its place there, after the counts of the file's earlier ranges. They
    are checkpointed as read: another scan may be cut otherwise.
    """
    ensure_checkpoints(spark)
    where = F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("range")
    read = spark.read.text(path).select(*where, "value").withColumn("at", F.monotonically_increasing_id()).checkpoint()
    ranges = read.groupBy("path", "range").agg(F.min("at").alias("first"), F.count("*").alias("size"))
    earlier = F.coalesce(F.sum("size").over(Window.partitionBy("path").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("path", "range", (earlier + 1 - F.col("first")).alias("shift"))
    return read.join(ranges, ["path", "range"]).select("path", (F.col("at") + F.col("shift")).alias("n"), F.col("value").alias("line"))


def tokens(line: str | Column = "line") -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ")


def sections(rows: DataFrame) -> DataFrame:
    """Adds ``item``, the number of ITEM lines up to a line of its file, ``header``, the latest of them, and ``is_item``."""
    is_item = F.col("line").startswith("ITEM:")
    return carried(rows, ["path"], "n", {"item": is_item.cast("int")}, {"header": F.when(is_item, F.col("line"))}).withColumn("is_item", is_item)


def _first_blocks(rows: DataFrame) -> DataFrame:
    """The first section of each kind in each file: what follows a repeated header is left out."""
    kind = F.element_at(tokens(F.regexp_replace("header", r"^ITEM:\s*", "")), 1)
    kind = F.when(kind == "NUMBER", F.lit("NUMBER")).when(kind == "BOX", F.lit("BOX")).otherwise(kind)
    named = rows.where("header is not null").withColumn("kind", kind)
    first = named.where("is_item").groupBy("path", "kind").agg(F.min("item").alias("item"))  # a few rows a file
    return named.join(first, ["path", "kind", "item"], "left_semi")


def _fields(rows: DataFrame, kind: str) -> list[str]:
    """Column names in the header of a kind of section; all files must agree."""
    found = [r[0] for r in rows.where(F.col("is_item") & (F.col("kind") == kind)).select(F.trim("line")).distinct().limit(2).collect()]
    if not found:
        raise DumpError(f"no section ITEM: {kind}")
    if len(found) > 1:
        raise DumpError(f"files differ in their columns: {found}")
    return found[0].split()[2:]


def _dump(listing: DataFrame, kind: str) -> tuple[DataFrame, list[str]]:
    rows = _first_blocks(sections(listing))
    names = _fields(rows, kind)
    step = rows.where("kind = 'TIMESTEP' and not is_item and trim(line) <> ''").groupBy("path").agg(F.min_by(F.expr("try_cast(trim(line) as int)"), "n").alias("timestep"))
    body = rows.where((F.col("kind") == kind) & ~F.col("is_item") & (F.trim("line") != "")).withColumn("t", tokens())
    kept = body.join(step, "path").where(F.size("t") >= len(names))
    return kept.select("path", "timestep", "n", *(_number(i, "long" if name == "id" else "float").alias(name) for i, name in enumerate(names))), names


def _number(at: int, to: str) -> Column:
    """The number at a place of a line's parts, null for what is none: a filter on it may be tried on headers too."""
    return F.get("t", F.lit(at)).try_cast(to)


def read_flow(spark: SparkSession, path) -> DataFrame:
    """Cells of flow dumps: path, timestep, n (line), and the dump's columns (float, id long). 2D dumps lack z columns."""
    return parse_flow(lines(spark, path))


def parse_flow(listing: DataFrame) -> DataFrame:
    """As ``read_flow``, of ``path, n, line``."""
    rows, names = _dump(listing, "CELLS")
    require(names, FLOW_COLUMNS if {"zlo", "zhi"} & set(names) else FLAT_FLOW_COLUMNS)
    return rows


def read_surface_data(spark: SparkSession, path) -> DataFrame:
    """Rows of surface dumps: path, timestep, n, id and fields."""
    return parse_surface_data(lines(spark, path))


def parse_surface_data(listing: DataFrame) -> DataFrame:
    """As ``read_surface_data``, of ``path, n, line``."""
    rows, names = _dump(listing, "SURFS")
    require(names, ("id",))
    return rows


def require(names, needed) -> None:
    missing = [c for c in needed if c not in set(names)]
    if missing:
        raise DumpError(f"missing columns: {', '.join(missing)}")


def read_surface(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """Points (path, timestep, pid, x, y[, z]) and elements (path, timestep, tid, a, b[, c]) of surface files; ids count from 0.

    The timestep is 0 for ``*.surf`` and else the third part of the name between dots.
    """
    return parse_surface(lines(spark, path))


def parse_surface(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``read_surface``, of ``path, n, line``."""
    rows = listing.withColumn("line", F.trim("line"))
    title = F.when(F.col("line").isin("Points", "Triangles", "Lines"), F.col("line"))
    rows = carried(rows, ["path"], "n", lasts={"part": title}).where("part is not null and line <> '' and line <> part").withColumn("t", tokens())
    name = F.element_at(F.split("path", "/"), -1)
    step = F.when(name.endswith(".surf"), F.lit(0)).otherwise(F.expr("try_cast(element_at(split(element_at(split(path, '/'), -1), '[.]'), 3) as int)")).alias("timestep")
    points = rows.where("part = 'Points'").select("path", step, (_number(0, "long") - 1).alias("pid"), *(_number(i + 1, "double").alias(c) for i, c in enumerate("xyz")))
    elements = rows.where("part <> 'Points'").select("path", step, (_number(0, "long") - 1).alias("tid"), *((_number(i + 1, "long") - 1).alias(c) for i, c in enumerate("abc")))
    return points, elements


def read_weights(spark: SparkSession, path) -> DataFrame:
    """``elem_id, oid, frac`` of weight files (elem_id from 0). DumpError for a line outside a block or a voxel twice in an element."""
    return parse_weights(lines(spark, path))


def parse_weights(listing: DataFrame) -> DataFrame:
    """As ``read_weights``, of ``path, n, line``."""
    rows = listing.where("n > 1 and trim(line) <> ''").withColumn("t", tokens())
    starts, ends = F.col("t")[0] == "start", F.col("t")[0] == "end"
    rows = carried(rows, ["path"], "n", {"open": F.when(starts, 1).when(ends, -1).otherwise(0)}, {"elem_id": F.when(starts, _number(1, "long") - 1)})
    body = rows.where(~starts & ~ends)
    if not body.where("open <> 1 or size(t) <> 2").isEmpty():
        raise DumpError("a line stands outside the element blocks")
    out = body.select("elem_id", _number(0, "long").alias("oid"), _number(1, "double").alias("frac"))
    if not out.groupBy("elem_id", "oid").count().where("count > 1").isEmpty():
        raise DumpError("a voxel stands twice in an element")
    return out


def read_solid(spark: SparkSession, path) -> DataFrame:
    """Rows of solid CSV files: path, timestep, id, x, y, z and fields (float)."""
    return parse_solid(lines(spark, path))


def parse_solid(listing: DataFrame) -> DataFrame:
    """As ``read_solid``, of ``path, n, line``."""
    rows = carried(listing.where("trim(line) <> ''"), ["path"], "n", {"seen": F.lit(1)})
    mark = rows.where(F.trim("line") == "ITEM: SOLID TIMESTEP").groupBy("path").agg(F.min("seen").alias("at"))
    if not rows.select("path").distinct().join(mark, "path", "left_anti").isEmpty():
        raise DumpError("no line ITEM: SOLID TIMESTEP")
    placed = rows.join(mark, "path").withColumn("nth", F.col("seen") - F.col("at")).where("nth > 0")
    heads = [r[0] for r in placed.where("nth = 2").select(F.trim("line")).distinct().limit(2).collect()]
    if len(heads) != 1:
        raise DumpError("no column names" if not heads else "files differ in their columns")
    names = [c.strip() for c in heads[0].split(",")]
    if len(names) < 4:
        raise DumpError("fewer than four columns")
    step = placed.where("nth = 1").select("path", F.trim("line").try_cast("int").alias("timestep"))
    body = placed.where("nth > 2")
    if not step.join(body, "path", "left_anti").isEmpty():
        raise DumpError("no data rows")
    return body.join(step, "path").withColumn("t", F.transform(F.split("line", ","), lambda x: F.trim(x))).select("path", "timestep", *(_number(i, "float").alias(c) for i, c in enumerate(names)))


def second_block(rows: DataFrame, header_lines: int = 9) -> DataFrame:
    """Lines of the second TIMESTEP block after its header, of ``path, n, line``."""
    starts = F.trim("line") == "ITEM: TIMESTEP"
    marked = carried(rows, ["path"], "n", {"block": starts.cast("int")}, {"start": F.when(starts, F.col("n"))})
    return marked.where((F.col("block") == 2) & (F.col("n") - F.col("start") >= header_lines) & (F.trim("line") != "")).select("path", "n", "line")


def read_reactions(spark: SparkSession, path, scale: float = 1.0) -> DataFrame:
    """``path, elem_id, scalar``: the i-th row by id of the second block belongs to element i."""
    return parse_reactions(lines(spark, path), scale)


def parse_reactions(listing: DataFrame, scale: float = 1.0) -> DataFrame:
    """As ``read_reactions``, of ``path, n, line``."""
    rows = second_block(listing).withColumn("t", tokens()).select("path", _number(0, "long").alias("id"), (_number(1, "double") * scale).alias("scalar"))
    return ranked(rows, ["path"], ["id"], "elem_id", 0).select("path", "elem_id", "scalar")


def reaction_scale(fnum: float, coupling_time: float, avogadro: float, dt: float, molar_mass: float = 0.012) -> float:
    """Mass that one counted reaction removes in a coupling step."""
    return molar_mass * fnum * coupling_time / (avogadro * dt)


def read_volume(spark: SparkSession, path) -> DataFrame:
    """``i, j, k, value`` (from 0) of voxel volume text after two header lines; absent voxels are 0."""
    rows = lines(spark, path).where("n > 2 and trim(line) <> ''").withColumn("t", tokens())
    return rows.select(*((_number(a, "int") - 1).alias(x) for a, x in enumerate("ijk")), _number(3, "int").alias("value"))


def slice_volume(volume: DataFrame, x: int, y: int, z: int, half: int, height: int | None = None, keep: int = 1) -> DataFrame:
    """Voxels of one value in a box around (x, y) from z on, moved to start at 0."""
    inside = F.col("i").between(x - half, x + half - 1) & F.col("j").between(y - half, y + half - 1) & (F.col("k") >= z)
    if height is not None:
        inside = inside & (F.col("k") < z + height)
    return volume.where(inside & (F.col("value") == keep)).select((F.col("i") - (x - half)).alias("i"), (F.col("j") - (y - half)).alias("j"), (F.col("k") - z).alias("k"))


def sliced_voxels(spark: SparkSession, path: str, x: int, y: int, z: int, side: int, voxel_size: float, buffer: float = 5.0, height: int | None = None) -> tuple[DataFrame, list[list[float]]]:
    """``(oid, x, y, z)`` centres of a block of a volume file, and the limits of a grid about it: ``[lo, hi]``.

    The block has ``side`` voxels across, about (x, y), and ``height`` (``side``
    unless given) from z on. The first axis of the result is the one through the
    thickness, the last one the rows of a page; ``buffer`` is in voxels. TIFF by
    ``.tif`` or ``.tiff``, text by ``.txt`` or ``.dat``, whose first column is the
    thickness; ValueError for other names.
    """
    height = height or side
    if path.endswith((".tif", ".tiff")):
        half = side // 2
        volume = read_tiff(spark, path, [[max(0, x - half), x + half], [max(0, y - half), y + half], [z, z + height]])
    elif path.endswith((".txt", ".dat")):
        volume = read_volume(spark, path).select(F.col("k").alias("i"), "j", F.col("i").alias("k"), "value")
    else:
        raise ValueError(f"no volume format for {path}")
    block = slice_volume(volume, x, y, z, side // 2, height)
    oid = (F.col("i").cast("long") * side + F.col("j")) * height + F.col("k")
    rows = block.select(oid.alias("oid"), *((F.col(a) * voxel_size).alias(b) for a, b in zip("kji", "xyz", strict=True)))
    return rows, [[-buffer * voxel_size] * 3, [(n + buffer) * voxel_size for n in (height, side, side)]]


def label_phases(volume: DataFrame) -> DataFrame:
    return volume.withColumn("phase", F.when(F.col("value") == 0, "Matrix").otherwise("Fiber"))


def read_state(spark: SparkSession, path) -> DataFrame:
    return spark.read.csv(path, comment="#", schema="x double, y double, z double, removed double")


def list_files(spark: SparkSession, path: str, stride: int = 1, pattern: str = "*") -> DataFrame:
    """``path, nth``: every stride-th file of a folder by timestep in its name, then by name."""
    if stride < 1:
        raise ValueError("the stride must be positive")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    return every_nth(found, stride)


def every_nth(files: DataFrame, stride: int) -> DataFrame:
    step = F.expr("try_cast(regexp_extract(path, '([0-9]+)[^0-9/]*$', 1) as long)")
    placed = numbered(files.withColumn("__step", step), ["__step", "path"], "nth")
    return placed.where(F.col("nth") % stride == 0).withColumn("nth", F.col("nth").cast("int")).drop("__step")


def attach(elements: DataFrame, data: DataFrame, left: str = "tid", right: str = "sid") -> tuple[DataFrame, DataFrame]:
    """Elements with the data of their id (NaN where there is none), and the data rows that found no element."""
    fields = [f.name for f in data.schema if f.name != right and f.dataType.typeName() in ("float", "double")]
    renamed = data.withColumnRenamed(right, left)
    joined = elements.join(renamed, left, "left").withColumns({c: F.coalesce(c, F.lit(float("nan"))) for c in fields})
    return joined, renamed.join(elements.select(left), left, "left_anti")


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str, per: list[str] | None = None) -> DataFrame:
    """Pairs of the n-th rows of two listings (n from 1), of each group of ``per`` or of the whole; what has no partner is left out."""
    if not per:
        return numbered(a, [order_a], "nth", 1).join(numbered(b, [order_b], "nth", 1), "nth")
    nth = [F.row_number().over(Window.partitionBy(*per).orderBy(o)) for o in (order_a, order_b)]
    return a.withColumn("nth", nth[0]).join(b.withColumn("nth", nth[1]), [*per, "nth"])


def non_nan_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(~F.isnan(F.col(c))).alias(c) for c in fields))


def common_steps(steps: DataFrame, solvers: list[str]) -> DataFrame:
    """Timesteps that every one of ``solvers`` has, of ``solver, timestep``; none if a solver has none."""
    chosen = steps.where(F.col("solver").isin(*solvers))
    return chosen.groupBy("timestep").agg(F.count_distinct("solver").alias("n")).where(F.col("n") == len(set(solvers))).select("timestep")


def output_steps(spark: SparkSession, path: str, solver: str) -> DataFrame:
    """``path, timestep`` of outputs named <solver>_<timestep>.<ending>; other names are skipped."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"{solver}_*.*").load(path).select("path")
    return found.withColumn("timestep", F.expr(f"try_cast(regexp_extract(path, '/{solver}_([0-9]+)[.][^/]*$', 1) as int)")).where("timestep is not null")


def file_for_step(outputs: DataFrame, timestep: int) -> str:
    """The output file of a timestep, of ``path, timestep``: the first of several by name, with a warning; DumpError if there is none."""
    found = outputs.where(F.col("timestep") == timestep).agg(F.min("path").alias("path"), F.count("*").alias("n")).first()
    if not found.n:
        raise DumpError(f"no output for timestep {timestep}")
    if found.n > 1:
        warnings.warn(f"{found.n} outputs for timestep {timestep}; {found.path} is taken", stacklevel=2)
    return found.path


def boxes_to_points(boxes: DataFrame, key: str = "id", flat: bool = False) -> tuple[DataFrame, DataFrame]:
    """Corners (key, corner, x, y, z) and cells (key, points) of axis-parallel boxes.

    ``flat`` boxes have no z; they get the thickness of the larger mean side.
    """
    lo, hi = ("xlo", "ylo", "zlo"), ("xhi", "yhi", "zhi")
    if flat:
        sides = boxes.agg(F.avg(F.col("xhi") - F.col("xlo")).alias("dx"), F.avg(F.col("yhi") - F.col("ylo")).alias("dy"))
        boxes = boxes.crossJoin(sides).withColumns({"zlo": F.lit(0.0), "zhi": F.greatest("dx", "dy")})  # one row
    corner = F.explode(F.array(*(F.struct(F.lit(c).alias("corner"), *(F.col((hi if c >> a & 1 else lo)[a]).cast("double").alias(x) for a, x in enumerate("xyz"))) for c in range(8)))).alias("p")
    points = boxes.select(key, corner).select(key, "p.*")
    cells = boxes.select(key, F.array(*(F.lit(c) for c in range(8))).alias("points"))
    return points, cells
