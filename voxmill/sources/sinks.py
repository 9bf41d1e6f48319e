"""Writers of the text formats.

A file is a table of lines in order. ``save`` sorts it by range and writes ordered
part files in parallel; ``merged`` lays them end to end as one file, streaming.
"""

from __future__ import annotations

import json
import os
import shutil
import zipfile
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import numbered

#: Cell types of the VTK formats.
VTK_VOXEL, VTK_HEXAHEDRON = 11, 12


def _lines(df: DataFrame, section: int, order: Column, text: Column) -> DataFrame:
    return df.select(F.lit(section).alias("section"), order.cast("long").alias("at"), text.alias("line"))


def _literal(df: DataFrame, section: int, rows: list[str]) -> DataFrame:
    return df.sparkSession.createDataFrame([(section, n, r) for n, r in enumerate(rows)], "section int, at long, line string")


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surface_lines(vertices: DataFrame, elements: DataFrame, title: str = "surface") -> DataFrame:
    """Surface file: points and triangles, or lines with their ends swapped; ids from 1."""
    flat = "c" not in elements.columns
    counts = vertices.agg(F.count("*").alias("n")).crossJoin(elements.agg(F.count("*").alias("m")))  # one row each
    kind = "lines" if flat else "triangles"
    number = counts.select(F.lit(1).alias("section"), F.posexplode(F.array(F.concat("n", F.lit(" points")), F.concat("m", F.lit(f" {kind}")), F.lit(""), F.lit("Points"), F.lit(""))).alias("at", "line")).withColumn("at", F.col("at").cast("long"))
    point = F.concat_ws(" ", F.col("vid") + 1, *(c for c in ("x", "y", "z") if c in vertices.columns))
    ends = ["b", "a"] if flat else ["a", "b", "c"]
    element = F.concat_ws(" ", F.col("elem_id") + 1, *(F.col(c) + 1 for c in ends))
    return union([_literal(vertices, 0, [title, ""]), number, _lines(vertices, 2, F.col("vid"), point), _literal(vertices, 3, ["", kind.capitalize(), ""]), _lines(elements, 4, F.col("elem_id"), element)])


def weight_lines(elements: DataFrame, weights: DataFrame, kind: str = "triangles") -> DataFrame:
    """Weight file: a block for each element, empty where it has no voxel."""
    count = elements.agg(F.concat(F.count("*"), F.lit(f" total {kind}")).alias("line")).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("within"), "line")
    own = weights.groupBy("elem_id").agg(F.count("*").alias("n"))
    sizes = elements.select("elem_id").join(own, "elem_id", "left").select("elem_id", F.coalesce("n", F.lit(0)).alias("n"))
    def mark(word, at):
        return sizes.select(F.lit(1).alias("section"), F.col("elem_id").alias("at"), F.lit(at).cast("long").alias("within"), F.concat_ws(" ", F.lit(word), F.col("elem_id") + 1, "n").alias("line"))
    rows = weights.select(F.lit(1).alias("section"), F.col("elem_id").alias("at"), F.col("oid").alias("within"), F.concat_ws(" ", F.lit("   "), "oid", "frac").alias("line"))
    return union([count, mark("start", -1), rows, mark("end", 1 << 62)])


def stl_lines(triangles: DataFrame, name: str = "surface") -> DataFrame:
    """ASCII STL of elem_id, t0, t1, t2 and a normal."""
    corner = [F.concat_ws(" ", F.lit("      vertex"), f"t{n}.x", f"t{n}.y", f"t{n}.z") for n in range(3)]
    normal = F.concat_ws(" ", F.lit("  facet normal"), *(F.coalesce(f"n{x}", F.lit(0.0)) for x in "xyz"))
    body = F.concat_ws("\n", normal, F.lit("    outer loop"), *corner, F.lit("    endloop"), F.lit("  endfacet"))
    return union([_literal(triangles, 0, [f"solid {name}"]), _lines(triangles, 1, F.col("elem_id"), body), _literal(triangles, 2, [f"endsolid {name}"])])


def grid_lines(points: DataFrame, cells: DataFrame, fields: list[str], key: str = "id", cell_type: int = VTK_VOXEL) -> DataFrame:
    """ASCII VTK unstructured grid of boxes: points has key, corner, x, y, z; cells has key and the fields."""
    placed = numbered(cells, [key], "nth")
    at = points.join(placed.select(key, "nth"), key)
    ring = [0, 1, 2, 3, 4, 5, 6, 7] if cell_type == VTK_VOXEL else [0, 1, 3, 2, 4, 5, 7, 6]
    n = cells.count()
    parts = [_literal(cells, 0, ['<?xml version="1.0"?>', '<VTKFile type="UnstructuredGrid" version="0.1">', "<UnstructuredGrid>", f'<Piece NumberOfPoints="{8 * n}" NumberOfCells="{n}">', '<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">'])]
    parts.append(_lines(at, 1, F.col("nth") * 8 + F.col("corner"), F.concat_ws(" ", "x", "y", "z")))
    parts.append(_literal(cells, 2, ["</DataArray></Points>", '<Cells><DataArray type="Int64" Name="connectivity" format="ascii">']))
    parts.append(_lines(placed, 3, F.col("nth"), F.concat_ws(" ", *(F.col("nth") * 8 + c for c in ring))))
    parts.append(_literal(cells, 4, ["</DataArray>", '<DataArray type="Int64" Name="offsets" format="ascii">']))
    parts.append(_lines(placed, 5, F.col("nth"), (F.col("nth") * 8 + 8).cast("string")))
    parts.append(_literal(cells, 6, ["</DataArray>", '<DataArray type="UInt8" Name="types" format="ascii">']))
    parts.append(_lines(placed, 7, F.col("nth"), F.lit(str(cell_type))))
    parts.append(_literal(cells, 8, ["</DataArray></Cells>", "<CellData>"]))
    section = 9
    for f in fields:
        parts.append(_literal(cells, section, [f'<DataArray type="Float64" Name={quoteattr(f)} format="ascii">']))
        parts.append(_lines(placed, section + 1, F.col("nth"), F.col(f).cast("double").cast("string")))
        parts.append(_literal(cells, section + 2, ["</DataArray>"]))
        section += 3
    parts.append(_literal(cells, section, ["</CellData>", "</Piece>", "</UnstructuredGrid>", "</VTKFile>"]))
    return union(parts)


def polydata_lines(points: DataFrame, triangles: DataFrame, fields: list[str]) -> DataFrame:
    """ASCII VTK polydata: points has pid, x, y, z; triangles has tid, a, b, c and the fields."""
    n, m = points.count(), triangles.count()
    parts = [_literal(points, 0, ['<?xml version="1.0"?>', '<VTKFile type="PolyData" version="0.1">', "<PolyData>", f'<Piece NumberOfPoints="{n}" NumberOfPolys="{m}">', '<Points><DataArray type="Float64" NumberOfComponents="3" format="ascii">'])]
    parts.append(_lines(points, 1, F.col("pid"), F.concat_ws(" ", "x", "y", "z")))
    parts.append(_literal(points, 2, ["</DataArray></Points>", '<Polys><DataArray type="Int64" Name="connectivity" format="ascii">']))
    parts.append(_lines(triangles, 3, F.col("tid"), F.concat_ws(" ", "a", "b", "c")))
    parts.append(_literal(points, 4, ["</DataArray>", '<DataArray type="Int64" Name="offsets" format="ascii">']))
    parts.append(_lines(triangles, 5, F.col("tid"), ((F.col("tid") + 1) * 3).cast("string")))
    parts.append(_literal(points, 6, ["</DataArray></Polys>", "<CellData>"]))
    section = 7
    for f in fields:
        parts.append(_literal(points, section, [f'<DataArray type="Float64" Name={quoteattr(f)} format="ascii">']))
        parts.append(_lines(triangles, section + 1, F.col("tid"), F.col(f).cast("double").cast("string")))
        parts.append(_literal(points, section + 2, ["</DataArray>"]))
        section += 3
    parts.append(_literal(points, section, ["</CellData>", "</Piece>", "</PolyData>", "</VTKFile>"]))
    return union(parts)


def save(rows: DataFrame, folder: str) -> None:
    """Ordered part files of lines; an earlier result is replaced only by a complete one (Spark's committer)."""
    order = [c for c in ("section", "at", "within") if c in rows.columns]
    rows.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(folder)


def merged(folder: str, target: str) -> str:
    """One file from the part files of a local folder."""
    temp = f"{target}.tmp"
    with open(temp, "wb") as out:
        for part in sorted(f for f in os.listdir(folder) if f.startswith("part-")):
            with open(os.path.join(folder, part), "rb") as source:
                shutil.copyfileobj(source, out)
    os.replace(temp, target)
    return target


def write_state(state: DataFrame, folder: str) -> None:
    state.select("x", "y", "z", "removed").write.mode("overwrite").csv(folder)


def write_volume_fraction(fractions: DataFrame, cells: int, folder: str) -> None:
    """One number: the filled share of a grid of ``cells`` cells, from node fractions."""
    fractions.agg((F.coalesce(F.sum("frac"), F.lit(0.0)) / cells).cast("string").alias("value")).write.mode("overwrite").text(folder)


def write_phases(state: DataFrame, folder: str) -> None:
    state.select(F.to_json(F.struct("oid", "phase")).alias("value")).write.mode("overwrite").text(folder)


def collection(steps: list[tuple[int, str]] | list[tuple[int, str, str]]) -> str:
    """PVD text for (timestep, file) or (timestep, group, file) in order of time; ValueError if there are none."""
    if not steps:
        raise ValueError("no timestep to list")
    rows = [f'    <DataSet timestep={quoteattr(str(t))} group={quoteattr(group[0] if group else "")} part="0" file={quoteattr(f)}/>' for t, *group, f in sorted(steps)]
    return "\n".join(['<?xml version="1.0"?>', '<VTKFile type="Collection" version="0.1">', "  <Collection>", *rows, "  </Collection>", "</VTKFile>", ""])


def synced_collection(common: list[int], solvers: dict[str, str]) -> str:
    """PVD text of every common timestep and solver, grouped by solver; ``solvers`` maps a name to its file pattern with ``{}`` for the timestep."""
    return collection([(t, name, pattern.format(t)) for t in common for name, pattern in sorted(solvers.items())])


def archive(folders: list[str], extra: list[str], target: str) -> str:
    """A stored ZIP of folders, under their names, and of files at the top level."""
    with zipfile.ZipFile(f"{target}.tmp", "w", zipfile.ZIP_STORED) as out:
        for folder in folders:
            for base, _, names in sorted(os.walk(folder)):
                for name in sorted(names):
                    path = os.path.join(base, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(os.path.abspath(folder))))
        for path in extra:
            out.write(path, os.path.basename(path))
    os.replace(f"{target}.tmp", target)
    return target


def phase_table(phases: dict[int, str]) -> str:
    return json.dumps(phases, sort_keys=True)
