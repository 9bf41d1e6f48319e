"""Cells with very many voxel faces give the same shares when they are split."""

import pytest
from pyspark.sql import functions as F

from voxmill.operators import flux, lattice
from voxmill.operators.pipeline import SurfaceMapper
from voxmill.spec import GridSpec


@pytest.mark.parametrize("ndims", [2, 3])
def test_shares_do_not_change(spark, ndims):
    n = 24
    spec = GridSpec((0.0,) * ndims, (10.0,) * ndims, (5,) * ndims, 0.25, (2.125,) * ndims, False)
    index = [F.floor(F.col("id") / n**a) % n for a in range(ndims)]
    tilt = sum(index[1:], index[0]) <= n * ndims * 0.6  # a corner cut off aslant
    rows = spark.range(n**ndims).where(tilt).select(F.col("id").alias("oid"), *((2.125 + i * 0.25).alias("xyz"[a]) for a, i in enumerate(index)))
    made = SurfaceMapper(spec).run(rows, check=False)
    faces = flux.surface_faces(lattice.collapse(lattice.snap(rows, spec), spec.voxel_axes), spec).cache()
    elements = made.elements.cache()
    cells = flux.split_cells(faces, spec, 6)
    assert cells.count() > 3 and cells.agg(F.max("level")).first()[0] > 1

    def shares(crowded):
        pairs = flux.candidates(elements, faces, spec, crowded)
        found = flux.weights(flux.overlaps_2d(pairs) if ndims == 2 else flux.overlaps_3d(pairs))
        return {(r.elem_id, r.oid): r.frac for r in found.collect()}, pairs.count()

    (whole, n_pairs), (split, n_split) = shares(None), shares(6)
    assert whole.keys() == split.keys() and len(whole) > 50
    assert all(split[k] == pytest.approx(v, abs=1e-9) for k, v in whole.items())
    assert n_split < n_pairs
