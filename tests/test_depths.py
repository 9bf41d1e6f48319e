"""Depths of voxels that are deeper than a weighted grid's reach."""

import pytest
from pyspark.sql import functions as F

from voxmill.operators import lattice
from voxmill.operators.pipeline import SurfaceMapper
from voxmill.spec import GridSpec


@pytest.mark.parametrize("side, ndims", [(31, 2), (15, 3)])
def test_depths_of_a_deep_block(spark, side, ndims):
    """A block with notches, a hole and a part of its own: each voxel has its whole depth, as in a dense lattice."""
    spec = GridSpec((-20.0,) * ndims, (60.0,) * ndims, (40,) * ndims, 1.0)
    axes = spec.voxel_axes
    rows = spark.range(side**ndims).select(*((F.floor(F.col("id") / side**n) % side).cast("int").alias(a) for n, a in enumerate(axes)))
    first, second = axes[:2]
    rows = rows.where(f"not ({first} = 4 and {second} = 5) and not ({first} > {side - 3} and {second} between 3 and 4)")
    rows = rows.unionByName(rows.where(f"{first} < 3").withColumn(first, F.col(first) + side + 2))
    dense = {tuple(r[a] for a in axes): r.depth for r in lattice.depth(lattice.padded(rows, spec), axes).collect()}
    solid = {p for p, d in dense.items() if d >= 0}
    assert max(dense.values()) > spec.reach
    assert {tuple(r[a] for a in axes): r.depth for r in lattice.solid_depth(rows.unionByName(rows), axes).collect()} == {p: dense[p] for p in solid}
    got = SurfaceMapper(spec).weighted(rows).collect()
    assert len(got) == len({tuple(r[a] for a in axes) for r in got})
    assert {tuple(r[a] for a in axes): (r.solid, r.depth) for r in got} == {p: (p in solid, d) for p, d in dense.items() if d >= -spec.reach}
    assert lattice.whole_depth(rows.limit(0), axes, 2).count() == 0
