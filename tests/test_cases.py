"""The validation case as one call."""

import pytest
from pyspark.sql import functions as F

from voxmill.operators import cases, validation


def test_a_finer_case_has_smaller_errors(spark):
    sides = validation.regular_polygon(spark, 5, 2.0)
    found = {}
    for ratio in (2, 8):
        case = cases.polygon_case(sides, 2.0, ratio * 2, ratio)
        size, row = 1.0 / ratio, cases.errors(case, sides, 2.0).first()
        assert case.voxels.count() * size * size == pytest.approx(validation.polygon_measures(sides).first().area, rel=0.2)
        inner = case.distances.where("solid and depth >= 3")
        assert inner.where("distance > 0").count() == 0 and case.distances.where("not solid and depth <= -3 and distance <= 0").count() == 0
        assert row.n_border == case.distances.where("depth = 0").count() > 0
        assert -1.5 * size / 2 < row.lowest <= row.highest < 1.5 * size / 2
        found[ratio] = row
    assert found[8].area_percent < found[2].area_percent + 1e-9 and abs(found[8].perimeter_percent) < 25
    with pytest.raises(ValueError):
        cases.polygon_case(sides, 2.0, 2, 4)


def test_blocks(spark):
    rows = [tuple(r) for r in cases.regular_block(spark, 3, 0.5, 2, -1.0).orderBy("oid").collect()]
    assert rows[:4] == [(0, -0.75, -0.75), (1, -0.25, -0.75), (2, 0.25, -0.75), (3, -0.75, -0.25)] and len(rows) == 9
    assert cases.regular_block(spark, 2, 1.0).agg(F.count("*")).first()[0] == 8
