"""Voxel and surface analytics, and preparation of training text, as Spark DataFrame operators."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Python functions of this package travel with the plan, so executors need no installed copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])


def __getattr__(name: str):
    """``voxmill.GridSpec`` and ``voxmill.SurfaceMapper``, loaded when asked for."""
    if name == "GridSpec":
        from .spec import GridSpec

        return GridSpec
    if name == "SurfaceMapper":
        from .operators.pipeline import SurfaceMapper

        return SurfaceMapper
    raise AttributeError(name)
