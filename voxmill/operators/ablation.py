"""Removal of voxels under a flux: single steps, steps by phase, spillover, and the driver loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mesh import ensure_checkpoints


def ablate(state: DataFrame, received: DataFrame, mass: float) -> DataFrame:
    """``state`` (oid, removed, ...) with what each voxel received added, and ``alive``: not more than ``mass`` is removed."""
    rows = state.join(received.select("oid", "value"), "oid", "left")
    total = F.col("removed") + F.coalesce("value", F.lit(0.0))
    return rows.withColumn("removed", total).withColumn("alive", F.col("removed") <= mass).drop("value")


def ablate_phases(state: DataFrame, received: DataFrame, factors: dict[str, float], mass: float, compound: bool = False) -> DataFrame:
    """As ``ablate``, with ``phase``: the threshold sees removed times the phase's factor (1 for an unnamed phase).

    Raw sums are stored, so a factor counts once; ``compound`` stores the product.
    """
    rows = state.join(received.select("oid", "value"), "oid", "left")
    factor = F.lit(1.0)
    for phase, f in sorted(factors.items()):
        factor = F.when(F.col("phase") == phase, F.lit(float(f))).otherwise(factor)
    raw = F.col("removed") + F.coalesce("value", F.lit(0.0))
    stored = raw * factor if compound else raw
    return rows.withColumns({"effective": raw * factor, "removed": stored}).withColumn("alive", F.col("effective") <= mass).drop("value")


def wear(state: DataFrame, received: DataFrame, area: float, axes: tuple[str, ...] = ("i", "j")) -> DataFrame:
    """One step of wear: ``state`` with ``integrity`` and ``alive`` after it, and ``taken``, the amount each voxel lost.

    ``state`` has oid, the axes, depth and integrity (1: whole), ``received`` oid
    and value. A surface voxel (depth 0) loses value / area of its integrity. Where
    nothing is left it goes, and what it could not lose is taken in equal parts
    from the voxels just below (depth 1) in its block of neighbours; those go
    too where that is more than they have, and the rest is lost.
    """
    rows = state.join(received.select("oid", "value"), "oid", "left").withColumn("value", F.when(F.col("depth") == 0, F.coalesce("value", F.lit(0.0))).otherwise(F.lit(0.0)))
    rows = rows.withColumn("left", F.col("integrity") - F.col("value") / area)
    offsets = [o for o in range(3 ** len(axes)) if o != (3 ** len(axes) - 1) // 2]
    step = F.explode(F.array(*(F.struct(*(F.lit(o // 3**a % 3 - 1).alias(f"d{x}") for a, x in enumerate(axes))) for o in offsets)))
    over = rows.where("depth = 0 and left <= 0").select(F.col("oid").alias("source"), (-F.col("left") * area).alias("excess"), *axes, step.alias("d"))
    met = over.select("source", "excess", *((F.col(x) + F.col(f"d.d{x}")).cast("int").alias(x) for x in axes)).join(rows.where("depth = 1").select("oid", *axes), list(axes))
    shares = met.groupBy("source").agg(F.count("*").alias("n"))
    more = met.join(shares, "source").groupBy("oid").agg(F.sum(F.col("excess") / F.col("n")).alias("more"))
    out = rows.join(more, "oid", "left").withColumn("left", F.col("left") - F.coalesce("more", F.lit(0.0)) / area)
    wanted = F.col("value") + F.coalesce("more", F.lit(0.0))
    out = out.withColumn("taken", F.least(wanted, F.col("integrity") * area)).withColumn("alive", F.col("left") > 0)
    return out.withColumn("integrity", F.greatest("left", F.lit(0.0))).drop("value", "left", "more")


def spill(state: DataFrame, axes: tuple[str, ...] = ("i", "j"), capacity: float = 1.0) -> DataFrame:
    """One round of spillover: what a voxel lost beyond ``capacity`` goes in equal parts to living neighbours in the 3 x 3 (x 3) block that lie on the surface (depth 0) or just below (1); with none, it stays.

    ``state`` has the axes, removed and depth. A neighbour is an offset other than 0.
    """
    over = state.where(F.col("removed") > capacity).select(*axes, (F.col("removed") - capacity).alias("excess"))
    offsets = [o for o in range(3 ** len(axes)) if o != (3 ** len(axes) - 1) // 2]
    step = F.explode(F.array(*(F.struct(*(F.lit(o // 3**a % 3 - 1).alias(f"d{x}") for a, x in enumerate(axes))) for o in offsets)))
    to = over.select(*(F.col(x).alias(f"from_{x}") for x in axes), "excess", step.alias("d")).select(*(f"from_{x}" for x in axes), "excess", *((F.col(f"from_{x}") + F.col(f"d.d{x}")).cast("int").alias(x) for x in axes))
    receivers = state.where((F.col("removed") <= capacity) & F.col("depth").isin(0, 1)).select(*axes)
    met = to.join(receivers, list(axes))
    shares = met.groupBy(*(f"from_{x}" for x in axes)).agg(F.count("*").alias("n"))
    gain = met.join(shares, [f"from_{x}" for x in axes]).groupBy(*axes).agg(F.sum(F.col("excess") / F.col("n")).alias("gain"))
    gave = shares.select(*(F.col(f"from_{x}").alias(x) for x in axes), F.lit(True).alias("gave"))
    out = state.join(gain, list(axes), "left").join(gave, list(axes), "left")
    removed = F.when(F.col("gave"), F.lit(float(capacity))).otherwise(F.col("removed")) + F.coalesce("gain", F.lit(0.0))
    return out.withColumn("removed", removed).drop("gain", "gave")


def run_steps(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], steps: int) -> list[DataFrame]:
    """The states after each step, from living voxels only; each is checkpointed, so lineage does not grow with the steps."""
    ensure_checkpoints(state.sparkSession)
    out = [state.checkpoint()]
    for n in range(1, steps + 1):
        alive = out[-1].where("alive") if "alive" in out[-1].columns else out[-1]
        out.append(step(alive, n).checkpoint())
        if out[-1].isEmpty():
            break
    return out


def remaining_curve(curve: DataFrame, half: float, rate: float, ndims: int = 2) -> DataFrame:
    """``curve`` (step, left) with ``share``, what is left of the first step's, and ``exact``, that of a square or cube of half side ``half`` whose sides recede by ``rate`` a step.

    Beyond its end ``exact`` turns negative. ``left`` is any amount; the first step is the smallest.
    """
    first = curve.agg(F.min_by("left", "step").alias("first"))
    depth = F.lit(float(half)) - F.lit(float(rate)) * F.col("step")
    exact = F.signum(depth) * F.pow(F.abs(depth) / float(half), F.lit(float(ndims)))
    return curve.crossJoin(first).withColumns({"share": F.col("left") / F.when(F.col("first") != 0, F.col("first")), "exact": exact}).drop("first")  # one row


def remaining(states: list[DataFrame]) -> DataFrame:
    """``step, n_alive, removed`` of each state."""
    out = None
    for n, s in enumerate(states):
        alive = F.count_if(F.col("alive")) if "alive" in s.columns else F.count("*")
        row = s.agg(F.lit(n).alias("step"), alive.alias("n_alive"), F.coalesce(F.sum("removed"), F.lit(0.0)).alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out
