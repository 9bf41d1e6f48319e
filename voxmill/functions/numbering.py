"""Row numbers over a whole table without one task that sorts it all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def on_one_machine(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Uses ``spark.checkpoint.dir``; sets a temporary folder only where it is unset and Spark runs in this machine alone."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not on_one_machine(spark):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` without the size that Spark has estimated for it, for tables that a loop makes from themselves.

    A join's estimate is the product of its sides', and a checkpoint keeps it: in a
    loop its digits multiply in each round, to hundreds of megabytes on the driver.
    What is joined how is then decided by what has been shuffled.
    """
    ensure_checkpoints(df.sparkSession)
    held, spark = df.checkpoint()._jdf, df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the checkpoint folder: made once, where a checkpoint makes it twice, compressed, and of known size."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: So many rows of a few numbers at most are sent to all tasks (some 60 bytes each, so tens of MB).
AT_HAND = 1_000_000


def at_hand(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast in joins if it has at most AT_HAND rows; larger ones are left to a shuffle. Runs a count."""
    return F.broadcast(df) if df.count() <= AT_HAND else df


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in the order of columns whose values together are unique.

    The table is range-partitioned, sorted in its partitions and checkpointed, so
    that it is dealt out once; a row's place is its partition and its number there.
    What is summed in one place is one count for each partition. Rows with equal
    values come in any order, each with a number of its own.
    """
    ensure_checkpoints(df.sparkSession)
    tag, place = "__part", "__place"
    at = F.monotonically_increasing_id()  # of the sorted partition: its number, and the row's within
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({tag: F.shiftright(at, 33), place: at.bitwiseAND((1 << 33) - 1)}).checkpoint()
    sizes = dealt.groupBy(tag).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(tag, before.alias("__before"))
    return dealt.join(F.broadcast(offsets), tag).withColumn(name, (F.col("__before") + F.col(place) + first).cast("long")).drop(tag, place, "__before")


def ranked(df: DataFrame, by: list[str], order: list[str], name: str, first: int = 1) -> DataFrame:
    """``df`` with ``name``: first, first + 1, ... within each group of ``by`` in the order of ``order`` (null first), a group of any size spread over tasks.

    As in ``numbered``, the table is range-partitioned, sorted and checkpointed.
    A group's rows lie in runs, one for each partition it reaches; a run's rows
    count on from the sizes of the group's earlier runs. ``by`` may not be null.
    """
    ensure_checkpoints(df.sparkSession)
    tag, place = "__part", "__place"
    at = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({tag: F.shiftright(at, 33), place: at.bitwiseAND((1 << 33) - 1)}).checkpoint()
    runs = dealt.groupBy(tag, *by).agg(F.min(place).alias("__start"), F.count("*").alias("__n"))
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy(*by).orderBy(tag).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(tag, *by, (earlier - F.col("__start") + first).alias("__shift"))
    return dealt.join(runs, [tag, *by]).withColumn(name, (F.col(place) + F.col("__shift")).cast("long")).drop(tag, place, "__shift")


def quantiles(df: DataFrame, by: list[str], column: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and, for each of ``shares``, the value that far up the group's values in order, between two of them in proportion.

    Values that are null don't count, and a group without values has no row; a
    ``by`` of null is a group. Values are ranked where they lie after a range
    partition, and only the rows at the wanted ranks are looked at, so no task holds
    a group. Without ``by``, the whole table is one group.
    """
    keys = [f"__by{n}" for n in range(len(by))]
    held = [F.struct(F.col(b).alias("v")).alias(k) for k, b in zip(keys, by, strict=True)] or [F.lit(0).alias("__all")]
    keys = keys or ["__all"]
    rows = ranked(df.where(F.col(column).isNotNull()).select(*held, F.col(column).cast("double").alias("value")), keys, ["value"], "rank", 0)
    groups = rows.groupBy(*keys).agg((F.max("rank") + 1).alias("size"))
    wanted = []
    for name, share in shares.items():
        at = (F.col("size") - 1) * F.lit(float(share))
        low, part = F.floor(at), at - F.floor(at)
        wanted += [F.struct(F.lit(name).alias("name"), low.alias("rank"), (1 - part).alias("part")), F.struct(F.lit(name).alias("name"), (low + 1).alias("rank"), part.alias("part"))]
    places = groups.select(*keys, F.explode(F.array(*wanted)).alias("w")).select(*keys, "w.*").where("part > 0")
    met = places.join(rows, [*keys, "rank"]).groupBy(*keys).agg(*(F.sum(F.when(F.col("name") == n, F.col("part") * F.col("value"))).alias(n) for n in shares))
    return met.select(*(F.col(f"{k}.v").alias(b) for k, b in zip(keys, by)), *shares)


def accumulated(df: DataFrame, by: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``column`` up to each row in the order of ``order`` within its group of ``by`` (not null), of any size."""
    from .carry import carried

    return carried(ranked(df, by, order, "__rank"), by, "__rank", {name: F.col(column)}).drop("__rank")
