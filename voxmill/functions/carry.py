"""Running sums and last values down a long listing, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a listing that one window takes.
CHUNK = 1 << 16


def carried(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, chunk: int | None = None) -> DataFrame:
    """``rows`` with the running sum of each of ``sums`` and the latest value that is not null of each of ``lasts``, down the ``order`` of its listing ``by``.

    ``order`` is a whole number, unique in a listing, as a line's is. Listings are
    cut into chunks of as many numbers. A chunk's totals and last values, one row
    each, are carried over the chunks before it; its rows need a window over their
    own chunk alone. So a listing of any length is the work of many tasks.
    """
    sums, lasts, part = sums or {}, lasts or {}, "__chunk"
    cut = rows.withColumn(part, F.floor(F.col(order) / (chunk or CHUNK)))
    within = Window.partitionBy(*by, part).orderBy(order)
    before = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = [F.sum(e).alias(f"__{n}") for n, e in sums.items()]
    latest = [F.max_by(e, F.when(e.isNotNull(), F.col(order))).alias(f"__{n}") for n, e in lasts.items()]
    chunks = cut.groupBy(*by, part).agg(*totals, *latest)
    chunks = chunks.select(*by, part, *(F.coalesce(F.sum(f"__{n}").over(before), F.lit(0)).alias(f"__{n}") for n in sums), *(F.last(f"__{n}", ignorenulls=True).over(before).alias(f"__{n}") for n in lasts))
    own = cut.withColumns({n: F.coalesce(F.sum(e).over(within), F.lit(0)) for n, e in sums.items()} | {n: F.last(e, ignorenulls=True).over(within) for n, e in lasts.items()})
    made = own.join(chunks, [*by, part])
    made = made.withColumns({n: F.col(n) + F.col(f"__{n}") for n in sums} | {n: F.coalesce(n, f"__{n}") for n in lasts})
    return made.drop(part, *(f"__{n}" for n in (*sums, *lasts)))
