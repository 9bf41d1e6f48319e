"""Row numbers of tables that are wide and in many partitions."""

import pytest
from pyspark.sql import functions as F

from voxmill.functions.numbering import numbered, ranked


@pytest.mark.parametrize("rows,adaptive", [(0, "true"), (200_000, "true"), (200_000, "false"), (2_000_000, "true")])
def test_numbers_are_whole(spark, rows, adaptive):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        table = spark.range(rows).select(F.xxhash64("id").alias("key"), F.repeat(F.col("id").cast("string"), 5).alias("text"), "id")
        made = numbered(table, ["key"], "nth", 3)
        n = made.agg(F.count("*").alias("n"), F.count_distinct("nth").alias("d"), F.min("nth").alias("lo"), F.max("nth").alias("hi"), F.count_distinct("id").alias("ids")).first()
        assert (n.n, n.d, n.ids) == (rows, rows, rows) and (not rows or (n.lo, n.hi) == (3, rows + 2))
        if rows == 200_000:
            at = [r.key for r in made.where("nth < 5003").orderBy("nth").select("key").collect()]
            assert at == [r.key for r in table.orderBy("key").limit(5000).select("key").collect()]
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_equal_values_get_numbers_of_their_own(spark):
    table = spark.range(1000).select((F.col("id") % 3).alias("key"), "id")
    assert sorted(r.nth for r in numbered(table, ["key"], "nth").collect()) == list(range(1000))


@pytest.mark.parametrize("partitions", ["3", "64"])
def test_ranks_within_groups_of_any_size(spark, partitions):
    held = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        hot = spark.range(20_000).select(F.lit(7).alias("key"), F.xxhash64("id").alias("v"))
        many = spark.range(20_000).select((F.col("id") % 900 + 10).cast("int").alias("key"), F.when(F.col("id") % 5 > 0, F.xxhash64("id")).alias("v"))
        made = ranked(hot.unionByName(many), ["key"], ["v"], "nth").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("nth", "v"))).alias("rows"))
        for r in made.collect():
            assert [x.nth for x in r.rows] == list(range(1, len(r.rows) + 1))
            values = [x.v for x in r.rows]
            assert values == sorted(values, key=lambda v: (v is not None, v or 0))
        assert ranked(hot.limit(0), ["key"], ["v"], "nth").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
