"""Ranks and picks that hold for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import cut_lineage, shuffle_width


def seeded_hash(seed: int, *keys: str) -> Column:
    """Hex MD5 of the seed and the keys: the same order on any engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def hash_rank(df: DataFrame, groups: list[str], order: Column, tie: str, name: str, digits: int = 2) -> DataFrame:
    """Rank from 1 within ``groups`` by a hex hash (``order``), then ``tie``.

    Rows of a group are spread over the first digits of the hash: a small table
    of counts per (group, digits) gives each part its start, so no window holds
    a whole group. The result is that of one window over the group. Nulls in
    the groups form groups.
    """
    keyed = df.withColumn("__h", order).withColumn("__p", F.substring("__h", 1, digits))
    counts = keyed.groupBy(*groups, "__p").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    ranked = keyed.withColumn("__r", F.row_number().over(Window.partitionBy(*groups, "__p").orderBy("__h", tie)))
    on = ranked["__p"] == starts["__q"]
    for i, g in enumerate(groups):
        on = on & ranked[g].eqNullSafe(starts[f"__g{i}"])
    joined = ranked.join(starts, on).withColumn(name, (F.col("__start") + F.col("__r")).cast("long"))
    return joined.drop("__h", "__p", "__q", "__start", "__r", *(f"__g{i}" for i in range(len(groups))))


def _on(left: DataFrame, groups: list[str], prefix: str) -> Column:
    """Null-safe equality of ``groups`` with the columns ``<prefix>0``, ..."""
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & left[g].eqNullSafe(F.col(f"{prefix}{i}"))
    return on


def _counted(df: DataFrame, value: str, groups: list[str], weight: str | None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``groups, value, n`` and ``sums`` of each distinct value, in ranges: with
    ``__to``, how many rows of the group are at or below the value, and
    ``total``, how many it has.

    The distinct values are range-partitioned, summed up per range and written
    once; a table of one entry per group and range gives each range its start.
    So no window holds more than a range, however many values there are.
    """
    spark = df.sparkSession
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("n"), *(c.alias(k) for k, c in (sums or {}).items()))
    ranged = cut_lineage(counts.repartitionByRange(shuffle_width(spark), *groups, value).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(*groups, "__part").agg(F.sum("n").alias("n"))
    parts = sizes.groupBy(*groups).agg(F.collect_list(F.struct("__part", "n")).alias("__parts"), F.sum("n").alias("total"))  # at most one entry per range
    parts = parts.select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)), "__parts", "total")
    inside = Window.partitionBy(*groups, "__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.withColumn("__to", F.sum("n").over(inside))
    joined = joined.join(parts, _on(joined, groups, "__g")) if groups else joined.join(F.broadcast(parts))  # one row without groups
    before = F.aggregate(F.filter("__parts", lambda x: x["__part"] < F.col("__part")), F.lit(0).cast("long"), lambda a, x: a + x["n"])
    return joined.withColumn("__to", F.col("__to") + before).drop("__part", "__parts", *(f"__g{i}" for i in range(len(groups))))


def value_ranks(df: DataFrame, value: str, groups: list[str] | None = None, weight: str | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``groups, value, n, total, avg_rank``: average ranks (from 1, ties share
    the mean) of each distinct value, from counts per value; the rows
    themselves are never sorted. A row counts ``weight`` times (once by
    default); ``sums`` are further aggregates per value. Null values are left
    out; null groups are groups."""
    ranked = _counted(df, value, groups or [], weight, sums)
    return ranked.withColumn("avg_rank", F.col("__to") - (F.col("n") - 1) / 2).drop("__to")


def values_at(df: DataFrame, value: str, fractions: dict[str, float], groups: list[str] | None = None, last: bool = True) -> DataFrame:
    """``groups`` and for each name the value at index ``int(n * fraction)`` of
    the sorted values (``last``: at most the last one), from counts per value."""
    groups = groups or []
    ranked = _counted(df, value, groups, None)
    picks = []
    for name, fraction in fractions.items():
        index = F.floor(F.col("total") * F.lit(fraction))
        index = F.least(index, F.col("total") - 1) if last else index
        picks.append(F.min(F.when(F.col("__to") > index, F.col(value))).alias(name))
    return ranked.groupBy(*groups).agg(*picks) if groups else ranked.agg(*picks)


def average_rank(df: DataFrame, value: str, groups: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds the average rank of each row's value within its group.

    Values that hold more than a range's share of their group are few (at most
    one per range and group) and their ranks are broadcast; the rows that they
    match are spread over the join for the other values, so no value makes a
    hot key."""
    width = shuffle_width(df.sparkSession)
    ranks = value_ranks(df, value, groups, weight).select(*(F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)), F.col(value).alias("__v"), "n", "total", F.col("avg_rank").alias(name))
    ranks = ranks.withColumn("__hot", F.col("n") * width > F.col("total"))
    extra = ["__v", *(f"__g{i}" for i in range(len(groups)))]
    hot = ranks.filter("__hot").select(*extra, F.col(name).alias("__rank"))
    marked = df.join(F.broadcast(hot), (df[value] == hot["__v"]) & _on(df, groups, "__g"), "left").drop(*extra)
    salted = marked.withColumn("__salt", F.when(F.col("__rank").isNull() & F.col(value).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*df.columns), F.lit(width))).cast("int"))
    cold = ranks.filter(~F.col("__hot")).select(*extra, F.col("__hot").cast("int").alias("__cold"), name)
    joined = salted.join(cold, (salted["__salt"] == cold["__cold"]) & (salted[value] == cold["__v"]) & _on(salted, groups, "__g"), "left")
    return joined.withColumn(name, F.coalesce("__rank", name)).drop("__rank", "__salt", "__cold", *extra)
