"""Aggregations: counts per class, shares, compositions, votes, series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def count_classes(df: DataFrame, keys, classes: dict[str, Column]) -> DataFrame:
    """Per key, the number of rows in each named class."""
    return df.groupBy(*keys).agg(*[F.count_if(test).alias(name) for name, test in classes.items()])


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.round(part / whole, digits)


def log_count(n: Column, digits: int = 3) -> Column:
    return F.round(F.log10(n), digits)


def list_counts(df: DataFrame, column: str, name: str) -> DataFrame:
    """How often each member of an array column occurs over all rows."""
    return df.select(F.explode(column).alias(name)).groupBy(name).agg(F.count("*").alias("n"))


def composition(df: DataFrame, x: str, y: str) -> DataFrame:
    """Add ``share``: the percentage of ``y`` in its ``x``.

    Expects one row per series and ``x``, so a window holds one row per series.
    """
    total = F.sum(y).over(Window.partitionBy(x))
    return df.withColumn("share", F.try_divide(F.col(y) * F.lit(100.0), total))


def wide_to_series(df: DataFrame, x: str, columns) -> DataFrame:
    """One row per series name and ``x`` from one column per series."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.col(c).alias("y")) for c in columns])
    return df.select(F.col(x).alias("x"), F.explode(pairs).alias("p")).select("p.series", "x", "p.y")


def slots_by_year(df: DataFrame, year: str, lists: str, top: DataFrame, item: str, n: int) -> DataFrame:
    """Per year, how often each of the ``n`` ranked items occurs in the lists.

    ``top`` holds ``item`` and its ``rank`` from 0; its columns are kept.  Every year with a list gets a
    row per item, zero where there is none.  One shuffle on the year.
    """
    exploded = df.select(F.col(year).alias("x"), F.explode(lists).alias(item), F.lit(1).cast("long").alias("n"))
    return slots_of_counts(exploded, top, item, n)


def cube(df: DataFrame, year: str, lists: str, item: str) -> DataFrame:
    """``x``, ``item`` and ``n``: how often each item occurs in the lists of each year, all years."""
    return df.select(F.col(year).alias("x"), F.explode(lists).alias(item)).groupBy("x", item).agg(F.count("*").alias("n"))


def slots_of_counts(counts: DataFrame, top: DataFrame, item: str, n: int) -> DataFrame:
    """``slots_by_year`` from rows ``x``, ``item`` and their number ``n``."""
    ranks = F.broadcast(top.select(F.col(item).alias("_item"), "rank"))
    ranked = counts.select("x", F.col(item).alias("_item"), "n").join(ranks, "_item", "left")
    counted = ranked.groupBy("x").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("rank") == i, F.col("n"))), F.lit(0).cast("long")) for i in range(n)]).alias("_slots"))
    slots = counted.select("x", F.posexplode("_slots").alias("_rank", "y"))
    return slots.join(F.broadcast(top), slots["_rank"] == top["rank"]).drop("_rank")


def series_arrays(df: DataFrame, series: str, x: str, *values: str) -> DataFrame:
    """Per series the ordered ``x`` and value arrays.

    For a finished chart: one row per series and ``x``.
    """
    rows = F.array_sort(F.collect_list(F.struct(x, *values)))
    ordered = df.groupBy(series).agg(rows.alias("_rows"))
    return ordered.select(series, *[F.col("_rows")[c].alias(c) for c in (x, *values)])


def winner(votes: Column) -> Column:
    """Key with the greatest sum in an array of ``struct<key, weight>``, first seen on ties.

    Works inside one row, so voting needs no shuffle; '' without votes.
    """
    keys = F.array_distinct(F.transform(votes, lambda v: v["key"]))

    def ballot(key, position):
        mine = F.filter(votes, lambda v: v["key"] == key)
        total = F.aggregate(mine, F.lit(0), lambda acc, v: acc + v["weight"])
        return F.struct(total.alias("total"), (-position).alias("order"), key.alias("key"))

    return F.coalesce(F.array_max(F.transform(keys, ballot))["key"], F.lit(""))


def group_means(df: DataFrame, key: str, columns) -> DataFrame:
    """Mean of every column per key; rows without a key are left out, NULLs skipped."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.avg(c).alias(c) for c in columns])


def group_value_counts(df: DataFrame, key: str, columns) -> DataFrame:
    """Number of non-NULL values of every column per key."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.count(c).alias(c) for c in columns])


def drop_any_null(df: DataFrame) -> DataFrame:
    return df.na.drop("any")


def observed(df: DataFrame, name: str, counters: dict[str, Column]):
    """``df`` with load counters; read them from the observation after an action."""
    from pyspark.sql import Observation

    observation = Observation(name)
    return df.observe(observation, *[c.alias(n) for n, c in counters.items()]), observation


def distinct_ids(df: DataFrame, scalars, lists) -> DataFrame:
    """Distinct non-NULL ids over several scalar and array columns, in one pass."""
    none = F.array().cast("array<string>")
    every = F.concat(F.array(*[F.col(c) for c in scalars]), *[F.coalesce(F.col(c), none) for c in lists])
    return df.select(F.explode(F.array_compact(every)).alias("qid")).where("qid != ''").distinct()
