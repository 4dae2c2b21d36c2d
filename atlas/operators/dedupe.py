"""Keep one row per key, rank, and break key collisions.

Each is ``row_number() = 1`` over a window.  Spark turns that filter into a
group limit that runs before the shuffle, so every map task passes on at most
one row per key and a key that holds a third of the table stays harmless.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from atlas.session import stage


def _columns(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _one_per_key(df: DataFrame, keys, order) -> DataFrame:
    window = Window.partitionBy(*_columns(keys)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def keep_first(df: DataFrame, keys, order) -> DataFrame:
    """First row per key in ascending ``order``: an insert that ignores conflicts."""
    return _one_per_key(df, keys, [c.asc() for c in _columns(order)])


def keep_last(df: DataFrame, keys, order) -> DataFrame:
    """Last row per key in ascending ``order``: an insert that replaces."""
    return _one_per_key(df, keys, [c.desc() for c in _columns(order)])


def drop_repeats(df: DataFrame, key: str, order: str, keep=stage) -> DataFrame:
    """``keep_first`` for wide rows whose keys hardly ever repeat.

    Repeated keys are found in a narrow pass and written down.  Rows that come
    after the first of their key are then dropped by an anti-join with that
    table, which Spark broadcasts if its size on disk allows, so that the wide
    rows are not shuffled.  Only rows equal in key and order need a window.  A NULL order comes last.
    """
    per_row = df.select(F.col(key).alias("_key"), F.col(order).alias("_order")).groupBy("_key", "_order").count()
    per_key = per_row.groupBy("_key").agg(
        F.min(F.struct(F.col("_order").isNull().alias("_last"), "_order", "count")).alias("_least"),
        F.sum("count").alias("_rows"))
    repeated = keep(per_key.where("_rows > 1").select(
        "_key", "_least._order", (F.col("_least.count") > 1).alias("_tied")), "repeated")
    if repeated.isEmpty():
        return df
    after = (df[order] > F.col("_order")) | (df[order].isNull() & F.col("_order").isNotNull())
    later = (df[key] == F.col("_key")) & after
    first = df.join(repeated, later, "left_anti")
    tied = repeated.where("_tied").select("_key")
    if tied.isEmpty():
        return first
    single = first.join(tied, first[key] == tied["_key"], "left_anti")
    several = first.join(tied, first[key] == tied["_key"], "left_semi")
    return single.unionByName(keep_first(several, [key], [order]))


def last_wins_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``key -> value`` where the value with the greatest ``order`` wins."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def top(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """The ``n`` rows with the greatest ``by``, ties in ascending ``tie``."""
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(n)


def rank_top(df: DataFrame, n: int, by: str, tie: str) -> DataFrame:
    """``top`` with its position, from 0.  Only ``n`` rows reach the final window."""
    order = Window.orderBy(F.col(by).desc(), F.col(tie).asc())
    return top(df, n, by, tie).withColumn("rank", (F.row_number().over(order) - 1).cast("long"))


def resolve_collisions(df: DataFrame, name: str, key: str, rank: str, keep: str = "first") -> DataFrame:
    """One row per ``key`` among ranked rows.

    ``first`` keeps the best rank.  ``last`` keeps the worst one, but a row whose
    name already is its key never replaces an earlier row.
    """
    if keep == "first":
        return keep_first(df, [key], [rank])
    row = F.struct(rank, *[c for c in df.columns if c not in (rank, key)])
    merged = df.groupBy(key).agg(
        F.min(row).alias("_first"),
        F.max(F.when(F.col(name) != F.col(key), row)).alias("_last"))
    winner = F.greatest("_first", F.coalesce("_last", "_first")).alias("_winner")
    return merged.select(key, winner).select(key, "_winner.*").select(*df.columns)
