"""Joins beyond a plain equi-join: hot keys, key sets, points in polygons.

Nothing here forces a broadcast except for rows bounded by a constant.  Other
small sides are left to the planner and to adaptive execution, which know or
measure their size and fall back to a shuffle when they are large.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F

from atlas.functions import geo
from atlas.session import stage

def fits_broadcast(df: DataFrame) -> bool:
    """Whether the planner's own size estimate lets it broadcast the frame."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= limit


def lookup(facts: DataFrame, dim: DataFrame, key: str, spread, how: str = "left",
           min_rows: int = 100_000, salted: bool | None = None) -> DataFrame:
    """Join ``facts`` to ``dim`` (unique on ``key``) when few keys may hold most facts.

    A dimension below the planner's broadcast limit is joined as it is: nothing is
    shuffled, so no key is hot.  Stage a dimension to have its size measured.

    Beyond that limit, or where ``salted`` says so, keys with ``min_rows`` facts or more are found
    by a pre-aggregated count.  Their facts are spread by a hash of ``spread`` over one bucket for
    each ``min_rows`` of them, and their dimension rows repeated once per bucket.  Facts without a
    key meet nothing: a left lookup adds them to the result without a shuffle.
    """
    if not salted and (salted is not None or fits_broadcast(dim)):
        return facts.join(dim, key, how)
    hot = (
        facts.where(F.col(key).isNotNull()).groupBy(key).count()
        .where(F.col("count") > min_rows)
        .select(F.col(key).alias("_hot"), F.ceil(F.col("count") / min_rows).cast("int").alias("_buckets"))
    )
    hot = stage(hot, "hot")
    keyed = facts.where(F.col(key).isNotNull())
    bucket = F.pmod(F.xxhash64(*spread), F.col("_buckets")).cast("int")
    spread_facts = keyed.join(hot, keyed[key] == hot["_hot"], "left").withColumn(
        "_salt", F.coalesce(bucket, F.lit(0))).drop("_hot", "_buckets")
    copies = dim.join(hot, dim[key] == hot["_hot"], "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_buckets", F.lit(1)) - 1))).drop("_hot", "_buckets")
    joined = spread_facts.join(copies, [key, "_salt"], how).drop("_salt")
    if how == "inner":
        return joined
    return joined.unionByName(facts.where(F.col(key).isNull()), allowMissingColumns=True)


def in_key_set(df: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``column`` is among ``keys``."""
    wanted = keys.select(F.col(key).alias("_key")).distinct()
    return df.join(wanted, df[column] == wanted["_key"], "left_semi")


def pending(needed: DataFrame, done: DataFrame, key: str, force: bool = False) -> DataFrame:
    """What is needed and not done yet; everything when forced."""
    return needed if force else needed.join(done.select(key), key, "left_anti")


def holding_all(rows: DataFrame, keys, tests) -> DataFrame:
    """Keys for which every test holds in some row: relational division by one partial aggregation.

    Each map task passes on one row per key at most, however many rows a key has.
    """
    sure = [F.coalesce(test, F.lit(False)) for test in tests]
    passed = rows.where(reduce(or_, tests)).groupBy(*keys).agg(
        *[F.bool_or(test).alias(f"_passed{i}") for i, test in enumerate(sure)])
    return passed.where(reduce(and_, [F.col(f"_passed{i}") for i in range(len(sure))])).select(*keys)


def translate(df: DataFrame, dim: DataFrame, column: str, key: str, value: str, default=None) -> DataFrame:
    """Replace ``column`` by its ``value`` in a dimension.

    Without a default, rows that have no match are dropped.
    """
    pairs = dim.select(F.col(key).alias("_key"), F.col(value).alias("_value"))
    how = "inner" if default is None else "left"
    new = F.col("_value") if default is None else F.coalesce("_value", F.lit(default))
    return df.join(pairs, df[column] == F.col("_key"), how).withColumn(column, new).drop("_key", "_value")


def labelled(top: DataFrame, labels: DataFrame, column: str) -> DataFrame:
    """Add ``label`` to a short ranked list of ids; the id itself where there is none.

    The label table is filtered by the list, so it is never shuffled for it.
    """
    ids = top.select(F.col(column).alias("qid"))
    mine = labels.select("qid", "label").join(F.broadcast(ids), "qid", "left_semi").withColumnRenamed("qid", "_qid")
    named = top.join(mine, top[column] == F.col("_qid"), "left")
    return named.withColumn("label", F.coalesce("label", column)).drop("_qid")


def first_hits(df: DataFrame, key: str, candidates: Column, dim: DataFrame, dim_key: str) -> DataFrame:
    """Per row with a candidate found in ``dim``, the columns of the first such.

    ``dim`` is unique on ``dim_key``.  Only candidates that resolve are shuffled
    to their row's key, and their minimum is taken before that shuffle.
    """
    exploded = df.select(F.col(key), F.posexplode(candidates).alias("_pos", dim_key))
    values = [c for c in dim.columns if c != dim_key]
    hits = lookup(exploded, dim, dim_key, [key, "_pos"], "inner")
    return hits.groupBy(key).agg(
        F.min_by(F.struct(dim_key, *values), "_pos").alias("_first")
    ).select(key, "_first.*")


def first_resolved(df: DataFrame, key: str, candidates: Column, dim: DataFrame, dim_key: str) -> DataFrame:
    """Every row with the columns of its first candidate found in ``dim``; NULLs if none is."""
    return df.join(first_hits(df, key, candidates, dim, dim_key), key, "left")


def _cells(x_low: Column, x_high: Column, y_low: Column, y_high: Column, size: float) -> Column:
    def steps(low, high):
        return F.sequence(F.floor(low / size).cast("int"), F.floor(high / size).cast("int"))

    return F.flatten(F.transform(steps(x_low, x_high), lambda cx: F.transform(
        steps(y_low, y_high), lambda cy: F.struct(cx.alias("cx"), cy.alias("cy")))))


#: Points above which a cell is split, and into how many parts a side of it at most.
DENSE, FINEST = 10_000, 64
#: Cells that a split table may have, by arithmetic on the globe, to be broadcast.
BROADCAST_CELLS = 1_000_000


def split_cells(points: DataFrame, size: float, dense: int, keep=stage) -> DataFrame:
    """``points`` (lng, lat on the globe) with ``cell``: grid cells, split into squares where points are dense.

    A cell of more than ``dense`` points is split into the fewest parts that hold no more each, up to
    ``FINEST`` a side.  Points are counted once, by the finest parts; coarser ones are sums of those.  Only
    split cells are listed, and a globe has a fixed number of cells.
    """
    placed = points.withColumns({"cx": F.floor(F.col("lng") / size).cast("int"), "cy": F.floor(F.col("lat") / size).cast("int")})

    def part(value, cell, parts):
        return F.least(parts - 1, F.greatest(F.lit(0), F.floor((value / size - cell) * parts).cast("int")))

    fine = keep(placed.groupBy("cx", "cy", part(F.col("lng"), F.col("cx"), F.lit(FINEST)).alias("fx"),
                               part(F.col("lat"), F.col("cy"), F.lit(FINEST)).alias("fy")).count(), "fine")
    full = fine.groupBy("cx", "cy").agg(F.sum("count").alias("all")).where(F.col("all") > dense).select("cx", "cy")
    choices = F.array(*[F.lit(2 ** k) for k in range(1, FINEST.bit_length())])
    coarse = fine.join(full, ["cx", "cy"], "left_semi").withColumn("parts", F.explode(choices))
    width = F.lit(FINEST) / F.col("parts")
    most = (coarse.groupBy("cx", "cy", "parts", F.floor(F.col("fx") / width), F.floor(F.col("fy") / width)).agg(F.sum("count").alias("own"))
            .groupBy("cx", "cy", "parts").agg(F.max("own").alias("most")))
    enough = F.min(F.when((F.col("most") <= dense) | (F.col("parts") == FINEST), F.col("parts")))
    splits = keep(most.groupBy("cx", "cy").agg(enough.alias("parts")), "splits")
    if (360 / size + 1) * (180 / size + 1) <= BROADCAST_CELLS:
        splits = F.broadcast(splits)
    parts = F.coalesce("parts", F.lit(1))
    return placed.join(splits, ["cx", "cy"], "left").withColumn("cell", F.struct(
        "cx", "cy", parts.alias("parts"), part(F.col("lng"), F.col("cx"), parts).alias("sx"), part(F.col("lat"), F.col("cy"), parts).alias("sy"),
    )).drop("cx", "cy", "parts")


def cell_polygons(cells: DataFrame, polygons: DataFrame, size: float) -> DataFrame:
    """``cell, poly_id, whole`` of polygons that a cell may meet; ``whole`` if it lies inside of one altogether.

    No edge comes near a cell that is whole or outside, so its middle tells which; cells outside are left out.
    """
    corners = F.flatten(F.col("rings"))
    xs, ys = F.transform(corners, lambda p: p.x), F.transform(corners, lambda p: p.y)
    boxes = polygons.select("poly_id", F.explode(_cells(
        F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys), size)).alias("box"))
    both = cells.join(boxes, (F.col("cell.cx") == F.col("box.cx")) & (F.col("cell.cy") == F.col("box.cy"))).select("cell", "poly_id")
    shaped = lookup(both, polygons.select("poly_id", "rings"), "poly_id", ["cell"], "inner")
    side, slack = size / F.col("cell.parts"), size * 1e-9
    left, low = F.col("cell.cx") * size + F.col("cell.sx") * side, F.col("cell.cy") * size + F.col("cell.sy") * side

    def near(ring):
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        return F.exists(F.zip_with(ring, following, lambda a, b: (
            (F.least(a.x, b.x) <= left + side + slack) & (F.greatest(a.x, b.x) >= left - slack)
            & (F.least(a.y, b.y) <= low + side + slack) & (F.greatest(a.y, b.y) >= low - slack))), lambda hit: hit)

    middle = geo.inside(F.col("rings"), left + side / 2, low + side / 2)
    judged = shaped.select("cell", "poly_id", F.exists("rings", near).alias("edge"), middle.alias("middle"))
    return judged.where("edge OR middle").select("cell", "poly_id", (~F.col("edge")).alias("whole"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, size: float = 1.0, dense: int = DENSE, keep=stage) -> DataFrame:
    """Attributes of the polygon each point lies in; every point is kept.

    ``points`` has ``key``, ``lng``, ``lat``; ``polygons`` has ``poly_id``, ``rings`` and attributes.
    Polygons are tested against the grid cells that hold points, once per cell, and cells are finer where
    points are dense.  Points of a cell inside a polygon need no test of their own; the exact test is for
    cells that an edge comes near.  Cells that stay hot are spread by the lookup.  Of several hits the
    polygon with the greatest ``poly_id`` wins.  Missing coordinates and those beyond 180 or 90 degrees
    lie in none.
    """
    attributes = [c for c in polygons.columns if c != "rings"]
    on_globe = F.col("lng").between(-180, 180) & F.col("lat").between(-90, 90)
    placed = keep(split_cells(points.where(on_globe).select(key, "lng", "lat"), size, dense, keep), "placed")
    found = cell_polygons(placed.select("cell").distinct(), polygons, size)
    cells = keep(found.groupBy("cell").agg(F.collect_list(F.struct("poly_id", "whole")).alias("near")), "cells")
    near = lookup(placed, cells, "cell", [key], "inner").select(key, "lng", "lat", F.explode("near").alias("at"))
    asked = near.select(key, "lng", "lat", F.col("at.poly_id").alias("hit"), F.when(~F.col("at.whole"), F.col("at.poly_id")).alias("poly_id"))
    tested = lookup(asked, polygons.select("poly_id", "rings"), "poly_id", [key], "left")
    hits = (tested.where(F.col("poly_id").isNull() | geo.inside(F.col("rings"), F.col("lng"), F.col("lat")))
            .groupBy(key).agg(F.max("hit").alias("poly_id")))
    return points.join(lookup(hits, polygons.select(*attributes), "poly_id", [key], "inner"), key, "left")
