"""Merkle manifest of a table: a hash for each row, for each group and for the whole.

Rows of a group stand in one order, and every 16 consecutive nodes become one node of the next level.
A level is worked on by lag and lead windows: rows of a run look up to 15 places back and ahead, masked
by their slot and the length of the run.  So every row sees its siblings, and the first row of a run
hashes the parent.  A window holds one run, never a whole group, and is dealt by the key of the parent,
so that siblings meet what lies above them without another shuffle.

Places are dealt without a window over a group: rows are dealt by range, and what stands before a
partition is a running sum over one row for each partition and group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import stage

FAN = 16
PATH = "array<struct<left:string,right:string>>"
#: monotonically_increasing_id has the partition above these bits.
PARTITION_BITS = 33


def digest(*texts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def leaf(*fields: Column) -> Column:
    """Hash of a row's fields: ``-`` for NULL, else UTF-8 bytes, a colon and the value as text."""
    texts = [f.cast("string") for f in fields]
    return digest(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` (column g and others) with ``pos``, the place in g by ``order`` from 0, and ``n``, the rows of g.

    NULLs come first.  Rows that are equal in all of ``order`` stand in any order.
    """
    dealt = nodes.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "tie")
    dealt = stage(dealt.sortWithinPartitions("g", *order, "tie").drop("tie").withColumn("at", F.monotonically_increasing_id()), "dealt")
    dealt = dealt.withColumn("part", F.shiftright("at", PARTITION_BITS))
    parts = dealt.groupBy("g", "part").agg(F.min("at").alias("low"), F.count("*").alias("own"))
    whole = Window.partitionBy("g")
    before = parts.select("g", "part", F.sum("own").over(whole).alias("n"),
                          (F.sum("own").over(whole.orderBy("part")) - F.col("own") - F.col("low")).alias("shift"))
    return dealt.join(before, ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def runs(level: DataFrame) -> DataFrame:
    """Nodes that have a level above them, with ``up``, the place of their parent."""
    return level.where("n > 1").withColumn("up", F.floor(F.col("pos") / FAN))


def sides() -> tuple[Column, Column]:
    """The siblings before and after a node, put together."""
    slot = F.col("pos") % FAN
    length = F.least(F.lit(FAN), F.col("n") - FAN * F.col("up"))
    near = Window.partitionBy("g", "up").orderBy("pos")
    behind = [F.when(slot >= k, F.lag("h", k).over(near)).otherwise("") for k in range(FAN - 1, 0, -1)]
    ahead = [F.when(slot + k < length, F.lead("h", k).over(near)).otherwise("") for k in range(1, FAN)]
    return F.concat(*behind), F.concat(*ahead)


def levels(nodes: DataFrame) -> list[DataFrame]:
    """All levels (g, pos, n, h) from ``nodes`` up; a group ends at the level where it has one node."""
    found, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        below = runs(found[-1].select("g", "pos", "n", "h"))
        first = below.withColumn("after", sides()[1]).where(F.col("pos") % FAN == 0)
        found.append(stage(first.select("g", F.col("up").alias("pos"), F.ceil(F.col("n") / FAN).alias("n"),
                                        digest(F.col("h"), F.col("after")).alias("h")), "level"))
        most = -(-most // FAN)
    return found


def tops(found: list[DataFrame]) -> DataFrame:
    """The last node (g, h) of every group."""
    out = None
    for level in found:
        own = level.where("n = 1").select("g", "h")
        out = own if out is None else out.unionByName(own)
    return out


def paths(found: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest level with ``path``: siblings before and after, level by level, then the group's path in ``above``.

    ``above`` has a row (g, path, top) for each group.
    """
    higher = None
    for level in reversed(found):
        last = level.where("n = 1").join(above, "g")
        if higher is not None:
            left, right = sides()
            inner = runs(level).withColumn("own", F.array(F.struct(left.alias("left"), right.alias("right"))))
            parents = higher.select("g", F.col("pos").alias("up"), F.col("path").alias("rest"), "top")
            inner = inner.join(parents, ["g", "up"]).withColumn("path", F.concat("own", "rest")).drop("up", "own", "rest")
            last = last.unionByName(inner)
        higher = last
    return higher


def folded(node: Column, path: Column) -> Column:
    """The root that a node leads to with its siblings."""
    return F.aggregate(path, node, lambda h, at: digest(at["left"], h, at["right"]))


def proof(path: Column) -> Column:
    """One hash of all siblings on a path, from the lowest level up, left to right."""
    return digest(F.array_join(F.transform(path, lambda at: F.concat(at["left"], at["right"])), ""))


def manifest(docs: DataFrame, fields: list[Column], group: Column, order: Column, **also: Column) -> DataFrame:
    """``doc_id`` (``order``), ``leaf``, ``subroot``, ``root``, ``path`` and the columns ``also`` of every row.

    ``fields`` make the leaf, in their order.  Leaves of a group ascend by ``order``, NULL first; rows with
    one id ascend by their leaves, so equal rows are a leaf each.  Groups ascend bytewise, NULL (a group of
    its own) before the empty text.  NULL fields count as ``-``, which no value can be.  A table of one row
    has its leaf as subroot and root and an empty path.  An empty table gives no rows.  Other columns of
    ``docs`` are ignored, and any names may occur among them.
    """
    key = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))
    leaves = stage(docs.select(key.alias("g"), order.alias("doc_id"), leaf(*fields).alias("h"),
                               *[c.alias(f"also_{name}") for name, c in also.items()]), "leaves")
    found = levels(stage(placed(leaves, "doc_id", "h"), "nodes"))
    upper = levels(stage(placed(tops(found).select(F.lit("").alias("g"), F.col("g").alias("source"), "h"), "source"), "sources"))
    root = tops(upper).first()
    end = docs.sparkSession.range(1 if root else 0).select(
        F.lit("").alias("g"), F.array().cast(PATH).alias("path"), F.lit(root.h if root else "").alias("top"))
    above = paths(upper, end).select(
        F.col("source").alias("g"), "path", F.struct(F.col("h").alias("subroot"), F.col("top").alias("root")).alias("top"))
    return paths(found, above).select(
        "doc_id", F.col("h").alias("leaf"), "top.subroot", "top.root", "path", *[F.col(f"also_{name}").alias(name) for name in also])
