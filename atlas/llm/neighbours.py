"""Nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions in several random ways, each with its own shift, and laid
along a Hilbert curve.  Spark range-partitions the curves; on each, a query looks at the vectors
whose keys come shortly before and after its own.  Positions along whole curves tell which blocks of
a curve the window meets, and the query is sent to each of them.  The best of all windows, by one-byte copies of
the vectors, merge and are ranked anew by the exact inner product of the original vectors.

Largest inner product is made a nearest-neighbour question first: candidates get one more
coordinate that lifts all of them to the largest norm, and queries are scaled to it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import stage

CURVES, DIMENSIONS, BITS = 32, 12, 5
#: Keys on either side of a query: a fixed number and a share of all distinct vectors.
NEAR, SHARE = 64, 0.009
#: Rows of curves in one block.
TASK_ROWS = 150_000
SEED = 20


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points with integer coordinates below ``2 ** bits``.

    Coordinates become the transposed Gray code of the position by undoing, from the coarsest bit
    down, the reflections and exchanges of axes of each sub-cube.
    """
    axes = [column.astype(np.int64) for column in cells.T]
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i, axis in enumerate(axes):
            high = (axis >> level) & 1 == 1
            swap = np.where(high, 0, (axes[0] ^ axis) & low)
            axes[0] = np.where(high, axes[0] ^ low, axes[0] ^ swap)
            axes[i] = axes[i] ^ swap if i else axes[0]
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros_like(axes[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> level) & 1 == 1, (1 << level) - 1, 0)
    key = np.zeros_like(axes[0])
    for level in range(bits - 1, -1, -1):
        for axis in axes:
            key = key << 1 | ((axis ^ turn) >> level) & 1
    return key


def curve(number: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Projection (orthogonal columns) and shift of one curve."""
    rng = np.random.default_rng((SEED, number))
    plane = np.linalg.qr(rng.normal(size=(width, min(DIMENSIONS, width))))[0]
    return plane, rng.uniform(-0.15, 0.15, plane.shape[1])


def valid(vectors: DataFrame, id_col: str, column: str) -> tuple[DataFrame, str, int]:
    """``vec_id`` and packed vector ``v`` of the rows that take part, their number format and size."""
    kind = "<f8" if dict(vectors.dtypes)[column] == "array<double>" else "<f4"
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & fine & F.exists("x", lambda x: x != 0))
    size = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("x") == (size["n"] if size else 0))

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"vec_id": frame["vec_id"], "v": [np.asarray(x, kind).tobytes() for x in frame["x"]]})

    return rows.mapInPandas(pack, "vec_id long, v binary"), kind, size["n"] if size else 0


def moments(rows: DataFrame, kind: str, width: int) -> tuple[np.ndarray, float, float]:
    """Mean vector, deviation of one coordinate about it, and largest norm."""
    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = unpack(frame["v"], kind, width)
            yield pd.DataFrame({"j": np.arange(width), "n": len(x), "s": x.sum(0), "q": (x ** 2).sum(0),
                                "m": float(np.sqrt((x ** 2).sum(1).max(initial=0)))})

    sums = (rows.mapInPandas(add, "j int, n long, s double, q double, m double").groupBy("j")
            .agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.max("m").alias("m")).orderBy("j").collect())
    if not sums:
        return np.zeros(width), 1.0, 1.0
    n, mean = sums[0]["n"], np.array([r["s"] for r in sums]) / sums[0]["n"]
    spread = np.mean([max(r["q"] / n - m * m, 0) for r, m in zip(sums, mean)])
    return mean, float(np.sqrt(spread)) or 1.0, sums[0]["m"]


def unpack(column: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, max(width, 1)).astype(np.float64)


def search(vectors: DataFrame, asks, k: int = 20, id_col: str = "vec_id", column: str = "embedding",
           curves: int = CURVES, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` nearest found of each row that asks.

    ``asks`` makes a condition from the id column.  Nearness is the largest inner product, ties go
    to the smaller id; a query's own id is no candidate.  Rows with NULL ids and vectors that are
    NULL, empty, zero, not finite or of another than the commonest size take no part.  Equal
    vectors are one point of the curves, of which the ``k + 1`` smallest ids can be among the
    nearest of anything; no other id of theirs could.  An empty table gives no rows.

    Work and recall grow with ``curves`` and the window of ``near`` keys plus ``share`` of all
    distinct vectors on either side.  A window ends only where its curve does.
    """
    rows, kind, width = valid(vectors, id_col, column)
    rows = stage(rows, "vectors")
    spark = vectors.sparkSession
    order = Window.partitionBy("v").orderBy("vec_id")
    points = (rows.distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
              .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")))
    asked = rows.where(asks(F.col("vec_id"))).select("v").distinct().withColumn("asked", F.lit(True))
    points = stage(points.join(asked, "v", "left").select(
        F.col("ids")[0].alias("point"), "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")), "points")
    count = points.count()
    mean, spread, norm = moments(points.select("v"), kind, width)
    reach = near + int(share * count)
    settings = spark.sparkContext.broadcast((mean, spread, norm))

    def lay(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre, deviation, most = settings.value
        planes = [curve(c, width + 1) for c in range(curves)]
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at:at + 2000]
                x = unpack(part["v"], kind, width)
                lengths = np.sqrt((x ** 2).sum(1))
                lift = np.sqrt(np.maximum(most ** 2 - lengths ** 2, 0))
                asking = np.flatnonzero(part["asked"].to_numpy(bool))
                point = part["point"].to_numpy()
                own = np.column_stack([x - centre, lift])
                query = np.column_stack([x[asking] * (most / lengths[asking])[:, None] - centre, np.zeros(len(asking))])
                for c, (plane, shift) in enumerate(planes):
                    for data, who, is_query in ((own, np.arange(len(x)), False), (query, asking, True)):
                        if len(who):
                            unit = data @ plane / (6 * deviation) + 0.5 + shift
                            cells = np.clip(unit * (1 << BITS), 0, (1 << BITS) - 1)
                            yield pd.DataFrame({"curve": np.int32(c), "key": hilbert(cells, BITS), "asks": is_query, "point": point[who]})

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Candidates of the curve before each row in its block."""
        block, before = TaskContext.get().partitionId(), Counter()
        for frame in frames:
            for c, part in frame.groupby("curve", sort=False):
                candidate = (~part["asks"].to_numpy(bool)).astype(np.int64)
                at = before[c] + np.cumsum(candidate) - candidate
                before[c] += int(candidate.sum())
                yield pd.DataFrame({"curve": part["curve"], "block": np.int32(block), "low": at, "high": at, "asks": part["asks"], "point": part["point"]})

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Part of each query's window in every block that it meets."""
        for frame in frames:
            for c, part in frame.groupby("curve", sort=False):
                blocks, starts = borders.value[c]
                at = starts[np.searchsorted(blocks, part["block"])] + part["low"].to_numpy()
                low, high = np.maximum(at - reach, 0), np.minimum(at + reach, starts[-1])
                first, last = np.searchsorted(starts, low, side="right") - 1, np.searchsorted(starts, high, side="left")
                times = np.maximum(last - first, 0)
                row = np.repeat(np.arange(len(part)), times)
                to = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                yield pd.DataFrame({"curve": np.int32(c), "block": blocks[to].astype(np.int32), "low": np.maximum(low[row], starts[to]) - starts[to],
                                    "high": np.minimum(high[row], starts[to + 1]) - starts[to], "asks": True, "point": part["point"].to_numpy()[row]})

    def shorten(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One-byte copies of vectors."""
        for frame in frames:
            for at in range(0, len(frame), 2000):
                part = frame.iloc[at:at + 2000]
                x = unpack(part["v"], kind, width)
                scale = 127 / np.abs(x).max(1)
                small = [b.tobytes() for b in np.rint(x * scale[:, None]).astype(np.int8)]
                yield pd.DataFrame({"point": part["point"], "scale": scale.astype(np.float32), "small": small})

    def look(part: pd.DataFrame) -> pd.DataFrame:
        asking = part["asks"].to_numpy(bool)
        here, wanted = part[~asking].sort_values("low"), part[asking]
        if not len(here) or not len(wanted):
            return pd.DataFrame({"query": [], "point": [], "score": []})
        data = (np.frombuffer(b"".join(here["small"]), np.int8).reshape(len(here), -1).astype(np.float32)
                / here["scale"].to_numpy(np.float32)[:, None])
        ids = here["point"].to_numpy()
        found = []
        for low, high, who, small, scale in zip(*(wanted[c].tolist() for c in ("low", "high", "point", "small", "scale"))):
            score = data[low:high] @ (np.frombuffer(small, np.int8).astype(np.float32) / np.float32(scale))
            best = np.argpartition(-score, 2 * k)[:2 * k] if len(score) > 2 * k else np.arange(len(score))
            found.append((np.full(len(best), who), ids[low + best], score[best]))
        query, candidate, score = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"query": query, "point": candidate, "score": score})

    tasks = max(1, -(-count * curves // TASK_ROWS))
    laid = points.select("point", "v", "asked").mapInPandas(lay, "curve int, key long, asks boolean, point long")
    placed = "curve int, block int, low long, high long, asks boolean, point long"
    order = stage(laid.repartitionByRange(tasks, "curve", "key", "point").sortWithinPartitions("curve", "key", "point")
                  .mapInPandas(number, placed), "order")
    sizes = defaultdict(list)
    for c, block, n in order.groupBy("curve", "block").agg(F.sum((~F.col("asks")).cast("long"))).orderBy("curve", "block").collect():
        sizes[c].append((block, n))
    borders = spark.sparkContext.broadcast({
        c: (np.array([b for b, _ in own]), np.cumsum([0, *[n for _, n in own]])) for c, own in sizes.items()})
    copies = points.select("point", "v").mapInPandas(shorten, "point long, scale float, small binary")
    asking = order.where("asks").mapInPandas(route, placed)
    seen = (order.where("NOT asks").unionByName(asking).join(copies, "point").groupBy("curve", "block")
            .applyInPandas(look, "query long, point long, score float"))
    ranked = Window.partitionBy("query").orderBy(F.desc("score"), "point")
    merged = (seen.groupBy("query", "point").agg(F.max("score").alias("score"))
              .withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= 3 * k).select("query", "point"))
    selves = points.where("asked").select(F.col("point").alias("query"), "point")
    pairs = merged.union(selves).distinct()
    pairs = (pairs.join(points.select("point", "v", "ids"), "point")
             .join(points.where("asked").select(F.col("point").alias("query"), F.col("v").alias("q")), "query"))

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            score = (unpack(frame["v"], kind, width) * unpack(frame["q"], kind, width)).sum(1)
            yield pd.DataFrame({"query": frame["query"], "ids": frame["ids"], "score": score})

    scored = pairs.select("query", "ids", "v", "q").mapInPandas(exact, "query long, ids array<long>, score double")
    nearest = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = (scored.select("query", F.explode("ids").alias("vec_id"), "score").withColumn("n", F.row_number().over(nearest))
            .where(F.col("n") <= k + 1).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best")))
    # one row per distinct vector that asks, then per id that asks
    lists = points.where("asked").join(best, points["point"] == best["query"]).select("v", "best")
    own = rows.where(asks(F.col("vec_id"))).distinct().join(lists, "v")
    kept = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("vec_id")), 1, k)
    return (own.select(F.col("vec_id").alias("query_id"), F.posexplode(kept).alias("at", "b"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score")))
