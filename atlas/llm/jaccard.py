"""N-gram Jaccard join by vertical partitioning.

All n-grams have one global order, rare ones first; how frequent an n-gram is comes from a count
sketch of all texts.  Two sets that are similar enough share an n-gram among the first few of both
(prefix filter), and where it stands in both bounds what they can share (length and position
filter).  The order is cut into fragments.  A pair's overlap is counted in each fragment on its own
and summed.

Only the components of links are wanted, so a group of copies needs no list of its pairs.  Equal
sets are one node.  Among the nodes that share an n-gram of their prefixes, each is first compared
with the most typical one.  What these links connect is then settled, and pairs are listed only
between nodes that are still apart.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import free_name, shingles, text_bytes, word_hashes, words
from atlas.llm.components import components
from atlas.session import arrow_bytes, stage

#: Cells of one piece of the count sketch; least and most cells of all, and bytes of text for each in between.
#: A byte for each cell is broadcast, so 32 MB at most; beyond that cells fill up, and rare n-grams are told
#: apart less well, which costs time but changes no result.
PIECE, LEAST_CELLS, MOST_CELLS, CELL_BYTES = 1 << 16, 1 << 21, 1 << 25, 64
FRAGMENTS = 8
#: Bits of the frequency level above an n-gram's hash in its place in the order.
LEVEL_BITS = 8


def grams(text: str | None, n: int) -> np.ndarray:
    """Distinct n-grams of a text as sorted hashes."""
    return np.unique(shingles(word_hashes(words(text)), n))


def cell(hashes: np.ndarray, cells: int) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype(np.int64) & (cells - 1)


def cells_for(size: int) -> int:
    """Cells of the sketch, a power of two, for texts of ``size`` bytes."""
    return min(MOST_CELLS, max(LEAST_CELLS, 1 << (size // CELL_BYTES).bit_length()))


def sketch(docs: DataFrame, n: int, cells: int) -> np.ndarray:
    """Level (8 times log2 of the count, in a byte) of every cell, over all texts."""
    def packed(piece, salt, counts: np.ndarray) -> pd.DataFrame:
        at = np.flatnonzero(counts)
        return pd.DataFrame({"piece": [piece], "salt": [salt], "counts": [zlib.compress(at.astype(np.uint16).tobytes() + counts[at].tobytes(), 1)]})

    def unpack(data: bytes, into: np.ndarray) -> None:
        raw = zlib.decompress(data)
        held = len(raw) // 6
        into[np.frombuffer(raw, np.uint16, held)] += np.frombuffer(raw[2 * held:], np.uint32)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(cells, np.uint32)
        for frame in frames:
            for text in frame["text"]:
                np.add.at(total, cell(grams(text, n), cells), 1)
        salt = TaskContext.get().partitionId() % 64
        for piece, own in enumerate(total.reshape(-1, PIECE)):
            if own.any():
                yield packed(piece, salt, own)

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PIECE, np.uint32)
        for counts in part["counts"]:
            unpack(counts, total)
        return packed(part["piece"].iloc[0], part["salt"].iloc[0], total)

    schema = "piece int, salt int, counts binary"
    sums = docs.select("text").mapInPandas(count, schema).groupBy("piece", "salt").applyInPandas(add, schema)
    out = np.zeros(cells, np.uint32)
    for piece, _, counts in sums.groupBy("piece").applyInPandas(add, schema).toLocalIterator():
        unpack(counts, out[piece * PIECE:(piece + 1) * PIECE])
    return np.minimum(np.rint(8 * np.log2(out + np.float32(1))), 255).astype(np.uint8)


def ordered(text: str | None, n: int, levels: np.ndarray) -> np.ndarray:
    """A text's n-grams as places in the global order, ascending."""
    hashes = grams(text, n)
    level = levels[cell(hashes, len(levels))].astype(np.uint64) >> np.uint64(1)
    return np.sort(level << np.uint64(64 - LEVEL_BITS) | hashes >> np.uint64(LEVEL_BITS)).astype(np.int64)


def need(a: Column, b: Column, percent: int) -> Column:
    """Smallest overlap of sets of two sizes that makes a link: 100 * both >= percent * either."""
    return F.ceil(percent * (a + b) / (100 + percent))


def nodes(docs: DataFrame, n: int, percent: int, levels) -> DataFrame:
    """One row per document: hash of its text, size, node (hash of its set), prefix, typicality and a place drawn from its set."""
    def build(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, mark, text in zip(frame["doc_id"].astype("Int64"), frame["print"].tolist(), frame["text"]):
                own = ordered(text, n, levels.value)
                size = len(own)
                if not size:
                    rows.append((doc, mark, 0, None, None, None, None))
                    continue
                node = int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True)
                prefix = own[:size - -(-percent * size // 100) + 1]
                typical = int((prefix >> (64 - LEVEL_BITS)).sum() * 16 // len(prefix))
                rows.append((doc, mark, size, node, prefix.tobytes(), typical, int(own[node % size])))
            frame = pd.DataFrame(rows, columns=["doc_id", "print", "size", "node", "prefix", "typical", "drawn"])
            yield frame.astype({c: "Int64" for c in ("doc_id", "size", "node", "typical", "drawn")})

    return docs.select("doc_id", "print", "text").mapInPandas(build, "doc_id long, print long, size long, node long, prefix binary, typical long, drawn long")


def entries(distinct: DataFrame) -> DataFrame:
    """A row for each n-gram of each prefix, with its position."""
    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts = [np.frombuffer(p, np.int64) for p in frame["prefix"]]
            if parts:
                times = [len(p) for p in parts]
                yield pd.DataFrame({
                    "gram": np.concatenate(parts), "at": np.concatenate([np.arange(t) for t in times]),
                    **{c: np.repeat(frame[c].to_numpy(np.int64), times) for c in ("node", "size", "typical")}})

    return distinct.mapInPandas(explode, "gram long, at int, node long, size int, typical int")


def fits(a: str, b: str, percent: int) -> Column:
    """Length and position filter of two entries of one n-gram."""
    def get(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}").cast("long")
    rest = F.least(get(a, "size") - get(a, "at"), get(b, "size") - get(b, "at"))
    long, short = F.greatest(get(a, "size"), get(b, "size")), F.least(get(a, "size"), get(b, "size"))
    return (100 * short >= percent * long) & (rest >= need(get(a, "size"), get(b, "size"), percent))


def segments(docs: DataFrame, wanted: DataFrame, n: int, levels, pivots: np.ndarray) -> DataFrame:
    """The sets of wanted nodes (columns node, doc_id), cut into fragments of the global order."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for node, text in zip(frame["node"].tolist(), frame["text"]):
                own = ordered(text, n, levels.value)
                for piece, part in enumerate(np.split(own, np.searchsorted(own, pivots, side="right"))):
                    if len(part):
                        rows.append((node, piece, len(own), part.tobytes()))
            yield pd.DataFrame(rows, columns=["node", "piece", "size", "part"])

    wanted = wanted.select(F.col("doc_id").alias("id"), "node", F.col("print").alias("mark"))
    same = docs["doc_id"].eqNullSafe(wanted["id"]) & (docs["print"] == wanted["mark"])
    texts = docs.join(wanted, same).dropDuplicates(["node"])
    return texts.select("node", "text").mapInPandas(cut, "node long, piece int, size long, part binary")


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are links: overlaps counted by fragment, then summed."""
    def overlap(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            both = [len(np.intersect1d(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), assume_unique=True))
                    if x != y else len(x) // 8 for x, y in zip(frame["part_a"], frame["part_b"])]
            yield frame[["a", "b", "size_a", "size_b"]].assign(both=np.array(both, np.int64))

    left = parts.select(F.col("node").alias("a"), "piece", F.col("size").alias("size_a"), F.col("part").alias("part_a"))
    right = parts.select(F.col("node").alias("b"), "piece", F.col("size").alias("size_b"), F.col("part").alias("part_b"))
    counted = pairs.join(left, "a").join(right, ["b", "piece"]).select("a", "b", "size_a", "size_b", "part_a", "part_b").mapInPandas(
        overlap, "a long, b long, size_a long, size_b long, both long")
    total = counted.groupBy("a", "b").agg(F.first("size_a").alias("x"), F.first("size_b").alias("y"), F.sum("both").alias("both"))
    return total.where(100 * F.col("both") >= percent * (F.col("x") + F.col("y") - F.col("both"))).select("a", "b")


def members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """``doc_id``, ``print`` (hash of the text), ``size`` and ``least`` (doc_id, print) of every document.

    ``least`` is the smallest document with an id that links lead to, itself included; NULL for an empty
    set, and where no document that links lead to has an id.
    """
    with arrow_bytes(docs.sparkSession):
        return _members(docs, n, percent)


def _members(docs: DataFrame, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    levels = spark.sparkContext.broadcast(sketch(docs, n, cells_for(text_bytes(docs))))
    printed = docs.withColumn("print", F.xxhash64("text"))
    built = stage(nodes(printed, n, percent, levels), "built")
    rows = built.select("doc_id", "print", "size", "node")
    distinct = stage(built.where("node IS NOT NULL").groupBy("node").agg(
        F.min(F.struct("doc_id", "print")).alias("one"), F.first("size").alias("size"), F.first("prefix").alias("prefix"),
        F.first("typical").alias("typical"), F.first("drawn").alias("drawn")), "nodes")
    pivots = distinct.agg(F.percentile_approx("drawn", [k / FRAGMENTS for k in range(1, FRAGMENTS)], 10_000)).first()[0]
    pivots = np.array(sorted(set(pivots or [])), np.int64)

    # shuffled once, for hubs and for the join with them
    prefixes = entries(distinct.select("node", "size", "typical", "prefix")).repartition("gram")
    hubs = (prefixes.groupBy("gram").agg(F.max(F.struct("typical", "node", "size", "at")).alias("hub"), F.count("*").alias("n"))
            .where("n > 1").select("gram", "hub"))
    shared = stage(prefixes.join(hubs, "gram"), "shared")
    near = (shared.select("gram", F.struct("node", "size", "at").alias("x"), "hub").where(F.col("x.node") != F.col("hub.node"))
            .where(fits("x", "hub", percent))
            .select(F.least("x.node", "hub.node").alias("a"), F.greatest("x.node", "hub.node").alias("b")).distinct())
    near = stage(near, "near")
    ids = distinct.select("node", F.col("one.doc_id").alias("doc_id"), F.col("one.print").alias("print"))

    def parts_of(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        return stage(segments(printed, ids.join(used, "node"), n, levels, pivots), "parts")

    links = stage(verified(near, parts_of(near), percent), "links")
    found = components(links)

    placed = (shared.select("gram", "node", "size", "at").join(found, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    apart = placed.groupBy("gram").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("gram")
    placed = stage(placed.join(apart, "gram", "left_semi"), "placed")
    rest = (placed.alias("x").join(placed.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.node") < F.col("y.node"))
                                   & (F.col("x.component") != F.col("y.component")) & fits("x", "y", percent))
            .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
    rest = stage(rest.join(near, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = verified(rest, parts_of(rest), percent)
        links = stage(links.unionByName(more), "links")
        found = components(links)
    named = rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.where("component IS NOT NULL AND doc_id IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "print")).alias("least"))
    # written first, so that Spark can split the join where one component holds many documents
    return named.join(stage(least, "least"), "component", "left").select("doc_id", "print", "size", "least")


def join(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document.

    A document's set holds the distinct runs of ``n`` words (lower-cased A-Z); with fewer words, all
    of them as one run; without words, or NULL, nothing, and then it is linked with no other.  Two
    documents are linked when 100 * common >= percent * (all of both).  ``component_id`` is the
    smallest ``doc_id`` that links lead to, itself included.  Rows without an id have no component
    and lead to none of their own, but their text links others.  Rows of one id and different texts
    are one document each.  An empty table gives no rows; other columns are ignored.
    """
    return members(docs, n, percent).select(
        "doc_id", F.col("size").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("least.doc_id", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component, the smallest by id and text hash; all columns are kept.

    Rows with one id and different texts are judged each by its own text.  Of rows with equal id and text
    one stays.  Rows without an id and texts without words all stay.  An empty table gives no rows.
    """
    mark = free_name(docs, "_print")
    marked = docs.withColumn(mark, F.xxhash64(F.col("text").cast("string")))
    judged = stage(members(docs, n, percent).where("least IS NOT NULL AND doc_id IS NOT NULL"), "members")
    key = [F.col("doc_id").alias("_id"), F.col("print").alias("_mark")]
    gone = judged.where(F.struct("doc_id", "print") != F.col("least")).select(*key).distinct()
    again = stage(judged.groupBy(*key).count().where("count > 1").select("_id", "_mark"), "again")

    def same(other: DataFrame):
        return (marked["doc_id"].cast("long") == other["_id"]) & (marked[mark] == other["_mark"])

    kept = marked.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        several = kept.join(again, same(again), "left_semi").dropDuplicates(["doc_id", mark])
        kept = kept.join(again, same(again), "left_anti").unionByName(several)
    return kept.select(*docs.columns)
