"""Substring dedup by level-wise doubling of word windows.

A level looks at windows of half the wanted length.  It needs only some of them: each long window is
represented by the half window in it with the least hash, its anchor, which is the same wherever the
long window stands.  Anchors that occur in one document alone are done.  Those repeated are extended to
twice their length, to the long windows that they represent.

Neighbouring long windows share an anchor and form a span.  Equal spans collapse before anything else:
all later copies of a span are covered by its first document.  Only where an anchor stands in different
spans are their long windows compared one by one, and only those of each span's first document.  What is
no window of an earlier document is no candidate any more, so nothing is left after this level.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import mix, word_hashes
from atlas.session import stage

#: Words worked on at a time; a longer text is worked on by itself.
SLICE = 400_000
#: Odd bases of the two polynomial hashes.
GRAM_BASE, SPAN_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
ROW = "doc_id long, row long"


def words(text: str | None) -> list[bytes]:
    """Runs of anything but space and ``\\x09-\\x0D``, unchanged."""
    return text.encode().split() if text else []


class Sums:
    """Hash of any run of words, from running sums of one polynomial."""

    powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, hashes: np.ndarray, base: int):
        up, self.down = self._powers(base, len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:len(hashes)])])

    @classmethod
    def _powers(cls, base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls.powers.get(base)
        if have is None or len(have[0]) < size:
            room = max(size, SLICE + SLICE // 4)
            have = cls.powers[base] = tuple(
                np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(room, b, np.uint64)]))
                for b in (base, pow(base, -1, 1 << 64)))
        return have

    def runs(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return mix((self.sums[high] - self.sums[low]) * self.down[low])


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    done = 1
    while 2 * done <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def slices(frames: Iterator[pd.DataFrame], least_words: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Rows with at least ``least_words`` words, the hashes of all their words, and where each row's begin."""
    rows, parts, size = [], [], 0
    for frame in frames:
        for row in frame.itertuples(index=False):
            own = words(row.text)
            if len(own) >= least_words:
                rows.append(row)
                parts.append(word_hashes(own))
                size += len(own)
            if size >= SLICE:
                yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
                rows, parts, size = [], [], 0
    if rows:
        yield rows, np.concatenate(parts), np.cumsum([0, *map(len, parts)])


def anchors(keyed: DataFrame, length: int) -> DataFrame:
    """A row for each anchor: hash of its half window (gram) and of its span, the first long window ``low`` and how many."""
    half = (length + 1) // 2

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, hashes, starts in slices(frames, length):
            count = len(hashes) - half + 1
            grams = Sums(hashes, GRAM_BASE).runs(np.arange(count), np.arange(half, len(hashes) + 1))
            # the least upper half of a hash, the first one of equals
            marked = grams & np.uint64(0xFFFFFFFF00000000) | np.arange(count, dtype=np.uint64)
            chosen = (least(marked, length - half + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            inside = np.zeros(len(hashes) + 1, np.int64)
            inside[starts[:-1]] += 1
            inside[starts[1:] - length + 1] -= 1
            places = np.flatnonzero(np.cumsum(inside)[:len(chosen)])
            chosen = chosen[places]
            first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
            last = np.concatenate([first[1:], [len(chosen)]]) - 1
            low, high, at = places[first], places[last], chosen[first]
            spans = Sums(hashes, SPAN_BASE).runs(low, high + length) + mix((at - low).astype(np.uint64))
            owner = np.searchsorted(starts, at, side="right") - 1
            yield pd.DataFrame({
                "gram": grams[at].astype(np.int64), "span": spans.astype(np.int64),
                "doc_id": np.array([r.doc_id for r in rows], np.int64)[owner], "row": np.array([r.row for r in rows], np.int64)[owner],
                "low": low - starts[owner], "many": (high - low + 1).astype(np.int32)})

    return keyed.mapInPandas(find, f"gram long, span long, {ROW}, low long, many int")


def long_windows(texts: DataFrame, length: int) -> DataFrame:
    """A row for each long window of the ``wanted`` spans (gram, span, low, many) of each text."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, hashes, starts in slices(frames, length):
            spans = pd.DataFrame([(s["gram"], s["span"], r.doc_id, start + s["low"], s["many"])
                                  for r, start in zip(rows, starts) for s in r.wanted], columns=["gram", "span", "first", "low", "many"])
            out = spans.loc[spans.index.repeat(spans["many"])]
            bit = out.groupby(level=0).cumcount().to_numpy()
            at = out["low"].to_numpy(np.int64) + bit
            yield out[["gram", "span", "first"]].assign(bit=bit, window=Sums(hashes, SPAN_BASE).runs(at, at + length).astype(np.int64))

    return texts.mapInPandas(cut, "gram long, span long, first long, bit int, window long")


def repeated(docs: DataFrame, length: int = 50) -> DataFrame:
    """``doc_id``, ``row`` and ``spans`` of every row with long windows of an earlier document.

    Spans are pairs of numbers, a place and a mask: bit k is the window that starts k words after the place.
    """
    keyed = docs.where("doc_id IS NOT NULL").select("doc_id", "row", "text")
    found = stage(anchors(keyed, length), "anchors")
    # sums are written before they are joined, so that Spark can split a hot key of the join
    again = found.groupBy("gram").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("gram")
    held = stage(found.join(stage(again, "again"), "gram"), "held")
    spans = stage(held.groupBy("gram", "span").agg(F.min(F.struct("doc_id", "row", "low", "many")).alias("at"))
                  .select("gram", "span", F.col("at.doc_id").alias("first"), "at"), "spans")
    differing = spans.groupBy("gram").agg(F.min("first").alias("a"), F.max("first").alias("b")).where("a < b").select("gram")
    wanted = (spans.join(stage(differing, "differing"), "gram").groupBy("at.doc_id", "at.row")
              .agg(F.collect_list(F.struct("gram", "span", "at.low", "at.many")).alias("wanted")))
    windows = stage(long_windows(keyed.join(wanted, ["doc_id", "row"]), length).distinct(), "windows")
    earliest = windows.groupBy("gram", "window").agg(F.min("first").alias("least"), F.max("first").alias("most")).where("least < most")
    masks = (windows.join(stage(earliest.select("gram", "window", "least"), "earliest"), ["gram", "window"]).where("least < first")
             .groupBy("gram", "span").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask")))
    judged = stage(spans.select("gram", "span", "first").join(masks, ["gram", "span"], "left"), "judged")
    gone = (held.join(judged, ["gram", "span"])
            .withColumn("mask", F.when(F.col("doc_id") > F.col("first"), F.expr("shiftleft(1L, many) - 1")).otherwise(F.col("mask"))).where("mask <> 0"))
    return gone.groupBy("doc_id", "row").agg(F.flatten(F.collect_set(F.array("low", "mask"))).alias("spans"))


def cleaned(docs: DataFrame, length: int = 50) -> DataFrame:
    """``docs`` without words covered by a window of ``length`` words that also starts in a document with a smaller id.

    ``text`` becomes the kept words joined by one space; ``n_words`` (before) and ``n_removed`` are added,
    and columns of these names replaced.  A NULL text stays NULL with no words; an empty one, or one of
    white space, becomes empty.  Windows are judged on the texts as given.  Rows with one ``doc_id`` never
    cover each other, as neither id is smaller; equal rows get equal results.  Rows without an id lose
    nothing and cover nothing.  A text that loses all its words keeps its row.  Other columns are kept,
    whatever their names.  An empty table gives no rows.
    """
    if not 2 <= length <= 122:
        raise ValueError("a window has 2 to 122 words")
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    held = docs.select(F.struct(*names).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = held.withColumn("row", F.xxhash64("text"))
    gone = repeated(held, length).withColumnRenamed("doc_id", "id").withColumnRenamed("row", "own")

    @F.pandas_udf("text string, n_words long, n_removed long")
    def without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, pairs in zip(texts, spans):
            own = kept = words(text)
            if pairs is not None:
                edges = np.zeros(len(own) + 1, np.int64)
                for low, mask in np.reshape(pairs, (-1, 2)).tolist():
                    starts = low + np.array([k for k in range(mask.bit_length()) if mask >> k & 1])
                    edges[starts] += 1
                    edges[starts + length] -= 1
                kept = [w for w, covered in zip(own, np.cumsum(edges).tolist()) if not covered]
            rows.append((None if text is None else b" ".join(kept).decode(), len(own), len(own) - len(kept)))
        return pd.DataFrame(rows, columns=["text", "n_words", "n_removed"])

    joined = held.join(gone, (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("own")), "left")
    done = joined.select("kept", without("text", "spans").alias("done"))
    return done.select(*[F.col("done.text") if c == "text" else F.col("kept")[c].alias(c) for c in names], "done.n_words", "done.n_removed")
