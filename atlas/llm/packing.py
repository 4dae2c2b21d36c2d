"""Bounded-space online packing of token sequences into training windows.

Every task walks its documents once.  A document's full windows become sequences of their own;
its rest goes into the open window that it fills best.  A task keeps ``open_windows`` of them:
when a rest fits nowhere and all are in use, the fullest is emitted.  What is still open at the
end of the tasks is merged in a second round of the same rule, over far fewer tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm import tokens
from atlas.session import arrow_bytes, stage

PIECE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
         "sequence_id long, offset long, used long, is_open boolean")
#: Windows that one task of the second round takes.
MERGE_ROWS = 50_000
#: Bits of a sequence's number below the number of the task that made it.
SHIFT = 40


class Windows:
    """Open windows of one task, each with what it holds and where."""

    def __init__(self, size: int, keep: int, base: int):
        self.size, self.keep, self.next = size, keep, base
        self.open: list[tuple[int, list]] = []  # (used, pieces)

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int, piece) -> list[tuple[int, list]]:
        """Put a piece into the fullest window that has room; returns the windows that leave."""
        best = -1
        for i, (used, _) in enumerate(self.open):
            if used + length <= self.size and (best < 0 or used > self.open[best][0]):
                best = i
        gone = None
        if best >= 0:
            used, pieces = self.open.pop(best)
        else:
            if len(self.open) >= self.keep:
                gone = self.open.pop(max(range(len(self.open)), key=lambda i: self.open[i][0]))
            used, pieces = 0, []
        pieces.append((piece, used))
        left = [gone] if gone else []
        if used + length == self.size:
            return [*left, (self.size, pieces)]
        self.open.append((used + length, pieces))
        return left


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1,
         open_windows: int = 64) -> DataFrame:
    """One row per piece: where it comes from and where it lies.

    ``doc_id``, ``start``, ``length``, ``ids_crc32`` of its ids, ``doc_tokens`` of its document with
    the end id, ``sequence_id``, ``offset``, ``sequence_tokens`` (used in the sequence) and
    ``padded_length`` (``size``, or what is used where that is a power of two).

    A NULL or empty text is the end id alone.  Rows are packed one by one, so repeated rows and
    repeated or NULL ids give a piece or more for each row.  Long documents are cut.  An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokenizer)
        windows = Windows(size, open_windows, TaskContext.get().partitionId() << SHIFT)
        for frame in frames:
            rows = []
            for doc, ids in zip(frame["doc_id"], encoder.encode(frame["text"])):
                ids = np.append(ids, np.uint32(end_id))
                for start in range(0, len(ids), size):
                    part = ids[start:start + size]
                    piece = (doc, start, len(part), tokens.crc(part), len(ids))
                    if len(part) == size:
                        rows.append((*piece, windows.number(), 0, size, False))
                    else:
                        for used, pieces in windows.place(len(part), piece):
                            number = windows.number()
                            rows += [(*p, number, at, used, False) for p, at in pieces]
            yield _frame(rows)
        rows = []
        for used, pieces in windows.open:
            number = windows.number()
            rows += [(*p, number, at, used, True) for p, at in pieces]
        yield _frame(rows)

    with arrow_bytes(docs.sparkSession):
        packed = stage(docs.mapInPandas(fill, PIECE), "packed")
    left = packed.where("is_open")
    merged = _merge(left, size, open_windows)
    return (packed.where("NOT is_open").drop("is_open").unionByName(merged)
            .withColumnRenamed("used", "sequence_tokens")
            .withColumn("padded_length", F.when(F.bit_count("sequence_tokens") == 1, F.col("sequence_tokens"))
                        .otherwise(F.lit(size).cast("long"))))


def _frame(rows: list) -> pd.DataFrame:
    names = [part.split()[0] for part in PIECE.split(", ")]
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({name: "Int64" for name in names[:-1]} | {"is_open": "bool"})


def _merge(left: DataFrame, size: int, open_windows: int) -> DataFrame:
    """Windows left open by the tasks, packed into one another as wholes."""
    sizes = left.groupBy("sequence_id").agg(F.max("used").alias("used"))
    tasks = max(1, -(-sizes.count() // MERGE_ROWS))

    def fill(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows, names = Windows(size, open_windows, (1 << 62) + (TaskContext.get().partitionId() << SHIFT)), []

        def emit(gone):
            for used, pieces in gone:
                number = windows.number()
                names.extend((sequence, number, at, used) for sequence, at in pieces)

        for frame in frames:
            for sequence, used in zip(frame["sequence_id"].tolist(), frame["used"].tolist()):
                emit(windows.place(used, sequence))
        emit(windows.open)
        yield pd.DataFrame(names, columns=["sequence_id", "into", "shift", "filled"], dtype="int64")

    moved = stage(sizes.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")
                  .mapInPandas(fill, "sequence_id long, into long, shift long, filled long"), "merged")
    return left.join(moved, "sequence_id").select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("into").alias("sequence_id"),
        (F.col("offset") + F.col("shift")).alias("offset"), F.col("filled").alias("used"))
