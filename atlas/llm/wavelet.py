"""Token ids as wavelet matrices: one compressed file per shard, with access, counting and lookup.

A shard's ids are kept as bit-planes from the highest bit down.  Each plane holds one bit of every
id; between planes, ids whose bit was 0 move before those whose bit was 1, order kept.  With counts
of ones at every 512th position, rank is a table lookup and a popcount, and select a binary search.

File: ``ATWM``, version, number of planes, ids and documents, then one zlib block each for document
ids (with a NULL flag), document lengths, and every plane's bits; little-endian throughout.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from atlas.llm import common, tokens
from atlas.session import scratch_dir, stage

MAGIC, VERSION, HEADER = b"ATWM", 1, "<4sHHqqqq"
BLOCK = 512
#: Ids in one file at most, but for a longer single document.
FILE_TOKENS = 2_000_000
#: Bytes of text that one shard is to hold.
SHARD_BYTES = 16 << 20


class WaveletMatrix:
    """Sequence of unsigned integers below ``2 ** planes``."""

    def __init__(self, planes: list[np.ndarray], length: int):
        self.length, self.bits = length, planes
        self.ones = []
        for plane in planes:
            counts = np.bitwise_count(plane).astype(np.int64)
            counts = np.pad(counts, (0, -len(counts) % (BLOCK // 8))).reshape(-1, BLOCK // 8).sum(1)
            self.ones.append(np.concatenate([[0], np.cumsum(counts)]))
        self.zeros = [length - int(ones[-1]) for ones in self.ones]

    @classmethod
    def build(cls, values: np.ndarray, planes: int) -> "WaveletMatrix":
        values, out = values.astype(np.uint16 if planes <= 16 else np.uint32), []
        for shift in range(planes - 1, -1, -1):
            high = (values >> shift) & 1 == 1
            out.append(np.packbits(high, bitorder="little"))
            values = np.concatenate([values[~high], values[high]])
        return cls(out, len(values))

    def values(self) -> np.ndarray:
        """All values in order, from the lowest plane up: each puts its two halves back in place."""
        kind = np.uint16 if len(self.bits) <= 16 else np.uint32
        out = np.zeros(self.length, kind)
        for shift, (plane, zeros) in enumerate(zip(reversed(self.bits), reversed(self.zeros))):
            high = np.unpackbits(plane, count=self.length, bitorder="little").view(bool)
            above = np.empty(self.length, kind)
            above[~high] = out[:zeros]
            above[high] = out[zeros:] | kind(1 << shift)
            out = above
        return out.astype(np.uint32)

    def rank(self, level: int, position: int) -> int:
        """Ones before ``position`` in a plane."""
        block, plane = position // BLOCK, self.bits[level]
        start = block * (BLOCK // 8)
        ones = int(self.ones[level][block]) + int(np.bitwise_count(plane[start:position // 8]).sum())
        rest = position % 8
        return ones + (int(plane[position // 8]) & ((1 << rest) - 1)).bit_count() if rest else ones

    def select(self, level: int, bit: int, nth: int) -> int:
        """Position of the ``nth`` (from 0) such bit of a plane."""
        low, high = 0, self.length - 1
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(level, middle + 1)
            if (ones if bit else middle + 1 - ones) > nth:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, position: int) -> int:
        value = 0
        for level, zeros in enumerate(self.zeros):
            bit = int(self.bits[level][position // 8]) >> (position % 8) & 1
            ones = self.rank(level, position)
            position, value = zeros + ones if bit else position - ones, value << 1 | bit
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        start = 0
        if value < 0 or value >> len(self.bits):
            return 0, 0
        for level, zeros in enumerate(self.zeros):
            first, last = self.rank(level, start), self.rank(level, stop)
            if value >> (len(self.bits) - 1 - level) & 1:
                start, stop = zeros + first, zeros + last
            else:
                start, stop = start - first, stop - last
        return start, stop

    def count(self, value: int, stop: int | None = None) -> int:
        """How often a value occurs before ``stop``."""
        start, end = self._range(value, self.length if stop is None else stop)
        return end - start

    def find(self, value: int, nth: int = 0) -> int:
        """Position of a value's ``nth`` occurrence, -1 if there is none."""
        start, end = self._range(value, self.length)
        if not 0 <= nth < end - start:
            return -1
        position = start + nth
        for level in range(len(self.bits) - 1, -1, -1):
            bit = value >> (len(self.bits) - 1 - level) & 1
            position = self.select(level, bit, position - self.zeros[level] if bit else position)
        return position


def to_bytes(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int], planes: int, shard: int, part: int) -> bytes:
    matrix = WaveletMatrix.build(ids, planes)
    blocks = [np.array([x is None for x in doc_ids], np.uint8), np.array([x or 0 for x in doc_ids], "<i8"),
              np.array(lengths, "<i8"), *matrix.bits]
    packed = [zlib.compress(block.tobytes(), 1) for block in blocks]
    head = struct.pack(HEADER, MAGIC, VERSION, planes, len(ids), len(doc_ids), shard, part)
    return b"".join([head, struct.pack(f"<{len(packed)}q", *map(len, packed)), *packed])


def from_bytes(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray, int, int]:
    """Matrix, document ids, document lengths, shard and part of a file."""
    magic, version, planes, length, docs, shard, part = struct.unpack_from(HEADER, data)
    if magic != MAGIC or version != VERSION:
        raise ValueError("not a wavelet token file")
    at = struct.calcsize(HEADER)
    sizes = struct.unpack_from(f"<{planes + 3}q", data, at)
    at, blocks = at + 8 * len(sizes), []
    for size in sizes:
        blocks.append(zlib.decompress(data[at:at + size]))
        at += size
    missing, ids, lengths = (np.frombuffer(b, t) for b, t in zip(blocks, ("u1", "<i8", "<i8")))
    matrix = WaveletMatrix([np.frombuffer(b, np.uint8) for b in blocks[3:]], length)
    return matrix, [None if m else i for m, i in zip(missing.tolist(), ids.tolist())], lengths, shard, part


def put(folder: str, name: str, data: bytes) -> None:
    """Write a file whole or not at all into a folder given as a path or a URI."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    store.create_dir(root, recursive=True)
    hidden = f"{root}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(hidden) as out:
        out.write(data)
    store.move(hidden, f"{root}/{name}")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 1,
                 file_tokens: int = FILE_TOKENS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encode texts and write their ids in ascending ``doc_id`` order; returns the list of files.

    Shards are ranges of ``doc_id``; a task writes a shard as one file, or several in order when it
    holds more than ``file_tokens`` ids, so memory does not depend on the size of a shard.  Texts
    are encoded where they are read and only ids are shuffled.  NULL ids come first, a NULL text is
    the end id alone; rows of one id are ordered by their ids' checksum and length.  The folder
    must be one that all executors reach.  A task that is run again writes the same files again.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = max(1, -(-common.text_bytes(docs) // shard_bytes))
    marks = [k / shards for k in range(1, shards)]
    bounds = docs.agg(F.percentile_approx("doc_id", marks, 100 * shards)).first()[0] if marks else []
    bounds = np.unique(np.array(bounds or [], np.int64))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokens.encoder(tokenizer)
        for frame in frames:
            ids = [np.append(x, np.uint32(end_id)) for x in encoder.encode(frame["text"])]
            given = frame["doc_id"].astype("Int64")
            shard = np.searchsorted(bounds, given.fillna(-2**63).to_numpy(np.int64), side="right")
            yield pd.DataFrame({"shard": shard.astype("int64"), "doc_id": given, "n": [len(x) for x in ids],
                                "crc": [tokens.crc(x) for x in ids],
                                "ids": [x.astype("<u4" if encoder.size > 1 << 16 else "<u2").tobytes() for x in ids]})

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = (tokens.encoder(tokenizer).size - 1).bit_length()
        kind = "<u4" if planes > 16 else "<u2"
        shard, part, held, size = None, 0, [], 0

        def flush():
            data = to_bytes(np.concatenate([np.frombuffer(x, kind) for _, x in held]), [d for d, _ in held],
                            [len(x) // np.dtype(kind).itemsize for _, x in held], planes, shard, part)
            name = f"tokens-{shard:08d}-{part:06d}.wm"
            put(folder, name, data)
            return pd.DataFrame({"shard": [shard], "part": [part], "file": [name], "n_tokens": [size], "n_docs": [len(held)]})

        for frame in frames:
            given = [None if pd.isna(x) else int(x) for x in frame["doc_id"].astype("Int64")]
            for own, doc, n, ids in zip(frame["shard"].tolist(), given, frame["n"].tolist(), frame["ids"]):
                if held and (own != shard or size + n > file_tokens):
                    yield flush()
                    part, held, size = part + 1 if own == shard else 0, [], 0
                shard = own
                held.append((doc, ids))
                size += n
        if held:
            yield flush()

    rows = docs.mapInPandas(encode, "shard long, doc_id long, n long, crc long, ids binary")
    spread = rows.repartition(shards, "shard").sortWithinPartitions("shard", "doc_id", "n", "crc")
    return stage(spread.mapInPandas(write, "shard long, part long, file string, n_tokens long, n_docs long"), "files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """One row per document of the listed files: ``doc_id``, ``start`` in all ids, ``n_tokens``, ``ids_crc32``, ``ids``.

    No rows where no file is listed, as an empty table writes none.
    """
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    if files.isEmpty():
        return files.sparkSession.createDataFrame([], schema)
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for data in frame["content"]:
                matrix, doc_ids, lengths, shard, part = from_bytes(data)
                ids = matrix.values().astype("<u4")
                ends = np.cumsum(lengths)
                own = [ids[a:b] for a, b in zip(ends - lengths, ends)]
                for k in range(0, len(own), 1000):
                    yield pd.DataFrame({
                        "shard": shard, "part": part, "doc_id": pd.array(doc_ids[k:k + 1000], "Int64"),
                        "first": (ends - lengths)[k:k + 1000], "n_tokens": lengths[k:k + 1000],
                        "ids_crc32": [tokens.crc(x) for x in own[k:k + 1000]], "ids": [x.tobytes() for x in own[k:k + 1000]]})

    spark = files.sparkSession
    content = spark.read.format("binaryFile").option("pathGlobFilter", "tokens-*.wm").load(folder).select("content")
    rows = content.mapInPandas(decode, "shard long, part long, doc_id long, first long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(starts, ["shard", "part"]).select(
        "doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "ids")


def new_folder(docs: DataFrame) -> str:
    """A fresh place for token files in the session's shared folder."""
    return f"{scratch_dir(docs.sparkSession)}/tokens"
