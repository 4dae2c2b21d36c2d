"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.session import arrow_rows  # noqa: F401  (several operators take it from here)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it what no column of ``df`` is called in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def fold(column: Column | str, parts: int = 5) -> Column:
    """crc32 of a document's id as text, modulo ``parts``; NULL ids count as the empty text."""
    text = F.coalesce((F.col(column) if isinstance(column, str) else column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % parts


def lower_ascii(column: Column) -> Column:
    """A-Z lower-cased, every other character kept."""
    return F.translate(column, UPPER, LOWER)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but space and ``\\x09-\\x0D``, as UTF-8.

    ``bytes.lower`` and ``bytes.split`` treat exactly these characters.
    """
    return text.encode().lower().split() if text else []


class Hashes(dict):
    """64-bit hashes of the tokens that a worker has met, at most ``LIMIT`` of them at a time.

    ``strip`` bytes around a token don't count; a token of them alone has the hash 0.
    """

    LIMIT = 150_000

    def __init__(self, strip: bytes = b""):
        super().__init__()
        self.strip = strip

    def __missing__(self, token: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        word = token.strip(self.strip) if self.strip else token
        found = self[token] = xxhash.xxh3_64_intdigest(word) if word else 0
        return found

    def of(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))


_hashes = Hashes()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """64-bit hash of every token."""
    return _hashes.of(tokens)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    values = values.astype(np.uint64)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


def word_lists(texts: Iterable[str | None]) -> pa.Array:
    """The words of each text, as ``words`` cuts them: Arrow's ASCII white space is the same six characters."""
    given = pc.ascii_trim_whitespace(pc.ascii_lower(pa.array(texts, pa.large_string())))
    return pc.ascii_split_whitespace(pc.if_else(pc.equal(given, ""), None, given))


def numbered(texts: Iterable[str | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words of texts, the number of each word of all texts in order, and words of each text."""
    lists = word_lists(texts)
    chunks = lists.flatten().dictionary_encode()
    distinct = chunks.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return distinct, chunks.indices.to_numpy().astype(np.int64), sizes


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, in text order; shorter texts give one for the whole, none for no words."""
    if len(hashes) == 0:
        return hashes
    width = min(n, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k:k + count])
    return out


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts, from a scan of that column alone."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
