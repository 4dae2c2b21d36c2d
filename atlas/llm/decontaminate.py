"""Benchmark decontamination by SimHash windows of the items' own sizes.

Every document is read as windows as long as an item, at every word.  Windows that hold too few of
the benchmark's shingles to be similar to any item need no fingerprint; the others get a 64-bit
SimHash of their five-word shingles.  Fingerprints alone propose which item a window is: those within
the item's radius.  Each is then verified by the exact weighted Jaccard similarity of shingles, a
shingle's weight in a text being its number of occurrences.

The radius follows from the weights.  Of texts similar by 0.8 the sums behind two fingerprints agree by
at least what is left when the item loses its heaviest shingles; that agreement is an angle, which gives
the share of bits to differ, and ``SIGMAS`` deviations are added.  Fingerprints of items of one size are
indexed by blocks of bits, one more than the widest radius there: within it two of them agree in a block
at least, so the index finds them all.  A window that repeats shingles lies further off than the index
reaches, and is compared with the fingerprints of all items of its size.  ``exact`` proposes also what
holds enough shingles of an item, whatever the fingerprint, so that nothing can be missed.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import Hashes, free_name, mix, shingles, text_bytes, words

#: ``RADIUS`` is the least; items have wider ones of their own.
WORDS, SIMILAR, RADIUS, SIGMAS = 5, 0.8, 15, 4
#: How far the squared weights of a window may exceed those of plain text, for the index to reach it.
PLAIN = 1.25
PUNCTUATION = b".,!?:;\"'()[]{}<>*_-"
#: Bytes of benchmark text that one pass over the documents takes along; bounds what is broadcast.
PASS_BYTES = 8 << 20
MATCH = "array<struct<item_id: long, start: long, words: long, similarity: double>>"


_hashes = Hashes(PUNCTUATION)


def hashes(text: str | None) -> np.ndarray:
    """Hash of every lower-cased word without punctuation around it; words of punctuation alone are left out."""
    out = _hashes.of(words(text.lower()) if text else [])
    return out[out != 0]


def simhash(shingled: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of the windows of ``width`` shingles that begin at ``starts``."""
    low, high = int(starts.min()), int(starts.max()) + width
    bits = np.unpackbits(mix(shingled[low:high]).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    total = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = total[starts - low + width] - total[starts - low]
    return np.packbits(2 * ones >= width, axis=1).view(np.uint64).ravel()


def weights(shingled: np.ndarray) -> dict[int, int]:
    return dict(zip(*(x.tolist() for x in np.unique(shingled, return_counts=True))))


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """Weighted Jaccard similarity."""
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def reach(shared: float, own: float, other: float) -> int:
    """Bits by which two fingerprints may differ, given the product of two weight vectors and their squares."""
    share = math.acos(min(1.0, shared / math.sqrt(own * other))) / math.pi
    return min(64, math.ceil(64 * share + SIGMAS * math.sqrt(64 * share * (1 - share))))


class Index:
    """Items by size, their shingles, and their fingerprints by blocks."""

    def __init__(self, items: list[tuple[int, str]], radius: int, similar: float, n: int, exact: bool = False):
        self.radius, self.similar, self.n, self.exact = radius, similar, n, exact
        #: By item: least product with a similar text, own squared weights, squared weights of a plain similar text.
        self.products: list[tuple[int, int, int]] = []
        self.ids, self.weights, self.prints, self.sizes_of = [], [], [], []
        #: By size: the widest radius, edges of blocks, items by the bits of each block, all items.
        self.sizes: dict[int, tuple[int, np.ndarray, list[dict], list[int]]] = {}
        shingled, members = [], defaultdict(list)
        for item, text in items:
            words_of = hashes(text)
            if len(words_of) == 0:
                continue
            own = shingles(words_of, n)
            at, size = len(self.ids), len(words_of)
            self.ids.append(item)
            self.weights.append(weights(own))
            self.sizes_of.append(size)
            self.prints.append(simhash(own, np.array([0]), len(own))[0])
            shingled.append(own)
            self.products.append(self._product(self.weights[-1]))
            members[size].append(at)
        for size, own in members.items():
            widest = max(radius, *(reach(shared, a, PLAIN * plain) for shared, a, plain in (self.products[at] for at in own)))
            edges = np.linspace(0, 64, min(widest, 63) + 2).astype(int)
            blocks = [defaultdict(list) for _ in edges[1:]]
            for at in own:
                for table, key in zip(blocks, self.keys(int(self.prints[at]), edges)):
                    table[key].append(at)
            self.sizes[size] = widest, edges, blocks, own
        self.prints = np.array(self.prints, np.uint64)
        self.lengths = [sum(w.values()) for w in self.weights]
        self.shingles = [np.array(list(w), np.uint64) for w in self.weights]
        self.owners: dict[int, list[int]] = defaultdict(list)
        for at, own in enumerate(self.weights):
            for shingle in own:
                self.owners[shingle].append(at)
        self.widths = sorted({min(n, size) for size in self.sizes})
        self.known = np.unique(np.concatenate(shingled)) if shingled else np.array([], np.uint64)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.known & np.uint64((1 << 20) - 1)] = True

    def _product(self, weights_of: dict[int, int]) -> tuple[int, int, int]:
        total = sum(weights_of.values())
        lost = rest = math.floor(total * (1 - self.similar) / (1 + self.similar) + 1e-9)
        shared = plain = 0
        for weight in sorted(weights_of.values(), reverse=True):
            left = weight - min(weight, rest)
            rest -= weight - left
            shared, plain = shared + weight * left, plain + left * left
        return max(shared, 1), sum(w * w for w in weights_of.values()), max(plain + lost, 1)

    def keys(self, fingerprint: int, edges: np.ndarray) -> list[int]:
        return [fingerprint >> int(a) & (1 << int(b - a)) - 1 for a, b in zip(edges, edges[1:])]

    def proposed(self, size: int, fingerprint: int, squares: int) -> set[int]:
        """Items of a size whose fingerprint lies within their radius of a window's with such squared weights."""
        widest, edges, blocks, own = self.sizes[size]
        radius = {i: max(self.radius, reach(*self.products[i][:2], squares)) for i in own}
        if max(radius.values()) <= widest:
            own = {i for table, key in zip(blocks, self.keys(fingerprint, edges)) for i in table.get(key, ())}
        return {i for i in own if (int(self.prints[i]) ^ fingerprint).bit_count() <= radius[i]}

    def holds(self, shingled: np.ndarray) -> np.ndarray:
        """Which shingles occur in the benchmark."""
        maybe = self.seen[shingled & np.uint64((1 << 20) - 1)]
        at = np.flatnonzero(maybe)
        if len(at):
            place = np.searchsorted(self.known, shingled[at])
            maybe[at] = self.known[np.minimum(place, len(self.known) - 1)] == shingled[at]
        return maybe

    def matches(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """Item, start in words, words and similarity of each item's best window in a text."""
        own, best = hashes(text), {}
        if len(own) == 0:
            return []
        cache = {}
        for width in self.widths:
            shingled = shingles(own, width)
            held = self.holds(shingled)
            met = Counter(i for h in shingled[held].tolist() for i in self.owners[h])
            # items, by window size, whose shingles could fill a window
            sizes = defaultdict(list)
            for i, n in met.items():
                if n >= self.similar * self.lengths[i] - 1e-9:
                    sizes[self.sizes_of[i]].append(i)
            cache[width] = shingled, np.concatenate([[0], np.cumsum(held)]), sizes
        for size in self.sizes:
            shingled, held, sizes = cache[min(self.n, size)]
            if size not in sizes:
                continue
            span = min(size - min(self.n, size) + 1, len(shingled))
            enough = np.flatnonzero(held[span:] - held[:-span] >= self.similar * (size - min(self.n, size) + 1) - 1e-9)
            if len(enough):
                self._compare(shingled, enough, span, size, min(size, len(own)), sizes[size], best)
        return [(self.ids[i], start, count, score) for i, (score, start, count) in sorted(best.items())]

    def _compare(self, shingled, starts, span, size, count, items, best) -> None:
        enough: dict[int, set[int]] = defaultdict(set)
        for i in items if self.exact else ():
            held = np.concatenate([[0], np.cumsum(np.isin(shingled, self.shingles[i]))])
            for start in starts[held[starts + span] - held[starts] >= self.similar * self.lengths[i] - 1e-9].tolist():
                enough[start].add(i)
        for start, fingerprint in zip(starts.tolist(), simhash(shingled, starts, span).tolist()):
            window = weights(shingled[start:start + span])
            for i in self.proposed(size, fingerprint, sum(w * w for w in window.values())) | enough.get(start, set()):
                score = similarity(window, self.weights[i])
                if score >= self.similar and (i not in best or score > best[i][0]):
                    best[i] = (score, start, count)


def searcher(index: Broadcast):
    """Column function from a text to its matches."""
    @F.pandas_udf(MATCH)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("item_id", "start", "words", "similarity")
        for part in texts:
            yield pd.Series([[dict(zip(names, m)) for m in index.value.matches(t)] for t in part])

    return search


def leaks(docs: DataFrame, benchmark: DataFrame, radius: int = RADIUS, similar: float = SIMILAR,
          n: int = WORDS, pass_bytes: int = PASS_BYTES, into: str = "leaks", exact: bool = False) -> DataFrame:
    """``docs`` with ``leaks`` (or a column named ``into``), an array of (item_id, start, words, similarity): items found in the text.

    Words are lower-cased and stripped of punctuation.  Per item the most similar window
    counts, of equal ones the first.  NULL and empty texts hold nothing; NULL or empty items are
    never found; items shorter than ``n`` words are one shingle of all their words; a document
    shorter than an item is compared as a whole.  Repeated rows and repeated items each count.  An
    existing column of that name is replaced; an empty table gives no rows.  A benchmark beyond
    ``pass_bytes`` is taken in several passes of that size at most on average.  ``radius`` is the least by
    which fingerprints may differ; with ``exact`` windows beyond an item's radius are verified too.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    passes = max(1, -(-text_bytes(items) // pass_bytes))
    found = docs.withColumn(into, F.array().cast(MATCH))
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(passes)) == k) if passes > 1 else items
        given = [tuple(r) for r in own.where("item_id IS NOT NULL").orderBy("item_id", "text").collect()]
        index = spark.sparkContext.broadcast(Index(given, radius, similar, n, exact))
        found = found.withColumn(into, F.concat(into, searcher(index)(F.col("text").cast("string"))))
    return found


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents in which no item of the benchmark is found, with their own columns, whatever these are called.

    NULL and empty texts stay, as do all rows where the benchmark is empty; repeated rows are judged alike.
    """
    into = free_name(docs, "leaks")
    return leaks(docs, benchmark, into=into).where(F.size(into) == 0).select(*docs.columns)
