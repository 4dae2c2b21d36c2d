"""Language-model scores from a log-frequency Bloom filter.

N-gram counts are quantised to levels that grow by a constant ratio.  An n-gram of level q is put
into a Bloom filter q times, with the numbers 1 to q; probing 1, 2, ... until one is missing reads
the level back.  A wrong answer can only be too high, and rarely by more than one level.  The filter
has room for all n-grams of training, whatever their number, and is built in pieces by Spark.  As
many pieces as ``GROUP_BYTES`` holds are broadcast at a time: a filter beyond that takes a pass over
the texts for each group of pieces, which notes the levels found there by position.

The model interpolates: each n-gram's share among those of its context, weighted by how often
n-grams of contexts that frequent come again, and the rest by the next shorter n-gram.  Words never
seen get the chance that the unigram estimate leaves for them.

How often exactly each token occurs, for the plain unigram score, comes from a join: counts of the
commonest words, a fixed number, are broadcast, and all other words meet their counts by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import arrow_rows, mix, numbered, word_lists
from atlas.session import stage

#: The token after the last word; no word holds a space.
END = b" end"
#: Least bytes of the filter, which grows with its entries, and bytes of it that are broadcast at a time.
FILTER_BYTES, GROUP_BYTES = 16 << 20, 256 << 20
#: Occurrences of n-grams that are counted together, on average.
BUCKET_TOKENS = 1 << 20
#: Bytes of a piece, in which all probes of an n-gram lie.
PIECE_BYTES = 1 << 16
#: Probes for each number, bits for each entry, ratio of levels.
PROBES, ENTRY_BITS, RATIO = 5, 9, 1.25
#: Words whose counts are broadcast.
COMMON = 65_536
#: Tokens of one packet of counts.
PACKET_TOKENS = 500_000
#: Documents whose n-grams are looked up together, and that are handed to a worker and whose words are counted together.
BATCH, TALLY = 1000, 2000
#: Levels: the count that each stands for; small counts have one each.
LEVELS = np.unique(np.concatenate([np.arange(1, 5), np.floor(4 * RATIO ** np.arange(1, 160))])).astype(np.int64)


def level_of(counts: np.ndarray) -> np.ndarray:
    """Number of the largest level that is at most the count; 0 for none."""
    return np.searchsorted(LEVELS, counts, side="right").astype(np.int64)


def tokens(texts: pd.Series | pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words and the end (last), the number of each token of all texts, tokens of each text."""
    distinct, codes, sizes = numbered(texts)
    return [*distinct, END], np.insert(codes, np.cumsum(sizes), len(distinct)), sizes + 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every token."""
    return mix(hash_array(np.array([*words, b""], object)[:-1], categorize=False))


def gram(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a context and the word after it."""
    return mix(context * np.uint64(0x9E3779B97F4A7C15) + word)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Which of equally wide ranges of hashes each lies in; sorted hashes meet the ranges in order."""
    return (((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


@dataclass
class Filter:
    """Bits of a filter or of some pieces of it, and what is known of contexts by level."""

    bits: np.ndarray  # of bytes
    repeat: np.ndarray  # by level of the context's count: share of n-grams that come again
    total: int
    distinct: int
    unseen: float
    first: int = 0  # piece that ``bits`` begins with
    of: int = 0  # pieces of the whole filter; 0: ``bits`` is the whole

    def pieces(self) -> int:
        return self.of or len(self.bits) // PIECE_BYTES

    def holds(self, grams: np.ndarray) -> np.ndarray:
        """Which n-grams lie in the pieces at hand."""
        piece = part_of(grams, self.pieces()) - self.first
        return (piece >= 0) & (piece < len(self.bits) // PIECE_BYTES)

    def level(self, grams: np.ndarray) -> np.ndarray:
        """Levels read back by probing until a number is missing; 0 in pieces that are not at hand."""
        out = np.zeros(len(grams), np.int64)
        active, number = np.flatnonzero(self.holds(grams)) if self.of else np.arange(len(grams)), 1
        start = (part_of(grams[active], self.pieces()) - self.first) * (PIECE_BYTES * 8)
        while len(active) and number <= len(LEVELS):
            first, step = probes(grams[active], number)
            # the first bit alone tells most of those that are missing
            hit = np.flatnonzero(self.bit(start + place(first, step, 0)))
            active, start, first, step = active[hit], start[hit], first[hit], step[hit]
            hit = np.ones(len(active), bool)
            for k in range(1, PROBES):
                hit &= self.bit(start + place(first, step, k))
            active, start = active[hit], start[hit]
            out[active] = number
            number += 1
        return out

    def bit(self, at: np.ndarray) -> np.ndarray:
        return (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """Levels of n-grams that may repeat."""
        found, back = np.unique(grams, return_inverse=True)
        return self.level(found)[back]


def count_of(levels: np.ndarray) -> np.ndarray:
    """Count that a level stands for; 0 for level 0."""
    return np.where(levels > 0, LEVELS[np.maximum(levels, 1) - 1], 0)


def probes(grams: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """What the bits of each n-gram for a number follow from."""
    first = mix(grams + np.uint64(number * 0xD6E8FEB86659FD93 % (1 << 64)))
    return first, (first >> np.uint64(32)) | np.uint64(1)


def place(first: np.ndarray, step: np.ndarray, probe: int) -> np.ndarray:
    """Bit of a probe within the piece, whose bits are a power of two."""
    return ((first + step * np.uint64(probe)) & np.uint64(PIECE_BYTES * 8 - 1)).astype(np.int64)


def fill(piece_bits: np.ndarray, grams: np.ndarray, levels: np.ndarray, pieces: int) -> None:
    """Enter n-grams of one of ``pieces``, all the same to it, with the numbers up to their levels."""
    for number in range(1, int(levels.max(initial=0)) + 1):
        first, step = probes(grams[levels >= number], number)
        for k in range(PROBES):
            at = place(first, step, k)
            np.bitwise_or.at(piece_bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Smaller parts of batches; memory that one part took is given back before the next."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            # a copy: Arrow's string functions misread slices
            yield batch.take(pa.array(np.arange(at, min(at + rows, len(batch)))))
            pa.default_memory_pool().release_unused()


def text_of(batch: pa.RecordBatch) -> pa.Array:
    return batch.column("text").cast(pa.large_string())


def packets(docs: DataFrame, make, buckets: int) -> DataFrame:
    """Counts of n-grams by bucket: keys, counts, and level of the context, packed.

    ``make`` turns a batch of texts into n-grams and the levels of their contexts.  A task sends one packet a
    bucket for every ``PACKET_TOKENS`` tokens, so what is shuffled grows with the text and a hot
    n-gram is counted once a packet.
    """
    names = ["bucket", "keys", "counts", "levels"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            grams, levels = (np.concatenate(x) for x in zip(*held))
            keys, first, counts = np.unique(grams, return_index=True, return_counts=True)
            levels = levels[first]
            bucket = part_of(keys, buckets)  # in ascending order, as keys are
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            parts = [np.split(x, cuts) for x in (keys, counts.astype(np.uint32), levels)]
            columns = [pa.array([x.tobytes() for x in part][:len(bucket)], pa.binary()) for part in parts]
            return pa.RecordBatch.from_arrays([pa.array(bucket[np.insert(cuts, 0, 0)] if len(bucket) else bucket, pa.int32()), *columns], names)

        for batch in slices(batches, BATCH):
            held.append(make(text_of(batch)))
            size += len(held[-1][0])
            if size >= PACKET_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(count, "bucket int, keys binary, counts binary, levels binary")


def merged(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, summed counts and context levels of packets of one bucket."""
    keys = np.frombuffer(b"".join(part["keys"]), np.uint64)
    counts = np.frombuffer(b"".join(part["counts"]), np.uint32).astype(np.int64)
    levels = np.frombuffer(b"".join(part["levels"]), np.uint8)
    found, first, back = np.unique(keys, return_index=True, return_inverse=True)
    return found, np.bincount(back, counts, len(found)).astype(np.int64), levels[first]


def total_counts(packed: DataFrame) -> DataFrame:
    """A row for each bucket: keys and levels, and statistics.

    ``entries`` holds how many filter entries n-grams of each level make, ``tokens`` and ``once``
    occurrences and n-grams that occur once, by level of the context.
    """
    def add(part: pd.DataFrame) -> pd.DataFrame:
        keys, counts, context = merged(part)
        levels = level_of(counts)
        size = len(LEVELS) + 1
        return pd.DataFrame({
            "bucket": part["bucket"].iloc[:1], "keys": [keys.tobytes()], "levels": [levels.astype(np.uint8).tobytes()],
            "entries": [np.bincount(levels, levels, size)], "tokens": [np.bincount(context, counts, size)],
            "once": [np.bincount(context, counts == 1, size)]})

    return packed.groupBy("bucket").applyInPandas(
        add, "bucket int, keys binary, levels binary, entries array<double>, tokens array<double>, once array<double>")


def buckets_for(least: int, occurrences: int) -> int:
    return max(1, least, -(-occurrences // BUCKET_TOKENS))


def share_of(entries: np.ndarray, buckets: int) -> int:
    """Pieces of each bucket, so that the filter has room for all entries: at least one, as n-grams of one piece are of one bucket."""
    return max(1, math.ceil(entries.sum() * ENTRY_BITS / 8 / PIECE_BYTES / buckets))


def pieces_of(bucket: int, keys: bytes, levels: bytes, share: int, pieces: int) -> Iterator[pd.DataFrame]:
    """``piece`` and ``bits`` of one bucket, a piece at a time."""
    grams, level = np.frombuffer(keys, np.uint64), np.frombuffer(levels, np.uint8).astype(np.int64)
    piece = part_of(grams, pieces)
    for k in range(bucket * share, (bucket + 1) * share):
        bits, own = np.zeros(PIECE_BYTES, np.uint8), piece == k
        fill(bits, grams[own], level[own], pieces)
        yield pd.DataFrame({"piece": [k], "bits": [bits.tobytes()]})


def groups(pieces: int, group_bytes: int) -> list[tuple[int, int]]:
    """First piece of each group that is broadcast together, and the one after its last."""
    size = max(1, group_bytes // PIECE_BYTES)
    return [(k, min(k + size, pieces)) for k in range(0, pieces, size)]


def read_pieces(made: DataFrame, first: int, end: int) -> np.ndarray:
    """Bits of some pieces; buckets without n-grams have none."""
    out = np.zeros((end - first) * PIECE_BYTES, np.uint8)
    for piece, bits in made.where(F.col("piece").between(first, end - 1)).toLocalIterator():
        out[(piece - first) * PIECE_BYTES:(piece - first + 1) * PIECE_BYTES] = np.frombuffer(bits, np.uint8)
    return out


def statistics(frame: DataFrame, *names: str) -> list[np.ndarray]:
    """Sums of array columns over all rows; the arrays have one value a level."""
    sums = frame.select(F.posexplode(F.arrays_zip(*names)).alias("at", "x")).groupBy("at").agg(
        *[F.sum(f"x.{n}").alias(n) for n in names]).collect()
    out = [np.zeros(len(LEVELS) + 1) for _ in names]
    for row in sums:
        for k, name in enumerate(names):
            out[k][row["at"]] = row[name] or 0
    return out


@dataclass
class Model:
    """The filter's two parts as tables of pieces, and what is known of contexts by level."""

    words: DataFrame
    word_pieces: int
    pairs: DataFrame
    pair_pieces: int
    repeat: np.ndarray
    total: int
    distinct: int
    unseen: float

    def part(self, kind: str, first: int, end: int) -> Filter:
        made, pieces = (self.words, self.word_pieces) if kind == "words" else (self.pairs, self.pair_pieces)
        whole = (first, end) == (0, pieces)
        return Filter(read_pieces(made, first, end), self.repeat, self.total, self.distinct, self.unseen, first, 0 if whole else pieces)


def train(docs: DataFrame, filter_bytes: int = FILTER_BYTES, group_bytes: int = GROUP_BYTES) -> tuple[Model, DataFrame]:
    """The model, and exact counts of all tokens (``word``, ``count``), of the texts of ``docs``.

    All words and all pairs of words are entered, those that occur once too.  The filter has
    ``filter_bytes`` at least.  Where its words exceed ``group_bytes``, pairs are counted in a pass
    for each group of words that they begin with.
    """
    spark = docs.sparkSession

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, TALLY):
            found = word_lists(text_of(batch)).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["word", "count"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([len(batch)])], ["word", "count"])

    counts = stage(docs.select("text").mapInArrow(tally, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count")), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()

    least = max(4, filter_bytes // PIECE_BYTES)
    word_buckets, pair_buckets = buckets_for(least // 4, distinct), buckets_for(least - least // 4, total)

    def hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keys = word_hashes(list(frame["word"]))
            levels = level_of(frame["count"].to_numpy(np.int64))
            bucket = part_of(keys, word_buckets)
            order = np.argsort(bucket, kind="stable")
            keys, levels, bucket = keys[order], levels[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            own = np.split(levels, cuts)
            yield pd.DataFrame({"bucket": bucket[np.insert(cuts, 0, 0)] if len(bucket) else bucket,
                                "keys": [x.tobytes() for x in np.split(keys, cuts)][:len(bucket)],
                                "levels": [x.astype(np.uint8).tobytes() for x in own][:len(bucket)],
                                "entries": [np.bincount(x, x, len(LEVELS) + 1) for x in own][:len(bucket)]})

    rows = stage(counts.mapInPandas(hashed, "bucket int, keys binary, levels binary, entries array<double>"), "words")
    (entries,) = statistics(rows, "entries")
    share = share_of(entries, word_buckets)
    word_pieces = word_buckets * share

    # one Python step a stage: a second one doubles the workers that later steps use in turn
    def enter_words(part: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(pieces_of(part["bucket"].iloc[0], b"".join(part["keys"]), b"".join(part["levels"]), share, word_pieces))

    words = stage(rows.groupBy("bucket").applyInPandas(enter_words, "piece int, bits binary"), "filter")
    unseen = 0.5 / (total + 0.5 * (distinct + 1))
    model = Model(words, word_pieces, words, word_pieces, np.zeros(len(LEVELS) + 1), total, distinct, unseen)

    def pairs_in(shared):
        def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            distinct, codes, sizes = tokens(texts)
            hashes, ends = word_hashes(distinct), np.cumsum(sizes)
            before, after = np.delete(codes, ends - 1), np.delete(codes, ends - sizes)
            if shared.value.of:
                own = shared.value.holds(hashes)[before]
                before, after = before[own], after[own]
            return gram(hashes[before], hashes[after]), shared.value.level(hashes).astype(np.uint8)[before]
        return pairs

    parts = groups(word_pieces, group_bytes)
    packed = None
    for first, end in parts:
        shared = spark.sparkContext.broadcast(model.part("words", first, end))
        own = packets(docs, pairs_in(shared), pair_buckets)
        if len(parts) > 1:
            own = stage(own, "packets")
            shared.unpersist()
        packed = packed.union(own) if packed is not None else own
    pairs_of = stage(total_counts(packed), "pairs")
    entries, seen, once = statistics(pairs_of, "entries", "tokens", "once")
    pair_share = share_of(entries, pair_buckets)
    pair_pieces = pair_buckets * pair_share

    def enter_pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for bucket, keys, levels in zip(frame["bucket"], frame["keys"], frame["levels"]):
                yield from pieces_of(bucket, keys, levels, pair_share, pair_pieces)

    model.pairs = stage(pairs_of.select("bucket", "keys", "levels").mapInPandas(enter_pairs, "piece int, bits binary"), "filter")
    model.pair_pieces = pair_pieces
    # contexts of one level: the share of pairs that come again; levels without pairs have none
    model.repeat = np.clip(1 - once / np.maximum(seen, 1), 0, 0.95)
    return model, counts


class Scorer:
    """Log10 probability of texts from levels of words and pairs."""

    def __init__(self, repeat: np.ndarray, unseen: float):
        level = np.arange(len(LEVELS) + 1)
        self.counts = count_of(level)
        self.single = (self.counts + 0.5) * 2 * unseen
        self.repeat = np.where(level > 0, repeat, 0)
        # counts are read as the least that a level stands for, contexts as the least of the next
        self.room = np.where(self.counts > 4, LEVELS[np.minimum(level, len(LEVELS) - 1)], np.maximum(self.counts, 1))

    def score(self, words: np.ndarray, pairs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of texts given by levels of each token and of the pair that it ends, and where texts start.

        Each position is given the one before it, the first of a text nothing.
        """
        context = np.roll(words, 1)
        context[starts] = 0
        repeat = self.repeat[context]
        chance = repeat * np.minimum(self.counts[pairs] / self.room[context], 1) + (1 - repeat) * self.single[words]
        return np.add.reduceat(np.log10(chance), starts)


def levels_at(part: Filter, kind: str, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, words: np.ndarray | None = None) -> np.ndarray:
    """Level of each token's word, or of the pair that it ends, as far as it lies in the pieces at hand.

    Texts are given by hashes of distinct tokens and the number of each token.  With levels of
    ``words``, pairs after words that occur once are left out: nothing comes again after these.
    """
    if kind == "words":
        return part.level(hashes)[codes]
    asked = np.ones(len(codes), bool) if words is None else np.roll(words, 1) > 1
    asked[starts] = False
    at, out = np.flatnonzero(asked), np.zeros(len(codes), np.int64)
    out[at] = part.levels(gram(hashes[codes[at - 1]], hashes[codes[at]]))
    return out


def scores_by_group(texts: DataFrame, model: Model, group_bytes: int) -> DataFrame:
    """``_i`` and ``score`` of texts with row numbers ``i``, by a pass for each group of pieces."""
    def search(shared, kind: str):
        def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                for at in range(0, len(frame), BATCH):
                    part = frame.iloc[at:at + BATCH]
                    named, codes, sizes = tokens(part["text"])
                    cuts = np.cumsum(sizes)
                    level = levels_at(shared.value, kind, word_hashes(named), codes, cuts - sizes).astype(np.uint8)
                    yield pd.DataFrame({"i": part["i"].array, "kind": kind, "levels": [x.tobytes() for x in np.split(level, cuts[:-1])]})
        return probe

    noted = None
    for kind, pieces in (("words", model.word_pieces), ("pairs", model.pair_pieces)):
        for first, end in groups(pieces, group_bytes):
            shared = texts.sparkSession.sparkContext.broadcast(model.part(kind, first, end))
            own = stage(texts.select("i", "text").mapInPandas(search(shared, kind), "i long, kind string, levels binary"), "levels")
            shared.unpersist()
            noted = noted.union(own) if noted is not None else own
    repeat, unseen = model.repeat, model.unseen

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(repeat, unseen)
        for frame in frames:
            # every position lies in one group, elsewhere it is 0
            whole = {k: [np.maximum.reduce([np.frombuffer(x, np.uint8) for x in parts]) for parts in frame[k]] for k in ("words", "pairs")}
            sizes = np.array([len(x) for x in whole["words"]], np.int64)
            if len(sizes):
                words, pairs = (np.concatenate(whole[k]).astype(np.int64) for k in ("words", "pairs"))
                yield pd.DataFrame({"_i": frame["i"].array, "score": scorer.score(words, pairs, np.cumsum(sizes) - sizes)})

    of = lambda kind: F.collect_list(F.when(F.col("kind") == kind, F.col("levels"))).alias(kind)
    return noted.groupBy("i").agg(of("words"), of("pairs")).mapInPandas(finish, "_i long, score double")


def score(docs: DataFrame, learn, filter_bytes: int = FILTER_BYTES, common: int = COMMON, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Scores of every document from the texts that ``learn`` (a condition) lets the model learn from.

    ``doc_id``, ``n_tokens`` (words and one end), ``n_known`` (seen in training), ``train_tokens``,
    ``base_score`` (unigrams, one half added) and ``score`` (the model), both log10.  A NULL text is
    empty.  Each row is a document of its own, whatever its id.  Without training texts all words
    are unseen.  An empty table gives no rows; other columns are ignored.  A filter beyond
    ``group_bytes`` gives the same scores in several passes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    with arrow_rows(spark, TALLY):
        model, counts = train(texts.where(learn), filter_bytes, group_bytes)
    at_once = (model.word_pieces + model.pair_pieces) * PIECE_BYTES <= group_bytes
    whole = (model.part("words", 0, model.word_pieces), model.part("pairs", 0, model.pair_pieces)) if at_once else None
    texts = texts.withColumn("i", F.monotonically_increasing_id())
    if not at_once:
        texts = stage(texts, "texts")
    top = counts.orderBy(F.desc("count"), "word").limit(common).collect()
    shared = spark.sparkContext.broadcast((whole, [bytes(w) for w, _ in top], np.array([*(math.log10(c + 0.5) for _, c in top), np.nan])))
    repeat, unseen = model.repeat, model.unseen
    log_total = math.log10(model.total + 0.5 * (model.distinct + 1))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, frequent, logs = shared.value  # the last of the logs is for words that are not common
        frequent, scorer = pa.array(frequent, pa.binary()), Scorer(repeat, unseen)
        for part in slices(batches, BATCH):
            named, back, sizes = tokens(text_of(part))
            starts = np.cumsum(sizes) - sizes
            names = pa.array(named, pa.binary())
            log = logs[pc.index_in(names, value_set=frequent).fill_null(-1).to_numpy(zero_copy_only=False)]
            is_rare = np.isnan(log)
            # words that are not common, once a document
            at_rare = np.flatnonzero(is_rare[back])
            doc = np.repeat(np.arange(len(part)), sizes)[at_rare]
            pair, times = np.unique(doc * len(named) + back[at_rare], return_counts=True)
            cuts = pa.array(np.searchsorted(pair // len(named), np.arange(len(part) + 1)), pa.int32())
            rare = pa.ListArray.from_arrays(cuts, names.take(pa.array(pair % len(named))))
            found = np.full(len(part), np.nan)
            if whole:
                hashes = word_hashes(named)
                levels = levels_at(whole[0], "words", hashes, back, starts)
                found = scorer.score(levels, levels_at(whole[1], "pairs", hashes, back, starts, levels), starts)
            yield pa.RecordBatch.from_arrays([
                part.column("i"), part.column("doc_id"), pa.array(sizes), pa.array(np.add.reduceat(~is_rare[back], starts, dtype=np.int64)),
                pa.array(np.add.reduceat(np.where(is_rare, 0, log)[back], starts)), pa.array(found), rare,
                pa.ListArray.from_arrays(cuts, pa.array(times))], ["i", "doc_id", "n_tokens", "known", "base", "score", "rare", "times"])

    with arrow_rows(spark, TALLY):
        rows = stage(texts.mapInArrow(read, "i long, doc_id long, n_tokens long, known long, base double, score double, "
                                             "rare array<binary>, times array<long>"), "scored")
    if not at_once:
        rows = rows.drop("score").join(scores_by_group(texts, model, group_bytes), F.col("i") == F.col("_i")).drop("_i")
    pairs = rows.select("i", F.posexplode("rare").alias("at", "word"), "times").select(
        "i", "word", F.get("times", F.col("at")).alias("n"))
    met = (pairs.join(counts, "word").groupBy("i").agg(
        F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("count") + 0.5)).alias("logs"))).withColumnRenamed("i", "_i")
    joined = rows.drop("rare", "times").join(met, F.col("i") == F.col("_i"), "left")
    n_known = F.col("known") + F.coalesce("more", F.lit(0))
    unknown = (F.col("n_tokens") - n_known) * math.log10(0.5)
    return joined.select(
        "doc_id", "n_tokens", n_known.alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0)) + unknown - F.col("n_tokens") * log_total).alias("base_score"), "score")
