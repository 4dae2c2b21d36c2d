"""Ranked lexical search without random access (NRA).

Documents are dealt into shards.  A shard holds, for every term of the items, its documents sorted by
what the term adds to their scores.  These lists are only read from the front.  A document seen in some
of an item's lists has a lower bound (what was read) and an upper bound (with the next unread value of
every other list).  Reading goes on until no unseen document and no candidate outside the result can
reach the last place or tie with it, and until both bounds of every document left are equal.  The best
of all shards are then ranked once more.

Document frequencies, the number of documents and their lengths cover the whole table.  Items are taken
in blocks of bounded size, so that what is broadcast (an item block's terms and weights) is bounded too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atlas.session import stage

#: Bytes that belong to terms, A-Z lowered; all others are spaces.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
#: Entries of one shard's lists, term entries of one block of items, and the first depth read.
SHARD_ENTRIES, BLOCK_TERMS, DEPTH = 2_000_000, 300_000, 256
#: Parts in which the shards' results of one item are ranked first.
SALTS = 64


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(TERM_BYTES).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and its distinct ``terms``; rows of one item count as one text."""
    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, t) for i, text in zip(frame["item_id"].astype("Int64"), frame["text"]) for t in dict.fromkeys(terms(text))]
            yield pd.DataFrame(rows, columns=["item_id", "term"]).astype({"item_id": "Int64"})

    flat = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInPandas(split, "item_id long, term binary")
    return flat.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def postings(docs: DataFrame, ids) -> DataFrame:
    """``doc_id``, the number ``n`` of all its terms, and numbers and counts of the terms in ``ids`` (broadcast)."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ids.value
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].astype("Int64"), frame["text"]):
                found = terms(text)
                own = Counter(found)
                both = known.keys() & own.keys()
                rows.append((doc, len(found), np.array([known[t] for t in both], np.int32).tobytes(),
                             np.array([own[t] for t in both], np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["doc_id", "n", "terms", "counts"]).astype({"doc_id": "Int64"})

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(count, "doc_id long, n long, terms binary, counts binary")


def frequencies(entries: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term, counted in tasks and summed."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(size, np.int64)
        for frame in frames:
            total += np.bincount(np.frombuffer(b"".join(frame["terms"]), np.int32), minlength=size)
        held = np.flatnonzero(total)
        yield pd.DataFrame({"term": held.astype(np.int32), "df": total[held]})

    out = np.zeros(size, np.int64)
    for term, df in entries.select("terms").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[term] = df
    return out


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, frames: list[pd.DataFrame], weights: np.ndarray, documents: int, length: int):
        self.ids = pd.concat([f["doc_id"].astype("Int64") for f in frames], ignore_index=True)
        sizes = np.concatenate([f["n"].to_numpy(np.int64) for f in frames])
        held = [np.frombuffer(t, np.int32) for f in frames for t in f["terms"]]
        counts = np.concatenate([np.frombuffer(c, np.int32) for f in frames for c in f["counts"]]).astype(np.int64)
        doc = np.repeat(np.arange(len(held), dtype=np.int32), [len(t) for t in held])
        term = np.concatenate(held)
        short = 100 - 90 + (90 * sizes * documents) // max(length, 1)
        impact = weights[term] * ((1_000_000_000 * counts) // (1000 * counts + 8 * short[doc]))
        order = np.lexsort((-impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(len(weights) + 1))
        #: place of every document by id, NULL first, for ties
        self.order = np.argsort(np.argsort(self.ids.fillna(np.iinfo(np.int64).min).to_numpy(np.int64), kind="stable"))

    def search(self, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and exact scores of the best ``top``, by sequential reads of the lists of terms ``own``."""
        begin, end = self.starts[own], self.starts[own + 1]
        at, depth = begin.copy(), DEPTH
        lower = np.zeros(len(self.ids), np.int64)
        unseen = np.ones((len(own), len(self.ids)), bool)
        alive, open_to_all = np.zeros(0, np.int64), True
        while True:
            for k in np.flatnonzero(at < end):
                if not open_to_all and not unseen[k, alive].any():
                    continue  # all that is left was met in this list
                stop = min(at[k] + depth, end[k])
                docs = self.doc[at[k]:stop]
                lower[docs] += self.impact[at[k]:stop]
                unseen[k, docs] = False
                at[k] = stop
            depth *= 2
            front = np.where(at < end, self.impact[np.minimum(at, len(self.impact) - 1)], 0) if len(self.impact) else np.zeros(len(own), np.int64)
            if open_to_all:
                alive = np.flatnonzero(lower)
            bound = np.partition(lower[alive], -top)[-top] if len(alive) >= top else 0
            upper = lower[alive] + front @ unseen[:, alive]
            stays = upper >= bound
            alive, upper = alive[stays], upper[stays]
            rest = front.sum()
            open_to_all = open_to_all and rest > 0 and rest >= bound
            if not open_to_all and (upper == lower[alive]).all():
                best = alive[np.lexsort((self.order[alive], -lower[alive]))[:top]]
                return best, lower[best]


def search_block(docs: DataFrame, queries: list[tuple[int | None, list[bytes]]], top: int, shard_entries: int) -> DataFrame:
    """The best documents (``item_id``, ``doc_id``, ``score``) of every shard for the items of one block."""
    spark = docs.sparkSession
    numbers = {t: k for k, t in enumerate(sorted({t for _, own in queries for t in own}))}
    entries = stage(postings(docs, spark.sparkContext.broadcast(numbers)), "entries")
    documents, length = entries.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = frequencies(entries, len(numbers))
    weights = np.floor(1000 * np.log((2.0 * documents + 2) / (2.0 * held + 1))).astype(np.int64)
    plan = [(item, np.array(sorted(numbers[t] for t in own), np.int64)) for item, own in queries if own]
    sent = spark.sparkContext.broadcast((plan, weights))

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan, weights = sent.value

        def results(part: list[pd.DataFrame]) -> pd.DataFrame:
            shard = Shard(part, weights, documents, length)
            rows = [(item, *shard.search(own, top)) for item, own in plan]
            out = [pd.DataFrame({"item_id": pd.array([item] * len(best), "Int64"), "doc_id": shard.ids.iloc[best].to_numpy(), "score": scores})
                   for item, best, scores in rows if len(best)]
            return pd.concat(out).astype({"doc_id": "Int64"}) if out else pd.DataFrame({"item_id": [], "doc_id": [], "score": []}).astype("Int64")

        part, size = [], 0
        for frame in frames:
            ends = np.cumsum([len(t) // 4 for t in frame["terms"]])
            cuts = [0, *(np.flatnonzero(np.diff(ends // shard_entries)) + 1).tolist(), len(frame)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    part.append(frame.iloc[low:high])
                    size += sum(len(t) // 4 for t in part[-1]["terms"])
                if size >= shard_entries:
                    yield results(part)
                    part, size = [], 0
        if part:
            yield results(part)

    return entries.where(F.octet_length("terms") > 0).mapInPandas(search, "item_id long, doc_id long, score long")


def best_of(scored: DataFrame, top: int) -> DataFrame:
    """``rank`` and the best ``top`` rows of each item, ranked in parts first."""
    def ranked(*by: Column | str) -> Column:
        return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))

    salt = F.pmod(F.xxhash64("doc_id", "score"), F.lit(SALTS))
    first = scored.withColumn("salt", salt).withColumn("rank", ranked("item_id", "salt")).where(F.col("rank") <= top)
    return first.withColumn("rank", ranked("item_id")).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10, shard_entries: int = SHARD_ENTRIES, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``item_id``, ``rank`` (from 1), ``doc_id`` and ``score`` of the ``top`` highest-scoring documents of every item.

    ``shard_entries`` and ``block_terms`` bound memory and change no result.
    Terms are maximal runs of ASCII letters, digits and characters beyond ASCII, of whole texts; A-Z are
    lower-cased.  A score sums, over an item's distinct terms, a weight for rarity times the term's share in
    the document, damped for long documents; it is the exact integer.  Only scores above 0 count, so an item
    without terms (NULL, empty) has no rows, and a document without terms is never found and not counted.
    Rows of one ``item_id`` are one item of all their terms; items without an id are one item.  Every row of
    ``docs`` is a document, also where ids or whole rows repeat.  Equal scores ascend by ``doc_id``, NULL
    first.  Empty tables give no rows; other columns are ignored.
    """
    own = stage(item_terms(items), "items").withColumn("size", F.size("terms"))
    blocks = -(-(own.agg(F.sum("size")).first()[0] or 0) // block_terms)
    out = docs.sparkSession.createDataFrame([], "item_id long, doc_id long, score long")
    for block in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        queries = [(r.item_id, [bytes(t) for t in r.terms]) for r in rows]
        if queries:
            out = out.unionByName(search_block(docs, queries, top, shard_entries))
    return best_of(out, top)
