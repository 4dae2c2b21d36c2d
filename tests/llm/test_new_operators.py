"""Manifest, ranked search and substring dedup on small tables, against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlas.llm import merkle, ranking, substrings
from atlas.llm.common import lower_ascii

#: Columns with names that the operators use themselves.
CLASHING = "doc_id LONG, text STRING, source STRING, g STRING, h STRING, pos LONG, row LONG, n LONG, spans STRING, kept STRING"


def table(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1, 2, 3, "z", "k") for i, t, s in rows], CLASHING)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """Root of a list of hashes, and each node's siblings on the way to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for k, place in enumerate(at):
            run = level[place // 16 * 16:][:16]
            paths[k].append(("".join(run[:place % 16]), "".join(run[place % 16 + 1:])))
        at, level = [p // 16 for p in at], [sha(*level[k:k + 16]) for k in range(0, len(level), 16)]
    return level[0], paths


MANIFESTS = {
    "empty": [],
    "one": [(7, "Text", "a")],
    "odd": [(1, None, None), (2, "", ""), (None, "No id", "a"), (3, "Ünï CODE", "a"), (3, "Ünï CODE", "a"), (3, "other", "a"), (4, "x" * 100_000, "b")],
    "large": [(k, f"Text {k}", f"s{0 if k % 3 else k % 60}") for k in range(1000, 0, -1)],
}


@pytest.mark.parametrize("name", MANIFESTS)
def test_manifest(spark, name):
    rows = MANIFESTS[name]
    docs = table(spark, rows)
    fields = [F.col("doc_id"), F.col("source")]
    done = merkle.manifest(docs, [*fields, F.col("text")], F.col("source"), F.col("doc_id"), h=merkle.leaf(*fields, lower_ascii(F.col("text"))))
    got = done.select("doc_id", "leaf", "subroot", "root", merkle.folded(F.col("leaf"), F.col("path")).alias("again"),
                      merkle.folded(F.col("h"), F.col("path")).alias("seen"), merkle.proof(F.col("path")).alias("proof")).collect()

    def leaf(*fields):
        return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])

    groups = collections.defaultdict(list)
    for i, text, source in rows:
        lowered = text and re.sub("[A-Z]", lambda m: m[0].lower(), text)
        groups[source].append((i is not None, i or 0, leaf(i, source, text), i, leaf(i, source, lowered)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, above = tree([trees[s][0] for s in names]) if names else (None, [])
    want = []
    for s, up in zip(names, above):
        for (_, _, own, i, seen), path in zip(sorted(groups[s], key=lambda x: x[:3]), trees[s][1]):
            for left, right in path + up:
                seen = sha(left, seen, right)
            want.append((i, own, trees[s][0], root, root, seen, sha(*[x for pair in path + up for x in pair])))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def best(docs, items, top):
    def split(text):
        return [t.lower() if t.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), t)
                for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]

    counts = [(i, collections.Counter(split(t))) for i, t, _ in docs]
    sizes = [sum(c.values()) for _, c in counts]
    many, whole = sum(s > 0 for s in sizes), sum(sizes)
    out, wanted = [], collections.defaultdict(set)
    for item, text in items:
        wanted[item] |= set(split(text))
    for item, own in wanted.items():
        scored = []
        for (i, held), n in zip(counts, sizes):
            score = 0
            for term in own & held.keys():
                df = sum(term in c for _, c in counts)
                weight = math.floor(1000 * math.log((2 * many + 2) / (2 * df + 1)))
                score += weight * (10 ** 9 * held[term] // (1000 * held[term] + 8 * (10 + 90 * n * many // whole)))
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:top])]
    return out


@pytest.mark.parametrize("shard,block", [(ranking.SHARD_ENTRIES, ranking.BLOCK_TERMS), (500, 40)])
def test_ranking(spark, shard, block):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(80)] + ["Ñandú", "ño", "A1", "İx"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    text = lambda n: " ,".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    docs = [(k // 2 if k < 40 else k, text(rng.integers(0, 60)), None) for k in range(300)]
    docs += [(1000, "same words twice", None)] * 15 + [(None, "same words twice", None), (2000, None, None), (2001, "", None), (2002, "-- !", None),
                                                       (2003, text(20_000), None)]
    items = [(k, text(12)) for k in range(12)] + [(50, "same w3"), (50, "words same"), (51, None), (52, ""), (53, "unknown term"), (None, "w70 w1")]
    found = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id LONG, text STRING, term STRING, rank INT")
    got = ranking.search(table(spark, docs), found, top=10, shard_entries=shard, block_terms=block).collect()
    assert sorted(map(tuple, got), key=str) == sorted(best(docs, items, 10), key=str)


def test_ranking_of_empty_tables(spark):
    docs, none = table(spark, [(1, "a b", None)]), table(spark, [])
    items = docs.withColumnRenamed("doc_id", "item_id")
    assert ranking.search(none, items).count() == ranking.search(docs, items.limit(0)).count() == ranking.search(none, items.limit(0)).count() == 0


def test_search_reads_no_further_than_needed():
    """A document far ahead in one long list is found without the end of the lists."""
    import pandas as pd
    size = 20_000
    frame = pd.DataFrame({"doc_id": range(size), "n": [10] * size, "terms": [np.array([0], np.int32).tobytes()] * size,
                          "counts": [np.array([1000 if k == 77 else 1 + k % 3], np.int32).tobytes() for k in range(size)]})
    shard = ranking.Shard([frame], np.array([500]), size, 10 * size)
    reads = []
    impact = shard.impact

    class Watched:
        def __len__(self):
            return len(impact)

        def __getitem__(self, at):
            if isinstance(at, slice):
                reads.append(at.stop - at.start)
            return impact[at]

    shard.impact = Watched()
    places, scores = shard.search(np.array([0]), 1)
    assert places.tolist() == [77] and scores[0] == impact[0] and sum(reads) == ranking.DEPTH


def without(rows, length):
    split = [(t or "").encode().split() for _, t, _ in rows]
    first = {}
    for (i, _, _), own in zip(rows, split):
        for k in range(len(own) - length + 1) if i is not None else ():
            key = tuple(own[k:k + length])
            first[key] = min(first.get(key, i), i)
    out = []
    for (i, t, _), own in zip(rows, split):
        gone = {k + j for k in range(len(own) - length + 1) if i is not None and first[tuple(own[k:k + length])] < i for j in range(length)}
        kept = b" ".join(w for k, w in enumerate(own) if k not in gone).decode()
        out.append((i, None if t is None else kept, len(own), len(gone)))
    return out


def test_substrings(spark):
    rng = np.random.default_rng(7)
    rows = []
    for vocabulary, length, many in ((2, 40, 60), (50, 200, 40)):
        rows += [(len(rows) + k, " ".join(f"W{x}" for x in rng.integers(0, vocabulary, rng.integers(0, length))), None) for k in range(many)]
    passage = " ".join(f"p{x}" for x in range(70))
    rows += [(500 + k, " ".join([f"a{k}", "b", passage, *[f"c{k}.{j}" for j in range(k)], passage]), None) for k in range(20)]
    rows += [(600, passage + " own", None), (600, passage + "\n\town", None), (600, "another with the id", None), (None, passage, None), (None, passage, None),
             (601, None, None), (602, "", None), (603, " \n\t ", None), (604, "  nbsp is a word", None),
             (605, "again " * 3000, None), (606, "again " * 2000, None), (3, " ".join(f"W{x}" for x in range(30)), None)]
    docs = table(spark, rows)
    for length in (2, 5, 50):
        got = substrings.cleaned(docs, length).collect()
        assert set(got[0].asDict()) == {*docs.columns, "n_words", "n_removed"}
        assert sorted([(r.doc_id, r.text, r.n_words, r.n_removed) for r in got], key=str) == sorted(without(rows, length), key=str)
    assert substrings.cleaned(docs.limit(0)).count() == 0
