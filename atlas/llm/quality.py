"""Quality by pairwise ranking: Bradley-Terry on features of whole texts.

Each training pair prefers a document labelled 1 to one labelled 0.  The chance that a beats b is
the logistic of the difference of their scores, which are linear in features; the weights minimise
the logistic loss on feature differences.  Weights are fitted on a bounded sample; the threshold is
a quantile of the scores of all labelled training rows, at the share of those labelled 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import fold
from atlas.session import stage

#: Labelled documents that are learned from, those of smallest hash, and pairs made of them.
SAMPLE, PAIRS = 20_000, 60_000
#: Bins in which ranks of labelled rows are counted, and how many deviations they reach (the ends hold what lies beyond).
BINS, SPAN = 1 << 16, 64.0
RUNS = re.compile(r"([^\w\s])\1\1")
SYMBOLS = "$%#*&@^~_=<>{}[]\\/+|!"
NAMES = ["symbols", "symbol_runs", "pipes", "exclaims", "capitals", "digits", "repeats", "distinct",
         "lone", "word_length", "lines_repeated", "short", "punctuated", "any_symbols", "any_repeats"]


def features(text: str | None) -> list[float]:
    """Shares and ratios over a whole text, each between 0 and about 1."""
    text = text or ""
    tokens = text.split()
    n, size = max(len(tokens), 1), max(len(text), 1)
    symbols = sum(map(text.count, SYMBOLS)) / n
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:])) / n
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        min(symbols, 3) / 3, min(len(RUNS.findall(text)) / n, 1), min(text.count("|") / n, 1),
        min(text.count("!") / n, 2) / 2, sum(map(str.isupper, tokens)) / n,
        sum(map(str.isdigit, tokens)) / n, repeats,
        len(set(tokens)) / n, tokens.count("|") / n, min(size / n, 20) / 20,
        1 - len(set(lines)) / max(len(lines), 1), 1 / np.sqrt(n), min((text.count(".") + text.count(",")) / n, 1),
        np.sqrt(min(symbols, 1)), np.sqrt(repeats)]


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.spread @ self.weights

    def chance(self, x: np.ndarray, at: float) -> np.ndarray:
        """Score from 0 to 1 that is ``at`` for the threshold."""
        z = (self.rank(x) - self.threshold) * self.scale + np.log(at / (1 - at))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def bradley_terry(better: np.ndarray, worse: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of least logistic loss on the differences of pairs, by Newton's method."""
    gap, w = better - worse, np.zeros(better.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(gap @ w, -30, 30)))
        slope = gap.T @ (p - 1) / len(gap) + penalty * w
        curve = (gap * (p * (1 - p))[:, None]).T @ gap / len(gap) + penalty * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w


def train_labels(labels: DataFrame) -> DataFrame:
    """``_id`` and ``quality`` of labels outside the held-out fold (crc32 of the id modulo 5 is 0), repeats once."""
    return labels.where("quality IS NOT NULL").where(fold("doc_id") != 0).select(F.col("doc_id").alias("_id"), "quality").distinct()


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """Weights from a sample of labelled rows, with the threshold 0; one score for all where it lacks a label."""
    marked = train_labels(labels).orderBy(F.xxhash64("_id"), "_id", "quality").limit(sample)
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(marked), F.col("doc_id") == F.col("_id"))

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"doc_id": frame["doc_id"], "quality": frame["quality"], "x": list(map(features, frame["text"]))})

    rows = (joined.select("doc_id", "quality", "text").mapInPandas(collect, "doc_id long, quality int, x array<double>")
            .orderBy("doc_id", "quality").collect())
    x = np.array([r["x"] for r in rows]).reshape(len(rows), len(NAMES))
    y = np.array([r["quality"] for r in rows])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        width = len(NAMES)
        return Model(np.zeros(width), np.ones(width), np.zeros(width), -1.0 if len(good) or not len(y) else 1.0, 1.0)
    mean, spread = x.mean(0), x.std(0)
    spread = np.where(spread < 1e-6, 1.0, spread)
    rng = np.random.default_rng(7)
    z = (x - mean) / spread
    weights = bradley_terry(z[rng.choice(good, pairs)], z[rng.choice(bad, pairs)])
    # in deviations of the sample's ranks, as bins are
    return Model(mean, spread, weights / max((z @ weights).std(), 1e-9), 0.0, 1.0)


def ranks(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``rank`` of every whole text; NULL counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.rank(np.array(list(map(features, part))).reshape(len(part), len(NAMES))))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), apply(F.col("text").cast("string")).alias("rank"))


def calibrated(model: Model, ranked: DataFrame, labels: DataFrame) -> Model:
    """The model with the threshold and scale that ranks of all labelled training rows give.

    Ranks are counted by bin, so the driver gets a table of fixed size.  The threshold lies between
    the ranks at the quantile; the medians of both sides set the scale.
    """
    place = F.floor((F.col("rank") + SPAN) / (2 * SPAN) * BINS)
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), place)).cast("int")
    counted = (ranked.join(train_labels(labels), F.col("doc_id") == F.col("_id")).groupBy(place.alias("place"))
               .agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 0).alias("bad")).orderBy("place").collect())
    if not model.weights.any() or not counted:
        return model
    at = (np.array([r["place"] for r in counted]) + 0.5) / BINS * 2 * SPAN - SPAN
    upto, bad = np.cumsum([r["n"] for r in counted]), sum(r["bad"] for r in counted)

    def rank_of(number: int) -> float:
        """The rank that so many labelled rows lie below."""
        return float(at[np.searchsorted(upto, min(max(number, 0), int(upto[-1]) - 1), side="right")])

    gap = rank_of((bad + int(upto[-1])) // 2) - rank_of(bad // 2)
    return replace(model, threshold=(rank_of(bad - 1) + rank_of(bad)) / 2, scale=8 / max(gap, 1e-6))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, pairs: int = PAIRS) -> Model:
    """Learn from labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    Weights come from at most ``sample`` labelled rows, the threshold from all of them.  NULL labels
    are left out, repeated labels count once, a row counts under each label that it has.  Where
    the sample lacks one of the labels every text gets one score: as good where no row is labelled 0.
    NULL and empty texts have features like any other; empty tables give the model without labels.
    """
    model = learn(docs, labels, sample, pairs)
    return calibrated(model, ranks(docs, model), labels)


def score(docs: DataFrame, model: Model, at: float = 0.3) -> DataFrame:
    """``docs`` with ``quality_score`` of every whole text, from 0 to 1, ``at`` for the threshold.

    NULL counts as empty.  Repeated rows and rows without an id are scored like any other; a column
    ``quality_score`` is replaced.  An empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            x = np.array(list(map(features, part))).reshape(len(part), len(NAMES))
            yield pd.Series(shared.value.chance(x, at))

    return docs.withColumn("quality_score", apply(F.col("text").cast("string")))


def judge(docs: DataFrame, labels: DataFrame, at: float = 0.3) -> DataFrame:
    """``doc_id`` and ``quality_score`` of every row, as ``fit`` and ``score`` give them, with one pass over the texts."""
    model = learn(docs, labels)
    ranked = stage(ranks(docs, model), "ranks")
    model = calibrated(model, ranked, labels)
    z = (F.col("rank") - model.threshold) * model.scale + float(np.log(at / (1 - at)))
    return ranked.select("doc_id", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("quality_score"))
