"""Toxicity by weak supervision.

1. A lexicon of words and word beginnings is drawn from a bounded sample of labelled documents.
2. Its terms, grouped into lexicon voters, how many of them a text holds, and patterns of the text
   itself (repeated marks, capitals, masked letters, address of a person) vote on the sample's documents.
3. A generative label model estimates without labels (expectation maximisation) each lexicon voter's
   accuracy, how often texts of either class show each pattern, and the voters' correlations, and
   shares the weight among correlated ones.
4. A linear classifier learns the model's posterior labels from the terms and patterns of a text.
   Spark scores every whole text with it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import fold, shingles, word_hashes, words
from atlas.session import stage

#: Labelled documents that are learned from: those of smallest hash.  Bounds the fit, not the scoring.
SAMPLE = 20_000
#: Terms of the lexicon at most, and shortest and longest word beginning.
TERMS, SHORT, LONG = 600, 4, 8
#: A term must occur in so many toxic documents, and be toxic so often.
SUPPORT, PRECISION = 3, 0.9
VOTERS = 24
STRIP = b".,!?:;\"'()[]$%#*&|-"
#: Patterns of a text: repeated marks, words in capitals, symbols that mask letters, second persons.
MARKS, CAPITALS, MASKS = re.compile(r"[!?]{2,}"), re.compile(r"[A-Z]{3,}"), re.compile(r"[*@#$]+(?=[^\W\d_])")
PERSONS = frozenset(b"you your yours yourself du dich dir dein deine ihr euch tu te toi vous votre vos usted ustedes ti".split())
PATTERNS = 4
#: Lexicon voters, five figures of a text, patterns.
WIDTH = VOTERS + 5 + PATTERNS
#: Occurrences a word from which a pattern is shown; with none it is not, between the two it has no vote.
SHOWN = 0.02


@dataclass
class Model:
    """What a worker needs to score a text."""

    terms: dict[bytes, int]  # word + b"$" or the beginning of a word
    voters: np.ndarray  # voter of each term
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, texts: pd.Series) -> np.ndarray:
        starts = openings(self.terms)
        x = (np.array([features(t, self.terms, starts, self.voters) for t in texts]) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def keys_of(word: bytes) -> list[bytes]:
    """The word itself and its beginnings, in whole characters."""
    if word.isascii():
        return [word + b"$", *(word[:n] for n in range(SHORT, min(LONG, len(word)) + 1))]
    text = word.decode()
    return [word + b"$", *(text[:n].encode() for n in range(SHORT, min(LONG, len(text)) + 1))]


def openings(terms: dict[bytes, int]) -> set[bytes]:
    """First bytes of all terms; a word that has none of them holds no term."""
    return {term.rstrip(b"$")[:SHORT] for term in terms}


def hits(text: str | None, terms: dict[bytes, int], starts: set[bytes]) -> tuple[Counter, int, int]:
    """Occurrences of terms, each word once by its longest term, the number of words, and of second persons."""
    found, every, persons = Counter(), words(text), 0
    for raw, n in Counter(every).items():
        if len(raw) < 12 and raw.strip(STRIP) in PERSONS:
            persons += n
        if raw[:SHORT] in starts or raw[0] in STRIP:
            word = raw.strip(STRIP)
            if word[:SHORT] in starts:
                for key in keys_of(word)[::-1]:
                    if key in terms:
                        found[terms[key]] += n
                        break
    return found, len(every), persons


def patterns(text: str, persons: int, total: int) -> list[float]:
    """Occurrences of each pattern for every word, 1 at most."""
    masked = sum(m.start() > 0 and text[m.start() - 1].isalpha() for m in MASKS.finditer(text))
    return [min(n / max(total, 1), 1.0) for n in (len(MARKS.findall(text)), len(CAPITALS.findall(text)), masked, persons)]


def features(text: str | None, terms: dict[bytes, int], starts: set[bytes], voters: np.ndarray) -> np.ndarray:
    """Presence of each voter, share and number of hits, and patterns of the text."""
    found, total, persons = hits(text, terms, starts)
    out = np.zeros(WIDTH)
    for term in found:
        out[voters[term]] = 1.0
    count, text = sum(found.values()), text or ""
    out[VOTERS:] = (count > 0, min(count, 10) / 10, min(1.0, 50 * count / max(total, 1)),
                    text.count("!") / (len(text) + 1), np.log1p(total) / 10, *patterns(text, persons, total))
    return out


def lexicon(sample: DataFrame) -> list[tuple[bytes, int, int]]:
    """Terms with how often documents of either label hold a word of theirs; the best ``TERMS`` reach the driver."""
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            toxic, clean = Counter(), Counter()
            met = set()
            for text, label in zip(frame["text"], frame["toxic"]):
                own = words(text)
                # near copies mostly share the three words of least hash; one of them counts
                if own and (mark := (label, int(shingles(word_hashes(own), 3).min()))) not in met:
                    met.add(mark)
                    (toxic if label else clean).update({raw.strip(STRIP) for raw in set(own)})
            rows = [(k, toxic[k], clean[k]) for k in toxic.keys() | clean.keys() if k]
            yield pd.DataFrame(rows, columns=["term", "toxic", "clean"])

    def widen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(term=[keys_of(w) for w in frame["term"]]).explode("term")

    schema = "term binary, toxic long, clean long"
    total = lambda df: df.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = stage(total(total(sample.mapInPandas(count, schema)).mapInPandas(widen, schema)), "terms")
    # so often that hardly one of all terms is by chance, even if each document had a copy or two
    n, toxic, clean = counts.agg(F.count("*"), F.sum("toxic"), F.sum("clean")).first()
    if not toxic:
        return []
    least = SUPPORT if not clean else max(SUPPORT, math.ceil(1.5 * math.log(n) / math.log((toxic + clean) / toxic)))
    best = (counts.where((F.col("toxic") >= least) & (F.col("toxic") >= PRECISION * (F.col("toxic") + F.col("clean"))))
            .orderBy(F.desc(F.col("toxic") - 9 * F.col("clean")), F.length("term"), "term").limit(TERMS))
    return standing({bytes(t): (a, b) for t, a, b in best.collect()})


def standing(terms: dict[bytes, tuple[int, int]]) -> list[tuple[bytes, int, int]]:
    """Terms that stay telling for the words that no longer term of the lexicon explains."""
    kept: dict[bytes, tuple[int, int]] = {}
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        own = [t for t in kept if t.startswith(term)]
        nearest = [t for t in own if not any(t != u and t.startswith(u) for u in own)]
        toxic, clean = (terms[term][k] - sum(terms[t][k] for t in nearest) for k in (0, 1))
        if clean <= 0 or toxic >= PRECISION * (toxic + clean):
            kept[term] = terms[term]
    return [(t, *kept[t]) for t in terms if t in kept]


def label_model(votes: np.ndarray, shown: np.ndarray | None = None, rounds: int = 50) -> np.ndarray:
    """Posterior chance of toxic from votes (1 toxic, -1 clean, 0 none), learned from the votes alone.

    Accuracies come from expectation maximisation.  What a pattern speaks for is learned, too: ``shown``
    (1 shown, -1 not, 0 neither) counts by how often either class gives each outcome, so a pattern that
    both classes show alike has no say.  Voters that are right or wrong together beyond what the
    classes explain are correlated: each one's say is divided by one plus the sum of its positive
    correlations, so a crowd of copies weighs as one voter.
    """
    shown = np.zeros((len(votes), 0)) if shown is None else shown
    lexical = votes.shape[1]
    said = votes != 0
    posterior = np.clip(0.5 + 0.5 * votes.sum(1) / np.maximum(said.sum(1), 1), 0.02, 0.98)
    share = np.ones(lexical + shown.shape[1])
    for step in range(rounds):
        right = np.where(votes > 0, posterior[:, None], np.where(votes < 0, 1 - posterior[:, None], 0.0))
        accuracy = np.clip((right.sum(0) + 2) / (said.sum(0) + 3), 0.55, 0.995)
        # chance that a text of either class shows a pattern, of texts that show it or not
        rates = [((shown > 0) * p[:, None]).sum(0) + 1 for p in (posterior, 1 - posterior)]
        rates = [r / (((shown != 0) * p[:, None]).sum(0) + 2) for r, p in zip(rates, (posterior, 1 - posterior))]
        if step == rounds // 2:
            agrees = votes * np.where(posterior > 0.5, 1, -1)[:, None]
            expected = posterior[:, None] * rates[0] + (1 - posterior[:, None]) * rates[1]
            error = np.column_stack([np.where(said, agrees - agrees.sum(0) / np.maximum(said.sum(0), 1), 0),
                                     np.where(shown != 0, (shown > 0) - expected, 0)])
            norm = np.sqrt((error ** 2).sum(0)) + 1e-9
            correlation = (error.T @ error) / np.outer(norm, norm)
            np.fill_diagonal(correlation, 0)
            share = 1 / (1 + np.clip(correlation, 0, 1).sum(0))
        prior = np.clip(posterior.mean(), 0.01, 0.99)
        says = np.where(shown > 0, np.log(rates[0] / rates[1]), np.where(shown < 0, np.log((1 - rates[0]) / (1 - rates[1])), 0.0))
        logit = (np.log(prior / (1 - prior)) + votes @ (share[:lexical] * np.log(accuracy / (1 - accuracy)))
                 + says @ share[lexical:])
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return posterior


def vote(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes of the lexicon on features, and which patterns are shown."""
    lexical = np.where(x[:, :VOTERS] > 0, 1, 0)
    some, count, dense = x[:, VOTERS], x[:, VOTERS + 1], x[:, VOTERS + 2]
    amounts = [np.where(some > 0, 1, -1), np.where(count > 0.1, 1, np.where(some > 0, 0, -1)),
               np.where(dense >= 0.1, 1, np.where(some > 0, 0, -1))]
    held = x[:, -PATTERNS:]
    return np.column_stack([lexical, *amounts]), np.where(held >= SHOWN, 1, np.where(held == 0, -1, 0))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression on soft labels, by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(z) + penalty * np.append(w[:-1], 0)
        curve = (z * (p * (1 - p))[:, None]).T @ z / len(z) + penalty * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -5, 5)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0), ``sample`` of them at most.

    NULL labels are left out, repeated labels count once, a row counts under each label that it has.
    NULL and empty texts hold no term and show no pattern.  Without labelled rows or telling terms
    the model gives every text one score below a half.
    """
    marked = (labels.where("toxic IS NOT NULL").where(fold("doc_id") != 0)
              .select(F.col("doc_id").alias("_id"), "toxic").distinct()
              .orderBy(F.xxhash64("_id"), "_id", "toxic").limit(sample))
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(marked), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "toxic")
    chosen = lexicon(joined)
    terms = {term: i for i, (term, _, _) in enumerate(chosen)}
    # a term's voter goes by the beginning of the word, so that forms of a word vote once
    stems = list(dict.fromkeys(term.rstrip(b"$")[:SHORT] for term in terms))
    voters = np.array([stems.index(term.rstrip(b"$")[:SHORT]) % VOTERS for term in terms] or [0])

    def collect(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array([features(t, terms, openings(terms), voters) for t in frame["text"]]).reshape(len(frame), WIDTH)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "x": list(x)})

    gathered = joined.mapInPandas(collect, "doc_id long, x array<double>").orderBy("doc_id").collect()
    x = np.array([r["x"] for r in gathered]).reshape(len(gathered), WIDTH)
    mean, spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    spread = np.where(spread < 1e-3, 1.0, spread)
    if not len(x) or not terms:
        return Model(terms, voters, mean, spread, np.zeros(WIDTH), -3.0)
    weights, bias = logistic((x - mean) / spread, label_model(*vote(x)))
    return Model(terms, voters, mean, spread, weights, bias)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxicity`` (0 to 1) of every whole text; NULL counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score(part) if len(part) else [], dtype="float64")

    return docs.withColumn("toxicity", apply(F.col("text").cast("string")))


def toxic(docs: DataFrame, labels: DataFrame, limit: float = 0.5) -> DataFrame:
    """Fit on labels, score all documents: ``toxicity`` and ``is_toxic`` are added (or replaced).

    Without labelled training rows, or without a term that tells toxic texts, every text scores
    below the limit.  NULL ids and repeated rows are scored like any other; NULL labels are left
    out.  An empty table gives no rows.
    """
    return score(docs, fit(docs, labels)).withColumn("is_toxic", F.col("toxicity") >= limit)
