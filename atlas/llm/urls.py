"""URL filter: host rules, then the ratio of two character language models.

URLs that the rules accept or reject train one variable-order Markov model each.  A model predicts
a character from up to ``order`` characters before it, and backs off to shorter contexts with the
weight of characters that are new there (Witten-Bell), down to equal chances for all bytes.  A URL
is judged, whole and with A-Z lower-cased, by the difference of its log-likelihoods, divided by its
length, against a threshold set on all URLs that the rules have judged.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlas.llm.common import lower_ascii

#: (host, path, verdict): fits the host and its subdomains where the path begins so.
Rule = tuple[str, str, str]
#: URLs of either verdict that train the models, those of smallest hash; bounds model and broadcast.
SAMPLE = 4000
ORDER = 4
END = 256
BINS = 2000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty without ``://``."""
    whole = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1))
    host = F.regexp_extract(whole, r"^([^/?#]*)", 1)
    path = F.regexp_extract(whole, r"^[^/?#]*([^?#]*)", 1)
    return lower_ascii(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest fitting rule, of equal ones the first; NULL without any."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, outcome).otherwise(verdict)
    return name, verdict


class Markov:
    """Counts of bytes after contexts of up to ``order`` bytes."""

    def __init__(self, texts: list[bytes], order: int):
        self.order = order
        counts: dict[bytes, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        for text in texts:
            codes = [*text, END]
            for i, code in enumerate(codes):
                for n in range(min(order, i) + 1):
                    counts[text[i - n:i]][code] += 1
        self.counts = {k: (dict(v), sum(v.values())) for k, v in counts.items()}
        self.memory: dict[tuple[bytes, int], float] = {}

    def log_chance(self, context: bytes, code: int) -> float:
        known = self.memory.get((context, code))
        if known is None:
            chance = 1 / 257
            for n in range(len(context) + 1):
                seen, total = self.counts.get(context[len(context) - n:], ({}, 0))
                if total:
                    chance = (seen.get(code, 0) + len(seen) * chance) / (total + len(seen))
            if len(self.memory) > 500_000:
                self.memory = {}
            known = self.memory[context, code] = math.log(chance)
        return known

    def score(self, text: bytes) -> float:
        codes = [*text, END]
        return sum(self.log_chance(text[max(0, i - self.order):i], code) for i, code in enumerate(codes))


def judge(pages: DataFrame, rules: list[Rule], sample: int = SAMPLE, order: int = ORDER) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule``, ``verdict`` and the model's ``ratio`` of every row.

    A NULL url is judged as an empty text.  It and one without ``://`` have an empty host and path.
    Where the rules leave one side without examples there is no ratio to learn; every ratio is then 0
    and URLs without a rule get the verdict of the side that has examples, ``allow`` if none has.
    Repeated rows are judged alike.  An empty table gives no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = split_url(F.col("url"))
    url = lower_ascii(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), url.alias("text"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "by_rule": verdict})

    def learn(outcome: str) -> Markov | None:
        chosen = (rows.where(F.col("by_rule") == outcome).select(F.encode("text", "UTF-8").alias("t")).distinct()
                  .orderBy(F.xxhash64("t"), "t").limit(sample).collect())
        return Markov([bytes(r[0]) for r in chosen], order) if chosen else None

    accept, reject = learn("allow"), learn("block")
    if accept is None or reject is None:
        other = "block" if reject is not None else "allow"
        return rows.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.lit(other)).alias("verdict"),
                           F.lit(0.0).alias("ratio"))
    models = spark.sparkContext.broadcast((accept, reject))

    @F.pandas_udf("double")
    def ratio(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = models.value
        for part in parts:
            found = {t: (good.score(b) - bad.score(b)) / (len(b) + 1) for t in part.unique() for b in [t.encode()]}
            yield part.map(found).astype("float64")

    rows = rows.withColumn("ratio", ratio("text"))
    limit = threshold(rows)
    return rows.select("page_id", "host", "path", "rule", F.coalesce(
        "by_rule", F.when(F.col("ratio") >= limit, "allow").otherwise("block")).alias("verdict"), "ratio")


def threshold(rows: DataFrame, span: float = 10.0) -> float:
    """Ratio that parts all accepted from all rejected URLs with the least mean error of both sides.

    Ratios are counted in ``BINS`` bins over ``-span`` to ``span`` (the ends hold what lies beyond),
    so the driver gets a table of fixed size.
    """
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("ratio") + span) / (2 * span) * BINS))).cast("int")
    counted = rows.where("by_rule IS NOT NULL").groupBy("by_rule", place.alias("place")).count().collect()
    counts = {"allow": np.zeros(BINS), "block": np.zeros(BINS)}
    for outcome, at, n in counted:
        counts[outcome][at] += n
    allow, block = (counts[k] / counts[k].sum() for k in ("allow", "block"))
    # rejected by a threshold at the lower edge of bin k: the accepted below it; let through: the rejected from it on
    error = np.concatenate([[0], np.cumsum(allow)]) + 1 - np.concatenate([[0], np.cumsum(block)])
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return float(best[len(best) // 2]) / BINS * 2 * span - span
