"""Charts over the persons table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from atlas import fixed_values as fv
from atlas.functions.predicates import born_between
from atlas.operators import stats
from atlas.operators.dedupe import rank_top
from atlas.operators.joins import labelled, translate
from atlas.session import stage
from atlas.sinks.tables import chart_payload


def gender_by_country(persons: DataFrame, codes: DataFrame, least: int = fv.MIN_PEOPLE_PER_COUNTRY) -> DataFrame:
    """``location, share, people``: female share per country of birth with enough people."""
    chosen = persons.where(
        F.col("pob_country_code").isNotNull() & born_between(F.col("year_born"))
        & F.col("gender_qid").isin(fv.GENDER_MALE, fv.GENDER_FEMALE))
    counts = stats.count_classes(chosen, ["pob_country_code"], {
        "male": F.col("gender_qid") == fv.GENDER_MALE,
        "female": F.col("gender_qid") == fv.GENDER_FEMALE,
    }).withColumn("people", F.col("male") + F.col("female")).where(F.col("people") >= least)
    return translate(counts, codes, "pob_country_code", "alpha2", "alpha3").select(
        F.col("pob_country_code").alias("location"),
        stats.share(F.col("female"), F.col("people")).alias("share"), "people")


def density_by_country(persons: DataFrame, codes: DataFrame) -> DataFrame:
    """``location, score, people``: people born per country, on a log scale too."""
    chosen = persons.where(F.col("pob_country_code").isNotNull() & born_between(F.col("year_born")))
    counts = chosen.groupBy("pob_country_code").agg(F.count("*").alias("people"))
    return translate(counts, codes, "pob_country_code", "alpha2", "alpha3").select(
        F.col("pob_country_code").alias("location"),
        stats.log_count(F.col("people")).alias("score"), "people")


def gender_over_time(persons: DataFrame) -> DataFrame:
    """``series, x, y, share``: people by gender and year of birth."""
    male, female = fv.GENDER_MALE, fv.GENDER_FEMALE
    chosen = persons.where(F.col("gender_qid").isNotNull() & born_between(F.col("year_born")))
    counts = stats.count_classes(chosen, ["year_born"], {
        "male": F.col("gender_qid") == male,
        "female": F.col("gender_qid") == female,
        "other": ~F.col("gender_qid").isin(male, female),
    })
    series = stats.wide_to_series(counts, "year_born", ["male", "female", "other"])
    return stats.composition(series, "x", "y").orderBy("x", "series")


def top_occupations(persons: DataFrame, n: int = fv.TOP_OCCUPATIONS) -> DataFrame:
    """``qid, n, rank`` of the most frequent occupations over all years."""
    return rank_top(stats.list_counts(persons, "occupation_qids", "qid"), n, "n", "qid")


def top_occupations_over_time(persons: DataFrame, labels: DataFrame, n: int = fv.TOP_OCCUPATIONS,
                              keep=stage) -> DataFrame:
    """``series, x, y, share``: slots filled by each top occupation per year of birth.

    One count by year and occupation over all years is written, from which both the short list and the
    slots are taken, so persons are read once.  The list is written too, as three joins need it.
    """
    counts = keep(stats.cube(persons, "year_born", "occupation_qids", "qid"), "cube")
    ranked = rank_top(counts.groupBy("qid").agg(F.sum("n").alias("n")), n, "n", "qid")
    top = keep(labelled(keep(ranked, "top"), labels, "qid"), "labelled")
    slots = stats.slots_of_counts(counts.where(born_between(F.col("x"))), top, "qid", n)
    return stats.composition(slots.select(F.col("label").alias("series"), "x", "y"), "x", "y").orderBy("x", "series")


def payload(chart: DataFrame) -> DataFrame:
    """One JSON document per series of a chart over time."""
    return chart_payload(chart, "series", "x", "y", "share")
