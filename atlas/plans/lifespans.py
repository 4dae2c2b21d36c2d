"""Life spans over the person trends table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from atlas.functions.predicates import life_span
from atlas.operators import stats
from atlas.operators.dedupe import top


def with_life_span(people: DataFrame) -> DataFrame:
    return people.withColumn("life_span", life_span(F.col("year_born"), F.col("year_died")))


def life_expectancy_by_occupation(people: DataFrame, born_before: int | None = None) -> DataFrame:
    """Mean life span per occupation over complete rows, shortest first."""
    complete = stats.drop_any_null(with_life_span(people))
    if born_before is not None:
        complete = complete.where(F.col("year_born") < born_before)
    return stats.group_means(complete, "occupation", ["life_span"]).orderBy("life_span", "occupation")


def top_jobs(people: DataFrame, n: int = 100) -> DataFrame:
    """Occupations with the most people whose life span is known."""
    counts = stats.group_value_counts(with_life_span(people), "occupation", ["life_span"])
    return top(counts.withColumnRenamed("life_span", "people"), n, "people", "occupation")


def life_expectancy_of_top_jobs(people: DataFrame, n: int = 100, born_before: int = 1924) -> DataFrame:
    """Mean life span of the most frequent occupations among people born early enough.

    An occupation without such people stays, with a NULL mean.
    """
    means = life_expectancy_by_occupation(people, born_before)
    return top_jobs(people, n).select("occupation").join(means, "occupation", "left").orderBy(
        "life_span", "occupation")


def life_span_summary(people: DataFrame, occupations=("rappers", "billionaires")) -> DataFrame:
    """Overall mean life span and the mean birth year of chosen occupations, in one pass."""
    means = [F.avg(F.when(F.col("occupation") == job, F.col("year_born"))).alias(f"born_{job}")
             for job in occupations]
    return with_life_span(people).agg(F.avg("life_span").alias("life_span"), *means)


def life_span_by_birth_year(people: DataFrame) -> DataFrame:
    """Mean of every numeric column per year of birth."""
    df = with_life_span(people)
    numeric = [f.name for f in df.schema.fields
               if f.dataType.typeName() in ("integer", "long", "double") and f.name != "year_born"]
    return stats.group_means(df, "year_born", numeric).orderBy("year_born")


def of_occupations(means: DataFrame, occupations) -> DataFrame:
    return means.where(F.col("occupation").isin(*occupations))
