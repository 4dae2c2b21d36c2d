"""Restartable imports: what is pending is read, and results and ledger are switched to together."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas import fixed_values as fv, schemas
from atlas.functions import text as tx
from atlas.plans import persons as ps
from atlas.plans.trends import people_by_birth_category
from atlas.session import stage
from atlas.sinks import versions
from atlas.sinks.tables import merge, write_year_partition
from atlas.sources.tables import year_buckets


def store_statements(triples: DataFrame, path: str) -> None:
    """Statements that an import of persons needs: a folder per predicate, births in a folder per year.

    Rows are gathered by folder before they are written, so a small folder is one file, and a
    large one several.  Dates of birth without a readable year are left out, as no import asks for them.
    """
    needed = ps.needed_statements(triples)
    needed.where(F.col("p") != fv.DATE_OF_BIRTH).hint("rebalance", "p") \
        .write.mode("overwrite").partitionBy("p").parquet(f"{path}/statements")
    ps.birth_statements(needed).where("year IS NOT NULL").hint("rebalance", "year") \
        .write.mode("overwrite").partitionBy("year").parquet(f"{path}/births")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """The stored statements but those of births."""
    return spark.read.schema(schemas.TRIPLES).parquet(f"{path}/statements").select("s", "p", "o", "lang")


def read_births(spark: SparkSession, path: str, years: list[int]) -> DataFrame:
    """``s, year, o`` of births in the given years; folders of other years are not read."""
    births = spark.read.schema("s STRING, o STRING, year INT").parquet(f"{path}/births")
    return births.where(F.col("year").isin(years)).select("s", "year", "o")


def persons_and_ledger(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The current ``persons`` and ``ledger``; both empty before the first import."""
    return versions.read(spark, root, persons=schemas.PERSONS, ledger=schemas.PROGRESS)


def import_persons(spark: SparkSession, statements: str, root: str, start: int = 1800, end: int = 2000,
                   force: bool = False) -> dict[str, DataFrame]:
    """Import the years ``start`` to ``end`` that the ledger in ``root`` does not have, or all when forced.

    ``statements`` is a folder by ``store_statements``.  Each year is a bucket of the ledger, with the
    number of persons born in it, 0 included, so that an empty year is not asked for again.  A person
    with birth dates in several of the years gets the last one's row, but counts in each.  Rows of
    persons already there are replaced.  Both tables are written before the switch: after a failure the
    old state stands, and the next call begins with the same years.
    """
    old = persons_and_ledger(spark, root)
    pending = ps.pending_years(year_buckets(spark, start, end), old["ledger"], force)
    years = [row.year for row in pending.collect()]  # at most the years asked for
    if not years:
        return old
    births = read_births(spark, statements, years)
    found = stage(ps.persons_of(births, read_statements(spark, statements)), "found")
    counts = (births.join(found.select(F.col("qid").alias("s")), "s", "left_semi").distinct()
              .groupBy(F.col("year").cast("string").alias("bucket")).agg(F.count("*").alias("row_count")))
    done = year_buckets(spark, start, end).where(F.col("year").isin(years)).join(counts, "bucket", "left").select(
        "bucket", F.current_timestamp().alias("imported_at"), F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"))
    versions.commit(spark, root, persons=merge(old["persons"], found, "qid", "year_born"),
                    ledger=merge(old["ledger"], done, "bucket", "imported_at"))
    return persons_and_ledger(spark, root)


def stored_years(spark: SparkSession, path: str) -> DataFrame:
    """``birth_year`` of the years whose people are stored, years without people among them."""
    try:
        return spark.read.schema("birth_year INT").parquet(f"{path}/years").distinct()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "birth_year INT")


def fetch_people(pages: DataFrame, views: DataFrame, path: str, first: int = fv.BIRTH_CATEGORY_YEARS[0],
                 last: int = fv.BIRTH_CATEGORY_YEARS[1]) -> DataFrame:
    """People filed under the years ``first`` to ``last`` (exclusive), parsed for years not stored yet and read for all.

    Articles of stored years only are not parsed again, whatever they hold by now.  Years are noted as
    stored after their people are written, so a failed run repeats them.
    """
    spark = pages.sparkSession
    wanted = year_buckets(spark, first, last, inclusive=False).select(F.col("year").alias("birth_year"))
    missing = [row.birth_year for row in wanted.join(stored_years(spark, path), "birth_year", "left_anti").collect()]  # a calendar
    people = people_by_birth_category(pages, views, first, last, only=missing)
    if missing:
        write_year_partition(people, f"{path}/people")
        spark.createDataFrame([(year,) for year in missing], "birth_year INT").coalesce(1).write.mode("append").parquet(f"{path}/years")
    stored = spark.read.schema(people.schema).parquet(f"{path}/people")
    return stored.where((F.col("birth_year") >= first) & (F.col("birth_year") < last)).select(*people.columns)


def labels_in(spark: SparkSession, root: str) -> DataFrame:
    """The current labels; none before the first import."""
    return versions.read(spark, root, labels=schemas.LABELS)["labels"]


def import_labels(spark: SparkSession, triples: DataFrame, people: DataFrame, root: str, force: bool = False) -> DataFrame:
    """Fetch English labels of all ids that ``people`` refers to and ``root`` lacks, or of all when forced.

    ``triples`` may hold more than labels; only its English labels of wanted ids are taken.  Ids
    without one stay pending.  Where nothing is found, no new version is written.
    """
    old = labels_in(spark, root)
    found = stage(ps.fetch_labels(triples, ps.missing_labels(people, old, force)), "labels")
    if found.isEmpty():
        return old
    versions.commit(spark, root, labels=merge(old, found, "qid", "label"))
    return labels_in(spark, root)
