"""Writers: full replacement, upserts, progress, partitions, JSON results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atlas.operators.dedupe import drop_repeats, keep_last
from atlas.operators.stats import series_arrays
from atlas.session import arrow_rows


def _replace(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_pages(pages: DataFrame, path: str) -> DataFrame:
    """Replace the pages; of pages with one title the lowest id stays."""
    with arrow_rows(pages.sparkSession):
        return _replace(drop_repeats(pages, "title", "wiki_id"), path)


def write_unique_pages(pages: DataFrame, path: str) -> DataFrame:
    """Replace the pages by ones whose titles don't repeat."""
    with arrow_rows(pages.sparkSession):
        return _replace(pages, path)


def record_load(spark: SparkSession, path: str, bucket: str, counters: dict[str, int]) -> DataFrame:
    """Add what an import counted to the table of loads, a row per counter."""
    rows = spark.createDataFrame(list(counters.items()), "counter STRING, n LONG")
    rows = rows.select(F.lit(bucket).alias("bucket"), F.current_timestamp().alias("imported_at"), "counter", "n")
    rows.coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def write_entities(entities: DataFrame, path: str) -> DataFrame:
    return _replace(entities, path)


def write_property_values(values: DataFrame, path: str) -> DataFrame:
    """One row per property value, dealt and sorted by property and value.

    A question about a property skips the row groups of all others, and a property that most entities
    have is spread over many files by its values and entities.
    """
    dealt = values.repartitionByRange("prop_name", "text", "num", "qid")
    return _replace(dealt.sortWithinPartitions("prop_name", "text", "num"), path)


def write_page_tags(tags: DataFrame, path: str) -> DataFrame:
    """The tag index, one row per page and tag, dealt and sorted by tag."""
    with arrow_rows(tags.sparkSession):
        return _replace(tags.repartitionByRange("kind", "tag", "title").sortWithinPartitions("kind", "tag"), path)


def write_pageviews(totals: DataFrame, path: str) -> DataFrame:
    return _replace(totals, path)


def write_person_trends(people: DataFrame, path: str) -> DataFrame:
    return _replace(people, path)


def merge(current: DataFrame, updates: DataFrame, key: str, order: Column | str) -> DataFrame:
    """``current`` with whole rows replaced by the last update of their key.

    Current rows are only tested against the keys of the updates, which adaptive
    execution broadcasts when they are few, so a small update moves no old row.
    """
    fresh = keep_last(updates, [key], [order]).select(*current.columns)
    return current.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def upsert_persons(current: DataFrame, updates: DataFrame, order: Column | str, path: str) -> DataFrame:
    """Merge persons by id and write them to a new path, for the caller to switch to."""
    return _replace(merge(current, updates, "qid", order), path)


def upsert_labels(current: DataFrame, updates: DataFrame, order: Column | str, path: str) -> DataFrame:
    return _replace(merge(current, updates, "qid", order), path)


def progress(rows: DataFrame, bucket: Column) -> DataFrame:
    """Ledger rows of an import: bucket, time and number of rows."""
    return rows.groupBy(bucket.cast("string").alias("bucket")).agg(
        F.count("*").alias("row_count")
    ).select("bucket", F.current_timestamp().alias("imported_at"), "row_count")


def record_progress(ledger: DataFrame, rows: DataFrame, bucket: Column, path: str) -> DataFrame:
    return _replace(merge(ledger, progress(rows, bucket), "bucket", "imported_at"), path)


def write_gazetteer(gazetteer: DataFrame, path: str) -> None:
    """One JSON object per place."""
    gazetteer.write.mode("overwrite").json(path)


def write_year_partition(people: DataFrame, path: str) -> None:
    """Parsed people in one folder per birth year; only years present are replaced.

    Rows are gathered by year first: a small year is one file, and a large one several.
    """
    with arrow_rows(people.sparkSession):
        people.hint("rebalance", "birth_year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
            .partitionBy("birth_year").parquet(path)


def chart_payload(series: DataFrame, name: str, x: str, *values: str) -> DataFrame:
    """One JSON document per series of a chart, with its ordered arrays."""
    arrays = series_arrays(series, name, x, *values)
    return arrays.select(name, F.to_json(F.struct(name, x, *values)).alias("payload"))
