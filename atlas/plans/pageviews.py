"""Hourly page-view logs to totals per title."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas import fixed_values as fv
from atlas.functions import predicates as pr, text as tx
from atlas.operators.dedupe import top
from atlas.sinks.tables import write_pageviews
from atlas.sources.dumps import read_pageview_lines


def pageview_totals(lines: DataFrame, project: str = "en") -> DataFrame:
    """``title, viewcount``: views per decoded title over all lines.

    Lines that count nothing readable are skipped.  The sum is partial before
    its one shuffle, so a very popular title costs one row per map task.
    """
    parts = F.split("value", " ")
    counted = lines.where(pr.valid_pageview_line(F.col("value"), project)).select(
        tx.decode_title(F.get(parts, F.lit(1))).alias("title"),
        F.get(parts, F.lit(2)).try_cast("long").alias("views"))
    return counted.where("title IS NOT NULL AND views IS NOT NULL").groupBy("title").agg(
        F.sum("views").alias("viewcount"))


def import_pageviews(spark: SparkSession, folder: str, path: str) -> DataFrame:
    """Every hourly file of a folder into the page-view table."""
    return write_pageviews(pageview_totals(read_pageview_lines(spark, folder)), path)


def top_titles(totals: DataFrame, n: int = fv.TOP_TITLES) -> DataFrame:
    return top(totals, n, "viewcount", "title")
