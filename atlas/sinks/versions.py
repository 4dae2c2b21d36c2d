"""Versions of a store: several tables written side by side and switched to at once.

A version is a folder with a folder for each table.  Its name goes into the table ``commits`` last, by
one appended row, and readers follow the row with the greatest number.  A job that dies before that
leaves a folder nobody reads.  One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

COMMITS = "number LONG, folder STRING"


def latest(spark: SparkSession, root: str) -> Row | None:
    """Number and folder of the current version, if there is one."""
    try:
        commits = spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return commits.orderBy(F.col("number").desc()).first()


def read(spark: SparkSession, root: str, **schemas: str) -> dict[str, DataFrame]:
    """The tables of the current version; empty ones before the first version."""
    version = latest(spark, root)
    if version is None:
        return {name: spark.createDataFrame([], schema) for name, schema in schemas.items()}
    return {name: spark.read.schema(schema).parquet(f"{root}/{version.folder}/{name}") for name, schema in schemas.items()}


def commit(spark: SparkSession, root: str, **tables: DataFrame) -> None:
    """Write the tables as a new version and switch to it; they may read the current one."""
    version = latest(spark, root)
    number = 1 if version is None else version.number + 1
    folder = f"version-{number}-{uuid.uuid4().hex}"
    for name, table in tables.items():
        table.write.parquet(f"{root}/{folder}/{name}")
    spark.createDataFrame([(number, folder)], COMMITS).coalesce(1).write.mode("append").parquet(f"{root}/commits")
