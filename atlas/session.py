"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Rows with an article's text that a Python worker is handed at a time.
ARTICLE_ROWS = 500
#: Bytes of whole texts that a Python worker is handed at a time.
TEXT_BYTES = 4 << 20


@functools.cache
def _local_root(_application: str) -> str:
    return tempfile.mkdtemp(prefix="atlas-")


def build_session(app: str = "atlas", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` entries win over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir`` for tables written between steps.

    A cluster must name a folder that every executor can reach.  Only a local
    session, whose executors live in the driver, may fall back to a temporary one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = _local_root(spark.sparkContext.applicationId)
    return f"{root.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Write ``df`` to the scratch folder, in one folder per value of ``by``, and read it back.

    Cuts lineage, so that a lost executor never repeats what came before, and
    lets several branches of a plan share one expensive step.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)


@contextmanager
def _setting(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int = ARTICLE_ROWS) -> AbstractContextManager[None]:
    """Steps that run inside hand ``rows`` rows at a time to Python workers; both sides hold a whole batch."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def arrow_bytes(spark: SparkSession, size: int = TEXT_BYTES) -> AbstractContextManager[None]:
    """Steps that run inside hand about ``size`` bytes at a time to Python workers, but for a longer single row."""
    return _setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def stage_articles(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``stage`` for what is scanned from articles: few of them reach a Python worker at a time."""
    with arrow_rows(df.sparkSession):
        return stage(df, label, *by)


def spread(df: DataFrame) -> DataFrame:
    """Repartition a frame that comes from fewer file splits than there are cores.

    For small files ahead of heavy work per row.  A large table has more splits
    than cores and is left alone.  ``df`` must not contain a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
