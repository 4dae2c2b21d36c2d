"""Training-data pipeline over the documents table: five stages, each a table written and read again.

All stages but the last return the columns of documents.  ``run`` hands each stage what the stage
before it kept.  SQL cannot express toxicity, packing and tokenization, so there is no checking SQL;
the tests hold ``run`` against plain Python: planted toxic documents go, and all that follows is recomputed.

NULL and empty texts pass every stage and are packed as the end id alone.  Rows without an id stay
unless their text is toxic or holds a benchmark item.  Of rows with equal id and words one stays.  An
empty documents table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlas.llm import decontaminate, jaccard, lines, packing, toxicity
from atlas.llm.common import table
from atlas.llm.queries import TOKENIZER
from atlas.session import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that weak supervision does not reject; learned from the labels of this input's documents."""
    judged = toxicity.toxic(docs, table(spark, sf_dir, "labels"))
    return judged.where("NOT is_toxic").select(COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; ``n_chars`` follows the text."""
    cleaned = lines.cleaned(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long"))
                              .otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles."""
    return jaccard.one_of_each(docs).select(COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no item of the benchmark is found."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in windows of 2048 tokens."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("n-gram Jaccard join", drop_copies),
          ("benchmark decontamination", drop_leaks), ("packing", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the stages before it are written to the session's shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
