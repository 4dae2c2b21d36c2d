"""Public dumps: page XML, entity JSON lines, hourly page-view text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atlas import schemas
from atlas.session import stage


END = "</page>"


def read_page_records(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``value``: the text of one page of an XML dump (plain or bz2) per row, not parsed.

    The text source cuts the file after each closing page tag, so that one large
    dump is read by many tasks; the XML reader would give a file to one task.
    A literal tag cannot occur inside a page, where it is escaped.  ``limit`` above 0 takes so many
    records; they are written down first, so that several readers see the same ones.
    """
    records = spark.read.text(path, lineSep=END).where(F.contains("value", F.lit("<page>")))
    if limit:
        records = stage(records.limit(limit), "records").repartition(spark.sparkContext.defaultParallelism)
    return records.select(F.concat(F.lit("<page>"), F.substring_index("value", "<page>", -1), F.lit(END)).alias("value"))


def record_title(value: Column) -> Column:
    """The title as it stands in a page's text, cut out without parsing; what precedes the revision is enough as a rule."""
    head = F.substring_index(value, "<revision", 1)
    rest = F.regexp_replace(value, r"(?s)<revision.*?</revision>", "")
    return F.regexp_extract(F.when(F.contains(head, F.lit("<title")), head).otherwise(rest), r"(?s)<title[^>]*>(.*?)</title>", 1)


def parse_records(records: DataFrame) -> DataFrame:
    """``title, wiki_id, revision_id, wikitext, malformed`` of page records."""
    page = F.from_xml("value", F.lit(schemas.PAGE_XML), {
        "rowTag": "page", "ignoreSurroundingSpaces": "false", "columnNameOfCorruptRecord": "_corrupt_record"})
    return records.select(page.alias("page")).select(
        F.col("page.title").alias("title"),
        F.col("page.id").alias("wiki_id"),
        F.col("page.revision.id").alias("revision_id"),
        F.coalesce(F.col("page.revision.text")["_VALUE"], F.lit("")).alias("wikitext"),
        (F.col("page").isNull() | F.col("page._corrupt_record").isNotNull()).alias("malformed"))


def read_pages(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """One row per page of an XML dump: title, wiki_id, revision_id, wikitext.  Pages that do not parse are left out."""
    return parse_records(read_page_records(spark, path, limit)).where("NOT malformed").drop("malformed")


def entity_lines(lines: DataFrame) -> DataFrame:
    """Entities of a JSON array written one object per line; other lines are skipped.

    ``id, wikipedia_id, title, description, claims``, with the English parts of a
    record picked while it is parsed.  Stage the result before asking several
    things of it: a filter on a parsed column would parse each line again.
    """
    line = F.regexp_replace(F.trim("value"), r"^\s+|\s+$", "")
    record = F.from_json(F.regexp_replace(line, ",$", ""), schemas.ENTITY_JSON)
    return lines.where(F.startswith(line, F.lit("{"))).select(record.alias("e")).select(
        "e.id",
        F.col("e.sitelinks.enwiki.title").alias("wikipedia_id"),
        F.col("e.labels.en.value").alias("title"),
        F.col("e.descriptions.en.value").alias("description"),
        "e.claims")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Entity dump (plain or bz2, read in splits)."""
    return entity_lines(spark.read.text(path))


def read_pageview_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines of every hourly file in a folder.  gzip allows one task per file."""
    return spark.read.text(f"{folder}/*.gz")
