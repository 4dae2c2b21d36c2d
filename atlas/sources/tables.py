"""Stored relations, query results, mapping dimensions and generated buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas import fixed_values as fv, schemas
from atlas.functions import geo, text as tx


def load_table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A stored relation, or the given columns of it."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def load_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A relation of a database; give partitionColumn, bounds and numPartitions to read in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """``triples(s, p, o, lang)`` with identifiers cut to their tails."""
    return tidy_triples(spark.read.schema(schemas.TRIPLES).parquet(path))


def tidy_triples(df: DataFrame) -> DataFrame:
    """Predicates and subjects without their address; articles and objects as they are.

    An article's address is kept whole, as its title may contain a slash.
    """
    article = F.contains("s", F.lit("/wiki/"))
    return df.select(
        F.when(article, F.col("s")).otherwise(tx.uri_tail(F.col("s"))).alias("s"),
        F.regexp_extract("p", r"([^/#]+)$", 1).alias("p"),
        "o", "lang")


def decode_bindings(df: DataFrame, column: str = "value") -> DataFrame:
    """Typed persons from query-result JSON, one document per row; absent variables are NULL."""
    parsed = df.select(F.explode(F.from_json(
        F.get_json_object(column, "$.results.bindings"), schemas.BINDINGS)).alias("b"))

    def value(name):
        return F.col("b")[name]["value"]

    def ids(name):
        return F.transform(tx.split_list(value(name)), tx.uri_tail)

    pob, pod = geo.parse_point(value("pobCoords")), geo.parse_point(value("podCoords"))
    return parsed.select(
        tx.uri_tail(value("person")).alias("qid"),
        tx.title_from_url(value("article")).alias("enwiki_title"),
        value("personLabel").alias("name"),
        tx.uri_tail(value("gender")).alias("gender_qid"),
        tx.iso_year(value("dob")).alias("year_born"),
        tx.iso_year(value("dod")).alias("year_died"),
        tx.split_list(value("citCodes")).alias("citizenship_country_codes"),
        tx.uri_tail(value("pob")).alias("pob_qid"),
        pob.lat.alias("pob_lat"), pob.lng.alias("pob_lon"),
        value("pobCC").alias("pob_country_code"),
        tx.uri_tail(value("pod")).alias("pod_qid"),
        pod.lat.alias("pod_lat"), pod.lng.alias("pod_lon"),
        value("podCC").alias("pod_country_code"),
        ids("occupations").alias("occupation_qids"),
        ids("fields").alias("field_qids"),
        tx.uri_tail(value("manner")).alias("manner_of_death_qid"),
        value("image").alias("image_filename"),
        value("sitelinks").try_cast("int").alias("sitelink_count"),
    )


def read_labels(triples: DataFrame, lang: str = "en") -> DataFrame:
    """Labels in one language, one per id."""
    return (
        triples.where((F.col("p") == fv.LABEL) & (F.col("lang") == lang))
        .groupBy(F.col("s").alias("qid")).agg(F.min("o").alias("label"))
    )


def read_people_csv(spark: SparkSession, path: str) -> DataFrame:
    """Person trends from CSV with a header; empty fields are NULL."""
    return spark.read.csv(path, header=True, schema=schemas.PERSON_TRENDS, nullValue="", enforceSchema=False)


def dim_field(spark: SparkSession) -> DataFrame:
    """Last word of a category -> field of work."""
    return _dimension(spark, fv.FIELD_OF_WORD, "word STRING, field STRING")


def dim_infobox(spark: SparkSession) -> DataFrame:
    """Kind of infobox -> field of work."""
    return _dimension(spark, fv.FIELD_OF_INFOBOX, "infobox STRING, field STRING")


def _dimension(spark, lines, schema):
    """A fixed table of fewer than 200 rows, marked for broadcast as it cannot grow."""
    return F.broadcast(spark.createDataFrame(list(fv.lookup_table(lines).items()), schema))


def dim_country_codes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """ISO 3166 codes ``alpha2, alpha3``: a table of your own, or the one the JVM carries."""
    if path:
        return spark.read.parquet(path).select("alpha2", "alpha3")
    locale = spark._jvm.java.util.Locale
    rows = [(code, locale("", code).getISO3Country()) for code in locale.getISOCountries()]
    return F.broadcast(spark.createDataFrame(rows, "alpha2 STRING, alpha3 STRING"))


def read_country_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Country polygons: ``poly_id, iso_a3, name, continent, rings``.

    A Parquet table in that shape, or a GeoJSON feature collection (``*.geojson``)
    of polygons and multi-polygons, numbered in file order.
    """
    if not path.endswith(".geojson"):
        return spark.read.schema(schemas.POLYGONS).parquet(path)
    shape = """features ARRAY<STRUCT<properties: STRUCT<iso_a3: STRING, name: STRING, continent: STRING>,
               geometry: STRUCT<type: STRING, coordinates: STRING>>>"""
    features = spark.read.schema(shape).json(path, multiLine=True).select(
        F.posexplode("features").alias("poly_id", "f"))
    ring = "ARRAY<ARRAY<ARRAY<DOUBLE>>>"
    raw = F.col("f.geometry.coordinates")
    rings = F.when(F.col("f.geometry.type") == "MultiPolygon", F.flatten(F.from_json(raw, f"ARRAY<{ring}>"))) \
        .otherwise(F.from_json(raw, ring))
    corners = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return features.select("poly_id", "f.properties.*", corners.alias("rings"))


def read_year_partition(spark: SparkSession, path: str, *years: int) -> DataFrame:
    """Parsed people of the given birth years; other partitions are not listed."""
    df = spark.read.parquet(path)
    return df.where(F.col("birth_year").isin(*years)) if years else df


def year_buckets(spark: SparkSession, start: int, end: int, inclusive: bool = True) -> DataFrame:
    """One row per year, named by its text."""
    years = spark.range(start, end + 1 if inclusive else end)
    return years.select(F.col("id").cast("int").alias("year"), F.col("id").cast("string").alias("bucket"))
