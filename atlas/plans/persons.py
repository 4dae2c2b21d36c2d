"""Triples to the persons table, and labels for the ids it refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from atlas import fixed_values as fv
from atlas.functions import geo, text as tx
from atlas.operators.joins import in_key_set, lookup, pending
from atlas.operators.stats import distinct_ids
from atlas.session import stage
from atlas.sources.tables import read_labels

_SAMPLED = {
    "gender_qid": fv.GENDER, "dod": fv.DATE_OF_DEATH, "pob": fv.PLACE_OF_BIRTH, "pod": fv.PLACE_OF_DEATH,
    "manner_of_death_qid": fv.MANNER_OF_DEATH, "image_filename": fv.IMAGE,
    "sitelink_count": fv.SITELINKS,
}
_LISTED = {"occupation_qids": fv.OCCUPATION, "field_qids": fv.FIELD_OF_WORK}
_READ = [
    fv.INSTANCE_OF, fv.DATE_OF_BIRTH, fv.LABEL, *_SAMPLED.values(), *_LISTED.values(), fv.ARTICLE_ABOUT,
    fv.ARTICLE_SITE, fv.CITIZENSHIP, fv.COUNTRY_ALPHA2, fv.COORDINATES, fv.COUNTRY,
]


def humans(triples: DataFrame) -> DataFrame:
    """Subjects that are an instance of human."""
    return triples.where(
        (F.col("p") == fv.INSTANCE_OF) & (tx.uri_tail(F.col("o")) == fv.HUMAN)).select("s").distinct()


def needed_statements(triples: DataFrame) -> DataFrame:
    """Statements that persons are made of."""
    return triples.where(F.col("p").isin(_READ) & ((F.col("p") != fv.LABEL) | (F.col("lang") == "en")))


def birth_statements(triples: DataFrame) -> DataFrame:
    """``s, year, o`` of every date of birth; the year is NULL where it can't be read."""
    return triples.where(F.col("p") == fv.DATE_OF_BIRTH).select("s", tx.iso_year(F.col("o")).alias("year"), "o")


def english_articles(triples: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """``s, article``: the entity an English article is about (one of ``people``), one article each."""
    about = triples.where(F.col("p") == fv.ARTICLE_ABOUT).select(
        F.col("s").alias("article_id"), tx.uri_tail(F.col("o")).alias("s"))
    if people is not None:
        about = about.join(people.select("s"), "s", "left_semi")
    english = triples.where((F.col("p") == fv.ARTICLE_SITE) & (F.col("o") == fv.ENGLISH_SITE)).select(
        F.col("s").alias("article_id"))
    return about.join(english, "article_id", "left_semi").groupBy("s").agg(F.min("article_id").alias("article"))


def qualified(births: DataFrame, triples: DataFrame) -> DataFrame:
    """``s, dob, article``: humans among ``births`` that have a site-link count and an English article.

    Of several dates of birth the last is taken, as a later year's import would replace an earlier
    one's row.  Every step is tested against what is left before it.
    """
    born = births.groupBy("s").agg(F.max(F.struct("year", "o"))["o"].alias("dob"))
    linked = triples.where((F.col("p") == fv.SITELINKS) & F.col("o").isNotNull())
    human = triples.where((F.col("p") == fv.INSTANCE_OF) & (tx.uri_tail(F.col("o")) == fv.HUMAN))
    people = born.join(human.select("s"), "s", "left_semi").join(linked.select("s"), "s", "left_semi")
    return people.join(english_articles(triples, people), "s")


def person_facts(triples: DataFrame, people: DataFrame) -> DataFrame:
    """``people`` with their sampled and listed properties.

    Statements of other subjects are dropped by a semi-join before anything is aggregated.  One
    conditional aggregation replaces a self-join per property.
    """
    p, o = F.col("p"), F.col("o")
    wanted = [fv.LABEL, *_SAMPLED.values(), *_LISTED.values()]
    own = triples.where(p.isin(wanted)).join(people.select("s"), "s", "left_semi")
    sampled = [F.min(F.when(p == pid, o)).alias(name) for name, pid in _SAMPLED.items()]
    listed = [F.collect_set(F.when(p == pid, tx.uri_tail(o))).alias(name) for name, pid in _LISTED.items()]
    name = F.min(F.when((p == fv.LABEL) & (F.col("lang") == "en"), o)).alias("name")
    return people.join(own.groupBy("s").agg(name, *sampled, *listed), "s")


def country_codes(triples: DataFrame) -> DataFrame:
    """``country, code`` of entities with an alpha-2 code."""
    return triples.where(F.col("p") == fv.COUNTRY_ALPHA2).groupBy(F.col("s").alias("country")).agg(
        F.min("o").alias("code"))


def citizenships(triples: DataFrame, people: DataFrame | None = None) -> DataFrame:
    """``s, citizenship_country_codes``: sorted distinct codes of the countries of citizenship (of ``people``)."""
    claims = triples.where(F.col("p") == fv.CITIZENSHIP).select("s", tx.uri_tail(F.col("o")).alias("country"))
    if people is not None:
        claims = claims.join(people.select("s"), "s", "left_semi")
    named = lookup(claims, country_codes(triples), "country", ["s"], "inner")
    return named.groupBy("s").agg(F.array_sort(F.collect_set("code")).alias("citizenship_country_codes"))


def places(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """``place, lat, lon, country_code`` of the ``wanted`` places with coordinates or a country."""
    p, o = F.col("p"), F.col("o")
    located = in_key_set(triples.where(p == fv.COORDINATES), "s", wanted, "place").groupBy(F.col("s").alias("place")).agg(
        geo.parse_point(F.min(o)).alias("at"))
    claims = in_key_set(triples.where(p == fv.COUNTRY), "s", wanted, "place").select(
        F.col("s").alias("place"), tx.uri_tail(o).alias("country"))
    coded = lookup(claims, country_codes(triples), "country", ["place"], "inner").groupBy("place").agg(
        F.min("code").alias("country_code"))
    return located.join(coded, "place", "full").select(
        "place", F.col("at.lat").alias("lat"), F.col("at.lng").alias("lon"), "country_code")


def persons(triples: DataFrame, start: int = 1800, end: int = 2000, keep=stage) -> DataFrame:
    """The persons table: humans with a date of birth, an English article and a site-link count.

    Years ``start`` to ``end`` inclusive.  The statements needed are written once, a folder per
    predicate, so that each step reads its own.
    """
    triples = keep(needed_statements(triples).hint("rebalance", "p"), "statements", "p")
    return persons_of(birth_statements(triples).where(F.col("year").between(start, end)), triples, keep)


def persons_of(births: DataFrame, triples: DataFrame, keep=stage) -> DataFrame:
    """The persons of ``births`` (s, year, o), from statements about them and about their places.

    Place of birth and death are one place each, with the coordinates and country of that place.
    Only statements of qualified people, and of places that they were born or died in, are aggregated.
    """
    people = keep(qualified(births, triples), "people")
    facts = keep(person_facts(triples, people), "facts")
    slim = facts.select("s", tx.uri_tail(F.col("pob")).alias("pob_qid"), tx.uri_tail(F.col("pod")).alias("pod_qid"))
    wanted = slim.select(F.explode(F.array_compact(F.array("pob_qid", "pod_qid"))).alias("place"))
    known = keep(places(triples, wanted), "places")

    def at(role):
        dim = known.select(
            F.col("place").alias(f"{role}_qid"), F.col("lat").alias(f"{role}_lat"),
            F.col("lon").alias(f"{role}_lon"), F.col("country_code").alias(f"{role}_country_code"))
        return dim

    placed = lookup(lookup(slim, at("pob"), "pob_qid", ["s"]), at("pod"), "pod_qid", ["s"])
    none_if_empty = lambda c: F.when(F.size(c) > 0, F.array_sort(c)).alias(c)
    return facts.join(placed, "s").join(citizenships(triples, people), "s", "left").select(
        F.col("s").alias("qid"), tx.title_from_url(F.col("article")).alias("enwiki_title"), "name",
        tx.uri_tail(F.col("gender_qid")).alias("gender_qid"),
        tx.iso_year(F.col("dob")).alias("year_born"), tx.iso_year(F.col("dod")).alias("year_died"),
        "citizenship_country_codes",
        "pob_qid", "pob_lat", "pob_lon", "pob_country_code",
        "pod_qid", "pod_lat", "pod_lon", "pod_country_code",
        none_if_empty("occupation_qids"), none_if_empty("field_qids"),
        tx.uri_tail(F.col("manner_of_death_qid")).alias("manner_of_death_qid"), "image_filename",
        F.col("sitelink_count").try_cast("int").alias("sitelink_count"))


def flat_persons(df: DataFrame) -> DataFrame:
    """Persons with their lists as pipe-joined text."""
    lists = ("citizenship_country_codes", "occupation_qids", "field_qids")
    return df.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns])


def referenced_ids(people: DataFrame) -> DataFrame:
    """Distinct ids a persons table refers to."""
    return distinct_ids(
        people, ["gender_qid", "manner_of_death_qid", "pob_qid", "pod_qid"], ["occupation_qids", "field_qids"])


def missing_labels(people: DataFrame, labels: DataFrame, force: bool = False) -> DataFrame:
    return pending(referenced_ids(people), labels, "qid", force)


def fetch_labels(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """English labels of the wanted ids."""
    return in_key_set(read_labels(triples), "qid", wanted, "qid")


def pending_years(buckets: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Years that no earlier import has recorded."""
    return pending(buckets, ledger, "bucket", force)
