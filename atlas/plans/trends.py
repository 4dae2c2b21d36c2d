"""People found by their birth category, and what their articles say about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atlas import fixed_values as fv
from atlas.functions import geo, markup as mk, predicates as pr, text as tx
from atlas.operators import stats
from atlas.operators.joins import first_hits, in_key_set, lookup, points_in_polygons
from atlas.session import stage, stage_articles


def people_by_birth_category(pages: DataFrame, views: DataFrame,
                             first: int = fv.BIRTH_CATEGORY_YEARS[0],
                             last: int = fv.BIRTH_CATEGORY_YEARS[1], only: list[int] | None = None) -> DataFrame:
    """Parsed people, once per birth year they are filed under, with their views.

    The article is parsed where it is read; only narrow rows are shuffled to
    meet the page views.  ``only`` names the years wanted; articles of no such year are not parsed.
    """
    years = tx.birth_category_years(F.col("categories"), first, last)
    if only is not None:
        years = F.filter(years, lambda year: year.isin(only))
    filed = pages.withColumn("_years", years).where(F.size("_years") > 0)
    parsed = parse_people(filed, "_years")
    return parsed.join(views, parsed["person_name"] == views["title"], "left").select(
        F.explode("_years").alias("birth_year"),
        *[c for c in parsed.columns if c != "_years"], F.col("viewcount").alias("view_count"))


def parse_people(pages: DataFrame, *extra: str) -> DataFrame:
    """Words, links, places and years of each article."""
    scanned = pages.select("title", "wiki_id", "infobox", *extra, mk.scan(F.col("wikitext")).alias("_m"))
    columns = scanned.select(
        F.col("title").alias("person_name"), "wiki_id", "infobox", *extra,
        F.col("_m.links").alias("wikilinks"),
        mk.infobox_params(F.col("_m.templates")).alias("_params"),
        tx.words(mk.plain_text(F.col("_m.plain"))).alias("_words"))
    return columns.select(
        "person_name", "wiki_id", "infobox", *extra, "wikilinks",
        mk.place_links(F.col("_params")).alias("locations"),
        F.size("_words").alias("word_count"),
        tx.word_counts(F.col("_words"), fv.GENDER_WEIGHTS).alias("gender_words"),
        tx.birth_year(F.col("wikilinks")).alias("born"),
        tx.death_year(F.col("wikilinks")).alias("died"))


def first_name_scores(people: DataFrame, weight: str | None = None) -> DataFrame:
    """``first_name, name_score``: mean word score of everyone of a first name.

    ``weight`` counts how often a row stands in the list being averaged.
    """
    times = F.col(weight) if weight else F.lit(1)
    scored = people.select(
        tx.first_name(F.col("person_name")).alias("first_name"),
        tx.word_score(F.col("gender_words")).alias("score"), times.alias("_times"))
    return scored.groupBy("first_name").agg(
        (F.sum(F.col("score") * F.col("_times")) / F.sum("_times")).alias("name_score"))


def assign_genders(people: DataFrame, scores: DataFrame) -> DataFrame:
    """``people`` with ``gender``: by their own words, leaning on others of their first name."""
    named = people.withColumn("first_name", tx.first_name(F.col("person_name")))
    both = lookup(named, scores, "first_name", ["person_name"])
    total = tx.word_score(F.col("gender_words")) + F.col("name_score") * fv.FIRST_NAME_WEIGHT
    return both.withColumn("gender", F.when(total < 0, "female").otherwise("male")).drop("first_name", "name_score")


def located_titles(people: DataFrame, pages: DataFrame) -> DataFrame:
    """``location, lng, lat`` of pages that are the first location of someone."""
    first = people.select(F.try_element_at("locations", F.lit(1)).alias("location")).where("location != ''")
    placed = pages.where(pr.has_coordinate(F.col("lng_lat"))).select(
        F.col("title").alias("location"), F.col("lng_lat.lng").alias("lng"), F.col("lng_lat.lat").alias("lat"))
    return in_key_set(placed, "location", first, "location")


def located_countries(people: DataFrame, pages: DataFrame, polygons: DataFrame, codes: DataFrame) -> DataFrame:
    """``location, lat, lng, country_code, country, continent`` of the located titles."""
    found = points_in_polygons(located_titles(people, pages), polygons, "location").select(
        "location", "lat", "lng",
        F.col("name").alias("country"), "continent",
        geo.fix_country_code(F.col("name"), F.col("iso_a3")).alias("iso_a3"))
    alpha2 = codes.select(F.col("alpha3").alias("iso_a3"), F.col("alpha2").alias("country_code"))
    return found.join(alpha2, "iso_a3", "left").drop("iso_a3")


def find_locations(people: DataFrame, places: DataFrame) -> DataFrame:
    """``person_name`` and the first located of their places and links; people without one are left out."""
    return first_hits(people, "person_name", F.concat("locations", "wikilinks"), places, "location")


def field_votes(links: Column, infobox: Column) -> tuple[Column, Column]:
    """Field and occupation of a person by the last words of their categories.

    Each known word is a vote for itself and its field; the infobox has three
    votes for its field.  The first seen wins a tie.  Two fixed tables of fewer
    than 200 entries, looked up inside the row.
    """
    def table(lines):
        return F.str_to_map(F.lit(lines.strip()), F.lit("\n"), F.lit(": "))

    field_of = table(fv.FIELD_OF_WORD)
    words = F.transform(tx.categories(links), tx.last_word)
    known = F.filter(words, lambda w: F.try_element_at(field_of, w).isNotNull())

    def vote(key, weight):
        return F.struct(key.alias("key"), F.lit(weight).alias("weight"))

    by_infobox = F.try_element_at(table(fv.FIELD_OF_INFOBOX), F.coalesce(infobox, F.lit("")))
    fields = F.concat(
        F.transform(known, lambda w: vote(F.try_element_at(field_of, w), 1)),
        F.when(by_infobox.isNotNull(), F.array(vote(by_infobox, fv.INFOBOX_VOTES))).otherwise(
            F.array().cast("array<struct<key: string, weight: int>>")))
    return stats.winner(fields), stats.winner(F.transform(known, lambda w: vote(w, 1)))


def person_trends(pages: DataFrame, views: DataFrame, polygons: DataFrame, codes: DataFrame,
                  keep=stage, first: int = fv.BIRTH_CATEGORY_YEARS[0],
                  last: int = fv.BIRTH_CATEGORY_YEARS[1]) -> DataFrame:
    """The person trends table.  ``pages`` holds each title once.

    The parsed people are written once and read by the steps that need them; so
    are the located places and the scores of first names, whose measured size
    decides how they are joined.  A
    person filed under several birth years is kept as one row that counts
    as many times where first names are averaged.
    """
    years = tx.birth_category_years(F.col("categories"), first, last)
    filed = pages.withColumn("_times", F.size(years)).where("_times > 0")
    people = (stage_articles if keep is stage else keep)(parse_people(filed, "_times"), "people")
    places = keep(located_countries(people, pages, polygons, codes), "places")
    scores = keep(first_name_scores(people, "_times"), "scores")
    field, occupation = field_votes(F.col("wikilinks"), F.col("infobox"))
    kept = people.where(pr.plausible_years(F.col("born"), F.col("died"))).select(
        "person_name", "word_count", "born", "died", "gender_words",
        field.alias("field"), occupation.alias("occupation"))
    gendered = assign_genders(kept, scores)
    joined = gendered.join(find_locations(people, places), "person_name", "left").join(
        views.withColumnRenamed("title", "person_name"), "person_name", "left")
    known = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select(
        "person_name", F.col("viewcount").alias("view_count"), "word_count",
        F.col("born").alias("year_born"), F.col("died").alias("year_died"),
        "gender", "occupation", "field", known("country_code"), known("continent"))
