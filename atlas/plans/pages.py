"""Page dump to a searchable table, and questions about pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas import fixed_values as fv
from atlas.functions import markup as mk, predicates as pr, text as tx
from atlas.operators.dedupe import keep_first, rank_top, resolve_collisions, top
from atlas.operators.joins import holding_all
from atlas.operators.stats import observed
from atlas.session import stage
from atlas.sinks.tables import write_unique_pages
from atlas.sources.dumps import parse_records, read_page_records, record_title


def tag_pages(pages: DataFrame) -> DataFrame:
    """``title, wiki_id, wikitext`` with infobox, templates, categories, general and lng_lat.

    No shuffle.  Pages with an over-long title are dropped; an infobox cannot be
    over-long, as its tag would have been dropped before.
    """
    scanned = pages.where(F.length("title") <= fv.MAX_NAME_CHARS).withColumn("_m", mk.scan(F.col("wikitext"), with_plain=False))
    names = tx.tidy_tags(F.transform("_m.templates", lambda t: t["name"]))
    tagged = scanned.select(
        "title", "wiki_id", "wikitext",
        names.alias("_names"),
        tx.normalise_tags(tx.categories(F.col("_m.links"))).alias("categories"),
        mk.coordinate_values(F.col("_m.templates")).alias("_at"))
    return tagged.select(
        "title", "wiki_id", tx.infobox_type(F.col("_names")).alias("infobox"), "wikitext",
        F.array_sort("_names").alias("templates"), "categories",
        tx.normalise_tags(F.transform("categories", tx.generalise)).alias("general"),
        mk.best_coordinate(F.col("_at")).alias("lng_lat"))


def import_pages(spark: SparkSession, dump: str, path: str, limit: int = 0) -> DataFrame:
    """A page dump into the page table; ``limit`` above 0 stops after so many records."""
    return import_counted_pages(spark, dump, path, limit)[0]


def import_counted_pages(spark: SparkSession, dump: str, path: str, limit: int = 0) -> tuple[DataFrame, dict[str, int]]:
    """The page table of a dump, and what was counted on the way; of pages with one title the lowest id stays.

    Titles that repeat are found in a narrow pass that cuts them out of the record's text.  The second pass
    parses every page once: pages of other titles are written as they come, and only those of repeated
    titles are sorted, after malformed ones are left out.  Counters are ``records`` read, ``malformed``,
    ``too_long`` (by title), ``duplicates`` and pages ``written``; they are observed while the pages are
    written.  Where a lost executor makes Spark repeat a task, its rows may count twice.
    """
    records = read_page_records(spark, dump, limit).withColumn("cut", record_title(F.col("value")))
    repeated = stage(records.groupBy("cut").count().where("count > 1").select("cut"), "repeated")
    too_long, watched = F.length("title") > fv.MAX_NAME_CHARS, []

    def observe(df, name, counters):
        seen, observation = observed(df, name, counters)
        watched.append(observation)
        return seen

    def parsed(rows, name):
        pages = observe(parse_records(rows), name, {
            "records": F.count("*"), "malformed": F.count_if("malformed"), "too_long": F.count_if(~F.col("malformed") & too_long)})
        return pages.where(~F.col("malformed") & ~too_long).select("title", "wiki_id", "wikitext")

    pages = parsed(records.join(repeated, "cut", "left_anti"), "single")
    if not repeated.isEmpty():
        several = observe(parsed(records.join(repeated, "cut", "left_semi"), "several"), "before", {"duplicates": F.count("*")})
        first = keep_first(several, ["title"], [F.col("wiki_id").isNull(), "wiki_id", "wikitext"])
        pages = pages.unionByName(observe(first, "after", {"duplicates": -F.count("*")}))
    table = write_unique_pages(observe(tag_pages(pages), "written", {"written": F.count("*")}), path)
    counters = dict.fromkeys(("records", "malformed", "too_long", "duplicates", "written"), 0)
    for observation in watched:
        for name, n in observation.get.items():
            counters[name] += n
    return table, counters


def tagged_pages(pages: DataFrame, general=(), categories=(), templates=(), infobox: str | None = None) -> DataFrame:
    """Pages that carry all given tags."""
    found = pages if infobox is None else pages.where(F.col("infobox") == infobox)
    for column, wanted in (("general", general), ("categories", categories), ("templates", templates)):
        if wanted:
            found = found.where(pr.array_contains_all(F.col(column), wanted))
    return found


def page_tags(pages: DataFrame) -> DataFrame:
    """``kind, tag, title, wiki_id``: a row for each tag of each page, the infobox among them."""
    def of_kind(kind, values):
        own = F.coalesce(values, F.array().cast("array<string>"))
        return F.transform(own, lambda tag: F.struct(F.lit(kind).alias("kind"), tag.alias("tag")))

    tags = F.concat(*[of_kind(kind, F.col(kind)) for kind in ("general", "categories", "templates")],
                    of_kind("infobox", F.array_compact(F.array("infobox"))))
    return pages.select(F.explode(tags).alias("t"), "title", "wiki_id").select("t.kind", "t.tag", "title", "wiki_id")


def indexed_pages(index: DataFrame, general=(), categories=(), templates=(), infobox: str | None = None) -> DataFrame:
    """``title, wiki_id`` of pages that carry all given tags (one at least), from the tag index alone."""
    wanted = [("general", general), ("categories", categories), ("templates", templates), ("infobox", [infobox] if infobox else [])]
    tests = [(F.col("kind") == kind) & (F.col("tag") == tag) for kind, tags in wanted for tag in dict.fromkeys(tags)]
    if not tests:
        raise ValueError("no tag is asked for")
    return holding_all(index, ["title", "wiki_id"], tests)


def with_views(pages: DataFrame, views: DataFrame, how: str = "inner") -> DataFrame:
    """Pages with their view count; ``left`` keeps pages nobody viewed."""
    return pages.join(views, "title", how)


def most_viewed_by_infobox(pages: DataFrame, views: DataFrame, infobox: str, n: int = fv.TOP_BY_VIEWS) -> DataFrame:
    """The most viewed pages with one kind of infobox."""
    return top(with_views(tagged_pages(pages, infobox=infobox), views), n, "viewcount", "title")


def gazetteer(pages: DataFrame, views: DataFrame, n: int = fv.GAZETTEER_SIZE, keep: str = "first") -> DataFrame:
    """``name, lat, lng, rank`` of the most viewed located countries and cities.

    Names are lower case up to their first comma; ``keep`` says which place stays
    when names collide: the ``first`` (most viewed), or the ``last``.
    """
    places = pages.where(
        pr.has_coordinate(F.col("lng_lat"))
        & pr.array_overlaps(F.col("general"), fv.COUNTRY_TERMS + fv.CITY_TERMS)
    ).select("title", "lng_lat")
    ranked = rank_top(with_views(places, views), n, "viewcount", "title").select(
        F.col("title").alias("raw"), tx.place_key(F.col("title")).alias("name"),
        F.col("lng_lat.lat").alias("lat"), F.col("lng_lat.lng").alias("lng"), "rank")
    return resolve_collisions(ranked, "raw", "name", "rank", keep).drop("raw")
