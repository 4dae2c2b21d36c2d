"""Page dump, markup, page views, gazetteer and people found by category."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas import fixed_values as fv
from atlas.catalog import inputs
from atlas.catalog.registry import query
from atlas.functions import geo, markup as mk, text as tx
from atlas.operators.joins import first_resolved, points_in_polygons
from atlas.plans import imports, pages, pageviews, trends
from atlas.session import scratch_dir, spread, stage_articles
from atlas.sinks import tables as sinks
from atlas.sources import dumps, tables


def _articles(spark, folder):
    return spread(inputs.in_spark(spark, folder, inputs.ARTICLES))


def _places(spark, folder):
    return inputs.in_spark(spark, folder, inputs.PLACES)


def _views(spark, folder):
    return inputs.in_spark(spark, folder, inputs.VIEWS)


def _raw_pages(spark, folder):
    """Untagged pages: articles about people, and about places with ids above theirs."""
    people = _articles(spark, folder).select("title", "wiki_id", "wikitext")
    places = _places(spark, folder).select("title", (-F.col("wiki_id") - 1).alias("wiki_id"), "wikitext")
    return people.unionByName(places)


def _flat(df, *lists):
    return df.select(*[F.array_join(c, "|").alias(c) if c in lists else F.col(c) for c in df.columns])


# --- page views ---------------------------------------------------------------

_TOTALS = "SELECT title, CAST(sum(n) AS BIGINT) AS viewcount FROM [VIEW_LINES] v WHERE counts GROUP BY 1"


@query(_TOTALS)
def pageview_totals(spark, folder):
    return pageviews.pageview_totals(inputs.in_spark(spark, folder, inputs.VIEW_LINES).select("value"))


@query(_TOTALS)
def pageview_import(spark, folder):
    """View logs written as gzip text, imported from there into the page-view table."""
    root = scratch_dir(spark)
    inputs.in_spark(spark, folder, inputs.VIEW_LINES).select("value").write.text(
        f"{root}/logs", compression="gzip")
    return pageviews.import_pageviews(spark, f"{root}/logs", f"{root}/pageviews")


@query(f"{_TOTALS} ORDER BY viewcount DESC, title LIMIT 25")
def top_viewed_titles(spark, folder):
    lines = inputs.in_spark(spark, folder, inputs.VIEW_LINES).select("value")
    return pageviews.top_titles(pageviews.pageview_totals(lines))


@query("SELECT title, count(*) AS n FROM [VIEW_LINES] v GROUP BY 1")
def decoded_titles(spark, folder):
    raw = inputs.in_spark(spark, folder, inputs.VIEW_LINES).select(
        F.get(F.split("value", " "), F.lit(1)).alias("raw"))
    return raw.groupBy(tx.decode_title(F.col("raw")).alias("title")).agg(F.count("*").alias("n"))


# --- pages ----------------------------------------------------------------------

_TAGS = """
SELECT title, wiki_id, infobox, templates, categories, general, round(lng, 6) AS lng, round(lat, 6) AS lat FROM (
  SELECT title, wiki_id, kind AS infobox,
         concat('cite|infobox ', kind, '|inner|nowrap') AS templates,
         array_to_string(list_sort(list_distinct([concat(born, CASE WHEN bc THEN ' bc births' ELSE ' births' END)]
             || CASE WHEN twice THEN [concat(born + 1, ' births')] ELSE [] END
             || CASE WHEN died IS NULL THEN [] ELSE [concat(died, ' deaths')] END
             || [concat('old ', job_a), concat('great ', job_b), concat('texts of ', lang)])), '|') AS categories,
         'texts' AS general, CAST(NULL AS DOUBLE) AS lng, CAST(NULL AS DOUBLE) AS lat
  FROM [ARTICLES] a
  UNION ALL
  SELECT title, -wiki_id - 1, 'settlement',
         CASE k WHEN 0 THEN 'coord|infobox settlement' WHEN 1 THEN 'coord|infobox settlement'
                WHEN 2 THEN 'coord missing|infobox settlement' WHEN 3 THEN 'coor dms|infobox settlement'
                WHEN 4 THEN 'coord|geolinks-start|infobox settlement' ELSE 'coord|infobox settlement' END,
         concat(lower(area), ' in nation ', s.s_nationkey), lower(area), lng, lat
  FROM [PLACES] p JOIN supplier s ON s.s_suppkey = p.wiki_id) t
"""


def _tags(df):
    flat = _flat(df, "templates", "categories", "general").drop("wikitext")
    return flat.withColumns({
        "lng": F.round("lng_lat.lng", 6), "lat": F.round("lng_lat.lat", 6)}).drop("lng_lat")


@query(_TAGS)
def page_tags(spark, folder):
    return _tags(pages.tag_pages(_raw_pages(spark, folder)))


@query(_TAGS)
def page_import(spark, folder):
    """Pages written as an XML dump, imported from there into the page table."""
    root = scratch_dir(spark)
    text = F.struct(F.col("wikitext").alias("_VALUE"), F.length("wikitext").alias("_bytes"))
    _raw_pages(spark, folder).select(
        "title", F.lit(0).alias("ns"), F.col("wiki_id").alias("id"),
        F.struct((F.col("wiki_id") + 7).alias("id"), text.alias("text")).alias("revision"),
    ).write.xml(f"{root}/dump", rowTag="page")
    return _tags(pages.import_pages(spark, f"{root}/dump", f"{root}/pages"))


@query(f"""
WITH pages AS (SELECT wiki_id FROM ({_TAGS}) t), n AS (
  SELECT count(*) AS all_pages, count(*) FILTER (WHERE wiki_id % 7 = 0) AS broken, count(*) FILTER (WHERE wiki_id % 5 = 0) AS again,
         count(*) FILTER (WHERE wiki_id % 50 = 0) AS long FROM pages)
SELECT 'records' AS counter, all_pages + broken + again + long AS n FROM n
UNION ALL SELECT 'malformed', broken FROM n UNION ALL SELECT 'too_long', long FROM n
UNION ALL SELECT 'duplicates', again FROM n UNION ALL SELECT 'written', all_pages FROM n
""")
def page_load_counters(spark, folder):
    """An import of a dump with broken, repeated and over-long pages; what it counted is read from the table of loads."""
    root, wiki_id = scratch_dir(spark), F.col("wiki_id")
    escaped = F.replace(F.replace(F.replace("wikitext", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))

    def record(title, page_id, text):
        return F.concat(F.lit("  <page>\n    <title>"), title, F.lit("</title>\n    <ns>0</ns>\n    <id>"), page_id,
                        F.lit("</id>\n    <revision><id>7</id><text>"), text, F.lit("</text></revision>\n  </page>"))

    # a broken page has the title of a good one and a lower id, a repeated one a greater id
    records = F.array_compact(F.array(
        record(F.col("title"), wiki_id, escaped),
        F.when(wiki_id % 7 == 0, record(F.col("title"), F.lit(-10_000_000) - F.abs(wiki_id), F.lit("open <b> & so on"))),
        F.when(wiki_id % 5 == 0, record(F.col("title"), F.lit(10_000_000) + F.abs(wiki_id), F.lit("later"))),
        F.when(wiki_id % 50 == 0, record(F.concat(F.col("title"), F.repeat(F.lit("x"), 1024)), F.lit(1), F.lit("long")))))
    _raw_pages(spark, folder).select(F.explode(records).alias("value")).write.text(f"{root}/dump.xml")
    _, counters = pages.import_counted_pages(spark, f"{root}/dump.xml", f"{root}/pages")
    return sinks.record_load(spark, f"{root}/loads", "dump.xml", counters).select("counter", "n")


@query("""
SELECT wiki_id, round(lng, 6) AS lng, round(lat, 6) AS lat FROM [PLACES] p
""")
def page_coordinates(spark, folder):
    scanned = _places(spark, folder).select("wiki_id", mk.scan(F.col("wikitext")).alias("m"))
    values = scanned.select("wiki_id", mk.coordinate_values(F.col("m.templates")).alias("values"))
    return values.select("wiki_id", mk.best_coordinate(F.col("values")).alias("at")).select(
        "wiki_id", F.round("at.lng", 6).alias("lng"), F.round("at.lat", 6).alias("lat"))


@query("""
SELECT wiki_id, concat('Infobox ', kind, '|nowrap|cite|inner') AS templates,
       concat(CASE WHEN birth_place IS NULL THEN '' ELSE concat(place_a, '|Nowhere|') END, place_b, '|', place_c,
              '|Nested page|Last page') AS links
FROM [ARTICLES] a
""")
def templates_and_links(spark, folder):
    scanned = _articles(spark, folder).select("wiki_id", mk.scan(F.col("wikitext")).alias("m"))
    plain_links = F.filter("m.links", lambda link: ~F.startswith(link, F.lit(fv.CATEGORY_PREFIX)))
    return scanned.select(
        "wiki_id", F.array_join(F.transform("m.templates", lambda t: t["name"]), "|").alias("templates"),
        F.array_join(plain_links, "|").alias("links"))


@query("""
SELECT wiki_id, CAST(len(regexp_extract_all(wikitext, '\\[\\[([^\\[\\]|]+)')) AS INT) AS n_targets,
       born + CASE WHEN twice THEN 1 ELSE 0 END AS born, died
FROM [ARTICLES] a
""")
def links_without_scanning(spark, folder):
    links = tx.strip(F.col("wikitext"))
    return _articles(spark, folder).select("wiki_id", mk.link_targets(links).alias("links")).select(
        "wiki_id", F.size("links").alias("n_targets"),
        tx.birth_year(F.col("links")).alias("born"), tx.death_year(F.col("links")).alias("died"))


@query("""
SELECT wiki_id, concat('{{nowrap|', title, '}}') AS name,
       CASE WHEN birth_place IS NULL THEN concat(place_b)
            ELSE concat(place_a, '|Nowhere|', place_b) END AS locations, 3 AS n_params
FROM [ARTICLES] a
""")
def infobox_parameters(spark, folder):
    scanned = _articles(spark, folder).select("wiki_id", mk.scan(F.col("wikitext")).alias("m"))
    params = mk.infobox_params(F.col("m.templates"))
    return scanned.select(
        "wiki_id", tx.strip(mk.infobox_map(F.col("m.templates"))["name"]).alias("name"),
        F.array_join(mk.place_links(params), "|").alias("locations"), F.size(params).alias("n_params"))


_WORDS = "regexp_extract_all(lower(words_text), '[\\p{L}\\p{N}_]+')"


@query(f"""
SELECT wiki_id, CAST(len(w) AS INT) AS word_count, {", ".join(
    f"len(list_filter(w, lambda x: x = '{word}')) AS n_{word}" for word in fv.GENDER_WEIGHTS)}
FROM (SELECT wiki_id, {_WORDS} AS w FROM [ARTICLES] a) t
""")
def word_statistics(spark, folder):
    people = trends.parse_people(_articles(spark, folder).select(
        "title", "wiki_id", F.col("kind").alias("infobox"), "wikitext"))
    return people.select("wiki_id", "word_count", *[
        F.col("gender_words")[word].alias(f"n_{word}") for word in fv.GENDER_WEIGHTS])


@query("""
SELECT title, wiki_id, categories FROM (
  SELECT title, -wiki_id - 1 AS wiki_id, concat('cities in nation ', s.s_nationkey) AS categories
  FROM [PLACES] p JOIN supplier s ON s.s_suppkey = p.wiki_id WHERE area = 'Cities') t
ORDER BY title, wiki_id LIMIT 10
""")
def ten_cities(spark, folder):
    found = pages.tagged_pages(pages.tag_pages(_raw_pages(spark, folder)), general=["cities"])
    return _flat(found.select("title", "wiki_id", "categories").orderBy("title", "wiki_id").limit(10), "categories")


@query("""
SELECT title, wiki_id FROM [ARTICLES] a
WHERE kind = 'philosopher' AND NOT bc AND (born = 1905 OR (twice AND born + 1 = 1905))
""")
def philosophers_born_1905(spark, folder):
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    return pages.tagged_pages(tagged, infobox="philosopher", categories=["1905 births"]).select("title", "wiki_id")


def _tag_index(spark, folder):
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    return sinks.write_page_tags(pages.page_tags(tagged), f"{scratch_dir(spark)}/page-tags")


@query("""
SELECT title, wiki_id FROM (
  SELECT title, -wiki_id - 1 AS wiki_id FROM [PLACES] p JOIN supplier s ON s.s_suppkey = p.wiki_id WHERE area = 'Cities') t
ORDER BY title, wiki_id LIMIT 10
""")
def ten_cities_by_index(spark, folder):
    """``ten_cities`` from a stored index of tags."""
    return pages.indexed_pages(_tag_index(spark, folder), general=["cities"]).orderBy("title", "wiki_id").limit(10)


@query("""
SELECT title, wiki_id FROM [ARTICLES] a
WHERE kind = 'philosopher' AND NOT bc AND (born = 1905 OR (twice AND born + 1 = 1905))
""")
def philosophers_born_1905_by_index(spark, folder):
    """``philosophers_born_1905`` from a stored index of tags."""
    return pages.indexed_pages(_tag_index(spark, folder), infobox="philosopher", categories=["1905 births"])


@query("""
SELECT title, wiki_id FROM [ARTICLES] a WHERE job_a = 'poets' AND job_b = 'judges' AND lang = 'en' AND died IS NOT NULL
""")
def pages_with_four_tags(spark, folder):
    """Pages with three categories and a template at once, from a stored index of tags."""
    index = _tag_index(spark, folder)
    died = index.where("kind = 'categories' AND tag LIKE '% deaths'").select("title", "wiki_id")
    found = pages.indexed_pages(index, categories=["old poets", "great judges", "texts of en"], templates=["nowrap"])
    return found.join(died, ["title", "wiki_id"], "left_semi")


@query("""
SELECT a.title, a.wiki_id, v.viewcount FROM [ARTICLES] a JOIN [VIEWS] v ON v.title = a.title
WHERE a.kind = 'philosopher' ORDER BY v.viewcount DESC, a.title LIMIT 100
""")
def most_viewed_philosophers(spark, folder):
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    return pages.most_viewed_by_infobox(tagged, _views(spark, folder), "philosopher").select(
        "title", "wiki_id", "viewcount")


@query("""
SELECT a.title, v.viewcount FROM [ARTICLES] a LEFT JOIN [VIEWS] v ON v.title = a.title
UNION ALL
SELECT p.title, v.viewcount FROM [PLACES] p LEFT JOIN [VIEWS] v ON v.title = p.title
""")
def pages_with_views(spark, folder):
    return pages.with_views(_raw_pages(spark, folder).select("title"), _views(spark, folder), "left")


# --- gazetteer ------------------------------------------------------------------

_RANKED = """
SELECT p.title AS raw, lower(string_split(p.title, ',')[1]) AS name, p.lat, p.lng,
       row_number() OVER (ORDER BY v.viewcount DESC, p.title) - 1 AS rank
FROM [PLACES] p JOIN [VIEWS] v ON v.title = p.title
WHERE p.lat IS NOT NULL AND lower(p.area) IN ('cities', 'populated places')
ORDER BY v.viewcount DESC, p.title LIMIT 50000
"""


def _gazetteer(spark, folder, keep):
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    found = pages.gazetteer(tagged, _views(spark, folder), keep=keep)
    return found.select("name", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"), "rank")


@query(f"""
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng, rank FROM ({_RANKED}) r
QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1
""")
def gazetteer(spark, folder):
    return _gazetteer(spark, folder, "first")


@query(f"""
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank) AS nth FROM ({_RANKED}) r) t
WHERE raw <> name OR nth = 1
QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank DESC) = 1
""")
def gazetteer_last_place(spark, folder):
    return _gazetteer(spark, folder, "last")


@query(f"""
SELECT name, round(lat, 6) AS lat, round(lng, 6) AS lng, rank FROM ({_RANKED}) r
QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1
""")
def gazetteer_as_json(spark, folder):
    """The gazetteer written as JSON objects and read back."""
    path = f"{scratch_dir(spark)}/gazetteer"
    sinks.write_gazetteer(_gazetteer(spark, folder, "first"), path)
    return spark.read.schema("name STRING, lat DOUBLE, lng DOUBLE, rank LONG").json(path)


# --- people ---------------------------------------------------------------------

_FILED = """
SELECT unnest(CASE WHEN bc AND NOT twice THEN [] WHEN bc THEN [born + 1] WHEN twice THEN [born, born + 1]
              ELSE [born] END) AS birth_year, a.*
FROM [ARTICLES] a
"""


@query(f"""
SELECT f.birth_year, f.title AS person_name, f.died, v.viewcount AS view_count
FROM ({_FILED}) f LEFT JOIN [VIEWS] v ON v.title = f.title
""")
def people_by_birth_category(spark, folder):
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    people = trends.people_by_birth_category(tagged, _views(spark, folder))
    return people.select("birth_year", "person_name", "died", "view_count")


@query(f"""
SELECT f.birth_year, f.title AS person_name FROM ({_FILED}) f WHERE f.birth_year IN (1801, 1850, 1900)
""")
def people_of_stored_years(spark, folder):
    """People written by birth year, three of the years read back."""
    path = f"{scratch_dir(spark)}/people"
    tagged = pages.tag_pages(_raw_pages(spark, folder))
    people = trends.people_by_birth_category(tagged, _views(spark, folder))
    sinks.write_year_partition(people.select("birth_year", "person_name", "born", "died"), path)
    return tables.read_year_partition(spark, path, 1801, 1850, 1900).select("birth_year", "person_name")


@query(f"""
SELECT f.birth_year, f.title AS person_name, f.died, CASE WHEN f.birth_year >= 1850 THEN v.viewcount END AS view_count
FROM ({_FILED}) f LEFT JOIN [VIEWS] v ON v.title = f.title WHERE f.birth_year BETWEEN 1800 AND 1919
""")
def people_of_fetched_years(spark, folder):
    """People of some years stored before any views were known, then of more years; stored ones are not parsed again."""
    path, views = f"{scratch_dir(spark)}/people", _views(spark, folder)
    tagged = stage_articles(pages.tag_pages(_raw_pages(spark, folder)), "tagged")
    imports.fetch_people(tagged, views.limit(0), path, 1800, 1850)
    return imports.fetch_people(tagged, views, path, 1800, 1920).select("birth_year", "person_name", "died", "view_count")


_SCORES = f"""
SELECT title, first_name, greatest(len(years), 0) AS times,
       CASE WHEN weight > 0 THEN balance / weight ELSE 0 END AS score
FROM (SELECT title, first_name, years,
             2 * len(list_filter(w, lambda x: x = 'he')) + len(list_filter(w, lambda x: x = 'his'))
             + len(list_filter(w, lambda x: x = 'him')) - 2 * len(list_filter(w, lambda x: x = 'she'))
             - len(list_filter(w, lambda x: x = 'her')) AS balance,
             2 * len(list_filter(w, lambda x: x = 'he')) + len(list_filter(w, lambda x: x = 'his'))
             + len(list_filter(w, lambda x: x = 'him')) + 2 * len(list_filter(w, lambda x: x = 'she'))
             + len(list_filter(w, lambda x: x = 'her')) AS weight
      FROM (SELECT title, first_name, {_WORDS} AS w,
                   CASE WHEN bc AND NOT twice THEN [] WHEN bc THEN [born + 1] WHEN twice THEN [born, born + 1]
                        ELSE [born] END AS years FROM [ARTICLES] a) t) s
WHERE len(years) > 0
"""

_GENDERS = f"""
SELECT s.title, CASE WHEN s.score + 0.3 * n.mean < 0 THEN 'female' ELSE 'male' END AS gender
FROM ({_SCORES}) s
JOIN (SELECT first_name, sum(score * times) / sum(times) AS mean FROM ({_SCORES}) x GROUP BY 1) n
  ON n.first_name = s.first_name
"""


@query(f"SELECT title AS person_name, gender FROM ({_GENDERS}) g")
def gender_scores(spark, folder):
    articles = _articles(spark, folder)
    years = tx.birth_category_years(
        tx.normalise_tags(tx.categories(mk.link_targets(F.col("wikitext")))), *fv.BIRTH_CATEGORY_YEARS)
    people = stage_articles(trends.parse_people(articles.select(
        "title", "wiki_id", F.col("kind").alias("infobox"), "wikitext", F.size(years).alias("times")
    ).where("times > 0"), "times"), "people")
    return trends.assign_genders(people, trends.first_name_scores(people, "times")).select("person_name", "gender")


_VOTES = """
SELECT title, CASE WHEN field IS NULL THEN '' ELSE field END AS field,
       CASE WHEN occupation IS NULL THEN '' ELSE occupation END AS occupation
FROM (SELECT title,
      (SELECT f FROM (SELECT f, sum(w) AS votes, min(pos) AS pos FROM (VALUES
         (CASE job_a WHEN 'philosophers' THEN 'science' WHEN 'poets' THEN 'art' WHEN 'chemists' THEN 'science'
                     WHEN 'boxers' THEN 'sport' END, 1, 1),
         (CASE job_b WHEN 'poets' THEN 'art' WHEN 'painters' THEN 'art' WHEN 'bankers' THEN 'business'
                     ELSE 'politics' END, 1, 2),
         (CASE kind WHEN 'philosopher' THEN 'science' ELSE 'art' END, 3, 3)) v(f, w, pos)
       WHERE f IS NOT NULL GROUP BY f) g ORDER BY votes DESC, pos LIMIT 1) AS field,
      CASE WHEN job_a = 'unknowns' THEN job_b ELSE job_a END AS occupation
      FROM [ARTICLES] a) t
"""


@query(_VOTES)
def field_votes(spark, folder):
    field, occupation = trends.field_votes(F.col("links"), F.col("kind"))
    links = _articles(spark, folder).select(
        "title", "kind", mk.link_targets(F.col("wikitext")).alias("links"))
    return links.select("title", field.alias("field"), occupation.alias("occupation"))


_LOCATED = """
SELECT p.title AS location, p.lng, p.lat, p.wiki_id FROM [PLACES] p
WHERE p.lat IS NOT NULL AND p.title IN (
  SELECT coalesce(birth_place, place_b) FROM [ARTICLES] a WHERE NOT bc OR twice)
"""

_IN_COUNTRY = f"""
SELECT l.location, l.lng, l.lat, c.iso_a3, c.name, c.continent FROM ({_LOCATED}) l
LEFT JOIN [POLYGONS] c ON l.lng >= c.x0 AND l.lng < c.x1 AND l.lat >= c.y0 AND l.lat < c.y1
  AND NOT (c.hole AND l.lng >= c.x0 + 8 AND l.lng < c.x1 - 8 AND l.lat >= c.y0 + 8 AND l.lat < c.y1 - 8)
QUALIFY row_number() OVER (PARTITION BY l.location ORDER BY c.poly_id DESC NULLS LAST) = 1
"""


@query("""
SELECT c_custkey, iso_a3, name, continent FROM (
  SELECT c_custkey, iso_a3, name, continent, row_number() OVER (
           PARTITION BY c_custkey ORDER BY p.poly_id DESC NULLS LAST) AS nth
  FROM (SELECT c_custkey, c_acctbal % 60 AS lng, (c_custkey % 997) / 10.0 - 49.05 AS lat FROM customer) c
  LEFT JOIN [POLYGONS] p ON c.lng >= p.x0 AND c.lng < p.x1 AND c.lat >= p.y0 AND c.lat < p.y1
    AND NOT (p.hole AND c.lng >= p.x0 + 8 AND c.lng < p.x1 - 8 AND c.lat >= p.y0 + 8 AND c.lat < p.y1 - 8)) t
WHERE nth = 1
""")
def points_in_countries(spark, folder):
    points = tables.load_table(spark, folder, "customer", "c_custkey", "c_acctbal").select(
        "c_custkey", (F.col("c_acctbal") % 60).alias("lng"),
        ((F.col("c_custkey") % 997) / 10.0 - 49.05).alias("lat"))
    found = points_in_polygons(points, inputs.polygons(spark, folder), "c_custkey", size=5.0)
    return found.select("c_custkey", "iso_a3", "name", "continent")


@query("""
SELECT o_orderkey, iso_a3, name, continent FROM (
  SELECT o_orderkey, iso_a3, name, continent, row_number() OVER (
           PARTITION BY o_orderkey ORDER BY p.poly_id DESC NULLS LAST) AS nth
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 9.75 + (o_orderkey % 1000) / 2000.0 ELSE o_custkey % 120 - 59.5 END AS lng,
               CASE WHEN o_orderkey % 2 = 0 THEN 0.3 + (o_custkey % 997) / 2000.0 ELSE o_orderkey % 100 - 49.5 END AS lat FROM orders) c
  LEFT JOIN [POLYGONS] p ON c.lng >= p.x0 AND c.lng < p.x1 AND c.lat >= p.y0 AND c.lat < p.y1
    AND NOT (p.hole AND c.lng >= p.x0 + 8 AND c.lng < p.x1 - 8 AND c.lat >= p.y0 + 8 AND c.lat < p.y1 - 8)) t
WHERE nth = 1
""")
def points_in_a_dense_cell(spark, folder):
    """Half of all points in one cell, which an edge crosses; the cell is split."""
    even, key = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey")
    points = tables.load_table(spark, folder, "orders", "o_orderkey", "o_custkey").select(
        "o_orderkey", F.when(even, 9.75 + (key % 1000) / 2000.0).otherwise(F.col("o_custkey") % 120 - 59.5).alias("lng"),
        F.when(even, 0.3 + (F.col("o_custkey") % 997) / 2000.0).otherwise(key % 100 - 49.5).alias("lat"))
    found = points_in_polygons(points, inputs.polygons(spark, folder), "o_orderkey", dense=100)
    return found.select("o_orderkey", "iso_a3", "name", "continent")


_CANDIDATES = """
SELECT title, 1 AS pos, birth_place AS link FROM [ARTICLES] a WHERE birth_place IS NOT NULL
UNION ALL SELECT title, 2, place_b FROM [ARTICLES] a
UNION ALL SELECT title, 3, birth_place FROM [ARTICLES] a WHERE birth_place IS NOT NULL
UNION ALL SELECT title, 4, place_b FROM [ARTICLES] a
UNION ALL SELECT title, 5, place_c FROM [ARTICLES] a
"""

_PLACED = f"""
SELECT title, iso_a3, name, continent FROM ({_CANDIDATES}) k JOIN ({_IN_COUNTRY}) c ON c.location = k.link
QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1
"""


@query(f"""
SELECT a.title, f.link AS location FROM [ARTICLES] a LEFT JOIN (
  SELECT title, link FROM ({_CANDIDATES}) k JOIN (SELECT DISTINCT title AS place FROM [PLACES] p
    WHERE lat IS NOT NULL) p ON p.place = k.link
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY pos) = 1) f ON f.title = a.title
""")
def first_resolved_location(spark, folder):
    people = stage_articles(trends.parse_people(_articles(spark, folder).select(
        "title", "wiki_id", F.col("kind").alias("infobox"), "wikitext")), "people")
    located = _places(spark, folder).where("lat IS NOT NULL").select(F.col("title").alias("location")).distinct()
    found = first_resolved(people, "person_name", F.concat("locations", "wikilinks"), located, "location")
    return found.select(F.col("person_name").alias("title"), "location")


@query(f"""
SELECT a.title AS person_name, v.viewcount AS view_count, CAST(len({_WORDS}) AS INT) AS word_count,
       CASE WHEN a.bc AND a.twice THEN a.born + 1 WHEN a.twice THEN a.born + 1 ELSE a.born END AS year_born,
       a.died AS year_died, g.gender, o.occupation, o.field,
       coalesce(c.alpha2, '') AS country_code, coalesce(p.continent, '') AS continent
FROM [ARTICLES] a JOIN ({_GENDERS}) g ON g.title = a.title JOIN ({_VOTES}) o ON o.title = a.title
LEFT JOIN [VIEWS] v ON v.title = a.title LEFT JOIN ({_PLACED}) p ON p.title = a.title
LEFT JOIN [CODES] c ON c.alpha3 = CASE p.name WHEN 'France' THEN 'FRA' ELSE p.iso_a3 END
WHERE (NOT a.bc OR a.twice) AND a.born + CASE WHEN a.twice THEN 1 ELSE 0 END >= 200
  AND (a.died IS NULL OR a.died = 0 OR a.died >= 200)
""")
def person_trends(spark, folder):
    """The whole analysis: articles tagged, parsed, placed, classified and written."""
    root = scratch_dir(spark)
    tagged = sinks.write_pages(pages.tag_pages(_raw_pages(spark, folder)), f"{root}/pages")
    found = trends.person_trends(
        tagged, _views(spark, folder), inputs.polygons(spark, folder),
        inputs.in_spark(spark, folder, inputs.CODES))
    return sinks.write_person_trends(found, f"{root}/trends")


@query("""
SELECT wiki_id, CASE WHEN lat IS NOT NULL THEN concat('POINT(', lng, ' ', lat, ')') END AS wkt, lat, lng FROM [PLACES] p
""")
def point_text(spark, folder):
    at = _places(spark, folder).select("wiki_id", geo.point(F.col("lng"), F.col("lat")).alias("at"))
    text = at.select("wiki_id", geo.point_text(F.col("at")).alias("wkt"))
    back = geo.parse_point(F.col("wkt"))
    return text.select("wiki_id", "wkt", back.lat.alias("lat"), back.lng.alias("lng"))
