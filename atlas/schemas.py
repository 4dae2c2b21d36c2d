"""Schemas of the relations, as DDL text."""

PAGE_XML = """
    title STRING, ns INT, id LONG, redirect STRUCT<_title: STRING>,
    revision STRUCT<id: LONG, parentid: LONG, timestamp: STRING,
        contributor: STRUCT<username: STRING, id: LONG>, model: STRING, format: STRING,
        text: STRUCT<_VALUE: STRING, `_xml:space`: STRING>, sha1: STRING>,
    _corrupt_record STRING
"""

PAGES = """
    title STRING, wiki_id LONG, infobox STRING, wikitext STRING,
    templates ARRAY<STRING>, categories ARRAY<STRING>, general ARRAY<STRING>,
    lng_lat STRUCT<lng: DOUBLE, lat: DOUBLE>
"""

ENTITY_JSON = """
    id STRING,
    labels STRUCT<en: STRUCT<value: STRING>>,
    descriptions STRUCT<en: STRUCT<value: STRING>>,
    sitelinks STRUCT<enwiki: STRUCT<title: STRING>>,
    claims MAP<STRING, ARRAY<STRUCT<rank: STRING,
        mainsnak: STRUCT<datavalue: STRUCT<type: STRING, value: STRING>>>>>
"""

PAGEVIEWS = "title STRING, viewcount LONG"

TRIPLES = "s STRING, p STRING, o STRING, lang STRING"

BINDINGS = "ARRAY<MAP<STRING, STRUCT<value: STRING>>>"

PERSONS = """
    qid STRING, enwiki_title STRING, name STRING, gender_qid STRING,
    year_born INT, year_died INT, citizenship_country_codes ARRAY<STRING>,
    pob_qid STRING, pob_lat DOUBLE, pob_lon DOUBLE, pob_country_code STRING,
    pod_qid STRING, pod_lat DOUBLE, pod_lon DOUBLE, pod_country_code STRING,
    occupation_qids ARRAY<STRING>, field_qids ARRAY<STRING>,
    manner_of_death_qid STRING, image_filename STRING, sitelink_count INT
"""

LABELS = "qid STRING, label STRING"

PROGRESS = "bucket STRING, imported_at TIMESTAMP, row_count LONG"

PERSON_TRENDS = """
    person_name STRING, view_count LONG, word_count INT, year_born INT, year_died INT,
    gender STRING, occupation STRING, field STRING, country_code STRING, continent STRING
"""

POLYGONS = """
    poly_id INT, iso_a3 STRING, name STRING, continent STRING,
    rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>
"""

GAZETTEER = "name STRING, lat DOUBLE, lng DOUBLE, rank LONG"
