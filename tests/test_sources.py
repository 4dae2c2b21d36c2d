"""Readers and writers on small hand-made files."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from atlas import fixed_values as fv
from atlas.plans import pages, pageviews
from atlas.session import ARTICLE_ROWS, scratch_dir, spread, stage, stage_articles
from atlas.sinks import tables as sinks
from atlas.sources import dumps, tables

DUMP = """<mediawiki version="0.11">
  <page>
    <title>Lake Brena</title>
    <ns>0</ns>
    <id>41</id>
    <revision>
      <id>900</id>
      <text xml:space="preserve">A lake. {{Infobox body of water
| name = Brena
| inflow = [[River Osk|Osk
| country = [[Norda]]
}} It lies at {{Coord|61|30|N|8|15|E|display=title}}; see {{see also|Fjords}} &amp;amp; [[Norda]].
&lt;!-- depth? --&gt;[[Category:Lakes of Norda]] [[Category:Glacial lakes]]</text>
    </revision>
  </page>
  <page>
    <title>Brena (lake)</title>
    <ns>0</ns>
    <id>40</id>
    <redirect title="Lake Brena" />
    <revision><id>901</id><text xml:space="preserve">#REDIRECT [[Lake Brena]] {{Moved}}</text></revision>
  </page>
  <page><title>Broken</title><id>42</id><revision><id>902</id><text>a & b</text></revision></page>
  <page><title>Blank</title><ns>4</ns><id>43</id><revision><id>903</id><text bytes="0" /></revision></page>
</mediawiki>
"""


@pytest.fixture(params=["xml", "xml.bz2"])
def dump(tmp_path, request):
    path = tmp_path / f"dump.{request.param}"
    if request.param == "xml":
        path.write_text(DUMP)
    else:
        path.write_bytes(bz2.compress(DUMP.encode()))
    return str(path)


def test_read_pages(spark, dump):
    rows = dumps.read_pages(spark, dump).orderBy("wiki_id").collect()
    assert [(r.title, r.wiki_id, r.revision_id) for r in rows] == [
        ("Brena (lake)", 40, 901), ("Lake Brena", 41, 900), ("Blank", 43, 903)]
    assert rows[0].wikitext == "#REDIRECT [[Lake Brena]] {{Moved}}"
    assert "see {{see also|Fjords}} &amp; [[Norda]].\n<!-- depth? -->" in rows[1].wikitext and rows[2].wikitext == ""


def test_import_pages(spark, dump, tmp_path):
    rows = {r.title: r for r in pages.import_pages(spark, dump, str(tmp_path / "pages")).collect()}
    assert len(rows) == 3 and rows["Brena (lake)"].templates == ["moved"]
    lake = rows["Lake Brena"]
    assert "see also" in lake.templates and lake.infobox == "body of water"
    assert lake.categories == ["glacial lakes", "lakes of norda"] and lake.general == ["lakes"]
    assert (lake.lng_lat.lat, lake.lng_lat.lng) == pytest.approx((61.5, 8.25), abs=1e-3)
    assert rows["Blank"].templates == [] and rows["Blank"].lng_lat is None


def test_record_limit(spark, dump):
    assert dumps.read_pages(spark, dump, limit=2).count() == 2


@pytest.mark.parametrize("suffix", ["xml", "xml.bz2"])
def test_one_dump_is_read_by_many_tasks(spark, tmp_path, suffix):
    body = "".join(
        f"<page><title>T{i}</title><id>{i}</id><revision><id>1</id><text>{'é<x'.replace('<', '&lt;') * (i % 97)} {i}"
        f"</text></revision></page>\n" for i in range(20_000))
    raw = f"<mediawiki>\n{body}</mediawiki>".encode()
    path = tmp_path / f"big.{suffix}"
    path.write_bytes(bz2.compress(raw, 1) if suffix.endswith("bz2") else raw)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000" if suffix.endswith("bz2") else "200000")
    try:
        df = dumps.read_pages(spark, str(path))
        assert df.rdd.getNumPartitions() > 2
        got = df.agg(F.count("*"), F.countDistinct("title"), F.sum("wiki_id"), F.sum(F.length("wikitext"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    length = sum(3 * (i % 97) + 1 + len(str(i)) for i in range(20_000))
    assert tuple(got) == (20_000, 20_000, sum(range(20_000)), length)


@pytest.mark.parametrize("suffix", ["json", "json.bz2"])
def test_read_entities(spark, tmp_path, suffix):
    objects = [
        {"id": "Q1", "labels": {"en": {"value": "one"}, "de": {"value": "eins"}}, "descriptions": {},
         "sitelinks": {"enwiki": {"title": "One"}, "dewiki": {"title": "Eins"}},
         "claims": {"P1": [{"rank": "normal", "mainsnak": {"datavalue": {"type": "time", "value": {"time": "+1"}}}}]}},
        {"id": "Q2", "labels": [], "descriptions": [], "sitelinks": [], "claims": []},
        {"id": "Q3", "labels": {"de": {"value": "drei"}}, "descriptions": {"en": {"value": "third, {odd}"}}}]
    lines = ["["] + [json.dumps(o) + ("," if o is not objects[-1] else "") for o in objects] + ["]", ""]
    path = tmp_path / f"dump.{suffix}"
    data = "\r\n".join(lines).encode()
    path.write_bytes(bz2.compress(data) if suffix.endswith("bz2") else data)
    rows = {r.id: r for r in dumps.read_entities(spark, str(path)).collect()}
    assert set(rows) == {"Q1", "Q2", "Q3"}
    assert (rows["Q1"].wikipedia_id, rows["Q1"].title, rows["Q1"].description) == ("One", "one", None)
    assert rows["Q1"].claims["P1"][0].mainsnak.datavalue.value == '{"time":"+1"}'
    assert rows["Q2"].title is None and rows["Q3"].description == "third, {odd}"


def test_pageviews(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    first = 'en A_b 3 10\nen A%20b 4 0\nde A_b 9 0\nen Talk:A 5 0\nen "Q" 1 0\nen A b 3 0\nen x many 0\nen%20 A_b 1 0\n'
    (folder / "one.gz").write_bytes(gzip.compress(first.encode()))
    (folder / "two.gz").write_bytes(gzip.compress("en A_b 3000000000 10\nen caf%C3%A9 2 0\n".encode()))
    (folder / "ignored.txt").write_text("en A_b 1000 0\n")
    totals = pageviews.import_pageviews(spark, str(folder), str(tmp_path / "views"))
    assert {r.title: r.viewcount for r in totals.collect()} == {"A b": 3000000007, '"Q"': 1, "café": 2}
    assert [r.title for r in pageviews.top_titles(totals, 2).collect()] == ["A b", "café"]


def test_people_csv(spark, tmp_path):
    path = tmp_path / "people.csv"
    path.write_text(
        "person_name,view_count,word_count,year_born,year_died,gender,occupation,field,country_code,continent\n"
        '"Lee, Ann",5,10,1900,,female,poets,art,,Europe\n')
    row = tables.read_people_csv(spark, str(path)).first()
    assert row.person_name == "Lee, Ann" and row.year_died is None and row.country_code is None


def test_dimensions(spark):
    codes = {r.alpha2: r.alpha3 for r in tables.dim_country_codes(spark).collect()}
    assert codes["NL"] == "NLD" and len(codes) >= 249 and all(len(c) == 3 for c in codes.values())
    assert dict(tables.dim_field(spark).collect())["poets"] == "art"
    assert dict(tables.dim_infobox(spark).collect())["philosopher"] == "science"
    assert max(len(fv.lookup_table(fv.FIELD_OF_WORD)), len(fv.lookup_table(fv.FIELD_OF_INFOBOX))) < 200


def test_country_polygons(spark, tmp_path):
    square = [[[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"iso_a3": "AAA", "name": "A", "continent": "X"},
         "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"iso_a3": "BBB", "name": "B", "continent": "Y"},
         "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}}]
    path = tmp_path / "world.geojson"
    path.write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    rows = tables.read_country_polygons(spark, str(path)).orderBy("poly_id").collect()
    assert [(r.poly_id, r.iso_a3, len(r.rings)) for r in rows] == [(0, "AAA", 1), (1, "BBB", 2)]
    assert rows[0].rings[0][1].x == 1.0


def test_triples_and_labels(spark, tmp_path):
    rows = [("http://x/entity/Q1", "http://x/rdf-schema#label", "One", "en"),
            ("http://x/entity/Q1", "http://x/rdf-schema#label", "Eins", "de"),
            ("https://en.wikipedia.org/wiki/A/B", "http://schema.org/about", "http://x/entity/Q1", None)]
    path = str(tmp_path / "triples")
    spark.createDataFrame(rows, "s STRING, p STRING, o STRING, lang STRING").write.parquet(path)
    triples = tables.read_triples(spark, path)
    assert {(r.s, r.p) for r in triples.collect()} == {
        ("Q1", "label"), ("https://en.wikipedia.org/wiki/A/B", "about")}
    assert tables.read_labels(triples).collect() == [("Q1", "One")]


def test_decode_bindings(spark):
    document = {"results": {"bindings": [
        {"person": {"value": "http://x/Q1"}, "article": {"value": "https://en.wikipedia.org/wiki/A%20b_c"},
         "dob": {"value": "1900-01-01T00:00:00Z"}, "pobCoords": {"value": "Point(1.5 -2)"},
         "occupations": {"value": "http://x/Q7||http://x/Q8"}, "sitelinks": {"value": "12"}, "citCodes": {"value": ""}},
        {"person": {"value": "http://x/Q2"}, "dod": {"value": "t55"}}]}}
    df = spark.createDataFrame([(json.dumps(document),)], "value STRING")
    rows = {r.qid: r for r in tables.decode_bindings(df).collect()}
    one, two = rows["Q1"], rows["Q2"]
    assert (one.enwiki_title, one.year_born, one.pob_lat, one.pob_lon) == ("A b c", 1900, -2.0, 1.5)
    assert one.occupation_qids == ["Q7", "Q8"] and one.sitelink_count == 12
    assert one.citizenship_country_codes is None
    assert all(two[c] is None for c in two.asDict() if c != "qid")


def test_year_partition(spark, tmp_path):
    path = str(tmp_path / "people")
    people = spark.createDataFrame([(1900, "a"), (1900, "b"), (1901, "c")], "birth_year INT, person_name STRING")
    sinks.write_year_partition(people, path)
    sinks.write_year_partition(people.where("birth_year = 1901").withColumn("person_name", F.lit("d")), path)
    got = tables.read_year_partition(spark, path)
    assert {(r.birth_year, r.person_name) for r in got.collect()} == {(1900, "a"), (1900, "b"), (1901, "d")}
    assert tables.read_year_partition(spark, path, 1901).count() == 1


def test_year_buckets(spark):
    assert [r.bucket for r in tables.year_buckets(spark, 1999, 2001).collect()] == ["1999", "2000", "2001"]
    assert tables.year_buckets(spark, -2, 1, inclusive=False).count() == 3


def test_scratch(spark):
    assert scratch_dir(spark) != scratch_dir(spark)
    df = spark.range(10).withColumn("x", F.array("id"))
    assert stage(df, "numbers").dtypes == df.dtypes and stage(df, "numbers").count() == 10
    assert spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == 8
    assert spread(spark.range(0, 10, 1, 20)).rdd.getNumPartitions() == 20


def _handed(spark, **columns):
    """A partition of 2,000 rows with the given columns, and ``handed``: the rows that their Python worker got at once."""
    import pyarrow as pa

    @F.arrow_udf("long")
    def handed(ids: pa.Array) -> pa.Array:
        return pa.array([len(ids)] * len(ids))

    return spark.range(2000).coalesce(1).select("id", *[F.expr(c).alias(name) for name, c in columns.items()], handed("id").alias("handed"))


def test_years_are_written_few_articles_at_a_time(spark):
    path = f"{scratch_dir(spark)}/people"
    people = _handed(spark, birth_year="CAST(1800 + id % 3 AS INT)")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sinks.write_year_partition(people, path)
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    found = tables.read_year_partition(spark, path).agg(F.count("*").alias("n"), F.max("handed").alias("most")).first()
    assert found.n == 2000 and found.most <= ARTICLE_ROWS


def test_articles_are_staged_few_at_a_time(spark):
    found = stage_articles(_handed(spark), "articles").agg(F.count("*").alias("n"), F.max("handed").alias("most")).first()
    assert found.n == 2000 and found.most <= ARTICLE_ROWS


def test_tags_and_pages_are_written_few_articles_at_a_time(spark):
    root = scratch_dir(spark)
    pages_ = _handed(spark, title="string(id)", wiki_id="id", kind="'categories'", tag="'a'")
    for table in (sinks.write_page_tags(pages_, f"{root}/tags"), sinks.write_pages(pages_, f"{root}/pages"),
                  sinks.write_unique_pages(pages_, f"{root}/unique")):
        found = table.agg(F.count("*").alias("n"), F.max("handed").alias("most")).first()
        assert found.n == 2000 and found.most <= ARTICLE_ROWS
