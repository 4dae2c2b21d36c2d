"""Restartable imports, stored values and tags, on small tables."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from atlas.catalog import inputs
from atlas.operators import joins, property_values as pv
from atlas.plans import entities as en, imports, pages, persons as ps
from atlas.sinks import tables as sinks, versions

SITE = "https://en.wikipedia.org/"


def triples(spark, *people, labels=()):
    """Statements about people: id, years of birth, name."""
    rows = []
    for qid, years, name in people:
        rows += [(qid, "P31", "x/Q5", None), (qid, "sitelinks", "3", None), (qid, "label", name, "en"), (qid, "P106", "x/Qjob", None)]
        rows += [(qid, "P569", f"{y}-01-01", None) for y in years]
        rows += [(f"{SITE}wiki/{qid}", "about", f"x/{qid}", None), (f"{SITE}wiki/{qid}", "isPartOf", SITE, None)]
    rows += [(qid, "label", label, "en") for qid, label in labels]
    return spark.createDataFrame(rows, "s STRING, p STRING, o STRING, lang STRING")


def state(tables):
    people = sorted((r.qid, r.name, r.year_born) for r in tables["persons"].collect())
    return people, {r.bucket: r.row_count for r in tables["ledger"].collect()}


def test_import_goes_on_with_pending_years(spark, tmp_path):
    old, new, root = (str(tmp_path / name) for name in ("old", "new", "root"))
    imports.store_statements(triples(spark, ("Q1", [1850], "One"), ("Q2", [1851, 1853], "Two"), ("Q9", [1999], "Nine")), old)
    assert state(imports.import_persons(spark, old, root, 1850, 1852)) == (
        [("Q1", "One", 1850), ("Q2", "Two", 1851)], {"1850": 1, "1851": 1, "1852": 0})
    imports.store_statements(triples(spark, ("Q1", [1850], "Uno"), ("Q2", [1851, 1853], "Due"), ("Q3", [1852], "Tre")), new)
    # years that are done are not even opened
    for name in glob.glob(f"{new}/births/year=185[0-2]/*.parquet"):
        with open(name, "wb") as file:
            file.write(b"no table")
        os.remove(f"{os.path.dirname(name)}/.{os.path.basename(name)}.crc")
    got = state(imports.import_persons(spark, new, root, 1850, 1853))
    assert got == ([("Q1", "One", 1850), ("Q2", "Due", 1853)], {"1850": 1, "1851": 1, "1852": 0, "1853": 1})
    before = versions.latest(spark, root)
    assert state(imports.import_persons(spark, new, root, 1850, 1853)) == got and versions.latest(spark, root) == before


def test_forced_import_replaces(spark, tmp_path):
    old, new, root = (str(tmp_path / name) for name in ("old", "new", "root"))
    imports.store_statements(triples(spark, ("Q1", [1850], "One"), ("Q2", [1851], "Two")), old)
    imports.store_statements(triples(spark, ("Q1", [1850], "Uno"), ("Q3", [1850], "Tre")), new)
    imports.import_persons(spark, old, root, 1850, 1851)
    assert state(imports.import_persons(spark, new, root, 1850, 1850, force=True)) == (
        [("Q1", "Uno", 1850), ("Q2", "Two", 1851), ("Q3", "Tre", 1850)], {"1850": 2, "1851": 1})


def test_failed_import_changes_nothing(spark, tmp_path):
    store, root = str(tmp_path / "store"), str(tmp_path / "root")
    imports.store_statements(triples(spark, ("Q1", [1850], "One")), store)
    first = state(imports.import_persons(spark, store, root, 1850, 1850))
    with pytest.raises(Exception):
        versions.commit(spark, root, persons=spark.range(3).withColumn("qid", F.raise_error(F.lit("lost"))))
    assert state(imports.persons_and_ledger(spark, root)) == first
    assert state(imports.persons_and_ledger(spark, str(tmp_path / "none"))) == ([], {})


def test_only_statements_of_qualified_people_are_aggregated(spark):
    found = triples(spark, ("Q1", [1850], "One"), ("Q2", [2100], "Two"))
    people = ps.qualified(ps.birth_statements(found).where("year < 2000"), found)
    plan = ps.person_facts(found, people)._jdf.queryExecution().optimizedPlan().toString()
    last = plan[plan.rindex("collect_set"):]  # the aggregate's input stands below it
    assert "LeftSemi" in last
    assert [r.s for r in ps.person_facts(found, people).collect()] == ["Q1"]


def test_labels_are_fetched_once(spark, tmp_path):
    root = str(tmp_path / "labels")
    found = triples(spark, ("Q1", [1850], "One"), labels=[("Qjob", "job"), ("Qother", "other")])
    people = ps.persons(found)
    assert [tuple(r) for r in imports.import_labels(spark, found, people, root).collect()] == [("Qjob", "job")]
    number = versions.latest(spark, root).number
    renamed = found.withColumn("o", F.regexp_replace("o", "^job$", "work"))
    assert [r.label for r in imports.import_labels(spark, renamed, people, root).collect()] == ["job"]
    assert versions.latest(spark, root).number == number
    assert [r.label for r in imports.import_labels(spark, renamed, people, root, force=True).collect()] == ["work"]


def test_one_record_per_id(spark):
    item = '{"rank":"normal","mainsnak":{"datavalue":{"type":"wikibase-entityid","value":{"id":"%s"}}}}'
    nine = '{"id":"Q9","labels":{"en":{"value":"Nine"}},"sitelinks":{"enwiki":{"title":"N"}},"claims":{"P1":[%s,%s]}},' % (item % "Q1", item % "Q2")
    bare = '{"id":"Q9","labels":{"en":{"value":"Other"}},"claims":{"P1":[%s]}},' % (item % "Q1")
    names = ['{"id":"%s","labels":{"en":{"value":"%s"}}},' % pair for pair in (("Q1", "Red"), ("Q2", "Blue"), ("P1", "color"))]
    from atlas.sources.dumps import entity_lines
    lines = spark.createDataFrame([(x,) for x in [bare, nine, nine, *names, names[0], '{"labels":{}},']], "value STRING")
    (row,) = en.entity_properties(entity_lines(lines)).collect()
    assert (row.qid, row.wikipedia_id, row.prop_name, row.vals) == ("Q9", "N", "color", ["Blue", "Red"])
    assert en.unique_records(entity_lines(lines)).count() == 4


def test_entities_are_brought_together_once(spark, no_broadcast):
    """Ranks, names shared by properties and documents work on the one exchange by entity."""
    schema = "qid STRING, prop_pos INT, prop_id STRING, prop_name STRING, pos INT, rank INT, kind STRING, text STRING, num DOUBLE, " \
             "lat DOUBLE, lng DOUBLE, globe STRING, altitude DOUBLE"
    claims = spark.createDataFrame([("Q1", 0, "P1", "a", 0, 1, "string", "x", None, None, None, None, None)], schema).repartition("qid")
    from atlas.operators.dedupe import keep_last
    found = keep_last(en.best_rank(claims, "prop_name"), ["qid", "prop_name"], ["prop_pos"]).withColumn("wikipedia_id", F.lit("w"))
    plan = en.gathered(found)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


DOCUMENTS = {
    1: '{"a": "x", "n": 5, "f": true, "l": ["u", "v", "v"], "o": {"lat": 1.5, "on": false, "deep": {"z": 1}}}',
    2: '{"a": ["x"], "n": "5", "f": "true", "l": ["u"], "o": {"lat": 2}}', 3: '{}', 4: '{"l": [], "o": {}, "a": null}',
    5: '{"l": [5, 6, "5"], "n": 5.0, "f": false}', 6: '{"l": "u"}'}


@pytest.mark.parametrize("wanted,keys", [
    ({"a": "x"}, [1]), ({"a": ["x"]}, [2]), ({"n": 5}, [1, 5]), ({"n": "5"}, [2]), ({"f": True}, [1]), ({"f": False}, [5]),
    ({"l": ["u"]}, [1, 2]), ({"l": ["v", "u", "v"]}, [1]), ({"l": []}, [1, 2, 4, 5]), ({"l": [5]}, [5]), ({"l": ["5"]}, [5]),
    ({"o": {"lat": 1.5}}, [1]), ({"o": {"on": False, "lat": 1.5}}, [1]), ({"o": {}}, [1, 2, 4]), ({"l": "u"}, [6]),
    ({"a": "x", "l": ["u"], "o": {"lat": 1.5}, "f": True}, [1]), ({"a": "x", "n": 6}, []), ({"none": 1}, [])])
def test_values_of_documents(spark, wanted, keys):
    df = spark.createDataFrame(list(DOCUMENTS.items()), "k INT, d STRING").select("k", F.parse_json("d").alias("doc"))
    assert sorted(r.k for r in pv.holding(pv.values_of_documents(df, "k", "doc"), "k", wanted).collect()) == keys


def test_question_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame(list(DOCUMENTS.items()), "qid INT, d STRING").select("qid", F.parse_json("d").alias("doc"))
    stored = sinks.write_property_values(pv.values_of_documents(df, "qid", "doc"), str(tmp_path / "values"))
    plan = pv.holding(stored, "qid", {"a": "x", "n": 5})._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters"):]
    assert "In(prop_name, [a,n])" in pushed.split("\n")[0]


def test_tag_index(spark, tmp_path):
    df = spark.createDataFrame([
        ("a", 1, "{{Infobox city}} {{x}} [[Category:Cities in A]] [[Category:Old cities]]"),
        ("b", 2, "{{Infobox city}} [[Category:Cities in A]]"), ("c", 3, "none")], "title STRING, wiki_id LONG, wikitext STRING")
    index = sinks.write_page_tags(pages.page_tags(pages.tag_pages(df)), str(tmp_path / "tags"))
    titles = lambda **tags: sorted(r.title for r in pages.indexed_pages(index, **tags).collect())
    assert titles(general=["cities"]) == ["a", "b"] and titles(infobox="city", categories=["old cities", "cities in a"]) == ["a"]
    assert titles(templates=["x"], categories=["cities in a"]) == ["a"] and titles(categories=["x"]) == []
    plan = pages.indexed_pages(index, general=["cities"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(tag,cities)" in plan
    with pytest.raises(ValueError):
        pages.indexed_pages(index)


def test_division_ignores_unknown_values(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (1, "b"), (2, "a"), (2, None)], "k INT, v STRING")
    assert [r.k for r in joins.holding_all(df, ["k"], [F.col("v") == "a", F.col("v") == "b"]).collect()] == [1]


def test_dense_cells_change_no_answer(spark):
    """Random triangles and points, half of them close together, against the even-odd rule in Python."""
    import random
    draw = random.Random(4)
    shapes = [(k, [(draw.uniform(-9, 9), draw.uniform(-9, 9)) for _ in range(3)]) for k in range(12)]
    shapes.append((12, [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]))
    points = [(k, draw.uniform(-10, 10), draw.uniform(-10, 10)) if k % 2 else (k, draw.uniform(2.3, 2.4), draw.uniform(1, 2)) for k in range(1500)]

    def inside(corners, x, y):
        hits = 0
        for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
            hits += (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
        return hits % 2 == 1

    rings = spark.createDataFrame([(k, [[{"x": x, "y": y} for x, y in corners]]) for k, corners in shapes],
                                  "poly_id INT, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    df = spark.createDataFrame(points, "id INT, lng DOUBLE, lat DOUBLE")
    want = {k: max((p for p, corners in shapes if inside(corners, x, y)), default=None) for k, x, y in points}
    for dense in (20, 10_000):
        got = {r.id: r.poly_id for r in joins.points_in_polygons(df, rings, "id", size=2.0, dense=dense).collect()}
        assert got == want
    cells = joins.split_cells(df, 2.0, 20)
    sizes = cells.groupBy("cell").count().collect()
    assert all(r["count"] <= 20 or r.cell.parts == joins.FINEST for r in sizes) and max(r["count"] for r in sizes) < 40  # of 750
    assert len({r.cell.parts for r in sizes}) > 1
    whole = joins.cell_polygons(cells.select("cell").distinct(), rings, 2.0).where("poly_id = 12 AND whole").count()
    assert whole > 50  # cells that need no test


def test_counted_import(spark, tmp_path):
    page = "<page>\n<title>{}</title><id>{}</id><revision><id>9</id><text>{}</text></revision></page>"
    odd_order = "<page><revision><text>odd <title>no</title></text></revision><title>A &amp; B</title><id>5</id></page>"
    dump = ["<mediawiki><siteinfo/>", page.format("A &amp; B", 1, "broken <b"), page.format("A &amp; B", 3, "good"), page.format("A &amp; B", 4, "late"),
            odd_order.replace("<title>no</title>", ""), page.format("C", 6, "only"), page.format("x" * 1025, 7, "long"),
            page.format("D", 8, "broken &"), "</mediawiki>"]
    (tmp_path / "dump.xml").write_text("\n".join(dump))
    table, counters = pages.import_counted_pages(spark, str(tmp_path / "dump.xml"), str(tmp_path / "pages"))
    assert sorted((r.title, r.wiki_id, r.wikitext) for r in table.collect()) == [("A & B", 3, "good"), ("C", 6, "only")]
    assert counters == {"records": 7, "malformed": 2, "too_long": 1, "duplicates": 2, "written": 2}
    loads = sinks.record_load(spark, str(tmp_path / "loads"), "dump.xml", counters)
    assert sinks.record_load(spark, str(tmp_path / "loads"), "other", {"records": 1}).count() == loads.count() + 1


def test_stored_years_are_not_parsed_again(spark, tmp_path):
    def tagged(word):
        rows = [("Ann", 1, f"{word} [[Category:1900 births]]"), ("Bob", 2, f"{word} {word} [[Category:1902 births]]")]
        return pages.tag_pages(spark.createDataFrame(rows, "title STRING, wiki_id LONG, wikitext STRING"))

    views = spark.createDataFrame([], "title STRING, viewcount LONG")
    path = str(tmp_path / "people")
    first = imports.fetch_people(tagged("he"), views, path, 1900, 1902)
    assert [(r.person_name, r.gender_words["he"]) for r in first.collect()] == [("Ann", 1)]
    again = imports.fetch_people(tagged("she"), views, path, 1900, 1904)
    assert sorted((r.person_name, r.gender_words["he"], r.gender_words["she"]) for r in again.collect()) == [("Ann", 1, 0), ("Bob", 0, 2)]
    assert sorted(r.birth_year for r in imports.stored_years(spark, path).collect()) == [1900, 1901, 1902, 1903]
    assert len(glob.glob(f"{path}/people/birth_year=1902/*.parquet")) == 1
    assert imports.fetch_people(tagged("it"), views, path, 1901, 1902).count() == 0


def test_occupations_over_time_read_persons_once(spark):
    from atlas.plans import charts
    people = spark.createDataFrame([("a", 1900, ["x", "y"]), ("b", 1400, ["y"]), ("c", None, ["y"])],
                                   "qid STRING, year_born INT, occupation_qids ARRAY<STRING>")
    labels = spark.createDataFrame([], "qid STRING, label STRING")
    kept = []

    def keep(df, label):
        kept.append((label, df))
        return df

    got = charts.top_occupations_over_time(people, labels, n=1, keep=keep).collect()
    assert [(r.series, r.x, r.y) for r in got] == [("y", 1900, 1)] and kept[0][0] == "cube"


def test_statements_of_one_file_are_made_on_all_cores(spark, tmp_path):
    names = "c_custkey LONG, c_name STRING, c_mktsegment STRING, c_nationkey LONG"
    customers = [(k, f"name {k}", None if k % 5 == 0 else ["BUILDING", "FURNITURE", "AUTO"][k % 3], k % 25) for k in range(200)]
    rows = {"customer": (customers + [customers[7], (None, None, None, None)], names),
            "supplier": ([(k, f"s {k}", k % 25) for k in range(9)], "s_suppkey LONG, s_name STRING, s_nationkey LONG"),
            "nation": ([(k, f"n {k}") for k in range(25)], "n_nationkey LONG, n_name STRING")}
    for name, table in rows.items():
        spark.createDataFrame(*table).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    got = inputs.triples(spark, str(tmp_path))
    plain = inputs.in_spark(spark, str(tmp_path), inputs.triples_sql())
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    of_customers = got.where("p = 'P18'").select(F.spark_partition_id().alias("task")).distinct()
    assert of_customers.count() == spark.sparkContext.defaultParallelism
