"""Operators and plans on hand-computed tables."""

import random

import pytest
from pyspark.sql import functions as F

from atlas.functions import text as tx
from atlas.operators import dedupe, joins, stats
from atlas.plans import charts, entities as en, lifespans, pages, persons as ps, trends
from atlas.sinks import tables as sinks
from atlas.sources.dumps import entity_lines


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def same(df, _label, *_by):
    """Stands in for writing a step to disk."""
    return df


# --- one row per key ----------------------------------------------------------------

def test_keep_first_and_last(spark):
    data = [(k, i, f"{k}{i}") for k in "abc" for i in range(50)]
    want_first = [(k, 0, f"{k}0") for k in "abc"]
    want_last = [(k, 49, f"{k}49") for k in "abc"]
    for seed in range(3):
        random.Random(seed).shuffle(data)
        df = spark.createDataFrame(data, "k STRING, i INT, v STRING").repartition(5)
        assert rows(dedupe.keep_first(df, ["k"], ["i"]), "k") == want_first
        assert rows(dedupe.keep_last(df, ["k"], ["i"]), "k") == want_last
        assert rows(dedupe.last_wins_map(df, "k", "v", "i"), "k") == [(k, f"{k}49") for k in "abc"]


def test_drop_repeats(spark):
    data = [(f"t{i}", i, "x" * (i % 5)) for i in range(200)] + [("t3", 1000, "late"), ("t7", -1, "early")]
    df = spark.createDataFrame(data, "t STRING, i LONG, v STRING")
    want = sorted([r for r in data if r[0] not in ("t3", "t7")] + [("t3", 3, "xxx"), ("t7", -1, "early")])
    assert sorted(rows(dedupe.drop_repeats(df, "t", "i"))) == want
    twice = df.unionByName(df.where("i < 5"))
    assert sorted(rows(dedupe.drop_repeats(twice, "t", "i"))) == want
    assert dedupe.drop_repeats(df.where("i BETWEEN 10 AND 20"), "t", "i").count() == 11


def test_one_row_per_key_is_limited_before_the_shuffle(spark):
    plan = dedupe.keep_first(spark.range(1000), [F.col("id") % 3], ["id"])._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.index("Final") < physical.index("Exchange hashpartitioning") < physical.index("Partial")


def test_rank_top(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "t STRING, v INT")
    assert rows(dedupe.rank_top(df, 3, "v", "t"), "rank") == [("b", 9, 0), ("a", 5, 1), ("c", 5, 2)]


def test_collisions(spark):
    ranked = [("Paris", 0), ("Paris, Texas", 1), ("paris", 2), ("rome", 3), ("Rome, Georgia", 4), ("oslo", 5)]
    df = spark.createDataFrame(ranked, "raw STRING, rank LONG").withColumn("name", tx.place_key(F.col("raw")))
    first = dedupe.resolve_collisions(df, "raw", "name", "rank")
    last = dedupe.resolve_collisions(df, "raw", "name", "rank", keep="last")
    assert {r.name: r["rank"] for r in first.collect()} == {"paris": 0, "rome": 3, "oslo": 5}
    assert {r.name: r["rank"] for r in last.collect()} == {"paris": 1, "rome": 4, "oslo": 5}


# --- joins ---------------------------------------------------------------------------

@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_equals_a_plain_join(spark, no_broadcast, how):
    facts = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, None).otherwise(F.col("id") % 50).alias("k"))
    dim = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.lookup(facts, dim, "k", ["id"], how, min_rows=100)
    assert sorted(map(str, rows(got.select("id", "k", "v")))) == sorted(map(str, rows(facts.join(dim, "k", how).select("id", "k", "v"))))


def test_lookup_spreads_a_hot_key(spark, no_broadcast):
    """No reduce task may get a third of the facts."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        facts = spark.range(80_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
        dim = spark.range(80_000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        sizes = joins.lookup(facts, dim, "k", ["id"], "left", min_rows=1000).groupBy(
            F.spark_partition_id().alias("p")).count().agg(F.sum("count"), F.max("count")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sizes[0] == 80_000 and sizes[1] < 80_000 / 4


def test_small_dimension_is_not_counted_for(spark):
    plan = joins.lookup(spark.range(1000).withColumnRenamed("id", "k"), spark.range(10).withColumnRenamed("id", "k"),
                        "k", ["k"], "inner")
    assert joins.fits_broadcast(spark.range(10)) and not joins.fits_broadcast(spark.range(1 << 30))
    assert "Aggregate" not in plan._jdf.queryExecution().toString()


def test_key_sets(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id INT, v STRING")
    keys = spark.createDataFrame([(1,), (1,), (9,)], "k INT")
    assert rows(joins.in_key_set(df, "id", keys, "k")) == [(1, "a")]
    done = spark.createDataFrame([(2,)], "id INT")
    assert rows(joins.pending(df, done, "id"), "id") == [(1, "a"), (3, "c")]
    assert joins.pending(df, done, "id", force=True).count() == 3


def test_first_resolved(spark):
    df = spark.createDataFrame([("p", ["x", "b", "a"]), ("q", ["x"]), ("r", []), ("s", ["a", "b", "a"])],
                               "k STRING, c ARRAY<STRING>")
    dim = spark.createDataFrame([("a", 1), ("b", 2)], "place STRING, v INT")
    got = joins.first_resolved(df, "k", F.col("c"), dim, "place").select("k", "place", "v")
    assert rows(got, "k") == [("p", "b", 2), ("q", None, None), ("r", None, None), ("s", "a", 1)]


def square(poly_id, name, x0, y0, size, hole=None):
    def ring(a, b, s):
        return [(a, b), (a + s, b), (a + s, b + s), (a, b + s), (a, b)]
    rings = [ring(x0, y0, size)] + ([ring(*hole)] if hole else [])
    return (poly_id, name[:3].upper(), name, "C", rings)


def test_points_in_polygons(spark):
    polygons = spark.createDataFrame([
        square(0, "Big", -5.5, -5.5, 20.0, hole=(0.0, 0.0, 2.0)), square(1, "Inner", 5.0, 5.0, 1.0),
        square(2, "France", 100.0, 0.0, 3.0)],
        "poly_id INT, iso_a3 STRING, name STRING, continent STRING, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    points = spark.createDataFrame(
        [("a", -5.2, -5.2), ("b", 5.5, 5.5), ("c", 1.0, 1.0), ("d", 101.0, 1.0), ("e", 50.0, 50.0), ("f", None, 1.0)],
        "id STRING, lng DOUBLE, lat DOUBLE")
    got = {r.id: r.name for r in joins.points_in_polygons(points, polygons, "id").collect()}
    assert got == {"a": "Big", "b": "Inner", "c": None, "d": "France", "e": None, "f": None}


# --- statistics ------------------------------------------------------------------------

def test_composition_sums_to_100(spark):
    df = spark.createDataFrame([("a", 1, 3), ("b", 1, 1), ("a", 2, 0), ("b", 2, 0)], "series STRING, x INT, y INT")
    got = {(r.series, r.x): r.share for r in stats.composition(df, "x", "y").collect()}
    assert got == {("a", 1): 75.0, ("b", 1): 25.0, ("a", 2): None, ("b", 2): None}


def test_winner(spark):
    def won(votes):
        df = spark.createDataFrame([(votes,)], "v ARRAY<STRUCT<key: STRING, weight: INT>>")
        return df.select(stats.winner(F.col("v"))).first()[0]

    assert won([("a", 1), ("b", 2), ("a", 1)]) == "a"
    assert won([("b", 1), ("a", 1)]) == "b"
    assert won([("a", 1), ("b", 1), ("c", 3)]) == "c"
    assert won([]) == ""


def test_distinct_ids(spark):
    df = spark.createDataFrame([("q1", None, ["q2", "q3"]), ("", "q1", None)], "a STRING, b STRING, l ARRAY<STRING>")
    assert rows(stats.distinct_ids(df, ["a", "b"], ["l"]), "qid") == [("q1",), ("q2",), ("q3",)]


def test_group_means_skip_missing(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 3, 4), (None, 9, 9)], "k STRING, x INT, y INT")
    assert rows(stats.group_means(df, "k", ["x", "y"])) == [("a", 2.0, 4.0)]
    assert rows(stats.group_value_counts(df, "k", ["x", "y"])) == [("a", 2, 1)]


def test_small_sample_and_unknown_country(spark):
    people = [(f"Q{i}", "N" if i < 60 else "U" if i < 110 else "S", 1900,
               "Q6581072" if i % 4 == 0 else "Q6581097") for i in range(120)]
    df = spark.createDataFrame(people, "qid STRING, pob_country_code STRING, year_born INT, gender_qid STRING")
    codes = spark.createDataFrame([("N", "NNN"), ("S", "SSS")], "alpha2 STRING, alpha3 STRING")
    assert rows(charts.gender_by_country(df, codes)) == [("NNN", 0.25, 60)]
    assert rows(charts.density_by_country(df, codes), "location") == [("NNN", 1.778, 60), ("SSS", 1.0, 10)]


def test_year_with_no_top_occupation_stays(spark):
    people = [("a", 1900, ["x"]), ("b", 1900, ["x", "y"]), ("c", 1901, ["z"]), ("d", 1902, None), ("e", 1400, ["x"])]
    df = spark.createDataFrame(people, "qid STRING, year_born INT, occupation_qids ARRAY<STRING>")
    labels = spark.createDataFrame([("x", "Ex")], "qid STRING, label STRING")
    got = rows(charts.top_occupations_over_time(df, labels, n=2, keep=same))
    assert got == [("Ex", 1900, 2, pytest.approx(200 / 3)), ("y", 1900, 1, pytest.approx(100 / 3)),
                   ("Ex", 1901, 0, None), ("y", 1901, 0, None)]


def test_life_spans(spark):
    people = [("a", 1, 1, 1900, 1950, "m", "poets", "art", "NL", "E"), ("b", 1, 1, 1930, 1940, "m", "poets", "art", "NL", "E"),
              ("c", 1, 1, 1900, None, "m", "rappers", "art", "NL", "E"), ("d", None, 1, 1900, 1990, "m", "poets", "art", "NL", "E")]
    df = spark.createDataFrame(people, """person_name STRING, view_count LONG, word_count INT, year_born INT,
        year_died INT, gender STRING, occupation STRING, field STRING, country_code STRING, continent STRING""")
    assert rows(lifespans.life_expectancy_by_occupation(df)) == [("poets", 30.0)]
    assert rows(lifespans.life_expectancy_of_top_jobs(df)) == [("rappers", None), ("poets", 50.0)]
    assert rows(lifespans.life_span_summary(df)) == [(50.0, 1900.0, None)]


# --- entities ----------------------------------------------------------------------------

def snak(rank, kind, value):
    return {"rank": rank, "mainsnak": {"datavalue": {"type": kind, "value": value}}}


def item(rank, qid):
    return snak(rank, "wikibase-entityid", {"id": qid})


def build(spark, main_claims):
    import json
    named = {"Q1": "Red", "Q2": "Blue", "Q3": "Green", "P1": "color", "P2": "population", "P3": "color", "P4": "place"}
    objects = [{"id": i, "labels": {"en": {"value": n}}} for i, n in named.items()]
    objects.append({"id": "Q9", "labels": {"en": {"value": "Nine"}}, "sitelinks": {"enwiki": {"title": "Nine (x)"}},
                    "claims": main_claims})
    lines = spark.createDataFrame([(json.dumps(o) + ",",) for o in objects], "value STRING")
    return entity_lines(lines)


def properties(spark, claims):
    long = en.entity_properties(build(spark, claims), keep=same)
    return {r.prop_name: r for r in long.collect()}


@pytest.mark.parametrize("claims, vals", [
    ([item("normal", "Q1")], ["Red"]),
    ([item("normal", "Q1"), item("normal", "Q2")], ["Blue", "Red"]),
    ([item("normal", "Q1"), item("normal", "Q1")], ["Red", "Red"]),
    ([item("normal", "Q1"), item("normal", "Q3"), item("preferred", "Q2")], ["Blue"]),
    ([item("normal", "Q1"), item("preferred", "Q404")], ["Red"]),
    ([item("deprecated", "Q1")], None),
    ([item("normal", "Q404")], None),
    ([item("normal", "Q1"), snak("normal", "string", "s"), item("normal", "Q2")], ["Blue", "s"]),
    ([snak("normal", "string", "a"), snak("normal", "string", "b")], ["b"]),
    ([{"rank": "normal"}, {"rank": "normal", "mainsnak": {}}], None)])
def test_best_rank(spark, claims, vals):
    got = properties(spark, {"P1": claims})
    assert (got["color"].vals if got else None) == vals


def test_property_names_and_falsy_values(spark):
    got = properties(spark, {
        "P1": [item("normal", "Q1")], "P3": [item("normal", "Q2")], "P7": [item("normal", "Q3")],
        "P2": [snak("normal", "quantity", {"amount": "+5"}), snak("normal", "quantity", {"amount": "+0"})],
        "P4": [snak("normal", "globecoordinate", {"latitude": 0, "longitude": 5, "altitude": 0,
                                                   "globe": "http://x/entity/Q1"})]})
    assert set(got) == {"color", "population", "place"}
    assert got["color"].vals == ["Blue"] and got["population"].num == 5.0
    assert (got["place"].lat, got["place"].lng, got["place"].globe, got["place"].altitude) == (0, 5, "Q1", None)


def test_entity_documents(spark):
    entities = build(spark, {
        "P1": [item("normal", "Q1"), item("normal", "Q2")],
        "P2": [snak("normal", "quantity", {"amount": "+5.5"})],
        "P4": [snak("normal", "globecoordinate", {"latitude": 1, "longitude": 5, "globe": "http://x/Q404"})]})
    table = en.entity_table(en.linked_entities(entities), en.entity_properties(entities, keep=same))
    assert rows(table.select("wikipedia_id", F.to_json("properties"))) == [
        ("Nine (x)", '{"color":["Blue","Red"],"place":{"lat":1,"lng":5},"population":5.5}')]
    assert rows(en.entities_with_properties(table, {"color": ["Red"]}, "population")) == [("Nine", "5.5")]
    assert rows(en.entities_with_properties(table, {"color": "Red"})) == []
    assert en.entity_lookup(table, "Nine (x)").count() == 1


def test_duplicate_articles_keep_the_lowest_id(spark):
    lines = [f'{{"id":"{q}","labels":{{"en":{{"value":"L"}}}},"sitelinks":{{"enwiki":{{"title":"A"}}}}}},'
             for q in ("Q100", "Q20", "Q3000")]
    found = en.linked_entities(entity_lines(spark.createDataFrame([(x,) for x in lines], "value STRING")))
    assert [r.wikidata_id for r in found.collect()] == ["Q20"]


# --- persons ---------------------------------------------------------------------------

def test_persons(spark):
    wiki, site = "https://en.wikipedia.org/wiki/", "https://en.wikipedia.org/"
    full = [("P31", "x/Q5"), ("P569", "1850-01-01"), ("P569", "1820-01-01"), ("P569", "2050-01-01"),
            ("sitelinks", "7"), ("P19", "x/Qb"), ("P19", "x/Qa"), ("P27", "x/Qn"), ("P27", "x/Qm"), ("P27", "x/Qz"),
            ("P106", "x/Qo2"), ("P106", "x/Qo1"), ("P106", "x/Qo2"), ("P18", "a.png")]
    data = [("Q1", p, o, None) for p, o in full] + [
        ("Q1", "label", "One", "en"), ("Q1", "label", "Eins", "de"),
        (wiki + "One_%C3%A9", "about", "x/Q1", None), (wiki + "One_%C3%A9", "isPartOf", site, None),
        ("Qa", "P625", "Point(4.5 52)", None), ("Qa", "P17", "x/Qn", None), ("Qb", "P625", "Point(1 1)", None),
        ("Qn", "P297", "NL", None), ("Qm", "P297", "DE", None),
        ("Q2", "P31", "x/Q5", None), ("Q2", "P569", "1850-01-01", None), ("Q2", "sitelinks", "1", None),
        (wiki + "Zwei", "about", "x/Q2", None), (wiki + "Zwei", "isPartOf", "https://de.wikipedia.org/", None),
        ("Q3", "P31", "x/Q6", None), ("Q3", "P569", "1850-01-01", None), ("Q3", "sitelinks", "1", None),
        (wiki + "Three", "about", "x/Q3", None), (wiki + "Three", "isPartOf", site, None)]
    triples = spark.createDataFrame(data, "s STRING, p STRING, o STRING, lang STRING")
    (one,) = ps.persons(triples, keep=same).collect()
    assert (one.qid, one.enwiki_title, one.name, one.year_born, one.year_died) == ("Q1", "One é", "One", 1850, None)
    assert one.citizenship_country_codes == ["DE", "NL"] and one.occupation_qids == ["Qo1", "Qo2"]
    assert (one.pob_qid, one.pob_lat, one.pob_lon, one.pob_country_code) == ("Qa", 52.0, 4.5, "NL")
    assert one.pod_qid is None and one.field_qids is None and one.sitelink_count == 7
    flat = ps.flat_persons(ps.persons(triples, keep=same)).first()
    assert flat.occupation_qids == "Qo1|Qo2" and flat.field_qids is None


def test_upserts_and_progress(spark, tmp_path):
    current = spark.createDataFrame([("Q1", "old"), ("Q2", "kept")], "qid STRING, label STRING")
    updates = spark.createDataFrame([("Q1", "b", 2), ("Q1", "a", 1), ("Q3", "new", 1)], "qid STRING, label STRING, n INT")
    merged = sinks.upsert_labels(current, updates, "n", str(tmp_path / "labels"))
    assert rows(merged, "qid") == [("Q1", "b"), ("Q2", "kept"), ("Q3", "new")]
    done = sinks.progress(spark.createDataFrame([(1900,), (1900,), (1901,)], "y INT"), F.col("y"))
    assert rows(done.select("bucket", "row_count"), "bucket") == [("1900", 2), ("1901", 1)]


# --- pages and people --------------------------------------------------------------------

def test_over_long_names_are_dropped(spark):
    df = spark.createDataFrame([("t" * 1025, 1, "x"), ("ok", 2, "x"), ("long box", 3, "{{Infobox " + "b" * 240 + "}}")],
                               "title STRING, wiki_id LONG, wikitext STRING")
    got = {r.title: r.infobox for r in pages.tag_pages(df).collect()}
    assert got == {"ok": None, "long box": "b" * 240}


PEOPLE = [
    ("Ann Lee", 1, "{{Infobox writer|birth_place=[[Nowhere]] [[Town]]}} She and her. He. [[Category:1900 births]]"
                   "[[Category:1950 deaths]][[Category:English poets]][[Category:English painters]]"),
    ("Ann Ray", 2, "No word. [[Town]] [[Category:1901 births]][[Category:1902 births]]"),
    ("Bob Ray", 3, "{{Infobox person|death_place=[[Town]]}} He his him. [[Category:150 births]]"),
    ("Old One", 4, "[[Category:44 BC births]]"),
    ("Town", 5, "{{coord|1|1}}"),
]


def tagged(spark):
    return pages.tag_pages(spark.createDataFrame(PEOPLE, "title STRING, wiki_id LONG, wikitext STRING")).cache()


def test_people_by_birth_category(spark):
    views = spark.createDataFrame([("Ann Lee", 10)], "title STRING, viewcount LONG")
    got = trends.people_by_birth_category(tagged(spark), views)
    assert rows(got.select("birth_year", "person_name", "born", "died", "view_count"), "birth_year") == [
        (150, "Bob Ray", 150, None, None), (1900, "Ann Lee", 1900, 1950, 10),
        (1901, "Ann Ray", 1902, None, None), (1902, "Ann Ray", 1902, None, None)]


def test_person_trends(spark):
    views = spark.createDataFrame([("Ann Lee", 10)], "title STRING, viewcount LONG")
    polygons = spark.createDataFrame([square(0, "France", 0.0, 0.0, 2.0)],
        "poly_id INT, iso_a3 STRING, name STRING, continent STRING, rings ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>")
    codes = spark.createDataFrame([("FR", "FRA")], "alpha2 STRING, alpha3 STRING")
    got = rows(trends.person_trends(tagged(spark), views, polygons, codes, keep=same), "person_name")
    # Ann Lee: words he 1, she 1, her 1 -> (2 - 2 - 1) / 5 = -0.2; Ann Ray has 0 and stands twice, so the
    # mean of Anns is -0.2 / 3 and both lean to female.  Their places resolve to Town, the first located
    # one (it is Bob's first location); the Ray born in 150 is left out.
    assert [(r[0], r[1], r[3], r[4], r[5], r[6], r[7], r[8], r[9]) for r in got] == [
        ("Ann Lee", 10, 1900, 1950, "female", "poets", "art", "FR", "C"),
        ("Ann Ray", None, 1902, None, "female", "", "", "FR", "C")]


def test_person_trends_by_shuffles(spark, no_broadcast):
    test_person_trends(spark)


def test_persons_by_shuffles(spark, no_broadcast):
    test_persons(spark)


def test_entity_documents_by_shuffles(spark, no_broadcast):
    test_entity_documents(spark)


def test_repeats_with_missing_order_are_dropped(spark):
    df = spark.createDataFrame([("a", None, "x"), ("a", 2, "y"), ("a", 1, "z"), ("b", None, "v")], "k STRING, n INT, v STRING")
    assert sorted(r.v for r in dedupe.drop_repeats(df, "k", "n").collect()) == ["v", "z"]


def test_points_off_the_globe_lie_nowhere(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5), (2, 9e10, 5.0), (3, None, 1.0)], "id INT, lng DOUBLE, lat DOUBLE")
    square = "array(array(struct(0D AS x, 0D AS y), struct(1D AS x, 0D AS y), struct(1D AS x, 1D AS y), struct(0D AS x, 1D AS y)))"
    polygons = spark.sql(f"SELECT 7 AS poly_id, {square} AS rings")
    got = joins.points_in_polygons(points, polygons, "id").orderBy("id").collect()
    assert [r.poly_id for r in got] == [7, None, None]


def test_quantities_keep_the_zero_rule(spark, tmp_path):
    from atlas.catalog import operator_queries  # noqa: F401  (registers the query)
    from atlas.catalog.registry import run
    spark.sql("SELECT 2L AS o_orderkey, 0L AS o_custkey UNION ALL SELECT 4L, 7L").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r.amount for r in run("quantities_without_zero", spark, str(tmp_path)).collect()}
    assert got == {2: None, 4: 7.0}
