"""Column functions on hand-made values."""

import time

import pytest
from pyspark.sql import functions as F

from atlas import fixed_values as fv
from atlas.functions import claims as cl, geo, markup as mk, predicates as pr, text as tx
from atlas.functions import scanner
from atlas.functions.scanner import scan_text


def one(spark, column, value, schema="v STRING"):
    """The column over a single value."""
    return spark.createDataFrame([(value,)], schema).select(column(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("value, expected", [
    ("quiet green valleys", None), ("the bridges of Lower Norda", "the bridges"),
    ("songs by unknown singers", "songs"), ("Villages in winter", "Villages"),
    ("rivers of towns in Spain", "rivers"), ("in ", None), (None, None)])
def test_generalise(spark, value, expected):
    assert one(spark, tx.generalise, value) == expected


@pytest.mark.parametrize("value, expected", [
    ("A_b", "A b"), ("caf%C3%A9", "café"), ("a+b", "a+b"), ("50%_x", "50% x"), ("x%zz", "x%zz"), ("a%2Fb", "a/b"),
    (None, None)])
def test_decode_title(spark, value, expected):
    assert one(spark, tx.decode_title, value) == expected


def test_title_from_url(spark):
    url = "https://en.wikipedia.org/wiki/AC/DC_%28band%29"
    assert one(spark, tx.title_from_url, url) == "AC/DC (band)"
    assert one(spark, lambda c: tx.title_from_url(c, last_segment=True), url) == "DC (band)"
    assert one(spark, tx.title_from_url, "") is None


@pytest.mark.parametrize("value, expected", [
    ("1950-01-02T00:00:00Z", 1950), ("-0044-03-15T00:00:00Z", -44), ("+2001-12-00T00:00:00Z", 2001),
    ("12345-01-01", 12345), ("+18000-01-01T00:00:00Z", 18000), ("-13798000000-00-00T00:00:00Z", None), ("t123", None), ("", None), (None, None)])
def test_iso_year(spark, value, expected):
    assert one(spark, tx.iso_year, value) == expected


@pytest.mark.parametrize("value, expected", [("1905", 1905), ("c. 44 BC", 44), ("none", -1), ("", -1)])
def test_digits_to_int(spark, value, expected):
    assert one(spark, tx.digits_to_int, value) == expected


def test_lists_and_tails(spark):
    assert one(spark, tx.uri_tail, "http://x/entity/Q5") == "Q5"
    assert one(spark, tx.uri_tail, "Q5") == "Q5"
    assert one(spark, tx.uri_tail, "") is None
    assert one(spark, tx.map_pipe_list, "a/Q1||b/Q2|") == "Q1|Q2"
    assert one(spark, tx.map_pipe_list, "||") is None


def test_normalise_tags(spark):
    tags = [" B  ", "b", "a\n", "", None, "x" * 256, "y" * 255, "  "]
    assert one(spark, tx.normalise_tags, tags, "v ARRAY<STRING>") == ["", "a", "b", "y" * 255]


def test_names(spark):
    assert one(spark, tx.first_name, "Ada King Lovelace") == "Ada"
    assert one(spark, tx.last_word, "19th-century English Poets") == "poets"
    assert one(spark, tx.place_key, "Paris, Texas, USA") == "paris"
    links = ["Category:1815 births", "x", "Category:1816 births", "Category:1852 deaths", "category:1 births"]
    assert one(spark, tx.birth_year, links, "v ARRAY<STRING>") == 1816
    assert one(spark, tx.death_year, links, "v ARRAY<STRING>") == 1852
    assert one(spark, tx.death_year, ["Category:Unknown deaths"], "v ARRAY<STRING>") == -1
    assert one(spark, tx.death_year, [], "v ARRAY<STRING>") is None


def test_birth_category_years(spark):
    cats = ["1905 births", "44 bc births", "0044 births", "-10 births", "2000 births", "births", "1905 births"]
    years = one(spark, lambda c: tx.birth_category_years(c, -2000, 2000), cats, "v ARRAY<STRING>")
    assert years == [1905, -10]


def test_words(spark):
    text = "He said: «Été_1 — HIS he's»"
    assert one(spark, tx.words, text) == ["he", "said", "été_1", "his", "he", "s"]
    counts = one(spark, lambda c: tx.word_counts(tx.words(c), fv.GENDER_WEIGHTS), text)
    assert counts.asDict() == {"he": 2, "his": 1, "him": 0, "she": 0, "her": 0}


@pytest.mark.parametrize("values, expected", [
    (["12", "45", "S", "77", "6", "W"], (-12.75, -77.1)),
    (["48", "2"], (48.0, 2.0)),
    (["10", "30", "36", "S", "20", "E"], (-10.51, 20.0)),
    (["x", "35"], None), (["1", "2", "N"], (1 + 2 / 60, None)), ([], (None, None)), (["NS", "", "5d"], (None, None))])
def test_parse_coordinates(spark, values, expected):
    got = one(spark, mk.parse_coordinates, values, "v ARRAY<STRING>")
    if expected is None:
        assert got is None
    else:
        for have, want in zip(got, expected):
            assert have is None and want is None or have == pytest.approx(want, abs=5e-4)


def page_coordinate(spark, text):
    df = spark.createDataFrame([(text,)], "v STRING").select(mk.scan(F.col("v")).alias("m"))
    df = df.select(mk.coordinate_values(F.col("m.templates")).alias("c"))
    return df.select(mk.best_coordinate(F.col("c")).alias("r")).first()["r"]


@pytest.mark.parametrize("text, expected", [
    ("{{coord|12|45|S|77|6|W|region:XX|name=Port}}", (-12.75, -77.1)),
    ("{{Coord|48|2|format=dms}}", (48, 2)),
    ("{{coord missing|x}} {{coord unknown}} {{cite|1|2}}", None),
    ("{{coord|0|0|N|0|0|E}} {{coor dms|1|2}}", (1, 2)),
    ("{{coor a|5|6|N}}{{coord|0|7}}", (0, 7)),
    ("{{coord|1|2}}{{coor d|3|4}}{{coord|bad|9}}", (3, 4)),
    ("{{coord|1|<!-- c -->2}}", (1, 2)),
    ("no template", None)])
def test_page_coordinate(spark, text, expected):
    got = page_coordinate(spark, text)
    if expected is None:
        assert got is None
    else:
        assert (got.lat, got.lng) == pytest.approx(expected, abs=5e-4)


def test_scanner_nesting():
    got = scan_text("{{A|x={{B|1|k=[[L|t=u]]}}|[[M]]|{{{arg|d}}}}} end")
    names = [t["name"] for t in got["templates"]]
    assert names == ["A", "B"]
    a = got["templates"][0]["params"]
    assert [(p["name"], p["value"], p["positional"]) for p in a] == [
        ("x", "{{B|1|k=[[L|t=u]]}}", False), ("1", "[[M]]", True), ("2", "{{{arg|d}}}", True)]
    assert got["links"] == ["L", "M"] and got["plain"] == " end"


def test_scanner_broken_markup():
    got = scan_text("[[File:x|open [[In]] {{T|[[never}} ]] {{lost [[A|b]] <!-- {{no}} --> <nowiki>{{raw}} [[r]]</nowiki> }")
    assert [t["name"] for t in got["templates"]] == ["T"]
    assert "In" in got["links"] and "A" in got["links"] and "r" not in got["links"]
    assert "no" not in got["plain"].split("{{lost")[1].replace("nowiki", "")
    assert scan_text("")["plain"] == "" and scan_text("}} ]] | =")["templates"] == []
    assert scan_text("[[a\nb]]")["links"] == []


def test_scanner_gives_results_in_slices(monkeypatch):
    monkeypatch.setattr(scanner, "SLICE", 1000)
    texts = [None, "", "{{A|x=1}} [[B]] c", "y" * 2500, *["[[L]] z"] * 40]
    slices = list(scanner.scanned_slices(texts))
    assert [len(piece) for piece in slices[:1]] == [4] and max(map(len, slices)) <= 10
    assert [row for piece in slices for row in piece.to_pylist()] == [scan_text(text or "") for text in texts]


def test_scanner_is_linear():
    import time
    start = time.perf_counter()
    scan_text("{{" * 200_000 + "[[" * 200_000 + "]]" * 100_000)
    scan_text("{{a|" * 50_000 + "}}" * 50_000, ("infobox",))
    assert time.perf_counter() - start < 20


def test_plain_text(spark):
    text = "'''Bold''' <b>x</b> [http://a.b label] {{t}}[[A|shown]] [[B]]"
    df = spark.createDataFrame([(text,)], "v STRING").select(mk.scan(F.col("v")).alias("m"))
    assert df.select(mk.plain_text(F.col("m.plain")).alias("r")).first()["r"] == "Bold x label shown B"


def test_infobox(spark):
    text = "{{Infobox person| Name = A |birth_place=[[P]], [[Q|q]]|death_place=[[R]]}}{{infobox b|name=B}}{{x|name=C}}"
    df = spark.createDataFrame([(text,)], "v STRING").select(mk.scan(F.col("v")).alias("m"))
    row = df.select(
        mk.infobox_map(F.col("m.templates")).alias("map"),
        mk.place_links(mk.infobox_params(F.col("m.templates"))).alias("places")).first()
    assert row["map"]["name"] == "B" and row["places"] == ["P", "Q", "R"]
    assert one(spark, tx.infobox_type, ["a", "infobox city", "infobox x"], "v ARRAY<STRING>") == "city"
    assert one(spark, tx.infobox_type, ["a"], "v ARRAY<STRING>") is None


def claim(spark, kind, value):
    return one(spark, lambda c: cl.claim_value(F.lit(kind), c), value)


def test_claim_values(spark):
    place = '{"latitude":52,"longitude":13,"altitude":null,"precision":0.016,"globe":"http://www.wikidata.org/entity/%s"}'
    earth = claim(spark, "globecoordinate", place % "Q2")
    assert (earth.lat, earth.lng, earth.globe, earth.altitude) == (52, 13, None, None)
    assert claim(spark, "globecoordinate", place % "Q405").globe == "Q405"
    assert claim(spark, "globecoordinate", '{"latitude":0,"longitude":0}').lat is None
    assert claim(spark, "globecoordinate", '{"latitude":0,"longitude":5}').lat == 0
    assert claim(spark, "time", '{"time":"+2001-12-00T00:00:00Z","precision":11}').text == "2001-12-01T00:00:00"
    assert claim(spark, "time", '{"time":"-0044-00-00T00:00:00Z"}').text == "-044-01-01T00:00:00"
    assert claim(spark, "time", '{"time":"soon"}').text is None
    assert claim(spark, "quantity", '{"amount":"+12.5","unit":"1"}').num == 12.5
    assert claim(spark, "quantity", '{"amount":"+0"}').num is None
    assert claim(spark, "monolingualtext", '{"text":"Hej","language":"sv"}').text == "Hej"
    assert claim(spark, "string", "plain").text == "plain"
    assert claim(spark, "wikibase-entityid", '{"id":"Q5"}').item == "Q5"
    assert claim(spark, "commonsMedia?", "x").text is None


def test_points(spark):
    at = one(spark, geo.parse_point, "POINT(-1.5 2)")
    assert (at.lat, at.lng) == (2.0, -1.5)
    assert one(spark, geo.parse_point, "xPoint(1 2)") is None
    assert one(spark, geo.parse_point, "Point(1-2 3)") is None
    text = one(spark, lambda c: geo.point_text(geo.point(c.cast("double"), F.lit(2.5))), "1")
    assert text == "POINT(1.0 2.5)"


@pytest.mark.parametrize("x, y, expected", [(1, 1, True), (5, 5, False), (9, 9, True), (11, 5, False), (5, -1, False)])
def test_inside(spark, x, y, expected):
    rings = [[(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)],
             [(3.0, 3.0), (7.0, 3.0), (7.0, 7.0), (3.0, 7.0), (3.0, 3.0)]]
    schema = "v ARRAY<ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>>"
    assert one(spark, lambda c: geo.inside(c, F.lit(float(x)), F.lit(float(y))), rings, schema) is expected


@pytest.mark.parametrize("wanted, expected", [
    ({"a": ["y", "x"]}, True), ({"a": ["y", "z"]}, False), ({"a": "x"}, False), ({"k k": "v"}, True),
    ({"k k": ["v"]}, False), ({"n": 5.5}, True), ({"m": 7, "k k": "v"}, True), ({"s": 5}, False),
    ({"s": "5"}, True), ({"m": "7"}, False), ({"none": "x"}, False), ({}, True)])
def test_property_contains(spark, wanted, expected):
    doc = '{"a":["x","y"],"k k":"v","n":5.5,"m":7,"s":"5"}'
    assert one(spark, lambda c: pr.property_contains(F.parse_json(c), wanted), doc) is expected


def test_array_predicates(spark):
    arrays = "v ARRAY<STRING>"
    assert one(spark, lambda c: pr.array_contains_all(c, ["a", "b"]), ["b", "a", "c"], arrays) is True
    assert one(spark, lambda c: pr.array_contains_all(c, ["a", "d"]), ["b", "a"], arrays) is False
    assert one(spark, lambda c: pr.array_overlaps(c, ["z"]), ["b", None], arrays) is False
    assert one(spark, lambda c: pr.array_overlaps(c, ["b"]), ["b", None], arrays) is True


def test_points_read_back(spark):
    for lng, lat in ((-0.0005, 51.25), (1e-7, -3.0), (179.5, 0.00025)):
        pair = spark.createDataFrame([(lng, lat)], "x DOUBLE, y DOUBLE").select(geo.point_text(geo.point(F.col("x"), F.col("y"))).alias("t"))
        text = pair.first()["t"]
        assert "E" not in text
        back = one(spark, geo.parse_point, text)
        assert (back.lng, back.lat) == (lng, lat)
    assert one(spark, geo.parse_point, "Point(1e-3 2E1)").lat == 20.0


def test_scanner_keeps_parameters_after_unclosed_brackets():
    text = "{{Infobox person|name=[[Ann|birth_place=[[Town]]|note={{x|death_place=[[City]]}}"
    got = scanner.scan_text(text)
    names = [p["name"] for t in got["templates"] for p in t["params"]]
    assert "birth_place" in names or "death_place" in names
    outer = scanner.scan_text("{{Infobox person|name=[[Ann|birth_place=[[Town]]|death_place=[[City]]}}")["templates"][0]
    assert [p["name"] for p in outer["params"]] == ["name", "birth_place", "death_place"]


@pytest.mark.parametrize("opener", ["<!--", "<math>", "[[", "{{", "<pre>|="])
def test_unclosed_openers_take_linear_time(opener):
    start = time.perf_counter()
    scanner.scan_text(opener * 200_000)
    assert time.perf_counter() - start < 20


def test_contains_by_kind(spark):
    def holds(document, wanted):
        return one(spark, lambda c: pr.property_contains(F.parse_json(c), wanted), document)
    assert holds('{"a": true}', {"a": True}) and not holds('{"a": 1}', {"a": True}) and not holds('{"a": true}', {"a": 1})
    assert holds('{"a": {"b": 1, "c": 2}}', {"a": {"b": 1}}) and not holds('{"a": {"b": 2}}', {"a": {"b": 1}})
    assert holds('{"a": [1, 2, 3]}', {"a": [3, 1]}) and not holds('{"a": [1]}', {"a": [2]})
