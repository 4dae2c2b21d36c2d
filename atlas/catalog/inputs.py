"""Wiki-shaped relations derived from the benchmark tables.

The benchmark tables hold no articles, claims or view logs.  Each relation here is
a row-by-row rewriting of whole tables into the shape an operator reads, written
once as a SELECT that Spark and the checking database both understand.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas.functions import text as tx
from atlas.session import scratch_dir, spread

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXY"
_CODE = f"concat('N', substr('{_LETTERS}', CAST({{0}} AS INT) + 1, 1))"

PERSONS = f"""
SELECT concat('Q', o_orderkey) AS qid,
       CASE WHEN o_orderstatus = 'P' THEN 'Q6581097' WHEN o_orderstatus = 'O' THEN 'Q6581072'
            WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'Q48270' END AS gender_qid,
       CAST(1490 + o_orderkey % 530 AS INT) AS year_born,
       CASE WHEN o_custkey % 26 = 25 THEN NULL ELSE {_CODE.format('o_custkey % 25')} END AS pob_country_code,
       concat('Q7', o_custkey) AS pob_qid,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('Q7', o_custkey % 97) END AS pod_qid,
       CASE WHEN o_orderkey % 7 = 0 THEN 'Q3739104' ELSE NULL END AS manner_of_death_qid,
       CASE WHEN o_orderpriority = '5-LOW' THEN NULL
            ELSE concat('QP', substr(o_orderpriority, 1, 1), '|QS', o_orderstatus, '|QM', month(o_orderdate))
       END AS occupations,
       CASE WHEN o_orderkey % 4 = 0 THEN concat('QF', o_custkey % 13) ELSE NULL END AS fields
FROM {{orders}}
"""

CODES = f"""
SELECT concat(CASE WHEN n_regionkey = 4 THEN 'x' ELSE '' END, {_CODE.format('n_nationkey')}) AS alpha2,
       CASE WHEN n_nationkey = 3 THEN 'FRA' WHEN n_nationkey < 10 THEN concat('N0', n_nationkey)
            ELSE concat('N', n_nationkey) END AS alpha3,
       n_nationkey
FROM {{nation}}
"""

LABELS = """
SELECT DISTINCT concat('QP', substr(o_orderpriority, 1, 1)) AS qid, lower(o_orderpriority) AS label FROM {orders}
UNION ALL
SELECT DISTINCT concat('QS', o_orderstatus) AS qid, concat('status ', o_orderstatus) AS label FROM {orders}
"""

TRENDS = """
SELECT concat(l_orderkey, '-', l_linenumber, '-', l_partkey) AS person_name,
       l_partkey AS view_count,
       CAST(floor(l_extendedprice) AS INT) AS word_count,
       CAST(1850 + l_orderkey % 120 AS INT) AS year_born,
       CASE WHEN l_linenumber = 3 THEN NULL
            ELSE CAST(1870 + l_orderkey % 120 + floor(l_quantity) AS INT) END AS year_died,
       CASE WHEN l_returnflag = 'R' THEN 'female' ELSE 'male' END AS gender,
       CASE l_suppkey % 150 WHEN 1 THEN 'rappers' WHEN 2 THEN 'billionaires' WHEN 3 THEN NULL
            ELSE concat('job ', l_suppkey % 150) END AS occupation,
       lower(l_returnflag) AS field,
       CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN NULL ELSE 'NA' END AS country_code,
       'Europe' AS continent
FROM {lineitem}
"""

VIEW_LINES = """
SELECT CASE WHEN event_id % 11 = 0 THEN concat('de ', raw, ' ', n, ' 0')
            WHEN event_id % 13 = 0 THEN concat('en ', raw, ' extra ', n, ' 0')
            WHEN event_id % 17 = 0 THEN concat('en.m ', raw, ' ', n, ' 0')
            ELSE concat('en ', raw, ' ', n, ' 0') END AS value,
       title, n,
       event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_type <> 'purchase' AS counts
FROM (SELECT event_id, event_type, CAST(floor(value) AS BIGINT) AS n,
             CASE event_type WHEN 'view' THEN concat('Page_', user_id, '%2Fa+b')
                  WHEN 'click' THEN concat('Page_', user_id) WHEN 'purchase' THEN concat('Talk:Page_', user_id)
                  WHEN 'signup' THEN concat('100%_', user_id) ELSE concat('Caf%C3%A9_', user_id) END AS raw,
             CASE event_type WHEN 'view' THEN concat('Page ', user_id, '/a+b')
                  WHEN 'click' THEN concat('Page ', user_id) WHEN 'purchase' THEN concat('Talk:Page ', user_id)
                  WHEN 'signup' THEN concat('100% ', user_id) ELSE concat('Café ', user_id) END AS title
      FROM {events}) e
"""

# Articles about people: one per document, its text kept whole.
_ARTICLE_PARTS = """
SELECT doc_id, text, lang, n_chars,
       concat('F', substr(source, 4), ' ', doc_id) AS title,
       concat('F', substr(source, 4)) AS first_name,
       CASE lang WHEN 'en' THEN 'philosopher' WHEN 'fr' THEN 'writer' WHEN 'de' THEN 'artist' ELSE 'person' END AS kind,
       CAST(CASE WHEN doc_id % 17 = 0 THEN 150 ELSE 1800 + doc_id % 150 END AS INT) AS born,
       CAST(CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN 190 ELSE 1840 + doc_id % 190 END AS INT) AS died,
       doc_id % 50 = 1 AS bc, doc_id % 10 = 0 AS twice,
       CASE doc_id % 3 WHEN 0 THEN 'She wrote her books. ' WHEN 1 THEN 'He wrote his book; they saw him. '
            ELSE '' END AS opening,
       CASE doc_id % 5 WHEN 0 THEN 'philosophers' WHEN 1 THEN 'poets' WHEN 2 THEN 'chemists'
            WHEN 3 THEN 'boxers' ELSE 'unknowns' END AS job_a,
       CASE doc_id % 4 WHEN 0 THEN 'poets' WHEN 1 THEN 'painters' WHEN 2 THEN 'bankers' ELSE 'judges' END AS job_b,
       concat('Place ', doc_id % 40) AS place_a, concat('Place ', doc_id % 60) AS place_b,
       concat('Place ', doc_id % 25) AS place_c
FROM {documents}
"""

ARTICLES = """
SELECT doc_id AS wiki_id, title, first_name, text, lang, n_chars, kind, born, died, bc, twice, job_a, job_b,
       place_a, place_b, place_c, opening,
       concat('{{Infobox ', kind, ' <!-- kind -->', chr(10), '| name = {{nowrap|', title, '}}', chr(10),
              '| birth_place = ', CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('[[', place_a, '|home]], [[Nowhere]]') END,
              chr(10), '| Death_place = [[', place_b, ']]', chr(10), '}}', chr(10),
              opening, text, chr(10), '[[', place_c, '|shown ', doc_id, ']] {{cite|{{inner', chr(10), '}}|[[Nested page]]}}',
              chr(10), '[[File:pic.png|thumb|open [[Last page]]', chr(10),
              '[[Category:', born, CASE WHEN bc THEN ' BC births]]' ELSE ' births]]' END, chr(10),
              CASE WHEN twice THEN concat('[[Category:', born + 1, ' births]]', chr(10)) ELSE '' END,
              CASE WHEN died IS NULL THEN '' ELSE concat('[[Category:', died, ' deaths]]', chr(10)) END,
              '[[Category:Old ', job_a, ']]', chr(10), '[[Category:Great ', job_b, ']]', chr(10),
              '[[Category:Texts of ', lang, ']]') AS wikitext,
       concat(opening, text, ' shown ', doc_id, ' File pic png thumb open Last page Category ', born,
              CASE WHEN bc THEN ' BC births ' ELSE ' births ' END,
              CASE WHEN twice THEN concat('Category ', born + 1, ' births ') ELSE '' END,
              CASE WHEN died IS NULL THEN '' ELSE concat('Category ', died, ' deaths ') END,
              'Category Old ', job_a, ' Category Great ', job_b, ' Category Texts of ', lang) AS words_text,
       CASE WHEN doc_id % 6 = 0 THEN NULL ELSE place_a END AS birth_place
FROM (<articles>) a
""".replace("<articles>", _ARTICLE_PARTS)

# Articles about places: one per supplier, with every way of writing a coordinate.
PLACES = """
SELECT s_suppkey AS wiki_id, k, title, CAST(lat AS DOUBLE) AS lat, CAST(lng AS DOUBLE) AS lng, area,
       concat('{{Infobox settlement|name=', title, '}}', chr(10),
              CASE k WHEN 0 THEN concat('{{coord|', deg_n, '|30|N|', deg_e, '|15|E|region:NL|display=title}}')
                     WHEN 1 THEN concat('{{Coord|', deg_n, '.5|', deg_e, '.25|type:city|display=title}}')
                     WHEN 2 THEN '{{coord missing|Nowhere}} no coordinate here'
                     WHEN 3 THEN concat('{{coor dms|', deg_n, '|30|0|S|', deg_e, '|15|0|W}}')
                     WHEN 4 THEN concat('{{coord|bad|value}}{{geolinks-start|', deg_n, '.5|', deg_e, '.25}}')
                     ELSE '{{coord|0|0|N|0|0|E}}' END,
              chr(10), 'A place.', chr(10), '[[Category:', area, ' in Nation ', s_nationkey, ']]') AS wikitext
FROM (SELECT s_suppkey, s_nationkey, s_suppkey % 6 AS k, s_suppkey % 40 AS deg_n, (s_suppkey * 7) % 45 AS deg_e,
             CASE s_suppkey % 5 WHEN 4 THEN concat('Place ', s_suppkey - 1, ', North')
                  WHEN 2 THEN concat('place ', s_suppkey - 1) ELSE concat('Place ', s_suppkey) END AS title,
             CASE s_suppkey % 6 WHEN 2 THEN NULL WHEN 5 THEN 0.0 WHEN 3 THEN -(s_suppkey % 40 + 0.5)
                  ELSE s_suppkey % 40 + 0.5 END AS lat,
             CASE s_suppkey % 6 WHEN 2 THEN NULL WHEN 5 THEN 0.0 WHEN 3 THEN -((s_suppkey * 7) % 45 + 0.25)
                  ELSE (s_suppkey * 7) % 45 + 0.25 END AS lng,
             CASE s_suppkey % 7 WHEN 0 THEN 'Rivers' WHEN 1 THEN 'Populated places' ELSE 'Cities' END AS area
      FROM {supplier}) s
"""

VIEWS = f"""
SELECT CASE event_type WHEN 'click' THEN concat('Place ', user_id, ', North')
            WHEN 'view' THEN concat('place ', user_id) ELSE concat('Place ', user_id) END AS title,
       CAST(sum(floor(value)) AS BIGINT) AS viewcount
FROM {{events}} GROUP BY 1
UNION ALL
SELECT concat('F', substr(source, 4), ' ', doc_id) AS title, n_chars AS viewcount FROM {{documents}} WHERE lang <> 'de'
"""

# Country squares from nations, five inner ones from regions; x0 <= x < x1.
POLYGONS = """
SELECT CAST(n_nationkey AS INT) AS poly_id,
       CASE WHEN n_nationkey = 3 THEN '-99' WHEN n_nationkey < 10 THEN concat('N0', n_nationkey)
            ELSE concat('N', n_nationkey) END AS iso_a3,
       CASE WHEN n_nationkey = 3 THEN 'France' ELSE n_name END AS name,
       concat('Continent ', n_regionkey) AS continent,
       CAST(n_nationkey % 5 AS DOUBLE) * 20 - 50 AS x0, CAST(n_nationkey % 5 AS DOUBLE) * 20 - 30 AS x1,
       CAST(floor(n_nationkey / 5) AS DOUBLE) * 20 - 50 AS y0, CAST(floor(n_nationkey / 5) AS DOUBLE) * 20 - 30 AS y1,
       n_nationkey % 7 = 0 AS hole
FROM {nation}
UNION ALL
SELECT CAST(100 + r_regionkey AS INT), concat('N1', r_regionkey), r_name, 'Inner',
       CAST(r_regionkey AS DOUBLE) * 20 - 45, CAST(r_regionkey AS DOUBLE) * 20 - 38,
       CAST(12.1 AS DOUBLE), CAST(17.9 AS DOUBLE), 1 = 0
FROM {region}
"""

ENTITY_PARTS = """
SELECT p_partkey, p_size,
       concat('Q', 1000 + p_partkey) AS qid,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_name, ' ', p_partkey) END AS title,
       CASE WHEN p_partkey % 9 = 0 THEN NULL
            ELSE concat('Part ', p_partkey - CASE WHEN p_partkey % 7 = 6 THEN 1 ELSE 0 END) END AS wikipedia_id,
       p_type AS description, p_brand,
       p_size % 25 AS n1, (p_size * 3) % 25 AS n2, (p_size + 7) % 25 AS n3,
       CASE p_size % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'preferred' ELSE 'deprecated' END AS rank2,
       (p_size % 5) * 10 AS amount1, p_size AS amount2,
       CASE WHEN p_partkey % 4 = 0 THEN 'preferred' ELSE 'normal' END AS rank_amount1,
       1900 + p_size AS year, CASE WHEN p_size % 2 = 0 THEN '' ELSE p_brand END AS brand,
       p_size % 11 AS lat, p_partkey % 13 AS lng,
       CASE p_partkey % 4 WHEN 0 THEN 'Q2' WHEN 1 THEN 'Q3' ELSE 'Q99999999' END AS globe,
       CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS altitude
FROM {part}
"""


def _claim(rank: str, kind: str, value: str) -> str:
    """SQL for one claim in JSON; ``value`` is SQL for its JSON value."""
    return (f"""concat('{{"rank":"', {rank}, '","mainsnak":{{"datavalue":"""
            f"""{{"type":"{kind}","value":', {value}, '}}}}}}')""")


def _object(**fields: str) -> str:
    """SQL for a JSON object; each field is SQL for its JSON value."""
    pairs = ", ',', ".join(f"""'"{name}":', {value}""" for name, value in fields.items())
    return f"concat('{{', {pairs}, '}}')"


def _text(value: str) -> str:
    return f"""concat('"', {value}, '"')"""


def _item(n: str) -> str:
    return _object(id=_text(f"concat('Q', {n})"))


def _named(value: str, key: str, field: str) -> str:
    """SQL for an object with one inner object, or an empty one where ``value`` is NULL."""
    return f"""CASE WHEN {value} IS NULL THEN '{{}}' ELSE {_object(**{key: _object(**{field: _text(value)})})} END"""


_CLAIMS = _object(
    P0="concat('[', " + ", ',', ".join([
        _claim("'normal'", "wikibase-entityid", _item("n1")), _claim("rank2", "wikibase-entityid", _item("n2")),
        _claim("'normal'", "wikibase-entityid", _item("n3"))]) + ", ']')",
    P1="concat('[', " + ", ',', ".join([
        _claim("rank_amount1", "quantity", _object(amount=_text("concat('+', amount1)"))),
        _claim("'normal'", "quantity", _object(amount=_text("concat('+', amount2)")))]) + ", ']')",
    P2="concat('[', " + _claim("'normal'", "time", _object(
        time=_text("concat('+', year, '-00-00T00:00:00Z')"))) + ", ']')",
    P3="concat('[', " + _claim("'normal'", "string", _text("brand")) + ", ']')",
    P4="concat('[', " + _claim("'normal'", "globecoordinate", _object(
        latitude="lat", longitude="lng", altitude="altitude",
        globe=_text("concat('http://www.wikidata.org/entity/', globe)"))) + ", ']')",
    P9="concat('[', " + _claim("'normal'", "string", _text("'lost'")) + ", ']')",
)


def _entity(id_: str, label: str, description: str, article: str, claims: str) -> str:
    return "concat(" + _object(
        id=_text(id_), labels=_named(label, "en", "value"), descriptions=_named(description, "en", "value"),
        sitelinks=_named(article, "enwiki", "title"), claims=claims) + ", ',')"


NATION_NAMES = """
SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_name END AS label,
       CASE WHEN n_nationkey % 3 = 0 AND n_nationkey % 5 <> 4 THEN concat('Country ', n_nationkey) END AS article
FROM {nation}
"""

PROPERTY_NAMES = """
SELECT r_regionkey, CASE WHEN r_regionkey = 3 THEN 'AFRICA' ELSE r_name END AS label FROM {region}
"""

ENTITY_LINES = f"""
SELECT {_entity('qid', 'title', 'description', 'wikipedia_id', _CLAIMS)} AS value FROM ({ENTITY_PARTS}) e
UNION ALL
SELECT {_entity("concat('Q', n_nationkey)", 'label', 'NULL', 'article', "'{}'")} FROM ({NATION_NAMES}) n
UNION ALL
SELECT {_entity("concat('P', r_regionkey)", 'label', 'NULL', 'NULL', "'{}'")} FROM ({PROPERTY_NAMES}) r
UNION ALL
SELECT CASE WHEN r_regionkey < 3 THEN '[' ELSE ']' END FROM {{region}}
"""


_ENTITY = "http://www.wikidata.org/entity/"

# Statements per source row: predicate, SQL for the object, language.
_STATEMENTS = {
    "customer": ("concat('%sQC', c_custkey)" % _ENTITY, [
        ("P31", f"CASE WHEN c_custkey % 20 = 0 THEN '{_ENTITY}Q6' ELSE '{_ENTITY}Q5' END", None),
        ("P569", "concat('+', 1790 + c_custkey % 230, '-03-01T00:00:00Z')", None),
        ("P569", "CASE WHEN c_custkey % 15 = 1 THEN concat('+', 1795 + c_custkey % 230, '-04-01T00:00:00Z') END", None),
        ("P570", "CASE WHEN c_custkey % 3 <> 0 THEN concat('+', 1850 + c_custkey % 230, '-05-02T00:00:00Z') END", None),
        ("P21", f"CASE c_mktsegment WHEN 'BUILDING' THEN '{_ENTITY}Q6581072' WHEN 'FURNITURE' THEN NULL "
                f"ELSE '{_ENTITY}Q6581097' END", None),
        ("label", "CASE WHEN c_custkey % 11 <> 0 THEN c_name END", "en"),
        ("label", "concat('Kunde ', c_custkey)", "de"),
        ("P27", f"concat('{_ENTITY}QN', c_nationkey)", None),
        ("P27", f"CASE WHEN c_custkey % 4 = 0 THEN concat('{_ENTITY}QN', (c_nationkey + 6) % 25) END", None),
        ("P19", f"concat('{_ENTITY}QS', 100000 + c_custkey % 120)", None),
        ("P19", f"CASE WHEN c_custkey % 6 = 0 THEN concat('{_ENTITY}QS', 100000 + c_custkey % 50) END", None),
        ("P20", f"CASE WHEN c_custkey % 3 <> 0 THEN concat('{_ENTITY}QS', 100000 + c_custkey % 70) END", None),
        ("P106", f"CASE WHEN c_custkey % 8 <> 0 THEN concat('{_ENTITY}QO', c_custkey % 9) END", None),
        ("P106", f"CASE WHEN c_custkey % 8 <> 0 THEN concat('{_ENTITY}QO', c_custkey % 4) END", None),
        ("P101", f"CASE WHEN c_custkey % 5 = 0 THEN concat('{_ENTITY}QF', c_custkey % 7) END", None),
        ("P1196", f"CASE WHEN c_custkey % 3 = 1 THEN '{_ENTITY}Q3739104' END", None),
        ("P18", "concat('image ', c_custkey, '.png')", None),
        ("http://wikiba.se/ontology#sitelinks", "CASE WHEN c_custkey % 19 <> 0 THEN concat(c_custkey % 40) END", None),
    ]),
    "supplier": ("concat('%sQS', 100000 + s_suppkey)" % _ENTITY, [
        ("P625", "CASE WHEN s_suppkey % 4 <> 0 THEN concat('Point(', s_suppkey % 90, '.5 -', s_suppkey % 45, '.25)') END", None),
        ("P17", f"CASE WHEN s_suppkey % 9 <> 0 THEN concat('{_ENTITY}QN', s_nationkey) END", None),
        ("label", "s_name", "en"),
    ]),
    "nation": ("concat('%sQN', n_nationkey)" % _ENTITY, [
        ("P297", f"CASE WHEN n_nationkey % 5 <> 4 THEN {_CODE.format('n_nationkey')} END", None),
        ("label", "n_name", "en"),
    ]),
    "customer ": ("concat('https://en.wikipedia.org/wiki/Customer%23', c_custkey, '_a/b')", [
        ("http://schema.org/about", f"concat('{_ENTITY}QC', c_custkey)", None),
        ("http://schema.org/isPartOf", "CASE WHEN c_custkey % 13 = 0 THEN 'https://de.wikipedia.org/' "
                                       "ELSE 'https://en.wikipedia.org/' END", None),
    ]),
}


def triples_sql() -> str:
    """Statements as rows, for the checking database: a plain union."""
    selects = []
    for table, (subject, rows) in _STATEMENTS.items():
        selects += [f"SELECT {subject} AS s, {_quoted(p)} AS p, {o} AS o, {_quoted(lang)} AS lang FROM {{{table.strip()}}} "
                    f"WHERE {o} IS NOT NULL" for p, o, lang in rows]
    return "\nUNION ALL\n".join(selects)


def _quoted(text: str | None) -> str:
    return "CAST(NULL AS STRING)" if text is None else f"'{text}'"


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


def in_spark(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    """A derived relation over the Parquet files of a folder."""
    for table in TABLES:
        sql = sql.replace("{" + table + "}", f"parquet.`{folder.rstrip('/')}/{table}.parquet`")
    return spark.sql(sql)


def in_check(sql: str) -> str:
    """The same relation for the checking database, as a parenthesised subquery."""
    for table in TABLES:
        sql = sql.replace("{" + table + "}", table)
    return f"({sql.strip()})"


def check(sql: str) -> str:
    """Checking SQL with ``[NAME]`` replaced by the derived relation of that name."""
    names = {
        "PERSONS": PERSONS, "CODES": CODES, "LABELS": LABELS, "TRENDS": TRENDS, "VIEW_LINES": VIEW_LINES,
        "ARTICLES": ARTICLES, "PLACES": PLACES, "VIEWS": VIEWS, "POLYGONS": POLYGONS,
        "ENTITY_PARTS": ENTITY_PARTS, "NATION_NAMES": NATION_NAMES, "TRIPLES": triples_sql(),
    }
    for name, text in names.items():
        sql = sql.replace(f"[{name}]", in_check(text))
    return sql


def persons(spark: SparkSession, folder: str) -> DataFrame:
    df = in_spark(spark, folder, PERSONS)
    return df.select(
        "qid", "gender_qid", "year_born", "pob_country_code", "pob_qid", "pod_qid", "manner_of_death_qid",
        tx.split_list(F.col("occupations")).alias("occupation_qids"),
        tx.split_list(F.col("fields")).alias("field_qids"))


def polygons(spark: SparkSession, folder: str) -> DataFrame:
    """Squares as closed rings, some with a square hole of side 4 in the middle."""
    df = in_spark(spark, folder, POLYGONS)

    def square(x0, x1, y0, y1):
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
        return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners])

    x0, x1, y0, y1 = (F.col(c) for c in ("x0", "x1", "y0", "y1"))
    outer, inner = square(x0, x1, y0, y1), square(x0 + 8, x1 - 8, y0 + 8, y1 - 8)
    rings = F.when(F.col("hole"), F.array(outer, inner)).otherwise(F.array(outer))
    return df.select("poly_id", "iso_a3", "name", "continent", rings.alias("rings"))


def triples(spark: SparkSession, folder: str) -> DataFrame:
    """Statements as rows: one pass per table with ``stack``.

    A row becomes up to 18 statements, so a table of few file splits is spread over all cores before.
    """
    def statements(table, subject, rows):
        cells = ", ".join(", ".join([_quoted(p), o, _quoted(lang)]) for p, o, lang in rows)
        source = spread(in_spark(spark, folder, f"SELECT * FROM {{{table.strip()}}}"))
        return source.selectExpr(f"{subject} AS s", f"stack({len(rows)}, {cells}) AS (p, o, lang)").where("o IS NOT NULL")

    return reduce(DataFrame.unionAll, [statements(table, *of) for table, of in _STATEMENTS.items()])


_DUMPS: dict[tuple[str, str], str] = {}


def entity_dump(spark: SparkSession, folder: str) -> str:
    """Path of the derived entity dump, written once per session and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _DUMPS:
        path = f"{scratch_dir(spark)}/entity-dump"
        in_spark(spark, folder, ENTITY_LINES).write.text(path)
        _DUMPS[key] = path
    return _DUMPS[key]
