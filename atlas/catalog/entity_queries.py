"""Entity dump: values, ranks, names, property documents and questions about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas.catalog import inputs
from atlas.catalog.registry import query
from atlas.functions import predicates as pr
from atlas.operators import property_values as pv
from atlas.plans import entities as en
from atlas.session import scratch_dir, stage
from atlas.sources import dumps, tables


def _entities(spark, folder):
    return dumps.read_entities(spark, inputs.entity_dump(spark, folder))


_NAMES = """
SELECT qid AS id, coalesce(wikipedia_id, title) AS name FROM [ENTITY_PARTS] e
WHERE coalesce(wikipedia_id, title) IS NOT NULL
UNION ALL
SELECT concat('Q', n_nationkey), coalesce(article, label) FROM [NATION_NAMES] n WHERE label IS NOT NULL
UNION ALL
SELECT concat('P', r_regionkey), CASE WHEN r_regionkey = 3 THEN 'AFRICA' ELSE r_name END FROM region
"""

_LINKED = """
SELECT wikipedia_id, title, qid AS wikidata_id, description FROM [ENTITY_PARTS] e
WHERE wikipedia_id IS NOT NULL AND title IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY wikipedia_id ORDER BY p_partkey) = 1
UNION ALL
SELECT article, label, concat('Q', n_nationkey), NULL FROM [NATION_NAMES] n WHERE article IS NOT NULL
"""


@query(f"""
SELECT qid AS id, 6 AS n_claims FROM [ENTITY_PARTS] e
UNION ALL SELECT concat('Q', n_nationkey), 0 FROM nation
UNION ALL SELECT concat('P', r_regionkey), 0 FROM region
""")
def entity_lines(spark, folder):
    """A JSON array written one entity per line in text files, read back."""
    return _entities(spark, folder).select("id", F.size("claims").alias("n_claims"))


@query(_NAMES)
def entity_names(spark, folder):
    return en.entity_names(_entities(spark, folder))


@query(_LINKED)
def linked_entities(spark, folder):
    return en.linked_entities(_entities(spark, folder))


_VALUES = """
SELECT qid, 'P0' AS prop_id, 0 AS pos, 'normal' AS rank, concat('Q', n1) AS item, NULL AS text, NULL AS num FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P0', 1, rank2, concat('Q', n2), NULL, NULL FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P0', 2, 'normal', concat('Q', n3), NULL, NULL FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P1', 0, rank_amount1, NULL, NULL, nullif(CAST(amount1 AS DOUBLE), 0) FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P1', 1, 'normal', NULL, NULL, nullif(CAST(amount2 AS DOUBLE), 0) FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P2', 0, 'normal', NULL, concat(year, '-01-01T00:00:00'), NULL FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P3', 0, 'normal', NULL, nullif(brand, ''), NULL FROM [ENTITY_PARTS] e
UNION ALL SELECT qid, 'P9', 0, 'normal', NULL, 'lost', NULL FROM [ENTITY_PARTS] e
"""

_HAS_LINK = "qid IN (SELECT qid FROM [ENTITY_PARTS] e WHERE wikipedia_id IS NOT NULL AND title IS NOT NULL)"

_PLACED_PARTS = """
SELECT qid, p_partkey, lat, lng, CASE WHEN globe = 'Q3' THEN 'Q3' END AS globe_named, globe, nullif(altitude, 0) AS altitude
FROM [ENTITY_PARTS] e WHERE NOT (lat = 0 AND lng = 0)
"""


@query(f"""
SELECT qid, prop_id, pos, CASE rank WHEN 'preferred' THEN 1 ELSE 2 END AS rank, item, text, num,
       CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng, NULL AS globe, CAST(NULL AS DOUBLE) AS altitude
FROM ({_VALUES}) v
WHERE rank <> 'deprecated' AND (item IS NOT NULL OR text IS NOT NULL OR num IS NOT NULL) AND {_HAS_LINK}
UNION ALL
SELECT qid, 'P4', 0, 2, NULL, NULL, NULL, lat, lng, nullif(globe, 'Q2'), altitude
FROM ({_PLACED_PARTS}) p WHERE {_HAS_LINK}
""")
def claim_values(spark, folder):
    return en.entity_claims(_entities(spark, folder)).drop("prop_pos", "kind")


_RESOLVED = f"""
SELECT v.qid, v.prop_id, v.pos, CASE v.rank WHEN 'preferred' THEN 1 ELSE 2 END AS rank,
       CASE WHEN v.item IS NULL THEN v.text ELSE n.name END AS text, v.num, v.item IS NOT NULL AS is_item
FROM (SELECT * FROM ({_VALUES}) x WHERE rank <> 'deprecated' AND {_HAS_LINK}) v
LEFT JOIN ({_NAMES}) n ON n.id = v.item
WHERE n.name IS NOT NULL OR (v.item IS NULL AND (v.text IS NOT NULL OR v.num IS NOT NULL))
"""


@query(f"""
SELECT text AS name, count(*) AS n FROM ({_RESOLVED}) r WHERE is_item GROUP BY 1
""")
def resolved_ids(spark, folder):
    found = stage(_entities(spark, folder), "entities")
    resolved = en.resolve_ids(en.entity_claims(found), en.entity_names(found))
    return resolved.where("item IS NOT NULL").groupBy(F.col("text").alias("name")).agg(F.count("*").alias("n"))


_COLLAPSED = f"""
SELECT qid, prop_id,
       CASE WHEN bool_or(is_item) THEN string_agg(text, '|' ORDER BY text)
            ELSE arg_max(coalesce(text, ''), pos) END AS vals,
       CASE WHEN bool_or(is_item) THEN count(*) ELSE count(text) FILTER (WHERE text IS NOT NULL) END AS n_vals,
       CASE WHEN bool_or(num IS NOT NULL) THEN arg_max(num, pos) END AS num
FROM (SELECT *, min(rank) OVER (PARTITION BY qid, prop_id) AS best FROM ({_RESOLVED}) r) b
WHERE rank = best GROUP BY qid, prop_id
"""


@query(f"""
SELECT qid, prop_id, vals, num, CAST(NULL AS DOUBLE) AS lat FROM ({_COLLAPSED}) c
UNION ALL
SELECT qid, 'P4', '', NULL, lat FROM ({_PLACED_PARTS}) p WHERE {_HAS_LINK}
""")
def best_rank_values(spark, folder):
    found = stage(_entities(spark, folder), "entities")
    resolved = en.resolve_ids(en.entity_claims(found), en.entity_names(found))
    return en.best_rank(resolved).select("qid", "prop_id", F.array_join("vals", "|").alias("vals"), "num", "lat")


_LONG = f"""
SELECT c.qid, l.wikipedia_id, n.name AS prop_name, c.vals, c.num,
       CAST(NULL AS DOUBLE) AS lat, CAST(NULL AS DOUBLE) AS lng, NULL AS globe, CAST(NULL AS DOUBLE) AS altitude, c.n_vals
FROM ({_COLLAPSED}) c JOIN ({_LINKED}) l ON l.wikidata_id = c.qid JOIN ({_NAMES}) n ON n.id = c.prop_id
WHERE NOT (c.prop_id = 'P0' AND c.qid IN (SELECT qid FROM [ENTITY_PARTS] e WHERE brand <> ''))
UNION ALL
SELECT p.qid, l.wikipedia_id, 'MIDDLE EAST', '', NULL, p.lat, p.lng, p.globe_named, p.altitude, 0
FROM ({_PLACED_PARTS}) p JOIN ({_LINKED}) l ON l.wikidata_id = p.qid
"""


@query(f"""
SELECT qid, wikipedia_id, prop_name, vals, num, lat, lng, globe, altitude
FROM ({_LONG.replace('p.globe_named', "CASE WHEN p.globe_named IS NOT NULL AND 'Q3' IN (SELECT id FROM (" + _NAMES + ") q) THEN 'Q3' END")}) t
""")
def entity_properties(spark, folder):
    long = en.entity_properties(stage(_entities(spark, folder), "entities"))
    return long.withColumn("vals", F.array_join("vals", "|")).drop("kind")


def _repeating_dump(spark, folder):
    """The dump with a third of its lines once more as they are, and once more without their article."""
    lines = spark.read.text(inputs.entity_dump(spark, folder))
    again = lines.where(F.crc32(F.col("value").cast("binary")) % 3 == 0)
    bare = again.select(F.regexp_replace("value", r'"sitelinks":\{"enwiki":\{[^}]*\}\}', '"sitelinks":{}').alias("value"))
    path = f"{scratch_dir(spark)}/repeating-dump"
    lines.unionByName(again).unionByName(bare).write.text(path)
    return path


@query(f"""
SELECT qid, wikipedia_id, prop_name, vals, num, lat, lng, globe, altitude
FROM ({_LONG.replace('p.globe_named', "CASE WHEN p.globe_named IS NOT NULL AND 'Q3' IN (SELECT id FROM (" + _NAMES + ") q) THEN 'Q3' END")}) t
""")
def entity_properties_of_repeats(spark, folder):
    """Properties from a dump in which ids repeat."""
    entities = stage(dumps.read_entities(spark, _repeating_dump(spark, folder)), "entities")
    return en.entity_properties(entities).withColumn("vals", F.array_join("vals", "|")).drop("kind")


def _stored(spark, folder):
    """The entity table and the property table beside it."""
    root = scratch_dir(spark)
    table = en.import_entities(spark, inputs.entity_dump(spark, folder), f"{root}/entities", f"{root}/values")
    return table, spark.read.parquet(f"{root}/values")


def _table(spark, folder):
    """The entity table, imported from the dump."""
    return en.import_entities(spark, inputs.entity_dump(spark, folder), f"{scratch_dir(spark)}/entities")


@query(f"""
SELECT l.wikipedia_id, l.title, l.wikidata_id, l.description, f.population, f.europe, f.many, coalesce(f.n, 0) AS n
FROM ({_LINKED}) l LEFT JOIN (
  SELECT qid, max(num) FILTER (WHERE prop_name = 'AMERICA') AS population,
         max(vals) FILTER (WHERE prop_name = 'ASIA') AS europe,
         bool_or(n_vals > 1) AS many, count(*) AS n FROM ({_LONG}) g GROUP BY qid) f ON f.qid = l.wikidata_id
""")
def entity_import(spark, folder):
    table = _table(spark, folder)
    props = F.col("properties")
    return table.select(
        "wikipedia_id", "title", "wikidata_id", "description",
        pr.property_text(props, "AMERICA").cast("double").alias("population"),
        pr.property_text(props, "ASIA").alias("europe"),
        F.when(F.size(F.json_object_keys(F.to_json(props))) > 0,
               F.try_variant_get(props, "$.AFRICA", "array<string>").isNotNull()).alias("many"),
        F.size(F.json_object_keys(F.to_json(props))).cast("long").alias("n"))


@query(f"SELECT wikipedia_id, title, wikidata_id, description FROM ({_LINKED}) l WHERE wikipedia_id = 'Part 31'")
def entity_lookup(spark, folder):
    return en.entity_lookup(en.linked_entities(_entities(spark, folder)), "Part 31")


@query(f"""
SELECT l.title, g.num AS "AMERICA" FROM ({_LINKED}) l
JOIN ({_LONG}) f ON f.qid = l.wikidata_id AND f.prop_name = 'AFRICA' AND f.n_vals = 1 AND f.vals = 'Country 12'
LEFT JOIN ({_LONG}) g ON g.qid = l.wikidata_id AND g.prop_name = 'AMERICA'
""")
def entities_with_scalar_property(spark, folder):
    found = en.entities_with_properties(_table(spark, folder), {"AFRICA": "Country 12"}, "AMERICA")
    return found.withColumn("AMERICA", F.col("AMERICA").cast("double"))


@query(f"""
SELECT l.title FROM ({_LINKED}) l JOIN ({_LONG}) f ON f.qid = l.wikidata_id AND f.prop_name = 'AFRICA'
WHERE f.n_vals > 1 AND list_contains(string_split(f.vals, '|'), 'NATION_7')
""")
def entities_with_listed_property(spark, folder):
    return en.entities_with_properties(_table(spark, folder), {"AFRICA": ["NATION_7"]})


@query(f"""
SELECT l.title, g.num AS "AMERICA" FROM ({_LINKED}) l
JOIN ({_LONG}) f ON f.qid = l.wikidata_id AND f.prop_name = 'AFRICA' AND f.n_vals = 1 AND f.vals = 'Country 12'
LEFT JOIN ({_LONG}) g ON g.qid = l.wikidata_id AND g.prop_name = 'AMERICA'
""")
def entities_holding_scalar(spark, folder):
    found = en.entities_holding(*_stored(spark, folder), {"AFRICA": "Country 12"}, "AMERICA")
    return found.withColumn("AMERICA", F.col("AMERICA").cast("double"))


@query(f"""
SELECT l.title FROM ({_LINKED}) l JOIN ({_LONG}) f ON f.qid = l.wikidata_id AND f.prop_name = 'AFRICA'
JOIN ({_LONG}) g ON g.qid = l.wikidata_id AND g.prop_name = 'AMERICA' AND g.num = 50
WHERE f.n_vals > 1 AND list_contains(string_split(f.vals, '|'), 'Country 0') AND list_contains(string_split(f.vals, '|'), 'NATION_7')
""")
def entities_holding_list_and_number(spark, folder):
    return en.entities_holding(*_stored(spark, folder), {"AFRICA": ["NATION_7", "Country 0"], "AMERICA": 50})


@query(f"""
SELECT l.title FROM ({_LINKED}) l JOIN ({_PLACED_PARTS}) p ON p.qid = l.wikidata_id WHERE p.lat = 3 AND p.altitude = 14
""")
def entities_holding_object(spark, folder):
    return en.entities_holding(*_stored(spark, folder), {"MIDDLE EAST": {"lat": 3, "altitude": 14.0}})


@query("""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' AND o_custkey % 4 = 1 AND o_orderkey % 3 = 0
""")
def orders_holding_flags(spark, folder):
    """Documents with a truth value, a list and an object, asked by their values."""
    status, key = F.col("o_orderstatus"), F.col("o_orderkey")
    document = F.parse_json(F.to_json(F.struct(
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.array(F.concat(F.lit("status "), status), F.concat(F.lit("third "), key % 3)).alias("marks"),
        F.struct((F.col("o_custkey") % 4).alias("rest"), F.lit(False).alias("closed")).alias("customer"))))
    documents = tables.load_table(spark, folder, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey").select(
        "o_orderkey", document.alias("properties"))
    return pv.holding(pv.values_of_documents(documents, "o_orderkey", "properties"), "o_orderkey", {
        "urgent": True, "marks": ["third 0", "status O"], "customer": {"closed": False, "rest": 1}})


_PART_VIEWS = """
SELECT concat('Part ', l_partkey) AS title, CAST(sum(floor(l_quantity)) AS BIGINT) AS viewcount
FROM {lineitem} GROUP BY 1
"""


@query(f"""
SELECT v.title, v.viewcount, g.num AS "AMERICA"
FROM ({inputs.in_check(_PART_VIEWS)}) v JOIN ({_LINKED}) l ON l.wikipedia_id = v.title
LEFT JOIN ({_LONG}) g ON g.qid = l.wikidata_id AND g.prop_name = 'AMERICA'
WHERE l.description = 'SMALL'
ORDER BY v.viewcount DESC, v.title LIMIT 100
""")
def most_viewed_with_property(spark, folder):
    """Three-way join: tagged pages, their views, and one property of their entity."""
    views = inputs.in_spark(spark, folder, _PART_VIEWS)
    table = _table(spark, folder)
    pages = table.select(F.col("wikipedia_id").alias("title"), F.array("description").alias("general"))
    found = en.top_by_views_with_property(pages, views, table, "AMERICA", general=["SMALL"])
    return found.withColumn("AMERICA", F.col("AMERICA").cast("double"))
