"""Entity dump to property tables, and questions about entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from atlas import fixed_values as fv
from atlas.functions import claims as cl, predicates as pr
from atlas.operators import property_values as pv
from atlas.operators.dedupe import keep_first, keep_last, top
from atlas.operators.joins import in_key_set, lookup
from atlas.session import stage
from atlas.sinks.tables import write_entities, write_property_values
from atlas.sources.dumps import read_entities

_FACT = ("prop_name", "kind", "vals", "num", "lat", "lng", "globe", "altitude")


def entity_names(entities: DataFrame) -> DataFrame:
    """``id, name``: English article title, else English label; unnamed entities are left out."""
    name = F.coalesce(F.nullif("wikipedia_id", F.lit("")), "title")
    return (
        entities.select("id", name.alias("name")).where("name IS NOT NULL")
        .groupBy("id").agg(F.max("name").alias("name"))
    )


def unique_records(entities: DataFrame, keep=stage) -> DataFrame:
    """One record per id; records without an id are left out.

    Of several the linked ones come first, then those with an article and a label, then by content, so
    that the choice does not depend on the order of the dump.  Repeated ids are found in a narrow pass;
    only their records are sorted, and all others stay where they are.
    """
    known = entities.where("id IS NOT NULL")
    repeated = keep(known.groupBy("id").count().where("count > 1").select("id"), "repeated")
    if repeated.isEmpty():
        return known
    order = [~pr.linked_entity(F.col("wikipedia_id"), F.col("title")), F.col("wikipedia_id").isNull(), "wikipedia_id",
             F.col("title").isNull(), "title", F.col("description").isNull(), "description", F.to_json("claims")]
    several = keep_first(known.join(repeated, "id", "left_semi"), ["id"], order)
    return known.join(repeated, "id", "left_anti").unionByName(several)


def linked_entities(entities: DataFrame) -> DataFrame:
    """Entities with an English article and label, one per article (lowest id)."""
    flat = entities.where(pr.linked_entity(F.col("wikipedia_id"), F.col("title"))).select(
        "wikipedia_id", "title", F.col("id").alias("wikidata_id"), "description")
    return keep_first(flat, ["wikipedia_id"], [F.length("wikidata_id"), "wikidata_id"])


def entity_claims(entities: DataFrame) -> DataFrame:
    """One row per claim that has a value and counts (preferred or normal rank)."""
    properties = entities.where(pr.linked_entity(F.col("wikipedia_id"), F.col("title"))).select(
        F.col("id").alias("qid"), F.posexplode("claims").alias("prop_pos", "prop_id", "_claims"))
    claims = properties.select("qid", "prop_pos", "prop_id", F.posexplode("_claims").alias("pos", "_c"))
    data = F.col("_c.mainsnak.datavalue")
    rank = F.when(F.col("_c.rank") == "preferred", 1).when(F.col("_c.rank") == "normal", 2)
    valued = claims.select(
        "qid", "prop_pos", "prop_id", "pos", rank.alias("rank"),
        data["type"].alias("kind"), cl.claim_value(data["type"], data["value"]).alias("v"))
    return valued.where(F.col("rank").isNotNull() & cl.has_value(F.col("v"))).select(
        "qid", "prop_pos", "prop_id", "pos", "rank", "kind", "v.*")


def resolve_ids(claims: DataFrame, names: DataFrame, keep=stage) -> DataFrame:
    """Replace entity values by their names; values that have none vanish.

    A few ids (a country, a gender) are the value of most claims, and most claims
    have no globe, hence the lookups that spread hot and missing keys.  Globes
    keep their id, if it is known.
    """
    items = claims.where("item IS NOT NULL").drop("text")
    known = names.select(F.col("id").alias("item"), F.col("name").alias("text"))
    named = lookup(items, known, "item", ["qid", "prop_pos", "pos"], "inner")
    globes = keep(in_key_set(names.select(F.col("id").alias("globe")), "globe", claims.where(
        "globe IS NOT NULL"), "globe").withColumn("_known", F.lit(True)), "globes")
    plain = lookup(claims.where("item IS NULL"), globes, "globe", ["qid", "prop_pos", "pos"]).withColumn(
        "globe", F.when(F.col("_known"), F.col("globe"))).drop("_known")
    return plain.unionByName(named)


def best_rank(claims: DataFrame, *also: str) -> DataFrame:
    """One row per entity and property (and ``also``): the values of the best rank that has any.

    All entity values are kept, sorted; of any other kind only the last claim.
    The rows grouped here all stem from one record of the dump.
    """
    claim = F.struct("rank", "pos", "kind", "text", "num", "lat", "lng", "globe", "altitude")
    grouped = claims.groupBy("qid", "prop_id", "prop_pos", *also).agg(
        F.array_sort(F.collect_list(claim)).alias("_all"))
    best = grouped.withColumn("_best", F.filter("_all", lambda c: c["rank"] == F.col("_all")[0]["rank"]))
    restart = F.array_max(F.transform("_best", lambda c: F.when(
        c["kind"] != "wikibase-entityid", c["pos"]).otherwise(F.lit(-1))))
    kept = best.withColumn("_from", restart).withColumn(
        "_kept", F.filter("_best", lambda c: c["pos"] >= F.col("_from")))
    first = F.col("_kept")[0]
    return kept.select(
        "qid", "prop_id", "prop_pos", *also, first["kind"].alias("kind"),
        F.array_sort(F.filter(F.transform("_kept", lambda c: c["text"]), lambda t: t.isNotNull())).alias("vals"),
        *[first[c].alias(c) for c in ("num", "lat", "lng", "globe", "altitude")])


def property_names(claims: DataFrame, names: DataFrame) -> DataFrame:
    """``prop_id, prop_name`` of the properties that occur in the claims."""
    used = in_key_set(names.where("name != ''"), "id", claims, "prop_id")
    return used.select(F.col("id").alias("prop_id"), F.col("name").alias("prop_name"))


def entity_properties(entities: DataFrame, keep=stage) -> DataFrame:
    """The long property table of staged entities, one record per id or not.

    Names and claims are written once, slim, instead of reading the dump twice or holding every name in
    memory.  Claims get the names of their properties first and are then brought together by entity
    once: best rank, properties that share a name (the later one stays) and the article all work on
    that one exchange, and so does what a caller groups by ``qid``.
    """
    entities = unique_records(entities, keep)
    names = keep(entity_names(entities), "names")
    claims = keep(entity_claims(entities), "claims")
    linked = linked_entities(entities).select(F.col("wikidata_id").alias("qid"), "wikipedia_id")
    props = keep(property_names(claims, names), "props")
    named = lookup(claims, props, "prop_id", ["qid", "prop_pos", "pos"], "inner")
    together = resolve_ids(named, names, keep).repartition("qid")
    found = keep_last(best_rank(together, "prop_name"), ["qid", "prop_name"], ["prop_pos"])
    return found.join(linked, "qid").select("qid", "wikipedia_id", *_FACT)


def property_json(facts: Column) -> Column:
    """Properties of one entity (an array of ``_FACT`` structs) as the text of a JSON document.

    A single value is a scalar, several are a list, a coordinate is an object.
    """
    number = lambda value: F.to_json(F.array(value))
    bare = lambda text: F.substring(text, F.lit(2), F.length(text) - 2)

    def pair(fact):
        texts = F.transform(fact["vals"], cl.json_string)
        parts = F.array_compact(F.array(
            F.concat(F.lit('"lat":'), F.coalesce(bare(number(fact["lat"])), F.lit("null"))),
            F.concat(F.lit('"lng":'), F.coalesce(bare(number(fact["lng"])), F.lit("null"))),
            F.when(fact["globe"].isNotNull(), F.concat(F.lit('"globe":'), cl.json_string(fact["globe"]))),
            F.when(fact["altitude"].isNotNull(), F.concat(F.lit('"altitude":'), bare(number(fact["altitude"]))))))
        value = (
            F.when(fact["kind"] == "globecoordinate", F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}")))
            .when(fact["num"].isNotNull(), bare(number(fact["num"])))
            .when(F.size(texts) == 1, F.get(texts, F.lit(0)))
            .otherwise(F.concat(F.lit("["), F.array_join(texts, ","), F.lit("]")))
        )
        return F.concat(cl.json_string(fact["prop_name"]), F.lit(":"), value)

    return F.concat(F.lit("{"), F.array_join(F.array_sort(F.transform(facts, pair)), ","), F.lit("}"))


def gathered(long: DataFrame) -> DataFrame:
    """``qid, wikipedia_id, facts``: the properties of one record of the dump in a row."""
    return long.groupBy("qid").agg(F.max("wikipedia_id").alias("wikipedia_id"), F.collect_list(F.struct(*_FACT)).alias("facts"))


def entity_table(linked: DataFrame, long: DataFrame) -> DataFrame:
    """``wikipedia_id, title, wikidata_id, description, properties`` with a variant document."""
    return with_documents(linked, gathered(long))


def with_documents(linked: DataFrame, facts: DataFrame) -> DataFrame:
    documents = facts.select(F.col("qid").alias("wikidata_id"), property_json(F.col("facts")).alias("properties"))
    return linked.join(documents, "wikidata_id", "left").select(
        "wikipedia_id", "title", "wikidata_id", "description",
        F.parse_json(F.coalesce("properties", F.lit("{}"))).alias("properties"))


def import_entities(spark: SparkSession, dump: str, path: str, values: str | None = None) -> DataFrame:
    """An entity dump into the entity table; the dump is read and parsed once.

    ``values`` names a place for the property table, one row per value, that ``entities_holding`` asks.
    """
    entities = unique_records(stage(read_entities(spark, dump), "entities"))
    facts = stage(gathered(entity_properties(entities)), "facts")
    if values:
        long = facts.select("qid", F.explode("facts").alias("fact")).select("qid", "fact.*")
        write_property_values(pv.property_values(long), values)
    return write_entities(with_documents(linked_entities(entities), facts), path)


def entities_holding(entities: DataFrame, values: DataFrame, wanted: dict, *texts: str) -> DataFrame:
    """What ``entities_with_properties`` finds, with the filter on the property table instead of every document.

    Documents are opened only for the entities found.
    """
    found = pv.holding(values, "qid", wanted).select(F.col("qid").alias("wikidata_id")) if wanted else entities.select("wikidata_id")
    return entities.join(found, "wikidata_id", "left_semi").select(
        "title", *[pr.property_text(F.col("properties"), key).alias(key) for key in texts])


def entity_lookup(entities: DataFrame, wikipedia_id: str) -> DataFrame:
    return entities.where(F.col("wikipedia_id") == wikipedia_id)


def entities_with_properties(entities: DataFrame, wanted: dict, *texts: str) -> DataFrame:
    """Titles of entities whose document contains ``wanted``, with some properties as text."""
    return entities.where(pr.property_contains(F.col("properties"), wanted)).select(
        "title", *[pr.property_text(F.col("properties"), key).alias(key) for key in texts])


def top_by_views_with_property(pages: DataFrame, views: DataFrame, entities: DataFrame, key: str,
                               n: int = fv.TOP_BY_VIEWS, general=()) -> DataFrame:
    """The most viewed pages with a tag, and one property of their entity.

    Capitals with their population, for instance: ``general=["capitals"]``.
    """
    tagged = pages.where(pr.array_contains_all(F.col("general"), general)).select("title")
    facts = entities.select(
        F.col("wikipedia_id").alias("title"), pr.property_text(F.col("properties"), key).alias(key))
    return top(tagged.join(views, "title").join(facts, "title"), n, "viewcount", "title")
