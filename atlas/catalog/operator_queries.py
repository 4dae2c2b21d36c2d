"""Single operators and column functions on the benchmark tables themselves."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas import fixed_values as fv
from atlas.catalog import inputs
from atlas.catalog.registry import query
from atlas.functions import claims as cl, markup as mk, predicates as pr, text as tx
from atlas.operators import dedupe, joins, stats
from atlas.sources import tables
from atlas.sources.tables import load_table


# --- one row per key ---------------------------------------------------------------

@query("""
SELECT user_id, event_id, event_type FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1
""")
def first_event_per_user(spark, folder):
    events = load_table(spark, folder, "events", "user_id", "event_id", "event_type", "ts")
    return dedupe.keep_first(events, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("""
SELECT user_id, event_type, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1
""")
def last_event_per_user_and_type(spark, folder):
    events = load_table(spark, folder, "events", "user_id", "event_id", "event_type", "ts")
    return dedupe.keep_last(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("SELECT l_partkey, arg_max(l_suppkey, l_orderkey * 8 + l_linenumber) AS l_suppkey FROM lineitem GROUP BY 1")
def last_supplier_of_part(spark, folder):
    items = load_table(spark, folder, "lineitem", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    ordered = items.withColumn("ord", F.struct("l_orderkey", "l_linenumber", "l_suppkey"))
    return dedupe.last_wins_map(ordered, "l_partkey", "l_suppkey", "ord")


@query("""
SELECT o_custkey, spend, row_number() OVER (ORDER BY spend DESC, o_custkey) - 1 AS rank
FROM (SELECT o_custkey, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))) * 100) AS BIGINT) AS spend
      FROM orders GROUP BY 1) t
ORDER BY spend DESC, o_custkey LIMIT 100
""")
def ranked_customers(spark, folder):
    spend = load_table(spark, folder, "orders", "o_custkey", "o_totalprice").groupBy("o_custkey").agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")) * 100).cast("long").alias("spend"))
    return dedupe.rank_top(spend, 100, "spend", "o_custkey")


_COLLIDING = """
SELECT CASE WHEN o_orderkey % 3 = 0 THEN concat('Name ', o_custkey, ', Somewhere')
            WHEN o_orderkey % 3 = 1 THEN concat('name ', o_custkey) ELSE concat('Name ', o_custkey) END AS raw,
       concat('name ', o_custkey) AS name, o_orderkey AS rank
FROM orders
"""


def _colliding(spark, folder):
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    raw = F.when(key % 3 == 0, F.concat(F.lit("Name "), customer, F.lit(", Somewhere"))).when(
        key % 3 == 1, F.concat(F.lit("name "), customer)).otherwise(F.concat(F.lit("Name "), customer))
    orders = load_table(spark, folder, "orders", "o_orderkey", "o_custkey").select(raw.alias("raw"), key.alias("rank"))
    return orders.select("raw", tx.place_key(F.col("raw")).alias("name"), "rank")


@query(f"SELECT raw, name, rank FROM ({_COLLIDING}) c QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank) = 1")
def first_of_colliding_names(spark, folder):
    return dedupe.resolve_collisions(_colliding(spark, folder), "raw", "name", "rank")


@query(f"""
SELECT raw, name, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank) AS nth FROM ({_COLLIDING}) c) t
WHERE raw <> name OR nth = 1 QUALIFY row_number() OVER (PARTITION BY name ORDER BY rank DESC) = 1
""")
def last_of_colliding_names(spark, folder):
    return dedupe.resolve_collisions(_colliding(spark, folder), "raw", "name", "rank", keep="last")


# --- joins -------------------------------------------------------------------------

@query("""
SELECT s_nationkey, count(*) AS n, count(s_suppkey) AS resolved FROM (
  SELECT CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber < 4 THEN 1 ELSE l_suppkey END AS k FROM lineitem) l
LEFT JOIN supplier ON s_suppkey = k GROUP BY 1
""")
def hot_key_lookup(spark, folder):
    """A join where one supplier owns a third of the line items, and a seventh has none."""
    line = F.col("l_linenumber")
    items = load_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey").withColumn(
        "k", F.when(line == 1, None).when(line < 4, 1).otherwise(F.col("l_suppkey")))
    suppliers = load_table(spark, folder, "supplier", "s_suppkey", "s_nationkey").withColumn("k", F.col("s_suppkey"))
    joined = joins.lookup(items, suppliers, "k", ["l_orderkey", "l_linenumber"], min_rows=1000, salted=True)
    return joined.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count("s_suppkey").alias("resolved"))


@query("""
SELECT o_custkey AS part, count(*) AS n FROM orders
WHERE o_custkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) GROUP BY 1
""")
def pending_parts(spark, folder):
    needed = load_table(spark, folder, "orders", "o_custkey").withColumnRenamed("o_custkey", "part")
    done = load_table(spark, folder, "lineitem", "l_partkey", "l_quantity").where("l_quantity > 45").select(
        F.col("l_partkey").alias("part"))
    return joins.pending(needed, done, "part").groupBy("part").agg(F.count("*").alias("n"))


@query("""
SELECT c_custkey, coalesce(alpha3, '') AS code FROM customer
LEFT JOIN [CODES] c ON c.alpha2 = concat('N', substr('ABCDEFGHIJKLMNOPQRSTUVWXY', c_nationkey + 1, 1))
""")
def country_code_or_blank(spark, folder):
    letter = F.substring(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXY"), F.col("c_nationkey") + 1, F.lit(1))
    customers = load_table(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        "c_custkey", F.concat(F.lit("N"), letter).alias("code"))
    codes = inputs.in_spark(spark, folder, inputs.CODES)
    return joins.translate(customers, codes, "code", "alpha2", "alpha3", default="")


@query("""
SELECT field, count(*) AS n FROM (
  SELECT CASE job_a WHEN 'philosophers' THEN 'science' WHEN 'poets' THEN 'art' WHEN 'chemists' THEN 'science'
              WHEN 'boxers' THEN 'sport' END AS field FROM [ARTICLES] a) t
WHERE field IS NOT NULL GROUP BY 1
UNION ALL
SELECT concat('infobox ', CASE kind WHEN 'philosopher' THEN 'science' ELSE 'art' END), count(*)
FROM [ARTICLES] a GROUP BY 1
""")
def fields_by_dimension(spark, folder):
    """Fields of work looked up in the two mapping dimensions."""
    articles = inputs.in_spark(spark, folder, inputs.ARTICLES).select("job_a", "kind")
    by_word = joins.translate(articles, tables.dim_field(spark), "job_a", "word", "field")
    by_box = joins.translate(articles, tables.dim_infobox(spark), "kind", "infobox", "field")
    words = by_word.groupBy(F.col("job_a").alias("field")).agg(F.count("*").alias("n"))
    boxes = by_box.groupBy(F.concat(F.lit("infobox "), "kind").alias("field")).agg(F.count("*").alias("n"))
    return words.unionByName(boxes)


# --- statistics ----------------------------------------------------------------------

@query("""
SELECT CAST(year(o_orderdate) AS INT) AS x, o_orderstatus AS series, count(*) AS y,
       round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY CAST(year(o_orderdate) AS INT)), 6) AS share
FROM orders GROUP BY 1, 2
""")
def order_status_composition(spark, folder):
    counts = load_table(spark, folder, "orders", "o_orderdate", "o_orderstatus").groupBy(
        F.year("o_orderdate").alias("x"), F.col("o_orderstatus").alias("series")).agg(F.count("*").alias("y"))
    return stats.composition(counts, "x", "y").withColumn("share", F.round("share", 6))


@query("""
SELECT event_type, concat('{"event_type":"', event_type, '","day":[', string_agg(d, ',' ORDER BY d), '],"n":[',
       string_agg(n, ',' ORDER BY d), ']}') AS payload
FROM (SELECT event_type, dayofyear(ts) AS d, count(*) AS n FROM events GROUP BY 1, 2) t GROUP BY 1
""")
def event_series(spark, folder):
    from atlas.sinks.tables import chart_payload
    counts = load_table(spark, folder, "events", "event_type", "ts").groupBy(
        "event_type", F.dayofyear("ts").alias("day")).agg(F.count("*").alias("n"))
    return chart_payload(counts, "event_type", "day", "n")


@query("""
SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word
  FROM lineitem JOIN part ON p_partkey = l_partkey) t GROUP BY 1
""")
def part_word_counts(spark, folder):
    items = load_table(spark, folder, "lineitem", "l_partkey")
    parts = load_table(spark, folder, "part", "p_partkey", "p_name")
    named = items.join(parts, items["l_partkey"] == parts["p_partkey"])
    return stats.list_counts(named.select(F.split("p_name", " ").alias("words")), "words", "word").select("word", "n")


@query("""
SELECT o_custkey, coalesce((SELECT k FROM (SELECT k, sum(w) AS votes, min(p) AS pos FROM (VALUES
    (o_orderpriority, 2, 1), (o_orderstatus, 1, 2), (CASE WHEN o_orderkey % 4 = 0 THEN o_orderstatus END, 1, 3)) v(k, w, p)
    WHERE k IS NOT NULL GROUP BY k) g ORDER BY votes DESC, pos LIMIT 1), '') AS winner, o_orderkey
FROM orders
""")
def order_votes(spark, folder):
    def vote(key, weight):
        return F.struct(key.alias("key"), F.lit(weight).alias("weight"))

    status = F.col("o_orderstatus")
    votes = F.filter(F.array(
        vote(F.col("o_orderpriority"), 2), vote(status, 1), vote(F.when(F.col("o_orderkey") % 4 == 0, status), 1)),
        lambda v: v["key"].isNotNull())
    orders = load_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return orders.select("o_orderkey", "o_custkey", stats.winner(votes).alias("winner"))


@query("""
SELECT count(*) AS records, count(*) FILTER (WHERE event_type = 'error') AS skipped,
       CAST(sum(floor(value)) AS BIGINT) AS total FROM events
""")
def load_counters(spark, folder):
    """Counters gathered while the events are read, without a job of their own."""
    events = load_table(spark, folder, "events", "event_type", "value")
    watched, counters = stats.observed(events, "load", {
        "records": F.count("*"), "skipped": F.count_if(F.col("event_type") == "error"),
        "total": F.sum(F.floor("value"))})
    watched.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([counters.get], "records LONG, skipped LONG, total LONG")


@query("""
SELECT o_orderpriority, round(avg(age), 6) AS age, count(age) AS n FROM (
  SELECT o_orderpriority, nullif(date_diff('day', o_orderdate, l_shipdate), 30) AS age
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey) t
WHERE age IS NOT NULL GROUP BY 1
""")
def order_age_by_priority(spark, folder):
    orders = load_table(spark, folder, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    items = load_table(spark, folder, "lineitem", "l_orderkey", "l_shipdate")
    age = F.nullif(F.date_diff("l_shipdate", "o_orderdate"), F.lit(30))
    aged = stats.drop_any_null(items.join(orders, items["l_orderkey"] == orders["o_orderkey"]).select(
        "o_orderpriority", age.alias("age")))
    means = stats.group_means(aged, "o_orderpriority", ["age"])
    counts = stats.group_value_counts(aged, "o_orderpriority", ["age"]).withColumnRenamed("age", "n")
    return means.join(counts, "o_orderpriority").withColumn("age", F.round("age", 6))


# --- predicates over arrays and documents ----------------------------------------------

@query("""
SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events
WHERE CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) = 7
""")
def events_with_property(spark, folder):
    events = load_table(spark, folder, "events", "event_id", "props").withColumn("doc", F.parse_json("props"))
    return events.where(pr.property_contains(F.col("doc"), {"k": 7})).select(
        "event_id", pr.property_text(F.col("doc"), "k").cast("int").alias("k"))


_TAGGED = "SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS tags FROM part"


def _tagged_parts(spark, folder):
    return load_table(spark, folder, "part", "p_partkey", "p_name", "p_type").select(
        "p_partkey", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("tags"))


@query(f"SELECT p_partkey FROM ({_TAGGED}) t WHERE list_contains(tags, 'red') AND list_contains(tags, 'small')")
def parts_with_all_tags(spark, folder):
    return _tagged_parts(spark, folder).where(pr.array_contains_all(F.col("tags"), ["red", "small"])).select("p_partkey")


@query(f"SELECT p_partkey FROM ({_TAGGED}) t WHERE list_contains(tags, 'bolt') OR list_contains(tags, 'gear')")
def parts_with_any_tag(spark, folder):
    return _tagged_parts(spark, folder).where(pr.array_overlaps(F.col("tags"), ["bolt", "gear"])).select("p_partkey")


# --- text --------------------------------------------------------------------------

@query("""
SELECT page_id, string_split(url, '/')[-1] AS tail, lower(string_split(url, '?')[1]) AS address FROM pages
""")
def url_tails(spark, folder):
    pages = load_table(spark, folder, "pages", "page_id", "url")
    return pages.select(
        "page_id", tx.uri_tail(F.col("url")).alias("tail"),
        F.lower(F.substring_index("url", "?", 1)).alias("address"))


@query("""
SELECT c_custkey, 'Customer' AS first_name, CASE WHEN c_custkey % 5 = 0 THEN -1 ELSE CAST(c_custkey AS INT) END AS number,
       lower(c_mktsegment) AS last_word, concat('customer no ', c_custkey) AS place,
       CASE WHEN c_custkey % 2 = 0 THEN 'Shops' END AS general,
       CASE WHEN c_custkey % 3 = 0 THEN -CAST(1000 + c_custkey * 7 AS INT) ELSE CAST(1000 + c_custkey * 7 AS INT) END AS year
FROM customer
""")
def name_parts(spark, folder):
    key = F.col("c_custkey")
    customers = load_table(spark, folder, "customer", "c_custkey", "c_name", "c_mktsegment")
    plain = F.concat(F.lit("Customer no "), key)
    return customers.select(
        "c_custkey", tx.first_name(plain).alias("first_name"),
        tx.digits_to_int(F.when(key % 5 == 0, "none").otherwise(F.col("c_name"))).alias("number"),
        tx.last_word(F.concat(F.lit("People of "), "c_mktsegment")).alias("last_word"),
        tx.place_key(F.concat(plain, F.lit(", Somewhere"))).alias("place"),
        tx.generalise(F.when(key % 2 == 0, F.concat(F.lit("Shops in "), "c_mktsegment")).otherwise("Shops")).alias("general"),
        tx.iso_year(F.concat(
            F.when(key % 3 == 0, "-").otherwise("+"), F.lit(1000) + key * 7, F.lit("-01-01T00:00:00Z"))).alias("year"))


@query("""
SELECT l_returnflag, l_linestatus, array_to_string(list_sort(list_distinct(list(lower(l_returnflag || ' ' || l_linestatus)))), '|') AS tags
FROM lineitem GROUP BY 1, 2
""")
def tidied_tags(spark, folder):
    """Tags trimmed, lowered, made distinct; empty and over-long ones dropped."""
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    tag = F.concat(flag, F.lit(" "), status)
    raw = F.array(F.concat(F.lit(" \t"), tag, F.lit("  ")), F.lower(tag), F.lit(None).cast("string"), F.lit(""),
                  F.repeat(tag, F.lit(100)))
    items = load_table(spark, folder, "lineitem", "l_returnflag", "l_linestatus")
    return items.select("l_returnflag", "l_linestatus", F.array_join(tx.normalise_tags(raw), "|").alias("tags")).distinct()


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-01T00:00:00') AS day,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS DOUBLE) END AS amount
FROM orders
""")
def times_and_quantities(spark, folder):
    """Claim values of two kinds: times without a day, and quantities, zero or not."""
    orders = load_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate")
    raw = F.concat(F.lit('{"time":"+'), F.date_format("o_orderdate", "yyyy-MM"), F.lit('-00T00:00:00Z"}'))
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    quantity = F.concat(F.lit('{"amount":"+'), amount, F.lit('"}'))
    number = cl.claim_value(F.lit("quantity"), quantity)["num"]
    return orders.select(
        "o_orderkey", cl.claim_value(F.lit("time"), raw)["text"].alias("day"),
        F.when(amount == 0, 0.0).otherwise(number).alias("amount"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(nullif(o_custkey, 0) AS DOUBLE) END AS amount FROM orders
""")
def quantities_without_zero(spark, folder):
    """Quantities as the operator gives them: a zero is none."""
    amount = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey"))
    number = cl.claim_value(F.lit("quantity"), F.concat(F.lit('{"amount":"+'), amount, F.lit('"}')))["num"]
    return load_table(spark, folder, "orders", "o_orderkey", "o_custkey").select("o_orderkey", number.alias("amount"))


@query("""
SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (c_custkey % 80 + (c_custkey % 60) / 60.0), 6) AS lat,
       round(c_nationkey + 30 / 60.0 + 36 / 3600.0, 6) AS lng
FROM customer
""")
def parsed_coordinates(spark, folder):
    """Degrees, minutes and seconds with directions, folded to degrees."""
    key = F.col("c_custkey")
    values = F.array(
        (key % 80).cast("string"), (key % 60).cast("string"), F.when(key % 2 == 0, "N").otherwise("S"),
        F.col("c_nationkey").cast("string"), F.lit("30"), F.lit("36"), F.lit("E"))
    at = mk.parse_coordinates(values)
    customers = load_table(spark, folder, "customer", "c_custkey", "c_nationkey")
    return customers.select("c_custkey", F.round(at.lat, 6).alias("lat"), F.round(at.lng, 6).alias("lng"))


@query(f"""
SELECT lang, source, CAST(sum(len(regexp_extract_all(lower(text), '{tx.WORD}'))) AS BIGINT) AS words,
       CAST(sum(len(list_filter(regexp_extract_all(lower(text), '{tx.WORD}'), lambda x: x = 'he'))) AS BIGINT) AS he
FROM documents GROUP BY 1, 2
""")
def words_by_source(spark, folder):
    words = load_table(spark, folder, "documents", "lang", "source", "text").select(
        "lang", "source", tx.words(F.col("text")).alias("w"))
    counts = tx.word_counts(F.col("w"), fv.GENDER_WEIGHTS)
    return words.groupBy("lang", "source").agg(
        F.sum(F.size("w")).alias("words"), F.sum(counts["he"]).alias("he"))
