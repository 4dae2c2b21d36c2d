"""Triples to persons, query-result documents, labels, upserts and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas.catalog import inputs
from atlas.catalog.registry import query
from atlas.functions import text as tx
from atlas.operators.joins import in_key_set
from atlas.plans import imports, persons as ps
from atlas.session import scratch_dir, stage
from atlas.sinks import tables as sinks, versions
from atlas.sources import tables

_E = "http://www.wikidata.org/entity/"

_TIDY = """
SELECT string_split(s, '/')[-1] AS s, regexp_extract(p, '([^/#]+)$', 1) AS p, o, string_split(o, '/')[-1] AS tail, lang
FROM [TRIPLES] t
"""


def _triples(spark, folder):
    return tables.tidy_triples(inputs.triples(spark, folder))


_PERSON_SQL = f"""
WITH t AS MATERIALIZED ({_TIDY}),
codes AS (SELECT s AS country, min(o) AS code FROM t WHERE p = 'P297' GROUP BY 1),
born AS (SELECT s, max(TRY_CAST(substr(o, 2, 4) AS INT)) AS year_born FROM t
         WHERE p = 'P569' AND TRY_CAST(substr(o, 2, 4) AS INT) BETWEEN 1800 AND 2000 GROUP BY 1),
art AS (SELECT a.tail AS s, 'Customer#' || split_part(split_part(min(a.s2), '%23', 2), '_a', 1) || ' a/b' AS title
        FROM (SELECT *, article AS s2 FROM (
          SELECT o, string_split(o, '/')[-1] AS tail, s AS article FROM [TRIPLES] x WHERE p = 'http://schema.org/about'
            AND s IN (SELECT s FROM [TRIPLES] y WHERE o = 'https://en.wikipedia.org/')) z) a GROUP BY 1),
facts AS (SELECT s, min(tail) FILTER (WHERE p = 'P21') AS gender_qid,
            min(TRY_CAST(substr(o, 2, 4) AS INT)) FILTER (WHERE p = 'P570') AS year_died,
            min(o) FILTER (WHERE p = 'label' AND lang = 'en') AS name,
            min(tail) FILTER (WHERE p = 'P19') AS pob_qid, min(tail) FILTER (WHERE p = 'P20') AS pod_qid,
            string_agg(DISTINCT tail, '|' ORDER BY tail) FILTER (WHERE p = 'P106') AS occupation_qids,
            string_agg(DISTINCT tail, '|' ORDER BY tail) FILTER (WHERE p = 'P101') AS field_qids,
            min(tail) FILTER (WHERE p = 'P1196') AS manner_of_death_qid,
            min(o) FILTER (WHERE p = 'P18') AS image_filename,
            TRY_CAST(min(o) FILTER (WHERE p = 'sitelinks') AS INT) AS sitelink_count,
            bool_or(p = 'P31' AND tail = 'Q5') AS human
          FROM t GROUP BY 1),
cit AS (SELECT t.s, string_agg(DISTINCT code, '|' ORDER BY code) AS citizenship_country_codes
        FROM t JOIN codes ON t.p = 'P27' AND codes.country = t.tail GROUP BY 1),
place AS (SELECT t.s AS place,
            CAST(regexp_extract(min(o) FILTER (WHERE p = 'P625'), 'Point\\(([-0-9.]+) ([-0-9.]+)\\)', 2) AS VARCHAR) AS lat,
            CAST(regexp_extract(min(o) FILTER (WHERE p = 'P625'), 'Point\\(([-0-9.]+) ([-0-9.]+)\\)', 1) AS VARCHAR) AS lon,
            min(code) AS country_code
          FROM t LEFT JOIN codes ON t.p = 'P17' AND codes.country = t.tail GROUP BY 1),
ps AS (SELECT f.s AS qid, a.title AS enwiki_title, f.name, f.gender_qid, b.year_born, f.year_died,
         c.citizenship_country_codes,
         f.pob_qid, TRY_CAST(p1.lat AS DOUBLE) AS pob_lat, TRY_CAST(p1.lon AS DOUBLE) AS pob_lon,
         p1.country_code AS pob_country_code,
         f.pod_qid, TRY_CAST(p2.lat AS DOUBLE) AS pod_lat, TRY_CAST(p2.lon AS DOUBLE) AS pod_lon,
         p2.country_code AS pod_country_code,
         f.occupation_qids, f.field_qids, f.manner_of_death_qid, f.image_filename, f.sitelink_count
       FROM facts f JOIN born b ON b.s = f.s JOIN art a ON a.s = f.s LEFT JOIN cit c ON c.s = f.s
       LEFT JOIN place p1 ON p1.place = f.pob_qid LEFT JOIN place p2 ON p2.place = f.pod_qid
       WHERE f.human AND f.sitelink_count IS NOT NULL)
"""


@query(f"{_PERSON_SQL} SELECT * FROM ps")
def person_import(spark, folder):
    return ps.flat_persons(ps.persons(_triples(spark, folder)))


_IDS = """
SELECT DISTINCT unnest([gender_qid, manner_of_death_qid, pob_qid, pod_qid]
       || coalesce(string_split(occupations, '|'), []) || coalesce(string_split(fields, '|'), [])) AS qid
FROM [PERSONS] p
"""


@query(f"SELECT qid FROM ({_IDS}) i WHERE qid IS NOT NULL")
def referenced_ids(spark, folder):
    return ps.referenced_ids(inputs.persons(spark, folder))


@query(f"SELECT qid FROM ({_IDS}) i WHERE qid IS NOT NULL AND qid NOT IN (SELECT qid FROM [LABELS] l)")
def missing_labels(spark, folder):
    return ps.missing_labels(inputs.persons(spark, folder), inputs.in_spark(spark, folder, inputs.LABELS))


@query(f"""
WITH t AS MATERIALIZED ({_TIDY})
SELECT s AS qid, min(o) AS label FROM t
WHERE p = 'label' AND lang = 'en' AND s IN (
  SELECT tail FROM t WHERE p IN ('P19', 'P20', 'P27')) AND s NOT LIKE 'QN1%'
GROUP BY 1
UNION ALL
SELECT concat('QN', n_nationkey), 'old label' FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%'
""")
def label_import(spark, folder):
    """Labels fetched for ids that have none yet, upserted into the label table."""
    triples = _triples(spark, folder)
    have = tables.load_table(spark, folder, "nation", "n_nationkey").select(
        F.concat(F.lit("QN"), "n_nationkey").alias("qid"), F.lit("old label").alias("label")
    ).where("qid LIKE 'QN1%'")
    needed = triples.where(F.col("p").isin("P19", "P20", "P27")).select(
        tx.uri_tail(F.col("o")).alias("qid")).distinct()
    fetched = ps.fetch_labels(triples, ps.pending(needed, have, "qid"))
    return sinks.upsert_labels(have, fetched, "label", f"{scratch_dir(spark)}/labels")


@query(f"""
{_PERSON_SQL},
needed AS (SELECT unnest([gender_qid, manner_of_death_qid, pob_qid, pod_qid]
             || coalesce(string_split(occupation_qids, '|'), []) || coalesce(string_split(field_qids, '|'), [])) AS qid FROM ps)
SELECT s AS qid, min(o) AS label FROM t
WHERE p = 'label' AND lang = 'en' AND s IN (SELECT qid FROM needed) AND s NOT LIKE 'QN1%'
GROUP BY 1
UNION ALL
SELECT concat('QN', n_nationkey), 'old label' FROM nation WHERE CAST(n_nationkey AS VARCHAR) LIKE '1%'
""")
def person_label_import(spark, folder):
    """Labels of all ids that imported persons refer to and that have none yet, upserted into the label table."""
    triples, root = _triples(spark, folder), scratch_dir(spark)
    versions.commit(spark, root, labels=tables.load_table(spark, folder, "nation", "n_nationkey").select(
        F.concat(F.lit("QN"), "n_nationkey").alias("qid"), F.lit("old label").alias("label")).where("qid LIKE 'QN1%'"))
    people = stage(ps.persons(triples), "persons")
    imports.import_labels(spark, triples, people, root)
    return imports.import_labels(spark, triples, people, root)  # once more, which changes nothing


_RESUMED = f"""
{_PERSON_SQL},
years AS (SELECT s, y, max(y) FILTER (WHERE y BETWEEN 1880 AND 1899) OVER own AS forced,
            max(y) FILTER (WHERE y BETWEEN 1900 AND 1950) OVER own AS added, max(y) FILTER (WHERE y BETWEEN 1800 AND 1879) OVER own AS first
          FROM (SELECT s, TRY_CAST(substr(o, 2, 4) AS INT) AS y FROM t WHERE p = 'P569') b WINDOW own AS (PARTITION BY s))
"""


def _resumed(spark, folder):
    """Persons and ledger after three imports: from an old dump, of years still missing, and of some years again.

    The old dump has neither labels nor dates of death.
    """
    root, triples = scratch_dir(spark), stage(_triples(spark, folder), "triples")
    imports.store_statements(triples.where("p NOT IN ('label', 'P570')"), f"{root}/old")
    imports.store_statements(triples, f"{root}/new")
    imports.import_persons(spark, f"{root}/old", f"{root}/store", 1800, 1899)
    imports.import_persons(spark, f"{root}/new", f"{root}/store", 1850, 1950)
    return imports.import_persons(spark, f"{root}/new", f"{root}/store", 1880, 1899, force=True)


@query(f"""
{_RESUMED}
SELECT ps.* REPLACE (coalesce(forced, added, first) AS year_born,
         CASE WHEN coalesce(forced, added) IS NOT NULL THEN name END AS name,
         CASE WHEN coalesce(forced, added) IS NOT NULL THEN year_died END AS year_died)
FROM ps JOIN (SELECT DISTINCT s, forced, added, first FROM years) b ON b.s = ps.qid WHERE coalesce(forced, added, first) IS NOT NULL
""")
def person_import_resumed(spark, folder):
    return ps.flat_persons(_resumed(spark, folder)["persons"])


@query(f"""
{_RESUMED}
SELECT CAST(b.y AS VARCHAR) AS bucket, count(DISTINCT ps.qid) AS row_count
FROM range(1800, 1951) b(y) LEFT JOIN years ON years.y = b.y LEFT JOIN ps ON ps.qid = years.s GROUP BY 1
""")
def person_import_ledger(spark, folder):
    return _resumed(spark, folder)["ledger"].select("bucket", "row_count")


@query(f"""
WITH t AS MATERIALIZED ({_TIDY})
SELECT s AS qid, min(o) AS label FROM t WHERE p = 'label' AND lang = 'en' GROUP BY 1
""")
def english_labels(spark, folder):
    return tables.read_labels(_triples(spark, folder))


@query(f"""
WITH t AS MATERIALIZED ({_TIDY}) SELECT DISTINCT s FROM t WHERE p = 'P31' AND tail = 'Q5'
""")
def humans(spark, folder):
    return ps.humans(_triples(spark, folder))


@query(f"""
WITH t AS MATERIALIZED ({_TIDY}), codes AS (SELECT s AS country, min(o) AS code FROM t WHERE p = 'P297' GROUP BY 1)
SELECT t.s, string_agg(DISTINCT code, '|' ORDER BY code) AS citizenship_country_codes
FROM t JOIN codes ON t.p = 'P27' AND codes.country = t.tail GROUP BY 1
""")
def citizenships(spark, folder):
    found = ps.citizenships(_triples(spark, folder))
    return found.select("s", F.array_join("citizenship_country_codes", "|").alias("citizenship_country_codes"))


@query("""
SELECT string_split(t.s, '/')[-1] AS s FROM [TRIPLES] t
WHERE p = 'P569' AND TRY_CAST(substr(o, 2, 4) AS INT) BETWEEN 1900 AND 1910 AND substr(o, 7, 2) = '04'
""")
def born_in_april(spark, folder):
    """Birth statements of some years and one month."""
    o = F.col("o")
    return _triples(spark, folder).where(
        (F.col("p") == "P569") & tx.iso_year(o).between(1900, 1910) & (tx.iso_month(o) == 4)).select("s")


# --- query-result documents -----------------------------------------------------

_BINDINGS = """
SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM {customer}
"""


@query(f"""
SELECT concat('Q', c_custkey) AS qid, concat('Customer ', c_custkey, ' 100% x') AS enwiki_title,
       CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
       'Q6581097' AS gender_qid, CASE WHEN c_custkey % 2 = 0 THEN -44 ELSE 1900 END AS year_born,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 2000 END AS year_died,
       'AA|BB' AS citizenship_country_codes, concat('Q7', c_nationkey) AS pob_qid,
       CAST(c_nationkey AS DOUBLE) + 0.5 AS pob_lat, -CAST(c_nationkey AS DOUBLE) - 0.25 AS pob_lon,
       CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Q1|Q2' END AS occupation_qids,
       CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE CAST(c_custkey AS INT) END AS sitelink_count
FROM customer
""")
def decoded_bindings(spark, folder):
    """Query results as JSON documents, one per customer, decoded to typed persons."""
    key = F.col("c_custkey")

    def var(value):
        return F.struct(value.cast("string").alias("value"))

    def unless(test, value):
        return F.when(~test, var(value))

    nation = F.col("c_nationkey")
    binding = F.struct(
        var(F.concat(F.lit(_E + "Q"), key)).alias("person"),
        var(F.concat(F.lit("https://en.wikipedia.org/wiki/Customer_"), key, F.lit("_100%_x"))).alias("article"),
        unless(key % 3 == 0, F.col("c_name")).alias("personLabel"),
        var(F.lit(_E + "Q6581097")).alias("gender"),
        var(F.when(key % 2 == 0, "-0044-03-15T00:00:00Z").otherwise("1900-01-01T00:00:00Z")).alias("dob"),
        var(F.when(key % 5 == 0, "unknown").otherwise("2000-01-01T00:00:00Z")).alias("dod"),
        var(F.lit("AA|BB")).alias("citCodes"),
        var(F.concat(F.lit(_E + "Q7"), nation)).alias("pob"),
        var(F.concat(F.lit("POINT(-"), nation, F.lit(".25 "), nation, F.lit(".5)"))).alias("pobCoords"),
        unless(key % 4 == 0, F.lit(f"{_E}Q1||{_E}Q2|")).alias("occupations"),
        unless(key % 7 == 0, key).alias("sitelinks"))
    document = F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results")))
    customers = tables.load_table(spark, folder, "customer", "c_custkey", "c_name", "c_nationkey")
    decoded = ps.flat_persons(tables.decode_bindings(customers.select(document.alias("value"))))
    return decoded.select(
        "qid", "enwiki_title", "name", "gender_qid", "year_born", "year_died", "citizenship_country_codes",
        "pob_qid", "pob_lat", "pob_lon", "occupation_qids", "sitelink_count")


@query("""
SELECT CASE WHEN l = '' THEN NULL ELSE l END AS tails, count(*) AS n FROM (
  SELECT concat_ws('|', CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, o_orderstatus) AS l
  FROM orders WHERE o_orderkey IS NOT NULL) t GROUP BY 1
""")
def mapped_lists(spark, folder):
    """Pipe-joined addresses, some parts empty, each cut to its tail."""
    listed = F.concat(
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit(_E), "o_orderpriority")),
        F.lit("||" + _E), "o_orderstatus", F.lit("|"))
    orders = tables.load_table(spark, folder, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")
    return orders.groupBy(tx.map_pipe_list(listed).alias("tails")).agg(F.count("*").alias("n"))


# --- upserts and progress --------------------------------------------------------

@query("""
SELECT concat('Q', c_custkey) AS qid,
       CASE WHEN u.custkey IS NULL THEN c_name ELSE u.name END AS name,
       CASE WHEN u.custkey IS NULL THEN 1900 ELSE CAST(u.year AS INT) END AS year_born
FROM customer LEFT JOIN (
  SELECT o_custkey AS custkey, arg_max(concat('order ', o_orderkey), o_orderkey) AS name,
         arg_max(year(o_orderdate), o_orderkey) AS year FROM orders GROUP BY 1) u ON u.custkey = c_custkey
""")
def person_upsert(spark, folder):
    """Persons replaced by the last of several updates of the same id."""
    current = tables.load_table(spark, folder, "customer", "c_custkey", "c_name").select(
        F.concat(F.lit("Q"), "c_custkey").alias("qid"), F.col("c_name").alias("name"),
        F.lit(1900).alias("year_born"))
    updates = tables.load_table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderdate").select(
        F.concat(F.lit("Q"), "o_custkey").alias("qid"), F.concat(F.lit("order "), "o_orderkey").alias("name"),
        F.year("o_orderdate").alias("year_born"), "o_orderkey")
    return sinks.upsert_persons(current, updates, "o_orderkey", f"{scratch_dir(spark)}/persons")


@query("""
SELECT bucket, row_count FROM (
  SELECT CAST(year_born AS VARCHAR) AS bucket, count(*) AS row_count FROM [PERSONS] p
  WHERE year_born >= 1900 GROUP BY 1) t
UNION ALL
SELECT CAST(r_regionkey AS VARCHAR), -1 FROM region
""")
def progress_ledger(spark, folder):
    """Row counts per birth year recorded over a ledger of older buckets."""
    ledger = tables.load_table(spark, folder, "region", "r_regionkey").select(
        F.col("r_regionkey").cast("string").alias("bucket"),
        F.lit("2020-01-01").cast("timestamp").alias("imported_at"), F.lit(-1).cast("long").alias("row_count"))
    rows = inputs.persons(spark, folder).where("year_born >= 1900")
    done = sinks.record_progress(ledger, rows, F.col("year_born"), f"{scratch_dir(spark)}/ledger")
    return done.select("bucket", "row_count")


@query("""
SELECT CAST(year_born AS VARCHAR) AS bucket, count(*) AS row_count FROM [PERSONS] p GROUP BY 1
UNION ALL
SELECT CAST(1600 + 400 * r_regionkey AS VARCHAR), -1 FROM region
WHERE 1600 + 400 * r_regionkey NOT IN (SELECT year_born FROM [PERSONS] p)
""")
def progress_replaced(spark, folder):
    """Row counts of all birth years over a ledger that holds some of them already."""
    ledger = tables.load_table(spark, folder, "region", "r_regionkey").select(
        (1600 + 400 * F.col("r_regionkey")).cast("string").alias("bucket"),
        F.lit("2020-01-01").cast("timestamp").alias("imported_at"), F.lit(-1).cast("long").alias("row_count"))
    done = sinks.record_progress(ledger, inputs.persons(spark, folder), F.col("year_born"), f"{scratch_dir(spark)}/ledger")
    return done.select("bucket", "row_count")


@query("""
SELECT CAST(y AS INT) AS year, CAST(y AS VARCHAR) AS bucket FROM range(1400, 2101) r(y)
WHERE y NOT IN (SELECT year_born FROM [PERSONS] p)
""")
def pending_years(spark, folder):
    """Years that the imported persons leave open."""
    done = sinks.progress(inputs.persons(spark, folder), F.col("year_born"))
    return ps.pending_years(tables.year_buckets(spark, 1400, 2100), done)


@query("""
SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (
  SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')
""")
def customers_with_urgent_orders(spark, folder):
    urgent = tables.load_table(spark, folder, "orders", "o_custkey", "o_orderpriority").where(
        "o_orderpriority = '1-URGENT'")
    return in_key_set(tables.load_table(spark, folder, "customer", "c_custkey", "c_name"),
                      "c_custkey", urgent, "o_custkey")
