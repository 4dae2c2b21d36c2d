"""Charts, occupations and life spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from atlas.catalog import inputs
from atlas.catalog.registry import query
from atlas.functions import predicates as pr
from atlas.operators import stats
from atlas.plans import charts, lifespans
from atlas.session import scratch_dir
from atlas.sources import tables


def _codes(spark, folder):
    return inputs.in_spark(spark, folder, inputs.CODES)


def _labels(spark, folder):
    return inputs.in_spark(spark, folder, inputs.LABELS)


def _trends(spark, folder):
    return inputs.in_spark(spark, folder, inputs.TRENDS)


def _rounded(df, *columns, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns])


@query("""
SELECT c.alpha3 AS location, round(t.female / t.people, 4) AS share, t.people
FROM (SELECT pob_country_code, count(*) FILTER (WHERE gender_qid = 'Q6581072') AS female, count(*) AS people
      FROM [PERSONS] p
      WHERE pob_country_code IS NOT NULL AND year_born BETWEEN 1500 AND 2010
        AND gender_qid IN ('Q6581097', 'Q6581072')
      GROUP BY 1 HAVING count(*) >= 50) t JOIN [CODES] c ON c.alpha2 = t.pob_country_code
""")
def gender_by_country(spark, folder):
    return charts.gender_by_country(inputs.persons(spark, folder), _codes(spark, folder))


@query("""
SELECT c.alpha3 AS location, round(log10(t.people), 3) AS score, t.people
FROM (SELECT pob_country_code, count(*) AS people FROM [PERSONS] p
      WHERE pob_country_code IS NOT NULL AND year_born BETWEEN 1500 AND 2010 GROUP BY 1) t
JOIN [CODES] c ON c.alpha2 = t.pob_country_code
""")
def density_by_country(spark, folder):
    return charts.density_by_country(inputs.persons(spark, folder), _codes(spark, folder))


_GENDER_SERIES = """
SELECT year_born AS x, series, sum(CASE WHEN series = cls THEN 1 ELSE 0 END) AS y
FROM (SELECT year_born, CASE gender_qid WHEN 'Q6581097' THEN 'male' WHEN 'Q6581072' THEN 'female'
             ELSE 'other' END AS cls
      FROM [PERSONS] p WHERE gender_qid IS NOT NULL AND year_born BETWEEN 1500 AND 2010) g
CROSS JOIN (VALUES ('male'), ('female'), ('other')) s(series)
GROUP BY 1, 2
"""


@query(f"""
SELECT series, x, CAST(y AS BIGINT) AS y, round(100.0 * y / sum(y) OVER (PARTITION BY x), 6) AS share
FROM ({_GENDER_SERIES}) t
""")
def gender_over_time(spark, folder):
    return _rounded(charts.gender_over_time(inputs.persons(spark, folder)), "share")


_TOP_JOBS = """
SELECT qid, n, row_number() OVER (ORDER BY n DESC, qid) - 1 AS rank
FROM (SELECT qid, count(*) AS n FROM (SELECT unnest(string_split(occupations, '|')) AS qid FROM [PERSONS] p) o
      GROUP BY 1) c
ORDER BY n DESC, qid LIMIT 10
"""


@query(_TOP_JOBS)
def top_occupations(spark, folder):
    return charts.top_occupations(inputs.persons(spark, folder))


@query(f"""
WITH jobs AS (SELECT t.qid, coalesce(l.label, t.qid) AS series FROM ({_TOP_JOBS}) t
              LEFT JOIN [LABELS] l ON l.qid = t.qid),
     slots AS (SELECT year_born AS x, unnest(string_split(occupations, '|')) AS qid FROM [PERSONS] p
               WHERE occupations IS NOT NULL AND year_born BETWEEN 1500 AND 2010),
     grid AS (SELECT y.x, j.qid, j.series FROM (SELECT DISTINCT x FROM slots) y CROSS JOIN jobs j),
     counted AS (SELECT g.series, g.x, count(s.qid) AS y FROM grid g
                 LEFT JOIN slots s ON s.x = g.x AND s.qid = g.qid GROUP BY 1, 2)
SELECT series, x, y, round(100.0 * y / nullif(sum(y) OVER (PARTITION BY x), 0), 6) AS share FROM counted
""")
def top_occupations_over_time(spark, folder):
    chart = charts.top_occupations_over_time(inputs.persons(spark, folder), _labels(spark, folder))
    return _rounded(chart, "share")


@query(f"""
SELECT series, concat('{{"series":"', series, '","x":[', string_agg(x, ',' ORDER BY x), '],"y":[',
       string_agg(CAST(y AS BIGINT), ',' ORDER BY x), ']}}') AS payload
FROM ({_GENDER_SERIES}) t GROUP BY series
""")
def chart_payload(spark, folder):
    from atlas.sinks.tables import chart_payload as payload
    return payload(charts.gender_over_time(inputs.persons(spark, folder)), "series", "x", "y")


_SPANS = "(SELECT *, year_died - year_born AS life_span FROM [TRENDS] t)"


@query(f"""
SELECT occupation, round(avg(life_span), 6) AS life_span FROM {_SPANS} s
WHERE life_span IS NOT NULL AND occupation IS NOT NULL AND country_code IS NOT NULL GROUP BY 1
""")
def life_expectancy_by_occupation(spark, folder):
    return _rounded(lifespans.life_expectancy_by_occupation(_trends(spark, folder)), "life_span")


@query(f"""
WITH jobs AS (SELECT occupation FROM (SELECT occupation, count(life_span) AS people FROM {_SPANS} s
                                      WHERE occupation IS NOT NULL GROUP BY 1) c
              ORDER BY people DESC, occupation LIMIT 100),
     means AS (SELECT occupation, avg(life_span) AS life_span FROM {_SPANS} s
               WHERE life_span IS NOT NULL AND country_code IS NOT NULL AND year_born < 1924 GROUP BY 1)
SELECT j.occupation, round(m.life_span, 6) AS life_span FROM jobs j LEFT JOIN means m ON m.occupation = j.occupation
""")
def life_expectancy_of_top_jobs(spark, folder):
    return _rounded(lifespans.life_expectancy_of_top_jobs(_trends(spark, folder)), "life_span")


@query(f"""
SELECT round(avg(life_span), 6) AS life_span,
       round(avg(year_born) FILTER (WHERE occupation = 'rappers'), 6) AS born_rappers,
       round(avg(year_born) FILTER (WHERE occupation = 'billionaires'), 6) AS born_billionaires
FROM {_SPANS} s
""")
def life_span_summary(spark, folder):
    return _rounded(lifespans.life_span_summary(_trends(spark, folder)),
                    "life_span", "born_rappers", "born_billionaires")


@query(f"""
SELECT year_born, round(avg(view_count), 6) AS view_count, round(avg(word_count), 6) AS word_count,
       round(avg(year_died), 6) AS year_died, round(avg(life_span), 6) AS life_span
FROM {_SPANS} s GROUP BY 1
""")
def life_span_by_birth_year(spark, folder):
    return _rounded(lifespans.life_span_by_birth_year(_trends(spark, folder)),
                    "view_count", "word_count", "year_died", "life_span")


@query("""
SELECT occupation, count(year_died) AS year_died, count(country_code) AS country_code, count(field) AS field
FROM [TRENDS] t WHERE occupation IS NOT NULL GROUP BY 1
""")
def value_counts_by_occupation(spark, folder):
    return stats.group_value_counts(_trends(spark, folder), "occupation", ["year_died", "country_code", "field"])


@query(f"""
SELECT occupation, round(avg(life_span), 6) AS life_span FROM {_SPANS} s
WHERE life_span IS NOT NULL AND country_code IS NOT NULL
  AND occupation IN ('rappers', 'billionaires', 'job 4') GROUP BY 1
""")
def life_expectancy_of_chosen_jobs(spark, folder):
    means = lifespans.life_expectancy_by_occupation(_trends(spark, folder))
    return _rounded(lifespans.of_occupations(means, ["rappers", "billionaires", "job 4"]), "life_span")


@query(f"""
SELECT occupation, count(*) AS people FROM {_SPANS} s WHERE occupation IS NOT NULL AND life_span IS NOT NULL
GROUP BY 1 ORDER BY people DESC, occupation LIMIT 60
""")
def occupations_with_most_life_spans(spark, folder):
    return lifespans.top_jobs(_trends(spark, folder), 60)


@query("""
SELECT person_name, view_count, word_count, year_born, year_died, gender, occupation, field, country_code, continent
FROM [TRENDS] t
""")
def people_csv(spark, folder):
    """Person trends written as CSV and read back."""
    path = f"{scratch_dir(spark)}/people.csv"
    _trends(spark, folder).write.csv(path, header=True)
    return tables.read_people_csv(spark, path)


@query("""
SELECT count(*) AS people, count(*) FILTER (WHERE year_born >= 200 AND (year_died IS NULL OR year_died >= 200)) AS kept
FROM (SELECT CASE WHEN l_orderkey % 5 = 0 THEN -1 ELSE year_born - 1750 END AS year_born,
             CASE WHEN l_orderkey % 7 = 0 THEN year_died - 1830 ELSE year_died END AS year_died
      FROM (SELECT l_orderkey, 1850 + l_orderkey % 120 AS year_born,
                   CASE WHEN l_linenumber <> 3 THEN 1870 + l_orderkey % 120 END AS year_died FROM lineitem) l) t
""")
def plausible_people(spark, folder):
    born = F.lit(1850) + F.col("l_orderkey") % 120
    died = F.when(F.col("l_linenumber") != 3, F.lit(1870) + F.col("l_orderkey") % 120)
    people = tables.load_table(spark, folder, "lineitem", "l_orderkey", "l_linenumber").select(
        F.when(F.col("l_orderkey") % 5 == 0, -1).otherwise(born - 1750).alias("born"),
        F.when(F.col("l_orderkey") % 7 == 0, died - 1830).otherwise(died).alias("died"))
    return people.agg(
        F.count("*").alias("people"),
        F.count_if(pr.plausible_years(F.col("born"), F.col("died"))).alias("kept"))
