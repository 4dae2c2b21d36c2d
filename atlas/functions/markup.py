"""Columns over wiki markup: templates, coordinates, infoboxes, links, plain text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atlas import fixed_values as fv
from atlas.functions import scanner, text as tx

# Templates whose parameters are read; those of citations and the like never leave the scanner.
_READ = ("infobox", *fv.COORDINATE_TEMPLATE_PREFIXES)


def scan(text: Column, wanted: tuple[str, ...] = _READ, with_plain: bool = True) -> Column:
    """``struct<templates, links, plain>`` of a markup column.

    Every template is named, in document order; parameters are given for those
    whose lower-case name starts with one of ``wanted``.  ``plain`` is NULL unless
    asked for, which halves what comes back from the workers.
    """
    return scanner.scan(text, wanted, with_plain)


def link_targets(text: Column) -> Column:
    """Link targets of a short markup value in order, without leaving the JVM."""
    return F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|\n]+)"), F.lit(1))


def plain_text(scanned_plain: Column) -> Column:
    """Remove tags, external link addresses and quote marks from scanned text."""
    plain = F.regexp_replace(scanned_plain, r"<[^<>]*>", "")
    plain = F.regexp_replace(plain, r"\[(?:https?:)?//[^\s\]]*\s*([^\]]*)\]", "$1")
    plain = F.regexp_replace(plain, "'{2,}", "")
    return F.replace(F.replace(F.replace(plain, F.lit("&nbsp;"), F.lit(" ")),
                               F.lit("&ndash;"), F.lit("–")), F.lit("&amp;"), F.lit("&"))


def positional_values(params: Column) -> Column:
    """Upper-case positional values of a template, those empty or with a colon left out."""
    mine = F.filter(params, lambda p: p.positional & (p.value != "") & ~F.contains(p.value, F.lit(":")))
    return F.transform(mine, lambda p: F.upper(tx.strip(
        F.regexp_replace(p.value, r"(?s)<!--.*?-->|<[^<>]*>|\{\{[^{}]*\}\}|'{2,}", ""))))


def parse_coordinates(values: Column) -> Column:
    """``struct<lat, lng>`` from positional values.

    Two values are plain degrees.  Otherwise numbers add up as degrees, minutes
    and seconds until a letter N, S, E or W says which coordinate they were.
    NULL when two plain values are not both numbers.
    """
    plain_lat = tx.to_double(F.get(values, F.lit(0)))
    plain_lng = tx.to_double(F.get(values, F.lit(1)))
    plain = F.when(
        plain_lat.isNotNull() & plain_lng.isNotNull(),
        F.struct(plain_lat.alias("lat"), plain_lng.alias("lng")),
    )

    def state(val, unit, lat, lng):
        return F.struct(val.alias("val"), unit.alias("unit"), lat.alias("lat"), lng.alias("lng"))

    nothing = F.lit(None).cast("double")
    zero, one = F.lit(0.0), F.lit(1.0)

    def step(acc, value):
        number = tx.to_double(value)
        signed = F.when(value.isin("S", "W"), -acc.val).otherwise(acc.val)
        return (
            F.when(value.isin("N", "S"), state(zero, one, signed, acc.lng))
            .when(value.isin("E", "W"), state(zero, one, acc.lat, signed))
            .when(number.isNotNull(), state(acc.val + number * acc.unit, acc.unit / 60.0, acc.lat, acc.lng))
            .otherwise(acc)
        )

    folded = F.aggregate(
        values, state(zero, one, nothing, nothing), step,
        lambda acc: F.struct(acc.lat.alias("lat"), acc.lng.alias("lng")),
    )
    return F.when(F.size(values) == 2, plain).otherwise(folded)


def coordinate_values(templates: Column) -> Column:
    """Positional values of each coordinate template of a page.

    A repeated template keeps its first place and its last parameters.
    """
    def is_coordinate(t):
        name = F.lower(t["name"])
        wanted = F.lit(False)
        for prefix in fv.COORDINATE_TEMPLATE_PREFIXES:
            wanted = wanted | F.startswith(name, F.lit(prefix))
        return wanted & ~name.isin(*fv.COORDINATE_TEMPLATES_IGNORED)

    mine = F.filter(templates, is_coordinate)
    names = F.array_distinct(F.transform(mine, lambda t: t["name"]))
    params = F.transform(names, lambda n: F.element_at(F.filter(mine, lambda t: t["name"] == n), -1)["params"])
    return F.transform(params, positional_values)


def best_coordinate(values: Column) -> Column:
    """``struct<lng, lat>`` of a page, NULL unless both parts are known.

    The first template with two non-zero parts wins, else the last readable one.
    """
    read = F.filter(F.transform(values, parse_coordinates), lambda c: c.isNotNull())
    last = F.array_size(values)
    ranked = F.transform(read, lambda c, i: F.struct(
        F.when((c.lat != 0) & (c.lng != 0), i).otherwise(last + last - i).alias("order"), c.alias("at")))
    best = F.slice(F.array_sort(ranked), 1, 1)
    return F.get(F.transform(
        F.filter(best, lambda b: b["at"].lat.isNotNull() & b["at"].lng.isNotNull()),
        lambda b: F.struct(b["at"].lng.alias("lng"), b["at"].lat.alias("lat"))), F.lit(0))


def infobox_params(templates: Column) -> Column:
    """Parameters of all infoboxes, names tidied, in document order."""
    boxes = F.filter(templates, lambda t: F.startswith(F.lower(t["name"]), F.lit("infobox")))
    return F.transform(
        F.flatten(F.transform(boxes, lambda t: t["params"])),
        lambda p: F.struct(F.lower(tx.strip(p["name"])).alias("name"), p["value"].alias("value")),
    )


def infobox_map(templates: Column) -> Column:
    """Infobox parameters as a map; the last value of a name wins."""
    params = infobox_params(templates)
    names = F.array_distinct(F.transform(params, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: last_param(params, n)))


def last_param(params: Column, name) -> Column:
    return F.try_element_at(F.filter(params, lambda p: p["name"] == name), F.lit(-1))["value"]


def place_links(params: Column) -> Column:
    """Links in the birth place and then the death place of infobox parameters."""
    none = F.array().cast("array<string>")
    return F.concat(*[
        F.coalesce(link_targets(last_param(params, name)), none) for name in fv.PLACE_PARAMETERS
    ])
