"""Column functions over coordinates, point text and polygon rings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atlas import fixed_values as fv
from atlas.functions import text as tx

def parse_point(text: Column) -> Column:
    """``Point(lng lat)`` as ``struct<lat, lng>``; NULL unless it holds two numbers."""
    head = F.upper(F.trim(F.substring_index(text, "(", 1)))
    body = F.trim(F.substring_index(F.substring_index(text, "(", -1), ")", 1))
    parts = F.split(body, r"\s+")
    shaped = (head == "POINT") & F.contains(text, F.lit(")")) & (F.size(parts) == 2)
    lng = F.when(shaped, tx.to_double(F.get(parts, F.lit(0))))
    lat = F.when(shaped, tx.to_double(F.get(parts, F.lit(1))))
    return F.when(lat.isNotNull() & lng.isNotNull(), F.struct(lat.alias("lat"), lng.alias("lng")))


def point(lng: Column, lat: Column) -> Column:
    """Point value, NULL unless both parts are known."""
    return F.when(lng.isNotNull() & lat.isNotNull(), F.struct(lng.alias("lng"), lat.alias("lat")))


def plain_number(value: Column) -> Column:
    """A number as text without an exponent, 18 decimals at most; numbers of 20 digits and more keep theirs."""
    text = value.cast("string")
    decimal = F.regexp_replace(value.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(F.contains(text, F.lit("E")), F.coalesce(decimal, text)).otherwise(text)


def point_text(pt: Column) -> Column:
    """``POINT(lng lat)`` of a point value, in plain decimals that ``parse_point`` reads back."""
    return F.when(pt.isNotNull(), F.concat(
        F.lit("POINT("), plain_number(pt.lng), F.lit(" "), plain_number(pt.lat), F.lit(")")))


def inside(rings: Column, lng: Column, lat: Column) -> Column:
    """Whether a point lies in a polygon of rings (holes by the even-odd rule)."""
    def crossings(ring):
        following = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
        edges = F.zip_with(ring, following, lambda a, b: F.when(
            ((a.y > lat) != (b.y > lat))
            & (lng < (b.x - a.x) * (lat - a.y) / F.nullif(b.y - a.y, F.lit(0.0)) + a.x),
            F.lit(1)).otherwise(F.lit(0)))
        return F.aggregate(edges, F.lit(0), lambda total, hit: total + hit)

    total = F.aggregate(rings, F.lit(0), lambda acc, ring: acc + crossings(ring))
    return total % 2 == 1


def fix_country_code(name: Column, alpha3: Column) -> Column:
    """Alpha-3 code, set by name for countries whose polygon carries none."""
    fixed = F
    for country, code in fv.COUNTRY_CODE_FIXES.items():
        fixed = fixed.when(name == country, F.lit(code))
    return fixed.otherwise(alpha3)
