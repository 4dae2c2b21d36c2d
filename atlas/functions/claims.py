"""Column functions over knowledge-base claim values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from atlas import fixed_values as fv

_TIME = r"^([+-]?[0-9]+)-([0-9]{2})-([0-9]{2})T([0-9]{2}):([0-9]{2}):([0-9]{2})"


def field(value: Column, name: str) -> Column:
    return F.get_json_object(value, f"$.{name}")


def time_text(raw: Column) -> Column:
    """``YYYY-MM-DDThh:mm:ss`` with a zero month or day raised to one."""
    def part(i):
        return F.regexp_extract(raw, _TIME, i).try_cast("long")

    year, month, day, hour, minute, second = (part(i) for i in range(1, 7))
    one = F.lit(1)
    return F.when(year.isNotNull(), F.format_string(
        "%04d-%02d-%02dT%02d:%02d:%02d",
        year, F.greatest(month, one), F.greatest(day, one), hour, minute, second))


def claim_value(kind: Column, value: Column) -> Column:
    """Typed value of a claim from its kind and raw JSON or text.

    ``struct<text, num, lat, lng, globe, altitude, item>``: ``text`` for strings,
    times and monolingual text, ``num`` for quantities, the coordinate parts, or
    ``item`` for the id of another entity, whose name the caller looks up.
    ``globe`` is the raw id; Earth is left out.
    """
    nothing = F.lit(None)
    lat = field(value, "latitude").try_cast("double")
    lng = field(value, "longitude").try_cast("double")
    placed = (kind == "globecoordinate") & (
        (F.coalesce(lat, F.lit(0.0)) != 0) | (F.coalesce(lng, F.lit(0.0)) != 0))
    globe = F.substring_index(field(value, "globe"), "/", -1)
    altitude = field(value, "altitude").try_cast("double")
    text = (
        F.when(kind == "string", value)
        .when(kind == "time", time_text(field(value, "time")))
        .when(kind == "monolingualtext", field(value, "text"))
    )
    return F.struct(
        F.nullif(text, F.lit("")).alias("text"),
        F.when(kind == "quantity", F.nullif(field(value, "amount").try_cast("double"), F.lit(0.0))).alias("num"),
        F.when(placed, lat).alias("lat"),
        F.when(placed, lng).alias("lng"),
        F.when(placed & (globe != fv.EARTH), globe).alias("globe"),
        F.when(placed, F.nullif(altitude, F.lit(0.0))).otherwise(nothing.cast("double")).alias("altitude"),
        F.when(kind == "wikibase-entityid", field(value, "id")).alias("item"),
    )


def has_value(v: Column) -> Column:
    """Whether a claim carries a value that counts: not missing, empty or zero."""
    return (
        v["text"].isNotNull() | v["num"].isNotNull() | v["lat"].isNotNull()
        | v["lng"].isNotNull() | v["item"].isNotNull()
    )


def json_string(text: Column) -> Column:
    """Text as a quoted JSON string."""
    quoted = F.to_json(F.array(text))
    return F.substring(quoted, F.lit(2), F.length(quoted) - 2)
