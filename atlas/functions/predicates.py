"""Row predicates: arrays, property documents, years, people."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

from atlas import fixed_values as fv


def array_contains_all(array: Column, wanted) -> Column:
    """Whether the array holds every wanted value (order and repeats do not matter)."""
    return reduce(and_, [F.array_contains(array, value) for value in wanted], F.lit(True))


def array_overlaps(array: Column, wanted) -> Column:
    """Whether the array holds at least one wanted value."""
    return F.coalesce(F.arrays_overlap(array, F.array(*[F.lit(v) for v in wanted])), F.lit(False))


def _path(key: str) -> str:
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def property_text(properties: Column, key: str) -> Column:
    """Property ``key`` of a variant document as text."""
    return F.try_variant_get(properties, _path(key), "string")


def property_contains(properties: Column, wanted: dict) -> Column:
    """Document containment: every key is present with a matching value.

    A list matches a list that holds all of its members; a scalar matches an
    equal scalar of its kind, never a list; an object matches one that contains it.
    """
    tests = []
    for key, value in wanted.items():
        if isinstance(value, dict):
            inner = F.try_variant_get(properties, _path(key), "variant")
            tests.append(F.schema_of_variant(inner).startswith("OBJECT") & property_contains(inner, value))
        elif isinstance(value, (list, tuple, set)):
            numbers = bool(value) and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in value)
            members = F.try_variant_get(properties, _path(key), "array<double>" if numbers else "array<string>")
            tests.append(array_contains_all(members, [float(v) for v in value] if numbers else list(value)))
        elif isinstance(value, bool):
            shape = F.schema_of_variant(F.try_variant_get(properties, _path(key), "variant"))
            tests.append((shape == "BOOLEAN") & (F.try_variant_get(properties, _path(key), "boolean") == F.lit(value)))
        else:
            shape = F.schema_of_variant(F.try_variant_get(properties, _path(key), "variant"))
            if isinstance(value, str):
                tests.append((shape == "STRING") & (property_text(properties, key) == value))
            else:
                number = F.try_variant_get(properties, _path(key), "double")
                tests.append(shape.rlike("^(BIGINT|DOUBLE|DECIMAL)") & (number == float(value)))
    return F.coalesce(reduce(and_, tests, F.lit(True)), F.lit(False))


def has_coordinate(lng_lat: Column) -> Column:
    return lng_lat.isNotNull()


def linked_entity(title: Column, label: Column) -> Column:
    """Whether an entity has both an article and a label."""
    return F.coalesce((title != "") & (label != ""), F.lit(False))


def born_between(year: Column, first: int = fv.YEAR_MIN, last: int = fv.YEAR_MAX) -> Column:
    return year.between(first, last)


def plausible_years(born: Column, died: Column, first: int = fv.FIRST_PLAUSIBLE_YEAR) -> Column:
    """Born in or after ``first``, and so is the death, if any is known."""
    return (born >= first) & (died.isNull() | (died == 0) | (died >= first))


def valid_pageview_line(line: Column, project: str = "en") -> Column:
    """``project title count bytes`` of one project, outside special namespaces."""
    parts = F.split(line, " ")
    return (
        F.startswith(line, F.lit(project + " "))
        & (F.size(parts) == 4)
        & ~F.contains(F.get(parts, F.lit(1)), F.lit(":"))
    )


def life_span(born: Column, died: Column) -> Column:
    return died - born
