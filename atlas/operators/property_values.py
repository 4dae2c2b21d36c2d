"""Property documents as rows, one per value, and containment asked of them.

``prop_name, shape, field, text, num, flag``: a scalar has one row, a list one per member (one without a
value if it is empty), an object one per ``field`` of it.  A value is text, a number or a truth value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from atlas.operators.joins import holding_all

_VALUE = "struct<shape: string, field: string, text: string, num: double, flag: boolean>"


def _value(shape: str, field: str | None = None, text=None, num=None, flag=None) -> Column:
    none = F.lit(None)
    return F.struct(F.lit(shape), F.lit(field), *[none if v is None else v for v in (text, num, flag)]).cast(_VALUE)


def property_values(long: DataFrame) -> DataFrame:
    """Rows of a long property table (``qid, prop_name, kind, vals, num, lat, lng, globe, altitude``)."""
    parts = F.array_compact(F.array(
        *[F.when(F.col(c).isNotNull(), _value("object", c, num=F.col(c))) for c in ("lat", "lng", "altitude")],
        F.when(F.col("globe").isNotNull(), _value("object", "globe", text=F.col("globe")))))
    members = F.transform("vals", lambda v: _value("list", text=v))
    values = (
        F.when(F.col("kind") == "globecoordinate", parts)
        .when(F.col("num").isNotNull(), F.array(_value("scalar", num=F.col("num"))))
        .when(F.size("vals") == 1, F.array(_value("scalar", text=F.get("vals", F.lit(0)))))
        .when(F.size("vals") > 1, members).otherwise(F.array(_value("list"))))
    return long.select("qid", "prop_name", F.explode(values).alias("v")).select("qid", "prop_name", "v.*")


def values_of_documents(df: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of variant documents; members of lists and objects that are lists or objects themselves have no value."""
    tvf = df.sparkSession.tvf
    top = df.select(key, column).lateralJoin(tvf.variant_explode(F.col(column).outer())).select(
        key, F.col("key").alias("prop_name"), F.col("value").alias("_value"))
    kind = F.schema_of_variant("_value")
    top = top.withColumn("shape", F.when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("scalar"))
    inner = top.lateralJoin(tvf.variant_explode_outer(F.col("_value").outer()))
    at = F.when(F.col("shape") == "scalar", F.col("_value")).otherwise(F.col("value"))
    own = inner.select(key, "prop_name", "shape", F.when(F.col("shape") == "object", F.col("key")).alias("field"), at.alias("_at"))
    kind = F.schema_of_variant("_at")
    return own.select(
        key, "prop_name", "shape", "field",
        F.when(kind == "STRING", F.try_variant_get("_at", "$", "string")).alias("text"),
        F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get("_at", "$", "double")).alias("num"),
        F.when(kind == "BOOLEAN", F.try_variant_get("_at", "$", "boolean")).alias("flag"))


def _equals(value) -> Column:
    if isinstance(value, bool):
        return F.col("flag") == F.lit(value)
    if isinstance(value, (int, float)):
        return F.col("num") == float(value)
    if isinstance(value, str):
        return F.col("text") == value
    raise ValueError("values within lists and objects are text, numbers or truth values")


def tests(wanted: dict) -> list[Column]:
    """What must hold in some row each, for a document to contain ``wanted``."""
    found = []
    for key, value in wanted.items():
        def row(shape: str, key=key) -> Column:
            return (F.col("prop_name") == key) & (F.col("shape") == shape)

        if isinstance(value, dict):
            found += [row("object") & (F.col("field") == name) & _equals(v) for name, v in value.items()] or [row("object")]
        elif isinstance(value, (list, tuple, set)):
            found += [row("list") & _equals(v) for v in dict.fromkeys(value)] or [row("list")]
        else:
            found.append(row("scalar") & _equals(value))
    return found


def holding(values: DataFrame, key: str, wanted: dict) -> DataFrame:
    """Keys whose documents contain ``wanted``, by relational division over the rows of its properties.

    The filter on the property names reaches the scan of a stored table, which skips all others.
    """
    return holding_all(values.where(F.col("prop_name").isin(list(wanted))), [key], tests(wanted))
