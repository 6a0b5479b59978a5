"""Free JSON payloads as VARIANT: parsed once, filtered and exploded by path. What is no JSON is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lawframe.functions.text import json_value


def payload(text: Column) -> Column:
    return json_value(text)


def at(value: Column, path: str, kind: str) -> Column:
    """What lies at `path` ($.a.b[0]) as a type; null where there is nothing or it is of another kind."""
    return F.try_variant_get(value, path, kind)


def where(points: DataFrame, wanted: dict[str, object], column: str = "payload") -> DataFrame:
    """Points whose payload has the wanted values at the given paths; a list of values means any of them."""
    kinds = {bool: "boolean", int: "bigint", float: "double", str: "string"}
    for path, value in wanted.items():
        values = value if isinstance(value, list) else [value]
        points = points.filter(at(F.col(column), path, kinds[type(values[0])]).isin(values))
    return points


def entries(points: DataFrame, key: str, column: str = "payload", path: str | None = None) -> DataFrame:
    """(key, pos, name, value) of an object's fields or an array's elements at `path`, a row each; none where it is neither."""
    held = points.select(key, (F.col(column) if path is None else F.try_variant_get(column, path, "variant")).alias("_held"))
    return held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("_held").outer())).select(key, "pos", F.col("key").alias("name"), "value")
