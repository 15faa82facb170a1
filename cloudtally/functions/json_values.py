"""Reading VARIANT values where missing, null and false must stay apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(text: Column) -> Column:
    """JSON text as a VARIANT; text that is not JSON gives NULL."""
    return F.try_parse_json(text)


def raw(value: Column, path: str) -> Column:
    """What is at a path as JSON text: NULL if missing, ``null`` if it is null."""
    return F.to_json(F.try_variant_get(value, path, "variant"))


def text(value: Column, path: str) -> Column:
    """A string at a path; NULL if it is missing or anything but a string."""
    return F.when(F.startswith(raw(value, path), F.lit('"')), F.try_variant_get(value, path, "string"))


def items(value: Column, path: str) -> Column:
    """The elements of an array at a path; an empty array if there is none."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))


def fields(value: Column, path: str) -> Column:
    """An object at a path as a map of values; NULL if it is not an object."""
    return F.try_variant_get(value, path, "map<string,variant>")


def one_or_many(value: Column, path: str) -> Column:
    """Strings at a path that holds either one string or an array of them."""
    # The array is tried first: reading an array as a string gives its JSON text.
    many = F.try_variant_get(value, path, "array<string>")
    one = text(value, path)
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
