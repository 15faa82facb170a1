"""Tags as ``array<struct<key,value>>``: build, clean, merge, look up.

Everything here is per row, with array functions: no explode, so no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cloudtally.schemas import TAG_ARRAY


def _pair(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def drop_key_prefix(pairs: Column, prefix: str = "user:") -> Column:
    """Remove a prefix some exports put on user-defined keys."""
    cut = len(prefix)
    return F.transform(
        F.coalesce(pairs, F.array().cast(TAG_ARRAY)),
        lambda t: _pair(
            F.when(t["key"].startswith(prefix), F.substring(t["key"], cut + 1, 1 << 30)).otherwise(t["key"]),
            t["value"],
        ),
    )


def pairs_from_text(text: Column, lenient: bool = False) -> Column:
    """Tags out of a flat JSON object kept as text.

    By default only text values written with no space around the colon count,
    which is how the export writes them. ``lenient`` reads it as JSON instead.
    NULL text, and text that is neither, gives an empty array.
    """
    if lenient:
        as_map = F.from_json(F.coalesce(text, F.lit("{}")), "map<string,string>")
        pairs = F.transform(F.map_entries(as_map), lambda e: _pair(e["key"], e["value"]))
        return F.coalesce(pairs, F.array().cast(TAG_ARRAY))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit('"[^"]+":"[^"]*"'), F.lit(0))
    # A match is "key":"value" and neither side can hold a quote.
    return F.transform(
        found,
        lambda m: _pair(
            F.substring_index(F.substring_index(m, '"', 2), '"', -1),
            F.substring_index(F.substring_index(m, '"', -2), '"', 1),
        ),
    )


def own_then_inherited(own: Column, inherited: Column) -> Column:
    """Merge labels: a resource's own label wins, its project's fill the rest.

    The first entry for a key is kept, so a key repeated inside one array is
    settled by position. The arrays are folded once: an expression used inside
    a lambda would be worked out again for every element.
    """
    none = F.array().cast(TAG_ARRAY)
    every = F.concat(F.coalesce(own.cast(TAG_ARRAY), none), F.coalesce(inherited.cast(TAG_ARRAY), none))

    def add(kept: Column, label: Column) -> Column:
        known = F.exists(kept, lambda k: k["key"].eqNullSafe(label["key"]))
        return F.when(known, kept).otherwise(F.array_append(kept, label))

    return F.aggregate(every, none, add)


def tag(tags: Column, key: str) -> Column:
    """First value under a key, NULL when the key is absent."""
    place = F.array_position(tags["key"], key).cast("int")
    return F.get(tags["value"], place - 1)


def tags_as_text(tags: Column) -> Column:
    """``key=value`` pairs in key order, for reports that need a flat column."""
    return F.array_join(
        F.array_sort(F.transform(tags, lambda t: F.concat(t["key"], F.lit("="), F.coalesce(t["value"], F.lit(""))))),
        ",",
    )
