"""Declared state against observed state, and image agreement across registries."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloudtally.functions import json_values as j
from cloudtally.functions.labels import join_same

_RESOURCE = ["root", "address"]


def state_documents(states: DataFrame, document: str = "state") -> DataFrame:
    """Resources' JSON documents in one spelling: spaces gone, keys in order.

    Documents that say the same are then the same text. One that is missing or
    is not JSON has no ``state``, and says so in ``unreadable``.
    """
    spelled = F.to_json(j.parse(F.col(document)))
    return states.select(*_RESOURCE, spelled.alias("state"), spelled.isNull().alias("unreadable"))


_NODE = "array<struct<path:string,code:variant,seen:variant,declared:string,observed:string,done:boolean>>"


def _levels(document: Column) -> Column:
    """How deep the objects and arrays of a JSON text lie in each other."""
    brackets = F.regexp_replace(document, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^\[\]{}"]++', "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(at: Column, mark: Column) -> Column:
        now = at["now"] + F.when(mark.isin("{", "["), 1).when(mark == "", 0).otherwise(-1)
        return F.struct(now.alias("now"), F.greatest(at["most"], now).alias("most"))

    return F.coalesce(F.aggregate(F.split(brackets, ""), start, step, lambda at: at["most"]), F.lit(0))


def _opened(node: Column) -> Column:
    """A pair of values as what differs at its own path, and the pairs of fields and elements one step down.

    Where both sides say the same nothing is left, so only what differs is
    taken further apart. An object or array stands for itself as ``{}`` or
    ``[]``, so that a change inside it is not one of it; one that came or went
    is not listed, as what is inside it is, unless it is empty.
    """
    path, code, seen = node["path"], node["code"], node["seen"]
    plain = r"^[A-Za-z_][A-Za-z0-9_-]*$"

    def parts(value: Column) -> tuple[Column, Column]:
        return j.fields(value, "$"), F.try_variant_get(value, "$", "array<variant>")

    def own(value: Column, members: Column, elements: Column) -> Column:
        # The document itself is no attribute, unless it is a plain value.
        container = F.when(members.isNotNull(), "{}").when(elements.isNotNull(), "[]")
        return F.when(container.isNull(), F.to_json(value)).when(path != "", container)

    def empty(members: Column, elements: Column) -> Column:
        return F.coalesce(F.size(members), F.size(elements), F.lit(0)) <= 0

    def below(key: Column) -> Column:
        step = F.when(key.rlike(plain), F.concat(F.lit("."), key)).otherwise(F.concat(F.lit("['"), key, F.lit("']")))
        return F.when((path == "") & key.rlike(plain), key).otherwise(F.concat(path, step))

    def row(path: Column, code: Column, seen: Column, declared: Column, observed: Column, done: bool) -> Column:
        return F.struct(
            path.alias("path"), code.alias("code"), seen.alias("seen"),
            declared.alias("declared"), observed.alias("observed"), F.lit(done).alias("done"),
        )

    nothing, text = F.lit(None).cast("variant"), F.lit(None).cast("string")
    (fields, elements), (fields_seen, elements_seen) = parts(code), parts(seen)
    mark, mark_seen = own(code, fields, elements), own(seen, fields_seen, elements_seen)
    both = code.isNotNull() & seen.isNotNull()
    listed = F.when(both, ~mark.eqNullSafe(mark_seen)).otherwise(
        (mark.isNotNull() | mark_seen.isNotNull()) & F.when(code.isNull(), empty(fields_seen, elements_seen)).otherwise(empty(fields, elements))
    )
    none = F.array().cast(_NODE)
    itself = F.when(listed, F.array(row(path, nothing, nothing, mark, mark_seen, True)).cast(_NODE)).otherwise(none)
    no_keys = F.array().cast("array<string>")
    keys = F.array_union(F.coalesce(F.map_keys(fields), no_keys), F.coalesce(F.map_keys(fields_seen), no_keys))
    members = F.transform(keys, lambda k: row(below(k), F.try_element_at(fields, k), F.try_element_at(fields_seen, k), text, text, False))
    length = F.greatest(F.coalesce(F.size(elements), F.lit(0)), F.coalesce(F.size(elements_seen), F.lit(0)))
    places = F.when(length > 0, F.sequence(F.lit(0), length - 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(
        places, lambda i: row(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), F.get(elements, i), F.get(elements_seen, i), text, text, False)
    )
    return (
        F.when(node["done"], F.array(node).cast(_NODE))
        .when(F.to_json(code).eqNullSafe(F.to_json(seen)), none)
        .otherwise(F.concat(itself, members.cast(_NODE), inside.cast(_NODE)))
    )


def _differences(code: Column, seen: Column, depth: int | None) -> Column:
    """Paths at which two JSON texts differ, as nodes: both are opened together, level by level, until nothing is left to open."""
    levels = F.greatest(_levels(code), _levels(seen)) + 1
    root = F.struct(
        F.lit("").alias("path"), j.parse(code).alias("code"), j.parse(seen).alias("seen"),
        F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("observed"), F.lit(False).alias("done"),
    )
    if depth is not None:
        levels = F.least(levels, F.lit(depth))
    nodes = F.aggregate(
        F.sequence(F.lit(1), levels), F.array(root).cast(_NODE), lambda nodes, _: F.flatten(F.transform(nodes, _opened)).cast(_NODE)
    )
    # What is not opened, as it lies below the depth asked for, is compared whole.
    whole = F.filter(nodes, lambda n: n["done"] | ~F.to_json(n["code"]).eqNullSafe(F.to_json(n["seen"])))
    return F.transform(
        whole,
        lambda n: F.struct(
            n["path"].alias("attr"),
            F.coalesce(n["declared"], F.to_json(n["code"])).alias("declared"),
            F.coalesce(n["observed"], F.to_json(n["seen"])).alias("observed"),
        ),
    )


def snapshot_diff(
    declared: DataFrame,
    observed: DataFrame,
    ignore: DataFrame | None = None,
    declared_only: Sequence[str] = (),
    depth: int | None = None,
) -> DataFrame:
    """Attributes, at any level, whose observed value is not the declared one.

    Both sides come from ``state_documents`` and are joined once. Documents
    that differ are opened together, row by row, into paths such as
    ``template[0].image``, as deep as they go; with a ``depth``, a value below
    that many levels is compared whole. Values keep their JSON text, so 1 and
    "1" differ, and so do null and missing. A document that cannot be read is a
    row of its own, with change ``unreadable`` and no attribute, whatever the
    other side says.

    ``ignore`` lists ``(address, attr)`` another process owns, and everything
    below that path; with a ``root`` column, in that root only. Addresses under
    a ``declared_only`` prefix are compared on declared paths alone, for a
    provider that leaves alone what the code does not name.
    """
    left = declared.select(*_RESOURCE, F.col("state").alias("_code"), F.col("unreadable").alias("_bad"))
    right = observed.select(*_RESOURCE, F.col("state").alias("_seen"), F.col("unreadable").alias("_bad_seen"))
    unread = F.coalesce("_bad", F.lit(False)) | F.coalesce("_bad_seen", F.lit(False))
    both = left.join(right, _RESOURCE, "full").filter(unread | ~F.col("_code").eqNullSafe(F.col("_seen")))
    broken = F.array(F.struct(F.lit(None).cast("string").alias("attr"), F.col("_code").alias("declared"), F.col("_seen").alias("observed")))
    rows = both.select(
        *_RESOURCE, unread.alias("_unread"), F.explode(F.when(unread, broken).otherwise(_differences(F.col("_code"), F.col("_seen"), depth))).alias("_d")
    ).select(*_RESOURCE, "_d.attr", "_d.declared", "_d.observed", "_unread")
    in_code, found = F.col("declared").isNotNull(), F.col("observed").isNotNull()
    for prefix in declared_only:
        rows = rows.filter(F.col("_unread") | in_code | ~F.col("address").startswith(prefix))
    change = F.when(F.col("_unread"), "unreadable").when(~in_code, "added").when(~found, "removed").otherwise("changed")
    diff = rows.select(*_RESOURCE, "attr", "declared", "observed", change.alias("change"))
    if ignore is not None:
        keys = [c for c in _RESOURCE if c in ignore.columns]
        owned = ignore.select(*[F.col(c).alias(f"_o_{c}") for c in (*keys, "attr")]).distinct()
        under = F.col("attr") == F.col("_o_attr")
        for mark in (".", "["):
            under = under | F.startswith(F.col("attr"), F.concat("_o_attr", F.lit(mark)))
        same = [F.col(c) == F.col(f"_o_{c}") for c in keys]
        diff = diff.join(owned, reduce(Column.__and__, [*same, under]), "left_anti")
    return diff


def drift_status(diff: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Drift, unreadable or clean: of every root listed, and of every other one with a change."""
    spark = diff.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(r) for r in roots])).alias("root"))
    counts = diff.groupBy("root").agg(
        F.count(F.lit(1)).alias("changes"), F.bool_or(F.col("change") == "unreadable").alias("unread")
    )
    changes = F.coalesce("changes", F.lit(0).cast("long"))
    return join_same(listed, counts, ["root"], "full").select(
        "root",
        changes.alias("changes"),
        F.when(F.col("unread"), "unreadable").when(changes > 0, "drift").otherwise("clean").alias("status"),
    )


def digest_agreement(images: DataFrame, registries: Sequence[str]) -> DataFrame:
    """Whether every registry holds the same image under a tag, and how many do not hold it.

    Any disagreement is ``differ``, also where a registry has no image at all.
    Pulls of one image repeat, so rows are reduced to (tag, registry, digest)
    first; what is counted per tag is as small as the list of registries.
    """
    one = images.filter(F.col("registry").isin(*registries)).groupBy("tag", "registry", "digest").agg(
        F.count(F.lit(1)).alias("_n")
    )
    per_tag = one.groupBy("tag", "registry").agg(
        F.min("digest").alias("_low"), F.max("digest").alias("_high")
    ).groupBy("tag").agg(
        F.count(F.lit(1)).alias("registries"), F.min("_low").alias("_low"), F.max("_high").alias("_high")
    )
    missing = F.lit(len(registries)).cast("long") - F.col("registries")
    same = F.coalesce(F.col("_low") == F.col("_high"), F.lit(False))
    return per_tag.select(
        "tag",
        "registries",
        missing.alias("missing"),
        F.when(~same, "differ").when(missing > 0, "missing").otherwise("same").alias("status"),
    )
