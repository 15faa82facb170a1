"""Three changes made by hand, one per cloud, and what must not show as drift."""

import json
import random

import pytest

from cloudtally.operators import drift

ROOTS = ["hub", "gcp", "aws", "azure"]


def state(spark, *rows):
    made = [(root, address, json.dumps(doc)) for root, address, doc in rows]
    return drift.state_documents(spark.createDataFrame(made, "root string, address string, state string"))


BUCKET, LOGS, GROUP = "google_storage_bucket.landing", "aws_cloudwatch_log_group.this", "azurerm_resource_group.this"
RUN = "google_cloud_run_v2_service.this"


def sides(spark):
    declared = state(
        spark,
        ("hub", BUCKET, {"age": 30}),
        ("aws", LOGS, {"retention": 1, "image": "a"}),
        ("azure", GROUP, {"tags": {"env": "dev"}}),
        ("gcp", RUN, {"cpu": "1"}),
    )
    observed = state(
        spark,
        ("hub", BUCKET, {"age": 7}),
        ("aws", LOGS, {"retention": 3, "image": "b"}),
        ("azure", GROUP, {"tags": {"env": "dev", "added": "console"}}),
        ("gcp", RUN, {"cpu": "1", "labels": {"by": "hand"}}),
    )
    return declared, observed


def test_three_changes(spark):
    declared, observed = sides(spark)
    owned = spark.createDataFrame([(LOGS, "image")], "address string, attr string")
    diff = drift.snapshot_diff(declared, observed, ignore=owned, declared_only=["google_"])
    got = {r["root"]: (r["attr"], r["declared"], r["observed"]) for r in diff.collect()}
    assert got == {
        "hub": ("age", "30", "7"),
        "aws": ("retention", "1", "3"),
        "azure": ("tags.added", None, '"console"'),
    }
    status = {r["root"]: r["status"] for r in drift.drift_status(diff, ROOTS).collect()}
    assert status == {"hub": "drift", "aws": "drift", "azure": "drift", "gcp": "clean"}


def test_nothing_is_hidden_unless_asked(spark):
    declared, observed = sides(spark)
    diff = drift.snapshot_diff(declared, observed)
    assert {(r["root"], r["attr"]) for r in diff.collect()} >= {("aws", "image"), ("gcp", "labels.by")}


def test_null_type_and_missing_differ(spark):
    declared = state(spark, ("r", "a", {"n": None, "one": 1, "same": None}))
    observed = state(spark, ("r", "a", {"one": "1", "same": None}))
    got = {(r["attr"], r["change"]) for r in drift.snapshot_diff(declared, observed).collect()}
    assert got == {("n", "removed"), ("one", "changed")}


def test_digests(spark):
    rows = [("t1", r, "d") for r in ("gcp", "aws", "azure")] * 3
    rows += [("t2", "gcp", "d"), ("t2", "aws", "e"), ("t2", "azure", "d"), ("t3", "gcp", "d"), ("t3", "other", "d"), ("t4", "gcp", "d"), ("t4", "aws", "e")]
    images = spark.createDataFrame(rows, "tag string, registry string, digest string")
    got = {r["tag"]: (r["status"], r["missing"]) for r in drift.digest_agreement(images, ["gcp", "aws", "azure"]).collect()}
    assert got == {"t1": ("same", 0), "t2": ("differ", 0), "t3": ("missing", 2), "t4": ("differ", 1)}


def test_spelling_is_not_drift(spark):
    rows = lambda text: drift.state_documents(spark.createDataFrame([("r", "a", text)], "root string, address string, state string"))
    assert drift.snapshot_diff(rows('{"b": 1, "a": [1, 2]}'), rows('{"a":[1,2],"b":1}')).count() == 0


def test_a_resource_on_one_side_only(spark):
    both = state(spark, ("r", "a", {"x": 1, "y": 2}))
    none = both.filter("false")
    assert {(r["attr"], r["change"]) for r in drift.snapshot_diff(both, none).collect()} == {("x", "removed"), ("y", "removed")}
    assert {(r["attr"], r["change"]) for r in drift.snapshot_diff(none, both).collect()} == {("x", "added"), ("y", "added")}


def changes(diff):
    return {(r["attr"], r["declared"], r["observed"], r["change"]) for r in diff.collect()}


def test_a_hand_added_label_on_a_provider_that_leaves_it_alone(spark):
    for before in ({"a": "1"}, {}):
        declared = state(spark, ("gcp", RUN, {"labels": before}))
        observed = state(spark, ("gcp", RUN, {"labels": {**before, "hand": "x"}}))
        assert drift.snapshot_diff(declared, observed, declared_only=["google_"]).count() == 0
        assert changes(drift.snapshot_diff(declared, observed)) == {("labels.hand", None, '"x"', "added")}


def test_paths_at_every_level(spark):
    declared = state(spark, ("r", "a", {"t": [{"c": [{"image": "1"}]}, 5], "gone": {"x": [], "y": {"z": 1}}, "odd key.": 1, "kind": {"k": 1}}))
    observed = state(spark, ("r", "a", {"t": [{"c": [{"image": "2"}, {"n": None}]}], "odd key.": 2, "kind": 3}))
    assert changes(drift.snapshot_diff(declared, observed)) == {
        ("t[0].c[0].image", '"1"', '"2"', "changed"), ("t[0].c[1].n", None, "null", "added"), ("t[1]", "5", None, "removed"),
        ("gone.x", "[]", None, "removed"), ("gone.y.z", "1", None, "removed"), ("['odd key.']", "1", "2", "changed"),
        ("kind", "{}", "3", "changed"), ("kind.k", "1", None, "removed"),
    }
    shallow = changes(drift.snapshot_diff(declared, observed, depth=1))
    assert ("t", '[{"c":[{"image":"1"}]},5]', '[{"c":[{"image":"2"},{"n":null}]}]', "changed") in shallow


def test_what_another_process_owns_is_owned_below_too_and_in_its_root(spark):
    rows = [(root, "a", {"t": {"image": 1, "images": 1}}) for root in ("hub", "gcp")]
    declared, observed = state(spark, *rows), state(spark, *[(r, a, {"t": {"image": {"v": 2}, "images": 2}}) for r, a, _ in rows])
    owned = spark.createDataFrame([("hub", "a", "t.image")], "root string, address string, attr string")
    got = {(r["root"], r["attr"]) for r in drift.snapshot_diff(declared, observed, ignore=owned).collect()}
    assert got == {("hub", "t.images"), ("gcp", "t.images"), ("gcp", "t.image"), ("gcp", "t.image.v")}


def test_documents_that_cannot_be_read_are_not_clean(spark):
    rows = lambda *texts: drift.state_documents(
        spark.createDataFrame([(f"r{i}", "a", t) for i, t in enumerate(texts)], "root string, address string, state string")
    )
    diff = drift.snapshot_diff(rows('{"a": 1', '{"a": 1', None, "{}"), rows('{"b', '{"a": 1}', "{}", "{}"))
    assert {(r["root"], r["change"]) for r in diff.collect()} == {("r0", "unreadable"), ("r1", "unreadable"), ("r2", "unreadable")}
    status = {r["root"]: r["status"] for r in drift.drift_status(diff, ["r1", "r3"]).collect()}
    assert status == {"r0": "unreadable", "r1": "unreadable", "r2": "unreadable", "r3": "clean"}


def slow_paths(value, path=""):
    """(path, what stands there, whether there is nothing inside) for a value and all below it."""
    if isinstance(value, dict):
        yield path, "{}", not value
        for k, v in value.items():
            plain = k.replace("-", "_").isidentifier() and k.isascii() and not k.startswith("-")
            step = (f".{k}" if path else k) if plain else f"['{k}']"
            yield from slow_paths(v, path + step)
    elif isinstance(value, list):
        yield path, "[]", not value
        for i, v in enumerate(value):
            yield from slow_paths(v, f"{path}[{i}]")
    else:
        yield path, json.dumps(value, separators=(",", ":")), True


def slow_diff(code, seen):
    sides = [{p: (j, e) for p, j, e in slow_paths(v) if p or j not in ("{}", "[]")} if v is not None else {} for v in (code, seen)]
    out = set()
    for path in {*sides[0], *sides[1]}:
        (a, empty_a), (b, empty_b) = (s.get(path, (None, False)) for s in sides)
        if a != b and (a is not None and b is not None or empty_a or empty_b):
            out.add((path, a, b, "added" if a is None else "removed" if b is None else "changed"))
    return out


def random_value(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([1, "1", None, True, "x{y}", "q\"]", {}, []])
    if rng.random() < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b", "c-d", "e f", "1"], rng.randrange(4))}


def changed_value(rng, value):
    if rng.random() < 0.15:
        return random_value(rng, 2)
    if isinstance(value, dict):
        return {k: changed_value(rng, v) for k, v in value.items() if rng.random() < 0.9}
    return [changed_value(rng, v) for v in value] if isinstance(value, list) else value


def test_any_documents_as_opened_by_hand(spark):
    rng = random.Random(4)
    pairs = []
    for _ in range(150):
        code = {"top": random_value(rng, 6)}
        pairs.append((code, changed_value(rng, code) if rng.random() < 0.9 else None))
    declared = state(spark, *[("r", f"a{i}", c) for i, (c, _) in enumerate(pairs)])
    observed = state(spark, *[("r", f"a{i}", o) for i, (_, o) in enumerate(pairs) if o is not None])
    got = {(r["address"], r["attr"], r["declared"], r["observed"], r["change"]) for r in drift.snapshot_diff(declared, observed).collect()}
    assert got == {(f"a{i}", *d) for i, pair in enumerate(pairs) for d in slow_diff(*pair)}
    assert len(got) > 200


@pytest.mark.parametrize("levels", [3, 12, 40])
def test_documents_are_opened_as_deep_as_they_go(spark, levels):
    def nested(leaf):
        value = leaf
        for i in range(levels):
            value = {"k": value} if i % 2 else [value]
        return {"top": value, "text": '{"[' * 9}

    (row,) = drift.snapshot_diff(state(spark, ("r", "a", nested(1))), state(spark, ("r", "a", nested(2)))).collect()
    assert (row["declared"], row["observed"]) == ("1", "2") and row["attr"].count("k") + row["attr"].count("[") == levels


def test_each_state_is_read_once(spark, folder):
    both = state(spark, ("r", "a", {"x": 1}))
    for side in ("code", "seen"):
        both.write.parquet(f"{folder}/{side}")
    plan = drift.snapshot_diff(spark.read.parquet(f"{folder}/code"), spark.read.parquet(f"{folder}/seen"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("Join") == 1
