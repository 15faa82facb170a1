"""Loads that can be repeated, files of every kind, and views."""

import csv
import glob
import json
import os
import pathlib
import random
import time
from collections import Counter
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cloudtally.schemas import LOAD_RUNS
from cloudtally.session import scratch_dir
from cloudtally.sources import csv_lines, files, months, versions, views
from cloudtally.sources.exposition import label_columns, parse_exposition, rejected_lines


def write(path, text, when=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    if when:
        os.utime(path, (when, when))


def test_periods():
    assert months.billing_periods(date(2026, 10, 11)) == ["2026-09", "2026-10"]
    assert months.billing_periods(date(2026, 1, 31)) == ["2025-12", "2026-01"]


def costs(spark, *values):
    return spark.createDataFrame([(float(v),) for v in values], "BilledCost double")


def total(spark, path):
    return spark.read.parquet(path).agg(F.sum("BilledCost"), F.count(F.lit(1))).first()


def test_a_month_is_replaced_and_the_others_stay(spark, folder):
    months.replace_month(costs(spark, 1, 2), folder, "2026-09")
    for _ in range(2):
        months.replace_month(costs(spark, 4, 8), folder, "2026-10")
    assert tuple(total(spark, folder)) == (15.0, 4)
    audit = months.load_audit(spark, folder, "2026-10", "BilledCost").first()
    assert (audit["period"], audit["row_count"], float(audit["billed_cost"])) == ("2026-10", 2, 12.0)


def test_aws_load_skips_a_month_without_files(spark, folder):
    export = f"{folder}/export"
    costs(spark, 1, 2).write.parquet(f"{export}/billing_period=2026-10")
    write(f"{export}/billing_period=2026-10/manifest.json", "{}")
    for _ in range(2):
        audit = months.load_aws(spark, export, f"{folder}/raw", date(2026, 10, 11))
    assert [(r["period"], r["row_count"]) for r in audit.collect()] == [("2026-10", 2)]
    assert months.load_aws(spark, export, f"{folder}/raw", date(2026, 7, 1)) is None


def test_only_the_newest_file_of_a_month_counts(spark, folder):
    now = time.time()
    header = "﻿SubscriptionId,costInBillingCurrency\r\n"
    month = f"{folder}/export/20261001-20261031"
    write(f"{month}/run-c/old.csv", header + "a,1\r\n", now - 300)
    write(f"{month}/run-a/new.csv", header + "a,1\r\nb,2\r\n", now - 100)
    write(f"{month}/run-b/mid.csv", header + "a,1\r\n", now - 200)
    assert months.newest_export(spark, f"{folder}/export", "2026-10").endswith("new.csv")
    assert months.newest_export(spark, f"{folder}/export", "2026-09") is None
    audit = months.load_azure(spark, f"{folder}/export", f"{folder}/raw", date(2026, 10, 11)).collect()
    assert [(r["row_count"], float(r["billed_cost"])) for r in audit] == [(2, 3.0)]


def test_all_parts_of_the_newest_run_count(spark, folder):
    now, header = time.time(), "SubscriptionId,costInBillingCurrency\n"
    runs = f"{folder}/export/20261001-20261031"
    write(f"{runs}/run-b/part_0.csv", header + "a,1\n", now - 300)
    write(f"{runs}/run-a/part_0.csv", header + "a,1\nb,2\n", now - 200)
    write(f"{runs}/run-a/part_1.csv", header + "c,4\n", now - 100)
    flat = f"{folder}/export/20260901-20260930"
    write(f"{flat}/old.csv", header + "a,1\n", now - 200)
    write(f"{flat}/new.csv", header + "a,1\nb,2\n", now - 100)
    audit = months.load_azure(spark, f"{folder}/export", f"{folder}/raw", date(2026, 10, 11)).collect()
    assert sorted((r["period"], r["row_count"], float(r["billed_cost"])) for r in audit) == [("2026-09", 2, 3.0), ("2026-10", 3, 7.0)]


def test_text_csv(spark, folder):
    path = f"{folder}/bill.csv"
    write(path, '﻿id,note,"a,b"\r\n1,"two\nlines, ""quoted""",007\r\n2,,x\r\n')
    got = files.read_text_csv(spark, path)
    assert got.columns == ["id", "note", "a,b"] and {t for _, t in got.dtypes} == {"string"}
    assert [tuple(r) for r in got.orderBy("id").collect()] == [("1", 'two\nlines, "quoted"', "007"), ("2", None, "x")]


def test_json_lines_have_their_schema_or_fail(spark, folder):
    good = {"run_id": 1, "cloud": "aws", "sent": 60, "ok": 60, "run_at": "2026-10-05T18:04:00Z"}
    write(f"{folder}/good/a.json", json.dumps(good) + "\n")
    row = files.read_json_lines(spark, f"{folder}/good", LOAD_RUNS).first()
    assert (row["run_id"], row["ok"]) == (1, 60)
    write(f"{folder}/bad/a.json", '{"run_id": "x"}\n')
    with pytest.raises(Exception):
        files.read_json_lines(spark, f"{folder}/bad", LOAD_RUNS).collect()


def test_documents_are_named_by_file(spark, folder):
    write(f"{folder}/aws.json", '{\n "a": 1\n}\n')
    row = files.read_documents(spark, folder).first()
    assert row["root"] == "aws" and json.loads(row["plan"]) == {"a": 1}


def test_export_is_read_in_place(spark, folder):
    costs(spark, 1).write.parquet(folder)
    assert files.read_export(spark, folder).count() == 1
    spark.read.parquet(folder).createOrReplaceTempView("an_export")
    assert files.read_export(spark, "an_export").count() == 1


def test_views_need_their_tables(spark):
    with pytest.raises(views.MissingTables, match="no_such_table"):
        views.require_tables(spark, ("no_such_table",))


@pytest.mark.parametrize(
    ("line", "expected"),
    [
        ('m_total{a="x",b="y"} 3', ("m_total", {"a": "x", "b": "y"}, 3.0)),
        ("m 1.5e3 1700000000", ("m", {}, 1500.0)),
        (r'm{a="q\"},{b\\",c="two\nlines"} +Inf', ("m", {"a": 'q"},{b\\', "c": "two\nlines"}, float("inf"))),
        ("# HELP m text", None),
        ("", None),
    ],
)
def test_exposition_line(spark, line, expected):
    rows = parse_exposition(spark.createDataFrame([(line,)], "value string")).collect()
    assert [(r["metric"], r["labels"], r["value"]) for r in rows] == ([expected] if expected else [])


def test_missing_label_is_empty(spark):
    rows = parse_exposition(spark.createDataFrame([('m{a="x"} 1',)], "value string"))
    assert label_columns(rows, "a", "b").first().asDict() == {"metric": "m", "value": 1.0, "a": "x", "b": ""}


def test_scratch_follows_the_cluster_setting(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")
    if root:
        assert scratch_dir(spark, "x").startswith(root)


def test_session_is_utc(spark):
    assert spark.range(1).select(F.lit("2026-10-05T18:04:00Z").cast("timestamp").cast("timestamp_ntz")).first()[0] == datetime(
        2026, 10, 5, 18, 4
    )


def test_an_emptied_month_is_empty_and_a_new_column_is_read(spark, folder):
    months.replace_month(costs(spark, 1, 2), folder, "2026-09")
    months.replace_month(costs(spark, 4), folder, "2026-10")
    months.replace_month(costs(spark, 1).limit(0), folder, "2026-10")
    assert months.load_audit(spark, folder, "2026-10", "BilledCost").first()["row_count"] == 0
    assert months.load_audit(spark, folder, "2026-09", "BilledCost").first()["row_count"] == 2
    months.replace_month(costs(spark, 8).withColumn("x_New", F.lit("n")), folder, "2026-10")
    assert {(r["BilledCost"], r["x_New"]) for r in files.read_export(spark, folder).collect()} == {(1.0, None), (2.0, None), (8.0, "n")}


def test_tabs_and_values_that_are_no_numbers(spark):
    lines = spark.createDataFrame([('m\t{a="x\ty"}\t3',), ("n\t4",), ('m{a="x"} abc',), ("# TYPE m counter",), ("k nope 5",)], "value string")
    got = {(r["metric"], r["labels"].get("a"), r["value"]) for r in parse_exposition(lines).collect()}
    assert got == {("m", "x\ty", 3.0), ("n", None, 4.0)}
    assert {r["value"] for r in rejected_lines(lines).collect()} == {'m{a="x"} abc', "k nope 5"}


def test_documents_in_folders_of_their_root(spark, folder):
    write(f"{folder}/root=hub/a.json", '{"a": 1}')
    write(f"{folder}/root=hub/b.json", '{"b":\n')
    assert {(r["root"], r["plan"]) for r in files.read_documents(spark, folder, named_by="root").collect()} == {("hub", '{"a": 1}'), ("hub", '{"b":\n')}


def test_documents_are_written_one_to_a_file_by_many_tasks(spark, folder):
    rows = [(root, n, f'{{"n":{n}}}') for n in range(40) for root in ("hub", "aws", None)]
    docs = spark.createDataFrame(rows, "root string, batch int, plan string").coalesce(1)
    files.write_documents(docs.unionByName(docs), folder, "root", "batch")
    names = [f.relative_to(folder) for f in pathlib.Path(folder).rglob("*.txt")]
    assert len(names) == 240 and {len(n.parts) for n in names} == {2}  # a folder per root, none per document
    assert len({n.name.split("-")[1] for n in names}) > 1
    read = [(r["root"], r["plan"].strip()) for r in files.read_documents(spark, folder, named_by="root").collect()]
    assert Counter(read) == Counter(2 * [(root, plan) for root, _, plan in rows])


def test_an_export_without_line_breaks_is_split(spark, folder):
    write(f"{folder}/bill.csv", "id,cost\n" + "x" * 50 + ",1\n" * 200_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert files.read_text_csv(spark, f"{folder}/bill.csv").rdd.getNumPartitions() == 1
        assert files.read_text_csv(spark, f"{folder}/bill.csv", line_breaks=False).rdd.getNumPartitions() > 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def broken_costs(spark, n=100):
    """A month of which the last row cannot be written."""
    cost = F.when(F.col("id") == n - 1, F.raise_error(F.lit("no such row")).cast("double")).otherwise(F.lit(1.0))
    return spark.range(n).repartition(4).select(cost.alias("BilledCost"))


def test_a_rewrite_that_fails_leaves_the_old_month(spark, folder):
    months.replace_month(costs(spark, 1, 2), folder, "2026-10")
    with pytest.raises(Exception, match="no such row"):
        months.replace_month(broken_costs(spark), folder, "2026-10")
    assert tuple(total(spark, folder)) == (3.0, 2)
    assert months.load_audit(spark, folder, "2026-10", "BilledCost").first()["row_count"] == 2
    months.replace_month(costs(spark, 5), folder, "2026-10")
    assert tuple(total(spark, folder)) == (5.0, 1)


def test_a_whole_table_is_replaced_or_stays(spark, folder):
    files.replace_table(costs(spark, 1, 2), folder)
    with pytest.raises(Exception, match="no such row"):
        files.replace_table(broken_costs(spark), folder)
    assert sorted(r["BilledCost"] for r in files.read_export(spark, folder).collect()) == [1.0, 2.0]
    files.replace_table(costs(spark, 7), folder)
    assert [r["BilledCost"] for r in files.read_export(spark, folder).collect()] == [7.0]


def test_a_write_is_not_seen_before_it_is_published(spark, folder, monkeypatch):
    months.replace_month(costs(spark, 1), folder, "2026-10")
    seen = []
    publish = versions._publish

    def late(*args):
        seen.append(files.read_export(spark, folder).count())
        return publish(*args)

    monkeypatch.setattr(versions, "_publish", late)
    months.replace_month(costs(spark, 1, 2, 3), folder, "2026-10")
    assert seen == [1] and files.read_export(spark, folder).count() == 3


def test_two_writers_keep_each_others_months(spark, folder, monkeypatch):
    months.replace_month(costs(spark, 1), folder, "2026-08")
    create, other = versions._create, []

    def raced(spark_, path, text):
        if not other:
            other.append(True)
            months.replace_month(costs(spark, 2), folder, "2026-09")  # takes the number first
        return create(spark_, path, text)

    monkeypatch.setattr(versions, "_create", raced)
    months.replace_month(costs(spark, 4), folder, "2026-10")
    assert files.read_export(spark, folder).agg(F.sum("BilledCost")).first()[0] == 7.0
    assert versions.published(spark, folder).number == 3


def test_a_publication_that_was_cut_off_does_not_count(spark, folder, monkeypatch):
    monkeypatch.setattr(versions, "PATIENCE_S", 1)
    months.replace_month(costs(spark, 1), folder, "2026-10")
    versions._create(spark, versions._file(folder, 2), '{"schema": {"ty')
    assert files.read_export(spark, folder).count() == 1
    months.replace_month(costs(spark, 1, 2), folder, "2026-10")
    assert files.read_export(spark, folder).count() == 2 and versions.published(spark, folder).number == 3


def test_an_old_version_stays_for_its_readers_if_asked(spark, folder):
    versions.write_part(costs(spark, 1), folder, "p=1")
    before = versions.read_table(spark, folder)
    versions.write_part(costs(spark, 2, 3), folder, "p=1", keep=True)
    assert before.count() == 1 and versions.read_table(spark, folder).count() == 2
    assert len(versions.remove_unpublished(spark, folder)) == 1
    assert versions.read_table(spark, folder).count() == 2 and versions.remove_unpublished(spark, folder) == []


def test_columns_grow_with_the_loads_and_never_change_their_kind(spark, folder):
    versions.write_part(spark.createDataFrame([(1, "a")], "n int, old string"), folder, "p=1")
    versions.write_part(spark.createDataFrame([(2**40, [1])], "n long, new array<int>"), folder, "p=2")
    rows = {r["n"]: (r["old"], r["new"], r["p"]) for r in versions.read_table(spark, folder).collect()}
    assert rows == {1: ("a", None, 1), 2**40: (None, [1], 2)}
    with pytest.raises(ValueError, match="column n was bigint and is now string"):
        versions.write_part(spark.createDataFrame([("x",)], "n string"), folder, "p=3")
    assert versions.read_table(spark, folder, ["p=9"]).count() == 0


def test_an_audit_and_a_report_open_only_the_files_of_their_months(spark, folder):
    for period in ("2026-08", "2026-09", "2026-10"):
        months.replace_month(costs(spark, 1, 2), folder, period)
    for spoilt in glob.glob(f"{folder}/billing_month=2026-08-01/v-*/*.parquet"):
        with open(spoilt, "wb") as f:
            f.write(b"no parquet")  # whoever opens it fails
    assert months.load_audit(spark, folder, "2026-10", "BilledCost").first()["row_count"] == 2
    recent = files.read_export(spark, folder).filter(F.col("billing_month") >= F.lit(date(2026, 9, 1)))
    assert recent.agg(F.sum("BilledCost")).first()[0] == 6.0
    with pytest.raises(Exception):
        files.read_export(spark, folder).agg(F.sum("BilledCost")).first()


REJECTED = {
    'm{a="x",b="y",a="z"} 3': "repeated label",
    'm{a="x,b="y"} 3': "grammar",
    'm{a="x} 3': "grammar",
    r'm{a="x\q"} 3': "grammar",
    'm{a="x" b="y"} 3': "grammar",
    'm{a="x"} 3 4 5': "grammar",
    "9m 3": "grammar",
    "m": "grammar",
    "m three": "no number",
    'm{a="x"} 3x 17': "no number",
}


def test_lines_that_break_the_rules_are_rejects_and_the_others_are_read(spark):
    good = ['m{a="x",} 3', "m { a = \"x\" , b=\"\" } 3 -17", "m 1\r", 'm{} 2', r'm{a="\\\"\n"} NaN', "m 4"]
    silent = ["", "   ", "# any thing", "  # TYPE m counter"]
    lines = spark.createDataFrame([("t", x) for x in [*good, *silent, *REJECTED]], "target string, value string")
    assert parse_exposition(lines).count() == len(good)
    assert {r["value"]: r["reason"] for r in rejected_lines(lines).filter("target = 't'").collect()} == REJECTED


def test_a_long_label_is_read(spark):
    text = "x" * 200_000 + r"\"" * 2_000
    row = parse_exposition(spark.createDataFrame([('m{a="' + text + '"} 1',)], "value string")).first()
    assert len(row["labels"]["a"]) == 202_000


def random_csv(rng, rows):
    """Records with quotes, commas and line breaks in their values; a quote in a plain value too."""
    marks = ["", "a", "b c", '"', '""', ",", "\n", "\r\n", "\n\n", 'x"y', "é", '","', '"\n', "1"]
    return [["".join(rng.choice(marks) for _ in range(rng.randrange(4))) for _ in range(3)] for _ in range(rows)]


@pytest.mark.parametrize("seed", range(4))
def test_a_csv_cut_anywhere_reads_as_in_one_piece(spark, folder, seed):
    rng = random.Random(seed)
    os.makedirs(folder)
    for k in range(3):
        with open(f"{folder}/{k}.csv", "w", encoding="utf-8", newline="") as f:
            f.write("\ufeff" if k == 1 else "")
            made = csv.writer(f, lineterminator="\r\n" if k == 2 else "\n")
            made.writerow(["id", "te xt", 'odd "`name'])
            made.writerows(random_csv(rng, 120))
            if k == 0:
                f.write("plain \"quote,two\" more,three\n")
    # The other reader leaves carriage returns inside values if lines end without them.
    plain = lambda v: None if v is None else v.replace("\r\n", "\n")
    whole = [tuple(map(plain, r)) for r in files.read_text_csv(spark, f"{folder}/*.csv").collect()]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        split = files.read_split_csv(spark, f"{folder}/*.csv")
        rows = [tuple(r) for r in split.collect()]
        tasks = spark.read.text(f"{folder}/*.csv").rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert tasks > 20 and len(whole) > 300
    key = lambda r: tuple("" if v is None else "v" + v for v in r)
    assert sorted(rows, key=key) == sorted(whole, key=key)


@pytest.mark.parametrize(
    ("line", "outside", "inside"),
    [
        ("a,b", False, True), ('"a', True, False), ('"a"', False, False), ('a","b', True, True), ('"a""', True, False), ('"a"""', False, False),
        ('x"y', False, False), ("", False, True), ('"', True, False), ('"",""', False, True), (',"', True, False), ('a"b,"c', True, True),
    ],
)
def test_where_quotes_are_open(line, outside, inside):
    assert (csv_lines.is_open(line, False), csv_lines.is_open(line, True)) == (outside, inside)
