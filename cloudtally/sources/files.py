"""Files of the kinds the feeds come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloudtally.sources import csv_lines, versions


def read_text_csv(spark: SparkSession, path: str, line_breaks: bool = True) -> DataFrame:
    """CSV with every column as text: names from the header, no guessing of types.

    Quoted line breaks and doubled quotes are kept, a byte order mark and
    carriage returns are not. Values with line breaks keep a file in one task,
    so a load turns it into Parquet once and everything else reads that. For an
    export known to have none, ``line_breaks=False`` lets large files be split.
    """
    return spark.read.csv(path, header=True, inferSchema=False, multiLine=line_breaks, escape='"', quote='"')


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`read_text_csv` gives, with files cut into splits that are read by many tasks, line breaks in values or not.

    Carriage returns before line breaks are dropped, inside values too.

    A line break ends a record unless it lies between quotes, which only the
    text before it tells. So every split is read twice: first each gives where
    it ends up if it begins at a record and if it begins inside quotes; these
    few rows in order give where each split does begin. Then its lines are
    put together to records, and the record that a split leaves open goes on
    with what the next ones begin with.
    """
    columns = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"', quote='"').columns
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value"
    )
    ends = lines.mapInArrow(csv_lines.split_ends, "file string, split long, outside boolean, inside boolean, closes boolean")
    # One row for each split of a file; a file's are put in order by one task.
    order = F.sort_array(F.collect_list(F.struct("split", "outside", "inside", "closes")))
    begins = (
        ends.groupBy("file").agg(order.alias("splits"))
        .mapInArrow(csv_lines.split_begins, "file string, split long, open boolean, start long")
    )
    placed = lines.join(F.broadcast(begins), ["file", "split"])
    parts = placed.mapInArrow(csv_lines.records, "file string, start long, split long, whole boolean, header boolean, record string")
    whole = parts.filter("whole").select("record")
    pieces = F.sort_array(F.collect_list(F.struct("split", "record")))
    cut = parts.filter("NOT whole").groupBy("file", "start").agg(pieces.alias("pieces"), F.bool_or("header").alias("header"))
    joined = cut.filter("NOT header").select(F.array_join(F.transform("pieces", lambda p: p["record"]), "\n").alias("record"))
    names = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    read = F.from_csv("record", names, {"quote": '"', "escape": '"'})
    return whole.unionByName(joined).filter("record <> ''").select(read.alias("r")).select("r.*")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON record per line with the columns given; a broken line raises."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_documents(spark: SparkSession, path: str, name: str = "plan", named_by: str | None = None) -> DataFrame:
    """Whole JSON documents, a row per file, with the file's base name as ``root``, or a folder's ``named_by=`` part."""
    if named_by:
        read = spark.read.option("basePath", path).text(path, wholetext=True)
        return read.select(F.col(named_by).cast("string").alias("root"), F.col("value").alias(name))
    base = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(base.alias("root"), F.col("value").alias(name))


def write_documents(docs: DataFrame, path: str, *key: str, name: str = "plan", named_by: str = "root") -> None:
    """The column ``name`` as text, a file per row, in a folder for each value of ``named_by``, as :func:`read_documents` finds them.

    Opening a file takes longer than filling it, so rows are dealt by ``key``
    to all tasks of a shuffle, however little text there is. No row has a
    folder of its own: those would be made, listed and published one by one.
    """
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs.repartition(tasks, *key).select(name, named_by).write.option("maxRecordsPerFile", 1).partitionBy(named_by).text(path)


def read_export(spark: SparkSession, where: str) -> DataFrame:
    """An export read in place by path or by table name.

    A table that :mod:`versions` keeps is read with the columns it has kept,
    without a look at any file. In an export of another system a column that
    first appears in a later file is there too, NULL before; its files are
    opened to find it.
    """
    if "/" not in where:
        return spark.table(where)
    if versions.published(spark, where):
        return versions.read_table(spark, where)
    return spark.read.option("mergeSchema", "true").parquet(where)


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a whole table, which makes a rerun harmless; a write that fails leaves the old rows.

    Readers find the rows with :func:`read_export`.
    """
    versions.write_part(df, path)
