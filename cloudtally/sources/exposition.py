"""Metric text exposition to sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One label, and a whole sample line: name, labels in braces, value, time.
LABEL = r'([a-zA-Z_][a-zA-Z0-9_]*)[ \t]*=[ \t]*"([^"\\]*+(?:\\["\\n][^"\\]*+)*+)"'
_LABELS = rf"\{{[ \t]*(?:{LABEL}[ \t]*(?:,[ \t]*|(?=\}})))*+\}}"
SAMPLE = rf"^[ \t]*[a-zA-Z_:][a-zA-Z0-9_:]*(?:[ \t]*{_LABELS}[ \t]*|[ \t]+)[^ \t{{}}\"]+(?:[ \t]+-?[0-9]+)?[ \t\r]*$"
# A line with nothing to read: blank, or a comment.
SILENT = r"^\s*(?:#.*)?$"


def _unescaped(text: Column) -> Column:
    r"""Undo ``\"``, ``\\`` and ``\n`` inside a label value."""
    hidden = F.replace(text, F.lit("\\\\"), F.lit("\u0000"))
    opened = F.replace(F.replace(hidden, F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\\")), F.replace(opened, F.lit("\u0000"), F.lit("\\"))).otherwise(text)


def rejected_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """What ``parse_exposition`` leaves out, as it came, with a ``reason``.

    That is every line that is neither blank nor a comment and breaks the
    grammar, repeats a label, or has a value that is no number. Works on a
    stream too, so a bad line goes to a table of its own and the job goes on.
    """
    kept = lines.columns
    reason = (
        F.when(~F.col("_whole"), "grammar")
        .when(F.col("_repeated"), "repeated label")
        .when(F.col("_number").isNull(), "no number")
    )
    odd = _samples(lines.withColumn("_line", F.col(text)), text).withColumn("reason", reason).filter(F.col("reason").isNotNull())
    return odd.select(*[F.col("_line").alias(c) if c == text else c for c in kept], "reason")


def parse_exposition(lines: DataFrame, text: str = "value") -> DataFrame:
    """``metric``, ``labels`` (a map) and ``value`` for every line that is a sample.

    Other columns, such as the target and the scrape time, are kept. Comments
    and blank lines are dropped, and so are :func:`rejected_lines`. Works the
    same on a stream of text.

    A line is cut at its braces, the closing one being the last, since neither
    a value nor a time holds one.
    """
    kept = [c for c in lines.columns if c != text]
    values = F.transform(F.regexp_extract_all("_labels", F.lit(LABEL), F.lit(2)), _unescaped)
    good = F.col("_whole") & ~F.col("_repeated") & F.col("_number").isNotNull()
    # A map of repeated names raises, so it is only made of what is good.
    labels = F.when(good, F.map_from_arrays("_names", values))
    return _samples(lines, text).filter(good).select(*kept, "metric", labels.alias("labels"), F.col("_number").alias("value"))


def _samples(lines: DataFrame, text: str) -> DataFrame:
    """Lines that should be samples: metric, text and names of the labels, the value as a number, and what is wrong."""
    kept = [c for c in lines.columns if c != text]
    # Tabs separate like spaces, but not inside the braces, where they belong to a value.
    open_at, close = F.instr(F.col(text), "{"), F.substring_index(F.col(text), "}", -1)
    spaced = F.when(
        open_at > 0,
        F.concat(
            F.translate(F.substr(F.col(text), F.lit(1), open_at), "\t", " "),
            F.substr(F.col(text), open_at + 1, F.length(text) - F.length(close) - open_at),
            F.translate(close, "\t", " "),
        ),
    ).otherwise(F.translate(F.col(text), "\t", " "))
    line = F.trim(spaced)
    braced = F.contains(line, F.lit("{"))
    name = F.trim(F.when(braced, F.substring_index(line, "{", 1)).otherwise(F.substring_index(line, " ", 1)))
    after = F.when(braced, F.substring_index(line, "}", -1)).otherwise(F.substr(line, F.length(name) + F.lit(1)))
    inside = F.when(braced, F.substr(line, F.instr(line, "{")))
    labels = F.coalesce(inside, F.lit(""))
    names = F.regexp_extract_all(labels, F.lit(LABEL), F.lit(1))
    return lines.filter(~F.col(text).rlike(SILENT)).select(
        *kept,
        name.alias("metric"),
        labels.alias("_labels"),
        names.alias("_names"),
        (F.size(F.array_distinct(names)) < F.size(names)).alias("_repeated"),
        F.col(text).rlike(SAMPLE).alias("_whole"),
        F.substring_index(F.ltrim(after), " ", 1).try_cast("double").alias("_number"),
    )


def label_columns(samples: DataFrame, *names: str) -> DataFrame:
    """Labels as columns; one a sample does not carry is the empty string."""
    return samples.withColumns({n: F.coalesce(F.col("labels")[n], F.lit("")) for n in names}).drop("labels")
