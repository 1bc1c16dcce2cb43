"""JSON, delimited text, line files and id lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlcorpus.session import materialize

PAIR_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("intent", T.StringType()),
    T.StructField("snippet", T.StringType()),
    T.StructField("rewritten_intent", T.StringType()),
    T.StructField("prob", T.DoubleType()),
])


def is_lines(path: str) -> bool:
    """A ``.jsonl`` name means one JSON object per line; anything else holds JSON arrays."""
    return path.lower().rstrip("/").endswith(".jsonl")


def require_path(spark: SparkSession, path: str) -> None:
    """Raise if nothing exists at ``path`` on whichever file system it names."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        raise ValueError(f"no such input: {path}")


def read_json(spark: SparkSession, path: str, schema: T.StructType | str = PAIR_SCHEMA) -> DataFrame:
    """JSON lines or JSON arrays by suffix, with a declared schema so nothing is read twice."""
    require_path(spark, path)
    return spark.read.schema(schema).option("multiLine", not is_lines(path)).json(path)


def _as_arrays(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    opening = "["
    for frame in frames:
        if len(frame):
            rows = frame["value"].tolist()
            yield pd.DataFrame({"value": [opening + rows[0]] + ["," + r for r in rows[1:]]})
            opening = ","
    yield pd.DataFrame({"value": ["]" if opening == "," else "[]"]})


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines or, without the ``.jsonl`` suffix, one JSON array per part file.

    Each part is a complete array that ends with a newline, so writing stays parallel in both forms.
    """
    if is_lines(path):
        df.write.json(path, ignoreNullFields=False)
        return
    rows = df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))
    rows.mapInPandas(_as_arrays, "value string").write.text(path)


def convert_json(spark: SparkSession, source: str, target: str, schema: T.StructType | str) -> None:
    """Copy between the two JSON forms."""
    write_json(read_json(spark, source, schema), target)


def name_order(file: Column) -> Column:
    """Sort key of a file name: numbers of parts compare as numbers, so ``part-100000`` follows ``part-99999``."""
    number = F.regexp_extract(file, r"part-(\d+)[^/]*$", 1)
    return F.struct(F.regexp_replace(file, r"part-\d+([^/]*)$", "part-"), F.lpad(number, 20, "0"), file)


def _lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Lines with ``__file``, ``__from`` and ``__seq``, and the table of the file splits, written from one pass.

    Lines of a split are contiguous, so a line's number is its place in the split plus the lines of all earlier splits.
    The table (``__head``, ``__n``, ``__offset`` by split) has one row per split, and tells the number of lines too.
    """
    require_path(spark, path)
    lines = (spark.read.text(path)
             .select("value", F.col("_metadata.file_path").alias("__file"),
                     F.col("_metadata.file_block_start").alias("__from"))
             .withColumn("__seq", F.monotonically_increasing_id()))
    before = Window.orderBy(name_order(F.col("__file")), "__from").rowsBetween(Window.unboundedPreceding, -1)
    splits = (lines.groupBy("__file", "__from")
              .agg(F.min("__seq").alias("__head"), F.count("*").alias("__n"))
              .withColumn("__offset", F.coalesce(F.sum("__n").over(before), F.lit(0))))
    return lines, materialize(splits, "line-splits")


def _numbered(lines: DataFrame, splits: DataFrame, *more: Column) -> DataFrame:
    return (lines.join(F.broadcast(splits.drop("__n")), ["__file", "__from"])  # one row per file split
            .select((F.col("__offset") + F.col("__seq") - F.col("__head")).alias("line_no"), "value", *more))


def read_lines(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """``(line_no, value)`` with 0-based numbers over all files below ``path`` in name order.

    ``file`` names a column for the file a line is from. The input is read twice: once for the table of its splits, which
    is written, and once for the lines. The broadcast holds one row per file split, some hundred bytes each: a hundred
    thousand splits are ten megabytes.
    """
    return _numbered(*_lines(spark, path), *([F.col("__file").alias(file)] if file else []))


def write_lines(df: DataFrame, value: str | Column, order: list[str | Column], path: str) -> None:
    """One text line per row in the given order; the parts' name order is the line order."""
    text = F.col(value) if isinstance(value, str) else value
    df.orderBy(*order).select(text.alias("value")).write.text(path)


def unescape_newlines(text: Column, marker: str | None = "\\n") -> Column:
    """Turn the marker into a newline; no change when the marker is None."""
    return text if marker is None else F.replace(text, F.lit(marker), F.lit("\n"))


def read_csv_pairs(spark: SparkSession, path: str, separator: str = ";", source_column: int = 0,
                   target_column: int = 1, newline_marker: str | None = "\\n", id_prefix: str = "",
                   header: bool = False) -> DataFrame:
    """Pairs from a delimited file: two columns by position, ids are the prefix and the 1-based row.

    Every line is one record (line breaks are written as the marker), so numbering needs no sort.
    """
    numbered = read_lines(spark, path)
    if header:
        numbered = numbered.where("line_no > 0").withColumn("line_no", F.col("line_no") - 1)
    width = max(source_column, target_column) + 1
    schema = ", ".join(f"c{i} string" for i in range(width))
    cells = F.from_csv("value", schema, {"sep": separator, "mode": "PERMISSIVE"})
    return (numbered.withColumn("__cells", cells)
            .select(F.concat(F.lit(id_prefix), (F.col("line_no") + 1).cast("string")).alias("id"),
                    F.col(f"__cells.c{source_column}").alias("intent"),
                    unescape_newlines(F.col(f"__cells.c{target_column}"), newline_marker).alias("snippet")))


def read_file_pair(spark: SparkSession, source_path: str, target_path: str,
                   newline_marker: str | None = "\\n", id_prefix: str = "") -> DataFrame:
    """Pairs from two line-aligned files; raises when they differ in length.

    The lengths come from the tables of splits that number the lines, so each file is read once for its table and once
    for its lines, and a wrong pair of files is told before any work is planned on it.
    """
    sides = [_lines(spark, path) for path in (source_path, target_path)]
    n_source, n_target = (splits.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0] for _, splits in sides)
    if n_source != n_target:
        raise ValueError(f"line counts differ: {n_source} and {n_target}")
    source, target = (_numbered(*side).withColumnRenamed("value", name) for side, name in zip(sides, ("intent", "snippet")))
    return (source.join(target, "line_no")
            .select(F.concat(F.lit(id_prefix), (F.col("line_no") + 1).cast("string")).alias("id"),
                    "intent", unescape_newlines(F.col("snippet"), newline_marker).alias("snippet")))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids, one per line, trailing white space removed."""
    require_path(spark, path)
    return spark.read.text(path).select(
        F.regexp_replace("value", r"(?U)\s+$", "").alias("id")).distinct()


def write_id_list(df: DataFrame, path: str, id_column: str = "id") -> None:
    """Distinct ids as strings in string order, one per line."""
    ids = df.select(F.col(id_column).cast("string").alias("id")).distinct()
    write_lines(ids, "id", ["id"], path)


def write_stats_json(df: DataFrame, path: str) -> None:
    """A one-row frame as a single pretty-printed JSON object; raises when there is another row."""
    rows = df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("statistics must be exactly one row")
    df.sparkSession.createDataFrame(rows, "value string").coalesce(1).write.text(path)


def read_stats_json(spark: SparkSession, path: str) -> dict:
    """The object written by :func:`write_stats_json` (one small record)."""
    text = spark.read.option("wholetext", True).text(path).agg(
        F.array_join(F.collect_list("value"), "")).first()[0]
    return json.loads(text)
