"""Joins and set operations on pair, token and grammar tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import lookup_join


def keep_with_any(df: DataFrame, items: DataFrame, table: DataFrame, wanted: Column, id_column: str, item: str,
                  weight: str) -> DataFrame:
    """Rows of ``df`` that own at least one item whose row of ``table`` is ``wanted``."""
    owners = lookup_join(items, table, item, weight, [id_column], "inner").where(wanted)
    return df.join(owners.select(id_column).distinct(), id_column, "left_semi")


def positional_join(left: DataFrame, right: DataFrame, index: str) -> DataFrame:
    """Line up two frames on a shared row index; rows without a partner stay, with nulls."""
    return left.join(right, index, "full_outer")


def vocab_lookup(tokens: DataFrame, vocab: DataFrame, spread: list[str], token: str = "token",
                 how: str = "left") -> DataFrame:
    """Attach ``id`` to every token row; tokens outside the vocabulary get null.

    ``vocab`` has ``(piece, id, cnt)``; frequent pieces are salted, so a common word does not pile up.
    """
    table = vocab.select(F.col("piece").alias(token), "id", F.col("cnt").alias("__cnt"))
    return lookup_join(tokens, table, token, "__cnt", spread, how).drop("__cnt")


def reverse_lookup(ids: DataFrame, vocab: DataFrame, spread: list[str], how: str = "left") -> DataFrame:
    """Attach ``piece`` to every id row."""
    table = vocab.select("id", "piece", F.col("cnt").alias("__cnt"))
    return lookup_join(ids, table, "id", "__cnt", spread, how).drop("__cnt")


def open_text_fields(fields: DataFrame, edges: DataFrame, literals: DataFrame) -> DataFrame:
    """How many text literals each text-list field still lacks, when all of them are to be allowed.

    Allowing every literal in every text field needs no table of all combinations: membership is
    "the child is a text literal and the field is a text list". This reports the size of what that rule adds.
    """
    total = literals.agg(F.count("*").alias("n_literals"))
    known = (edges.join(literals, edges["child"] == literals["literal"], "left_semi")
             .groupBy("parent").agg(F.count("*").alias("n_known")))
    return (fields.join(known, "parent", "left").join(F.broadcast(total))  # one row
            .select("parent", F.coalesce("n_known", F.lit(0)).alias("n_known"), "n_literals")
            .select("parent", "n_known", (F.col("n_literals") - F.col("n_known")).alias("n_added")))


def missing_from(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """List difference that keeps duplicates of the left side."""
    return keep_keys(left, right, keys, spread, F.col("__listed").isNull())


def present_in(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str]) -> DataFrame:
    """Rows of the left side whose keys occur on the right."""
    return keep_keys(left, right, keys, spread, F.col("__listed").isNotNull())


def keep_keys(left: DataFrame, right: DataFrame, keys: list[str], spread: list[str], keep: Column) -> DataFrame:
    """Semi or anti join that decides on each distinct key once, then tells the rows, frequent keys salted.

    ``keep`` looks at ``__listed``, which is null for keys that are not on the right.
    """
    counts = left.groupBy(*keys).agg(F.count("*").alias("__cnt"))
    listed = right.select(*keys).distinct().withColumn("__listed", F.lit(True))
    key = F.struct(*keys)
    verdicts = counts.join(listed, keys, "left").select(key.alias("__key"), "__cnt", keep.alias("__keep"))
    rows = lookup_join(left.withColumn("__key", key), verdicts, "__key", "__cnt", spread, "inner")
    return rows.where("__keep").drop("__key", "__cnt", "__keep")


def union_ids(*ids: DataFrame, column: str = "id") -> DataFrame:
    """Distinct ids, as strings, of several drop lists."""
    frames = [f.select(F.col(column).cast("string").alias("id")) for f in ids]
    return reduce(DataFrame.unionByName, frames).distinct()


def concat_results(*frames: DataFrame) -> DataFrame:
    """Append result batches by column name; absent columns are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
