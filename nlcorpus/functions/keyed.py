"""Keyed operations that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.session import materialize


def hot_keys(table: DataFrame, weight: str) -> DataFrame:
    """The rows of ``table`` (unique keys) that weigh more than an even share, with their ``__shares``.

    An even share is the total over the number of shuffle partitions, so fewer rows than partitions are hot and a
    broadcast of them is bounded. ``table`` is read twice.
    """
    parts = _partitions(table)
    total = table.agg((F.sum(weight) / F.lit(parts)).alias("__share"))
    return (table.join(F.broadcast(total), F.col(weight) > F.col("__share"))  # one row
            .withColumn("__shares", F.col(weight) / F.col("__share")).drop("__share"))


def _partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)


def lookup_join(df: DataFrame, table: DataFrame, key: str, weight: str, spread: Sequence[str],
                how: str = "left") -> DataFrame:
    """Join every row of ``df`` to its row of ``table`` (unique ``key``) without a hot reducer.

    The row of ``table`` of a hot key (:func:`hot_keys`) is copied once per even share it holds, and its rows in
    ``df`` are spread over the copies by a hash of ``spread``. ``table`` should cover the frequent keys of ``df``:
    filter its values after the join, not before. It is read three times, so it is written once.
    """
    table = materialize(table, "lookup")
    copied_to = F.least(F.ceil("__shares"), F.lit(_partitions(df))).cast("int")
    hot = hot_keys(table, weight).select(key, copied_to.alias("__copies"))
    salt = F.coalesce(F.pmod(F.xxhash64(*spread), F.col("__copies")), F.lit(0))
    copies = F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1)
    rows = (df.join(F.broadcast(hot), key, "left")
            .withColumn("__salt", salt.cast("int")).drop("__copies"))
    copied = (table.join(F.broadcast(hot), key, "left")
              .withColumn("__salt", F.explode(copies)).drop("__copies"))
    return rows.join(copied, [key, "__salt"], how).drop("__salt")


def digest(*columns: str | Column) -> Column:
    """Fixed-size key for wide or nested values; equal digests stand for equal values."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def first_of_each(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """Keep, for each key, the row with the smallest ``order`` (which must be unique).

    Only digests and order values are grouped, with map-side combine, so a key held by a third of the
    rows collapses before the shuffle; the rows themselves meet the winners on the unique order value.
    """
    winners = df.groupBy(digest(*keys).alias("__key")).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_semi")


def later_duplicates(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """The rows :func:`first_of_each` removes."""
    winners = df.groupBy(digest(*keys).alias("__key")).agg(F.min(order).alias(order)).select(order)
    return df.join(winners, order, "left_anti")
