"""Helpers of the training-data operators: row keys, word codes, shared tables, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlcorpus.session import BATCH_BYTES, BATCH_SETTING, bound_batches, materialize, ship_package  # noqa: F401

MEMO_WORDS = 400_000  # entries of a worker's word table before it starts anew; bounds memory, not results
SLICE_CHARS = 4_000_000  # texts handled at once inside a task; a longer text makes a slice of its own
WORDS_CHARS = 1_000_000  # the same where all words of a slice are Python objects at a time, some 60 bytes each

#: Odd 64-bit multipliers, one per position of a shingle, and the finaliser's constants.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63,
                        0x27D4EB2F165667C5], dtype=np.uint64)
FINAL = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], dtype=np.uint64)


def prepare(spark: SparkSession) -> None:
    """The workers get this package, and rows in batches of a bounded size (see :func:`nlcorpus.session.bound_batches`)."""
    ship_package(spark)
    bound_batches(spark)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """One of the given tables, in place: how it is split is left to the reader's settings."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared folder and read back: cuts lineage and survives lost executors."""
    return materialize(df, name)


def bucket(key: Column, parts: int) -> Column:
    """The fold of a row: crc32 of the id as text, modulo ``parts`` (null ids: fold of the empty text)."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts


def slices(batches: Iterable[pa.RecordBatch], text: int = 1, size: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that the texts of one piece hold about ``size`` bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, before + size, side="right")))
            yield batch.slice(start, end - start)
            start = end


def split_words(text: str | None) -> list[bytes]:
    """Maximal runs without ASCII white space, A-Z lower-cased, as UTF-8; none for a null text."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


class WordCodes:
    """64-bit codes of words, remembered while a task runs."""

    def __init__(self):
        self.memo = _Codes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        return np.fromiter(map(self.memo.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit output."""
    values = (values ^ (values >> np.uint64(30))) * FINAL[0]
    values = (values ^ (values >> np.uint64(27))) * FINAL[1]
    return values ^ (values >> np.uint64(31))


def shingle_codes(codes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct codes of all ``width``-word runs; fewer words make one run, none make no run."""
    if not len(codes):
        return codes
    width = min(width, len(codes))
    total = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for place in range(width):  # the codes are mixed already, so a sum with one odd factor per place is enough
        total += codes[place:len(codes) - width + 1 + place] * MULTIPLIERS[place]
    return np.unique(mixed(total))


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)`` with the least node as component.

    Alternating large and small stars until every node but the least of its component has one edge, to that least
    node. Every step is written to the shared folder. Nodes without an edge, and edges with a null end, are not in the
    result. A hub's rows meet a one-row minimum in a join of two plain tables, so adaptive execution can split it.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return saved(pairs.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")

    def unfinished(pairs: DataFrame) -> bool:
        ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("up")).unionByName(
            pairs.select(F.col("v").alias("x"), F.lit(0).alias("up")))
        tally = ends.groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
        return not tally.where("up > 1 or (up = 1 and n > 1)").isEmpty()

    current = saved(edges.where(F.col("a") != F.col("b"))
                    .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-edges")
    while unfinished(current):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = saved(both.join(least(both), "u").where(F.col("v") > F.col("u"))
                      .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct(), f"{name}-large")
        joined = large.join(least(large), "u")
        current = saved(joined.select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m")))
                                      .alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
                        .where(F.col("u") != F.col("v")).distinct(), f"{name}-small")
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
