"""Quality rules from tokeniser fertility, beside rules on words, symbols and repetition.

A public vocabulary is a yardstick: text of the language it is read as gives a steady number of characters per token,
hardly falls back to bytes, and spreads over many tokens. The bands are learnt per language over all documents as
median and median absolute deviation, so junk has to be the majority of a language before it moves them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.llm import pieces
from nlcorpus.llm.common import MULTIPLIERS, WordCodes, mixed, saved, slices

MIN_WORDS = 50  # fixed values of the base rules
REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
BLOCK = 64  # tokens of a window whose entropy is measured, so that long and short texts compare
WIDTH = 8.0  # half width of a band in robust standard deviations
#: Least robust deviations, so that a language with very even texts does not reject its tail.
FLOORS = {"chars_per_token": 0.05, "byte_share": 0.005, "entropy": 0.05}

SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, "
          "chars_per_token double, byte_share double, entropy double")


def repeated_words(codes: np.ndarray, bounds: np.ndarray, width: int = 3) -> np.ndarray:
    """Per text the words inside ``width``-word windows that its text holds twice or more."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    if len(codes) < width:
        return np.zeros(len(bounds) - 1, dtype=np.int64)
    last = len(codes) - width + 1
    inside = owner[:last] == owner[width - 1:]
    total = mixed(owner[:last].astype(np.uint64) + MULTIPLIERS[4])
    for place in range(width):
        total = mixed(total + codes[place:last + place] * MULTIPLIERS[place])
    starts = np.flatnonzero(inside)
    _, inverse, counts = np.unique(total[starts], return_inverse=True, return_counts=True)
    covered = np.zeros(len(codes), dtype=bool)
    for place in range(width):
        covered[starts[counts[inverse] > 1] + place] = True
    return np.bincount(owner[covered], minlength=len(bounds) - 1)


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def block_entropy(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per text the mean entropy in bits of its blocks of ``BLOCK`` tokens; a shorter rest counts only alone."""
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(ids)) - bounds[owner]
    keep = (place < (sizes // BLOCK * BLOCK)[owner]) | (sizes < BLOCK)[owner]
    block = (np.cumsum(np.maximum(sizes // BLOCK, 1)) - np.maximum(sizes // BLOCK, 1))[owner] + place // BLOCK
    pairs, counts = np.unique(block[keep] << 32 | ids[keep], return_counts=True)
    blocks = pairs >> 32
    length = np.bincount(blocks, counts)
    share = counts / length[blocks]
    bits = np.bincount(blocks, -share * np.log2(share))
    first = np.searchsorted(np.arange(len(bits)), np.cumsum(np.maximum(sizes // BLOCK, 1)) - np.maximum(sizes // BLOCK, 1))
    total = np.concatenate([[0.0], np.cumsum(bits)])
    ends = np.minimum(first + np.maximum(sizes // BLOCK, 1), len(bits))
    return np.where(sizes > 0, (total[ends] - total[np.minimum(first, len(bits))]) / np.maximum(sizes // BLOCK, 1), 0.0)


def measures(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text",
             language: str = "lang") -> DataFrame:
    """``(key, language, measures)`` of every whole text in one pass without a shuffle.

    Words are runs without ASCII white space. White space that the vocabulary has no piece for does not count as byte
    fallback. A null or empty text has zeros, and null for the two ratios.
    """
    model = pieces.model_bytes(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, codes = pieces.load(model), WordCodes()
        blank = {processor.piece_to_id(f"<0x{ord(c):02X}>") for c in SPACES}
        fallback = np.array([processor.is_byte(i) and i not in blank for i in range(processor.get_piece_size())])
        for batch in slices(batches, text=2):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
            repeats = repeated_words(codes([w for one in words for w in one]), bounds)
            del words
            ids, ends = pieces.encode_slice(model, batch.column(2))
            tokens = np.diff(ends)
            bytes_seen = np.concatenate([[0], np.cumsum(fallback[ids])])[ends]
            some = tokens > 0
            chars = np.array([len(t) for t in texts], dtype=np.int64)
            ratio = lambda a: pa.array(a / np.maximum(tokens, 1), mask=~some)
            solid = chars - np.array([sum(map(t.count, SPACES)) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(solid),
                pa.array([sum(map(t.count, SYMBOLS)) for t in texts], pa.int64()),
                pa.array([repeated_lines(t) for t in texts], pa.int64()), pa.array(repeats),
                pa.array(tokens), ratio(chars), ratio(np.diff(bytes_seen)), pa.array(block_entropy(ids, ends))],
                ["k", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens",
                 "chars_per_token", "byte_share", "entropy"])

    frame = docs.select(docs[key].alias("k"), docs[language].cast("string").alias("language"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, language string, {SCHEMA}").withColumnRenamed("k", key)


def base_failed() -> Column:
    """The base rules as a condition on ``measures``."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def bands(measured: DataFrame, width: float = WIDTH) -> DataFrame:
    """Per language ``of`` the least and the greatest of each measure, over all documents that pass the base rules.

    Median plus or minus ``width`` robust deviations; byte fallback is bounded above, entropy below. Two mergeable
    quantile sketches per language, so a language with most of the rows is combined before the shuffle.
    """
    names = list(FLOORS)
    usable = measured.where(~base_failed())
    middle = usable.groupBy(F.col("language").alias("of")).agg(
        *[F.percentile_approx(n, 0.5, 10_000).alias(f"{n}_mid") for n in names])
    spread = (usable.join(middle, F.col("language").eqNullSafe(F.col("of"))).groupBy("of")
              .agg(*[F.percentile_approx(F.abs(F.col(n) - F.col(f"{n}_mid")), 0.5, 10_000).alias(f"{n}_dev")
                     for n in names], *[F.first(f"{n}_mid").alias(f"{n}_mid") for n in names]))
    half = {n: width * F.greatest(1.4826 * F.col(f"{n}_dev"), F.lit(FLOORS[n])) for n in names}
    return spread.select(
        "of", (F.col("chars_per_token_mid") - half["chars_per_token"]).alias("least_chars"),
        (F.col("chars_per_token_mid") + half["chars_per_token"]).alias("most_chars"),
        (F.col("byte_share_mid") + half["byte_share"]).alias("most_bytes"),
        (F.col("entropy_mid") - half["entropy"]).alias("least_entropy"))


def judge(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text", language: str = "lang",
          width: float = WIDTH) -> DataFrame:
    """``measures`` with ``base_failed``, ``fertile`` (inside the bands of its language) and ``kept``.

    Null languages form a language of their own. Texts without words fail the base rules. Repeated rows are judged
    alike. The bands are a row per language code and are left to Spark to broadcast by size.
    """
    measured = saved(measures(docs, model_path, key, text, language), "fertility")
    limits = bands(measured, width)
    joined = measured.join(limits, F.col("language").eqNullSafe(F.col("of")), "left").drop("of")
    fertile = (F.col("chars_per_token").between(F.col("least_chars"), F.col("most_chars"))
               & (F.col("byte_share") <= F.col("most_bytes")) & (F.col("entropy") >= F.col("least_entropy")))
    return (joined.withColumn("base_failed", base_failed()).withColumn("fertile", F.coalesce(fertile, F.lit(False)))
            .withColumn("kept", F.col("fertile") & ~F.col("base_failed"))
            .drop("least_chars", "most_chars", "most_bytes", "least_entropy"))
