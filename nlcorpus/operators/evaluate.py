"""Scores of predictions against expected code: exact match, BLEU, validity.

Predictions are two tables: ``inputs(id, expected)`` with one row per input, and ``candidates(id, rank, predicted)`` with
one row per candidate, ranked from 1. An input may have any number of candidates: nothing here collects them or runs a
window over an input. :func:`split_records` makes the two tables of records that hold their candidates in an array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions import arrays
from nlcorpus.functions.keyed import digest
from nlcorpus.functions.ordered import chunk_of, number_rows
from nlcorpus.operators.profile import one_row

MAX_ORDER = 4  # fixed value: longest n-gram of the score
EM_CUTS = (1, 3, 10)  # fixed values
BLEU_CUTS = (1, 3, 10, 20)  # fixed values


def tokenize_code(code: Column) -> Column:
    """Tokens of a snippet: symbols and camel-case parts stand alone, quotes become back ticks."""
    spaced = F.regexp_replace(code, r"([^A-Za-z0-9_])", r" $1 ")
    spaced = F.regexp_replace(spaced, r"([a-z])([A-Z])", r"$1 $2")
    spaced = F.regexp_replace(spaced, r"(?U)\s+", " ")
    return F.filter(F.split(F.translate(spaced, "\"'", "``"), " "), lambda t: t != "")


def split_records(records: DataFrame, expected: str = "expected", predicted: str = "predicted") -> tuple[DataFrame, DataFrame]:
    """``inputs`` and ``candidates`` of records ``(id, expected, predicted array)``; ids are unique."""
    inputs = records.select("id", F.col(expected).alias("expected"))
    rows = records.select("id", F.posexplode(predicted).alias("place", "predicted"))
    return inputs, rows.select("id", (F.col("place") + 1).cast("long").alias("rank"), "predicted")


def first_hits(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """``(id, hit)``: rank of the first candidate that equals the expected value, for inputs that have one.

    Text and sequences are compared by digest. The least rank of every distinct candidate is found first, combined before
    the shuffle, so both sides of the join are unique and an input's candidates spread over their digests. Null
    candidates never match.
    """
    seen = (candidates.where(F.col("predicted").isNotNull()).groupBy("id", digest("predicted").alias("__digest"))
            .agg(F.min("rank").alias("hit")))
    wanted = inputs.where(F.col("expected").isNotNull()).select("id", digest(F.col("expected").alias("predicted")).alias("__digest"))
    return seen.join(wanted, ["id", "__digest"]).select("id", "hit")


def exact_match(inputs: DataFrame, candidates: DataFrame, cuts: Sequence[int] = EM_CUTS) -> DataFrame:
    """Share of inputs matched within the first k candidates, for each cut; works on text and sequences."""
    hits = inputs.select("id").join(first_hits(inputs, candidates), "id", "left")
    share = lambda k: F.avg(F.coalesce(F.col("hit") <= k, F.lit(False)).cast("int"))
    return hits.agg(*[share(k).alias(f"em_{k}") for k in cuts])


def validity_counts(candidates: DataFrame) -> DataFrame:
    return candidates.agg(F.count_if(F.col("predicted").isNull()).alias("num_invalid_predictions"),
                          F.count_if(F.col("predicted").isNotNull()).alias("num_valid_predictions"))


def valid_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates that are neither null nor empty, numbered anew from 0 in ``place``, chunk by chunk of their ranks."""
    valid = candidates.where(F.col("predicted").isNotNull() & (F.col("predicted") != ""))
    numbered = number_rows(valid, ["id"], "rank", "place", chunk_of(F.col("rank")))
    return numbered.withColumn("place", F.col("place") - 1)


def tokenize_predictions(candidates: DataFrame) -> DataFrame:
    """``(id, rank, tokens)`` of the valid candidates, ranked from 0 among themselves."""
    return valid_candidates(candidates).select("id", F.col("place").alias("rank"), tokenize_code(F.col("predicted")).alias("tokens"))


def candidate_stats(inputs: DataFrame, candidates: DataFrame, cuts: Sequence[int] = BLEU_CUTS) -> DataFrame:
    """One row per input and valid candidate within the largest cut: n-gram matches and possible matches, lengths,
    sentence score.

    An input without valid candidates gets one empty-word candidate of score 0. Token lists are placed by input
    and rank once; n-grams are made, counted and clipped after that, so they are never shuffled.
    """
    firsts = tokenize_predictions(candidates).where(F.col("rank") < max(cuts))
    none = F.array(F.lit(""))
    tasks = int(inputs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so small texts stay spread
    rows = (inputs.select("id", tokenize_code(F.col("expected")).alias("ref")).join(firsts, "id", "left")
            .select("id", "ref", F.col("tokens").isNotNull().alias("real"), F.coalesce("rank", F.lit(0)).alias("rank"),
                    F.coalesce("tokens", none).alias("cand"))
            .repartition(tasks, "id", "rank"))
    lengths = [F.size("ref").alias("ref_len"), F.size("cand").alias("cand_len")]
    entry = lambda n, side, gram: F.struct(F.lit(n).alias("n"), F.lit(side).alias("side"), gram.alias("gram"))
    tagged = []
    for side, tokens in ((1, F.col("cand")), (2, F.col("ref"))):
        for n, grams in enumerate(arrays.ngrams(tokens, MAX_ORDER), 1):
            tagged.append(F.transform(grams, partial(entry, n, side)))
    # One marker per order keeps candidates that are too short to have n-grams of that order.
    markers = F.array(*[entry(n, 0, F.lit(None).cast("string")) for n in range(1, MAX_ORDER + 1)])
    counts = (rows.select("id", "rank", *lengths, "real", F.inline(F.concat(*tagged, markers)))
              .groupBy("id", "rank", "ref_len", "cand_len", "real", "n", "gram")
              .agg(F.sum((F.col("side") == 1).cast("int")).alias("c"),
                   F.sum((F.col("side") == 2).cast("int")).alias("r")))
    at = lambda n, value: F.sum(F.when(F.col("n") == n, value).otherwise(0))
    orders = range(1, MAX_ORDER + 1)
    stats = counts.groupBy("id", "rank", "ref_len", "cand_len", "real").agg(
        *[at(n, F.least("c", "r")).alias(f"match_{n}") for n in orders])
    stats = stats.withColumns({f"possible_{n}": F.greatest(F.col("cand_len") - n + 1, F.lit(0)).cast("long")
                               for n in orders})
    return stats.withColumn("bleu", F.when(F.col("real"), bleu_of()).otherwise(F.lit(0.0)))


def bleu_of(prefix: str = "") -> Column:
    """Unsmoothed score from match, possible and length columns; 0 when any precision is 0."""
    col = lambda name: F.col(prefix + name)
    orders = range(1, MAX_ORDER + 1)
    precise = [F.when(col(f"possible_{n}") > 0, col(f"match_{n}") / F.greatest(col(f"possible_{n}"), F.lit(1)))
               .otherwise(F.lit(0.0)) for n in orders]
    mean = F.exp(sum((F.log(F.when(p > 0, p).otherwise(F.lit(1.0))) for p in precise), F.lit(0.0)) / MAX_ORDER)
    ratio = col("cand_len") / F.greatest(col("ref_len"), F.lit(1))
    brevity = F.when(ratio > 1, F.lit(1.0)).when(ratio > 0, F.exp(1 - 1 / F.when(ratio > 0, ratio).otherwise(1.0)))
    return F.when(F.least(*precise) > 0, mean * F.coalesce(brevity, F.lit(0.0))).otherwise(F.lit(0.0))


def best_candidates(stats: DataFrame, cuts: Sequence[int] = BLEU_CUTS) -> DataFrame:
    """Per record and cut the best-scored of the first k candidates; the first wins ties."""
    fields = [c for c in stats.columns if c != "id"]
    order = F.struct((-F.col("bleu")).alias("worse"), F.col("rank").alias("rank"))
    return stats.groupBy("id").agg(*[
        F.min_by(F.struct(*fields), F.when(F.col("rank") < k, order)).alias(f"best_{k}") for k in cuts])


def corpus_bleu(best: DataFrame, cuts: Sequence[int] = BLEU_CUTS) -> DataFrame:
    """Corpus score over the chosen candidates for each cut, in one row."""
    names = ["ref_len", "cand_len"] + [f"{k}_{n}" for n in range(1, MAX_ORDER + 1) for k in ("match", "possible")]
    sums = best.agg(*[F.sum(f"best_{k}.{name}").alias(f"k{k}_{name}") for k in cuts for name in names])
    return sums.select(*[F.coalesce(bleu_of(f"k{k}_"), F.lit(0.0)).alias(f"bleu_{k}") for k in cuts])


def eval_report(inputs: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row of exact match, BLEU and validity numbers."""
    bleu = corpus_bleu(best_candidates(candidate_stats(inputs, candidates)))
    return one_row(exact_match(inputs, candidates), bleu, validity_counts(candidates))
