"""Candidate ranking, masking and scoring over tables of token log-probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlcorpus.functions.ordered import bounded_chunks, number_rows
from nlcorpus.operators.grammar import ChildSets, allowed


def rank_candidates(candidates: DataFrame, keys: list[str], score: str, tie: str, k: int | None, valid: Column | None = None,
                    text: str | None = None, keep_invalid: bool = False) -> DataFrame:
    """The k best (lowest score) candidates of each input with their 1-based ``rank``.

    Invalid candidates are dropped unless kept; with ``text`` given, empty text is invalid too. The limit is
    applied before the shuffle as well, so an input with very many candidates costs k rows per task. Without ``k``
    all candidates are ranked, in chunks, so an input may have any number of them; the rank is a long then.
    """
    rows = candidates
    if not keep_invalid:
        ok = F.lit(True) if valid is None else valid
        if text is not None:
            ok = ok & F.coalesce(F.col(text) != "", F.lit(False))
        rows = rows.where(ok)
    if k is None:
        placed = bounded_chunks(rows.withColumn("__order", F.struct(score, tie)), keys, ["__order"], "__piece")
        return number_rows(placed, keys, "__order", "rank", F.col("__piece")).drop("__order", "__piece")
    w = Window.partitionBy(*keys).orderBy(F.asc(score), F.asc(tie))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mask_candidates(candidates: DataFrame, sets: ChildSets, field: str, token: str, keys: list[str], score: str, tie: str,
                    k: int, in_text: str | None = None) -> DataFrame:
    """Only candidates whose ``token`` the grammar allows in the open ``field``, then the k best of each input.

    The rule that any text literal may stand in any text field is part of ``sets``; ``in_text`` is as for
    :func:`nlcorpus.operators.grammar.allowed`.
    """
    masked = allowed(candidates, sets, field, token, [tie], "__allowed", in_text).where("__allowed").drop("__allowed")
    return rank_candidates(masked, keys, score, tie, k)


def sequence_scores(steps: DataFrame, sequence: str, token: str, logp: str, pad: str | None = None) -> DataFrame:
    """Sum of log-probabilities per sequence without padding steps."""
    rows = steps if pad is None else steps.where(F.col(token) != pad)
    return rows.groupBy(sequence).agg(F.sum(logp).alias("score"), F.count("*").alias("n_tokens"))


def best_tokens(steps: DataFrame, keys: list[str], token: str, logp: str) -> DataFrame:
    """Most probable token of each position and its log-probability; the smaller token wins ties."""
    best = F.min(F.struct((-F.col(logp)).alias("cost"), F.col(token).alias("token")))
    return steps.groupBy(*keys).agg(best.alias("__best")).select(
        *keys, F.col("__best.token").alias("token"), (-F.col("__best.cost")).alias("logp"))


def token_scores(steps: DataFrame, best: DataFrame, candidate: list[str], logp: str) -> DataFrame:
    """Cost (negated log-probability) of every step of the kept candidates."""
    kept = best.select(*candidate, "rank")
    return steps.join(kept, candidate).withColumn("cost", -F.col(logp))


def perplexity(losses: DataFrame, epoch: Column, loss: str) -> DataFrame:
    """Mean loss and its exponential per epoch."""
    return losses.groupBy(epoch.alias("epoch")).agg(F.avg(loss).alias("avg_loss"),
                                                    F.exp(F.avg(loss)).alias("perplexity"))


def prediction_table(ranked: DataFrame, key: str, fields: dict[str, str], rank: str = "rank") -> DataFrame:
    """One row per input with an array per field, in rank order.

    This form is for output and for inputs of few candidates: an array holds all of an input. Scores are computed on
    candidate rows (see :mod:`nlcorpus.operators.evaluate`).
    """
    ordered = F.sort_array(F.collect_list(F.struct(rank, *fields)))
    rows = ranked.groupBy(key).agg(ordered.alias("__all"))
    column = lambda field: F.transform("__all", lambda c: c[field])
    return rows.select(key, *[column(field).alias(name) for field, name in fields.items()])
