"""Error analysis of predicted sequences: prefixes, literal runs, diffs, type precision and recall."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlcorpus.functions import arrays
from nlcorpus.functions.ordered import add_ordinal, islands
from nlcorpus.functions.tiered import sliced, stretches

OPCODES = """tag string, pos_exp_i1 int, pos_exp_i2 int, pos_pred_j1 int, pos_pred_j2 int,
 val_exp array<string>, val_pred array<string>, type_exp array<string>, type_pred array<string>"""
DIFF_VALUES = 200_000  # tokens of a slice that a task compares at once


def prefix_scores(df: DataFrame, expected: str, predicted: str, literal_limit: int) -> DataFrame:
    """Add the common prefix and both lengths, for the sequences as they are and with literals collapsed."""
    out = df
    for name, change in (("", lambda c: c), ("replaced_", lambda c: arrays.collapse_above(c, literal_limit))):
        exp, pred = change(F.col(expected)), change(F.col(predicted))
        out = (out.withColumn(f"{name}prefix_len", arrays.common_prefix_length(exp, pred))
               .withColumn(f"{name}expected_len", F.size(exp)).withColumn(f"{name}predicted_len", F.size(pred)))
    return out


def _both(value) -> list[Column]:
    return [value(p).alias(f"{p}{label}") for p in ("", "replaced_") for label in ("value",)]


def sequence_recall(scores: DataFrame) -> DataFrame:
    """Mean share of each expected sequence that was predicted as a prefix, in percent."""
    return scores.agg(*_both(lambda p: F.avg(F.try_divide(
        F.col(f"{p}prefix_len") * 100, F.col(f"{p}expected_len")))))


def sequence_precision(scores: DataFrame) -> DataFrame:
    """Mean share of each predicted sequence that is a right prefix; empty predictions do not count."""
    return scores.agg(*_both(lambda p: F.avg(F.try_divide(
        F.col(f"{p}prefix_len") * 100, F.col(f"{p}predicted_len")))))


def token_recall(scores: DataFrame) -> DataFrame:
    return scores.agg(*_both(lambda p: F.try_divide(
        F.sum(f"{p}prefix_len") * 100, F.sum(f"{p}expected_len"))))


def token_precision(scores: DataFrame) -> DataFrame:
    return scores.agg(*_both(lambda p: F.try_divide(
        F.sum(f"{p}prefix_len") * 100, F.sum(f"{p}predicted_len"))))


def prefix_exact_match(scores: DataFrame) -> DataFrame:
    """Percent of rows whose prefix is as long as the expected sequence."""
    return scores.agg(*_both(lambda p: F.avg(
        (F.col(f"{p}prefix_len") == F.col(f"{p}expected_len")).cast("int")) * 100))


def brevity_penalty(scores: DataFrame) -> DataFrame:
    """Corpus brevity penalty (0 without any prediction) and the numbers of shorter and other rows."""
    ratio = F.least(F.lit(1.0), F.try_divide(F.sum("predicted_len"), F.sum("expected_len")))
    penalty = F.when(ratio > 0, F.exp(1 - F.try_divide(F.lit(1.0), ratio))).otherwise(F.lit(0.0))
    shorter = F.col("predicted_len") < F.col("expected_len")
    return scores.agg(penalty.alias("brevity_penalty"), F.count_if(shorter).alias("n_shorter"),
                      F.count_if(~shorter).alias("n_not_shorter"))


def brevity_by_length(scores: DataFrame) -> DataFrame:
    """Mean per-row length ratio, capped at 1, of shorter and of other predictions."""
    ratio = F.least(F.lit(1.0), F.try_divide(F.col("predicted_len"), F.col("expected_len")))
    return scores.groupBy((F.col("predicted_len") < F.col("expected_len")).alias("shorter")).agg(
        F.avg(ratio).alias("mean_brevity"))


def merge_literal_runs(tokens: DataFrame) -> DataFrame:
    """``(id, run, token, kind)``: consecutive string pieces joined into one token."""
    starts = lambda prev, cur: prev.isNull() | (cur["kind"] != "strliteral") | (prev["kind"] != "strliteral")
    runs = islands(tokens, ["id"], "pos", ["kind"], starts, "run")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda p: p["token"])
    return runs.groupBy("id", "run").agg(F.array_join(ordered, "").alias("token"),
                                         F.min("kind").alias("kind"))


def merged_runs(tokens: Column, kinds: Column) -> Column:
    """As :func:`merge_literal_runs` for the arrays of one record: an array of ``struct(run, token, kind)``."""
    def runs(parts: Column) -> Column:
        words, own = parts["t"], parts["k"]
        inner = lambda i: (F.get(own, i) == "strliteral") & (F.get(own, i - 1) == "strliteral")
        places = F.transform(words, lambda _, i: i)
        starts = F.filter(places, lambda i: (i == 0) | ~F.coalesce(inner(i), F.lit(False)))
        end = lambda at, n: F.coalesce(F.get(at, n + 1), F.size(words))
        listed = lambda at: F.transform(at, lambda s, n: F.struct(
            (n + 1).cast("long").alias("run"),
            F.array_join(F.transform(F.sequence(s, end(at, n) - 1), lambda i: F.get(words, i)), "").alias("token"),
            F.get(own, s).alias("kind")))
        return F.get(F.transform(F.array(starts), listed), F.lit(0))

    # Bound to a lambda's argument, the arrays are made once, not once per element; a slice would copy all of them.
    return F.get(F.transform(F.array(F.struct(tokens.alias("t"), kinds.alias("k"))), runs), F.lit(0))


def strip_suffix(token: Column) -> Column:
    return F.regexp_replace(token, "#strliteral|#literal", "")


def kind_of(token: Column) -> Column:
    """Token kind as told by its suffix; list ends and sentence markers are special."""
    return (F.when(token.endswith("#strliteral"), "strliteral").when(token.endswith("#literal"), "literal")
            .when(token.isin("</l>", "<s>", "</s>"), "special").otherwise("node"))


def sequence_diff(df: DataFrame, expected: str = "expected", predicted: str = "predicted",
                  expected_kinds: str = "expected_kinds", predicted_kinds: str = "predicted_kinds") -> DataFrame:
    """One row per edit opcode (equal, insert, delete, replace) with positions, values and kinds.

    Texts stay Arrow columns: tokens are compared by their number within a slice of a batch, and values are taken by place.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in sliced(whole, (1, 2), DIFF_VALUES):
                flat = [column.flatten() for column in batch.columns[1:]]
                bounds = [np.concatenate([[0], np.cumsum(pc.list_value_length(c).fill_null(0).to_numpy(zero_copy_only=False))])
                          for c in batch.columns[1:]]
                numbers = pa.concat_arrays(flat[:2]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
                numbers = numbers[:len(flat[0])], numbers[len(flat[0]):]
                rows, tags, spans = [], [], []
                for row in range(batch.num_rows):
                    exp, pred = (numbers[k][bounds[k][row]:bounds[k][row + 1]].tolist() for k in (0, 1))
                    for tag, *span in SequenceMatcher(None, exp, pred).get_opcodes():
                        rows.append(row)
                        tags.append(tag)
                        spans.append(span)
                ends = np.array(spans, np.int64).reshape(-1, 4)
                at = np.array(rows, np.int64)
                lists = [stretches(flat[k], bounds[k][at] + ends[:, 2 * side], bounds[k][at] + ends[:, 2 * side + 1])
                         for k, side in ((0, 0), (1, 1), (2, 0), (3, 1))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(tags, pa.string()),
                     *(pa.array(ends[:, k].astype(np.int32)) for k in range(4)), *lists],
                    ["id", "tag", "pos_exp_i1", "pos_exp_i2", "pos_pred_j1", "pos_pred_j2", "val_exp", "val_pred",
                     "type_exp", "type_pred"])

    kind = df.schema["id"].dataType.simpleString()
    return (df.select("id", expected, predicted, expected_kinds, predicted_kinds)
            .mapInArrow(run, f"id {kind}, {OPCODES}"))


def diff_type_counts(df: DataFrame, opcodes: DataFrame) -> DataFrame:
    """``(id, kind, expected, predicted, equal)``: tokens per kind; ``equal`` counts the predicted side."""
    side = lambda rows, kinds, name: rows.select("id", F.explode(kinds).alias("kind"), F.lit(name).alias("side"))
    rows = (side(df, "expected_kinds", "expected").unionByName(side(df, "predicted_kinds", "predicted"))
            .unionByName(side(opcodes.where("tag = 'equal'"), "type_pred", "equal")))
    count = lambda name: F.count(F.when(F.col("side") == name, 1)).alias(name)
    return rows.groupBy("id", "kind").agg(count("expected"), count("predicted"), count("equal"))


def type_precision_recall(counts: DataFrame, *keys: str) -> DataFrame:
    """Equal tokens per predicted and per expected token by kind, per record (``id``) or over all records.

    A kind absent from the reference side has no ratio.
    """
    total = counts.groupBy(*keys, "kind").agg(*[F.sum(c).alias(c) for c in ("expected", "predicted", "equal")])
    return total.select(*keys, "kind", F.try_divide(F.col("equal"), F.col("predicted")).alias("precision"),
                        F.try_divide(F.col("equal"), F.col("expected")).alias("recall"))


def describe_scores(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of a column, exactly.

    Quartiles are interpolated between neighbours in rank. Equal values are counted first and the distinct
    values are ranked in sorted ranges, so no task holds all values.
    """
    shared = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ranked = weighted_ranks(shared)
    total = ranked.agg(F.sum("n").alias("total"))
    quarters = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    rows = ranked.withColumn("__one", F.lit(1)).join(F.broadcast(total.withColumn("__one", F.lit(1))), "__one")

    def quantile(p: float) -> Column:
        at = (F.col("total") - 1) * F.lit(p)
        low, high = F.floor(at), F.ceil(at)
        holds = lambda k: (F.col("before") <= k) & (k < F.col("before") + F.col("n"))
        below = F.max(F.when(holds(low), F.col("v")))
        above = F.max(F.when(holds(high), F.col("v")))
        return below + (above - below) * (F.max(at) - F.max(low))

    return rows.agg(F.max("total").alias("count"), F.min("v").alias("min"), F.max("v").alias("max"),
                    *[quantile(p).alias(name) for name, p in quarters.items()]).withColumn("__one", F.lit(1)).join(
        df.agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")).withColumn("__one", F.lit(1)),
        "__one").drop("__one")


def weighted_ranks(values: DataFrame) -> DataFrame:
    """``(v, n, before)``: number of rows below each distinct value."""
    placed = add_ordinal(values, ["v"], "__no", start=0)
    block = F.floor(F.col("__no") / 100_000)
    sums = placed.groupBy(block.alias("__block")).agg(F.sum("n").alias("__sum"))
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__block", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return (placed.withColumn("__block", block)
            .withColumn("__inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .join(offsets, "__block")
            .select("v", "n", (F.col("__offset") + F.col("__inside")).alias("before")))
