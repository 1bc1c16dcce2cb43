"""Curation filters: each yields the ids to drop; ``curate`` unions the active ones and applies the list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import hot_keys, later_duplicates
from nlcorpus.operators import clean, joins, profile
from nlcorpus.session import materialize


def low_probability(pairs: DataFrame, threshold: float) -> DataFrame:
    return pairs.where(F.col("prob") < threshold).select("id")


def long_literal(elements: DataFrame, threshold: int) -> DataFrame:
    """Records with a literal longer than the threshold."""
    text = profile.literal_repr(F.col("label"))
    return elements.where(profile.of_type(*profile.LITERAL_TYPES) & (F.length(text) > threshold)).select(
        "id").distinct()


def long_list(elements: DataFrame, threshold: int) -> DataFrame:
    """Records with a list field of more than ``threshold`` elements, its end included."""
    return elements.where(profile.of_type("list") & (F.col("cnt") > threshold)).select("id").distinct()


def duplicate_tree(records: DataFrame, order: str, sequence: str = "ast_seq") -> DataFrame:
    """Records whose sequence occurred earlier in ingest order."""
    return later_duplicates(records, [sequence], order).select("id")


def rare_literal(owned: DataFrame, frequency: DataFrame, threshold: int) -> DataFrame:
    """Records that own a literal with corpus frequency up to the threshold.

    ``owned`` holds ``(id, literal)`` rows, repeats allowed, and ``frequency`` all corpus counts
    ``(literal, freq)``, which are written once, since they are read three times. Rows of frequent literals only have
    to find no partner: those above an even share, fewer than there are partitions, are dropped where they are, so no
    task has to sort all rows of a literal that every record holds. What is left meets the wanted literals, each with
    at most ``threshold`` rows, and nothing is copied.
    """
    wanted = F.col("freq").between(0, threshold)
    counts = materialize(frequency.groupBy("literal").agg(F.max("freq").alias("freq"), F.bool_or(wanted).alias("rare")),
                         "literal-counts")
    frequent = hot_keys(counts, "freq").where(~F.col("rare")).select("literal")
    rest = owned.select("id", "literal").join(F.broadcast(frequent), "literal", "left_anti")
    return rest.join(counts.where("rare").select("literal"), "literal", "left_semi").select("id").distinct()


def drop_ids(pairs: DataFrame | None = None, elements: DataFrame | None = None,
             records: DataFrame | None = None, *, prob: float | None = None, literal_length: int | None = None,
             list_length: int | None = None, literal_frequency: int | None = None,
             duplicates: bool = False, order: str = "id") -> DataFrame:
    """Union of the ids of all filters whose threshold is set."""
    lists = []
    if prob is not None:
        lists.append(low_probability(pairs, prob))
    if literal_length is not None:
        lists.append(long_literal(elements, literal_length))
    if list_length is not None:
        lists.append(long_list(elements, list_length))
    if duplicates:
        lists.append(duplicate_tree(records, order))
    if literal_frequency is not None:
        lists.append(rare_literal(profile.literals(elements), profile.literal_frequency(elements), literal_frequency))
    if not lists:
        raise ValueError("no curation filter is active")
    return joins.union_ids(*lists)


def curate(pairs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The pairs that no active filter drops."""
    return clean.drop_blacklisted(pairs, dropped)
