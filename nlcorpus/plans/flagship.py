"""The end-to-end slices: notebook pairs or code pairs, their profile, curation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import first_of_each
from nlcorpus.operators import curate, evaluate, trees
from nlcorpus.session import materialize


def curated_pairs(pairs: DataFrame, rare: int = 1, longer_than: int = 0) -> DataFrame:
    """Pairs with new code and without rare words.

    A pair goes when its code occurred before, or when it holds a word that occurs at most ``rare`` times in all
    code (of more than ``longer_than`` characters; by default any). The pairs are written once, since three
    branches read them.
    """
    pairs = materialize(pairs, "pairs")
    words = (pairs.select("id", F.explode(evaluate.tokenize_code(F.col("snippet"))).alias("literal"))
             .where(F.length("literal") > longer_than))
    frequency = words.groupBy("literal").agg(F.count("*").alias("freq"))
    dropped = curate.rare_literal(words, frequency, rare)
    ordered = pairs.withColumn("__order", F.struct("nb", "block"))
    return (first_of_each(ordered, ["snippet"], "__order").drop("__order")
            .join(dropped, "id", "left_anti"))


def curated_code(pairs: DataFrame, rare: int = 1, literal_length: int | None = None, list_length: int | None = None,
                 piece_ids: dict[str, int] | None = None) -> DataFrame:
    """Pairs ``(id, intent, snippet)`` whose code parses and passes every filter of the corpus profile.

    Parsed once into the child-count profile; dropped are later copies of a tree (by ``id``), trees with a literal
    that occurs at most ``rare`` times in all code, and those with a literal or a list beyond the given lengths.
    Literals are whole, or subword pieces when ``piece_ids`` are given.
    """
    parsed = trees.parse_corpus(pairs, ("tokens", "edge_counts"), piece_ids=piece_ids).where("parse_ok")
    parsed = materialize(parsed, "parsed-code")
    records = parsed.select("id", trees.linearised(F.col("tokens")).alias("ast_seq"))
    dropped = curate.drop_ids(elements=trees.edge_table(parsed, "id"), records=records, literal_length=literal_length,
                              list_length=list_length, literal_frequency=rare, duplicates=True)
    return curate.curate(parsed.select("id", "intent", "snippet"), dropped)
