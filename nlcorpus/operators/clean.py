"""Projections, defaults, row filters and text repair."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlcorpus.functions import keyed, syntax
from nlcorpus.functions.ordered import add_ordinal

REGULAR_CELLS = ("markdown", "code")  # fixed values: the two cell types that can form pairs


def select_with_defaults(df: DataFrame, columns: Sequence[str], optional: Sequence[str] = ("id", "ast_seq_list"),
                         defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """The named columns, absent ones from ``defaults``; optional columns are added when present."""
    defaults = defaults or {}
    missing = [c for c in columns if c not in df.columns and c not in defaults]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    extra = [c for c in optional if c in df.columns and c not in columns]
    return df.select(*[F.col(c) if c in df.columns else defaults[c].alias(c) for c in columns], *extra)


def ordinal_id(df: DataFrame, order: Sequence[str | Column], prefix: str = "", out: str = "id") -> DataFrame:
    """String ids made of a prefix and the 1-based row number in the given order."""
    numbered = add_ordinal(df, order, "__ordinal")
    return numbered.withColumn(out, F.concat(F.lit(prefix), F.col("__ordinal").cast("string"))).drop("__ordinal")


def coalesce_intent(df: DataFrame, out: str = "nl") -> DataFrame:
    """The rewritten intent where there is one, else the intent."""
    if "rewritten_intent" not in df.columns:
        return df.withColumn(out, F.col("intent"))
    return df.withColumn(out, F.coalesce("rewritten_intent", "intent"))


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.dropna(subset=list(columns) if columns else None)


def drop_blacklisted(df: DataFrame, blacklist: DataFrame, id_column: str = "id") -> DataFrame:
    """Rows whose id, as a string, is not listed.

    The list grows with the corpus, so no broadcast is forced; adaptive execution picks one when it fits.
    """
    if id_column not in df.columns:
        raise ValueError(f"input has no column {id_column!r}")
    listed = blacklist.select(F.col("id").cast("string").alias("__listed")).distinct()
    return df.join(listed, F.col(id_column).cast("string") == F.col("__listed"), "left_anti")


def dedup_pairs(df: DataFrame, keys: Sequence[str | Column], order: str) -> DataFrame:
    """First row of each pair value in ingest order."""
    return keyed.first_of_each(df, keys, order)


def valid_text(text: Column) -> Column:
    """True for text made of Latin-1 characters without NUL; null and binary input are never valid."""
    ok = ~text.rlike(r"[^\x{01}-\x{FF}]")
    return F.coalesce(ok, F.lit(False))


def length_filter(df: DataFrame, source: str, target: str, max_source: int, max_target: int) -> DataFrame:
    return df.where((F.size(source) <= max_source) & (F.size(target) <= max_target))


def apply_to_tokens(tokens: Column, replacements: Column) -> Column:
    """Each token replaced by its mapped value, joined with spaces."""
    return F.array_join(
        F.transform(tokens, lambda t: F.coalesce(F.try_element_at(replacements, t), t)), " ")


def apply_to_code(code: Column, replacements: Column) -> Column:
    """Each quoted placeholder name in the code replaced by its value, in map order; null stays null."""
    return F.reduce(F.map_entries(replacements), code,
                    lambda text, e: F.replace(text, F.concat(F.lit("'"), e["key"], F.lit("'")), e["value"]))


def postprocess_predictions(predictions: DataFrame, replacements: DataFrame) -> DataFrame:
    """Put the original strings back into expected and predicted code, matched on ``id``."""
    return (predictions.join(replacements.select("id", "replacements"), "id")
            .select("id",
                    apply_to_code(F.col("expected_codesnippet"), F.col("replacements"))
                    .alias("expected_codesnippet"),
                    F.transform("predicted_codesnippets",
                                lambda p: apply_to_code(p, F.col("replacements")))
                    .alias("predicted_codesnippets")))


@F.pandas_udf(T.StringType())
def normalise_code(code: pd.Series) -> pd.Series:
    """Code parsed and printed again; text that does not parse is kept."""
    return code.map(lru_cache(maxsize=4096)(lambda text: syntax.reprint(text, keep=True)), na_action="ignore")


@F.pandas_udf(T.StringType())
def normalise_code_or_null(code: pd.Series) -> pd.Series:
    """Code parsed and printed again; null when it does not parse."""
    return code.map(lru_cache(maxsize=4096)(lambda text: syntax.reprint(text, keep=False)), na_action="ignore")


def irregular_cells(cells: DataFrame) -> DataFrame:
    """Counts of cell types that take no part in pairs."""
    return cells.where(~F.col("cell_type").isin(*REGULAR_CELLS)).groupBy("cell_type").agg(
        F.count("*").alias("n"))


def convert_placeholder_pairs(df: DataFrame, id_prefix: str = "", apply: bool = True) -> DataFrame:
    """Pairs from placeholder-coded records ``(query, code, raw_id, replacements)``.

    Without ``apply`` the placeholders stay and the map is carried along for later post-processing.
    """
    query, code, names = F.col("query"), F.col("code"), F.col("replacements")
    columns = [
        F.concat(F.lit(id_prefix), F.col("raw_id")).alias("id"),
        (apply_to_tokens(query, names) if apply else F.array_join(query, " ")).alias("intent"),
        normalise_code_or_null(apply_to_code(code, names) if apply else code).alias("snippet"),
        F.col("raw_id"),
    ]
    return df.select(*columns, *([] if apply else [names]))
