"""Notebook segmentation: runs of text cells followed by runs of code cells become pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions.ordered import add_ordinal, chunk_of, islands, number_rows
from nlcorpus.operators.clean import REGULAR_CELLS
from nlcorpus.session import materialize


def cells_to_pairs(cells: DataFrame) -> DataFrame:
    """``(nb, block, intent, snippet)`` from ``(nb, pos, cell_type, text)``.

    A block starts at each markdown cell that follows code or opens the notebook. Irregular cells neither
    count nor break a run. Blocks lacking text or code, such as leading code, are dropped. Only the cells
    of one block meet in one value, since their joined text is the result.
    """
    regular = cells.where(F.col("cell_type").isin(*REGULAR_CELLS))
    starts = lambda prev, cur: (cur["cell_type"] == "markdown") & (
        prev.isNull() | (prev["cell_type"] != "markdown"))
    blocks = islands(regular, ["nb"], "pos", ["cell_type"], starts, "block", chunk=chunk_of(F.col("pos")))

    def joined(kind: str) -> Column:
        parts = F.collect_list(F.when(F.col("cell_type") == kind, F.struct("pos", "text")))
        return F.array_join(F.transform(F.sort_array(parts), lambda p: p["text"]), "\n")

    return (blocks.where("block > 0").groupBy("nb", "block")
            .agg(joined("markdown").alias("intent"), joined("code").alias("snippet"))
            .where((F.col("intent") != "") & (F.col("snippet") != "")))


def pair_ids(pairs: DataFrame, notebooks: DataFrame) -> DataFrame:
    """Add ``id`` = notebook ordinal, underscore, pair ordinal; both 1-based, pairs counted after filtering.

    ``notebooks`` lists every notebook (``nb``), with or without pairs, since all of them are counted. The pairs
    are written once, so that numbering does not join their texts again.
    """
    pairs = materialize(pairs, "pairs")
    ordinals = add_ordinal(notebooks.select("nb").distinct(), ["nb"], "nb_no")
    numbered = number_rows(pairs, ["nb"], "block", "pair_no", chunk_of(F.col("block")))
    return (numbered.join(ordinals, "nb")
            .withColumn("id", F.concat_ws("_", F.col("nb_no"), F.col("pair_no"))))
