"""Training-set assembly: split, batches, padding, test set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nlcorpus.functions import arrays
from nlcorpus.functions.ordered import add_ordinal, first_by_digest
from nlcorpus.operators.clean import select_with_defaults

SPLIT_SEED = 4831  # fixed value: default seed of the split
TRAIN_COLUMNS = ("nl_enc", "nl_char_enc", "ast_seq_enc", "edge_order_seq", "allowed_tokens")


def train_valid_split(df: DataFrame, id_column: str, fraction: float, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``split``: exactly ``round(fraction * n)`` rows, half to even, are ``train``, the rest ``valid``.

    The first rows by a digest of id and seed are chosen, so the same input always splits the same way. A null id
    counts as an empty one, rows of one id follow a hash of their other columns, and rows that are equal in every
    column fall on the same side, which moves the cut by their number at most.
    """
    plain = [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    own = F.md5(F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.lit(f"-{seed}")))
    key = F.concat(own, F.lpad(F.hex(F.xxhash64(*plain)), 16, "0"))
    rows = F.bround(F.count("*") * F.lit(fraction), 0).cast("long")
    return (first_by_digest(df, key, rows, "__train")
            .withColumn("split", F.when(F.col("__train"), "train").otherwise("valid")).drop("__train"))


def load_sets(spark: SparkSession, combined: str | None = None, fraction: float | None = None,
              train: str | None = None, valid: str | None = None, id_column: str = "id",
              with_chars: bool = True) -> DataFrame:
    """Training rows with ``split``, from one input to be split or from separate train and valid inputs."""
    defaults = {} if with_chars else {"nl_char_enc": F.lit(None).cast("array<array<int>>")}
    read = lambda path: select_with_defaults(spark.read.parquet(path), TRAIN_COLUMNS, (id_column,), defaults)
    if combined is not None and fraction is not None:
        return train_valid_split(read(combined), id_column, fraction)
    if train is not None and valid is not None:
        return read(train).withColumn("split", F.lit("train")).unionByName(
            read(valid).withColumn("split", F.lit("valid")))
    raise ValueError("give one input with a split fraction, or a train and a valid input")


def fixed_paths(paths: Column, multiple: int, depth: int) -> Column:
    """Scaled, cut and zero-padded path of every token."""
    return F.transform(paths, lambda p: arrays.fixed_path(p, multiple, depth))


def pad_chars(chars: Column, width: int) -> Column:
    """Every character list cut or zero-padded to ``width``."""
    return F.transform(chars, lambda c: arrays.pad(c, width, F.lit(0)))


def pad_batches(df: DataFrame, order: list[str], batch_size: int, source: str = "nl_enc", target: str = "ast_seq_enc",
                paths: str | None = None, depth: int = 0, chars: str | None = None,
                char_width: int = 0) -> DataFrame:
    """Number batches in the given order and pad every sequence to the longest of its batch with zeros.

    The last batch may be short. Paths must already have ``depth`` steps and are padded with zero paths; character
    lists must have ``char_width`` entries and are padded with zero lists. A batch window holds at most
    ``batch_size`` rows.
    """
    rows = add_ordinal(df, order, "__row", start=0).withColumn(
        "batch", F.floor(F.col("__row") / batch_size).cast("long"))
    w = Window.partitionBy("batch")
    widest = {c: F.max(F.size(c)).over(w) for c in (source, target)}
    rows = rows.withColumn("__src", widest[source]).withColumn("__tgt", widest[target])
    zeros = lambda n: F.array_repeat(F.lit(0), n)
    if paths:
        rows = rows.withColumn(paths, arrays.pad(F.col(paths), F.col("__tgt"), zeros(depth)))
    if chars:
        rows = rows.withColumn(chars, arrays.pad(F.col(chars), F.col("__src"), zeros(char_width)))
    return (rows.withColumn(source, arrays.pad(F.col(source), F.col("__src"), F.lit(0)))
            .withColumn(target, arrays.pad(F.col(target), F.col("__tgt"), F.lit(0)))
            .withColumn("place", (F.col("__row") % batch_size).cast("int"))
            .drop("__row", "__src", "__tgt"))


def test_set(df: DataFrame) -> DataFrame:
    """Columns of the test file, by name; optional ones only when present."""
    return select_with_defaults(df, ["nl_enc", "nl_char_enc", "snippet"], ["id", "nl", "ast_seq_list"],
                                {"nl_char_enc": F.lit(None).cast("array<array<int>>")})


def preproc_outputs(encoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Train table (eight columns) and statistics table (five columns) as projections of one frame."""
    train = encoded.select(*TRAIN_COLUMNS, "ast_seq", "snippet", "id")
    return train, encoded.select("id", "snippet", "edge_counts", "max_depth", "ast_seq")
