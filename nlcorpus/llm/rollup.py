"""Token counts as additive totals that signed deltas keep up to date.

A delta row is ``(source, lang, tokenizer, n_docs, n_tokens)`` with signs. Every batch is summed and written to a
folder named after its id; Spark's job commit makes that write whole or absent, and the same id again replaces
nothing. Totals are the sum over committed batches, so replays and restarts cannot count twice, and a batch that a
lost executor left unfinished is not seen.
"""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer"]
COUNTED = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

#: Tokenizers by version, as expressions over a text; public byte-pair counts can be passed in their place.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words-1": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), 1)),
    "pieces-2": lambda text: F.size(F.regexp_extract_all(text, F.lit(r"(\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}\x20\x09-\x0D])"), 1)),
}


def counted(docs: DataFrame, version: str, text: str = "text", tokens: Column | None = None) -> DataFrame:
    """``docs`` with ``tokenizer`` and ``tokens``; a null text has no tokens."""
    count = TOKENIZERS[version](F.coalesce(F.col(text), F.lit(""))) if tokens is None else tokens
    return docs.withColumn("tokenizer", F.lit(version)).withColumn("tokens", count.cast("long"))


def inserts(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Deltas that add (or with ``sign=-1`` take away) the counted documents. Null keys are keys of their own."""
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (sign * F.col("tokens")).alias("n_tokens"))


def revisions(rows: DataFrame, revised: str = "revised") -> DataFrame:
    """Deltas for documents whose count changes from ``tokens`` to ``revised``; the number of documents stays."""
    return rows.select(*KEYS, F.lit(0).cast("long").alias("n_docs"), (F.col(revised) - F.col("tokens")).alias("n_tokens"))


def difference(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deltas between two counted states with one row per key: gone, new, recounted or moved documents."""
    cells = [F.col(c) for c in [*KEYS, "tokens"]]
    old, new = (d.select(F.col(key).alias("k"), F.struct(*cells).alias(n)) for d, n in ((before, "old"), (after, "new")))
    both = old.join(new, F.expr("true") & old["k"].eqNullSafe(new["k"]), "full").where(~F.col("old").eqNullSafe(F.col("new")))
    sides = F.array(F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("s"), F.col("old").alias("r"))),
                    F.when(F.col("new").isNotNull(), F.struct(F.lit(1).alias("s"), F.col("new").alias("r"))))
    signed = both.select(F.explode(sides).alias("e")).where("e is not null")
    return signed.select(*[F.col(f"e.r.{k}").alias(k) for k in KEYS], F.col("e.s").cast("long").alias("n_docs"),
                         (F.col("e.s") * F.col("e.r.tokens")).alias("n_tokens"))


def summed(deltas: DataFrame) -> DataFrame:
    """One row per key, zeros included; combined before the shuffle, so a hot source costs a row per task."""
    return deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """A store of committed batches below ``root``, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._files = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        return f"{self.root}/batch-{quote(batch, safe='')}"

    def _exists(self, path: str) -> bool:
        return self._files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def committed(self, batch: str) -> bool:
        """Whether the batch was written to its end."""
        return self._exists(f"{self._folder(batch)}/_SUCCESS")

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """Apply a batch once; False when it had been applied before. Leftovers of a broken attempt are replaced."""
        if self.committed(batch):
            return False
        summed(deltas).write.mode("overwrite").parquet(self._folder(batch))
        return True

    def totals(self) -> DataFrame:
        """Current totals; keys whose documents are all gone and whose tokens sum to nothing are left out."""
        pattern = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batch-*/_SUCCESS")
        done = [s.getPath().getParent().toString() for s in self._files.globStatus(pattern) or []]
        batches = self.spark.read.schema(COUNTED).parquet(*done) if done else self.spark.createDataFrame([], COUNTED)
        return summed(batches).where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))
