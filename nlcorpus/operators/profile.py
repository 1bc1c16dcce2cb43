"""Record and corpus profiles over the long child-count table ``(id, label, type, cnt)``.

Every statistic is a grouped aggregate with map-side combine. Record-level groups hold one record's own
elements; corpus-level groups are pre-aggregated per record or per key first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import lookup_join

LITERAL_TYPES = ("literal", "strliteral")  # fixed values
FIELD_TYPES = ("list", "singleton")  # fixed values


def of_type(*types: str) -> Column:
    return F.col("type").isin(*types)


def literal_repr(label: Column) -> Column:
    """Literal text: everything before the last ``#``."""
    return F.regexp_replace(label, r"#[^#]*$", "")


def counted(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def max_edge_count(profile: DataFrame) -> DataFrame:
    return profile.groupBy("id").agg(F.greatest(F.max("cnt"), F.lit(0)).alias("max_edge_count"))


def list_bounds(profile: DataFrame, *keys: str) -> DataFrame:
    """Smallest and largest element count of every list field, per record or over all (no ``keys``)."""
    return profile.where(of_type("list")).groupBy(*keys, "label").agg(
        F.min("cnt").alias("min_cnt"), F.max("cnt").alias("max_cnt"))


def list_len_histogram(profile: DataFrame, *keys: str) -> DataFrame:
    return profile.where(of_type("list")).groupBy(*keys, "cnt").agg(F.count("*").alias("n"))


def node_histogram(profile: DataFrame, *keys: str) -> DataFrame:
    return profile.where(of_type("node")).groupBy(*keys, "label").agg(F.count("*").alias("n"))


def edge_histogram(profile: DataFrame, *keys: str) -> DataFrame:
    return profile.where(of_type(*FIELD_TYPES)).groupBy(*keys, "label").agg(F.sum("cnt").alias("n"))


def literal_histogram(profile: DataFrame, *keys: str) -> DataFrame:
    return (profile.where(of_type(*LITERAL_TYPES))
            .groupBy(*keys, literal_repr(F.col("label")).alias("literal")).agg(F.count("*").alias("n")))


def literals(profile: DataFrame) -> DataFrame:
    """``(id, literal)``, one row per occurrence."""
    return profile.where(of_type(*LITERAL_TYPES)).select("id", literal_repr(F.col("label")).alias("literal"))


def max_literal_length(profile: DataFrame) -> DataFrame:
    """Longest literal of each record, 0 without literals."""
    longest = F.max(F.when(of_type(*LITERAL_TYPES), F.length(literal_repr(F.col("label")))))
    return profile.groupBy("id").agg(F.coalesce(longest, F.lit(0)).alias("max_lit_length"))


def type_counts(profile: DataFrame, *keys: str) -> DataFrame:
    return profile.groupBy(*keys).agg(counted(of_type("node")).alias("node_count"),
                                      counted(of_type("list")).alias("list_count"),
                                      counted(of_type(*LITERAL_TYPES)).alias("literal_count"))


def edge_count(profile: DataFrame, *keys: str) -> DataFrame:
    """Total of the edge histogram."""
    total = F.coalesce(F.sum(F.when(of_type(*FIELD_TYPES), F.col("cnt"))), F.lit(0))
    return profile.groupBy(*keys).agg(total.alias("edge_count"))


def record_histograms(profile: DataFrame) -> DataFrame:
    """All histograms of all records as one long table ``(id, kind, key, n, lo, hi)`` in one grouped pass."""
    label, cnt, one = F.col("label"), F.col("cnt").cast("long"), F.lit(1).cast("long")
    entry = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))
    entries = (
        F.when(of_type("node"), F.array(entry("node", label, one)))
        .when(of_type("list"), F.array(entry("edge", label, cnt), entry("bounds", label, cnt),
                                       entry("list_len", F.col("cnt").cast("string"), one)))
        .when(of_type("singleton"), F.array(entry("edge", label, cnt)))
        .when(of_type(*LITERAL_TYPES), F.array(entry("literal", literal_repr(label), one)))
        .otherwise(F.array(entry("other", F.lit(""), one))))
    # One entry per record keeps records without countable elements and carries the largest count.
    return (profile.select("id", F.inline(F.concat(entries, F.array(entry("any", F.lit(""), cnt)))))
            .groupBy("id", "kind", "key")
            .agg(F.sum("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"),
                 F.count("*").alias("rows")))


def record_stats(profile: DataFrame) -> DataFrame:
    """One row per record with all maps and scalars of the record profile."""
    is_kind = lambda kind: F.col("kind") == kind

    def as_map(kind: str, value: Column) -> Column:
        return F.map_from_entries(F.collect_list(F.when(is_kind(kind), F.struct("key", value))))

    total = lambda kind, value: F.coalesce(F.sum(F.when(is_kind(kind), F.col(value))), F.lit(0))
    return record_histograms(profile).groupBy("id").agg(
        F.greatest(F.max(F.when(is_kind("any"), F.col("hi"))), F.lit(0)).alias("max_edge_count"),
        as_map("bounds", F.struct("lo", "hi")).alias("min_max_list_el"),
        as_map("list_len", F.col("n")).alias("list_len_histogram"),
        as_map("node", F.col("n")).alias("node_histogram"),
        as_map("edge", F.col("n")).alias("edge_histogram"),
        as_map("literal", F.col("n")).alias("literal_histogram"),
        F.coalesce(F.max(F.when(is_kind("literal"), F.length("key"))), F.lit(0)).alias("max_lit_length"),
        total("node", "n").alias("node_count"),
        total("bounds", "rows").alias("list_count"),
        total("literal", "n").alias("literal_count"),
        total("edge", "n").alias("edge_count"))


def global_maxima(stats: DataFrame) -> DataFrame:
    """Largest depth and child count over records with ``max_depth`` and ``max_edge_count``."""
    return stats.agg(F.max("max_depth").alias("global_max_depth"),
                     F.max("max_edge_count").alias("global_max_edge_count"))


def max_lit_len_histogram(profile: DataFrame) -> DataFrame:
    """Number of records by the length of their longest literal."""
    return max_literal_length(profile).groupBy("max_lit_length").agg(F.count("*").alias("n"))


def literal_frequency(elements: DataFrame) -> DataFrame:
    """``(literal, freq)`` over all records."""
    return literal_histogram(elements).withColumnRenamed("n", "freq")


def rarest_literal(records: DataFrame, owned: DataFrame, frequency: DataFrame) -> DataFrame:
    """``(id, min_freq)``: corpus frequency of each record's rarest literal, -1 without literals.

    ``owned`` holds the ``(id, literal)`` rows of the records, repeats allowed, and ``frequency`` the corpus
    counts ``(literal, freq)``.
    """
    rarest = (lookup_join(owned.select("id", "literal"), frequency, "literal", "freq", ["id"])
              .groupBy("id").agg(F.min("freq").alias("min_freq")))
    return (records.select("id").join(rarest, "id", "left")
            .select("id", F.coalesce("min_freq", F.lit(-1).cast("long")).alias("min_freq")))


def min_lit_freq_histogram(records: DataFrame, owned: DataFrame, frequency: DataFrame) -> DataFrame:
    return rarest_literal(records, owned, frequency).groupBy("min_freq").agg(F.count("*").alias("n"))


def distinct_counts(profile: DataFrame) -> DataFrame:
    """Number of different literals and node names; the keys are grouped before they are counted."""
    is_literal = of_type(*LITERAL_TYPES)
    keys = (profile.where(is_literal | of_type("node"))
            .select(is_literal.alias("is_literal"),
                    F.when(is_literal, literal_repr(F.col("label"))).otherwise(F.col("label")).alias("key"))
            .groupBy("is_literal", "key").count())
    return keys.agg(counted(F.col("is_literal")).alias("distinct_literal_count"),
                    counted(~F.col("is_literal")).alias("distinct_node_count"))


def length_histogram(df: DataFrame, sequence: str | Column) -> DataFrame:
    """Number of rows by sequence length."""
    seq = F.col(sequence) if isinstance(sequence, str) else sequence
    return df.groupBy(F.size(seq).alias("len")).agg(F.count("*").alias("n"))


def cumulate(histogram: DataFrame, key: str = "len", count: str = "n", out: str = "cumulative") -> DataFrame:
    """Running total over an aggregated histogram: one row per distinct length, bounded by the longest."""
    w = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumn(out, F.sum(count).over(w))


def global_scalars(profile: DataFrame, depths: DataFrame) -> DataFrame:
    """All single-number corpus statistics in one row."""
    totals = profile.agg(
        F.greatest(F.max("cnt"), F.lit(0)).alias("global_max_edge_count"),
        counted(of_type("node")).alias("global_node_count"),
        counted(of_type("list")).alias("global_list_count"),
        counted(of_type(*LITERAL_TYPES)).alias("global_literal_count"),
        F.coalesce(F.sum(F.when(of_type(*FIELD_TYPES), F.col("cnt"))), F.lit(0)).alias("global_edge_count"))
    parts = [totals, distinct_counts(profile),
             depths.agg(F.max("max_depth").alias("global_max_depth"))]
    return one_row(*parts)


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side. Only the first frame may have more rows."""
    joined = frames[0].withColumn("__one", F.lit(1))
    for frame in frames[1:]:
        joined = joined.join(F.broadcast(frame.withColumn("__one", F.lit(1))), "__one")  # a single row
    return joined.drop("__one")
