"""Order-sensitive primitives that never put an unbounded group into one task.

Plain windows are fine when a group is the exploded content of one record (it came out of one task
anyway). For groups that can grow with the corpus (a conversation, a user, a file) the functions here
cut each group into chunks of its order column, work inside the chunks, and pass only one summary row
per chunk on to the next chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import lookup_join
from nlcorpus.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in its low 33 bits
CHUNK_ROWS = 4096


def add_ordinal(df: DataFrame, order: Sequence[str | Column], out: str, start: int = 1) -> DataFrame:
    """Dense row number over the whole frame in the given order, without a single-task window.

    The frame is range-sorted and written once; each written row knows its partition and its place in
    it, so the number is that place plus the rows of all earlier partitions (one row per partition).
    """
    placed = materialize(
        df.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()), "ordinal")
    part = F.shiftright("__place", _ROW_BITS)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
               .select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")))
    row = F.col("__place").bitwiseAND((1 << _ROW_BITS) - 1)
    return (placed.withColumn("__part", part)
            .join(F.broadcast(offsets), "__part")  # one row per partition of the sort
            .withColumn(out, (F.col("__offset") + row + start).cast("long"))
            .drop("__part", "__offset", "__place"))


def first_by_digest(df: DataFrame, digest: Column, rows: Column, out: str) -> DataFrame:
    """Mark with ``out`` the rows whose uniform hex digest is among the first ``rows`` (an aggregate over ``df``).

    Only digests are counted and ranked: four digits say in which of at most 65,536 even buckets the cut lies, the
    digests of that bucket alone are ranked, and every row is then decided by comparing it with the cut, where it
    is. Rows with equal digests fall on the same side.
    """
    keyed = df.withColumn("__digest", digest)
    bucket = F.substring("__digest", 1, 4).alias("__bucket")
    upto = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = (keyed.groupBy(bucket).agg(F.count("*").alias("__n"))  # at most 16^4 rows
            .withColumn("__end", F.sum("__n").over(upto)))
    place = (ends.join(F.broadcast(df.agg(rows.alias("__rows"))), (F.col("__rows") > F.col("__end") - F.col("__n"))
                       & (F.col("__rows") <= F.col("__end")))
             .select("__bucket", (F.col("__rows") - F.col("__end") + F.col("__n")).alias("__place")))
    inside = keyed.select("__digest", bucket).join(F.broadcast(place), "__bucket")  # one row
    ranked = inside.withColumn("__rank", F.row_number().over(Window.partitionBy("__bucket").orderBy("__digest")))
    cut = ranked.where(F.col("__rank") == F.col("__place")).agg(F.max("__digest").alias("__cut"))
    return (keyed.join(F.broadcast(cut))  # one row, null when no row is among the first
            .withColumn(out, F.coalesce(F.col("__digest") <= F.col("__cut"), F.lit(False)))
            .drop("__digest", "__cut"))


def chunk_of(position: Column, rows: int = CHUNK_ROWS) -> Column:
    """Chunk number of a dense integer position."""
    return F.floor(position / F.lit(rows)).cast("long")


def bounded_chunks(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` with a chunk number that rises with ``order`` inside each group; no chunk has more than ``rows`` rows.

    For order columns that say nothing about how many rows lie between two values (times, scores), ties and nulls
    included. Group sizes are counted first, combined before the shuffle. Groups of up to ``rows`` rows are one
    chunk. The rows of longer ones are sorted by group and order over all partitions, so a long group lies in many of
    them, written, and cut where they lie; ties keep the place they got there. Groups are told apart by a hash: should two
    share one, a short group is sorted too, which changes nothing else. ``df`` is read twice.
    """
    group = df.withColumn("__group", F.xxhash64(*[F.struct(k) for k in keys]))
    long = materialize(group.groupBy("__group").agg(F.count("*").alias("__n")).where(F.col("__n") > rows), "long-groups")
    if long.isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    marked = lookup_join(group, long, "__group", "__n", list(order))
    short = marked.where("__n is null").drop("__n", "__group").withColumn(out, F.lit(0).cast("long"))
    placed = materialize(marked.where("__n is not null").drop("__n", "__group").orderBy(*keys, *order)
                         .withColumn(out, F.monotonically_increasing_id()), "chunks")
    return short.unionByName(placed.withColumn(out, F.floor(F.col(out) / F.lit(rows)).cast("long")))


def _keyed(keys: Sequence[str]) -> list[str]:
    return [*keys, "__chunk"]


def _with_carry(rows: DataFrame, carry: DataFrame, grouped: Sequence[str]) -> DataFrame:
    """Each row with its chunk's summary; null keys and null positions are groups and chunks like others."""
    names = {c: f"__of_{i}" for i, c in enumerate(grouped)}
    named = carry.withColumnsRenamed(names)
    same = [rows[c].eqNullSafe(named[n]) for c, n in names.items()]
    return rows.join(named, same).drop(*names.values())


def islands(df: DataFrame, keys: Sequence[str], position: str, looks_at: Sequence[str],
            starts: Callable[[Column, Column], Column], out: str = "island",
            previous: str | None = None, chunk: Column | None = None) -> DataFrame:
    """Number the runs of rows inside each group.

    ``starts(prev, cur)`` says from the ``looks_at`` fields of the previous and the current row whether a
    new run begins; ``prev`` is null on the first row of a group, and a null answer means no. Rows before
    the first start get run 0. ``previous`` optionally keeps the previous row's fields as a struct.

    With ``chunk`` the group may be of any size: a number that rises with ``position`` and that few rows of a group
    share (:func:`chunk_of`, :func:`bounded_chunks`). Without it the group must be one record's content.
    """
    begins = lambda prev, cur: F.coalesce(starts(prev, cur), F.lit(False)).cast("long")
    cur = F.struct(*[F.col(c) for c in looks_at])
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(position)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = (df.withColumn("__prev", F.lag(cur).over(w))
                .withColumn("__start", begins(F.col("__prev"), cur))
                .withColumn(out, F.sum("__start").over(upto)))
        rows = rows.withColumn(previous, F.col("__prev")) if previous else rows
        return rows.drop("__prev", "__start")

    grouped = _keyed(keys)
    w = Window.partitionBy(*grouped).orderBy(position)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (df.withColumn("__chunk", chunk)
            .withColumn("__prev", F.lag(cur).over(w))
            .withColumn("__head", F.row_number().over(w) == 1)
            .withColumn("__start", F.when(F.col("__head"), F.lit(0)).otherwise(
                begins(F.col("__prev"), cur)))
            .withColumn("__run", F.sum("__start").over(upto)))
    place = F.struct(position)  # a null position is a place like others, before them
    ends = rows.groupBy(*grouped).agg(F.min_by(cur, place).alias("__first"),
                                      F.max_by(cur, place).alias("__last"),
                                      F.sum("__start").alias("__inner"))
    over = Window.partitionBy(*keys).orderBy("__chunk")
    carry = (ends.withColumn("__before", F.lag("__last").over(over))
             .withColumn("__opens", begins(F.col("__before"), F.col("__first")))
             .withColumn("__base", F.coalesce(
                 F.sum(F.col("__inner") + F.col("__opens")).over(
                     over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("__opens"))
             .select(*grouped, "__before", "__base"))
    rows = _with_carry(rows, carry, grouped).withColumn(out, F.col("__run") + F.col("__base"))
    if previous:
        rows = rows.withColumn(
            previous, F.when(F.col("__head"), F.col("__before")).otherwise(F.col("__prev")))
    return rows.drop("__chunk", "__prev", "__head", "__start", "__run", "__before", "__base")


def number_rows(df: DataFrame, keys: Sequence[str], position: str, out: str, chunk: Column) -> DataFrame:
    """1-based row number inside groups of any size."""
    return islands(df, keys, position, [position], lambda prev, cur: F.lit(True), out, chunk=chunk)


def fill_forward(df: DataFrame, keys: Sequence[str], position: str, value: Column, out: str,
                 chunk: Column) -> DataFrame:
    """Last non-null ``value`` up to and including the current row, for groups of any size."""
    grouped = _keyed(keys)
    w = (Window.partitionBy(*grouped).orderBy(position)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (df.withColumn("__chunk", chunk).withColumn("__value", value)
            .withColumn("__here", F.last("__value", ignorenulls=True).over(w)))
    lasts = rows.groupBy(*grouped).agg(
        F.max_by("__value", F.when(F.col("__value").isNotNull(), F.struct(position))).alias("__last"))
    over = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*grouped, F.last("__last", ignorenulls=True).over(over).alias("__carried"))
    return (_with_carry(rows, carry, grouped)
            .withColumn(out, F.coalesce("__here", "__carried"))
            .drop("__chunk", "__value", "__here", "__carried"))
