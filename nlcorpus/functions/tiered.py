"""Dictionary coding of arrays in two tiers: frequent values inside the record, only the others through a shuffle."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from nlcorpus.functions.keyed import lookup_join
from nlcorpus.session import materialize

FREQUENT = 1_048_576  # entries of the first tier, at most
LONGEST = 64  # bytes of a text in it, so the broadcast has a bound: longer ones go through the second
SLICE_VALUES = 1_000_000  # array elements handled at once inside a task


def sliced(batch: pa.RecordBatch, lists: Iterable[int], values: int) -> Iterator[pa.RecordBatch]:
    """A batch cut so that the arrays in columns ``lists`` of a piece hold about ``values`` elements."""
    lengths = [pc.list_value_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False) for c in lists]
    sizes = np.cumsum(np.sum(lengths, axis=0, dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + values, side="right")))
        yield batch.slice(start, end - start)
        start = end


def _slices(batches: Iterable[pa.RecordBatch], lists: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that the arrays of a piece hold about ``SLICE_VALUES`` elements."""
    for batch in batches:
        yield from sliced(batch, (lists,), SLICE_VALUES)


def stretches(flat: pa.Array, start: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """Lists of the elements of ``flat`` between the places ``start`` and ``end``."""
    sizes = end - start
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    places = np.arange(offsets[-1]) + np.repeat(start - offsets[:-1], sizes)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat.take(pa.array(places)))


def _relisted(like: pa.Array, values: pa.Array, keep: np.ndarray | None = None) -> pa.Array:
    """``values`` in lists as long as those of ``like``, or only those of ``keep``; null lists stay null."""
    sizes = pc.list_value_length(like).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    if keep is not None:
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        values = values.filter(pa.array(keep))
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    holes = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=holes) if holes is not None else \
        pa.ListArray.from_arrays(pa.array(offsets), values)


def _heavy(table: DataFrame, name: str, code: str, weight: str, frequent: int) -> pa.Table:
    """``(name, code)`` of the heaviest rows, at most ``frequent``; equal or nearly equal weights go in or stay out together.

    Weights are told apart exactly below 4,096, above by a 64th of a power of two, so a few thousand counts tell the limit.
    """
    heft = F.when(F.col(weight) < 4096, F.col(weight)).otherwise(F.floor(F.log2(weight) * 64) + 4096)
    counts = table.groupBy(heft.alias("heft")).agg(F.count("*").alias("n")).orderBy(F.desc("heft")).collect()
    least, held = None, 0
    for row in counts:
        held += row["n"]
        if row["heft"] is None or held > frequent:
            break
        least = row["heft"]
    rows = table.where(heft >= least) if least is not None else table.limit(0)
    return rows.select(name, code).toArrow().combine_chunks()


def code_arrays(df: DataFrame, values: str, table: DataFrame, name: str, code: str, weight: str, out: str,
                frequent: int = FREQUENT, keep: bool = True) -> DataFrame:
    """``df`` with ``out``: the ``code`` of every element of the array ``values``, null for elements without one.

    ``table`` has one row per ``name`` with its ``weight``. At most ``frequent`` of the heaviest names are one broadcast,
    and their elements are coded where they are. Only what is left is exploded: it meets the table through its distinct
    values, values held by many rows salted, and comes back to its record in order. Records without such elements are not
    shuffled at all. Null arrays stay null; rows, also repeated ones, and other columns stay as they are. Without ``keep``
    the column ``values`` is left out, and is not written either.
    """
    text = dict(df.dtypes)[values] == "array<string>"
    heavy = table.where(F.col(name).isNotNull() & F.col(code).isNotNull())
    rows = _heavy(heavy.where(F.octet_length(name) <= LONGEST) if text else heavy, name, code, weight, frequent)
    element, target = df.schema[values].dataType.elementType, table.schema[code].dataType
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(tuple(column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
                                                for column in rows.columns))
    place = df.columns.index(values)
    fields = [f for f in df.schema.fields if keep or f.name != values]
    held = [f.name for f in fields]
    schema = StructType([*fields, StructField("__codes", ArrayType(target)), StructField("__rare", ArrayType(element))])

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = codes = None
        for batch in _slices(batches, place):
            lists = batch.column(place)
            flat = lists.flatten()
            if names is None:
                names, codes = shared.value[0].cast(flat.type), shared.value[1].cast(KINDS[target.typeName()])
            found = codes.take(pc.index_in(flat, names))
            rare = found.is_null().to_numpy(zero_copy_only=False)
            kept = [batch.column(c) for c in range(batch.num_columns) if keep or c != place]
            yield pa.RecordBatch.from_arrays([*kept, _relisted(lists, found), _relisted(lists, flat, rare)],
                                             [*held, "__codes", "__rare"])

    tier = materialize(df.mapInArrow(first, schema).withColumn("__row", F.monotonically_increasing_id()), "coded")
    done = tier.where("__rare is null or size(__rare) = 0").select(*held, F.col("__codes").alias(out))
    rest = tier.where("size(__rare) > 0")
    if rest.isEmpty():
        return done
    rare = rest.select("__row", F.posexplode("__rare").alias("__at", "__name"))
    counts = rare.where("__name is not null").groupBy("__name").agg(F.count("*").alias("__n"))
    known = counts.join(table.select(F.col(name).alias("__name"), F.col(code).alias("__code")), "__name", "left")
    met = lookup_join(rare, known, "__name", "__n", ["__row", "__at"])
    patches = met.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.struct("__at", "__code"))),
                                                   lambda p: p["__code"]).alias("__patch"))

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, len(held)):
            lists, patch = batch.column(len(held)), batch.column(len(held) + 1)
            flat = lists.flatten()
            filled = pc.replace_with_mask(flat, flat.is_null(), patch.flatten())
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(held)], _relisted(lists, filled)], [*held, out])

    patched = rest.join(patches, "__row").select(*held, "__codes", "__patch")
    return done.unionByName(patched.mapInArrow(second, StructType([*fields, StructField(out, ArrayType(target))])))


KINDS = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
