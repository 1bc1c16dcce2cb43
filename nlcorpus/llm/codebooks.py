"""Product quantisation of integer vectors by Lloyd rounds that rescan only what can have changed.

A vector is cut into equal parts; every part position has a codebook of its own. All arithmetic is on whole numbers, so
results do not depend on how rows are dealt out.

**Active entries.** Every row keeps, per part, its entry and the exact squared distance to it. After an update an entry
is active when its values moved. A part whose own entry stayed has a distance that still holds, and no entry that stayed
can be nearer than before; so it is compared with the active entries only, and changes when one is nearer, or as near
with a lower index. A part whose entry moved is compared with the whole codebook. Both give the nearest entry, the
lowest index among equals.

Codebooks are ``parts x entries x width`` numbers, whatever the number of vectors; they go to the workers and back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from nlcorpus.functions.keyed import lookup_join
from nlcorpus.llm.common import saved

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LIMIT = 2 ** 24  # components are held to this range, in which sums and squares of four are exact in doubles
STATE = "vec_id {id}, label {label}, v array<int>, codes binary, distances array<long>"


@dataclass(frozen=True)
class Trained:
    """Codebooks (``parts, entries, width`` whole numbers) and ``(vec_id, label, v, codes, distances)`` of all vectors."""

    codebooks: np.ndarray
    coded: DataFrame

    def sha256(self) -> str:
        """Of all components in decimal, by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
              parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)`` with ``v`` the floors of the scaled components, held to ``±LIMIT``.

    Dropped are rows whose vector is null, holds a null or non-finite component, or has another length than the kept
    vector of the least id whose length is a multiple of ``parts`` (such vectors cannot be compared).
    """
    kind = vectors.schema[label].dataType if label else "int"
    rows = vectors.select(vectors[key].alias("vec_id"), (vectors[label] if label else F.lit(None)).cast(kind).alias("label"),
                          vectors[vector].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & (F.size("x") % parts == 0)).where(finite)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), F.size("x")).select(F.size("x").alias("n")).first()
    held = lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return rows.where(F.size("x") == (first["n"] if first else 0)).select("vec_id", "label", F.transform("x", held).alias("v"))


def _block(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(np.float64) if len(column) else np.empty((0, 0))


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry; whole numbers, exact within ``LIMIT``."""
    return (x * x).sum(axis=1)[:, None] - 2.0 * (x @ entries.T) + (entries * entries).sum(axis=1)[None, :]


def assign(x: np.ndarray, books: np.ndarray, codes: np.ndarray | None, distances: np.ndarray | None,
           moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of every part of the rows ``x`` and the squared distances to them.

    ``codes`` and ``distances`` are those of the round before, ``moved`` says which entries changed since; without them
    everything is compared.
    """
    parts, _, width = books.shape
    new_codes, new_distances = np.zeros((len(x), parts), np.uint8), np.zeros((len(x), parts), np.int64)
    for part in range(parts):
        piece, book = x[:, part * width:(part + 1) * width], books[part].astype(np.float64)
        scan = np.ones(len(x), dtype=bool)
        if codes is not None:
            new_codes[:, part], new_distances[:, part] = codes[:, part], distances[:, part]
            scan = moved[part][codes[:, part]]
            active, stays = np.flatnonzero(moved[part]), np.flatnonzero(~scan)
            if len(active) and len(stays):
                near = _distances(piece[stays], book[active])
                best = near.argmin(axis=1)
                least, entry = near[np.arange(len(stays)), best].astype(np.int64), active[best]
                had, at = distances[stays, part], codes[stays, part]
                wins = (least < had) | ((least == had) & (entry < at))
                new_codes[stays[wins], part], new_distances[stays[wins], part] = entry[wins], least[wins]
        rows = np.flatnonzero(scan)
        if len(rows):
            near = _distances(piece[rows], book)
            best = near.argmin(axis=1)
            new_codes[rows, part], new_distances[rows, part] = best, near[np.arange(len(rows)), best].astype(np.int64)
    return new_codes, new_distances


def _assigned(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """``state`` with codes and distances under ``books``; ``moved`` is None where there are none from before."""
    parts = len(books)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = distances = None
            if moved is not None:
                codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, parts)
                distances = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts)
            codes, distances = assign(_block(batch.column(2)), books, codes, distances, moved)
            offsets = pa.array(np.arange(len(codes) + 1, dtype=np.int32) * parts)
            lists = pa.ListArray.from_arrays(offsets, pa.array(distances.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)),
                                              pa.array([r.tobytes() for r in codes], pa.binary()), lists],
                                             ["vec_id", "label", "v", "codes", "distances"])

    kinds = {name: state.schema[column].dataType.simpleString() for name, column in (("id", "vec_id"), ("label", "label"))}
    return state.mapInArrow(run, STATE.format(**kinds))


def _updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of its parts; entries without parts stay.

    A task sums its rows to one row per used entry, so the shuffle carries codebooks, not vectors.
    """
    parts, entries, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, parts)
            cells = (codes + np.arange(parts) * entries).ravel()
            counts += np.bincount(cells, minlength=parts * entries)
            pieces = _block(batch.column(0)).reshape(-1, width)
            for place in range(width):
                sums[:, place] += np.bincount(cells, pieces[:, place], minlength=parts * entries).astype(np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, width), pa.int32()),
                                          pa.array(np.tile(np.arange(width), len(used)), pa.int32()),
                                          pa.array(sums[used].ravel(), pa.int64()),
                                          pa.array(np.repeat(counts[used], width), pa.int64())], ["cell", "place", "s", "n"])

    sums = state.select("v", "codes").mapInArrow(run, "cell int, place int, s long, n long")
    means = sums.groupBy("cell", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"))
    books = books.copy()
    flat = books.reshape(parts * entries, width)
    for row in means.collect():  # parts x entries x width rows at most
        flat[row["cell"], row["place"]] = int(row["s"]) // row["n"]
    return books


def first_books(state: DataFrame, parts: int, entries: int) -> np.ndarray:
    """Codebooks of the parts of the ``entries`` vectors of the least ids (then of the least values; null ids last)."""
    rows = state.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    if not rows:
        return np.zeros((parts, 0, 0), np.int64)
    values = np.array([r["v"] for r in rows], dtype=np.int64)
    return np.ascontiguousarray(values.reshape(len(rows), parts, -1).transpose(1, 0, 2))


def fit(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str | None = "label",
        parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Trained:
    """Codebooks after ``rounds`` of assigning and updating, and all vectors assigned to the last ones.

    Fewer than ``entries`` vectors make smaller codebooks, none makes empty ones. For dropped rows see
    :func:`quantised`; other rows, also repeated ones, keep their number.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: 1 to 256 entries")
    state = saved(quantised(vectors, key, vector, label, parts, scale), "quantised")
    books, moved = first_books(state, parts, entries), None
    if not books.shape[1]:
        kinds = {"id": state.schema["vec_id"].dataType.simpleString(), "label": state.schema["label"].dataType.simpleString()}
        return Trained(books, state.sparkSession.createDataFrame([], STATE.format(**kinds)))
    for _ in range(rounds):
        state = saved(_assigned(state, books, moved), "assigned")
        new = _updated(state, books)
        books, moved = new, (new != books).any(axis=2)
    return Trained(books, saved(_assigned(state, books, moved), "assigned"))


def code_text(codes: str = "codes") -> Column:
    """Two lower-case hexadecimal digits per part."""
    return F.lower(F.hex(codes))


def with_errors(trained: Trained) -> DataFrame:
    """``(vec_id, label, code, error, label_error)``: squared distance of every vector, and its sum over equal labels.

    Null labels are one group. Sums are made before the shuffle, and a label of many rows is salted in the join. A sum
    beyond 63 bits is given as the largest number of that size.
    """
    rows = trained.coded.select("vec_id", "label", code_text().alias("code"),
                                F.aggregate("distances", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"))
    keyed = rows.withColumn("__label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    top = F.lit(2 ** 63 - 1).cast("decimal(38,0)")
    sums = keyed.groupBy("__label").agg(
        F.least(F.sum(F.col("error").cast("decimal(28,0)")).cast("decimal(38,0)"), top).cast("long").alias("label_error"),
        F.count("*").alias("__rows"))
    return lookup_join(keyed, sums, "__label", "__rows", ["vec_id"]).select("vec_id", "label", "code", "error", "label_error")


def decode(coded: DataFrame, codebooks: np.ndarray, scale: int = SCALE, codes: str = "codes",
           out: str = "approximation") -> DataFrame:
    """``coded`` with the vectors that the codes stand for, at the middle of every floored step; null for null codes."""
    parts, entries, width = codebooks.shape
    values, names = (codebooks + 0.5) / scale, coded.columns
    held = [c for c in names if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if c is None else values[np.arange(parts), np.frombuffer(c, np.uint8)].ravel().tolist()
                    for c in batch.column(names.index(codes)).to_pylist()]
            columns = [batch.column(names.index(c)) for c in held]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.list_(pa.float64()))], [*held, out])

    fields = [f for f in coded.schema.fields if f.name != out]
    return coded.mapInArrow(run, StructType([*fields, StructField(out, ArrayType(DoubleType()))]))
