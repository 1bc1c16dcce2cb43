"""Fill-in-the-middle documents: prefix, middle and suffix in another order, cut at token or character borders.

Texts are cut as UTF-8 bytes. For the numbers of characters a **sparse exception index** is kept: only characters of
more than one byte are recorded, by place and by the bytes they have besides the first. A cut goes from bytes to
characters and back by one search in that list; between its entries, in ASCII, it is plain arithmetic. The index, the
token borders and the cuts are made for all texts of a slice at once, on the bytes that Arrow hands over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from nlcorpus.llm.common import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


@dataclass(frozen=True)
class Recipe:
    """What decides a document's form: ``seed`` goes into its hash, the rates are percentages.

    ``unit`` says where cuts may lie: ``token`` (a run of white space with the run of other characters after it) or
    ``char`` (any character).
    """

    seed: int = 42
    rate: int = 50
    suffix_first: int = 80
    unit: str = "token"


class Exceptions:
    """Multibyte characters of a UTF-8 buffer: place of each in bytes and in characters, and excess bytes so far."""

    def __init__(self, data: np.ndarray):
        leads = np.flatnonzero(data >= 0xC0)
        head = data[leads]
        self.excess = np.concatenate([[0], np.cumsum(1 + (head >= 0xE0) + (head >= 0xF0), dtype=np.int64)])
        self.at_byte = leads.astype(np.int64)
        self.at_char = self.at_byte - self.excess[:-1]

    def chars(self, cuts: np.ndarray) -> np.ndarray:
        """Characters before byte offsets that lie between characters."""
        return cuts - self.excess[np.searchsorted(self.at_byte, cuts)]

    def bytes(self, cuts: np.ndarray) -> np.ndarray:
        """Bytes before character offsets."""
        return cuts + self.excess[np.searchsorted(self.at_char, cuts)]


def _strings(values: list[bytes | None]) -> pa.Array:
    """Text as it is: bytes that are no valid UTF-8 go through unchanged."""
    return pa.array(values, pa.binary()).cast(options=pc.CastOptions(pa.string(), allow_invalid_utf8=True))


def draws(seed: int, keys: Iterable[str | None]) -> np.ndarray:
    """Four unsigned 32-bit numbers per key, from the SHA-256 of ``seed:key`` (a null key is an empty one)."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).digest()[:16] for k in keys)
    return np.frombuffer(digests, dtype=">u4").reshape(-1, 4).astype(np.int64)


def token_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of every token of all texts, and where each text's tokens begin in that list.

    A text's white space after its last word is a token of its own, and so is a text of white space alone.
    """
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(starts) + 1, np.int64)
    space = SPACE[data]
    last = np.zeros(len(data), dtype=bool)  # last byte of a text
    full = ends > starts
    last[ends[full] - 1] = True
    closes = last.copy()
    closes[:-1] |= ~space[:-1] & space[1:]
    found = np.flatnonzero(closes).astype(np.int64) + 1
    return found, np.searchsorted(found, np.append(starts, ends[-1]), side="right")


def _cuts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, drawn: np.ndarray, unit: str, index: Exceptions):
    """Units of each text, and the two cuts of each in bytes."""
    if unit == "token":
        found, first = token_ends(data, starts, ends)
        n = np.diff(first)
    else:
        n = index.chars(ends) - index.chars(starts)
    picks = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)
    if unit == "char":
        return n, index.bytes(index.chars(starts)[:, None] + picks)
    # Units are counted from the text's start; nought units end there, any other number at the end of that token.
    places = np.where(picks > 0, np.append(found, 0)[np.minimum(first[:-1, None] + picks - 1, len(found))], starts[:, None])
    return n, places


def _marked(texts: pa.Array) -> np.ndarray:
    found = [pc.match_substring(texts, mark) for mark in (PREFIX, SUFFIX, MIDDLE)]
    return pc.or_(pc.or_(found[0], found[1]), found[2]).to_numpy(zero_copy_only=False)


def _slice(keys: list, texts: pa.Array, recipe: Recipe) -> list:
    """Columns of the result for the texts of one slice."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if texts.offset:
        texts = pa.concat_arrays([texts])
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.empty(0, np.uint8)
    data, offsets = data[offsets[0]:offsets[-1]], offsets - offsets[0]
    starts, ends = offsets[:-1], offsets[1:]
    index = Exceptions(data)
    drawn = draws(recipe.seed, keys)
    n, cuts = _cuts(data, starts, ends, drawn, recipe.unit, index)
    plain = (ends == starts) | _marked(texts) | (drawn[:, 2] % 100 >= recipe.rate)
    form = np.where(plain, "plain", np.where(drawn[:, 3] % 100 < recipe.suffix_first, "spm", "psm"))
    chars = index.chars(np.column_stack([starts, cuts]))
    content, out = data.tobytes(), []
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for start, (one, two), end, kind in zip(starts.tolist(), cuts.tolist(), ends.tolist(), form.tolist()):
        prefix, middle, suffix = content[start:one], content[one:two], content[two:end]
        if kind == "plain":
            out.append(content[start:end])
        elif kind == "psm":
            out.append(b"".join((p, prefix, s, suffix, m, middle)))
        else:
            out.append(b"".join((s, suffix, p, prefix, m, middle)))
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
            pa.array(chars[:, 1] - chars[:, 0], pa.int64(), mask=plain), pa.array(chars[:, 2] - chars[:, 1], pa.int64(), mask=plain),
            _strings(out)]


def transform(docs: DataFrame, recipe: Recipe = Recipe(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output)``: every whole text, plain or with its parts in another order.

    ``n`` counts units. A text is plain when it is empty (null counts as empty), holds one of the markers, or its draw
    says so; the numbers of characters are null then. Equal keys draw alike, a null key draws as an empty one. Rows,
    also repeated ones, keep their number; other columns are not carried. Needs no shuffle; a task holds one slice.
    """
    if recipe.unit not in ("token", "char"):
        raise ValueError(f"no such unit: {recipe.unit}")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            columns = _slice(batch.column(1).to_pylist(), batch.column(2), recipe)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns],
                                             ["k", "n", "form", "prefix_chars", "middle_chars", "output"])

    frame = docs.select(docs[key].alias("k"), docs[key].cast("string").alias("s"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, n long, form string, prefix_chars long, middle_chars long, output string") \
        .withColumnRenamed("k", key)


def rebuilt(output: bytes, form: str) -> bytes:
    """The text before the change. Markers are found from the left; a text that holds one is plain."""
    if form == "plain":
        return output
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    first, second = (p, s) if form == "psm" else (s, p)
    cut = output.index(second, len(first))
    one, (two, middle) = output[len(first):cut], output[cut + len(second):].split(m, 1)
    return one + middle + two if form == "psm" else two + middle + one


def restore(changed: DataFrame, output: str = "output", form: str = "form", out: str = "restored") -> DataFrame:
    """``changed`` with the text that every output was made from; null where output or form is null."""
    names = changed.columns
    place, kind, held = names.index(output), names.index(form), [c for c in names if c != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, place):
            texts = [None if o is None or f is None else rebuilt(o, f) for o, f in zip(
                batch.column(place).cast(pa.binary()).to_pylist(), batch.column(kind).to_pylist())]
            columns = [batch.column(names.index(c)) for c in held]
            yield pa.RecordBatch.from_arrays([*columns, _strings(texts)], [*held, out])

    fields = [f for f in changed.schema.fields if f.name != out]
    return changed.mapInArrow(run, StructType([*fields, StructField(out, StringType())]))
