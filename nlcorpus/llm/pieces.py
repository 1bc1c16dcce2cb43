"""Encoding with a sentencepiece model through a table of distinct white-space-marked chunks.

No piece of the vocabularies meant here has a word marker after another character, so no merge crosses the start of
a run of spaces: a text is the concatenation of chunks ``spaces + non-spaces`` that segment independently. Inside a
task the chunks of a slice of texts are dictionary-encoded by Arrow, each distinct chunk is segmented once, and the
ids come back by position. The table lives in the task because texts outweigh it: a table across tasks would have to
shuffle every text to its chunks. Memory is bounded by the slice.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from nlcorpus.llm.common import slices

MARK = "\u2581"
CHUNK_CHARS = 2_000_000  # of texts whose distinct chunks and ids are held as Python objects at a time


@lru_cache(maxsize=2)
def load(model: bytes):
    """The sentencepiece processor of a serialised model; kept by the worker."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def model_bytes(path: str) -> bytes:
    """The model file as bytes, which go to the workers inside the task (half a megabyte, fixed by the file).

    Raises when a piece has the marker after another character, as chunks would not be independent then.
    """
    with open(path, "rb") as file:
        model = file.read()
    processor = load(model)
    crossing = [p for p in map(processor.id_to_piece, range(processor.get_piece_size())) if MARK in p.lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces cross word markers, chunks are not independent: {crossing[:5]}")
    if processor.encode("a  b", out_type=str) != processor.encode(f"a{MARK}{MARK}b", out_type=str):
        raise ValueError("the model does not keep runs of spaces")
    return model


def encode_slice(model: bytes, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, without begin and end, and the offsets of the texts in them.

    A null text is an empty one.
    """
    processor = load(model)
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    # The model puts one marker before a non-empty text and reads a marker in the text as a space.
    marked = pc.replace_substring(texts, " ", MARK)
    lead = pc.if_else(pc.equal(pc.binary_length(texts), 0), pa.scalar("", pa.large_string()),
                      pa.scalar(MARK, pa.large_string()))
    marked = pc.binary_join_element_wise(lead, marked, pa.scalar("", pa.large_string()))
    # A break before every marker that follows another character; chunks then start with their markers.
    broken = pc.replace_substring_regex(marked, f"([^{MARK}])({MARK})", "\\1\x00\x01\\2")
    if pc.any(pc.match_substring(texts, "\x00\x01")).as_py():
        return _encode_whole(processor, texts)
    lists = pc.split_pattern(broken, "\x00\x01")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    table = lists.flatten().dictionary_encode()
    distinct = table.dictionary.to_pylist()
    # A chunk's first marker is what the model adds itself, so it is left out of what is handed over.
    segmented = processor.encode([c[1:] for c in distinct], num_threads=1)
    if MARK in distinct:  # a lone marker: the model gives nothing for an empty text
        segmented[distinct.index(MARK)] = [processor.piece_to_id(MARK)]
    lengths = np.fromiter(map(len, segmented), dtype=np.int64, count=len(segmented))
    starts = np.cumsum(lengths) - lengths
    flat = np.fromiter(chain.from_iterable(segmented), dtype=np.int32, count=int(lengths.sum()))
    order = table.indices.to_numpy()
    sizes = lengths[order]
    ends = np.cumsum(sizes)
    ids = flat[np.repeat(starts[order] - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]
    return ids, np.concatenate([[0], ends])[offsets - offsets[0]]


def _encode_whole(processor, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The same for texts that hold the break mark itself: each is encoded as a whole."""
    lists = processor.encode(texts.to_pylist(), num_threads=1)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    return np.concatenate([np.asarray(x, dtype=np.int32) for x in lists] or [np.empty(0, np.int32)]), bounds


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)``: every whole text with begin and end ids. Null texts count as empty.

    Rows, also repeated ones, keep their number; other columns are not carried. Needs no shuffle.
    """
    model = model_bytes(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, end = load(model).bos_id(), load(model).eos_id()
        for batch in slices(batches, size=CHUNK_CHARS):
            ids, bounds = encode_slice(model, batch.column(1))
            rows = [np.concatenate([[begin], ids[a:b], [end]]) for a, b in zip(bounds, bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["k", "ids"])

    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def decode(encoded: DataFrame, model_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(key, text)`` from id lists, as the library decodes them; a null list gives a null text."""
    model = model_bytes(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else load(model).decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["k", "text"])

    frame = encoded.select(encoded[key].alias("k"), encoded[ids].alias("i"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)


def digests(docs: DataFrame, model_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens, ids_sha256, decoded_sha256)``: encode and decode in one pass, without id lists in the plan."""
    model = model_bytes(model_path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model)
        begin, end = processor.bos_id(), processor.eos_id()
        for batch in slices(batches, size=CHUNK_CHARS):
            ids, bounds = encode_slice(model, batch.column(1))
            counts, hashes, decoded = [], [], []
            for a, b in zip(bounds, bounds[1:]):
                row = np.concatenate([[begin], ids[a:b], [end]])
                counts.append(len(row))
                hashes.append(hashlib.sha256(row.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(processor.decode(row.tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes),
                                              pa.array(decoded)], ["k", "n_tokens", "ids_sha256", "decoded_sha256"])

    frame = docs.select(docs[key].alias("k"), docs[text].alias("t"))
    kind = frame.schema["k"].dataType.simpleString()
    return frame.mapInArrow(run, f"k {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string") \
        .withColumnRenamed("k", key)
