"""Vocabularies and encodings: word, character and subword level."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlcorpus.functions import subword
from nlcorpus.functions.ordered import add_ordinal
from nlcorpus.functions.tiered import FREQUENT, code_arrays, stretches
from nlcorpus.operators.clean import valid_text
from nlcorpus.operators.trees import literal_text
from nlcorpus.session import bound_batches, materialize

# The special pieces and their ids.
SPECIALS = (("<pad>", 0), ("<unk>", 1), ("<s>", 2), ("</s>", 3))
UNK, BOS, EOS = 1, 2, 3
SPACE = "▁"
SLICE_CHARS = 1_000_000  # bytes of text whose pieces are held as Python objects at a time; a longer text makes a slice of its own


@F.pandas_udf(T.StringType())
def normalise_nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def with_specials(pieces: DataFrame) -> DataFrame:
    """Prepend the special pieces to a ``(piece, id, cnt)`` table."""
    spark = pieces.sparkSession
    special = spark.createDataFrame([(p, i, 0) for p, i in SPECIALS], "piece string, id long, cnt long")
    return special.unionByName(pieces.select("piece", "id", "cnt"))


def count_vocab(occurrences: DataFrame, piece: str | Column) -> DataFrame:
    """``(piece, id, cnt)`` of all distinct values, ids after the specials by (count desc, piece)."""
    value = F.col(piece) if isinstance(piece, str) else piece
    counts = occurrences.groupBy(value.alias("piece")).agg(F.count("*").alias("cnt"))
    return with_specials(add_ordinal(counts, [F.desc("cnt"), F.asc("piece")], "id", start=len(SPECIALS)))


def char_occurrences(df: DataFrame, text: str) -> DataFrame:
    """One row per character of the valid texts, spaces as the marker that pieces hold."""
    marked = df.where(valid_text(F.col(text))).select(F.replace(F.col(text), F.lit(" "), F.lit(SPACE)).alias("t"))
    return marked.select(F.explode(F.split("t", "")).alias("ch")).where("ch <> ''")


def word_counts(df: DataFrame, text: str, whitespace_as_suffix: bool = False, split_digits: bool = False,
                split_words: bool = True, add_dummy_prefix: bool = True) -> DataFrame:
    """Distinct training units and their counts, spaces shown as the marker.

    Units are words with their marker in front (or behind). Without ``split_words`` the whole text is one
    unit; with ``split_digits`` every digit is a unit of its own.
    """
    marked = F.replace(F.col(text), F.lit(" "), F.lit(SPACE))
    if add_dummy_prefix:
        marked = F.concat(marked, F.lit(SPACE)) if whitespace_as_suffix else F.concat(F.lit(SPACE), marked)
    word = rf"[^{SPACE}]*{SPACE}|[^{SPACE}]+" if whitespace_as_suffix else rf"{SPACE}?[^{SPACE}]+|{SPACE}"
    units = F.regexp_extract_all(marked, F.lit(word), 0) if split_words else F.array(marked)
    rows = df.select(F.explode(units).alias("word"))
    if split_digits:
        rows = rows.groupBy("word").agg(F.count("*").alias("c")).select(
            "c", F.explode(F.regexp_extract_all("word", F.lit(r"\d|\D+"), 0)).alias("word"))
        return rows.groupBy("word").agg(F.sum("c").alias("cnt"))
    return rows.groupBy("word").agg(F.count("*").alias("cnt"))


def bpe_vocab(words: DataFrame, vocab_size: int = 800, max_piece_length: int = 16,
              user_symbols: Sequence[str] = (), cut_every: int = 100) -> DataFrame:
    """Subword vocabulary ``(piece, id, score)`` by repeated merging of the most frequent pair.

    Only distinct units with their counts take part. A pass over them counts what many merges change, see
    :func:`nlcorpus.functions.subword.learned_merges`; units are written out, without finished ones, every ``cut_every``
    merges to cut their lineage.
    """
    units = materialize(words.where("word <> ''"), "bpe")
    chars = (units.select("cnt", F.explode(F.regexp_extract_all("word", F.lit("(?s)."), 0)).alias("ch")).groupBy("ch")
             .agg(F.sum("cnt").alias("cnt")))
    alphabet = [r["ch"] for r in chars.orderBy(F.desc("cnt"), "ch").collect()]  # Unicode bounds this
    room = vocab_size - len(SPECIALS) - len(user_symbols) - len(alphabet)
    if room < 0:
        raise ValueError(f"vocab_size {vocab_size} is smaller than the alphabet of {len(alphabet)}")
    merged = subword.learned_merges(units, alphabet, room, max_piece_length, cut_every) if room else []
    pieces = [p for p, _ in SPECIALS] + list(user_symbols) + merged + alphabet
    first = len(SPECIALS) + len(user_symbols)
    rows = [(p, i, float(first - i) if i >= first else 0.0) for i, p in enumerate(pieces)]
    return words.sparkSession.createDataFrame(rows, "piece string, id int, score double")


def vocab_ids(vocab: DataFrame) -> dict[str, int]:
    """Subword or character vocabulary as a dict.

    Its size is set by ``vocab_size`` or by the characters of Unicode, not by the corpus. Word vocabularies grow with
    the corpus and are joined instead (``vocab_lookup``).
    """
    return {r["piece"]: r["id"] for r in vocab.select("piece", "id").collect()}


def encode_nl(df: DataFrame, text: str, vocab: DataFrame, out: str = "nl_enc", out_pieces: str | None = None,
              **units) -> DataFrame:
    """Subword ids of a text between start and end id; every run of unknown characters gets one unknown id.

    Words are segmented in Arrow batches; a worker keeps the words it has seen for all its tasks, so nothing is shuffled.
    Pieces are Python objects for about ``SLICE_CHARS`` of text at a time, and are returned only where they are asked for.
    """
    bound_batches(df.sparkSession)
    shared = vocab.sparkSession.sparkContext.broadcast(vocab_ids(vocab))
    kinds = {"ids": pa.list_(pa.int32()), **({"pieces": pa.list_(pa.string())} if out_pieces else {})}

    @F.arrow_udf("ids array<int>" + ", pieces array<string>" * bool(out_pieces))
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids = shared.value
        segment = subword.worker_segmenter(ids, **units)
        for texts in batches:
            parts = [pa.array([], pa.struct(kinds))]
            for some in text_slices(texts):
                cut = [None if t is None else subword.unknown_runs(segment(t), ids) for t in some.to_pylist()]
                coded = [None if ps is None else [BOS, *(ids.get(p, UNK) for p in ps), EOS] for ps in cut]
                columns = {"ids": coded, "pieces": cut}
                parts.append(pa.StructArray.from_arrays([pa.array(columns[c], kinds[c]) for c in kinds], list(kinds)))
            yield pa.concat_arrays(parts)

    result = df.withColumn("__coded", encoded(F.col(text))).withColumn(out, F.col("__coded.ids"))
    return (result.withColumn(out_pieces, F.col("__coded.pieces")) if out_pieces else result).drop("__coded")


def text_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Texts cut so that those of a piece hold about ``SLICE_CHARS`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + SLICE_CHARS, side="right")))
        yield texts.slice(start, end - start)
        start = end


def decode_nl(ids: Column, vocab: DataFrame) -> Column:
    """Text of an id array: start and end dropped, pieces joined, markers to spaces. For subword vocabularies.

    An id outside the vocabulary reads as the unknown piece.
    """
    numbers = {i: p for p, i in vocab_ids(vocab).items()}
    shared = vocab.sparkSession.sparkContext.broadcast((list(numbers), list(numbers.values())))

    @F.arrow_udf("array<string>")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pieces = None
        for lists in batches:
            if known is None:
                known, pieces = pa.array(shared.value[0], pa.int64()), pa.array(shared.value[1], pa.string())
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            first = np.minimum(ends - sizes + 1, ends)
            inner = stretches(lists.flatten(), first, np.maximum(ends - 1, first))
            text = pieces.take(pc.index_in(inner.flatten(), known)).fill_null(SPECIALS[UNK][0])
            yield pa.ListArray.from_arrays(inner.offsets, text, mask=lists.is_null())

    return literal_text(spelled(ids.cast("array<long>")))


def encode_chars(df: DataFrame, pieces: str, char_vocab: DataFrame, out: str = "nl_char_enc") -> DataFrame:
    """Character ids of every piece, with an empty list for the start and the end."""
    shared = char_vocab.sparkSession.sparkContext.broadcast(vocab_ids(char_vocab))

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def spelled(cut: pd.Series) -> pd.Series:
        ids = shared.value
        return cut.map(lambda ps: None if ps is None else [
            [], *([ids.get(c, UNK) for c in p] for p in ps), []])

    return df.withColumn(out, spelled(F.col(pieces)))


def tree_labels(target_vocab: DataFrame, source_vocab: DataFrame, target_size: int) -> DataFrame:
    """``(label, id, cnt)`` of plain tokens and of string pieces, told apart by their first letter.

    String pieces take their source id plus the target size, an empty string the target size itself.
    """
    plain = target_vocab.where(F.col("id") != UNK).select(F.concat(F.lit("n"), "piece").alias("label"), F.col("id").cast("long"), "cnt")
    text = source_vocab.where((F.col("id") != UNK) & (F.col("piece") != "")).select(
        F.concat(F.lit("s"), "piece").alias("label"), (F.col("id") + target_size).cast("long").alias("id"), "cnt")
    empty = target_vocab.sparkSession.createDataFrame([("s", target_size, 1)], "label string, id long, cnt long")
    return plain.unionByName(text).unionByName(empty)


def encode_tree(records: DataFrame, tokens: str, is_string: str, target_vocab: DataFrame, source_vocab: DataFrame,
                target_size: int, out: str = "ast_seq_enc", frequent: int = FREQUENT, keep: bool = True) -> DataFrame:
    """``records`` with the ids of ``tokens`` between start and end id; ``is_string`` tells the string pieces among them.

    A record with any unknown token is dropped. Both vocabularies may be of any size: frequent tokens are coded in the
    record, only the others are looked up by a join (see :func:`nlcorpus.functions.tiered.code_arrays`). Without ``keep``
    the columns ``tokens`` and ``is_string`` are left out, and are not written on the way.
    """
    labels = F.transform(F.arrays_zip(F.col(tokens).alias("t"), F.col(is_string).alias("s")),
                         lambda x: F.concat(F.when(x["s"], "s").otherwise("n"), x["t"]))
    labelled = records.withColumn("__labels", labels)
    labelled = labelled if keep else labelled.drop(tokens, is_string)
    coded = code_arrays(labelled, "__labels", tree_labels(target_vocab, source_vocab, target_size),
                        "label", "id", "cnt", "__ids", frequent, keep=False)
    known = coded.where(~F.exists("__ids", lambda i: i.isNull()))
    ids = F.transform("__ids", lambda i: i.cast("int"))
    return known.withColumn(out, F.concat(F.array(F.lit(BOS)), ids, F.array(F.lit(EOS)))).drop("__ids")


def decode(records: DataFrame, ids: str, vocab: DataFrame, out: str = "text", frequent: int = FREQUENT,
           keep: bool = True) -> DataFrame:
    """``records`` with the text of ``ids``: start and end dropped, pieces joined, marker to space.

    A record of start and end alone has an empty text; an id outside the vocabulary reads as the unknown piece.
    Without ``keep`` the column ``ids`` is left out, and is not written on the way.
    """
    inner = F.filter(F.col(ids), lambda i: ~i.isin(BOS, EOS)).cast("array<bigint>")
    table = vocab.select(F.col("id").cast("long").alias("id"), "piece", "cnt")
    inside = records.withColumn("__inner", inner)
    coded = code_arrays(inside if keep else inside.drop(ids), "__inner", table, "id", "piece", "cnt", "__pieces", frequent, keep=False)
    named = F.transform("__pieces", lambda p: F.coalesce(p, F.lit(SPECIALS[UNK][0])))
    return coded.withColumn(out, F.replace(F.array_join(named, ""), F.lit(SPACE), F.lit(" "))).drop("__pieces")


def oov_report(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens outside the vocabulary with their counts. Tokens are counted before they are looked up."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("cnt"))
    known = vocab.select(F.col("piece").alias("token"))
    return counts.join(known, "token", "left_anti")
