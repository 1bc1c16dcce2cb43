"""From pairs to training data: parse, vocabularies, grammar, encodings, train and statistics tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.functions.keyed import first_of_each
from nlcorpus.functions.ordered import add_ordinal
from nlcorpus.functions.tiered import code_arrays
from nlcorpus.operators import clean, dataset, grammar, trees, vocab
from nlcorpus.session import materialize

PARSED_ROWS = 8_192  # pairs that a task parses, about


@dataclass
class Vocabularies:
    source: DataFrame  # (piece, id, score): subwords of intents and string literals
    characters: DataFrame  # (piece, id, cnt)
    target: DataFrame  # (piece, id, cnt): all tokens but string literals
    target_size: int


@dataclass
class Prepared:
    vocabularies: Vocabularies
    grammar: DataFrame  # (field, child, kind, cnt, first_seen, id)
    allowed: DataFrame  # (field, in_text, allowed)
    train: DataFrame
    stats: DataFrame


def train_texts(parsed: DataFrame) -> DataFrame:
    """Valid intents and string literal values, the input of the source and character vocabularies."""
    strings = trees.string_values(trees.only_strings(F.col("tokens")))
    literals = parsed.select(F.explode(strings).alias("text"))
    return parsed.select(F.col("nl").alias("text")).unionByName(literals).where(clean.valid_text(F.col("text")))


def numbered(pairs: DataFrame) -> DataFrame:
    """Pairs written once with ``rec``, a number of their own that follows ingest order.

    Ids may repeat; records are told apart, joined and compared by ``rec``. Where there is no id, it is the 0-based
    row number. Parsing takes most of the time and a file of a few MB holds very many pairs, so they are dealt out by
    their number at ``PARSED_ROWS`` a task, however they were read.
    """
    if "id" not in pairs.columns:
        rows = pairs.withColumn("__at", F.monotonically_increasing_id())
        pairs = add_ordinal(rows, ["__at"], "id", start=0).drop("__at")
    rows = materialize(pairs.withColumn("rec", F.monotonically_increasing_id()), "pairs")
    return rows.repartition(max(1, -(-rows.count() // PARSED_ROWS)), "rec")


def build_vocabularies(pairs: DataFrame, vocab_size: int = 800, units: dict | None = None, **bpe) -> Vocabularies:
    """Vocabularies of the pairs ``(nl, snippet)`` that parse; ``units`` are the options of ``vocab.word_counts``."""
    parsed = materialize(trees.parse_corpus(pairs, ("tokens",)).where("parse_ok").select("nl", "tokens"), "parsed")
    texts = train_texts(parsed)
    plain = parsed.select(F.explode(trees.without_strings(trees.linearised(F.col("tokens")))).alias("token"))
    target = vocab.count_vocab(plain, "token")
    return Vocabularies(source=materialize(vocab.bpe_vocab(vocab.word_counts(texts, "text", **(units or {})), vocab_size,
                                                           **bpe), "vocab"),
                        characters=vocab.count_vocab(vocab.char_occurrences(texts, "text"), "ch"),
                        target=target, target_size=target.count())


def label_ids(v: Vocabularies) -> DataFrame:
    """``(token, id)`` for every token of a piece-level sentence: target ids, then shifted source ids."""
    shifted = F.col("id").cast("long") + v.target_size
    source = v.source.where(F.col("id") > vocab.UNK).select(
        F.concat("piece", F.lit(syntax.STRING)).alias("token"), shifted.alias("id"))
    empty = v.source.where("id = 0").select(F.lit(syntax.STRING).alias("token"), shifted.alias("id"))
    target = v.target.where(F.col("id") != vocab.UNK).select(F.col("piece").alias("token"), "id")
    return target.unionByName(source).unionByName(empty)


def prepare(pairs: DataFrame, vocabularies: Vocabularies | None = None, vocab_size: int = 800,
            eliminate_duplicates: bool = False, check_roundtrip: bool = True, units: dict | None = None,
            **bpe) -> Prepared:
    """Training and statistics tables of pairs ``([id,] intent, snippet[, rewritten_intent])``.

    Records that do not parse, do not survive the round trip, or hold an unknown token are dropped; ids may repeat.
    The allowed tokens of a position are given as the open field, to be looked up in ``allowed``. ``units`` (digit
    splitting, spaces as suffix, no dummy prefix, unsplit texts) hold for training and encoding alike.
    """
    pairs = clean.coalesce_intent(numbered(pairs))
    pairs = clean.drop_null_rows(pairs, ["id", "nl"]).select("rec", "id", "nl", "snippet")
    v = vocabularies or build_vocabularies(pairs, vocab_size, units, **bpe)
    wanted = ["tokens", "kinds", "paths", "fields", "edge_counts", "max_depth"] + ["roundtrip_ok"] * check_roundtrip
    parsed = trees.parse_corpus(pairs, wanted, piece_ids=vocab.vocab_ids(v.source), units=units).where("parse_ok")
    parsed = materialize(trees.roundtrip_gate(parsed) if check_roundtrip else parsed, "parsed")

    tokens = trees.token_table(parsed, "rec")  # its id is the record number
    counts = tokens.groupBy("token").agg(F.count("*").alias("cnt"))
    known = materialize(counts.join(label_ids(v).withColumnRenamed("id", "label_id"), "token", "left"), "labels")
    named = code_arrays(parsed.select("rec", "tokens"), "tokens", known.where("label_id is not null"), "token", "label_id", "cnt",
                        "labels")
    encoded = named.where(~F.exists("labels", lambda i: i.isNull())).select(
        "rec", F.transform("labels", lambda i: i.cast("int")).alias("ast_seq_enc"))

    edges = grammar.sentence_edges(tokens).join(known.select(F.col("token").alias("child"), F.col("label_id").alias(
        "child_id")), "child")
    rows = vocab.encode_nl(parsed, "nl", v.source, out_pieces="nl_pieces", **(units or {})).join(encoded, "rec")
    rows = (vocab.encode_chars(rows, "nl_pieces", v.characters)
            .withColumn("allowed_tokens", grammar.next_fields(F.col("fields"), F.col("kinds")))
            .withColumn("ast_seq", F.array_join(trees.linearised(F.col("tokens")), " "))
            .withColumnRenamed("paths", "edge_order_seq"))
    _, stats = dataset.preproc_outputs(rows)
    kept = first_of_each(rows, ["nl_enc", "ast_seq_enc"], "rec") if eliminate_duplicates else rows
    train, _ = dataset.preproc_outputs(kept)
    return Prepared(v, edges, grammar.field_children(edges, "child_id"), train, stats)


def prepare_test(pairs: DataFrame, v: Vocabularies, units: dict | None = None) -> DataFrame:
    """Test table: encoded intents with snippet and token list; nothing is dropped."""
    rows = clean.coalesce_intent(pairs)
    rows = trees.parse_corpus(rows.select("id", "nl", "snippet"), ("tokens",))
    rows = rows.withColumn("ast_seq_list", trees.linearised(F.col("tokens")))
    rows = vocab.encode_nl(rows, "nl", v.source, out_pieces="nl_pieces", **(units or {}))
    return dataset.test_set(vocab.encode_chars(rows, "nl_pieces", v.characters))
