"""Grammar tables observed in a corpus: which child types occur under which parent field."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.functions.keyed import lookup_join
from nlcorpus.session import materialize

NONE = "None" + syntax.LITERAL
SIEVE_BITS = 29  # a sieve has at most 2 to that power of bits, 64 MB, however large the grammar


def extract_edges(links: DataFrame, order: list[str]) -> DataFrame:
    """``(parent, child, cnt, first_seen)`` from ``(parent, child, …)`` rows; counts combine map-side.

    ``first_seen`` is the smallest value of the ``order`` columns, so rows can be ranked by appearance.
    """
    return links.groupBy("parent", "child").agg(F.count("*").alias("cnt"),
                                                F.min(F.struct(*order)).alias("first_seen"))


def sentence_edges(tokens: DataFrame) -> DataFrame:
    """``(field, child, kind, cnt, first_seen)``: which tokens stand in which field of parsed snippets."""
    return tokens.where("field <> ''").groupBy("field", F.col("token").alias("child"), "kind").agg(
        F.count("*").alias("cnt"), F.min(F.struct("id", "pos")).alias("first_seen"))


def field_kinds(edges: DataFrame) -> DataFrame:
    """``(field, kind, cnt)``: a field that was ever closed by a list end is a list, any other a singleton."""
    closed = F.max((F.col("child") == syntax.LIST_END).cast("int")) == 1
    return edges.groupBy("field").agg(F.when(closed, "list").otherwise("singleton").alias("kind"),
                                      F.sum("cnt").alias("cnt"))


def next_fields(fields: Column, kinds: Column) -> Column:
    """Per token the field open after it and whether a text run goes on there; null after the last token.

    Together with :func:`field_children` this tells the allowed next tokens without repeating a set per token.
    """
    return F.transform(fields, lambda f, i: F.when(i + 1 < F.size(fields), F.struct(
        F.get(fields, i + 1).alias("field"), (F.get(kinds, i) == "strliteral").alias("in_text"))))


def field_children(edges: DataFrame, value: str) -> DataFrame:
    """``(field, in_text, allowed)``, one row per allowed value. Inside a text run ``None#literal`` is left out.

    Fields may have as many children as there are literals, so no set is collected.
    """
    spots = F.when(F.col("child") == "None" + syntax.LITERAL, F.array(F.lit(False))).otherwise(
        F.array(F.lit(False), F.lit(True)))
    return edges.select("field", F.explode(spots).alias("in_text"), F.col(value).alias("allowed")).distinct()


@dataclass(frozen=True)
class ChildSets:
    """The children that every parent allows, with equal sets kept once.

    ``parents (parent, set_id, n_children, any_text)`` names the set of each parent; a set is named by its least parent.
    ``members (set_id, child)`` is the dictionary. Where ``any_text`` is set, the parent also allows every row of
    ``literals (child)``, and its own set holds none of them, so that text fields that differ only in their texts share
    a set. ``pairs (parent, child)``, where given, are all pairs that the sets were made of.
    """

    parents: DataFrame
    members: DataFrame
    literals: DataFrame
    pairs: DataFrame | None = None


def intern_sets(edges: DataFrame, list_end: bool = False, text_fields: DataFrame | None = None,
                is_text: Column | None = None) -> ChildSets:
    """Child sets of the edges ``(parent, child, …)``; edges with a null end are left out.

    ``list_end`` adds the list end to every set. With ``text_fields (parent)`` every text literal of the grammar
    (``is_text`` of ``child``) is allowed in each of these fields. No set is collected: a set is told by its size and two
    independent sums of hashes, which combine before the shuffle however many children a parent has.
    """
    pairs = edges.where("parent is not null and child is not null").select("parent", "child").distinct()
    ruled = text_fields is not None
    text = is_text if ruled and is_text is not None else F.lit(False)
    literals = materialize(pairs.where(text).select("child").distinct(), "text-literals")
    if list_end:
        pairs = pairs.unionByName(pairs.select("parent", F.lit(syntax.LIST_END).alias("child")).distinct()).distinct()
    pairs = materialize(pairs.withColumn("__text", text), "grammar-pairs")
    # A text literal has no part in the fingerprint of a field that allows all of them.
    sums = lambda keep: [F.count_if(keep).alias("n"), *[F.coalesce(F.bit_xor(F.when(keep, F.xxhash64(F.lit(seed), "child"))),
                                                                   F.lit(0)).alias(f"h{seed}") for seed in (0, 1)]]
    plain, whole = F.struct(*sums(~F.col("__text"))), F.struct(*sums(F.lit(True)))
    prints = pairs.groupBy("parent").agg(F.count("*").alias("n_children"), plain.alias("plain"), whole.alias("whole"))
    if ruled:
        flagged = text_fields.select("parent").where("parent is not null").distinct().withColumn("any_text", F.lit(True))
        prints = prints.join(flagged, "parent", "left").withColumn("any_text", F.coalesce("any_text", F.lit(False)))
    else:
        prints = prints.withColumn("any_text", F.lit(False))
    prints = prints.withColumn("print", F.when(F.col("any_text"), F.col("plain")).otherwise(F.col("whole")))
    prints = materialize(prints.select("parent", "n_children", "any_text", "print.*"), "set-prints")
    same = ["n", "h0", "h1"]
    names = prints.groupBy(*same).agg(F.min("parent").alias("set_id"))
    parents = materialize(prints.join(names, same).select("parent", "set_id", "n_children", "any_text"), "child-sets")
    # A set's name is one of its parents; should that parent allow all text, its own set is without it, as the set is.
    owned = lookup_join(pairs, parents.where("parent = set_id"), "parent", "n_children", ["child"], "inner")
    members = owned.where(~(F.col("any_text") & F.col("__text"))).select("set_id", "child")
    return ChildSets(parents, materialize(members, "set-members"), literals, pairs.select("parent", "child"))


def allowed_children(steps: DataFrame, sets: ChildSets, spread: list[str], field: str = "open_parent",
                     spelled: bool = False) -> DataFrame:
    """``steps`` with ``set_id`` and ``any_text`` of the field open after each, which say what may come next.

    The set itself is in ``sets.members``; with ``spelled`` every step also gets its members, sorted and joined by
    spaces, as ``allowed``. Fields outside the grammar get nulls. A step inside a text run (see :func:`allowed`) has the
    same set without ``None#literal``. Frequent fields are salted.
    """
    counts = steps.groupBy(field).agg(F.count("*").alias("__n"))
    table = counts.join(sets.parents.withColumnRenamed("parent", field), field, "left")
    names = [field, "__n", "set_id", "any_text"]
    if spelled:
        text = F.array_join(F.array_sort(F.collect_list("child")), " ")
        table = table.join(sets.members.groupBy("set_id").agg(text.alias("allowed")), "set_id", "left")
        names.append("allowed")
    return lookup_join(steps, table.select(*names), field, "__n", spread).drop("__n")


def allowed(rows: DataFrame, sets: ChildSets, field: str, child: str, spread: list[str], out: str = "allowed",
            in_text: str | None = None) -> DataFrame:
    """``rows`` with ``out``: whether the grammar allows ``child`` in ``field``.

    It does when the child is a member of the field's set, or a text literal and the field allows any text. Where the
    column ``in_text`` is true, ``None#literal`` is not allowed. Every distinct pair is decided once; rows with a null end
    are not allowed.
    """
    key = F.struct(F.col(field).alias("parent"), F.col(child).alias("child"))
    keyed = rows.withColumn("__key", key).drop(field, child)  # the key brings them back
    pairs = keyed.groupBy("__key").agg(F.count("*").alias("__cnt")).select("__key", "__cnt", "__key.parent", "__key.child")
    named = lookup_join(pairs, sets.parents, "parent", "n_children", ["child"])
    listed = sets.members.withColumn("__member", F.lit(True))
    texts = sets.literals.withColumn("__literal", F.lit(True))
    verdict = F.coalesce("__member", F.lit(False)) | F.coalesce(F.col("__literal") & F.col("any_text"), F.lit(False))
    table = (named.join(listed, ["set_id", "child"], "left").join(texts, "child", "left")
             .select("__key", "__cnt", verdict.alias(out)))
    marked = lookup_join(keyed, table, "__key", "__cnt", spread).withColumns(
        {field: F.col("__key.parent"), child: F.col("__key.child")}).select(*rows.columns, out)
    ok = F.coalesce(F.col(out), F.lit(False))
    return marked.withColumn(out, ok if in_text is None else ok & ~(F.col(in_text) & (F.col(child) == NONE)))


def nonconforming(links: DataFrame, sets: ChildSets, id_column: str) -> DataFrame:
    """Observed links ``(parent, child, pos, …)`` that the grammar does not allow, with their record ids.

    A sieve of the grammar, which passes all that is allowed, tells most other links where they are; only links that pass
    are shuffled, and looked up exactly.
    """
    verdicts = lambda rows: allowed(rows, sets, "parent", "child", [id_column, "pos"], "__allowed").where("not __allowed")
    if sets.pairs is None:
        return verdicts(links).drop("__allowed")
    passes = F.coalesce(_sieve(sets)(F.col("parent"), F.col("child")), F.lit(False))
    sifted = links.withColumn("__passes", passes)
    rest = verdicts(sifted.where("__passes").drop("__passes")).drop("__allowed")
    return sifted.where("not __passes").drop("__passes").unionByName(rest)


def _sieve(sets: ChildSets):
    """A function of parent and child that is true for all pairs that may be allowed, and for few others.

    A Bloom filter of two bits for each pair, each text literal and each field that allows all of these, sized by their
    number. Its words are formed by a grouping; null ends never pass.
    """
    code = lambda kind, *columns: F.xxhash64(F.lit(kind), *columns)
    kinds = [sets.pairs.select(code(0, "parent", "child").alias("h")), sets.literals.select(code(1, "child").alias("h")),
             sets.parents.where("any_text").select(code(2, "parent").alias("h"))]
    codes = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    size = min(max(codes.count() * 8, 64).bit_length(), SIEVE_BITS)
    places = F.array(*[F.shiftrightunsigned("h", 64 - size) if n == 0 else F.col("h").bitwiseAND((1 << size) - 1) for n in (0, 1)])
    bit = F.shiftright(F.lit(0).cast("long") + F.col("at"), 6)
    words = (codes.select(F.explode(places).alias("at"))
             .groupBy(bit.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))).toArrow()
    table = np.zeros(1 << (size - 6), np.uint64)
    table[words.column(0).to_numpy()] = words.column(1).to_numpy().view(np.uint64)
    shared = sets.pairs.sparkSession.sparkContext.broadcast(table)

    def held(codes: pd.Series) -> np.ndarray:
        code, bits = codes.to_numpy(np.int64).view(np.uint64), shared.value
        found = np.ones(len(code), bool)
        for at in (code >> np.uint64(64 - size), code & np.uint64((1 << size) - 1)):
            found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    @F.pandas_udf("boolean")
    def passes(pair: pd.Series, text: pd.Series, field: pd.Series) -> pd.Series:
        return pd.Series(held(pair) | (held(text) & held(field)))

    return lambda parent, child: F.when(parent.isNotNull() & child.isNotNull(),
                                        passes(code(0, parent, child), code(1, child), code(2, parent)))


def edge_stats(train: DataFrame, test: DataFrame) -> DataFrame:
    """Per child kind: edge and parent counts of both grammars, mean children, and test edges not in train.

    Both inputs hold distinct ``(parent, child, kind)`` edges.
    """
    def side(edges: DataFrame, name: str) -> DataFrame:
        return edges.groupBy("kind").agg(
            F.count("*").alias(f"{name}_edges"), F.countDistinct("parent").alias(f"{name}_parents"),
            F.round(F.count("*") / F.countDistinct("parent"), 6).alias(f"{name}_mean"))

    extra = (test.join(train, ["parent", "child", "kind"], "left_anti")
             .groupBy("kind").agg(F.count("*").alias("new_edges")))
    return (side(train, "train").join(side(test, "test"), "kind", "full_outer").join(extra, "kind", "left")
            .withColumn("new_edges", F.coalesce("new_edges", F.lit(0))))
