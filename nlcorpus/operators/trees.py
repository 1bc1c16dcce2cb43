"""Trees of snippets and pages: parse, linearise, positions, child counts, depth, canonical order.

A snippet is parsed once, in Arrow batches; everything else reads the emitted columns. Pages give trees
from their tags without any Python. Windows here run over the exploded content of one record only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nlcorpus.functions import syntax
from nlcorpus.functions.subword import Segmenter

PARSED = {
    "parse_ok": ("boolean", pa.bool_()),
    "tokens": ("array<string>", pa.list_(pa.string())),
    "kinds": ("array<string>", pa.list_(pa.string())),
    "paths": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))),
    "fields": ("array<string>", pa.list_(pa.string())),
    "edge_counts": ("array<struct<label:string,type:string,cnt:int>>",
                    pa.list_(pa.struct([("label", pa.string()), ("type", pa.string()), ("cnt", pa.int32())]))),
    "max_depth": ("int", pa.int32()),
    "roundtrip_ok": ("boolean", pa.bool_()),
}
MEMO_TEXTS = 16_384  # parsed texts a task remembers, as Arrow columns, before it starts anew
MEMO_BYTES = 32_000_000  # and bytes of these columns, about
PARSED_AT_ONCE = 256  # texts whose trees are Python objects at a time, before they are Arrow columns
TOKEN_KINDS = ("node", "special", "literal", "strliteral")

# Elements without content, from the HTML standard.
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
             "track", "wbr")


def _profile(text: str | None, walk: syntax.Walk, want: Sequence[str]) -> tuple:
    """The wanted columns of one text; all null when it gives no tree."""
    tree = syntax.parse(text) if text is not None else None
    if tree is None:
        return (False, *[None] * len(want))
    found: dict = {}
    events = None
    if set(want) - {"roundtrip_ok"}:
        try:
            events = walk.sentence(tree)
        except RecursionError:
            return (False, *[None] * len(want))
        tokens = [e for e in events if e[1] in TOKEN_KINDS]
        found = {name: [t[i] for t in tokens] for name, i in
                 (("tokens", 0), ("kinds", 1), ("paths", 2), ("fields", 4)) if name in want}
        if "edge_counts" in want:
            found["edge_counts"] = [(label, kind, n) for label, kind, _, n, _ in events]
        found["max_depth"] = max(len(e[2]) for e in events) - 1
    if "roundtrip_ok" in want:
        found["roundtrip_ok"] = walk.same_after_reprint(tree, events)
    return (True, *[found[name] for name in want])


def parse_corpus(df: DataFrame, want: Sequence[str] = tuple(PARSED)[1:], snippet: str = "snippet",
                 piece_ids: dict[str, int] | None = None, units: dict | None = None) -> DataFrame:
    """Add ``parse_ok`` and the wanted columns of ``PARSED`` to every row, in one parse per text.

    Tokens, kinds, paths and fields cover the whole sentence with its start and end marker; rows that do not
    parse keep nulls. Other columns pass through as Arrow data; copies of a text are parsed and converted
    once, as tasks remember recent texts. With a subword vocabulary, string literals are
    cut into its pieces, by the unit options it was made with.
    """
    want = list(want)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    schema = ", ".join(fields + [f"{name} {PARSED[name][0]}" for name in ("parse_ok", *want)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = syntax.Walk(Segmenter(piece_ids, **(units or {})) if piece_ids else None)
        names = ("parse_ok", *want)
        places: dict[str | None, int] = {}
        held = [pa.array([], PARSED[name][1]) for name in names]
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(snippet)).dictionary_encode()
            distinct = [*texts.dictionary.to_pylist(), None]
            if len(places) > MEMO_TEXTS or sum(column.nbytes for column in held) > MEMO_BYTES:
                places.clear()
                held = [column[:0] for column in held]
            new = [t for t in distinct if t not in places]
            if new:
                parts = [held]
                for start in range(0, len(new), PARSED_AT_ONCE):
                    parsed = zip(*[_profile(t, walk, want) for t in new[start:start + PARSED_AT_ONCE]])
                    parts.append([pa.array(values, column.type) for column, values in zip(held, parsed)])
                held = [pa.concat_arrays(columns) for columns in zip(*parts)]
                places.update(zip(new, range(len(places), len(places) + len(new))))
            rows = pa.array([places[t] for t in distinct]).take(texts.indices.fill_null(len(distinct) - 1))
            columns = [column.take(rows) for column in held]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, batch.schema.names + list(names))

    return df.mapInArrow(run, schema)


def linearised(tokens: Column) -> Column:
    """The token list of a snippet without its sentence markers."""
    return F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 2, F.lit(0)))


def without_strings(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.endswith(syntax.STRING))


def only_strings(tokens: Column) -> Column:
    """Quoted text of the string literals."""
    return F.transform(F.filter(tokens, lambda t: t.endswith(syntax.STRING)),
                       lambda t: F.left(t, F.length(t) - len(syntax.STRING)))


@F.pandas_udf(T.ArrayType(T.StringType()))
def string_values(quoted: pd.Series) -> pd.Series:
    """Values of quoted literals; byte strings as Latin-1 text. Only literals are read, nothing is run."""
    import ast

    @lru_cache(maxsize=MEMO_TEXTS)
    def value(text: str) -> str:
        v = ast.literal_eval(text)
        return v.decode("latin-1") if isinstance(v, bytes) else v

    return quoted.map(lambda items: None if items is None else [value(t) for t in items])


def token_table(parsed: DataFrame, id_column: str) -> DataFrame:
    """``(id, pos, token, kind, path, field)``, as far as parsed, one row per token."""
    names = {"tokens": "token", "kinds": "kind", "paths": "path", "fields": "field"}
    there = [c for c in names if c in parsed.columns]
    return (parsed.where("parse_ok")
            .select(F.col(id_column).alias("id"), F.posexplode(F.arrays_zip(*there)).alias("pos", "t"))
            .select("id", "pos", *[F.col(f"t.{c}").alias(names[c]) for c in there]))


def edge_table(parsed: DataFrame, id_column: str) -> DataFrame:
    """Long child-count profile ``(id, label, type, cnt)``, one row per element and field."""
    return (parsed.where("parse_ok").select(F.col(id_column).alias("id"), F.inline("edge_counts")))


def failed_ids(parsed: DataFrame, id_column: str) -> DataFrame:
    """Ids whose snippet gave no tree."""
    return parsed.where(~F.col("parse_ok")).select(id_column)


def roundtrip_gate(parsed: DataFrame) -> DataFrame:
    """Only rows whose printed tree parses to the same tree."""
    return parsed.where("parse_ok and roundtrip_ok")


def tag_events(pages: DataFrame) -> DataFrame:
    """``(page_id, pos, tag, opens, level)``: tags in text order with their textual nesting level.

    ``level`` counts open minus close tags up to and including the row. Void elements are left out.
    """
    names = F.transform(F.regexp_extract_all("html", F.lit(r"<(/?[a-zA-Z][a-zA-Z0-9]*)"), 1), F.lower)
    w = (Window.partitionBy("page_id").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (pages.select("page_id", F.posexplode(names).alias("pos", "name"))
            .withColumn("opens", ~F.col("name").startswith("/"))
            .withColumn("tag", F.ltrim("name", F.lit("/")))
            .where(~F.col("tag").isin(*VOID_TAGS))
            .withColumn("level", F.sum(F.when(F.col("opens"), 1).otherwise(-1)).over(w))
            .select("page_id", F.col("pos").cast("long").alias("pos"), "tag", "opens", "level"))


def page_depth(events: DataFrame) -> DataFrame:
    return events.groupBy("page_id").agg(F.max("level").alias("max_depth"))


def tag_parents(events: DataFrame) -> DataFrame:
    """``(page_id, pos, tag, level, parent_pos, parent)`` for every opened element.

    Each element appears once as a possible parent at its level and once as a child one level up; the last
    parent seen before a child is its parent. This avoids matching positions against each other.
    """
    here = F.struct(F.col("pos").alias("pos"), F.col("tag").alias("tag"))
    roles = F.array(F.struct(F.col("level").alias("at"), here.alias("parent")),
                    F.struct((F.col("level") - 1).alias("at"), F.lit(None).cast("struct<pos:bigint,tag:string>")
                             .alias("parent")))
    w = (Window.partitionBy("page_id", "at").orderBy("pos")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (events.where("opens").withColumn("__role", F.explode(roles))
            .select("*", "__role.at", F.col("__role.parent").alias("__parent"))
            .withColumn("__last", F.last("__parent", ignorenulls=True).over(w))
            .where(F.col("__parent").isNull())
            .select("page_id", "pos", "tag", "level", F.col("__last.pos").alias("parent_pos"),
                    F.col("__last.tag").alias("parent")))


def page_profile(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Child-count profile ``(id, label, type, cnt)`` of pages: tags, their child lists, link texts.

    A child list counts its children and its end, as list fields of snippets do.
    """
    sizes = (elements.where(F.col("parent_pos").isNotNull())
             .groupBy("page_id", F.col("parent_pos").alias("pos")).agg(F.count("*").alias("n")))
    both = F.array(
        F.struct(F.col("tag").alias("label"), F.lit("node").alias("type"), F.lit(1).alias("cnt")),
        F.struct(F.concat("tag", F.lit("_children")).alias("label"), F.lit("list").alias("type"),
                 (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("cnt")))
    tags = (elements.join(sizes, ["page_id", "pos"], "left")
            .select(F.col("page_id").alias("id"), F.inline(both)))
    links = (pages.select(F.col("page_id").alias("id"),
                          F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))
             .select("id", F.concat("href", F.lit(syntax.STRING)).alias("label"),
                     F.lit("strliteral").alias("type"), F.lit(0).alias("cnt")))
    return tags.unionByName(links)


def canonical_order(children: DataFrame, record: str, parent_key: str, parent: str, name: str, index: str,
                    reorder: Sequence[str] = ("and", "or"),
                    first: Sequence[str] = ("flight", "from", "to")) -> DataFrame:
    """New 1-based index of every child: below ``reorder`` parents the ``first`` names lead, each part by
    name; below other parents the old order stays. Ties keep the old order."""
    moved = F.col(parent).isin(*reorder)
    rank = F.when(moved, F.when(F.col(name).isin(*first), 0).otherwise(1)).otherwise(0)
    label = F.when(moved, F.col(name)).otherwise("")
    w = Window.partitionBy(record, parent_key).orderBy(rank, label, index)
    return children.withColumn("new_index", F.row_number().over(w))


def literal_text(pieces: Column, add_dummy_prefix: bool = True) -> Column:
    """Text of a list of subword pieces: joined, one leading marker dropped, markers to spaces."""
    joined = F.array_join(pieces, "")
    if add_dummy_prefix:
        joined = F.regexp_replace(joined, "^▁", "")
    return F.replace(joined, F.lit("▁"), F.lit(" "))
