"""Corpus-shaped views of the given tables, as DataFrames and as SQL for the oracles.

The given tables hold no code corpus, so conversations stand in for notebooks and predictions, page tags for
syntax trees, document words for tokens, and line items are spelled as Python calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nlcorpus.functions import ordered
from nlcorpus.operators import decode, segment, trees

_VOID = ", ".join(f"'{t}'" for t in trees.VOID_TAGS)
_CODE_TOKENS = r"""list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(replace(replace({0}, '"',
 '`'), '''', '`'), '([^A-Za-z0-9_])', ' \1 ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '\s+', ' ', 'g'), ' '),
 lambda w: w <> '')"""


def code_tokens_sql(text: str) -> str:
    """SQL for the code tokens of a text column."""
    return _CODE_TOKENS.format(text)


_ORDERS = range(1, 5)
_PIVOT = ", ".join(f"max(m) FILTER (n = {n}) AS m{n}, max(p) FILTER (n = {n}) AS p{n}" for n in _ORDERS)


def bleu_sql(cand_len: str, ref_len: str, match: str, possible: str) -> str:
    """SQL for the score from summed columns; ``match`` and ``possible`` are name patterns with {}."""
    names = [(match.format(n), possible.format(n)) for n in _ORDERS]
    positive = " AND ".join(f"{m} > 0" for m, _ in names)
    mean = " + ".join(f"ln({m} / {p})" for m, p in names)
    return (f"CASE WHEN {positive} THEN exp(({mean}) / 4) * CASE WHEN {cand_len} > {ref_len} THEN 1.0 "
            f"ELSE exp(1 - {ref_len} / {cand_len}) END ELSE 0.0 END")


SQL_VIEWS: dict[str, tuple[str, str]] = {
    "cells": ("", """SELECT conv_id AS nb, turn AS pos, CASE role WHEN 'user' THEN 'markdown'
        WHEN 'assistant' THEN 'code' ELSE 'raw' END AS cell_type, text FROM conversations"""),
    "cells_prev": ("cells", """SELECT *, lag(cell_type) OVER (PARTITION BY nb ORDER BY pos) AS prev
        FROM cells WHERE cell_type <> 'raw'"""),
    "cells_block": ("cells_prev", """SELECT *, sum(CASE WHEN cell_type = 'markdown'
        AND prev IS DISTINCT FROM 'markdown' THEN 1 ELSE 0 END) OVER (PARTITION BY nb ORDER BY pos) AS block
        FROM cells_prev"""),
    "blocks": ("cells_block", """SELECT nb, CAST(block AS BIGINT) AS block,
        string_agg(text, chr(10) ORDER BY pos) FILTER (cell_type = 'markdown') AS intent,
        string_agg(text, chr(10) ORDER BY pos) FILTER (cell_type = 'code') AS snippet
        FROM cells_block WHERE block > 0 GROUP BY nb, block"""),
    "nbs": ("cells", """SELECT nb, row_number() OVER (ORDER BY nb) AS nb_no
        FROM (SELECT DISTINCT nb FROM cells)"""),
    "pairs_v": ("blocks nbs", """SELECT *, nb_no || '_' || pair_no AS id FROM (SELECT blocks.*, nb_no,
        row_number() OVER (PARTITION BY blocks.nb ORDER BY block) AS pair_no
        FROM blocks JOIN nbs ON blocks.nb = nbs.nb WHERE intent <> '' AND snippet <> '')"""),
    "tok": ("", """SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS token
        FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)"""),
    "doc_edges": ("", """SELECT doc_id, unnest(range(len(ws) - 1)) AS pos, unnest(ws[:-2]) AS parent,
        unnest(ws[2:]) AS child FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)"""),
    "item_edges": ("", """SELECT item_id, unnest(range(len(ws) - 1)) AS pos, unnest(ws[:-2]) AS parent,
        unnest(ws[2:]) AS child FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)"""),
    "turn_edges": ("", """SELECT unnest(ws[:-2]) AS parent, unnest(ws[2:]) AS child
        FROM (SELECT string_split(text, ' ') AS ws FROM conversations)"""),
    "lits": ("tok", """SELECT doc_id AS id, token AS literal, count(*) AS n FROM tok GROUP BY ALL"""),
    "lit_freq": ("lits", "SELECT literal, CAST(sum(n) AS BIGINT) AS freq FROM lits GROUP BY literal"),
    "tag_names": ("", """SELECT page_id, unnest(range(len(ns))) AS pos, lower(unnest(ns)) AS name
        FROM (SELECT page_id, regexp_extract_all(html, '<(/?[a-zA-Z][a-zA-Z0-9]*)', 1) AS ns FROM pages)"""),
    "tag_events": ("tag_names", f"""SELECT page_id, pos, ltrim(name, '/') AS tag, name NOT LIKE '/%' AS opens,
        CAST(sum(CASE WHEN name LIKE '/%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY pos)
        AS BIGINT) AS level FROM tag_names WHERE ltrim(name, '/') NOT IN ({_VOID})"""),
    "child_of": ("tag_events", """SELECT page_id, pos, tag, level, (SELECT max(p.pos) FROM tag_events p
        WHERE p.page_id = e.page_id AND p.opens AND p.level = e.level - 1 AND p.pos < e.pos) AS parent_pos
        FROM tag_events e WHERE opens"""),
    "elements": ("child_of", """SELECT c.*, p.tag AS parent FROM child_of c LEFT JOIN tag_events p
        ON p.page_id = c.page_id AND p.pos = c.parent_pos"""),
    "links": ("elements", """SELECT page_id, pos, parent, tag AS child FROM elements
        WHERE parent IS NOT NULL"""),
    "kids": ("child_of", """SELECT page_id, parent_pos AS pos, count(*) AS n FROM child_of
        WHERE parent_pos IS NOT NULL GROUP BY ALL"""),
    "profile": ("child_of kids", """SELECT page_id AS id, tag AS label, 'node' AS type, 1 AS cnt FROM child_of
        UNION ALL SELECT e.page_id, tag || '_children', 'list', CAST(coalesce(n, 0) + 1 AS INTEGER)
        FROM child_of e LEFT JOIN kids k ON k.page_id = e.page_id AND k.pos = e.pos
        UNION ALL SELECT page_id, href || '#strliteral', 'strliteral', 0
        FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""),
    "depths": ("tag_events", "SELECT page_id AS id, max(level) AS max_depth FROM tag_events GROUP BY page_id"),
    "answers": ("", """SELECT conv_id AS id, turn, text, CASE WHEN length(text) % 7 = 0 THEN NULL
        WHEN length(text) % 11 = 0 THEN '' ELSE text END AS pred FROM conversations WHERE role = 'assistant'"""),
    "ranked": ("answers", """SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY turn) AS rank
        FROM answers"""),
    "expected": ("answers", "SELECT id, arg_max(text, turn) AS expected FROM answers GROUP BY id"),
    "cand": ("ranked expected", """SELECT e.id, e.expected, r.rank, r.pred FROM expected e
        LEFT JOIN ranked r ON r.id = e.id"""),
    "valid_cand": ("cand", """SELECT id, pred, row_number() OVER (PARTITION BY id ORDER BY rank) - 1 AS rank
        FROM cand WHERE pred IS NOT NULL AND pred <> ''"""),
    "bleu_cand": ("valid_cand expected", f"""SELECT e.id, coalesce(v.rank, 0) AS rank, v.id IS NOT NULL AS scored,
        {code_tokens_sql('e.expected')} AS ref, CASE WHEN v.id IS NULL THEN [''] ELSE {code_tokens_sql('v.pred')} END
        AS cand FROM expected e LEFT JOIN valid_cand v ON v.id = e.id"""),
    "bleu_grams": ("bleu_cand", """SELECT id, rank, side, n, unnest(list_transform(range(1,
        greatest(CAST(len(ws) AS INTEGER) - n + 2, 1)), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS gram
        FROM (SELECT id, rank, 'c' AS side, cand AS ws FROM bleu_cand UNION ALL
        SELECT id, rank, 'r', ref FROM bleu_cand), (VALUES (1), (2), (3), (4)) AS orders(n)"""),
    "bleu_match": ("bleu_grams", """SELECT id, rank, n, sum(least(c, r)) AS m FROM (SELECT id, rank, n, gram,
        count(*) FILTER (side = 'c') AS c, count(*) FILTER (side = 'r') AS r FROM bleu_grams GROUP BY ALL)
        GROUP BY ALL"""),
    "bleu_stats": ("bleu_match", f"""SELECT *, CASE WHEN scored THEN {bleu_sql('cand_len', 'ref_len', 'm{}', 'p{}')}
        ELSE 0.0 END AS bleu FROM (SELECT id, rank, scored, len(ref) AS ref_len, len(cand) AS cand_len, {_PIVOT} FROM (
        SELECT c.*, o.n, coalesce(m, 0) AS m, greatest(CAST(len(cand) AS INTEGER) - o.n + 1, 0) AS p FROM bleu_cand c
        CROSS JOIN (VALUES (1), (2), (3), (4)) AS o(n)
        LEFT JOIN bleu_match b ON b.id = c.id AND b.rank = c.rank AND b.n = o.n) GROUP BY ALL)"""),
    "seq_text": ("", """SELECT d.doc_id AS id, string_split(d.text, ' ') AS expected, CASE d.doc_id % 3
        WHEN 1 THEN string_split(d.text, ' ')
        WHEN 0 THEN string_split(d.text, ' ')[1:len(string_split(d.text, ' ')) * 8 // 10]
        ELSE coalesce(string_split(n.text, ' '), []) END AS predicted
        FROM documents d LEFT JOIN documents n ON n.doc_id = d.doc_id + 1"""),
    "seq_rows": ("seq_text", """SELECT id, unnest(range(len(expected))) AS pos, unnest(expected) AS token, 'e' AS side
        FROM seq_text UNION ALL
        SELECT id, unnest(range(len(predicted))), unnest(predicted), 'p' FROM seq_text"""),
    "seq_ids": ("seq_rows", """SELECT id, side, pos, length(token) * 1000
        + CASE WHEN token = '' THEN 0 ELSE ascii(token) END AS x FROM seq_rows"""),
    "seq_plain": ("seq_ids", """SELECT coalesce(e.id, p.id) AS id, coalesce(e.pos, p.pos) AS pos, e.x AS ex, p.x AS px
        FROM (SELECT * FROM seq_ids WHERE side = 'e') e FULL JOIN (SELECT * FROM seq_ids WHERE side = 'p') p
        ON e.id = p.id AND e.pos = p.pos"""),
    "seq_short": ("seq_ids", """SELECT id, side, row_number() OVER (PARTITION BY id, side ORDER BY pos) - 1 AS pos,
        least(x, 6001) AS x FROM (SELECT *, lag(x) OVER (PARTITION BY id, side ORDER BY pos) AS before
        FROM seq_ids) WHERE NOT (x > 6000 AND coalesce(before, 0) > 6000)"""),
    "seq_replaced": ("seq_short", """SELECT coalesce(e.id, p.id) AS id, coalesce(e.pos, p.pos) AS pos,
        e.x AS ex, p.x AS px
        FROM (SELECT * FROM seq_short WHERE side = 'e') e FULL JOIN (SELECT * FROM seq_short WHERE side = 'p') p
        ON e.id = p.id AND e.pos = p.pos"""),
    "scores": ("seq_plain seq_replaced", """SELECT a.id, prefix_len, expected_len, predicted_len,
        replaced_prefix_len, replaced_expected_len, replaced_predicted_len FROM
        (SELECT id, CAST(count(ex) AS INTEGER) AS expected_len, CAST(count(px) AS INTEGER) AS predicted_len,
         CAST(coalesce(min(pos) FILTER (ex IS DISTINCT FROM px), count(*)) AS INTEGER) AS prefix_len
         FROM seq_plain GROUP BY id) a JOIN
        (SELECT id, CAST(count(ex) AS INTEGER) AS replaced_expected_len,
         CAST(count(px) AS INTEGER) AS replaced_predicted_len,
         CAST(coalesce(min(pos) FILTER (ex IS DISTINCT FROM px), count(*)) AS INTEGER) AS replaced_prefix_len
         FROM seq_replaced GROUP BY id) b ON a.id = b.id"""),
    "top_words": ("tok", """SELECT doc_id, token, rn FROM (SELECT doc_id, token, row_number() OVER (
        PARTITION BY doc_id ORDER BY count(*) DESC, token) AS rn FROM tok WHERE token <> ''
        GROUP BY doc_id, token) WHERE rn <= 3"""),
    "snip": ("", """SELECT l_orderkey, l_linenumber, l_quantity, l_tax, l_orderkey % 50 <> 0 AS closed,
        'q' || l_linenumber || ' = scale(' || l_quantity || ',tax=' || l_tax || ')' AS ok_text,
        'q' || l_linenumber || ' = scale(' || l_quantity || ',tax=' || l_tax
        || CASE WHEN l_orderkey % 50 <> 0 THEN ')' ELSE '' END AS snippet FROM lineitem"""),
    "doc_ids": ("", """SELECT doc_id AS id, list_transform(string_split(text, chr(10)),
        lambda t: CAST(length(t) AS INTEGER)) AS nl_enc, list_transform(string_split(text, ' '),
        lambda t: CAST(length(t) AS INTEGER)) AS ast_seq_enc, text FROM documents"""),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the named views and everything they build on."""
    ordered: list[str] = []

    def add(name: str) -> None:
        needs, _ = SQL_VIEWS[name]
        for need in needs.split():
            add(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    if not ordered:
        return body
    parts = ",\n".join(f"{name} AS ({SQL_VIEWS[name][1]})" for name in ordered)
    return f"WITH {parts}\n{body}"


def words(text: str | Column) -> Column:
    return F.split(text, " ")


def cells(t) -> DataFrame:
    """Conversations as notebook cells: questions are text, answers are code, system turns irregular."""
    kind = F.when(F.col("role") == "user", "markdown").when(F.col("role") == "assistant", "code").otherwise("raw")
    return t.conversations.select(F.col("conv_id").alias("nb"), F.col("turn").alias("pos"),
                                  kind.alias("cell_type"), "text")


def pairs(t) -> DataFrame:
    """``(nb, block, intent, snippet, pair_no, nb_no, id)``."""
    source = cells(t)
    return segment.pair_ids(segment.cells_to_pairs(source), source)


def tokens(t) -> DataFrame:
    """``(doc_id, pos, token)``."""
    return t.documents.select("doc_id", F.posexplode(words("text")).alias("pos", "token"))


def successions(texts: DataFrame, key: str) -> DataFrame:
    """``(key, pos, parent, child)``: every word with the next one, as edges of a grammar."""
    pairs = F.arrays_zip(words("text").alias("parent"), F.slice(words("text"), 2, 2 ** 31 - 1).alias("child"))
    return (texts.select(key, F.posexplode(pairs).alias("pos", "e"))
            .select(key, F.col("pos").cast("long").alias("pos"), "e.parent", "e.child").where("child is not null"))


def literals(t) -> DataFrame:
    """Per-document word histogram ``(id, literal, n)``; a document's words combine in the task that splits it."""
    return (t.documents.select(F.col("doc_id").alias("id"), F.explode(words("text")).alias("literal"))
            .groupBy("id", "literal").agg(F.count("*").alias("n")))


def owned_words(t) -> DataFrame:
    """``(id, literal)``: the distinct words of each document, found inside the row."""
    return t.documents.select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(words("text"))).alias("literal"))


def word_frequency(t) -> DataFrame:
    """``(literal, freq)`` over all documents; only one row per word and task is shuffled."""
    return t.documents.select(F.explode(words("text")).alias("literal")).groupBy("literal").agg(
        F.count("*").alias("freq"))


def elements(t) -> DataFrame:
    return trees.tag_parents(trees.tag_events(t.pages))


def links(t) -> DataFrame:
    """``(page_id, pos, parent, child)`` for elements with a parent."""
    return elements(t).where(F.col("parent").isNotNull()).select(
        "page_id", "pos", "parent", F.col("tag").alias("child"))


def profile(t) -> DataFrame:
    return trees.page_profile(t.pages, elements(t))


def depths(t) -> DataFrame:
    return trees.page_depth(trees.tag_events(t.pages)).withColumnRenamed("page_id", "id")


def predictions(t) -> tuple[DataFrame, DataFrame]:
    """``inputs`` and ``candidates``: a conversation's last answer against its answers in turn order.

    All answers are predictions, so the last one is among them unless it is made null or empty, as some are.
    """
    answers = t.conversations.where("role = 'assistant'").withColumnRenamed("conv_id", "id")
    n = F.length("text")
    made = answers.select("id", "turn", F.when(n % 7 != 0, F.when(n % 11 == 0, "").otherwise(F.col("text"))).alias("predicted"))
    ranked = ordered.number_rows(made, ["id"], "turn", "rank", ordered.chunk_of(F.col("turn")))
    return answers.groupBy("id").agg(F.max_by("text", "turn").alias("expected")), ranked.select("id", "rank", "predicted")


def token_ids(tokens: Column) -> Column:
    """Surrogate ids of words: length and first character."""
    return F.transform(tokens, lambda x: F.length(x) * 1000 + F.ascii(x))


LITERAL_LIMIT = 6000  # surrogate ids above this (words of six letters and more) count as literals


def sequences(t) -> DataFrame:
    """``(id, expected, predicted)`` word lists: equal, cut to 80 %, or the next document's."""
    docs = t.documents.select(F.col("doc_id").alias("id"), words("text").alias("expected"))
    following = t.documents.select((F.col("doc_id") - 1).alias("id"), words("text").alias("next"))
    cut = F.slice("expected", F.lit(1), F.floor(F.size("expected") * 8 / 10).cast("int"))
    third = F.col("id") % 3
    return (docs.join(following.where("id % 3 = 2"), "id", "left")
            .withColumn("predicted", F.when(third == 1, F.col("expected")).when(third == 0, cut)
                        .otherwise(F.coalesce("next", F.array().cast("array<string>"))))
            .drop("next"))


def sequence_ids(t) -> DataFrame:
    return sequences(t).select("id", token_ids(F.col("expected")).alias("expected"),
                               token_ids(F.col("predicted")).alias("predicted"))


def top_words(t) -> DataFrame:
    """``(doc_id, names)``: up to three most frequent words of each document, as an array."""
    counts = literals(t).where("literal <> ''")
    ranked = decode.rank_candidates(counts.withColumn("less", -F.col("n")), ["id"], "less", "literal", 3)
    return decode.prediction_table(ranked, "id", {"literal": "names"}).withColumnRenamed("id", "doc_id")


def replacements(t) -> DataFrame:
    """Documents with a placeholder map for their most frequent words."""
    mapping = F.map_from_arrays("names", F.transform(
        "names", lambda x, i: F.concat(F.lit("STR_"), i.cast("string"))))
    return t.documents.join(top_words(t).withColumn("replacements", mapping), "doc_id")


def snippets(t) -> DataFrame:
    """Line items as Python calls; every fiftieth order lacks the closing bracket."""
    closing = F.when(F.col("l_orderkey") % 50 != 0, ")").otherwise("")
    text = F.concat(F.lit("q"), "l_linenumber", F.lit(" = scale("), "l_quantity", F.lit(",tax="), "l_tax", closing)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", text.alias("snippet"))


def encoded(t) -> DataFrame:
    """``(id, nl_enc, ast_seq_enc, text)``: lengths of the lines and of the words of each document."""
    lengths = lambda parts: F.transform(parts, lambda x: F.length(x))
    return t.documents.select(F.col("doc_id").alias("id"), lengths(F.split("text", "\n")).alias("nl_enc"),
                              lengths(words("text")).alias("ast_seq_enc"), "text")


def order_code(t) -> DataFrame:
    """Orders as pairs: ``(id, intent, snippet)`` with a sentence and the call it describes."""
    intent = F.concat(F.lit("place an order of "), F.lower("o_orderpriority"), F.lit(" priority for customer "),
                      "o_custkey", F.lit(" with status "), "o_orderstatus")
    snippet = F.concat(F.lit("order_"), "o_custkey", F.lit(" = place('"), "o_orderpriority", F.lit("', status='"),
                       "o_orderstatus", F.lit("', total="), F.floor(F.col("o_totalprice") / 1000), F.lit(")"))
    return t.orders.select(F.col("o_orderkey").alias("id"), intent.alias("intent"), snippet.alias("snippet"))
