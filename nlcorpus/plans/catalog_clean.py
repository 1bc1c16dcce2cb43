"""Queries for projections, filters, joins, set operations and notebook segmentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.functions.tiered import code_arrays
from nlcorpus.operators import clean, dataset, joins, segment, vocab
from nlcorpus.plans import views
from nlcorpus.plans.registry import Tables, query


@query("B1_select_with_defaults", """SELECT doc_id, lang, 'none' AS nl_char_enc, 'd' || doc_id AS id
 FROM documents""")
def select_with_defaults(t: Tables):
    docs = t.documents.withColumn("id", F.concat(F.lit("d"), "doc_id"))
    return clean.select_with_defaults(docs, ["doc_id", "lang", "nl_char_enc"],
                                      defaults={"nl_char_enc": F.lit("none")})


@query("B2_ordinal_id", """SELECT o_orderkey, 'order-' || row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id
 FROM orders""")
def ordinal_id(t: Tables):
    return clean.ordinal_id(t.orders.select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"],
                            "order-").select("o_orderkey", "id")


@query("B3_coalesce_intent", """SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN upper(role) ELSE text END) AS nl
 FROM conversations""")
def coalesce_intent(t: Tables):
    rows = t.conversations.select("conv_id", "turn", F.col("text").alias("intent"), F.when(
        F.col("turn") % 2 == 0, F.upper("role")).alias("rewritten_intent"))
    return clean.coalesce_intent(rows).select("conv_id", "turn", F.md5("nl").alias("nl"))


@query("B4_drop_null_rows", """SELECT d.doc_id, quality, toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id
 WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def drop_null_rows(t: Tables):
    rows = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return clean.drop_null_rows(rows, ["quality", "toxic"])


@query("B5_drop_blacklisted", """SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (
 SELECT doc_id FROM labels WHERE toxic = 1)""")
def drop_blacklisted(t: Tables):
    listed = t.labels.where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    return clean.drop_blacklisted(t.documents.select("doc_id", "n_chars"), listed, "doc_id")


@query("B6_dedup_pairs", "SELECT min(doc_id) AS doc_id, lang, md5(text) AS digest FROM documents GROUP BY lang, text")
def dedup_pairs(t: Tables):
    kept = clean.dedup_pairs(t.documents.select("doc_id", "lang", "text"), ["lang", "text"], "doc_id")
    return kept.select("doc_id", "lang", F.md5("text").alias("digest"))


@query("B7_valid_text", """SELECT doc_id, odd, NOT regexp_matches(t, '[^\\x{01}-\\x{FF}]') AS valid FROM (
 SELECT doc_id, doc_id % 3 AS odd, CASE doc_id % 3 WHEN 1 THEN text || chr(8364) ELSE text END AS t FROM documents)""")
def valid_text(t: Tables):
    """Every third document gets a euro sign, which is outside Latin-1."""
    text = F.when(F.col("doc_id") % 3 == 1, F.concat("text", F.lit("€"))).otherwise(F.col("text"))
    return t.documents.select("doc_id", (F.col("doc_id") % 3).alias("odd"), clean.valid_text(text).alias("valid"))


@query("B8_unescape_newlines", """SELECT doc_id, md5(replace(text, '. ', '.' || chr(10))) AS digest
 FROM documents""")
def unescape_newlines(t: Tables):
    from nlcorpus.sources.files import unescape_newlines as unescape

    escaped = F.replace(F.replace("text", F.lit("\n"), F.lit("\\n")), F.lit(". "), F.lit(".\\n"))
    return t.documents.select("doc_id", F.md5(unescape(escaped)).alias("digest"))


SPLIT_SQL = """SELECT id, CASE WHEN row_number() OVER (ORDER BY md5(id || '-4831'))
 <= round_even(0.8 * count(*) OVER (), 0) THEN 'train' ELSE 'valid' END AS split FROM doc_ids"""


@query("B9_length_filter", f"""SELECT s.id, split FROM ({SPLIT_SQL}) s JOIN doc_ids d ON d.id = s.id
 WHERE len(nl_enc) <= 12 AND len(ast_seq_enc) <= 300""", "doc_ids")
def length_filter(t: Tables):
    rows = views.encoded(t).drop("text")
    split = dataset.train_valid_split(rows, "id", 0.8)
    return clean.length_filter(split, "nl_enc", "ast_seq_enc", 12, 300).select("id", "split")


@query("B10_apply_replacements_tokens", """SELECT doc_id, md5(string_agg(coalesce('STR_' || (rn - 1), token), ' '
 ORDER BY pos)) AS digest FROM tok LEFT JOIN top_words USING (doc_id, token) GROUP BY doc_id""", "top_words")
def apply_replacements_tokens(t: Tables):
    rows = views.replacements(t)
    return rows.select("doc_id", F.md5(clean.apply_to_tokens(views.words("text"), F.col("replacements")))
                       .alias("digest"))


CODE_SQL = """SELECT doc_id, string_agg(CASE WHEN rn IS NULL THEN '''' || token || '''' ELSE 'STR_' || (rn - 1) END,
 ', ' ORDER BY pos) AS code FROM tok LEFT JOIN top_words USING (doc_id, token) GROUP BY doc_id"""


def quoted_words(text):
    return F.array_join(F.transform(views.words(text), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")


@query("B11_apply_replacements_code", f"SELECT doc_id, md5(code) AS digest FROM ({CODE_SQL})", "top_words")
def apply_replacements_code(t: Tables):
    rows = views.replacements(t)
    return rows.select("doc_id", F.md5(clean.apply_to_code(quoted_words("text"), F.col("replacements")))
                       .alias("digest"))


def placeholder_predictions(t: Tables):
    """Predictions with their replacements: each document's words as quoted code, one prediction null."""
    rows = views.replacements(t).withColumnRenamed("doc_id", "id")
    code = quoted_words("text")
    predictions = t.documents.select(F.col("doc_id").alias("id"), code.alias("expected_codesnippet"), F.array(
        F.lit(None).cast("string"), F.concat(code, F.lit(";"))).alias("predicted_codesnippets"))
    return predictions, rows.select("id", "replacements")


@query("B12_postprocess_predictions", f"""SELECT doc_id AS id, md5(code) AS expected, md5(code || ';') AS predicted,
 1 AS n_null FROM ({CODE_SQL})""", "top_words")
def postprocess_predictions(t: Tables):
    done = clean.postprocess_predictions(*placeholder_predictions(t))
    return done.select("id", F.md5("expected_codesnippet").alias("expected"),
                       F.md5(F.col("predicted_codesnippets")[1]).alias("predicted"),
                       F.size(F.filter("predicted_codesnippets", lambda p: p.isNull())).alias("n_null"))


@query("B13_normalise_snippets", """SELECT l_orderkey, CASE WHEN closed THEN replace(ok_text, ',tax', ', tax')
 ELSE snippet END AS normal, count(*) AS n FROM snip GROUP BY ALL""", "snip")
def normalise_snippets(t: Tables):
    rows = views.snippets(t).select("l_orderkey", clean.normalise_code(F.col("snippet")).alias("normal"))
    return rows.groupBy("l_orderkey", "normal").agg(F.count("*").alias("n"))


@query("B14_flag_irregular_cells", "SELECT cell_type, count(*) AS n FROM cells WHERE cell_type = 'raw' GROUP BY ALL",
       "cells")
def flag_irregular_cells(t: Tables):
    return clean.irregular_cells(views.cells(t))


@query("C1_inner_join", """SELECT id, len(names) AS n_names, label.toxic FROM (SELECT doc_id AS id,
 list(token) AS names FROM top_words GROUP BY doc_id) JOIN labels label ON label.doc_id = id""", "top_words")
def inner_join(t: Tables):
    names = views.top_words(t)
    return names.join(t.labels, "doc_id").select(F.col("doc_id").alias("id"),
                                                 F.size("names").cast("long").alias("n_names"), "toxic")


@query("C2_left_anti_join", """SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (
 SELECT l_orderkey FROM lineitem)""")
def left_anti_join(t: Tables):
    listed = t.lineitem.select(F.col("l_orderkey").alias("id"))
    return clean.drop_blacklisted(t.orders.select("o_orderkey"), listed, "o_orderkey")


@query("C3_semi_join", """SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT id FROM lits
 JOIN lit_freq USING (literal) WHERE freq BETWEEN 2 AND 3)""", "lit_freq")
def semi_join(t: Tables):
    docs = t.documents.select(F.col("doc_id").alias("id"), "n_chars")
    kept = joins.keep_with_any(docs, views.owned_words(t), views.word_frequency(t), F.col("freq").between(2, 3), "id",
                               "literal", "freq")
    return kept.withColumnRenamed("id", "doc_id")


@query("C4_positional_join", """SELECT coalesce(d.n, o.n) AS line_no, doc_id, item_id FROM (SELECT doc_id,
 row_number() OVER (ORDER BY doc_id) AS n FROM documents) d FULL JOIN (SELECT item_id,
 row_number() OVER (ORDER BY item_id) AS n FROM benchmark) o ON d.n = o.n""")
def positional_join(t: Tables):
    from nlcorpus.functions.ordered import add_ordinal

    left = add_ordinal(t.documents.select("doc_id"), ["doc_id"], "line_no")
    right = add_ordinal(t.benchmark.select("item_id"), ["item_id"], "line_no")
    return joins.positional_join(left, right, "line_no")


VOCAB_SQL = "SELECT literal AS piece, 3 + row_number() OVER (ORDER BY freq DESC, literal) AS id FROM lit_freq"


@query("C5_vocab_lookup", f"""SELECT doc_id, md5(string_agg(CAST(id AS VARCHAR), ' ' ORDER BY pos)) AS ids,
 md5(string_agg(token, ' ' ORDER BY pos)) AS back FROM tok JOIN ({VOCAB_SQL}) ON piece = token GROUP BY doc_id""",
       "tok lit_freq")
def vocab_lookup(t: Tables):
    """Words to ids and back to words."""
    table = vocab.count_vocab(views.tokens(t), "token")
    records = t.documents.select("doc_id", views.words("text").alias("words"))
    ids = code_arrays(records, "words", table, "piece", "id", "cnt", "ids", keep=False)
    text = lambda field: F.md5(F.array_join(F.col(field).cast("array<string>"), " "))
    told = ids.select("doc_id", text("ids").alias("digest"), "ids")
    back = code_arrays(told, "ids", table, "id", "piece", "cnt", "back", keep=False)
    return back.select("doc_id", F.col("digest").alias("ids"), text("back").alias("back"))


@query("C5_vocab_lookup_rows", f"""SELECT conv_id, turn, pos, token, coalesce(id, -1) AS id FROM (SELECT conv_id, turn,
 unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM (SELECT conv_id, turn, string_split(text, ' ') AS ws
 FROM conversations)) LEFT JOIN ({VOCAB_SQL}) ON piece = token""", "tok lit_freq")
def vocab_lookup_rows(t: Tables):
    """Words of the conversations, as rows, to ids of the documents' vocabulary."""
    table = vocab.count_vocab(views.tokens(t), "token")
    words = t.conversations.select("conv_id", "turn", F.posexplode(views.words("text")).alias("pos", "token"))
    rows = joins.vocab_lookup(words.withColumn("pos", F.col("pos").cast("long")), table, ["conv_id", "turn", "pos"])
    return rows.select("conv_id", "turn", "pos", "token", F.coalesce("id", F.lit(-1)).cast("long").alias("id"))


@query("C6_cross_expand", """SELECT parent, n_known, (SELECT count(DISTINCT child) FROM links WHERE child NOT IN (
 SELECT parent FROM links)) - n_known AS n_added FROM (SELECT parent, count(DISTINCT child) FILTER (
 child NOT IN (SELECT parent FROM links)) AS n_known FROM links GROUP BY parent)""", "links")
def cross_expand(t: Tables):
    """Tags that never have children are the literals; every parent is a text field."""
    edges = views.links(t).groupBy("parent", "child").agg(F.count("*").alias("cnt"))
    fields = edges.select("parent").distinct()
    leaves = edges.select(F.col("child").alias("literal")).distinct().join(
        fields, F.col("literal") == F.col("parent"), "left_anti")
    return joins.open_text_fields(fields, edges.select("parent", "child"), leaves)


@query("C7_grammar_set_ops", """SELECT item_id, pos, parent, child FROM item_edges
 WHERE (parent, child) NOT IN (SELECT (parent, child) FROM doc_edges)""", "item_edges doc_edges")
def grammar_set_ops(t: Tables):
    """Word successions of the benchmark that no document has, duplicates kept."""
    return joins.missing_from(views.successions(t.benchmark, "item_id"), views.successions(t.documents, "doc_id"),
                              ["parent", "child"], ["item_id", "pos"])


@query("C8_union_drop_ids", """SELECT DISTINCT CAST(doc_id AS VARCHAR) AS id FROM (SELECT doc_id FROM labels
 WHERE toxic = 1 UNION ALL SELECT doc_id FROM labels WHERE quality = 0 UNION ALL
 SELECT doc_id FROM documents WHERE n_chars > 5000)""")
def union_drop_ids(t: Tables):
    return joins.union_ids(t.labels.where("toxic = 1"), t.labels.where("quality = 0"),
                           t.documents.where("n_chars > 5000"), column="doc_id")


@query("C9_concat_results", """SELECT 'nl' AS kind, doc_id AS id, md5(text) AS digest, NULL::INTEGER AS toxic
 FROM documents UNION ALL SELECT 'literal', item_id, md5(text), NULL FROM benchmark
 UNION ALL SELECT 'label', doc_id, NULL, toxic FROM labels""")
def concat_results(t: Tables):
    tagged = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"),
                                             F.md5("text").alias("digest"))
    labels = t.labels.select(F.lit("label").alias("kind"), F.col("doc_id").alias("id"), "toxic")
    return joins.concat_results(tagged(t.documents, "nl", "doc_id"), tagged(t.benchmark, "literal", "item_id"),
                                labels)


@query("D1_cells_to_pairs", "SELECT nb, block, intent, snippet FROM pairs_v", "pairs_v")
def cells_to_pairs(t: Tables):
    return segment.cells_to_pairs(views.cells(t))


@query("D2_pair_ids", "SELECT id, nb, nb_no, pair_no, md5(intent) AS intent, md5(snippet) AS snippet FROM pairs_v",
       "pairs_v")
def pair_ids(t: Tables):
    return views.pairs(t).select("id", "nb", "nb_no", "pair_no", F.md5("intent").alias("intent"),
                                 F.md5("snippet").alias("snippet"))
