"""Queries for record and corpus profiles and for curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.functions.arrays import map_text
from nlcorpus.operators import curate, grammar, profile, trees
from nlcorpus.plans import flagship, views
from nlcorpus.plans.registry import Tables, query

LITERAL = "regexp_replace(label, '#[^#]*$', '')"


@query("F_r1_max_edge_count", "SELECT id, max(cnt) AS max_edge_count FROM profile GROUP BY id", "profile")
def max_edge_count(t: Tables):
    return profile.max_edge_count(views.profile(t))


@query("F_r2_min_max_list_el", """SELECT id, label, min(cnt) AS min_cnt, max(cnt) AS max_cnt FROM profile
 WHERE type = 'list' GROUP BY id, label""", "profile")
def min_max_list_el(t: Tables):
    return profile.list_bounds(views.profile(t), "id")


@query("F_r3_list_len_histogram", "SELECT id, cnt, count(*) AS n FROM profile WHERE type = 'list' GROUP BY id, cnt",
       "profile")
def list_len_histogram(t: Tables):
    return profile.list_len_histogram(views.profile(t), "id")


@query("F_r4_node_histogram", "SELECT id, label, count(*) AS n FROM profile WHERE type = 'node' GROUP BY id, label",
       "profile")
def node_histogram(t: Tables):
    return profile.node_histogram(views.profile(t), "id")


@query("F_r5_edge_histogram", """SELECT id, label, CAST(sum(cnt) AS BIGINT) AS n FROM profile
 WHERE type IN ('list', 'singleton') GROUP BY id, label""", "profile")
def edge_histogram(t: Tables):
    return profile.edge_histogram(views.profile(t), "id")


@query("F_r6_literal_histogram", "SELECT id, literal, n FROM lits", "lits")
def literal_histogram(t: Tables):
    return views.literals(t)


@query("F_r6_literal_histogram_links", f"""SELECT id, {LITERAL} AS literal, count(*) AS n FROM profile
 WHERE type IN ('literal', 'strliteral') GROUP BY ALL""", "profile")
def literal_histogram_links(t: Tables):
    return profile.literal_histogram(views.profile(t), "id")


@query("F_r7_max_lit_length", f"""SELECT id, CAST(coalesce(max(length({LITERAL})) FILTER (type = 'strliteral'), 0)
 AS INTEGER) AS max_lit_length FROM profile GROUP BY id""", "profile")
def max_lit_length(t: Tables):
    return profile.max_literal_length(views.profile(t))


@query("F_r8_type_counts", """SELECT id, count(*) FILTER (type = 'node') AS node_count, count(*) FILTER (type = 'list')
 AS list_count, count(*) FILTER (type = 'strliteral') AS literal_count FROM profile GROUP BY id""", "profile")
def type_counts(t: Tables):
    return profile.type_counts(views.profile(t), "id")


@query("F_r9_edge_count", """SELECT id, CAST(sum(cnt) FILTER (type = 'list') AS BIGINT) AS edge_count FROM profile
 GROUP BY id""", "profile")
def edge_count(t: Tables):
    return profile.edge_count(views.profile(t), "id")


def _items(key: str, value: str, source: str) -> str:
    """SQL text of a map in key order."""
    return (f"SELECT id, string_agg({key} || '=' || {value}, ',' ORDER BY {key} || '=' || {value}) AS items "
            f"FROM ({source}) GROUP BY id")


RECORD_SQL = f"""SELECT p.id, max_edge_count, nodes.items AS node_histogram, edges.items AS edge_histogram,
 coalesce(lits.items, '') AS literal_histogram, lens.items AS list_len_histogram, bounds.items AS min_max_list_el,
 max_lit_length, node_count, list_count, literal_count, edge_count FROM (SELECT id, CAST(max(cnt) AS BIGINT)
 AS max_edge_count, CAST(coalesce(max(length({LITERAL})) FILTER (type = 'strliteral'), 0) AS INTEGER) AS max_lit_length,
 count(*) FILTER (type = 'node') AS node_count, count(*) FILTER (type = 'list') AS list_count,
 count(*) FILTER (type = 'strliteral') AS literal_count,
 CAST(sum(cnt) FILTER (type = 'list') AS BIGINT) AS edge_count FROM profile GROUP BY id) p
 JOIN ({_items('label', 'n', "SELECT id, label, count(*) AS n FROM profile WHERE type = 'node' GROUP BY ALL")}) nodes
 ON nodes.id = p.id
 JOIN ({_items('label', 'n', "SELECT id, label, sum(cnt) AS n FROM profile WHERE type = 'list' GROUP BY ALL")}) edges
 ON edges.id = p.id
 LEFT JOIN ({_items('l', 'n', f"SELECT id, {LITERAL} AS l, count(*) AS n FROM profile WHERE type = 'strliteral' GROUP BY ALL")})
 lits ON lits.id = p.id
 JOIN ({_items('cnt', 'n', "SELECT id, cnt, count(*) AS n FROM profile WHERE type = 'list' GROUP BY ALL")}) lens
 ON lens.id = p.id
 JOIN ({_items('label', "lo || '-' || hi", "SELECT id, label, min(cnt) AS lo, max(cnt) AS hi FROM profile WHERE type = 'list' GROUP BY ALL")})
 bounds ON bounds.id = p.id"""


@query("F_r10_record_stats", RECORD_SQL, "profile")
def record_stats(t: Tables):
    stats = profile.record_stats(views.profile(t))
    bounds = F.transform_values("min_max_list_el", lambda k, v: F.concat_ws("-", v["lo"], v["hi"]))
    text = {c: map_text(F.col(c)) for c in ("node_histogram", "edge_histogram", "literal_histogram",
                                            "list_len_histogram")}
    return stats.withColumns({**text, "min_max_list_el": map_text(bounds)})


@query("F_g1_global_maxima", """SELECT (SELECT max(max_depth) FROM depths) AS global_max_depth,
 (SELECT max(cnt) FROM profile) AS global_max_edge_count""", "depths profile")
def global_maxima(t: Tables):
    return profile.global_maxima(views.depths(t).join(profile.max_edge_count(views.profile(t)), "id", "full_outer"))


@query("F_g2_global_min_max_list_el", """SELECT label, min(cnt) AS min_cnt, max(cnt) AS max_cnt FROM profile
 WHERE type = 'list' GROUP BY label""", "profile")
def global_min_max_list_el(t: Tables):
    return profile.list_bounds(views.profile(t)).orderBy("label")


@query("F_g3_global_list_len_histogram", "SELECT cnt, count(*) AS n FROM profile WHERE type = 'list' GROUP BY cnt",
       "profile")
def global_list_len_histogram(t: Tables):
    return profile.list_len_histogram(views.profile(t)).orderBy("cnt")


@query("F_g4_global_node_histogram", "SELECT label, count(*) AS n FROM profile WHERE type = 'node' GROUP BY label",
       "profile")
def global_node_histogram(t: Tables):
    return profile.node_histogram(views.profile(t)).orderBy("n")


@query("F_g4_global_edge_histogram", """SELECT label, CAST(sum(cnt) AS BIGINT) AS n FROM profile WHERE type = 'list'
 GROUP BY label""", "profile")
def global_edge_histogram(t: Tables):
    return profile.edge_histogram(views.profile(t)).orderBy("n")


@query("F_g4_global_literal_histogram", "SELECT literal, freq AS n FROM lit_freq", "lit_freq")
def global_literal_histogram(t: Tables):
    return views.word_frequency(t).withColumnRenamed("freq", "n").orderBy("n")


@query("F_g5_max_lit_len_histogram", f"""SELECT max_lit_length, count(*) AS n FROM (SELECT id, CAST(coalesce(
 max(length({LITERAL})) FILTER (type = 'strliteral'), 0) AS INTEGER) AS max_lit_length FROM profile GROUP BY id)
 GROUP BY ALL""", "profile")
def max_lit_len_histogram(t: Tables):
    return profile.max_lit_len_histogram(views.profile(t)).orderBy("max_lit_length")


@query("F_g6_min_lit_freq_histogram", """SELECT min_freq, count(*) AS n FROM (SELECT i.id, coalesce(min(freq), -1)
 AS min_freq FROM (SELECT doc_id AS id FROM documents UNION SELECT item_id + 1000000000 FROM benchmark) i LEFT JOIN lits
 ON lits.id = i.id LEFT JOIN lit_freq USING (literal) GROUP BY i.id) GROUP BY min_freq""", "lit_freq")
def min_lit_freq_histogram(t: Tables):
    """Documents, plus benchmark items as records without literals."""
    records = t.documents.select(F.col("doc_id").alias("id")).unionByName(
        t.benchmark.select((F.col("item_id") + 1000000000).alias("id")))
    return profile.min_lit_freq_histogram(records, views.owned_words(t), views.word_frequency(t)).orderBy("min_freq")


@query("F_g7_global_counts", """SELECT count(*) FILTER (type = 'node') AS node_count, count(*) FILTER (type = 'list')
 AS list_count, count(*) FILTER (type = 'strliteral') AS literal_count,
 CAST(sum(cnt) FILTER (type = 'list') AS BIGINT) AS edge_count FROM profile""", "profile")
def global_counts(t: Tables):
    elements = views.profile(t)
    return profile.one_row(profile.type_counts(elements), profile.edge_count(elements))


@query("F_g8_distinct_counts", f"""SELECT count(DISTINCT CASE WHEN type = 'strliteral' THEN {LITERAL} END)
 AS distinct_literal_count, count(DISTINCT CASE WHEN type = 'node' THEN label END) AS distinct_node_count
 FROM profile""", "profile")
def distinct_counts(t: Tables):
    return profile.distinct_counts(views.profile(t))


@query("F_g9_length_histogram", """SELECT 'nl' AS seq, CAST(len(nl_enc) AS INTEGER) AS len, count(*) AS n FROM doc_ids
 GROUP BY ALL UNION ALL SELECT 'tree', CAST(len(ast_seq_enc) AS INTEGER), count(*) FROM doc_ids GROUP BY ALL""",
       "doc_ids")
def length_histogram(t: Tables):
    rows = views.encoded(t)
    side = lambda column, name: profile.length_histogram(rows, column).withColumn("seq", F.lit(name))
    return side("nl_enc", "nl").unionByName(side("ast_seq_enc", "tree")).orderBy("seq", "len")


@query("F_g10_length_cumulative", """SELECT CAST(len(ast_seq_enc) AS INTEGER) AS len, count(*) AS n,
 CAST(sum(count(*)) OVER (ORDER BY len(ast_seq_enc)) AS BIGINT) AS cumulative FROM doc_ids GROUP BY len(ast_seq_enc)""",
       "doc_ids")
def length_cumulative(t: Tables):
    return profile.cumulate(profile.length_histogram(views.encoded(t), "ast_seq_enc"))


SIDE = """SELECT kind, count(*) AS {0}_edges, count(DISTINCT parent) AS {0}_parents,
 round(count(*) / count(DISTINCT parent), 6) AS {0}_mean FROM (SELECT DISTINCT parent, child, kind FROM kinded
 WHERE {1}) GROUP BY kind"""


@query("F_g11_grammar_edge_stats", f"""SELECT coalesce(a.kind, b.kind) AS kind, train_edges, train_parents, train_mean,
 test_edges, test_parents, test_mean, coalesce(new_edges, 0) AS new_edges
 FROM ({SIDE.format('train', 'page_id % 5 <> 0').replace('kinded', "(SELECT *, CASE WHEN child IN ('a', 'b', 'li', 'p') "
       "THEN 'literal' ELSE 'node' END AS kind FROM links)")}) a
 FULL JOIN ({SIDE.format('test', 'page_id % 5 = 0').replace('kinded', "(SELECT *, CASE WHEN child IN ('a', 'b', 'li', 'p') "
       "THEN 'literal' ELSE 'node' END AS kind FROM links)")}) b ON a.kind = b.kind
 LEFT JOIN (SELECT CASE WHEN child IN ('a', 'b', 'li', 'p') THEN 'literal' ELSE 'node' END AS kind, count(*) AS new_edges
 FROM (SELECT DISTINCT parent, child FROM links WHERE page_id % 5 = 0 EXCEPT
 SELECT parent, child FROM links WHERE page_id % 5 <> 0) GROUP BY 1) c ON c.kind = coalesce(a.kind, b.kind)""", "links")
def grammar_edge_stats(t: Tables):
    kind = F.when(F.col("child").isin("a", "b", "li", "p"), "literal").otherwise("node")
    edges = lambda rows: rows.groupBy("parent", "child").count().select("parent", "child", kind.alias("kind"))
    links = views.links(t)
    return grammar.edge_stats(edges(links.where("page_id % 5 <> 0")), edges(links.where("page_id % 5 = 0")))


@query("F_global_scalars", """SELECT max(cnt) AS global_max_edge_count, count(*) FILTER (type = 'node')
 AS global_node_count, count(*) FILTER (type = 'list') AS global_list_count, count(*) FILTER (type = 'strliteral')
 AS global_literal_count, CAST(sum(cnt) FILTER (type = 'list') AS BIGINT) AS global_edge_count,
 count(DISTINCT label) FILTER (type = 'strliteral') AS distinct_literal_count,
 count(DISTINCT label) FILTER (type = 'node') AS distinct_node_count,
 (SELECT max(max_depth) FROM depths) AS global_max_depth FROM profile""", "profile depths")
def global_scalars(t: Tables):
    return profile.global_scalars(views.profile(t), views.depths(t))


@query("F1_drop_low_prob", "SELECT event_id AS id FROM events WHERE value / 100 < 0.05")
def drop_low_prob(t: Tables):
    rows = t.events.select(F.col("event_id").alias("id"), (F.col("value") / 100).alias("prob"))
    return curate.low_probability(rows, 0.05)


def word_profile(t: Tables):
    """Documents as records: every word is a literal and the lines are one list."""
    row = lambda label, kind, cnt: F.struct(label.alias("label"), F.lit(kind).alias("type"), cnt.alias("cnt"))
    entries = F.concat(
        F.transform(views.words("text"), lambda w: row(F.concat(w, F.lit("#literal")), "literal", F.lit(0))),
        F.array(row(F.lit("lines"), "list", F.size(F.split("text", "\n")) + 1)))
    return t.documents.select(F.col("doc_id").alias("id"), F.inline(entries))


@query("F2_drop_long_literal", "SELECT DISTINCT doc_id AS id FROM tok WHERE length(token) > 20", "tok")
def drop_long_literal(t: Tables):
    return curate.long_literal(word_profile(t), 20)


@query("F3_drop_long_list", "SELECT DISTINCT id FROM profile WHERE type = 'list' AND cnt > 7", "profile")
def drop_long_list(t: Tables):
    return curate.long_list(views.profile(t), 7)


@query("F4_drop_duplicate_tree", """SELECT doc_id AS id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text
 ORDER BY doc_id) AS rn FROM documents) WHERE rn > 1""")
def drop_duplicate_tree(t: Tables):
    rows = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("ast_seq"))
    return curate.duplicate_tree(rows, "id")


@query("F5_drop_rare_literal", "SELECT DISTINCT id FROM lits JOIN lit_freq USING (literal) WHERE freq <= 1", "lit_freq")
def drop_rare_literal(t: Tables):
    return curate.rare_literal(views.owned_words(t), views.word_frequency(t), 1)


@query("F6_curate", """SELECT doc_id AS id, n_chars FROM documents WHERE n_chars / 10000 >= 0.05
 AND doc_id NOT IN (SELECT doc_id FROM tok WHERE length(token) > 24)
 AND len(string_split(text, chr(10))) + 1 <= 60
 AND doc_id NOT IN (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn
 FROM documents) WHERE rn > 1)
 AND doc_id NOT IN (SELECT id FROM lits JOIN lit_freq USING (literal) WHERE freq <= 1)""", "lit_freq")
def curate_documents(t: Tables):
    pairs = t.documents.select(F.col("doc_id").alias("id"), "n_chars", (F.col("n_chars") / 10000).alias("prob"),
                               F.col("text").alias("ast_seq"))
    dropped = curate.drop_ids(pairs, word_profile(t), pairs, prob=0.05, literal_length=24, list_length=60,
                              literal_frequency=1, duplicates=True)
    return curate.curate(pairs, dropped).select("id", "n_chars")


@query("flagship_curated_pairs", """SELECT id, md5(intent) AS intent, md5(snippet) AS snippet FROM pairs_v WHERE id NOT IN (
 SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY snippet ORDER BY nb, block) AS rn FROM pairs_v) WHERE rn > 1)
 AND id NOT IN (SELECT id FROM code_words JOIN (SELECT word, count(*) AS f FROM code_words GROUP BY word) USING (word)
 WHERE f <= 1)""".replace("code_words", """(SELECT id, unnest(list_filter(string_split(
 regexp_replace(regexp_replace(regexp_replace(snippet, '([^A-Za-z0-9_])', ' \\1 ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'),
 '\\s+', ' ', 'g'), ' '), lambda w: w <> '')) AS word FROM pairs_v)"""), "pairs_v")
def flagship_curated_pairs(t: Tables):
    kept = flagship.curated_pairs(views.pairs(t))
    return kept.select("id", F.md5("intent").alias("intent"), F.md5("snippet").alias("snippet"))


CODE_SQL = """o AS (SELECT o_orderkey AS id, 'place an order of ' || lower(o_orderpriority) || ' priority for customer '
 || o_custkey || ' with status ' || o_orderstatus AS intent, 'order_' || o_custkey AS name, o_orderpriority AS p,
 o_orderstatus AS s, CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS VARCHAR) AS total FROM orders),
code AS (SELECT *, name || ' = place(''' || p || ''', status=''' || s || ''', total=' || total || ')' AS snippet FROM o),
own AS (SELECT id, '''' || name || '''' AS literal FROM o UNION ALL SELECT id, '''' || p || '''' FROM o
 UNION ALL SELECT id, '''' || s || '''' FROM o UNION ALL SELECT id, total FROM o)"""


@query("flagship_curated_code", f"""WITH {CODE_SQL} SELECT id, md5(intent) AS intent, md5(snippet) AS snippet FROM code
 WHERE id NOT IN (SELECT id FROM own JOIN (SELECT literal, count(*) AS n FROM own GROUP BY literal) USING (literal)
 WHERE n <= 1 OR length(literal) > 16) AND id NOT IN (SELECT id FROM (SELECT id, row_number() OVER (
 PARTITION BY snippet ORDER BY id) AS rn FROM code) WHERE rn > 1)""")
def flagship_curated_code(t: Tables):
    """Orders spelled as calls that have no rare and no long literal and are no later copy."""
    kept = flagship.curated_code(views.order_code(t), literal_length=16, list_length=5)
    return kept.select("id", F.md5("intent").alias("intent"), F.md5("snippet").alias("snippet"))


@query("F_g4_code_literal_histogram", f"""WITH {CODE_SQL} SELECT literal, count(*) AS n FROM (SELECT literal FROM own
 UNION ALL SELECT unnest(['''place''', '''status''', '''total''', 'None', 'None', 'None', 'None']) FROM o)
 GROUP BY literal""")
def code_literal_histogram(t: Tables):
    """How often every literal occurs in all code."""
    parsed = trees.parse_corpus(views.order_code(t), ("edge_counts",)).where("parse_ok")
    return profile.literal_histogram(trees.edge_table(parsed, "id"))
