"""Queries for trees and grammar: Python calls spelled from line items, and tag trees of pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.operators import grammar, trees
from nlcorpus.plans import views
from nlcorpus.plans.registry import Tables, query

TOKENS = """'Module Assign Name ''q' || l_linenumber || '''#strliteral </l> </l> Call Name ''scale''#strliteral </l> '
 || 'Constant ' || l_quantity || '#literal None#literal </l> keyword ''tax''#strliteral </l> Constant ' || l_tax
 || '#literal None#literal </l> None#literal </l> </l>'"""


def parsed(t: Tables, *want: str):
    return trees.parse_corpus(views.snippets(t), want)


@query("E1_parse_corpus", "SELECT l_orderkey, closed AS parse_ok, count(*) AS n FROM snip GROUP BY ALL", "snip")
def parse_corpus(t: Tables):
    return parsed(t).groupBy("l_orderkey", "parse_ok").agg(F.count("*").alias("n"))


@query("E2_linearise", f"SELECT l_orderkey, {TOKENS} AS ast_seq, count(*) AS n FROM snip WHERE closed GROUP BY ALL",
       "snip")
def linearise(t: Tables):
    seq = F.array_join(trees.linearised(F.col("tokens")), " ")
    return parsed(t, "tokens").where("parse_ok").groupBy("l_orderkey", seq.alias("ast_seq")).agg(F.count("*").alias("n"))


@query("E3_split_literals", f"""SELECT l_orderkey, regexp_replace({TOKENS}, '''[a-z0-9]+''#strliteral ', '', 'g')
 AS plain, 'q' || l_linenumber || ',scale,tax' AS strings, count(*) AS n FROM snip WHERE closed GROUP BY ALL""", "snip")
def split_literals(t: Tables):
    tokens = trees.linearised(F.col("tokens"))
    strings = trees.string_values(trees.only_strings(tokens))
    rows = parsed(t, "tokens").where("parse_ok").select(
        "l_orderkey", F.array_join(trees.without_strings(tokens), " ").alias("plain"),
        F.array_join(strings, ",").alias("strings"))
    return rows.groupBy("l_orderkey", "plain", "strings").agg(F.count("*").alias("n"))


@query("E4_extract_grammar", """SELECT parent, child, cnt, first_seen.page_id AS first_page, first_seen.pos AS first_pos
 FROM (SELECT parent, child, count(*) AS cnt, min({'page_id': page_id, 'pos': pos}) AS first_seen FROM links
 GROUP BY parent, child)""", "links")
def extract_grammar(t: Tables):
    return grammar.extract_edges(views.links(t), ["page_id", "pos"]).select(
        "parent", "child", "cnt", F.col("first_seen.page_id").alias("first_page"),
        F.col("first_seen.pos").alias("first_pos"))


FIELDS_SQL = """SELECT field, kind, CAST(times * n AS BIGINT) AS cnt FROM (VALUES ('<s>_root', 'singleton', 1),
 ('Module_body', 'list', 2), ('Assign_targets', 'list', 2), ('Name_id', 'list', 4), ('Assign_value', 'singleton', 1),
 ('Call_func', 'singleton', 1), ('Call_args', 'list', 2), ('Constant_value', 'singleton', 2),
 ('Constant_kind', 'singleton', 2), ('Call_keywords', 'list', 2), ('keyword_arg', 'list', 2),
 ('keyword_value', 'singleton', 1), ('Assign_type_comment', 'singleton', 1), ('Module_type_ignores', 'list', 1),
 ('<s>_end', 'singleton', 1)) AS fixed(field, kind, times), (SELECT count(*) AS n FROM snip WHERE closed)"""


@query("E4_extract_grammar_fields", FIELDS_SQL, "snip")
def extract_grammar_fields(t: Tables):
    return grammar.field_kinds(grammar.sentence_edges(trees.token_table(parsed(t, "tokens", "kinds", "fields"), "l_orderkey")))


@query("E5_grammar_errors", "SELECT l_orderkey, count(*) AS n FROM snip WHERE NOT closed GROUP BY ALL", "snip")
def grammar_errors(t: Tables):
    return trees.failed_ids(parsed(t), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


# The path of every token of the one sentence form, leaf first; A is the path of the assignment.
PATHS = """1|1,1,1|A|1,1,A|1,1,1,1,A|2,1,1,1,A|2,1,A|1,2,A|1,1,1,2,A|1,1,1,1,1,2,A|2,1,1,1,1,2,A|1,2,1,2,A|1,1,1,2,1,2,A
|1,2,1,2,1,2,A|2,2,1,2,A|1,3,1,2,A|1,1,1,3,1,2,A|2,1,1,3,1,2,A|1,2,1,3,1,2,A|1,1,1,2,1,3,1,2,A|1,2,1,2,1,3,1,2,A
|2,3,1,2,A|1,3,A|2,1,1,1,1|1,2,1,1,1|1,2,1"""


@query("E6_tree_positions", f"""SELECT l_linenumber, pos, replace(path, 'A', '1,1,1,1,1') AS path, n FROM (
 SELECT unnest(range(len(ps))) AS pos, unnest(ps) AS path FROM (SELECT string_split(replace('{PATHS}', chr(10), ''), '|')
 AS ps)), (SELECT l_linenumber, count(*) AS n FROM snip WHERE closed GROUP BY ALL)""", "snip")
def tree_positions(t: Tables):
    """Copies of a text within a line number are counted before it is parsed."""
    texts = views.snippets(t).groupBy("l_linenumber", "snippet").agg(F.count("*").alias("times"))
    copies = texts.select(F.struct("l_linenumber", "times").alias("copies"), "snippet")
    tokens = trees.token_table(trees.parse_corpus(copies, ("paths",)), "copies")
    return tokens.groupBy(F.col("id.l_linenumber").alias("l_linenumber"), F.col("pos").cast("long").alias("pos"),
                          F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path")).agg(
        F.sum("id.times").alias("n"))


COUNTS_SQL = """SELECT label, type, cnt, CAST(times * n AS BIGINT) AS n FROM (VALUES ('<s>', 'special', 2, 1),
 ('<s>_root', 'singleton', 1, 1), ('Module', 'node', 2, 1), ('Module_body', 'list', 2, 1), ('Assign', 'node', 3, 1),
 ('Assign_targets', 'list', 2, 1), ('Name', 'node', 1, 2), ('Name_id', 'list', 2, 2), ('</l>', 'special', 0, 8),
 ('Assign_value', 'singleton', 1, 1), ('Call', 'node', 3, 1), ('Call_func', 'singleton', 1, 1),
 ('Call_args', 'list', 2, 1), ('Constant', 'node', 2, 2), ('Constant_value', 'singleton', 1, 2),
 ('Constant_kind', 'singleton', 1, 2), ('None#literal', 'literal', 0, 3), ('Call_keywords', 'list', 2, 1),
 ('keyword', 'node', 2, 1), ('keyword_arg', 'list', 2, 1), ('keyword_value', 'singleton', 1, 1),
 ('Assign_type_comment', 'singleton', 1, 1), ('Module_type_ignores', 'list', 1, 1), ('<s>_end', 'singleton', 1, 1),
 ('</s>', 'special', 0, 1), ('''scale''#strliteral', 'strliteral', 0, 1), ('''tax''#strliteral', 'strliteral', 0, 1))
 AS fixed(label, type, cnt, times), (SELECT count(*) AS n FROM snip WHERE closed)
 UNION ALL SELECT '''q' || l_linenumber || '''#strliteral', 'strliteral', 0, count(*) FROM snip WHERE closed GROUP BY ALL
 UNION ALL SELECT v || '#literal', 'literal', 0, count(*) FROM (SELECT CAST(l_quantity AS VARCHAR) AS v FROM snip
 WHERE closed UNION ALL SELECT CAST(l_tax AS VARCHAR) FROM snip WHERE closed) GROUP BY ALL"""


@query("E7_edge_counts", COUNTS_SQL, "snip")
def edge_counts(t: Tables):
    """Copies of a text are counted before it is parsed."""
    texts = views.snippets(t).groupBy("snippet").agg(F.count("*").alias("times"))
    edges = trees.edge_table(trees.parse_corpus(texts, ("edge_counts",)), "times")
    return edges.groupBy("label", "type", "cnt").agg(F.sum("id").alias("n"))


@query("E8_max_depth", "SELECT id AS page_id, max_depth FROM depths", "depths")
def max_depth(t: Tables):
    return trees.page_depth(trees.tag_events(t.pages))


SETS_SQL = """(SELECT p, c, min(p) OVER (PARTITION BY members) AS set_id FROM (SELECT p, array_to_string(list_sort(
 list(DISTINCT c)), ' ') AS members, list(DISTINCT c) AS c FROM (SELECT parent AS p, child AS c FROM links UNION ALL
 SELECT parent, '</l>' FROM links) GROUP BY p))"""


def tag_sets(t: Tables):
    return grammar.intern_sets(grammar.extract_edges(views.links(t), ["page_id", "pos"]), list_end=True)


@query("E9_allowed_children", """SELECT page_id, pos, tag, allowed FROM elements LEFT JOIN (SELECT p,
 array_to_string(list_sort(list(DISTINCT c)), ' ') AS allowed FROM (SELECT parent AS p, child AS c FROM links UNION ALL
 SELECT parent, '</l>' FROM links) GROUP BY p) ON p = tag""", "elements links")
def allowed_children(t: Tables):
    """Tags allowed inside each opened tag, as seen anywhere in the corpus."""
    steps = views.elements(t).select("page_id", "pos", "tag", F.col("tag").alias("open_parent"))
    rows = grammar.allowed_children(steps, tag_sets(t), ["page_id", "pos"], spelled=True)
    return rows.select("page_id", "pos", "tag", "allowed")


@query("E9_set_members", f"SELECT set_id, unnest(c) AS child FROM {SETS_SQL} WHERE p = set_id", "links")
def set_members(t: Tables):
    """The dictionary of the sets that positions name, equal ones once."""
    return tag_sets(t).members


@query("E9_sets_of_words", """SELECT set_id, count(*) AS n_parents FROM (SELECT min(parent) OVER (PARTITION BY members)
 AS set_id FROM (SELECT parent, list_sort(list(DISTINCT child)) AS members FROM turn_edges GROUP BY parent))
 GROUP BY set_id""", "turn_edges")
def sets_of_words(t: Tables):
    """How many words of the conversations have the same set of next words."""
    sets = grammar.intern_sets(turn_successions(t))
    return sets.parents.groupBy("set_id").agg(F.count("*").alias("n_parents"))


def turn_successions(t: Tables):
    turns = t.conversations.select(F.struct("conv_id", "turn").alias("at"), "text")
    return grammar.extract_edges(views.successions(turns, "at"), ["at", "pos"])


@query("E10_grammar_conformance", """SELECT doc_id, pos, parent, child FROM doc_edges
 WHERE (parent, child) NOT IN (SELECT (parent, child) FROM turn_edges)""", "doc_edges turn_edges")
def grammar_conformance(t: Tables):
    """Word successions of the documents that a grammar taken from the conversations does not allow."""
    sets = grammar.intern_sets(turn_successions(t))
    return grammar.nonconforming(views.successions(t.documents, "doc_id"), sets, "doc_id")


@query("E10_conformance_any_text", """SELECT doc_id, pos, parent, child FROM doc_edges
 WHERE (parent, child) NOT IN (SELECT (parent, child) FROM turn_edges) AND NOT (parent IN (SELECT parent FROM turn_edges
 WHERE length(parent) < 6) AND child IN (SELECT child FROM turn_edges WHERE length(child) >= 6))""", "doc_edges turn_edges")
def conformance_any_text(t: Tables):
    """The same with every text literal (a word of six letters and more) allowed after every shorter word."""
    edges = turn_successions(t)
    sets = grammar.intern_sets(edges, text_fields=edges.where(F.length("parent") < 6), is_text=F.length("child") >= 6)
    return grammar.nonconforming(views.successions(t.documents, "doc_id"), sets, "doc_id")


@query("E11_canonical_order", """SELECT page_id, pos, tag, CAST(row_number() OVER (PARTITION BY page_id, parent_pos
 ORDER BY CASE WHEN parent IN ('body', 'article') AND tag NOT IN ('h1', 'nav') THEN 1 ELSE 0 END,
 CASE WHEN parent IN ('body', 'article') THEN tag ELSE '' END, pos) AS INTEGER) AS new_index FROM elements
 WHERE parent IS NOT NULL""", "elements")
def canonical_order(t: Tables):
    children = views.elements(t).where(F.col("parent").isNotNull())
    return trees.canonical_order(children, "page_id", "parent_pos", "parent", "tag", "pos", ("body", "article"),
                                 ("h1", "nav")).select("page_id", "pos", "tag", "new_index")


@query("E12_roundtrip_gate", "SELECT l_orderkey, count(*) AS n FROM snip WHERE closed GROUP BY ALL", "snip")
def roundtrip_gate(t: Tables):
    return trees.roundtrip_gate(parsed(t, "roundtrip_ok")).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("E13_canonical_literal_text", "SELECT doc_id, md5(text) AS digest FROM documents")
def canonical_literal_text(t: Tables):
    pieces = F.transform(views.words("text"), lambda w: F.concat(F.lit("▁"), w))
    return t.documents.select("doc_id", F.md5(trees.literal_text(pieces)).alias("digest"))
