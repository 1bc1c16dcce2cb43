"""Queries for vocabularies, encodings and training-set assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.operators import dataset, trees, vocab
from nlcorpus.plans import preprocess, views
from nlcorpus.plans.catalog_clean import SPLIT_SQL
from nlcorpus.plans.registry import Tables, query
from nlcorpus.session import materialize, scratch_path

SPECIALS_SQL = "SELECT * FROM (VALUES ('<pad>', 0, 0), ('<unk>', 1, 0), ('<s>', 2, 0), ('</s>', 3, 0))"


def vocab_sql(counts: str) -> str:
    return f"""SELECT piece, 3 + row_number() OVER (ORDER BY cnt DESC, piece) AS id, CAST(cnt AS BIGINT) AS cnt
 FROM ({counts}) UNION ALL {SPECIALS_SQL}"""


@query("G1_word_vocab", vocab_sql("""SELECT piece, times * n AS cnt FROM (VALUES ('Module', 1), ('Assign', 1),
 ('Name', 2), ('</l>', 8), ('Call', 1), ('Constant', 2), ('None#literal', 3), ('keyword', 1)) AS fixed(piece, times),
 (SELECT count(*) AS n FROM snip WHERE closed) UNION ALL SELECT v || '#literal', count(*) FROM (
 SELECT CAST(l_quantity AS VARCHAR) AS v FROM snip WHERE closed UNION ALL SELECT CAST(l_tax AS VARCHAR) FROM snip
 WHERE closed) GROUP BY ALL"""), "snip")
def word_vocab(t: Tables):
    parsed = trees.parse_corpus(views.snippets(t), ("tokens",)).where("parse_ok")
    plain = trees.without_strings(trees.linearised(F.col("tokens")))
    return vocab.count_vocab(parsed.select(F.explode(plain).alias("token")), "token")


def char_counts_sql(table: str) -> str:
    """Characters of the valid texts, spaces as markers."""
    return f"""SELECT ch AS piece, count(*) AS cnt FROM (SELECT unnest(string_split(replace(text, ' ', '{vocab.SPACE}'), ''))
 AS ch FROM {table} WHERE NOT regexp_matches(text, '[^\\x{{01}}-\\x{{FF}}]')) GROUP BY ch"""


@query("G2_char_vocab", vocab_sql(char_counts_sql("documents")))
def char_vocab(t: Tables):
    return vocab.count_vocab(vocab.char_occurrences(t.documents, "text"), "ch")


def document_vocab(t: Tables):
    return vocab.bpe_vocab(vocab.word_counts(t.documents, "text"))


@query("G3_bpe_vocab")
def bpe_vocab(t: Tables):
    return document_vocab(t)


@query("G4_normalise_nfkc", "SELECT doc_id, md5(text) AS digest FROM documents")
def normalise_nfkc(t: Tables):
    """Spaces become no-break spaces, "fi" a ligature and "A" its full-width form; normalising undoes all three."""
    odd = F.translate(F.replace("text", F.lit("fi"), F.lit("ﬁ")), " A", " Ａ")
    return t.documents.select("doc_id", F.md5(vocab.normalise_nfkc(odd)).alias("digest"))


@query("G5_encode_nl", "SELECT doc_id, 2 AS first_id, 3 AS last_id, false AS unknown, md5(text) AS back FROM documents")
def encode_nl(t: Tables):
    """Documents as subword ids, with their ends, unknown pieces and the text the ids give back."""
    table = materialize(document_vocab(t), "vocab")
    rows = vocab.encode_nl(t.documents.select("doc_id", "text"), "text", table)
    return rows.select("doc_id", F.get("nl_enc", F.lit(0)).alias("first_id"), F.element_at("nl_enc", -1).alias("last_id"),
                       F.array_contains("nl_enc", vocab.UNK).alias("unknown"),
                       F.md5(vocab.decode_nl(F.col("nl_enc"), table)).alias("back"))


@query("G6_encode_chars", f"""SELECT conv_id, turn, md5(string_agg(ids, '|' ORDER BY pos)) AS digest FROM (
 SELECT conv_id, turn, pos, string_agg(CAST(coalesce(id, 1) AS VARCHAR), ',' ORDER BY i) AS ids FROM (SELECT conv_id,
 turn, pos, unnest(range(1, length(w) + 1)) AS i, unnest(string_split(w, '')) AS ch FROM (SELECT conv_id, turn,
 unnest(range(len(ws))) AS pos, '{vocab.SPACE}' || unnest(ws) AS w FROM (SELECT conv_id, turn, string_split(text, ' ')
 AS ws FROM conversations))) LEFT JOIN (SELECT piece, 3 + row_number() OVER (ORDER BY cnt DESC, piece) AS id FROM (
 {char_counts_sql("conversations")})) ON piece = ch GROUP BY conv_id, turn, pos) GROUP BY conv_id, turn""")
def encode_chars(t: Tables):
    """Words with their marker stand in for subword pieces, so the ids can be checked."""
    table = vocab.count_vocab(vocab.char_occurrences(t.conversations, "text"), "ch")
    pieces = F.transform(views.words("text"), lambda w: F.concat(F.lit(vocab.SPACE), w))
    rows = vocab.encode_chars(t.conversations.withColumn("pieces", pieces), "pieces", table)
    inner = F.filter("nl_char_enc", lambda c: F.size(c) > 0)
    text = F.array_join(F.transform(inner, lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")), "|")
    return rows.select("conv_id", "turn", F.md5(text).alias("digest"))


TREE_VOCABS = """tv AS (SELECT token, 3 + row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM tok
 WHERE doc_id % 5 <> 0 AND token NOT LIKE '%.' AND token <> '' GROUP BY token), sv AS (SELECT token,
 3 + row_number() OVER (ORDER BY count(*) DESC, token) AS id FROM tok WHERE doc_id % 5 <> 0 AND token LIKE '%.'
 GROUP BY token), enc AS (SELECT doc_id, pos, CASE WHEN tok.token = '' THEN 4 + (SELECT count(*) FROM tv)
 WHEN tok.token LIKE '%.' THEN sv.id + 4 + (SELECT count(*) FROM tv) ELSE tv.id END AS id FROM tok
 LEFT JOIN tv ON tv.token = tok.token LEFT JOIN sv ON sv.token = tok.token)"""


@query("G7_encode_tree", f"""SELECT doc_id AS id, count(*) + 2 AS n, md5('2,' || string_agg(CAST(id AS VARCHAR), ','
 ORDER BY pos) || ',3') AS digest FROM enc GROUP BY doc_id HAVING count(*) = count(id)""".replace(
    "FROM enc", f"FROM (WITH {TREE_VOCABS} SELECT * FROM enc)"), "tok")
def encode_tree(t: Tables):
    """Words that end a sentence and empty words are strings; vocabularies come from four fifths of the documents."""
    string = lambda w: w.endswith(".") | (w == "")
    train = views.tokens(t).where("doc_id % 5 <> 0 AND token <> ''")
    target = vocab.count_vocab(train.where(~string(F.col("token"))), "token")
    source = vocab.count_vocab(train.where(string(F.col("token"))), "token")
    records = t.documents.select(F.col("doc_id").alias("id"), views.words("text").alias("tokens"))
    records = records.withColumn("is_string", F.transform("tokens", string))
    rows = vocab.encode_tree(records, "tokens", "is_string", target, source, target.count(), keep=False)
    text = F.array_join(F.transform("ast_seq_enc", lambda x: x.cast("string")), ",")
    return rows.select("id", F.size("ast_seq_enc").cast("long").alias("n"), F.md5(text).alias("digest"))


@query("G8_decode", "SELECT doc_id, md5(text) AS digest FROM documents")
def decode(t: Tables):
    """Documents as ids between start and end id, decoded back to text."""
    from nlcorpus.functions.tiered import code_arrays

    marked = F.transform(views.words("text"), lambda w: F.concat(F.lit(vocab.SPACE), w))
    records = t.documents.select("doc_id", marked.alias("words"))
    table = vocab.count_vocab(records.select(F.explode("words").alias("token")), "token")
    ids = code_arrays(records, "words", table, "piece", "id", "cnt", "inner", keep=False)
    ends = [F.array(F.lit(e).cast("long")) for e in (vocab.BOS, vocab.EOS)]
    text = vocab.decode(ids.select("doc_id", F.concat(ends[0], "inner", ends[1]).alias("ids")), "ids", table, keep=False)
    return text.select("doc_id", F.md5(F.regexp_replace("text", "^ ", "")).alias("digest"))


@query("G9_vocab_dump", f"""SELECT id, piece, count(*) OVER () AS size FROM ({vocab_sql('''SELECT word AS piece,
 count(*) AS cnt FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY word''')})""")
def vocab_dump(t: Tables):
    from nlcorpus.operators.profile import one_row

    table = vocab.count_vocab(t.benchmark.select(F.explode(views.words("text")).alias("word")), "word")
    size = table.agg(F.count("*").alias("size"))
    return one_row(table.select("id", "piece"), size)


@query("G10_oov_report", """SELECT token, count(*) AS cnt FROM tok WHERE token NOT IN (
 SELECT unnest(string_split(text, ' ')) FROM conversations) GROUP BY token""", "tok")
def oov_report(t: Tables):
    """Words of the documents that the conversations do not have."""
    known = t.conversations.select(F.explode(views.words("text")).alias("piece")).groupBy("piece").count()
    return vocab.oov_report(views.tokens(t), known)


@query("H1_train_valid_split", SPLIT_SQL, "doc_ids")
def train_valid_split(t: Tables):
    return dataset.train_valid_split(t.documents.select(F.col("doc_id").alias("id")), "id", 0.8)


@query("H2_two_file_dataset", f"""SELECT s.id, split, md5(array_to_string(ast_seq_enc, ',')) AS digest FROM ({SPLIT_SQL}) s
 JOIN doc_ids d ON d.id = s.id""", "doc_ids")
def two_file_dataset(t: Tables):
    """The split written as two files and read back as train and valid input."""
    rows = views.encoded(t).drop("text").withColumn("edge_order_seq", F.array()).withColumn("allowed_tokens", F.array())
    split = dataset.train_valid_split(rows, "id", 0.8)
    paths = {side: scratch_path(t.spark, f"{side}.parquet") for side in ("train", "valid")}
    for side, path in paths.items():
        split.where(F.col("split") == side).drop("split", "edge_order_seq", "allowed_tokens").withColumn(
            "edge_order_seq", F.array(F.lit(1))).withColumn("allowed_tokens", F.array(F.lit(1))).write.parquet(path)
    both = dataset.load_sets(t.spark, train=paths["train"], valid=paths["valid"], with_chars=False)
    text = F.array_join(F.transform("ast_seq_enc", lambda x: x.cast("string")), ",")
    return both.select("id", "split", F.md5(text).alias("digest"))


@query("H3_tree_path_transform", """SELECT id, array_to_string(list_transform(range(16), lambda i: CASE
 WHEN i < len(nl_enc) THEN nl_enc[i + 1] + (len(nl_enc) - 1 - i) * 2 ELSE 0 END), ',') AS path FROM doc_ids""",
       "doc_ids")
def tree_path_transform(t: Tables):
    """Line lengths stand in for a path."""
    paths = dataset.fixed_paths(F.array("nl_enc"), multiple=2, depth=16)
    return views.encoded(t).select("id", F.array_join(F.transform(
        paths[0], lambda x: x.cast("string")), ",").alias("path"))


def padded_sql(column: str, width: str) -> str:
    return (f"md5(array_to_string(list_concat({column}, list_transform(range({width} - len({column})), "
            f"lambda i: CAST(0 AS INTEGER))), ','))")


@query("H4_pad_batches", f"""SELECT id, batch, place, {padded_sql('nl_enc', 'src')} AS nl, {padded_sql('ast_seq_enc', 'tgt')}
 AS tree FROM (SELECT *, max(len(nl_enc)) OVER (PARTITION BY batch) AS src, max(len(ast_seq_enc)) OVER (
 PARTITION BY batch) AS tgt FROM (SELECT id, nl_enc, ast_seq_enc, (row_number() OVER (ORDER BY id) - 1) // 32 AS batch,
 CAST((row_number() OVER (ORDER BY id) - 1) % 32 AS INTEGER) AS place FROM doc_ids))""", "doc_ids")
def pad_batches(t: Tables):
    rows = dataset.pad_batches(views.encoded(t).drop("text"), ["id"], 32)
    text = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))
    return rows.select("id", "batch", "place", text("nl_enc").alias("nl"), text("ast_seq_enc").alias("tree"))


@query("H5_pad_chars", """SELECT doc_id, md5(string_agg(array_to_string(list_transform(range(1, 9), lambda i: CASE
 WHEN i <= length(token) THEN ascii(substr(token, i, 1)) ELSE 0 END), ','), '|' ORDER BY pos)) AS digest FROM tok
 GROUP BY doc_id""", "tok")
def pad_chars(t: Tables):
    letters = F.transform(views.words("text"), lambda w: F.filter(F.transform(
        F.split(w, ""), lambda c: F.ascii(c)), lambda x: x > 0))
    padded = F.transform(dataset.pad_chars(letters, 8), lambda cs: F.array_join(
        F.transform(cs, lambda x: x.cast("string")), ","))
    return t.documents.select("doc_id", F.md5(F.array_join(padded, "|")).alias("digest"))


@query("H6_test_set", """SELECT id, md5(text) AS nl, CAST(len(nl_enc) AS INTEGER) AS n_nl, true AS no_chars,
 'snippet ' || id AS snippet FROM doc_ids""", "doc_ids")
def test_set(t: Tables):
    rows = views.encoded(t).withColumn("snippet", F.concat(F.lit("snippet "), "id")).withColumnRenamed("text", "nl")
    done = dataset.test_set(rows)
    return done.select("id", F.md5("nl").alias("nl"), F.size("nl_enc").alias("n_nl"),
                       F.col("nl_char_enc").isNull().alias("no_chars"), "snippet")


@query("H7_preproc_outputs", """SELECT o_orderkey AS id, md5('place an order of ' || lower(o_orderpriority)
 || ' priority for customer ' || o_custkey || ' with status ' || o_orderstatus) AS intent, true AS aligned,
 2 AS first_id, 3 AS last_id, 12 AS max_depth, 10 AS n_nodes FROM orders""")
def preproc_outputs(t: Tables):
    """Train and statistics rows of the orders spelled as calls, joined again on their id.

    Reported are the intent the ids give back, whether the aligned sequences have the same length, and the
    depth and number of nodes, which are the same for all orders.
    """
    ready = preprocess.prepare(views.order_code(t))
    aligned = (F.size("ast_seq_enc") == F.size("edge_order_seq")) & (
        F.size("ast_seq_enc") == F.size("allowed_tokens")) & (F.size("nl_enc") == F.size("nl_char_enc"))
    intent = vocab.decode_nl(F.col("nl_enc"), ready.vocabularies.source)
    train = ready.train.select("id", F.md5(intent).alias("intent"), aligned.alias("aligned"),
                               F.get("ast_seq_enc", F.lit(0)).alias("first_id"),
                               F.element_at("ast_seq_enc", -1).alias("last_id"))
    nodes = F.size(F.filter("edge_counts", lambda e: e["type"] == "node"))
    return train.join(ready.stats.select("id", "max_depth", nodes.alias("n_nodes")), "id")
