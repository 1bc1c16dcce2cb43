"""Queries of the training-data operators over the given tables, and their SQL where SQL can tell the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nlcorpus.llm import boosted, codebooks, crf, exact, fertility, infill, jaccard, pieces, rollup, semantic, spans, suffixes, urls
from nlcorpus.llm.common import documents
from nlcorpus.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def piece_model() -> str:
    """Where the public sentencepiece vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


@query("op1_token_rollup", """
WITH c AS (
  SELECT source, lang, doc_id, coalesce(text, '') AS text,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS w,
    CAST(len(regexp_extract_all(coalesce(text, ''), '(\\p{L}+|\\p{N}{1,3}|[^\\p{L}\\p{N}\\x20\\x09-\\x0D])')) AS BIGINT) AS p
  FROM documents),
firsts AS (SELECT min(doc_id) AS doc_id FROM c GROUP BY text),
f AS (SELECT * FROM c WHERE doc_id IN (SELECT doc_id FROM firsts)),
r AS (
  SELECT source, lang, 'words-1' AS tokenizer, doc_id, w - len(regexp_extract_all(text, '\\|')) AS n FROM f
  UNION ALL SELECT source, lang, 'pieces-2', doc_id, p FROM f)
SELECT source, lang, tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens FROM r
GROUP BY source, lang, tokenizer""")
def op1_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents by two tokenizer versions, then the later copies of equal texts
    deleted, then table bars taken out of the word counts of what is left. The second batch comes twice."""
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "text")
    store = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    words, parts = (rollup.counted(docs, v) for v in ("words-1", "pieces-2"))
    store.commit("2024-01-words", rollup.inserts(words))
    store.commit("2024-01-pieces", rollup.inserts(parts))
    store.commit("2024-01-pieces", rollup.inserts(parts))
    keyed = words.unionByName(parts).select(
        "doc_id", "source", "lang", "tokenizer", "tokens", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"),
        (F.length(F.coalesce("text", F.lit(""))) - F.length(F.translate(F.coalesce("text", F.lit("")), "|", ""))).alias("bars"))
    firsts = docs.groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).agg(F.min("doc_id").alias("doc_id"))
    store.commit("2024-02-copies", rollup.inserts(keyed.join(firsts.select("doc_id"), "doc_id", "left_anti"), -1))
    left = keyed.where("tokenizer = 'words-1'").join(firsts.select("doc_id"), "doc_id", "left_semi")
    store.commit("2024-02-bars", rollup.revisions(left.withColumn("revised", F.col("tokens") - F.col("bars"))))
    return store.totals()


@query("op2_tokeniser_fertility")
def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and fertility bands on every document."""
    judged = fertility.judge(documents(spark, sf_dir), piece_model())
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "n_tokens", "chars_per_token", "byte_share", "entropy")


@query("op3_field_pii")
def op3_field_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document: counts and digest of the base rules, and all spans."""
    found = crf.find(documents(spark, sf_dir))

    def listed(spans: str) -> Column:
        form = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
        return F.array_join(F.transform(spans, form), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in crf.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


@query("op4_boosted_quality")
def op4_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learnt from the labels outside the held-out fold."""
    return boosted.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


@query("op5_semantic_leaks")
def op5_semantic_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return semantic.leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


@query("op6_shingle_classes", """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 100 * p.c >= 75 * (x.n + y.n - p.c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT d, min(root) AS component_id FROM r GROUP BY d) c ON c.d = w.doc_id""")
def op6_shingle_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document."""
    return jaccard.link_classes(documents(spark, sf_dir))


@query("op7_suffix_tree")
def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document under a suffix tree grown from the documents outside the held-out fold."""
    return suffixes.score(documents(spark, sf_dir))


@query("op8_piece_chunks")
def op8_piece_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return pieces.digests(documents(spark, sf_dir), piece_model())


@query("op9_sentence_spans")
def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that repeat a span found earlier in the corpus."""
    cut = spans.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cut.select("doc_id", "n_sentences", "n_removed", "words_removed", "text")


@query("op10_url_equivalence", """
WITH p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '^[\\s\\S]*?://([^/?#]*)', 1), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
known AS (
  SELECT DISTINCT url AS a FROM p WHERE url IS NOT NULL),
forms AS (
  SELECT a,
    regexp_replace(translate(regexp_extract(a, '^[\\s\\S]*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^(www|m)\\.', '')
    || regexp_replace(regexp_extract(a, '^[\\s\\S]*?://[^/?#]*([^?#]*)', 1), '/(index\\.html?)?$', '') AS site,
    trim(regexp_replace(regexp_replace(regexp_extract(a, '^[^?#]*\\?([^#]*)', 1),
      '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid)=[^&]*', '', 'g'), '&&+', '&', 'g'), '&') AS q
  FROM known),
classes AS (
  SELECT a, site || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS class FROM forms),
rules(verdict, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fits AS (
  SELECT u.url, r.host || r.path AS rule, r.verdict,
    row_number() OVER (PARTITION BY u.url ORDER BY length(r.host || r.path) DESC) AS place
  FROM (SELECT DISTINCT url, host, path FROM p WHERE url IS NOT NULL) u
  JOIN rules r ON ends_with('.' || u.host, '.' || r.host) AND starts_with(u.path, r.path)),
decided AS (
  SELECT c.class, bool_or(f.verdict = 'allow') AS allowed
  FROM classes c JOIN fits f ON f.url = c.a AND f.place = 1 GROUP BY c.class)
SELECT p.page_id, p.host, p.path, f.rule,
  coalesce(f.verdict, CASE WHEN d.allowed THEN 'allow' WHEN d.allowed IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN fits f ON f.url = p.url AND f.place = 1
LEFT JOIN classes c ON c.a = p.url LEFT JOIN decided d ON d.class = c.class""")
def op10_url_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page. The SQL names the classes by canonical form, as no given page declares a link."""
    return urls.judge(documents(spark, sf_dir, "pages"), urls.RULES)


@query("op11_digest_runs", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op11_digest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its text that stays, which has the largest id."""
    return exact.dedup(documents(spark, sf_dir), largest=True)


def _assigned_sql(name: str, books: str) -> str:
    """SQL for the nearest entry of every part under the codebooks ``books``."""
    distance = " + ".join(f"(p.{x} - c.{x}) * (p.{x} - c.{x})" for x in "abcd")
    return (f"{name} AS (SELECT r, part, m.e, m.d AS far FROM (SELECT p.r, p.part, min({{'d': {distance}, 'e': c.e}}) AS m "
            f"FROM p JOIN {books} c ON c.part = p.part GROUP BY p.r, p.part))")


def _updated_sql(name: str, books: str, assigned: str) -> str:
    """SQL for the codebooks after the update by an assignment."""
    means = ", ".join(f"CAST(floor(CAST(sum({x}) AS DOUBLE) / count(*)) AS BIGINT) AS {x}" for x in "abcd")
    return (f"{name} AS (SELECT c.part, c.e, {', '.join(f'coalesce(u.{x}, c.{x}) AS {x}' for x in 'abcd')} FROM {books} c "
            f"LEFT JOIN (SELECT part, e, {means} FROM p JOIN {assigned} USING (r, part) GROUP BY part, e) u "
            f"ON u.part = c.part AND u.e = c.e)")


@query("op12_active_lloyd", f"""
WITH q AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (
  SELECT r, part, v[4 * part + 1] AS a, v[4 * part + 2] AS b, v[4 * part + 3] AS c, v[4 * part + 4] AS d
  FROM q, (SELECT unnest(range(16)) AS part)),
c0 AS (SELECT part, r - 1 AS e, a, b, c, d FROM p WHERE r <= 64),
{_assigned_sql("a1", "c0")}, {_updated_sql("c1", "c0", "a1")},
{_assigned_sql("a2", "c1")}, {_updated_sql("c2", "c1", "a2")},
{_assigned_sql("a3", "c2")},
coded AS (
  SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a3 GROUP BY r),
books AS (SELECT sha256(string_agg(concat_ws(',', a, b, c, d), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT q.vec_id, coded.code, coded.error, CAST(sum(coded.error) OVER (PARTITION BY q.label) AS BIGINT) AS label_error,
  books.codebooks_sha256
FROM q JOIN coded USING (r), books""")
def op12_active_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors after two rounds, with their errors and the digest of the codebooks."""
    trained = codebooks.fit(documents(spark, sf_dir, "embeddings"))
    return codebooks.with_errors(trained).select("vec_id", "code", "error", "label_error",
                                                 F.lit(trained.sha256()).alias("codebooks_sha256"))


@query("op13_sparse_infill", """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS u,
    sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
d AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25],
    lambda i: CAST('0x' || substr(h, i, 8) AS BIGINT)) AS h FROM t),
c AS (
  SELECT doc_id, text, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50
      THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
s AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:i], '') AS prefix, array_to_string(u[i + 1:j], '') AS middle,
    array_to_string(u[j + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM s""")
def op13_sparse_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its parts in the drawn order, and the text rebuilt from that."""
    changed = infill.restore(infill.transform(documents(spark, sf_dir)))
    return changed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                          F.sha2("restored", 256).alias("restored_sha256"))
