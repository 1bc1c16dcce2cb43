"""Queries for evaluation, error analysis and candidate tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.functions import arrays
from nlcorpus.operators import decode, errors, evaluate, grammar
from nlcorpus.plans import views
from nlcorpus.plans.registry import Tables, query
from nlcorpus.plans.views import bleu_sql, code_tokens_sql
from nlcorpus.session import materialize

BEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(bleu, 12) DESC, rank) AS rn
 FROM bleu_stats WHERE rank < {0}) WHERE rn = 1)"""
EM_SQL = ", ".join(f"avg(CASE WHEN hit <= {k} THEN 1.0 ELSE 0.0 END) AS em_{k}" for k in evaluate.EM_CUTS)
FIRST_HIT = "(SELECT id, min(rank) FILTER (pred = expected) AS hit FROM cand GROUP BY id)"


def corpus_sql(k: int) -> str:
    sums = ", ".join(f"sum(m{n}) AS m{n}, sum(p{n}) AS p{n}" for n in range(1, 5))
    return (f"(SELECT round({bleu_sql('c', 'r', 'm{}', 'p{}')}, 6) FROM (SELECT sum(cand_len) AS c, "
            f"sum(ref_len) AS r, {sums} FROM {BEST.format(k)}))")


BLEU_SQL = ", ".join(f"{corpus_sql(k)} AS bleu_{k}" for k in evaluate.BLEU_CUTS)


def rounded(df, *columns: str, places: int = 6):
    return df.withColumns({c: F.round(c, places) for c in columns})


@query("I1_exact_match_at_k", f"SELECT {EM_SQL.replace('avg(', 'round(avg(').replace(') AS', '), 6) AS')} FROM {FIRST_HIT}",
       "cand")
def exact_match_at_k(t: Tables):
    return rounded(evaluate.exact_match(*views.predictions(t)), *[f"em_{k}" for k in evaluate.EM_CUTS])


@query("I1_exact_match_ast_seq", """SELECT round(avg(CASE WHEN id % 3 = 1 THEN 1.0 ELSE 0.0 END), 6) AS em_1,
 round(avg(CASE WHEN id % 3 < 2 THEN 1.0 ELSE 0.0 END), 6) AS em_3 FROM (SELECT doc_id AS id FROM documents)""")
def exact_match_ast_seq(t: Tables):
    """Sequence mode: the right word list comes first, third or not at all."""
    rows = views.sequences(t)
    wrong = F.concat("expected", F.array(F.lit("!")))
    third = F.col("id") % 3
    ranked = F.when(third == 1, F.array("expected", wrong, wrong)).when(
        third == 0, F.array(wrong, wrong, "expected")).otherwise(F.array(wrong, wrong, wrong))
    records = evaluate.split_records(rows.withColumn("predicted", ranked))
    return rounded(evaluate.exact_match(*records, cuts=(1, 3)), "em_1", "em_3")


@query("I2_tokenize_code", f"""SELECT 'conversation' AS kind, conv_id AS id, turn, md5(array_to_string(
 {code_tokens_sql('text')}, ' ')) AS tokens FROM conversations UNION ALL
 SELECT 'page', page_id, 0, md5(array_to_string({code_tokens_sql('html')}, ' ')) FROM pages""")
def tokenize_code(t: Tables):
    digest = lambda c: F.md5(F.array_join(evaluate.tokenize_code(F.col(c)), " ")).alias("tokens")
    turns = t.conversations.select(F.lit("conversation").alias("kind"), F.col("conv_id").alias("id"), "turn",
                                   digest("text"))
    pages = t.pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                           F.lit(0).cast("long").alias("turn"), digest("html"))
    return turns.unionByName(pages)


@query("I3_sentence_bleu_best_of_k", f"""SELECT a.id, a.rank AS rank_1, round(a.bleu, 6) AS bleu_1,
 b.rank AS rank_20, round(b.bleu, 6) AS bleu_20 FROM {BEST.format(1)} a JOIN {BEST.format(20)} b
 ON b.id = a.id""", "bleu_stats")
def sentence_bleu_best_of_k(t: Tables):
    best = evaluate.best_candidates(evaluate.candidate_stats(*views.predictions(t)), (1, 20))
    return best.select("id", *[c for k in (1, 20) for c in (
        F.col(f"best_{k}.rank").alias(f"rank_{k}"), F.round(f"best_{k}.bleu", 6).alias(f"bleu_{k}"))])


@query("I4_corpus_bleu", f"SELECT {BLEU_SQL}", "bleu_stats")
def corpus_bleu(t: Tables):
    stats = evaluate.candidate_stats(*views.predictions(t))
    return rounded(evaluate.corpus_bleu(evaluate.best_candidates(stats)),
                   *[f"bleu_{k}" for k in evaluate.BLEU_CUTS])


VALIDITY = """count(*) FILTER (rank IS NOT NULL AND pred IS NULL) AS num_invalid_predictions,
 count(*) FILTER (pred IS NOT NULL) AS num_valid_predictions"""


@query("I5_prediction_validity_counts", f"SELECT {VALIDITY} FROM cand", "cand")
def prediction_validity_counts(t: Tables):
    return evaluate.validity_counts(views.predictions(t)[1])


@query("I6_tokenize_predictions", f"""SELECT id, rank, md5(array_to_string(
 {code_tokens_sql('pred')}, ' ')) AS tokens FROM valid_cand""", "valid_cand")
def tokenize_predictions(t: Tables):
    rows = evaluate.tokenize_predictions(views.predictions(t)[1])
    return rows.select("id", "rank", F.md5(F.array_join("tokens", " ")).alias("tokens"))


def scores(t: Tables):
    return errors.prefix_scores(views.sequence_ids(t), "expected", "predicted", views.LITERAL_LIMIT).drop(
        "expected", "predicted")


@query("I7_common_prefix", "SELECT * FROM scores", "scores")
def common_prefix(t: Tables):
    return scores(t)


@query("I8_collapse_literals", """SELECT id, md5(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS digest,
 count(*) AS n FROM seq_short WHERE side = 'e' GROUP BY id""", "seq_short")
def collapse_literals(t: Tables):
    short = arrays.collapse_above(F.col("expected"), views.LITERAL_LIMIT)
    text = F.array_join(F.transform(short, lambda x: x.cast("string")), ",")
    return views.sequence_ids(t).select("id", F.md5(text).alias("digest"), F.size(short).cast("long").alias("n"))


@query("I9_merge_literal_runs", """SELECT doc_id AS id, run, md5(string_agg(token, '' ORDER BY pos)) AS digest,
 min(kind) AS kind FROM (SELECT *, CAST(sum(CASE WHEN kind = 'strliteral' AND before = 'strliteral' THEN 0 ELSE 1 END)
 OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM (SELECT *, lag(kind) OVER (PARTITION BY doc_id
 ORDER BY pos) AS before FROM (SELECT *, CASE WHEN length(token) >= 6 THEN 'strliteral' ELSE 'node' END AS kind
 FROM tok))) GROUP BY doc_id, run""", "tok")
def merge_literal_runs(t: Tables):
    """Runs are told inside the row; rows that share an id are one record, and only those meet."""
    kind = lambda w: F.when(F.length(w) >= 6, "strliteral").otherwise("node")
    shared = materialize(t.documents.groupBy(F.struct("doc_id").alias("key")).agg(F.count("*").alias("n"))
                         .where("n > 1").select("key"), "shared-ids")
    docs = t.documents.select(F.struct("doc_id").alias("key"), F.col("doc_id").alias("id"), "text")
    single = docs.join(shared, "key", "left_anti").where("text is not null")
    runs = errors.merged_runs(views.words("text"), F.transform(views.words("text"), kind))
    rows = single.select("id", F.inline(runs)).select("id", "run", "token", "kind")
    tokens = docs.join(shared, "key", "left_semi").select("id", F.posexplode(views.words("text")).alias("pos", "token"))
    met = errors.merge_literal_runs(tokens.withColumn("kind", kind(F.col("token"))))
    return rows.unionByName(met).select("id", "run", F.md5("token").alias("digest"), "kind")


@query("I10_strip_type_suffix", """SELECT regexp_replace(label, '#strliteral|#literal', '', 'g') AS token,
 CASE WHEN label LIKE '%#strliteral' THEN 'strliteral' ELSE 'node' END AS kind, count(*) AS n FROM profile
 GROUP BY ALL""", "profile")
def strip_type_suffix(t: Tables):
    label = F.col("label")
    return views.profile(t).groupBy(errors.strip_suffix(label).alias("token"), errors.kind_of(label).alias("kind")).agg(
        F.count("*").alias("n"))


def kinded_sequences(t: Tables):
    """Word sequences with kinds: words of six letters and more are string literals, others nodes."""
    kinds = lambda c: F.transform(c, lambda w: F.when(F.length(w) >= 6, "strliteral").otherwise("node"))
    rows = views.sequences(t)
    return rows.withColumn("expected_kinds", kinds(F.col("expected"))).withColumn(
        "predicted_kinds", kinds(F.col("predicted")))


@query("I11_sequence_diff")
def sequence_diff(t: Tables):
    codes = errors.sequence_diff(kinded_sequences(t))
    return codes.select("id", "tag", "pos_exp_i1", "pos_exp_i2", "pos_pred_j1", "pos_pred_j2",
                        F.array_join("val_exp", " ").alias("val_exp"), F.array_join("val_pred", " ").alias("val_pred"))


@query("I11_diff_rebuilds", """SELECT id, md5(array_to_string(expected, ' ')) AS expected,
 md5(array_to_string(predicted, ' ')) AS predicted FROM seq_text WHERE len(expected) + len(predicted) > 0""", "seq_text")
def diff_rebuilds(t: Tables):
    """Both sequences put together again from the opcodes; equal stretches come from the other side."""
    codes = errors.sequence_diff(kinded_sequences(t))
    equal = F.col("tag") == "equal"
    side = lambda own, other: F.when(equal, F.col(other)).otherwise(F.col(own))
    ordered = F.sort_array(F.collect_list(F.struct("pos_exp_i1", "pos_pred_j1", side("val_exp", "val_pred").alias("e"),
                                                   side("val_pred", "val_exp").alias("p"))))
    text = lambda field: F.md5(F.array_join(F.flatten(F.transform("parts", lambda c: c[field])), " "))
    return codes.groupBy("id").agg(ordered.alias("parts")).select("id", text("e").alias("expected"),
                                                                  text("p").alias("predicted"))


def percent(top: str, bottom: str, many: str) -> str:
    """SQL for one value per prefix; ``many`` combines the two columns of a row or of all rows."""
    return ", ".join(f"round({many.format(p + top, p + bottom)}, 6) AS {p}value" for p in ("", "replaced_"))


def both(df):
    return rounded(df, "value", "replaced_value")


MEAN, TOTAL = "avg({0} * 100 / nullif({1}, 0))", "sum({0}) * 100 / sum({1})"


@query("I12_seq_recall", f"SELECT {percent('prefix_len', 'expected_len', MEAN)} FROM scores", "scores")
def seq_recall(t: Tables):
    return both(errors.sequence_recall(scores(t)))


@query("I12_seq_precision", f"SELECT {percent('prefix_len', 'predicted_len', MEAN)} FROM scores", "scores")
def seq_precision(t: Tables):
    return both(errors.sequence_precision(scores(t)))


@query("I13_token_recall", f"SELECT {percent('prefix_len', 'expected_len', TOTAL)} FROM scores", "scores")
def token_recall(t: Tables):
    return both(errors.token_recall(scores(t)))


@query("I13_token_precision", f"SELECT {percent('prefix_len', 'predicted_len', TOTAL)} FROM scores", "scores")
def token_precision(t: Tables):
    return both(errors.token_precision(scores(t)))


@query("I14_prefix_exact_match", """SELECT round(avg(CASE WHEN prefix_len = expected_len THEN 100.0 ELSE 0.0 END), 6)
 AS value, round(avg(CASE WHEN replaced_prefix_len = replaced_expected_len THEN 100.0 ELSE 0.0 END), 6)
 AS replaced_value FROM scores""", "scores")
def prefix_exact_match(t: Tables):
    return both(errors.prefix_exact_match(scores(t)))


@query("I15_brevity_penalty", """SELECT round(exp(1 - 1 / least(1.0, sum(predicted_len) / sum(expected_len))), 6)
 AS brevity_penalty, count(*) FILTER (predicted_len < expected_len) AS n_shorter,
 count(*) FILTER (predicted_len >= expected_len) AS n_not_shorter FROM scores""", "scores")
def brevity_penalty(t: Tables):
    return rounded(errors.brevity_penalty(scores(t)), "brevity_penalty")


@query("I15_brevity_by_length", """SELECT predicted_len < expected_len AS shorter,
 round(avg(least(1.0, predicted_len / expected_len)), 6) AS mean_brevity FROM scores GROUP BY 1""", "scores")
def brevity_by_length(t: Tables):
    return rounded(errors.brevity_by_length(scores(t)), "mean_brevity")


@query("I16_score_difference_describe", """SELECT count(*) AS count, round(avg(d), 6) AS mean,
 round(stddev_samp(d), 6) AS std, round(min(d), 6) AS min, round(quantile_cont(d, 0.25), 6) AS p25,
 round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.75), 6) AS p75, round(max(d), 6) AS max
 FROM (SELECT user_id, date_trunc('day', ts) AS day, round(sum(CASE WHEN event_type IN ('click', 'view') THEN -value ELSE value END), 4)
 AS d FROM events GROUP BY ALL)""")
def score_difference_describe(t: Tables):
    """Expected minus predicted log score of daily user sequences; clicks and views are the expected side."""
    side = F.when(F.col("event_type").isin("click", "view"), -F.col("value")).otherwise(F.col("value"))
    rows = t.events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.round(F.sum(side), 4).alias("d"))
    names = ("mean", "std", "min", "p25", "p50", "p75", "max")
    return rounded(errors.describe_scores(rows, "d"), *names)


@query("I17_sequence_scores", """SELECT user_id, round(sum(-value), 4) AS score, count(*) AS n_tokens FROM events
 WHERE event_type <> 'error' GROUP BY user_id""")
def sequence_scores(t: Tables):
    steps = t.events.withColumn("logp", -F.col("value"))
    return rounded(decode.sequence_scores(steps, "user_id", "event_type", "logp", pad="error"), "score", places=4)


@query("I17_best_tokens", """SELECT user_id, day, arg.t AS token, -arg.c AS logp FROM (SELECT user_id,
 CAST(ts AS DATE) AS day, min({'c': value, 't': event_type}) AS arg FROM events GROUP BY ALL)""")
def best_tokens(t: Tables):
    steps = t.events.select("user_id", F.to_date("ts").alias("day"), "event_type", (-F.col("value")).alias("logp"))
    return decode.best_tokens(steps, ["user_id", "day"], "event_type", "logp")


@query("I18_diff_type_counts")
def diff_type_counts(t: Tables):
    rows = kinded_sequences(t)
    return errors.diff_type_counts(rows, errors.sequence_diff(rows))


@query("I18_type_totals", """SELECT kind, count(*) FILTER (side = 'e') AS expected, count(*) FILTER (side = 'p')
 AS predicted FROM (SELECT side, CASE WHEN length(token) >= 6 THEN 'strliteral' ELSE 'node' END AS kind FROM seq_rows)
 GROUP BY kind""", "seq_rows")
def type_totals(t: Tables):
    rows = kinded_sequences(t)
    counts = errors.diff_type_counts(rows, errors.sequence_diff(rows))
    return counts.groupBy("kind").agg(F.sum("expected").alias("expected"), F.sum("predicted").alias("predicted"))


@query("I19_type_precision_recall")
def type_precision_recall(t: Tables):
    rows = kinded_sequences(t)
    counts = errors.diff_type_counts(rows, errors.sequence_diff(rows))
    return rounded(errors.type_precision_recall(counts), "precision", "recall")


@query("I20_perplexity", """SELECT CAST(ts AS DATE) AS epoch, round(avg(value / 100), 6) AS avg_loss,
 round(exp(avg(value / 100)), 6) AS perplexity FROM events GROUP BY 1""")
def perplexity(t: Tables):
    losses = t.events.select("ts", (F.col("value") / 100).alias("loss"))
    return rounded(decode.perplexity(losses, F.to_date("ts"), "loss"), "avg_loss", "perplexity")


@query("I21_rank_candidates", """SELECT user_id, event_id, value, CAST(rank AS INTEGER) AS rank FROM (SELECT *,
 row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events WHERE event_type <> 'error')
 WHERE rank <= 5""")
def rank_candidates(t: Tables):
    ranked = decode.rank_candidates(t.events, ["user_id"], "value", "event_id", 5, F.col("event_type") != "error")
    return ranked.select("user_id", "event_id", "value", "rank")


@query("I22_mask_candidates", """SELECT user_id, event_id, event_type, value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events
 WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE value > 150)) WHERE rank <= 5""")
def mask_candidates(t: Tables):
    """Users are the open fields; their event types with any value above 150 are the allowed tokens."""
    seen = t.events.where("value > 150").select(F.col("user_id").alias("parent"), F.col("event_type").alias("child"))
    return masked_events(t, grammar.intern_sets(seen))


def masked_events(t: Tables, sets: grammar.ChildSets):
    return decode.mask_candidates(t.events, sets, "user_id", "event_type", ["user_id"], "value", "event_id", 5).select(
        "user_id", "event_id", "event_type", "value", "rank")


@query("I22_mask_any_text", """SELECT user_id, event_id, event_type, value, CAST(rank AS INTEGER) AS rank FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS rank FROM events
 WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE value > 150)
 OR user_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE value > 150) AND length(event_type) > 4
 AND event_type IN (SELECT event_type FROM events WHERE value > 150)) WHERE rank <= 5""")
def mask_any_text(t: Tables):
    """The same with all event types of more than four letters allowed for every third user."""
    seen = t.events.where("value > 150").select(F.col("user_id").alias("parent"), F.col("event_type").alias("child"))
    return masked_events(t, grammar.intern_sets(seen, text_fields=seen.where("parent % 3 = 0"), is_text=F.length("child") > 4))


@query("I23_token_scores", """SELECT e.user_id, e.event_id, event_type, value AS cost, CAST(rank AS INTEGER) AS rank
 FROM events e JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score, day) AS rank FROM (
 SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS score FROM events GROUP BY ALL)) b
 ON b.user_id = e.user_id AND b.day = CAST(e.ts AS DATE) WHERE rank <= 3""")
def token_scores(t: Tables):
    """Daily user sequences as candidates; the steps of the three cheapest of each user."""
    steps = t.events.select("user_id", F.to_date("ts").alias("day"), "event_id", "event_type",
                            (-F.col("value")).alias("logp"))
    totals = steps.groupBy("user_id", "day").agg(F.round(F.sum(-F.col("logp")), 4).alias("score"))
    best = decode.rank_candidates(totals, ["user_id"], "score", "day", 3)
    return decode.token_scores(steps, best, ["user_id", "day"], "logp").select(
        "user_id", "event_id", "event_type", "cost", "rank")


@query("I24_prediction_table", """SELECT id, md5(any_value(expected)) AS expected, count(rank) AS n,
 md5(coalesce(string_agg(coalesce(pred, '<null>'), '|' ORDER BY rank) FILTER (rank IS NOT NULL), '')) AS predicted FROM cand GROUP BY id""",
       "cand")
def prediction_table(t: Tables):
    inputs, candidates = views.predictions(t)
    table = inputs.join(decode.prediction_table(candidates, "id", {"predicted": "predicted"}), "id", "left")
    return table.select("id", F.md5("expected").alias("expected"), F.coalesce(F.size("predicted"), F.lit(0)).cast("long").alias("n"),
                        F.md5(F.coalesce(F.array_join("predicted", "|", "<null>"), F.lit(""))).alias("predicted"))


@query("I24_ranked_candidates", """SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id)
 AS rank FROM events WHERE event_type <> 'error'""")
def ranked_candidates(t: Tables):
    """All valid candidates of every input ranked by score, however many an input has."""
    ranked = decode.rank_candidates(t.events.select("user_id", "event_id", "value", "event_type"), ["user_id"], "value",
                                    "event_id", None, F.col("event_type") != "error")
    return ranked.select("user_id", "event_id", "rank")


@query("I25_eval_report", f"""SELECT em.*, {BLEU_SQL}, v.* FROM (SELECT
 {EM_SQL.replace('avg(', 'round(avg(').replace(') AS', '), 6) AS')} FROM {FIRST_HIT}) em, (SELECT {VALIDITY}
 FROM cand) v""", "cand bleu_stats")
def eval_report(t: Tables):
    return rounded(evaluate.eval_report(*views.predictions(t)), *[f"em_{k}" for k in evaluate.EM_CUTS],
                   *[f"bleu_{k}" for k in evaluate.BLEU_CUTS])
