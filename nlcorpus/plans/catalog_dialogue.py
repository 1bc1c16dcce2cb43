"""Queries for dialogue transcripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.operators import dialogue
from nlcorpus.plans import views  # noqa: F401
from nlcorpus.plans.catalog_sources import exchanges
from nlcorpus.plans.registry import Tables, query


@query("J1_turn_pairs", """SELECT a.conv_id, q.turn AS query_turn, md5(q.text) AS query, a.turn, md5(a.text) AS response
 FROM conversations a JOIN conversations q ON q.conv_id = a.conv_id AND q.turn = (SELECT max(u.turn)
 FROM conversations u WHERE u.conv_id = a.conv_id AND u.role = 'user' AND u.turn <= a.turn)
 WHERE a.role = 'assistant'""")
def turn_pairs(t: Tables):
    return dialogue.turn_pairs(t.conversations).select("conv_id", "query_turn", F.md5("query").alias("query"), "turn",
                                                       F.md5("response").alias("response"))


@query("J2_story_transitions", """SELECT step, next_step, count(*) AS n FROM (SELECT role AS step, lead(role) OVER (
 PARTITION BY conv_id ORDER BY turn) AS next_step FROM conversations) WHERE next_step IS NOT NULL GROUP BY ALL""")
def story_transitions(t: Tables):
    return dialogue.story_transitions(t.conversations, "conv_id", "turn", "role")


STORIES = {
    "one exchange": ["user", "assistant"],
    "two exchanges": ["user", "assistant", "user", "assistant"],
    "three exchanges": ["user", "assistant", "user", "assistant", "user", "assistant"],
    "guided": ["system", "user", "assistant", "user", "assistant"],
}
STORY_SQL = ", ".join(f"('{name}', '{' '.join(steps)}')" for name, steps in STORIES.items())


@query("J3_story_conformance", f"""SELECT conv_id, story FROM (SELECT conv_id, string_agg(role, ' ' ORDER BY turn)
 AS steps FROM conversations GROUP BY conv_id) JOIN (VALUES {STORY_SQL}) AS known(story, steps) USING (steps)""")
def story_conformance(t: Tables):
    return dialogue.story_conformance(t.conversations, known_stories(t), "conv_id", "turn", "role")


def known_stories(t: Tables):
    steps = [(story, i, name) for story, names in STORIES.items() for i, name in enumerate(names, 1)]
    return t.spark.createDataFrame(steps, "story string, step long, name string")


@query("J3_story_prefixes", f"""SELECT conv_id, len(roles) AS n_steps, coalesce((SELECT max(n) FROM (SELECT string_split(steps,
 ' ') AS names FROM (VALUES {STORY_SQL}) AS known(story, steps)), (SELECT unnest(range(1, 20)) AS n)
 WHERE n <= len(names) AND n <= len(roles) AND names[1:n] = roles[1:n]), 0) AS followed
 FROM (SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id)""")
def story_prefixes(t: Tables):
    """How far every conversation follows the story that it follows longest."""
    rows = dialogue.story_prefixes(t.conversations, known_stories(t), "conv_id", "turn", "role")
    return rows.select("conv_id", "n_steps", "followed")


@query("J4_fallback_rule", """SELECT user_id, day, max(name) FILTER (rn = 1) AS intent, max(c) FILTER (rn = 1) AS top1,
 max(c) FILTER (rn = 2) AS top2, max(c) FILTER (rn = 1) < 0.25 OR coalesce(max(c) FILTER (rn = 1)
 - max(c) FILTER (rn = 2) < 0.05, false) AS fallback FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day
 ORDER BY c DESC, name) AS rn FROM (SELECT user_id, CAST(ts AS DATE) AS day, event_type AS name, max(value) / 200 AS c
 FROM events GROUP BY ALL)) GROUP BY user_id, day""")
def fallback_rule(t: Tables):
    """Each user's day is a message; the largest value of an event type is that intent's confidence."""
    candidates = t.events.groupBy("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("name")).agg(
        (F.max("value") / 200).alias("confidence"))
    return dialogue.fallback_rule(candidates, ["user_id", "day"], "name", "confidence")


@query("J5_word_count_features", """SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id,
 unnest(string_split_regex(text, '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL""")
def word_count_features(t: Tables):
    return dialogue.word_counts(t.documents, "doc_id", "text")


@query("J6_char_ngram_features", """SELECT conv_id, gram, CAST(sum(c) AS BIGINT) AS n FROM (SELECT conv_id, c,
 unnest(list_transform(range(1, length(w) - k + 2), lambda i: substr(w, i, k))) AS gram FROM (SELECT conv_id,
 ' ' || lower(word) || ' ' AS w, count(*) AS c FROM (SELECT conv_id, unnest(string_split_regex(text, '\\s+')) AS word
 FROM conversations) WHERE word <> '' GROUP BY ALL), (VALUES (1), (2), (3), (4)) AS sizes(k) WHERE k <= length(w))
 GROUP BY ALL""")
def char_ngram_features(t: Tables):
    return dialogue.char_ngrams(dialogue.word_counts(t.conversations, "conv_id", "text"), "conv_id")


@query("J7_answer_rate", """SELECT conv_id, count(*) AS n_answers, round(avg(CASE WHEN length(text) % 13 <> 0
 AND contains(text, chr(10)) THEN 1.0 ELSE 0.0 END), 6) AS code_rate, round(avg(CASE WHEN length(text) % 13 = 0
 THEN 1.0 ELSE 0.0 END), 6) AS failure_rate FROM conversations WHERE role = 'assistant' GROUP BY conv_id""")
def answer_rate(t: Tables):
    """Answers of several lines count as code; some answers are set to the no-translation text."""
    text = F.when(F.length("text") % 13 == 0, dialogue.NO_TRANSLATION).otherwise(F.col("text"))
    rates = dialogue.answer_rate(t.conversations.withColumn("text", text), F.contains("text", F.lit("\n")),
                                 F.col("text") == dialogue.NO_TRANSLATION)
    return rates.withColumns({c: F.round(c, 6) for c in ("code_rate", "failure_rate")})


@query("J8_transcript_eval", """SELECT conv_id, count(*) AS n, round(avg(CASE WHEN turn % 4 = 0 THEN 0.0 ELSE 1.0 END), 6)
 AS match_rate FROM conversations WHERE role = 'user' GROUP BY conv_id""")
def transcript_eval(t: Tables):
    """Generated code is the expected code below the query comment, with a semicolon added in every fourth turn."""
    rows = exchanges(t)
    generated = F.concat("bot_response_code_generated", F.when(F.col("turn") % 4 == 0, ";").otherwise(""))
    bare = dialogue.strip_query_comment(generated)
    match = F.avg((bare == F.col("bot_response_code_expected")).cast("int"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.round(match, 6).alias("match_rate"))


@query("J9_session_expiry", """SELECT user_id, CAST(session AS BIGINT) AS session, min(ts) AS started, max(ts) AS ended,
 count(*) AS n_events FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts > before + INTERVAL 60 MINUTE
 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT user_id, ts, lag(ts) OVER (
 PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY user_id, session""")
def session_expiry(t: Tables):
    return dialogue.session_summary(dialogue.sessions(t.events.select("user_id", "ts"), "user_id", "ts"), "user_id", "ts")
