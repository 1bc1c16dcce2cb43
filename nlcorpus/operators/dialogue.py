"""Analytics of dialogue transcripts: turn pairs, stories, fallback, features, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nlcorpus.functions.keyed import lookup_join
from nlcorpus.functions.ordered import bounded_chunks, chunk_of, fill_forward, islands, number_rows
from nlcorpus.session import materialize

# Thresholds, session length and texts of the assistant's configuration.
CONFIDENCE_THRESHOLD = 0.25
AMBIGUITY_THRESHOLD = 0.05
SESSION_MINUTES = 60
MAX_CHAR_NGRAM = 4
GRAMS_A_TASK = 500_000  # character n-grams that a task counts, on average
NO_TRANSLATION = "Could not translate to code. Please try reformulating your question."


def turn_pairs(turns: DataFrame, asker: str = "user", answerer: str = "assistant") -> DataFrame:
    """``(conv_id, query_turn, query, turn, response)``: each answer with the question it follows."""
    question = F.when(F.col("role") == asker, F.struct("turn", "text"))
    carried = fill_forward(turns, ["conv_id"], "turn", question, "asked", chunk_of(F.col("turn")))
    return (carried.where((F.col("role") == answerer) & F.col("asked").isNotNull())
            .select("conv_id", F.col("asked.turn").alias("query_turn"), F.col("asked.text").alias("query"),
                    "turn", F.col("text").alias("response")))


def story_transitions(steps: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """``(step, next_step, n)`` over all neighbouring steps of a conversation or story."""
    rows = islands(steps, [key], position, [name], lambda prev, cur: F.lit(False), "run", "before",
                   chunk_of(F.col(position)))
    return (rows.where(F.col("before").isNotNull())
            .groupBy(F.col(f"before.{name}").alias("step"), F.col(name).alias("next_step"))
            .agg(F.count("*").alias("n")))


def _states(rows: DataFrame, key: str, step: str, name: str) -> DataFrame:
    """``rows`` with ``state``: what stands for the names from step 1 to this one.

    It is two sums of hashes of (step, name), so the states of two stretches add up to that of both, in any chunks.
    """
    upto = Window.partitionBy(key).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    move = lambda seed: F.xxhash64(F.lit(seed), F.col(step).cast("long"), F.coalesce(name, F.lit("")), F.col(name).isNull())
    part = lambda seed: F.sum(move(seed).cast("decimal(38,0)")).over(upto).alias(f"h{seed}")
    return rows.withColumn("state", F.struct(F.col(step).cast("long").alias("length"), part(0), part(1)))


def story_automaton(stories: DataFrame) -> DataFrame:
    """``(state, length, stories)``: every prefix of a story ``(story, step, name)``, with the stories that end there."""
    ends = stories.groupBy("story").agg(F.max("step").alias("story_len"))
    states = _states(stories.join(ends, "story"), "story", "step", "name")
    return states.groupBy("state").agg(F.collect_set(F.when(F.col("step") == F.col("story_len"), F.col("story"))).alias("stories"))


def story_prefixes(steps: DataFrame, stories: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """``(key, n_steps, followed, stories)``: how many first steps of each conversation some story has as well.

    ``stories`` lists those that end just there. Story prefixes are the states of an automaton; a conversation's steps
    are numbered in chunks and only those up to the longest story's length take part further. Whether a state is a
    story's is decided once for every distinct state, and states that many conversations share are salted. A conversation with
    a null key is one of its own; steps are numbered from 1 in ``stories``.
    """
    longest = stories.agg(F.coalesce(F.max("step"), F.lit(0)).alias("n")).first()["n"]
    steps = steps.select(F.struct(key).alias("__key"), F.col(position).alias("__at"), F.col(name).alias("__name"))
    numbered = number_rows(steps, ["__key"], "__at", "__step", chunk_of(F.col("__at")))
    totals = numbered.groupBy("__key").agg(F.max("__step").alias("n_steps"))
    walked = _states(numbered.where(F.col("__step") <= longest), "__key", "__step", "__name").select("__key", "__step", "state")
    seen = walked.groupBy("state").agg(F.count("*").alias("__n"))
    known = seen.join(story_automaton(stories), "state")
    reached = lookup_join(walked, known, "state", "__n", ["__key"], "inner")
    far = reached.groupBy("__key").agg(F.max("__step").alias("followed"), F.max_by("stories", "__step").alias("stories"))
    return totals.join(far, "__key", "left").select(
        F.col(f"__key.{key}").alias(key), "n_steps", F.coalesce("followed", F.lit(0)).cast("long").alias("followed"),
        F.coalesce("stories", F.array().cast("array<string>")).alias("stories"))


def story_conformance(steps: DataFrame, stories: DataFrame, key: str, position: str, name: str) -> DataFrame:
    """``(key, story)`` for conversations whose steps equal a story's steps, in order and in full."""
    whole = story_prefixes(steps, stories, key, position, name).where(F.col("followed") == F.col("n_steps"))
    return whole.select(key, F.explode("stories").alias("story"))


def fallback_rule(candidates: DataFrame, keys: list[str], name: str, confidence: str) -> DataFrame:
    """Best intent of each message and whether to fall back: too unsure, or too close to the second."""
    w = Window.partitionBy(*keys).orderBy(F.desc(confidence), F.asc(name))
    top = candidates.withColumn("__rank", F.row_number().over(w)).where("__rank <= 2")
    at = lambda rank, column: F.max(F.when(F.col("__rank") == rank, F.col(column)))
    best = top.groupBy(*keys).agg(at(1, name).alias("intent"), at(1, confidence).alias("top1"),
                                  at(2, confidence).alias("top2"))
    unsure = (F.col("top1") < CONFIDENCE_THRESHOLD) | F.coalesce(
        F.col("top1") - F.col("top2") < AMBIGUITY_THRESHOLD, F.lit(False))
    return best.withColumn("fallback", unsure)


def word_counts(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, word, n)`` over white-space separated words."""
    words = F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")
    return df.select(key, F.explode(words).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def char_ngrams(words: DataFrame, key: str, longest: int = MAX_CHAR_NGRAM) -> DataFrame:
    """``(key, gram, n)``: character 1..n-grams inside each space-padded lower-case word.

    ``words`` are counted words, so a repeated word is cut only once. They are written and their grams counted first: grams
    are dealt out by key and gram, ``GRAMS_A_TASK`` to a task on average, and combined only there, so that no task holds
    more than that in its table, however large the input or its parts.
    """
    words = materialize(words, "words")
    padded = F.concat(F.lit(" "), F.lower("word"), F.lit(" "))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.least(F.lit(longest), F.length(padded))),
        lambda n: F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1),
                              lambda i: F.substr(padded, i, n))))
    long = F.length(padded)
    total = words.agg(F.sum(F.aggregate(F.sequence(F.lit(1), F.least(F.lit(longest), long)), F.lit(0).cast("long"),
                                        lambda a, n: a + long - n + 1)).alias("n")).first()["n"] or 0
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // GRAMS_A_TASK))
    return (words.select(key, F.col("n").alias("c"), F.explode(grams).alias("gram"))
            .repartition(parts, key, "gram").groupBy(key, "gram").agg(F.sum("c").alias("n")))


def answer_rate(turns: DataFrame, is_code: Column, failed: Column) -> DataFrame:
    """Per conversation the share of answers with code and of answers that could not be translated."""
    return turns.where("role = 'assistant'").groupBy("conv_id").agg(
        F.count("*").alias("n_answers"), F.avg(is_code.cast("int")).alias("code_rate"),
        F.avg(failed.cast("int")).alias("failure_rate"))


def strip_query_comment(code: Column) -> Column:
    """Code without the leading comment line that repeats the query; line breaks may be escaped."""
    return F.regexp_replace(code, r"^\s*#[^\n]*?(?:\n|\\n\s?|$)", "")


def sessions(events: DataFrame, user: str, time: str, minutes: int = SESSION_MINUTES) -> DataFrame:
    """Add the 1-based ``session`` of every event; more than ``minutes`` without activity start a new one.

    Users may have any number of events, in an hour as well: they are worked off in chunks of a bounded number of events,
    with one summary row per chunk.
    """
    ends = lambda prev, cur: prev.isNull() | (cur[time] > prev[time] + F.expr(f"interval {minutes} minutes"))
    placed = bounded_chunks(events, [user], [time], "__piece")
    return islands(placed, [user], time, [time], ends, "session", chunk=F.col("__piece")).drop("__piece")


def session_summary(numbered: DataFrame, user: str, time: str) -> DataFrame:
    return numbered.groupBy(user, "session").agg(F.min(time).alias("started"), F.max(time).alias("ended"),
                                                 F.count("*").alias("n_events"))
