"""Dialogue transcripts, intent examples and story step lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlcorpus.functions.ordered import chunk_of, fill_forward, number_rows
from nlcorpus.sources.files import read_json, read_lines, require_path

# The transcript columns and their headings in the delimited form.
TRANSCRIPT_FIELDS = {
    "NL Query": "user_query",
    "NL Response": "bot_response_text",
    "Code expected": "bot_response_code_expected",
    "Code generated": "bot_response_code_generated",
}
TRANSCRIPT_SCHEMA = ", ".join(f"{name} string" for name in TRANSCRIPT_FIELDS.values())

# Line forms of the intent and story files.
INTENT_HEADER = r"^- intent:\s*(\S+)\s*$"
EXAMPLE_LINE = r"^\s+- (.*)$"
STORY_HEADER = r"^- (?:story|rule):\s*(.+?)\s*$"
STEP_LINE = r"^\s*- (intent|action):\s*(\S+)\s*$"


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Exchanges from a ``;`` file with headings (``.csv``) or from JSON arrays; absent text is empty."""
    if path.lower().rstrip("/").endswith(".csv"):
        require_path(spark, path)
        headings = ", ".join(f"`{h}` string" for h in TRANSCRIPT_FIELDS)
        rows = spark.read.csv(path, sep=";", header=True, schema=headings)
        rows = rows.select(*[F.col(f"`{h}`").alias(name) for h, name in TRANSCRIPT_FIELDS.items()])
    else:
        rows = read_json(spark, path, TRANSCRIPT_SCHEMA)
    return rows.fillna("")


def _group(text: str, pattern: str, group: int):
    return F.when(F.col(text).rlike(pattern), F.regexp_extract(text, pattern, group))


def _under_headers(spark: SparkSession, path: str, header: str, name: str) -> DataFrame:
    """Lines with the last heading above them in their own file."""
    return fill_forward(read_lines(spark, path, "file"), ["file"], "line_no", _group("value", header, 1), name,
                        chunk_of(F.col("line_no")))


def read_intents(spark: SparkSession, path: str) -> DataFrame:
    """``(intent, line_no, example)`` from a list of intent headings with dashed examples below."""
    rows = _under_headers(spark, path, INTENT_HEADER, "intent")
    return (rows.withColumn("example", _group("value", EXAMPLE_LINE, 1))
            .where(F.col("example").isNotNull() & F.col("intent").isNotNull())
            .select("intent", "line_no", "example"))


def read_stories(spark: SparkSession, path: str) -> DataFrame:
    """``(story, step, kind, name)`` with 1-based steps, from story or rule headings with step lines."""
    rows = _under_headers(spark, path, STORY_HEADER, "story")
    steps = (rows.withColumn("kind", _group("value", STEP_LINE, 1))
             .withColumn("name", _group("value", STEP_LINE, 2))
             .where(F.col("kind").isNotNull() & F.col("story").isNotNull()))
    return (number_rows(steps, ["file", "story"], "line_no", "step", chunk_of(F.col("line_no")))
            .select("story", "step", "kind", "name"))
