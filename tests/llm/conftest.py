import pytest

PROSE = ("The quick brown fox jumps over the lazy dog near the river bank. It was a bright cold day in April, and the "
         "clocks were striking thirteen. Nobody knew why the old man had left his house so early in the morning.\n"
         "Call him at +1 (212) 555-0143 or write to anna.b@post.example.org about the server at 10.20.30.40. ")
OTHER = ("Seven ships sailed west at dawn with silk and salt below their decks. Their captains had sworn never to speak "
         "of what they saw beyond the reef. When only three of them returned, the harbour stayed silent for a week.\n")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, k string, t long, x int, score string"


def cases():
    """Nulls in every column, empty and very long texts, equal texts, a repeated row, columns with clashing names."""
    long_words = " ".join(f"w{i * 7919 % 50_021}" for i in range(60_000))
    texts = {1: PROSE + OTHER, 2: PROSE + OTHER, 3: "", 4: None, 5: " \n\t ", 6: "two words", 7: long_words, 8: "x" * 200_000,
             9: "7" * 50_000, 10: OTHER + PROSE, 11: "!! ?? ..", 12: "▁▁ é　汉字 \U0001F600\x00 a b"}
    rows = [(i, t, "en", "src0", 5, "k", 1, 2, "s") for i, t in texts.items()]
    rows += [(1, PROSE + OTHER, "en", "src0", 5, "k", 1, 2, "s"), (None, OTHER, None, None, None, None, None, None, None),
             (13, OTHER, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
