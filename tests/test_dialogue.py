"""Stories as prefix states, against plain comparison of lists."""

import random
from collections import Counter

from nlcorpus.operators import dialogue


def test_story_prefixes(spark):
    rnd = random.Random(6)
    stories = {"s1": ["a", "b", "c"], "s2": ["a", "b"], "s3": ["a", "b", "c"], "s4": ["c", None, "a", "a"], "s5": ["b"]}
    talks = {i: rnd.choices(["a", "b", "c", None], k=rnd.randint(1, 6)) for i in range(300)}
    talks |= {1000 + i: list(s) for i, s in enumerate(stories.values())}
    talks |= {2000 + i: ["a", "b", "c"] for i in range(400)}  # most conversations are in the same states
    talks |= {None: ["c", None, "a", "b"], 5000: ["a", "b", *["c"] * 9000]}  # one has most of all steps
    steps = [(k, i * 2, n, "o") for k, names in talks.items() for i, n in enumerate(names)]
    rnd.shuffle(steps)
    frame = spark.createDataFrame(steps, "k int, at long, n string, step string").repartition(5)
    known = spark.createDataFrame([(s, i, n) for s, names in stories.items() for i, n in enumerate(names, 1)],
                                  "story string, step long, name string")
    got = {r.k: r for r in dialogue.story_prefixes(frame, known, "k", "at", "n").collect()}
    assert set(got) == set(talks)
    for k, names in talks.items():
        followed = max((n for s in stories.values() for n in range(1, len(s) + 1) if n <= len(names) and s[:n] == names[:n]), default=0)
        assert (got[k].n_steps, got[k].followed) == (len(names), followed)
        ends = {s for s, steps in stories.items() if followed and steps == names[:followed]}
        assert set(got[k].stories) == ends
    full = {(r.k, r.story) for r in dialogue.story_conformance(frame, known, "k", "at", "n").collect()}
    assert full == {(k, s) for k, names in talks.items() for s, steps in stories.items() if steps == names}
    assert dialogue.story_conformance(frame, known.limit(0), "k", "at", "n").count() == 0
    assert dialogue.story_prefixes(frame.limit(0), known, "k", "at", "n").count() == 0


def test_grams_are_dealt_out_by_their_number(spark, monkeypatch):
    words = spark.createDataFrame([(k, w, 2) for k in (1, 2, None) for w in ("Ab", "b", "")], "k int, word string, n long")
    monkeypatch.setattr(dialogue, "GRAMS_A_TASK", 2)
    got = dialogue.char_ngrams(words, "k")
    want = Counter(((k, f" {w} "[i:i + n]), 2) for k in (1, 2, None) for w in ("ab", "b", "")
                   for n in range(1, min(4, len(w) + 2) + 1) for i in range(len(w) + 3 - n))
    assert {((r.k, r.gram), r.n) for r in got.collect()} == {(key, 2 * sum(c for (other, _), c in want.items() if other == key))
                                                            for (key, _), _ in want.items()}
    assert got.rdd.getNumPartitions() == -(-sum(want.values()) // 2)
