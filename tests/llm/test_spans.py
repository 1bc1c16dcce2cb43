"""Spans that share half of their hash are told apart by the whole of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from nlcorpus.llm import spans


def test_halves_that_collide(spark, monkeypatch):
    lines = [f"w{i} " + " ".join(f"x{i}-{j}" for j in range(5)) + ".\n" for i in range(12)]
    texts = [(1, "".join(lines[:5])), (2, "".join(lines[5:9])), (3, "".join(lines[1:4] + lines[9:])), (4, None), (5, ""),
             (None, "".join(lines[5:9]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()}
    assert found[3]["n_removed"] == 3 and found[None]["n_removed"] == 4
    assert [found[i]["n_removed"] for i in (1, 2, 4, 5)] == [0] * 4 and found[4]["text"] is None
    own = spans.spans
    monkeypatch.setattr(spans, "spans", lambda *a: own(*a).withColumn("h1", F.col("h1") * 0))
    assert {r["doc_id"]: r for r in spans.remove_repeats(docs).collect()} == found
