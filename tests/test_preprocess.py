"""The preparation plan end to end on a few pairs."""

from pyspark.sql import functions as F

from nlcorpus.operators import profile
from nlcorpus.plans import preprocess

PAIRS = [(1, "call f with text", "f('ab')"), (2, "call f with one", "f(1)"), (3, "broken", "f("),
         (4, "call f with text", "f('ab')"), (5, "empty text", "f('')"), (6, None, "f(1)")]


def test_prepare(spark):
    pairs = spark.createDataFrame(PAIRS, "id int, intent string, snippet string")
    ready = preprocess.prepare(pairs, vocab_size=40)
    train = {r.id: r for r in ready.train.collect()}
    assert sorted(train) == [1, 2, 4, 5]
    source = {r.id: r.piece for r in ready.vocabularies.source.collect()}
    target = {r.id: r.piece for r in ready.vocabularies.target.collect()}
    size = ready.vocabularies.target_size
    for r in train.values():
        assert "".join(source[i] for i in r.nl_enc[1:-1]).replace("▁", " ").strip() == dict(
            (i, t) for i, t, _ in PAIRS)[r.id]
        assert len(r.nl_char_enc) == len(r.nl_enc)
        assert len(r.ast_seq_enc) == len(r.edge_order_seq) == len(r.allowed_tokens)
        assert r.ast_seq_enc[0] == 2 and r.ast_seq_enc[-1] == 3
    text = [source[i - size] for i in train[1].ast_seq_enc if i >= size]
    assert "".join(text).replace("▁", "") == "fab"
    assert [i for i in train[5].ast_seq_enc if i == size] == [size]  # the empty string
    assert [target[i] for i in train[2].ast_seq_enc if i < size][1:3] == ["Module", "Expr"]
    allowed = {(r.field, r.in_text, r.allowed) for r in ready.allowed.collect()}
    for r in train.values():
        for step, following in zip(r.allowed_tokens, r.ast_seq_enc[1:]):
            assert (step.field, step.in_text, following) in allowed
    stats = profile.record_stats(ready.stats.select("id", F.inline("edge_counts"))).collect()
    assert len(stats) == 4 and all(s.node_histogram["Call"] == 1 for s in stats)
    again = preprocess.prepare(pairs, ready.vocabularies, eliminate_duplicates=True)
    assert sorted(r.id for r in again.train.collect()) == [1, 2, 5]
    test = preprocess.prepare_test(pairs, ready.vocabularies)
    assert test.count() == 6 and set(test.columns) == {"nl_enc", "nl_char_enc", "snippet", "id", "nl", "ast_seq_list"}


def test_repeated_and_missing_ids(spark):
    pairs = spark.createDataFrame([("10_1", "call f with text", "f('ab')"), ("2_1", "call f with one", "f(1)"),
                                   ("10_1", "call g with one", "g(1, 2)"), ("2_1", "call f with text", "f('ab')")],
                                  "id string, intent string, snippet string").coalesce(1)
    ready = preprocess.prepare(pairs, vocab_size=40)
    train = ready.train.collect()
    assert sorted(r.id for r in train) == ["10_1", "10_1", "2_1", "2_1"]
    assert all(len(r.ast_seq_enc) == len(r.edge_order_seq) == len(r.allowed_tokens) for r in train)
    once = preprocess.prepare(pairs, ready.vocabularies, eliminate_duplicates=True).train.collect()
    assert sorted(r.id for r in once) == ["10_1", "10_1", "2_1"]  # the first in file stays, not the smallest id
    plain = preprocess.prepare(pairs.drop("id"), ready.vocabularies).train.collect()
    assert sorted(r.id for r in plain) == [0, 1, 2, 3]


def test_unit_options(spark):
    pairs = spark.createDataFrame([(1, "call f 12 times", "f('a 1')"), (2, "call g 21 times", "g(1)")],
                                  "id int, intent string, snippet string")
    ready = preprocess.prepare(pairs, vocab_size=45, units={"split_digits": True, "add_dummy_prefix": False})
    source = {r.id: r.piece for r in ready.vocabularies.source.collect()}
    texts = {r.id: [source[i] for i in r.nl_enc[1:-1]] for r in ready.train.collect()}
    assert "".join(texts[1]) == "call▁f▁12▁times" and "12" not in texts[1] and "1" in texts[1]


def test_pairs_are_dealt_out_for_parsing(spark, monkeypatch):
    monkeypatch.setattr(preprocess, "PARSED_ROWS", 10)
    pairs = spark.createDataFrame([(i, f"set {i}", f"x = {i}") for i in range(95)], "id int, nl string, snippet string").coalesce(1)
    dealt = preprocess.numbered(pairs)
    sizes = [len(p) for p in dealt.select("rec").rdd.glom().collect()]
    assert len(sizes) == 10 and max(sizes) < 30 and sum(sizes) == 95
    assert [r.id for r in dealt.orderBy("rec").collect()] == list(range(95))
