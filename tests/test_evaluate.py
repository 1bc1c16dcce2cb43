"""Scores against plain Python on random and hand-made predictions."""

import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nlcorpus.functions import arrays
from nlcorpus.functions.tiered import sliced, stretches
from nlcorpus.operators import decode, errors, evaluate


def plain_bleu(pairs):
    """Corpus score of (reference tokens, candidate tokens) pairs, by the published definition."""
    match, possible = Counter(), Counter()
    for ref, cand in pairs:
        for n in range(1, 5):
            grams = lambda t: Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))
            match[n] += sum((grams(ref) & grams(cand)).values())
            possible[n] += max(len(cand) - n + 1, 0)
    r, c = sum(len(a) for a, _ in pairs), sum(len(b) for _, b in pairs)
    if not c or any(not match[n] for n in range(1, 5)):
        return 0.0
    mean = math.exp(sum(math.log(match[n] / possible[n]) for n in range(1, 5)) / 4)
    return mean * (1.0 if c > r else math.exp(1 - r / c))


def plain_tokens(code):
    code = re.sub(r"([^A-Za-z0-9_])", r" \1 ", code)
    code = re.sub(r"([a-z])([A-Z])", r"\1 \2", code)
    return re.sub(r"\s+", " ", code).replace('"', "`").replace("'", "`").split()


def records(seed, n=40):
    rnd = random.Random(seed)
    text = lambda: " ".join(rnd.choices(["a", "bC", "f(x)", "'q'", "+", "d1"], k=rnd.randint(3, 12)))
    rows = []
    for i in range(n):
        expected = text()
        options = [None, "", expected, expected + " z", text(), text(), expected[:-2]]
        rows.append((i, expected, rnd.choices(options, k=rnd.randint(0, 6))))
    return rows


def test_bleu_and_exact_match(spark):
    rows = records(5)
    df = spark.createDataFrame(rows, "id int, expected string, predicted array<string>")
    report = evaluate.eval_report(*evaluate.split_records(df)).first().asDict()
    for k in evaluate.BLEU_CUTS:
        chosen = []
        for _, expected, predicted in rows:
            ref = plain_tokens(expected)
            cands = [plain_tokens(p) for p in predicted if p][:k] or [[""]]
            chosen.append((ref, max(cands, key=lambda c: round(plain_bleu([(ref, c)]), 12))))
        assert report[f"bleu_{k}"] == pytest.approx(plain_bleu(chosen), abs=1e-9)
    for k in evaluate.EM_CUTS:
        assert report[f"em_{k}"] == pytest.approx(sum(e in p[:k] for _, e, p in rows) / len(rows))
    assert report["num_invalid_predictions"] == sum(p is None for _, _, ps in rows for p in ps)
    assert report["num_valid_predictions"] == sum(p is not None for _, _, ps in rows for p in ps)


def test_input_with_a_third_of_all_candidates(spark):
    """One input has as many candidates as all others; its hits lie far beyond the first chunk."""
    rnd = random.Random(12)
    texts = ["a b", "f(x) y z", "fooBar + 1 2", None, ""]
    inputs = [(i, f"f(x) y z w{i}") for i in range(300)]
    rows = [(i, r, inputs[i][1] if r == 9 and i % 3 == 0 else rnd.choice(texts)) for i in range(1, 300) for r in range(1, 31)]
    rows += [(0, r, inputs[0][1] if r == 4500 else "" if r <= 4200 else rnd.choice(texts)) for r in range(1, 5001)]
    rnd.shuffle(rows)
    tables = (spark.createDataFrame(inputs, "id int, expected string"),
              spark.createDataFrame(rows, "id int, rank long, predicted string").repartition(5))
    by_input = {i: [p for _, _, p in sorted((r for r in rows if r[0] == i), key=lambda r: r[1])] for i, _ in inputs}
    assert {r.id: r.hit for r in evaluate.first_hits(*tables).collect()} == {
        i: by_input[i].index(e) + 1 for i, e in inputs if e in by_input[i]}
    em = evaluate.exact_match(*tables, cuts=(8, 9, 5000)).first()
    assert [em.em_8, em.em_9, em.em_5000] == pytest.approx([0, 99 / 300, 100 / 300])
    places = {(r.id, r["rank"]): r["place"] for r in evaluate.valid_candidates(tables[1]).collect()}
    for i, texts in by_input.items():
        assert [places[i, r + 1] for r, p in enumerate(texts) if p] == list(range(sum(bool(p) for p in texts)))
    report = evaluate.eval_report(*tables).first()
    chosen = []
    for i, expected in inputs:
        ref, cands = plain_tokens(expected), [plain_tokens(p) for p in by_input[i] if p][:20] or [[""]]
        chosen.append((ref, max(cands, key=lambda c: round(plain_bleu([(ref, c)]), 12))))
    assert report.bleu_20 == pytest.approx(plain_bleu(chosen), abs=1e-9)
    assert report.num_invalid_predictions == sum(p is None for _, _, p in rows)


def test_all_candidates_are_ranked_in_chunks(spark):
    rnd = random.Random(3)
    rows = [("hot" if t % 2 else f"k{t % 7}", t, rnd.choice([0.5, 0.25, None, 1.0])) for t in range(11_000)]
    df = spark.createDataFrame(rows, "i string, t int, s double").repartition(6)
    got = decode.rank_candidates(df, ["i"], "s", "t", None).collect()
    for key in {r[0] for r in rows}:
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (r[2] is not None, r[2] or 0, r[1]))
        assert [r.t for r in sorted((r for r in got if r.i == key), key=lambda r: r["rank"])] == [r[1] for r in order]
    assert sorted(r["rank"] for r in got if r.i == "hot") == list(range(1, 5501))


def test_no_predictions_at_all(spark):
    df = spark.createDataFrame([(1, "a b c d e", []), (2, "x", [None, None])],
                               "id int, expected string, predicted array<string>")
    report = evaluate.eval_report(*evaluate.split_records(df)).first()
    assert report.em_10 == 0 and report.bleu_20 == 0
    assert (report.num_valid_predictions, report.num_invalid_predictions) == (0, 2)


def test_tokenize_code(spark):
    texts = ["fooBar(x, 'y')", "a b\tc\nd", "", "é+\"z\"", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(evaluate.tokenize_code(F.col("t"))).collect()]
    assert got == [None if t is None else plain_tokens(t) for t in texts]


def test_prefix_collapse_pad_and_paths(spark):
    rnd = random.Random(2)
    rows = [(rnd.choices(range(9), k=rnd.randint(0, 8)), rnd.choices(range(9), k=rnd.randint(0, 8))) for _ in range(60)]
    rows += [([1, 2, 3], [1, 2, 3]), ([1, 2], [1, 2, 3]), ([], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = df.select(arrays.common_prefix_length(F.col("a"), F.col("b")).alias("p"),
                    arrays.collapse_above(F.col("a"), 5).alias("c"), arrays.pad(F.col("a"), 3, F.lit(0)).alias("w"),
                    arrays.fixed_path(F.col("a"), 2, 4).alias("f")).collect()
    for (a, b), r in zip(rows, got):
        assert r.p == len(commonprefix([a, b]))
        short = []
        for x in [min(x, 6) for x in a]:
            if not (x == 6 and short and short[-1] == 6):
                short.append(x)
        assert r.c == short
        assert r.w == (a + [0, 0, 0])[:3]
        assert r.f == ([x + (len(a) - 1 - i) * 2 for i, x in enumerate(a)] + [0] * 4)[:4]
    one = spark.createDataFrame([([1, 7, 8, 6, 2, 9, 9, 5], [3, 1, 1])], "a array<int>, b array<int>").select(
        arrays.collapse_above(F.col("a"), 5), arrays.fixed_path(F.col("b"), 2, 4)).first()
    assert one[0] == [1, 6, 2, 6, 5] and one[1] == [7, 3, 1, 0]


def diff_rows():
    rnd = random.Random(8)
    word = lambda: rnd.choice(["a", "b", "c", "longer", "literal"])
    rows = [(i, [word() for _ in range(rnd.randint(0, 12))], [word() for _ in range(rnd.randint(0, 12))])
            for i in range(40)]
    many = ["x"] * 150 + [f"w{i}" for i in range(120)]  # long enough for frequent tokens to be skipped as anchors
    return rows + [(99, many, ["y"] + many[50:])]


def kind(w):
    return "strliteral" if len(w) >= 6 else "node"


def test_diff_and_type_ratios(spark):
    rows = [(i, a, b, [kind(w) for w in a], [kind(w) for w in b]) for i, a, b in diff_rows()]
    df = spark.createDataFrame(rows, "id int, expected array<string>, predicted array<string>, "
                                     "expected_kinds array<string>, predicted_kinds array<string>")
    codes = errors.sequence_diff(df)
    got = codes.collect()
    totals = Counter()
    for i, a, b, _, _ in rows:
        mine = sorted((r for r in got if r.id == i), key=lambda r: (r.pos_exp_i1, r.pos_pred_j1))
        assert [(r.tag, r.pos_exp_i1, r.pos_exp_i2, r.pos_pred_j1, r.pos_pred_j2) for r in mine] == \
            SequenceMatcher(None, a, b).get_opcodes()
        rebuilt = [w for r in mine for w in (r.val_exp if r.tag == "equal" else r.val_pred)]
        assert rebuilt == b
        for r in mine:
            assert r.type_exp == [kind(w) for w in r.val_exp]
            if r.tag == "equal":
                totals.update(("equal", kind(w)) for w in r.val_pred)
        totals.update(("expected", kind(w)) for w in a)
        totals.update(("predicted", kind(w)) for w in b)
    counts = errors.diff_type_counts(df, codes)
    ratios = {r.kind: (r.precision, r.recall) for r in errors.type_precision_recall(counts).collect()}
    for k in ("node", "strliteral"):
        assert ratios[k][0] == pytest.approx(totals["equal", k] / totals["predicted", k])
        assert ratios[k][1] == pytest.approx(totals["equal", k] / totals["expected", k])
    per_row = {(r.id, r.kind): r.precision for r in errors.type_precision_recall(counts, "id").collect()}
    for i, a, b, _, _ in rows:
        for k in {kind(w) for w in a} - {kind(w) for w in b}:
            assert per_row[i, k] is None  # nothing of this kind was predicted


def test_prefix_scores_with_empty_prediction(spark):
    df = spark.createDataFrame([(1, [1, 2, 9], []), (2, [1, 9, 9], [1, 9])], "id int, e array<int>, p array<int>")
    scores = errors.prefix_scores(df, "e", "p", 5)
    assert errors.sequence_precision(scores).first().value == pytest.approx(100)
    assert errors.sequence_recall(scores).first().value == pytest.approx((0 + 200 / 3) / 2)
    assert errors.prefix_exact_match(scores).first().replaced_value == pytest.approx(50)
    empty = scores.where("id = 1")
    assert errors.brevity_penalty(empty).first().brevity_penalty == 0
    assert errors.token_precision(empty).first().value is None


def test_describe_matches_pandas(spark):
    rnd = random.Random(4)
    values = [rnd.choice([1.5, 2.0, rnd.random() * 10]) for _ in range(301)]
    df = spark.createDataFrame([(v,) for v in values], "d double").repartition(7)
    got, exact = errors.describe_scores(df, "d").first(), pd.Series(values).describe()
    for name, key in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                      ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert got[name] == pytest.approx(exact[key])


def test_merge_literal_runs(spark):
    rows = [(1, i, t, kind(t)) for i, t in enumerate(["a", "longer", "literal", "b", "letters", "xxxxxx"])]
    got = errors.merge_literal_runs(spark.createDataFrame(rows, "id int, pos int, token string, kind string"))
    assert [r.token for r in got.orderBy("run").collect()] == ["a", "longerliteral", "b", "lettersxxxxxx"]


def test_rank_candidates_validity(spark):
    rows = [(1, 1, 0.5, "x"), (1, 2, 0.5, ""), (1, 3, 0.1, None), (1, 4, 0.9, "y"), (2, 5, 0.0, "")]
    df = spark.createDataFrame(rows, "i int, t int, s double, code string")
    ids = lambda out: sorted((r.i, r["rank"], r.t) for r in out.collect())
    assert ids(decode.rank_candidates(df, ["i"], "s", "t", 2, text="code")) == [(1, 1, 1), (1, 2, 4)]
    assert ids(decode.rank_candidates(df, ["i"], "s", "t", 2, F.col("code").isNotNull())) == [
        (1, 1, 1), (1, 2, 2), (2, 1, 5)]
    assert ids(decode.rank_candidates(df, ["i"], "s", "t", 1, text="code", keep_invalid=True)) == [(1, 1, 3), (2, 1, 5)]


def test_runs_inside_a_row_equal_runs_of_rows(spark):
    words = ["a", "longer", "literal", "b", "", "letters", "xxxxxx", "letters", "c"]
    records = [(1, words), (2, words[1:3]), (3, [""]), (4, [])]
    df = spark.createDataFrame([(i, w, [kind(x) for x in w]) for i, w in records], "id int, w array<string>, k array<string>")
    inside = df.select("id", F.inline(errors.merged_runs(F.col("w"), F.col("k"))))
    tokens = df.select("id", F.posexplode(F.arrays_zip("w", "k")).alias("pos", "x")).select(
        "id", "pos", F.col("x.w").alias("token"), F.col("x.k").alias("kind"))
    rows = errors.merge_literal_runs(tokens).select("id", "run", "token", "kind")
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, rows.collect()))


def test_diff_takes_bounded_slices():
    import pyarrow as pa

    lists = pa.array([["a"] * n for n in (3, 0, 5, 1, 1)] + [None])
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), lists, lists], ["id", "e", "p"])
    pieces = [p.column(0).to_pylist() for p in sliced(batch, (1, 2), 6)]
    assert pieces == [[0, 1], [2], [3, 4, 5]]
    flat = pa.array(list("abcdef"))
    assert stretches(flat, np.array([0, 2, 6]), np.array([2, 2, 6])).to_pylist() == [["a", "b"], [], []]
