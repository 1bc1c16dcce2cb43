"""Codebooks against plain integer arithmetic with full rescans."""

import math
import random

import numpy as np
import pytest

from nlcorpus.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, code string, __label string"


def brute(vectors, parts, entries, rounds, scale=256):
    """Codes, errors and codebooks of ``(id, ints)`` rows in order of id."""
    width = len(vectors[0]) // parts
    cut = [[tuple(v[p * width:(p + 1) * width]) for v in vectors] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def near(piece, book):
        return min((sum((a - b) ** 2 for a, b in zip(piece, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [near(piece, books[p])[1] for piece in cut[p]]
            for e in range(len(books[p])):
                own = [piece for piece, m in zip(cut[p], mine) if m == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own))
    last = [[near(piece, books[p]) for piece in cut[p]] for p in range(parts)]
    codes = ["".join(f"{last[p][i][1]:02x}" for p in range(parts)) for i in range(len(vectors))]
    return codes, [sum(last[p][i][0] for p in range(parts)) for i in range(len(vectors))], books


@pytest.mark.parametrize("rounds", [0, 1, 2, 5])
def test_fit(spark, rounds):
    random.seed(rounds)
    rows = [(i * 3 - 100, [random.choice([-0.5, -0.25, 0.0, 0.2, 0.7]) for _ in range(8)], random.choice([0, 1, 2, None]), "x", "y")
            for i in range(300)]  # few values: many ties
    random.shuffle(rows)
    trained = codebooks.fit(spark.createDataFrame(rows, SCHEMA).repartition(4), parts=4, entries=16, rounds=rounds)
    floats = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    ordered = sorted(rows)
    codes, errors, books = brute([floats(r[1]) for r in ordered], 4, 16, rounds)
    assert trained.codebooks.tolist() == [[list(e) for e in b] for b in books]
    found = {r["vec_id"]: r for r in codebooks.with_errors(trained).collect()}
    by_label = {}
    for row, e in zip(ordered, errors):
        by_label[row[2]] = by_label.get(row[2], 0) + e
    for row, code, e in zip(ordered, codes, errors):
        assert (found[row[0]]["code"], found[row[0]]["error"], found[row[0]]["label_error"]) == (code, e, by_label[row[2]])
    back = codebooks.decode(trained.coded, trained.codebooks).where("vec_id = -100").first()
    entry = [x for p in range(4) for x in books[p][int(codes[0][2 * p:2 * p + 2], 16)]]
    assert back["approximation"] == [(x + 0.5) / 256 for x in entry]


def test_active_entries_give_what_a_rescan_gives():
    rng = np.random.default_rng(2)
    x = rng.integers(-4, 5, (400, 8)).astype(np.float64)
    books = rng.integers(-4, 5, (4, 12, 2))
    codes, distances = codebooks.assign(x, books, None, None, None)
    for _ in range(6):
        new = books.copy()
        chosen = rng.random((4, 12)) < 0.3
        new[chosen] = rng.integers(-4, 5, (int(chosen.sum()), 2))
        moved = (new != books).any(axis=2)
        active = codebooks.assign(x, new, codes, distances, moved)
        full = codebooks.assign(x, new, None, None, None)
        assert np.array_equal(active[0], full[0]) and np.array_equal(active[1], full[1])
        books, (codes, distances) = new, active


def test_cases(spark):
    good = [0.5, -0.5, 0.0, 0.25]
    rows = [(1, good, 1), (2, None, 1), (3, [], 1), (4, [0.5, None, 0.0, 0.0], 1), (5, [float("nan"), 0.0, 0.0, 0.0], 1),
            (6, [float("inf"), 0.0, 0.0, 0.0], 1), (7, good[:2], 1), (8, good[:3], 1), (1, good, 1), (None, good, None),
            (9, [3e38, -3e38, 0.0, 0.0], None)]
    frame = spark.createDataFrame([(*r, "c", "l") for r in rows], SCHEMA)
    trained = codebooks.fit(frame, parts=2, entries=3)
    out = codebooks.with_errors(trained).collect()
    assert sorted(str(r["vec_id"]) for r in out) == ["1", "1", "9", "None"]
    assert all(r["error"] == 0 == r["label_error"] for r in out)  # three distinct rows, ids 1, 1 and 9, are the entries
    assert {r["code"] for r in out} == {"0000", "0202"} or {r["code"] for r in out} == {"0000", "0201"}
    nothing = codebooks.fit(frame.where("vec_id = 2"), parts=2)
    assert codebooks.with_errors(nothing).count() == 0 and len(nothing.sha256()) == 64
    assert codebooks.with_errors(codebooks.fit(frame.limit(0))).count() == 0
    without = codebooks.fit(frame, label=None, parts=2)
    assert {r["label_error"] for r in codebooks.with_errors(without).collect()} == {0}
    with pytest.raises(ValueError):
        codebooks.fit(frame, entries=257)


def test_sums_beyond_a_long(spark):
    rows = [(i, [6e4 * (1 if i % 2 else -1)] * 8, 0, "c", "l") for i in range(200)]
    trained = codebooks.fit(spark.createDataFrame(rows, SCHEMA), parts=2, entries=1, rounds=1)
    out = codebooks.with_errors(trained).collect()
    assert len(out) == 200 and all(0 < r["error"] <= r["label_error"] <= 2 ** 63 - 1 for r in out)
