"""The bound of the latent retrieval against a plain count, and a benchmark searched in parts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from nlcorpus.llm import semantic

FOLDER = "/root/testdata/sf0.001"


def invented(seed: int) -> tuple[semantic.Items, list[np.ndarray]]:
    """Items of 3 to 40 words, and texts of 0 to 300 with stretches of items in them."""
    random.seed(seed)
    words = [np.array([min(random.randrange(60), random.randrange(60)) for _ in range(random.randrange(3, 40))]) for _ in range(12)]
    items = semantic.Items(list(range(12)), words, [max(0, len(w) - 3) for w in words], {str(i): i for i in range(60)})
    rows = []
    for _ in range(30):
        row = [random.randrange(-40, 60) for _ in range(random.randrange(300))]
        row = [max(-1, w) for w in row]
        for w in random.sample(words, random.randrange(3)):
            at = random.randrange(len(row) + 1)
            row[at:at] = [x for x in w.tolist() if random.random() < 0.8]
        rows.append(np.array(row, np.int64))
    return items, rows


@pytest.mark.parametrize("pairs", [10**6, 40])
def test_bound_loses_no_leak(monkeypatch, pairs):
    monkeypatch.setattr(semantic, "PAIR_ROWS", pairs)
    for seed in range(20):
        items, rows = invented(seed)
        idf = np.random.default_rng(seed).random(60)
        screen, layout = semantic.Screen.over(items, idf), semantic.Layout(rows)
        assert (screen.least >= 1).all()
        found = [(r, b - layout.first[r], i) for part in semantic.near_pairs(layout, screen) for r, b, i in zip(*part)]
        assert len(found) == len(set(found))
        want, leaks = set(), set()
        for r, row in enumerate(rows):
            for p in range(max(1, -(-len(row) // semantic.BLOCK) - 1)):
                for i, (pattern, answer) in enumerate(zip(items.words, items.answers)):
                    rare = set((screen.keys[screen.keys % 12 == i] // 12).tolist())
                    window = row[max(0, p * 24 - len(pattern)):(p + 2) * 24 + len(pattern)]
                    if sum(w in rare for w in window.tolist()) >= screen.least[i]:
                        want.add((r, p, i))
                    if len(window) and semantic.judge(pattern, answer, window)[2]:
                        leaks.add((r, p, i))
        assert set(found) == want and leaks and leaks <= want


def test_cosines_of_some_passages():
    items, rows = invented(3)
    layout, rng = semantic.Layout(rows), np.random.default_rng(3)
    words, targets = rng.standard_normal((60, 5)).astype(np.float32), rng.standard_normal((12, 5)).astype(np.float32)
    pairs = [(r, p) for r, row in enumerate(rows) for p in range(max(1, -(-len(row) // 24) - 1)) if (r + p) % 3]
    blocks = np.array([layout.first[r] + p for r, p in pairs])
    got = semantic.cosines(layout, blocks, np.arange(len(pairs)) % 12, words, targets)
    for i, (r, p) in enumerate(pairs):
        inside = rows[r][p * 24:(p + 2) * 24]
        vector = words[inside[inside >= 0]].sum(axis=0) if (inside >= 0).any() else np.zeros(5)
        assert got[i] == pytest.approx(float(vector @ targets[i % 12]) / max(float(np.linalg.norm(vector)), 1e-9), abs=1e-4)


def test_products_take_in_every_passage(spark, monkeypatch):
    """A' A B of the tasks against plain matrices, with passages cut into many groups."""
    monkeypatch.setattr(semantic, "FIT_CELLS", 50)
    monkeypatch.setattr(semantic, "FIT_PASSAGES", 3)
    items, rows = invented(5)
    rng = np.random.default_rng(5)
    idf, basis = rng.random(60) + 0.5, rng.standard_normal((60, 7))
    table = spark.createDataFrame([(r.astype("<i4").tobytes(),) for r in rows], "words binary").repartition(3)
    want = np.zeros((60, 7))
    for row in rows:
        for p in range(max(1, -(-len(row) // 24) - 1)):
            inside = row[p * 24:(p + 2) * 24]
            vector = np.zeros(60)
            place, counts = np.unique(inside[inside >= 0], return_counts=True)
            vector[place] = (1 + np.log(counts)) * idf[place]
            vector /= max(np.linalg.norm(vector), 1e-12)
            want += np.outer(vector, vector @ basis)
    assert np.allclose(semantic.gram_product(table, idf, basis), want, atol=1e-3)


def test_benchmark_in_parts(spark):
    """Several passes over parts of the benchmark find what one pass finds, whole items in any case."""
    docs, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "benchmark"))
    size = sum(len(r["text"] or "") for r in bench.collect())
    assert len(semantic.benchmark_parts(bench, "text", size // 3)) >= 3
    one = {(r["doc_id"], r["item_id"]): r["words_in_order"] for r in semantic.leaks(docs, bench).collect()}
    many = {(r["doc_id"], r["item_id"]): r["words_in_order"] for r in semantic.leaks(docs, bench, part_chars=size // 3).collect()}
    assert one and {k for k, v in one.items() if v == 1.0} == {k for k, v in many.items() if v == 1.0}
    both = set(one) & set(many)
    assert len(both) >= 0.9 * len(set(one) | set(many))
    none = bench.where("item_id is null and item_id is not null")
    assert semantic.leaks(docs, none, part_chars=10).count() == 0
