"""Exact duplicates against plain Python, with runs that need several rounds."""

import hashlib
import random

import numpy as np
import pytest

from nlcorpus.llm import exact


def brute(rows, largest):
    """``(id, keep_id, group_size, digest)`` per row, sorted, and the number of kept rows per text."""
    groups = {}
    for key, text in rows:
        groups.setdefault(text or "", []).append(key)
    pick = max if largest else min
    keeps = {t: pick([k for k in ks if k is not None], default=None) for t, ks in groups.items()}
    return sorted(((k, keeps[t or ""], len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for k, t in rows),
                  key=str)


def found(frame):
    rows = frame.collect()
    kept = {}
    for r in rows:
        kept[r["text_sha256"]] = kept.get(r["text_sha256"], 0) + r["kept"]
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert set(kept.values()) <= {1}  # exactly one row of every text
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows), key=str)


@pytest.mark.parametrize("largest", [False, True])
@pytest.mark.parametrize("bits,records", [(1, 16), (3, 40), (3, 10 ** 6)])
def test_dedup(spark, largest, bits, records):
    random.seed(5)
    rows = [(i, f"text {random.randrange(700)}") for i in range(1500)] + [(i, "hot") for i in range(2000, 2900)]
    rows += [(7, "seven"), (7, "seven"), (None, "seven"), (None, "alone"), (None, "alone"), (-9, None), (2 ** 62, ""), (3, "é")]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(exact.dedup(docs, largest=largest, bits=bits, node_records=records)) == brute(rows, largest)


def test_cases(docs, empty):
    rows = docs.select("doc_id", "text").collect()
    assert found(exact.dedup(docs)) == brute([tuple(r) for r in rows], False)
    assert exact.dedup(empty).count() == 0 and exact.drop_copies(empty).count() == 0
    left = exact.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({r["text"] or "" for r in rows}) and {r["k"] for r in left.where("doc_id = 1").collect()} == {"k"}


def test_narrow_ids(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id int, text string")
    frame = exact.dedup(docs, largest=True)
    assert dict(frame.dtypes)["keep_id"] == "int" and {r["keep_id"] for r in frame.collect()} == {2}


def test_equal_leading_words_are_compared_whole():
    run = np.zeros(4, dtype=exact.RECORD)
    run["digest"] = [[5, 0, 0, 2], [5, 0, 0, 1], [5, 0, 0, 2], [5, 0, 0, 2]]
    run["id"], run["place"], run["named"], run["n"], run["size"] = [4, 3, 2, 9], [0, 1, 2, 3], 1, 1, [1, 1, 1, 2]
    out = exact.merged([run[1:2], run[:1], run[2:3], run[3:]], False)
    assert [(r["digest"][3], r["size"], r["id"], r["n"]) for r in out] == [(1, 1, 3, 1), (2, 1, 2, 2), (2, 2, 9, 1)]
    assert [r["id"] for r in exact.merged([run], True)] == [3, 4, 9]


def test_stretches_cover_a_run_and_narrow():
    random.seed(1)
    digests = sorted(random.getrandbits(64) for _ in range(500))
    run = np.zeros(500, dtype=exact.RECORD)
    run["digest"][:, 0] = digests
    for node, part in list(exact._parts(run, 13, 0, 2)):
        assert node & ~3 == 12
        again = list(exact._parts(part, node, 1, 2))
        assert sum(len(p) for _, p in again) == len(part)
        for target, piece in again:
            assert {(int(d) >> 62, int(d) >> 60 & 3) for d in piece["digest"][:, 0]} == {(target & 3, target >> 2 & 3)}
