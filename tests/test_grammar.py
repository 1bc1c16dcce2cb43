"""Interned child sets and what they allow, against plain Python sets."""

import random

import pytest
from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.operators import decode, grammar

TEXT = lambda c: c.endswith("#strliteral")


def edges_of(seed):
    rnd = random.Random(seed)
    words = ["Name", "Call", "None#literal", *[f"w{i}#strliteral" for i in range(12)]]
    rows = [(f"p{i}", c) for i in range(20) for c in rnd.sample(words, rnd.randint(1, 3))]
    rows += [("wide", f"v{i}#strliteral") for i in range(2000)]  # a field with as many children as there are literals
    rows += [("same1", "Name"), ("same1", "Call"), ("same2", "Call"), ("same2", "Name"), ("same2", "Name"), (None, "x"), ("y", None)]
    return rows


def plain_rule(rows, fields, list_end):
    """What every parent allows, by definition."""
    sets = {}
    for parent, child in rows:
        if parent is not None and child is not None:
            sets.setdefault(parent, set()).add(child)
    texts = {c for s in sets.values() for c in s if TEXT(c)}
    return {p: s | (texts if p in fields else set()) | ({syntax.LIST_END} if list_end else set()) for p, s in sets.items()}


@pytest.mark.parametrize("list_end", [False, True])
@pytest.mark.parametrize("fields", [None, {"p1", "p2", "p3", "wide", "same1"}])
def test_sets_and_membership(spark, fields, list_end):
    rows = edges_of(1)
    edges = spark.createDataFrame(rows, "parent string, child string").repartition(4)
    flagged = fields and spark.createDataFrame([(f,) for f in fields] + [("unknown",)], "parent string")
    sets = grammar.intern_sets(edges, list_end, flagged, F.col("child").endswith("#strliteral") if fields else None)
    want = plain_rule(rows, fields or set(), list_end)
    members = {}
    for r in sets.members.collect():
        assert r.child not in members.setdefault(r.set_id, set())
        members[r.set_id].add(r.child)
    literals = {r.child for r in sets.literals.collect()}
    parents = {r.parent: r for r in sets.parents.collect()}
    assert set(parents) == set(want)
    for parent, r in parents.items():
        assert members.get(r.set_id, set()) | (literals if r.any_text else set()) == want[parent]
    stored = [frozenset(s) for s in members.values()]
    assert len(stored) == len(set(stored))  # equal sets are there once
    assert parents["same1"].set_id == parents["same2"].set_id
    if fields:
        assert sum(map(len, stored)) < 200  # the wide field's texts are not in any set
    asked = [(i, p, c, bool(i % 2)) for i, (p, c) in enumerate(
        (p, c) for p in [*want, "unknown", None] for c in ["Name", "Call", "None#literal", syntax.LIST_END, "w3#strliteral",
                                                          "v7#strliteral", "new#strliteral", None])]
    asked += [(10_000 + i, "wide", "v1#strliteral", False) for i in range(3000)]  # a hot pair
    frame = spark.createDataFrame(asked, "i int, f string, t string, run boolean").repartition(5)
    got = {r.i: r.allowed for r in grammar.allowed(frame, sets, "f", "t", ["i"], in_text="run").collect()}
    assert got == {i: t in want.get(f, set()) and not (run and t == "None#literal") for i, f, t, run in asked}
    bad = grammar.nonconforming(frame.selectExpr("i", "f AS parent", "t AS child", "i AS pos"), sets, "i")
    assert {r.i for r in bad.collect()} == {i for i, f, t, _ in asked if t not in want.get(f, set())}


def test_positions_carry_the_name_of_the_set(spark):
    edges = spark.createDataFrame(edges_of(2), "parent string, child string")
    sets = grammar.intern_sets(edges)
    steps = spark.createDataFrame([(i, "wide" if i % 3 else "nowhere") for i in range(3000)], "i int, open_parent string")
    out = grammar.allowed_children(steps, sets, ["i"])
    assert set(out.columns) == {"open_parent", "i", "set_id", "any_text"}
    assert {(r.open_parent, r.set_id) for r in out.collect()} == {("wide", "wide"), ("nowhere", None)} and out.count() == 3000


def test_positions_carry_the_members_of_the_set(spark):
    edges = spark.createDataFrame([("f", "b"), ("f", "a"), ("f", "b"), ("g", "a"), ("g", "b"), ("h", "c")], "parent string, child string")
    steps = spark.createDataFrame([(1, "f"), (2, "g"), (3, "h"), (4, "nowhere"), (5, None)], "i int, open_parent string")
    out = grammar.allowed_children(steps, grammar.intern_sets(edges, list_end=True), ["i"], spelled=True)
    assert {r.i: r.allowed for r in out.collect()} == {1: "</l> a b", 2: "</l> a b", 3: "</l> c", 4: None, 5: None}


def test_masking_with_and_without_the_rule(spark):
    edges = spark.createDataFrame([("f", "Name"), ("f", "a#strliteral"), ("g", "b#strliteral"), ("g", "None#literal")],
                                  "parent string, child string")
    rows = [(1, n, "g", t, s, run) for n, (t, s, run) in enumerate([("a#strliteral", 0.1, True), ("b#strliteral", 0.2, True),
                                                                     ("None#literal", 0.0, True), ("Name", 0.05, True)])]
    frame = spark.createDataFrame(rows, "i int, n int, f string, t string, s double, run boolean")
    picked = lambda sets, **more: [r.t for r in sorted(
        decode.mask_candidates(frame, sets, "f", "t", ["i"], "s", "n", 2, **more).collect(), key=lambda r: r["rank"])]
    assert picked(grammar.intern_sets(edges)) == ["None#literal", "b#strliteral"]
    rule = grammar.intern_sets(edges, text_fields=edges, is_text=F.col("child").endswith("#strliteral"))
    assert picked(rule) == ["None#literal", "a#strliteral"] and picked(rule, in_text="run") == ["a#strliteral", "b#strliteral"]
    none = grammar.intern_sets(edges.limit(0))
    assert none.parents.count() == 0 and picked(none) == []


def test_sieve_passes_all_that_is_allowed(spark):
    edges = spark.createDataFrame([(f"p{i % 40}", f"c{i}") for i in range(400)] + [(None, "c")], "parent string, child string")
    sets = grammar.intern_sets(edges)
    links = [("p%d" % (i % 40), "c%d" % i, i) for i in range(4000)] + [(None, "c1", -1), ("p1", None, -2)]
    df = spark.createDataFrame(links, "parent string, child string, pos int").withColumn("id", F.lit(1))
    passed = {r.pos for r in df.where(grammar._sieve(sets)(F.col("parent"), F.col("child"))).collect()}
    assert set(range(400)) <= passed and len(passed) < 1500 and not passed & {-1, -2}
    assert {r.pos for r in grammar.nonconforming(df, sets, "id").collect()} == set(range(400, 4000)) | {-1, -2}
