import random
from collections import Counter

from nlcorpus.functions import keyed


def test_lookup_join_with_hot_and_cold_keys(spark):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.4 else rnd.choice(["b", "c", "d", "e", "missing"])) for i in range(600)]
    table = [("hot", 1, 300), ("b", 2, 90), ("c", 3, 80), ("d", 4, 5), ("e", 5, 1), ("unused", 6, 0)]
    df = spark.createDataFrame(rows, "i int, k string")
    lookup = spark.createDataFrame(table, "k string, v int, w int")
    values = {k: v for k, v, _ in table}
    left = keyed.lookup_join(df, lookup, "k", "w", ["i"]).collect()
    assert {r.i: r.v for r in left} == {i: values.get(k) for i, k in rows}
    assert len(left) == len(rows)
    semi = keyed.lookup_join(df, lookup, "k", "w", ["i"], "left_semi").collect()
    assert sorted(r.i for r in semi) == [i for i, k in rows if k in values]
    inner = keyed.lookup_join(df, lookup, "k", "w", ["i"], "inner").count()
    assert inner == len(semi)


def test_first_and_later_copies(spark):
    rows = [(5, "a", 1), (2, "a", 1), (9, "a", None), (1, "b", 1), (7, "a", None), (8, None, None)]
    df = spark.createDataFrame(rows, "o int, x string, y int")
    assert sorted(r.o for r in keyed.first_of_each(df, ["x", "y"], "o").collect()) == [1, 2, 7, 8]
    assert sorted(r.o for r in keyed.later_duplicates(df, ["x", "y"], "o").collect()) == [5, 9]


def test_list_difference_keeps_duplicates(spark):
    from nlcorpus.operators import joins

    rows = [(i, "hot" if i % 2 else "k" + str(i % 7), i % 3) for i in range(60)]
    left = spark.createDataFrame(rows, "i int, a string, b int")
    right = spark.createDataFrame([("hot", 1), ("k2", 2), ("k4", 0), ("k4", 0)], "a string, b int")
    listed = {("hot", 1), ("k2", 2), ("k4", 0)}
    out = joins.missing_from(left, right, ["a", "b"], ["i"])
    assert sorted(map(tuple, out.select("i", "a", "b").collect())) == [r for r in rows if r[1:] not in listed]
    kept = joins.present_in(left, right, ["a", "b"], ["i"])
    assert sorted(map(tuple, kept.select("i", "a", "b").collect())) == [r for r in rows if r[1:] in listed]


def test_every_key_above_an_even_share_is_salted(spark):
    """Twenty keys of equal weight among few partitions, and one that holds most: copies follow the weight."""
    table = [(f"k{i}", i, 10) for i in range(20)] + [("most", 99, 2000)]
    lookup = spark.createDataFrame(table, "k string, v int, w int")
    rows = [(i, f"k{i % 20}") for i in range(200)] + [(1000 + i, "most") for i in range(2000)]
    df = spark.createDataFrame(rows, "i int, k string")
    joined = keyed.lookup_join(df, lookup, "k", "w", ["i"])
    assert joined.count() == 2200 and joined.where("v is null").count() == 0
    plan = joined._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan


def shuffled_rows(plan):
    """Rows that each exchange of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled_rows(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled_rows(plan.plan())
    written, below = plan.metrics().get("shuffleRecordsWritten"), plan.children()
    own = [written.get().value()] if written.isDefined() else []
    return own + [n for i in range(below.size()) for n in shuffled_rows(below.apply(i))]


def test_rows_of_frequent_literals_are_not_shuffled(spark):
    """Every record holds one literal three times; one is listed as rare and as frequent, some are null."""
    from nlcorpus.operators import curate

    rows = [(i, "None") for i in range(800) for _ in range(3)] + [(i, f"x{i // 2 if i % 8 else i}") for i in range(800)]
    rows += [(i, None) for i in range(50)] + [(900 + i, "twice") for i in range(600)] + [(2000, "unlisted")]
    listed = [(k, rows_of) for k, rows_of in Counter(k for _, k in rows).items() if k != "unlisted"]
    listed += [("twice", 1), ("x1", None)]
    owned = spark.createDataFrame(rows, "id int, literal string")
    frequency = spark.createDataFrame(listed, "literal string, freq long")
    default = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for threshold in (0, 1, 2, 5000):
            rare = {k for k, n in listed if k is not None and n is not None and n <= threshold}
            got = curate.rare_literal(owned, frequency, threshold)
            assert sorted(r.id for r in got.collect()) == sorted({i for i, k in rows if k in rare})
            if threshold == 1:  # rows of "None" stay where they are, 2400 of 3851
                assert max(shuffled_rows(got._jdf.queryExecution().executedPlan())) <= 1500
        assert curate.rare_literal(owned, frequency.limit(0), 1).count() == 0
        assert curate.rare_literal(owned.limit(0), frequency, 1).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", default)
