"""Chunked scans against plain loops, with chunks far smaller than the groups."""

import random

from pyspark.sql import functions as F

from nlcorpus.functions import ordered


def rows_of(seed, groups=4, longest=40):
    rnd = random.Random(seed)
    return [(g, p, rnd.choice("abc"), rnd.choice([None, "x", "y", "z"]))
            for g in range(groups) for p in sorted(rnd.sample(range(200), rnd.randint(1, longest)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g int, p long, kind string, v string")


def test_islands_any_chunk_size(spark):
    starts = lambda prev, cur: (cur["kind"] == "a") & (prev.isNull() | (prev["kind"] != "a"))
    for seed, chunk in [(1, 1), (2, 3), (3, 17), (4, 1000), (5, None)]:
        rows = rows_of(seed)
        expected, run, last = {}, 0, None
        for g, p, kind, _ in rows:
            if last is None or last[0] != g:
                run, before = 0, None
            else:
                before = last[1]
            run += kind == "a" and before != "a"
            expected[g, p] = (run, before)
            last = (g, kind)
        got = ordered.islands(frame(spark, rows), ["g"], "p", ["kind"], starts, "run", "before",
                              chunk and ordered.chunk_of(F.col("p"), chunk))
        assert {(r.g, r.p): (r.run, r.before and r.before.kind) for r in got.collect()} == expected


def test_fill_forward_across_chunks(spark):
    for seed, chunk in [(1, 1), (2, 5), (3, 1000)]:
        rows = rows_of(seed)
        expected, carried = {}, {}
        for g, p, _, v in rows:
            carried[g] = v or carried.get(g)
            expected[g, p] = carried[g]
        got = ordered.fill_forward(frame(spark, rows), ["g"], "p", F.col("v"), "f",
                                   ordered.chunk_of(F.col("p"), chunk))
        assert {(r.g, r.p): r.f for r in got.collect()} == expected


def test_number_rows(spark):
    rows = rows_of(7)
    got = ordered.number_rows(frame(spark, rows), ["g"], "p", "n", ordered.chunk_of(F.col("p"), 4)).collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.p, r.n) for r in got if r.g == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))


def test_bounded_chunks(spark):
    """Groups of any size and shape: chunks are small, rise with the order, and give the islands of a plain loop."""
    rnd = random.Random(9)
    rows = [(g, p) for g, n in [(1, 700), (2, 90), (3, 5), (None, 300)] for p in rnd.choices([*range(12), None], k=n)]
    rows += [(4, p) for p in range(500)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, g, p, "o") for i, (g, p) in enumerate(rows)], "i int, g int, p long, other string").repartition(7)
    placed = ordered.bounded_chunks(df, ["g"], ["p", "i"], "c", rows=64)
    got = placed.collect()
    assert len(got) == len(rows) and set(placed.columns) == {"i", "g", "p", "other", "c"}
    sizes = {}
    for r in got:
        sizes[r.g, r.c] = sizes.get((r.g, r.c), 0) + 1
    assert max(sizes.values()) <= 64
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.p is not None, r.p or 0, r.i))
        assert [r.c for r in mine] == sorted(r.c for r in mine)
    numbered = ordered.number_rows(placed.withColumn("o", F.struct("p", "i")), ["g"], "o", "n", F.col("c")).collect()
    for g in {r.g for r in got}:
        mine = sorted((r for r in numbered if r.g == g), key=lambda r: (r.p is not None, r.p or 0, r.i))
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
    assert ordered.bounded_chunks(df.limit(0), ["g"], ["p"], "c").count() == 0


def test_busy_user_in_one_hour(spark):
    """Sessions of a user with a third of all events inside an hour, against a loop."""
    from nlcorpus.operators import dialogue

    rnd = random.Random(4)
    events = [(u, rnd.randrange(0, 10 ** 6)) for u in range(30) for _ in range(600)] + [(99, rnd.randrange(3000)) for _ in range(9000)]
    df = spark.createDataFrame(events, "u int, s long").select("u", F.timestamp_seconds("s").alias("at"))
    got = dialogue.session_summary(dialogue.sessions(df, "u", "at"), "u", "at").groupBy("u").agg(
        F.max("session").alias("n"), F.sum("n_events").alias("e")).collect()
    for r in got:
        times = sorted(s for u, s in events if u == r.u)
        assert (r.n, r.e) == (1 + sum(b - a > 3600 for a, b in zip(times, times[1:])), len(times))


def test_add_ordinal_over_many_partitions(spark):
    values = [f"k{i % 50}-{i:04}" for i in range(700)]
    random.Random(3).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(13)
    got = ordered.add_ordinal(df, [F.desc("v")], "n").collect()
    assert [r.v for r in sorted(got, key=lambda r: r.n)] == sorted(values, reverse=True)
    assert sorted(r.n for r in got) == list(range(1, 701))


def test_first_by_digest(spark):
    df = spark.range(3000)
    key = F.md5(F.col("id").cast("string"))
    order = [r.id for r in df.orderBy(key).collect()]
    for n in (0, 1, 1234, 3000):
        got = ordered.first_by_digest(df, key, F.lit(n).cast("long") + F.count("*") * 0, "first").where("first").collect()
        assert sorted(r.id for r in got) == sorted(order[:n])


def test_null_keys_stay(spark):
    from nlcorpus.operators import dataset, dialogue

    split = dataset.train_valid_split(spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (None, "d"), (3, "e")],
                                                            "id int, x string"), "id", 0.6).collect()
    assert len(split) == 5 and sum(r.split == "train" for r in split) == 3
    events = spark.sql("select * from values (1, timestamp'2024-01-01 10:00:00'), (cast(null as int), "
                       "timestamp'2024-01-01 10:00:00'), (1, cast(null as timestamp)) as t(user, at)")
    assert dialogue.sessions(events, "user", "at").count() == 3
    rows = spark.createDataFrame([(None, 1, "x"), (None, 2, None), (1, None, None)], "g int, p long, v string")
    filled = ordered.fill_forward(rows, ["g"], "p", F.col("v"), "f", ordered.chunk_of(F.col("p"))).collect()
    assert {(r.g, r.p, r.f) for r in filled} == {(None, 1, "x"), (None, 2, "x"), (1, None, None)}
