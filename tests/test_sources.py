"""Readers and writers on small files, with their error cases."""

import json

import pytest
from pyspark.sql import functions as F

from nlcorpus.operators import clean, curate, dataset, dialogue
from nlcorpus.sources import files, transcripts


def text_file(folder, name, text):
    path = folder / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_forms(spark, tmp_path):
    rows = [{"id": "1", "intent": "a", "snippet": "x\ny"}, {"id": "2", "intent": "b", "snippet": None}]
    array = text_file(tmp_path, "in.json", json.dumps(rows, indent=1))
    lines = str(tmp_path / "out.jsonl")
    files.convert_json(spark, array, lines, files.PAIR_SCHEMA)
    back = str(tmp_path / "back.json")
    files.convert_json(spark, lines, back, files.PAIR_SCHEMA)
    got = files.read_json(spark, back).orderBy("id").collect()
    assert [(r.id, r.intent, r.snippet, r.prob) for r in got] == [("1", "a", "x\ny", None), ("2", "b", None, None)]
    parts = [p for p in (tmp_path / "back.json").iterdir() if p.name.startswith("part")]
    texts = [p.read_text() for p in parts if p.stat().st_size]
    assert sum(len(json.loads(t)) for t in texts) == 2 and all(t.endswith("\n") for t in texts)
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path / "absent.jsonl"))


def test_lines_over_splits_and_files(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    expected = []
    for name in ("b", "a", "c"):
        (folder / f"{name}.txt").write_text("".join(f"{name}{i}\n" for i in range(500)))
    for name in ("a", "b", "c"):
        expected += [f"{name}{i}" for i in range(500)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = files.read_lines(spark, str(folder)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(got, key=lambda r: r.line_no)] == expected
    assert sorted(r.line_no for r in got) == list(range(1500))


def test_csv_and_file_pairs(spark, tmp_path):
    path = text_file(tmp_path, "p.csv", 'do a;x = 1\\ny = 2;z\n"do;b";q;z\n')
    got = files.read_csv_pairs(spark, path, id_prefix="p").orderBy("id").collect()
    assert [(r.id, r.intent, r.snippet) for r in got] == [("p1", "do a", "x = 1\ny = 2"), ("p2", "do;b", "q")]
    swapped = files.read_csv_pairs(spark, path, source_column=2, target_column=0, newline_marker=None, header=True)
    assert [(r.id, r.intent, r.snippet) for r in swapped.collect()] == [("1", "z", "do;b")]
    source, target = text_file(tmp_path, "s.txt", "a\n\nc\n"), text_file(tmp_path, "t.txt", "1\n2\\n\n3\n")
    pairs = files.read_file_pair(spark, source, target).orderBy("id").collect()
    assert [(r.id, r.intent, r.snippet) for r in pairs] == [("1", "a", "1"), ("2", "", "2\n"), ("3", "c", "3")]
    with pytest.raises(ValueError):
        files.read_file_pair(spark, source, text_file(tmp_path, "u.txt", "1\n"))


def test_lists_and_stats(spark, tmp_path):
    ids = files.read_blacklist(spark, text_file(tmp_path, "b.txt", "2 \n10\t\n2\n"))
    assert sorted(r.id for r in ids.collect()) == ["10", "2"]
    rows = spark.createDataFrame([(1,), (2,), (10,)], "id int")
    assert [r.id for r in clean.drop_blacklisted(rows, ids).collect()] == [1]
    with pytest.raises(ValueError):
        clean.drop_blacklisted(rows.withColumnRenamed("id", "x"), ids)
    out = str(tmp_path / "ids.txt")
    files.write_id_list(rows, out)
    assert [r.value for r in files.read_lines(spark, out).orderBy("line_no").collect()] == ["1", "10", "2"]
    stats = str(tmp_path / "stats.json")
    files.write_stats_json(rows.agg(F.max("id").alias("top"), F.array_sort(F.collect_list("id")).alias("all")), stats)
    assert files.read_stats_json(spark, stats) == {"top": 10, "all": [1, 2, 10]}


def test_transcripts(spark, tmp_path):
    heading = "NL Query;NL Response;Code expected;Code generated\n"
    path = text_file(tmp_path, "t.csv", heading + "Hi;Hey!;;\nLoad it;;x = 1\\n;# Load it\\n x = 1\\n\n")
    got = transcripts.read_transcripts(spark, path).collect()
    assert got[0].bot_response_code_expected == "" and got[1].user_query == "Load it"
    bare = transcripts.read_transcripts(spark, path).select(
        dialogue.strip_query_comment(F.col("bot_response_code_generated"))).collect()
    assert [r[0] for r in bare] == ["", "x = 1\\n"]


def test_intents_and_stories(spark, tmp_path):
    nlu = 'version: "2.0"\n\nnlu:\n- intent: greet\n  examples: |\n    - hey\n    - hello there\n\n- intent: bye\n' \
          "  examples: |\n    - What is 2 + 2?"
    got = transcripts.read_intents(spark, text_file(tmp_path, "nlu.yml", nlu)).orderBy("line_no").collect()
    assert [(r.intent, r.example) for r in got] == [("greet", "hey"), ("greet", "hello there"), ("bye", "What is 2 + 2?")]
    stories = "stories:\n\n- story: decision tree\n  steps:\n  - intent: greet\n  - action: utter_greet\n\n- story: end\n" \
              "  steps:\n  - intent: goodbye\n"
    got = transcripts.read_stories(spark, text_file(tmp_path, "stories.yml", stories)).collect()
    assert sorted(tuple(r) for r in got) == [("decision tree", 1, "intent", "greet"),
                                             ("decision tree", 2, "action", "utter_greet"), ("end", 1, "intent", "goodbye")]


def test_defaults_and_filters(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "é", "b"), (3, "€", "c"), (4, "x\0", "d")],
                               "id int, intent string, rewritten_intent string")
    with pytest.raises(ValueError):
        clean.select_with_defaults(df, ["intent", "nl_char_enc"])
    got = clean.select_with_defaults(df, ["intent", "nl_char_enc"], defaults={"nl_char_enc": F.lit(None)})
    assert got.columns == ["intent", "nl_char_enc", "id"]
    assert [r.nl for r in clean.coalesce_intent(df).orderBy("id").collect()] == ["a", "b", "c", "d"]
    valid = {r.id: r.v for r in df.select("id", clean.valid_text(F.col("intent")).alias("v")).collect()}
    assert valid == {1: True, 2: True, 3: False, 4: False}
    assert df.select(clean.valid_text(F.col("rewritten_intent")).alias("v")).where("not v").count() == 1
    with pytest.raises(ValueError):
        curate.drop_ids(df)


def test_placeholder_pairs(spark):
    rows = [(["set", "STR:0"], "f('STR:0')", "7", {"STR:0": "'hello'"})]
    df = spark.createDataFrame(rows, "query array<string>, code string, raw_id string, replacements map<string,string>")
    done = clean.convert_placeholder_pairs(df, "dj").first()
    assert (done.id, done.intent, done.snippet) == ("dj7", "set 'hello'", "f('hello')")
    kept = clean.convert_placeholder_pairs(df, apply=False).first()
    assert (kept.intent, kept.snippet, kept.replacements) == ("set STR:0", "f('STR:0')", {"STR:0": "'hello'"})
    predictions = spark.createDataFrame([("dj7", "f('STR:0')", ["g('STR:0')", None])],
                                        "id string, expected_codesnippet string, predicted_codesnippets array<string>")
    ids = df.select(F.lit("dj7").alias("id"), "replacements")
    final = clean.postprocess_predictions(predictions, ids).first()
    assert (final.expected_codesnippet, final.predicted_codesnippets) == ("f('hello')", ["g('hello')", None])


def test_split_and_batches(spark):
    df = spark.range(25).select("id", F.array_repeat(F.lit(7), (F.col("id") % 5).cast("int")).alias("nl_enc"),
                                F.array_repeat(F.lit(9), F.col("id").cast("int")).alias("ast_seq_enc"),
                                F.array_repeat(F.array(F.lit(1), F.lit(2)), F.col("id").cast("int")).alias("paths"))
    split = dataset.train_valid_split(df, "id", 0.5)
    assert split.where("split = 'train'").count() == 12  # 12.5 rounds to even
    same = lambda s: sorted((r.id, r.split) for r in s.collect())
    assert same(split) == same(dataset.train_valid_split(df.repartition(9), "id", 0.5))
    batches = dataset.pad_batches(df, ["id"], 10, paths="paths", depth=2).collect()
    for b in (0, 1, 2):
        rows = [r for r in batches if r.batch == b]
        assert len(rows) == (10, 10, 5)[b]
        assert {len(r.ast_seq_enc) for r in rows} == {len(r.paths) for r in rows} == {max(r.id for r in rows)}
        assert all(r.ast_seq_enc == [9] * r.id + [0] * (len(r.ast_seq_enc) - r.id) for r in rows)
        assert all(p == [0, 0] for r in rows for p in r.paths[r.id:])
    with pytest.raises(ValueError):
        dataset.load_sets(spark)


def test_dialogue_rules(spark):
    rows = [(1, "a", 0.9), (1, "b", 0.1), (2, "a", 0.5), (2, "b", 0.48), (3, "a", 0.2), (4, "b", 0.3)]
    got = dialogue.fallback_rule(spark.createDataFrame(rows, "m int, i string, c double"), ["m"], "i", "c").collect()
    assert {r.m: r.fallback for r in got} == {1: False, 2: True, 3: True, 4: False}
    events = spark.sql("""SELECT 1 AS u, timestamp_ntz'2024-01-01 23:30:00' + make_dt_interval(0, 0, m) AS t FROM VALUES
        (0), (60), (121), (122), (3000) AS v(m)""")
    sessions = dialogue.session_summary(dialogue.sessions(events, "u", "t"), "u", "t").orderBy("session").collect()
    assert [r.n_events for r in sessions] == [2, 2, 1]
    words = spark.createDataFrame([("k", "Ab", 2)], "k string, word string, n long")
    grams = {r.gram: r.n for r in dialogue.char_ngrams(words, "k").collect()}
    assert grams == {" ": 4, "a": 2, "b": 2, " a": 2, "ab": 2, "b ": 2, " ab": 2, "ab ": 2, " ab ": 2}


def test_statistics_are_one_row(spark, tmp_path):
    from nlcorpus.sources import files

    with pytest.raises(ValueError):
        files.write_stats_json(spark.range(2), str(tmp_path / "two"))
    with pytest.raises(ValueError):
        files.write_stats_json(spark.range(0), str(tmp_path / "none"))


def test_parts_are_read_in_number_order(spark, tmp_path):
    from nlcorpus.sources import files

    for name in ("part-99999-x", "part-100000-x", "part-00001-x"):
        text_file(tmp_path, name, f"{name}\n")
    lines = sorted((r.line_no, r.value) for r in files.read_lines(spark, str(tmp_path)).collect())
    assert [v for _, v in lines] == ["part-00001-x", "part-99999-x", "part-100000-x"]


def test_headings_end_with_their_file(spark, tmp_path):
    from nlcorpus.sources import transcripts

    text_file(tmp_path, "a.yml", "- intent: greet\n  examples: |\n    - hi\n")
    text_file(tmp_path, "b.yml", "    - orphan\n- intent: leave\n  examples: |\n    - bye\n")
    rows = transcripts.read_intents(spark, str(tmp_path)).collect()
    assert {(r.intent, r.example) for r in rows} == {("greet", "hi"), ("leave", "bye")}
