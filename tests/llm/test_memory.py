"""What a worker and its executor hold at a time."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from nlcorpus.llm import boosted, common, crf, jaccard, semantic


def sizes(docs):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "z"])

    rows = docs.mapInArrow(run, "n long, z long").collect()
    return sum(r.n for r in rows), max(r.z for r in rows)


def test_batches_are_bounded(spark):
    docs = spark.range(2000).selectExpr("id", "repeat('word ', 2000) AS text").coalesce(1)
    unset, own = spark.newSession(), spark.newSession()
    assert unset.conf.get(common.BATCH_SETTING, None) is None
    common.prepare(unset)
    assert unset.conf.get(common.BATCH_SETTING) == str(common.BATCH_BYTES)
    own.conf.set(common.BATCH_SETTING, "1m")
    common.prepare(own)
    assert own.conf.get(common.BATCH_SETTING) == "1m"
    held = unset.range(2000).selectExpr("id", "repeat('word ', 2000) AS text").coalesce(1)
    rows, most = sizes(held)
    assert rows == docs.count() and most < 1.1 * common.BATCH_BYTES  # 20 MB in one batch by default


def test_slices_keep_rows_and_bound():
    texts = ["x" * 400_000, None, "", "y" * 3_000_000, *["z" * 300_000] * 9]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    parts = list(common.slices([batch], size=common.WORDS_CHARS))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    for part in parts:
        held = [len(t or "") for t in part.column(1).to_pylist()]
        assert sum(held) <= common.WORDS_CHARS or len(held) == 1


def test_slices_do_not_change_statistics_or_spans():
    texts = [f"Write to anna{i}@post.example.org or +1 (212) 555-01{i:02d} about Item {i}.\n" * (i + 1) for i in range(40)]
    whole = boosted.statistics(texts, common.WordCodes())
    codes, decoder = common.WordCodes(), crf.Decoder(crf.train(crf.LABELLED.strip().split("\n")))
    assert np.array_equal(whole, np.concatenate([boosted.statistics(texts[a:a + 7], codes) for a in range(0, 40, 7)]))
    assert crf.field_spans(texts, decoder) == [s for a in range(0, 40, 7) for s in crf.field_spans(texts[a:a + 7], decoder)]


def test_repeated_codes_without_copies():
    codes = np.random.default_rng(1).integers(0, 2 ** 63, 1_000_000).astype(np.uint64)
    codes[:5000] = np.arange(5000) % 700
    every, counts = np.unique(codes, return_counts=True)
    tracemalloc.start()
    again, found = jaccard.repeated(codes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(again, every[counts > 1]) and np.array_equal(found, counts[counts > 1])
    assert most < codes.nbytes  # over three times that with a count of all codes
    assert [len(x) for x in jaccard.repeated(np.empty(0, np.uint64))] == [0, 0]


def test_windows_of_shingles(spark, monkeypatch):
    """Counts are those of all windows, also where a text does not fit the rest of one."""
    monkeypatch.setattr(jaccard, "WINDOW", 100)
    texts = [" ".join(f"w{(i * 31 + j) % 90}" for j in range(60 + i)) for i in range(12)] + ["", None, " ".join(f"v{j}" for j in range(300))]
    held = []

    class Frame:
        """Runs the step of a partition here, so that the smaller window holds."""

        def __getitem__(self, name):
            return common.F.lit(0)

        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            held.append(run)

    jaccard.measure(Frame())
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["k", "t"])
    rows = pa.Table.from_batches(held[0]([batch])).to_pylist()
    windows, known, size, expected = [], set(), 0, {}
    for text in texts:
        codes = jaccard.shingle_codes(common.WordCodes()(common.split_words(text)), jaccard.WIDTH)
        if (name := jaccard.fingerprint(codes)) not in known:
            known.add(name)
            windows.append(codes)
            size += len(codes)
        if size >= 100:
            for code, n in zip(*np.unique(np.concatenate(windows), return_counts=True)):
                expected.setdefault(int(code.view(np.int64)), []).append(n) if n > 1 else None
            windows, known, size = [], set(), 0
    for code, n in zip(*np.unique(np.concatenate(windows or [np.empty(0, np.uint64)]), return_counts=True)):
        expected.setdefault(int(code.view(np.int64)), []).append(n) if n > 1 else None
    counted = {}
    for row in rows:
        if row["c"]:
            counted.setdefault(row["fp"], []).append(row["c"])
    assert expected and counted == expected
    assert sum(r["c"] == 0 for r in rows) == len(texts)


def test_item_names_take_no_workers(spark, tmp_path):
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    bench = spark.createDataFrame([(None, "one two three four five six seven eight"), (7, "never met here at all")],
                                  "item_id int, text string")
    found = semantic.leaks(docs, bench)
    assert "ExistingRDD" not in found._jdf.queryExecution().toString()
    assert dict(found.dtypes)["item_id"] == "int" and [(r.doc_id, r.item_id) for r in found.collect()] == [(1, None)]
