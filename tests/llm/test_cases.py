"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nlcorpus.llm import boosted, crf, fertility, jaccard, pieces, rollup, semantic, spans, suffixes, urls
from nlcorpus.llm.queries import piece_model
from nlcorpus.session import scratch_path

LABELS = "doc_id long, quality int, toxic int, x string"


def by_id(frame):
    return {r["doc_id"]: r for r in frame.collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "a"), (2, 0, None, "b"), (2, None, 0, "c"), (None, 1, 0, "d")], LABELS)


def test_rollup(spark, docs, empty):
    store = rollup.Rollup(spark, scratch_path(spark, "rollup-test"))
    counted = rollup.counted(docs, "words-1")
    assert store.totals().count() == 0
    assert store.commit("a/1", rollup.inserts(counted)) and not store.commit("a/1", rollup.inserts(counted))
    first = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in store.totals().collect()}
    assert first[(None, None)] == (2, 2 * len(counted.where("doc_id = 13").first().text.split()))
    assert sum(n for n, _ in first.values()) == 15
    store.commit("b", rollup.inserts(rollup.counted(empty, "words-1")))
    store.commit("c", rollup.inserts(counted.where("source is null"), -1))
    assert (None, None) not in {(r.source, r.lang) for r in store.totals().collect()}
    before = counted.where("doc_id in (1, 3, 6)").dropDuplicates(["doc_id"])
    after = before.where("doc_id <> 3").replace({"src0": "src1"}, subset=["source"])
    change = {(r.source, r.n_docs, r.n_tokens) for r in rollup.summed(rollup.difference(before, after)).collect()}
    words = sum(r.tokens for r in after.collect())
    assert change == {("src0", -3, -words), ("src1", 2, words)}


def test_unfinished_batch_is_not_seen(spark, docs):
    root = scratch_path(spark, "rollup-broken")
    store = rollup.Rollup(spark, root)
    rollup.summed(rollup.inserts(rollup.counted(docs, "words-1"))).write.option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/batch-x")
    assert store.totals().count() == 0 and not store.committed("x")
    assert store.commit("x", rollup.inserts(rollup.counted(docs, "words-1")))
    assert sum(r.n_docs for r in store.totals().collect()) == 15


def test_fertility(docs, empty):
    rows = fertility.judge(docs, piece_model()).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15 and found[4]["n_words"] == found[3]["n_tokens"] == 0
    assert all(found[i]["base_failed"] and not found[i]["kept"] for i in (3, 4, 5, 6, 8, 9, 11))
    assert found[1]["kept"] and found[7]["n_words"] == 60_000
    assert fertility.judge(empty, piece_model()).count() == 0


def test_field(docs, empty):
    rows = crf.find(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15
    assert [s["kind"] for s in found[1]["base"]] == ["phone", "email", "ip"]
    assert found[4]["text"] is None and not found[4]["spans"] and not found[3]["spans"] and not found[13]["spans"]
    assert not found[9]["base"]  # digits alone, too many for a card
    masked = by_id(crf.mask(docs))
    assert "[PHONE]" in masked[1]["text"] and "anna" not in masked[1]["text"] and masked[1]["k"] == "k"
    assert masked[4]["text"] is None and crf.find(empty).count() == crf.mask(empty).count() == 0


def test_boosted(docs, empty, labels):
    rows = boosted.score(docs, labels).collect()
    assert len(rows) == 15 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert boosted.score(empty, labels).count() == 0
    assert {r["score"] for r in boosted.score(docs, labels.limit(0)).collect()} == {0.5}
    assert boosted.accepted(docs, labels.limit(0)).count() == 15


def test_semantic(spark, docs, empty):
    from conftest import OTHER, PROSE

    bench = spark.createDataFrame([(1, OTHER), (1, OTHER), (2, ""), (3, None), (None, PROSE), (4, "two words"), (5, "!!")],
                                  "item_id int, text string")
    rows = semantic.leaks(docs, bench).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(rows) == len(found)
    assert found == {(i, 1) for i in (1, 2, 10, 13, None)} | {(i, None) for i in (1, 2, 10)} | {(6, 4)}
    assert semantic.leaks(empty, bench).count() == 0 and semantic.leaks(docs, bench.limit(0)).count() == 0


def test_jaccard(docs, empty):
    rows = jaccard.link_classes(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15 and found[None]["component_id"] is None and found[None]["n_shingles"] == found[13]["n_shingles"]
    assert [found[i]["n_shingles"] for i in (3, 4, 5, 6, 8)] == [0, 0, 0, 1, 1]
    assert {i for i, r in found.items() if r["component_id"] == 1} == {1, 2, 10}
    assert all(found[i]["component_id"] == i for i in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13))
    assert jaccard.link_classes(empty).count() == 0


def test_suffix_tree(docs, empty):
    rows = suffixes.score(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15 and found[3]["n_tokens"] == found[4]["n_tokens"] == found[5]["n_tokens"] == 1
    assert found[1]["base_score"] == pytest.approx(found[2]["base_score"])
    assert found[13]["n_tokens"] == found[None]["n_tokens"] and suffixes.score(empty).count() == 0


def test_pieces(docs, empty):
    processor = pieces.load(pieces.model_bytes(piece_model()))
    rows = pieces.encode(docs, piece_model()).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == 15
    for row in rows:
        assert row["ids"] == processor.encode(texts[row["doc_id"]], add_bos=True, add_eos=True)
    decoded = by_id(pieces.decode(pieces.encode(docs, piece_model()), piece_model()))
    assert all(decoded[i]["text"] == t.replace("▁", " ") for i, t in texts.items())
    digest = by_id(pieces.digests(docs, piece_model()))
    assert digest[4]["ids_sha256"] == hashlib.sha256(b"\1\0\0\0\2\0\0\0").hexdigest() and digest[4]["n_tokens"] == 2
    assert pieces.encode(empty, piece_model()).count() == pieces.digests(empty, piece_model()).count() == 0


def test_spans(docs, empty):
    rows = spans.remove_repeats(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == 15 and set(docs.columns) < set(rows[0].asDict()) and found[1]["k"] == "k"
    assert found[1]["n_removed"] == 0 and found[2]["text"] == "" and found[2]["n_removed"] == found[2]["n_sentences"]
    assert found[4]["text"] is None and found[3]["text"] == "" and found[7]["n_removed"] < found[7]["n_sentences"]
    assert found[None]["n_removed"] == 3 and found[13]["n_removed"] == 3
    assert spans.remove_repeats(empty).count() == 0


def test_urls(spark):
    rows = [(1, "https://www.A.example.org/es/x", "h"), (2, None, None), (3, "nonsense", ""), (4, "http://m.b.net/p/?utm_id=3#f", None),
            (5, "https://b.net/p", '<link rel="canonical" href="https://c.net/z">'), (5, "https://b.net/p", ""),
            (6, "http://c.net/z/", "<meta http-equiv='refresh' content='0; url=http://d.com/de/q'>"), (7, "http://d.com/de/q", ""),
            (8, "http://e.com/fr/", '<link href="http://d.net/q" rel=canonical>'), (9, "http://d.net/q", ""), (None, "ftp://x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'a' AS a", "1 AS component")
    judged = urls.judge(pages, urls.RULES).collect()
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judged}
    assert len(judged) == 11
    assert found[1] == ("www.a.example.org", "/es/x", "example.org/es/", "block")
    assert found[2] == ("", "", None, "allow") == found[3]
    assert [found[i][3] for i in (4, 5, 6, 7)] == ["block"] * 4 and found[7][2] == "com/de/"
    assert found[8][3] == found[9][3] == "allow" and found[9][2] is None
    allowed = urls.judge(pages, [*urls.RULES, ("allow", "b.net", "/p")])
    assert {r["page_id"]: r["verdict"] for r in allowed.collect()}[6] == "allow"  # explicit allow goes before block
    assert urls.judge(pages.limit(0), urls.RULES).count() == 0 and urls.judge(pages, []).count() == 11


def test_link_targets(spark):
    from urllib.parse import urljoin

    base = "http://a.com/x/y.html?k=1#f"
    targets = ["/de/q", "//b.net/p", "q", "../q", "./q/", "../../../q", "?z=2", "q?u=http://c.net/&amp;v=1", "http://d.net/&#38;", "..",
               "/a/./b/../c", "HTTPS://E.com/", "/r?to=http://x.y/"]
    rows = spark.createDataFrame([(t, base) for t in targets], "t string, b string")
    for r in rows.select("t", urls.resolved(rows["t"], rows["b"]).alias("u")).collect():
        want = urljoin(base, r["t"].replace("&amp;", "&").replace("&#38;", "&"))
        assert r["u"] == (want.replace("https://E", "HTTPS://E")), r["t"]
    none = spark.createDataFrame([("", base), ("#f", base), ("mailto:a@b.c", base), ("/a", "nonsense"), ("/a", None), (None, base)],
                                 "t string, b string")
    assert {r[0] for r in none.select(urls.resolved(none["t"], none["b"])).collect()} == {None}
    assert spark.sql("select 'a' t, 'http://h' b").select(urls.resolved(F.col("t"), F.col("b"))).first()[0] == "http://h/a"
    link = '<link rel="canonical" href="{}">'
    rows = [(1, "http://a.com/x", link.format("/de/q")), (2, "http://a.com/de/q", None), (3, "https://b.net/y", link.format("//a.com/de/q")),
            (4, "http://c.net/w/z", "<meta http-equiv=refresh content='0; url=../de/q?a=1&amp;b=2'>"), (5, "http://c.net/de/q?a=1&b=2", ""),
            (6, "http://c.net/other", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages, [*urls.RULES, ("block", "c.net", "/de/")]).collect()}
    assert [found[i] for i in range(1, 7)] == ["block"] * 5 + ["allow"]


def test_pipeline_on_cases(spark, docs, tmp_path):
    folder = str(tmp_path)
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(9, "When only three of them returned, the harbour stayed silent for a week.")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near copies", "decontamination", "personal data", "encoding"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, folder)
        assert frame.columns == columns, name
    left = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert left == {3, 4, 5, 6, 7, 8, 9, 11, 12} == {r["doc_id"] for r in frame.collect()}
