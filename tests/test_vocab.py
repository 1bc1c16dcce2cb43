"""Vocabularies and encodings against plain Python."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nlcorpus.functions import subword
from nlcorpus.functions.tiered import _heavy, code_arrays
from nlcorpus.operators import vocab


def plain_bpe(counts, merges, longest):
    """Merge the most frequent pair one at a time."""
    words = {w: list(w) for w in counts}
    pieces = []
    known = {c for w in counts for c in w}
    while len(pieces) < merges:
        pairs = Counter()
        for w, n in counts.items():
            for a, b in zip(words[w], words[w][1:]):
                if len(a + b) <= longest:
                    pairs[a, b] += n
        if not pairs:
            break
        (a, b), _ = min(pairs.items(), key=lambda kv: (-kv[1], kv[0]))
        if a + b not in known:
            pieces.append(a + b)
            known.add(a + b)
        for s in words.values():
            i = 0
            while i < len(s) - 1:
                if (s[i], s[i + 1]) == (a, b):
                    s[i:i + 2] = [a + b]
                i += 1
    return pieces


@pytest.mark.parametrize("seed,letters,longest", [(1, "abc", 16), (2, "ab", 6), (3, "abcdefgh", 3)])
def test_batched_merges_equal_single_merges(spark, seed, letters, longest):
    rnd = random.Random(seed)
    counts = Counter("▁" + "".join(rnd.choices(letters, k=rnd.randint(1, 9))) for _ in range(60))
    words = spark.createDataFrame(list(counts.items()), "word string, cnt long")
    alphabet = Counter()
    for w, n in counts.items():
        alphabet.update({c: w.count(c) * n for c in set(w)})
    merges = 25
    got = vocab.bpe_vocab(words, 4 + len(alphabet) + merges, longest, cut_every=7).orderBy("id").collect()
    letters_by_count = [c for c, _ in sorted(alphabet.items(), key=lambda kv: (-kv[1], kv[0]))]
    expected = plain_bpe(counts, merges, longest)
    assert [r.piece for r in got] == ["<pad>", "<unk>", "<s>", "</s>"] + expected + letters_by_count


def indexed_bpe(counts, size, longest):
    """The same one at a time, with counts kept up for the words that hold a merged pair; for whole tables."""
    words = {w: list(w) for w in counts}
    totals, holders = Counter(), {}

    def count(w, sign):
        for pair in zip(words[w], words[w][1:]):
            if len(pair[0]) + len(pair[1]) <= longest:
                totals[pair] += sign * counts[w]
                holders.setdefault(pair, set()).add(w)

    for w in words:
        count(w, 1)
    alphabet = Counter()
    for w, n in counts.items():
        for c in w:
            alphabet[c] += n
    pieces, known = [], set(alphabet)
    while len(pieces) < size - 4 - len(alphabet):
        best = min(((-n, pair) for pair, n in totals.items() if n > 0), default=None)
        if best is None:
            break
        left, right = best[1]
        for w in list(holders[left, right]):
            count(w, -1)
            s, i = words[w], 0
            while i < len(s) - 1:
                if s[i] == left and s[i + 1] == right:
                    s[i:i + 2] = [left + right]
                i += 1
            count(w, 1)
        if left + right not in known:
            pieces.append(left + right)
            known.add(left + right)
    return ["<pad>", "<unk>", "<s>", "</s>", *pieces, *sorted(alphabet, key=lambda c: (-alphabet[c], c))]


def test_vocabulary_of_a_whole_table(spark):
    """The registered query on all documents of the smallest tables, piece by piece."""
    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.001"
    texts = [r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect()]
    counts = Counter(u for t in texts if t is not None for u in re.findall("▁?[^▁]+|▁", "▁" + t.replace(" ", "▁")))
    got = entry.queries()["G3_bpe_vocab"](spark, folder).orderBy("id").collect()
    assert [r["piece"] for r in got] == indexed_bpe(counts, 800, 16) and [r["id"] for r in got] == list(range(800))


def test_vocab_size_and_symbols(spark):
    words = spark.createDataFrame([("▁aab", 5), ("▁b", 1)], "word string, cnt long")
    with pytest.raises(ValueError):
        vocab.bpe_vocab(words, 5)
    got = [r.piece for r in vocab.bpe_vocab(words, 9, user_symbols=["@"]).orderBy("id").collect()]
    assert got[:5] == ["<pad>", "<unk>", "<s>", "</s>", "@"] and len(got) == 9


def test_word_counts_options(spark):
    df = spark.createDataFrame([("ab 12 ab",), ("a  b",)], "text string")
    counts = lambda **o: {r.word: r.cnt for r in vocab.word_counts(df, "text", **o).collect()}
    assert counts() == {"▁ab": 2, "▁12": 1, "▁a": 1, "▁": 1, "▁b": 1}
    assert counts(split_digits=True)["1"] == 1 and counts(split_digits=True)["▁"] == 2
    assert counts(whitespace_as_suffix=True) == {"ab▁": 2, "12▁": 1, "a▁": 1, "▁": 1, "b▁": 1}
    assert counts(split_words=False) == {"▁ab▁12▁ab": 1, "▁a▁▁b": 1}


def test_segmenter_merges_lowest_id_first():
    ids = {"ab": 4, "bc": 5, "abc": 6, "a": 7, "b": 8, "c": 9, "▁": 10}
    assert subword.Segmenter(ids)("abc") == ["▁", "abc"]
    assert subword.Segmenter({"bc": 4, "ab": 5})("abc") == ["▁", "a", "bc"]
    assert subword.Segmenter(ids)("") == []
    assert "".join(subword.Segmenter(ids)("a  bc x")) == "▁a▁▁bc▁x"


def test_heap_merges_like_a_scan():
    """Every round of the scan looks at all pairs; the heap must take the same ones, ties from the left."""
    def scan(ids, unit):
        parts = list(unit)
        while True:
            options = [(ids[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids]
            if not options:
                return parts
            at = min(options)[1]
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    rnd = random.Random(21)
    for _ in range(300):
        letters = "ab" if rnd.random() < 0.5 else "abcd"
        pieces = {"".join(rnd.choices(letters, k=rnd.randint(2, 5))) for _ in range(rnd.randint(1, 25))}
        ids = {p: i for i, p in enumerate(rnd.sample(sorted(pieces), len(pieces)))}
        unit = "".join(rnd.choices(letters, k=rnd.randint(0, 60)))
        assert list(subword.Segmenter(ids).pieces_of(unit)) == scan(ids, unit)
    ids = {"ab": 0, "abab": 1}
    long = subword.Segmenter(ids, split_words=False, add_dummy_prefix=False)("ab" * 100_000)  # a scan would take minutes
    assert long == ["abab"] * 50_000


def test_segmenter_is_kept_by_the_worker():
    ids, other = {"ab": 1}, {"ab": 1}
    first = subword.worker_segmenter(ids, split_digits=True)
    assert subword.worker_segmenter(ids, split_digits=True) is first
    assert subword.worker_segmenter(ids) is not first and subword.worker_segmenter(other, split_digits=True) is not first


def test_encode_nl_and_chars(spark):
    table = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<s>", 2), ("</s>", 3), ("▁a", 4), ("▁", 5), ("a", 6),
                                   ("b", 7)], "piece string, id int")
    df = spark.createDataFrame([("a b?",), ("",), (None,)], "t string")
    rows = vocab.encode_nl(df, "t", table, out_pieces="p")
    assert [r.nl_enc for r in rows.collect()] == [[2, 4, 5, 7, 1, 3], [2, 3], None]
    chars = spark.createDataFrame([("a", 10), ("▁", 11)], "piece string, id int")
    assert vocab.encode_chars(rows, "p", chars).first().nl_char_enc == [[], [11, 10], [11], [1], [1], []]


def test_encode_tree_drops_unknown(spark):
    rows = [("r1", ["Name", "txt", ""], [False, True, True]), ("r2", ["Other"], [False]), ("r3", ["<unk>"], [False]),
            ("r4", [], []), ("r5", ["txt"], [False])]
    records = spark.createDataFrame(rows, "id string, tokens array<string>, s array<boolean>")
    target = spark.createDataFrame([("<unk>", 1, 0), ("Name", 4, 9)], "piece string, id long, cnt long")
    source = spark.createDataFrame([("<unk>", 1, 0), ("txt", 4, 2)], "piece string, id long, cnt long")
    for frequent in (0, 1, 10):
        got = vocab.encode_tree(records, "tokens", "s", target, source, 5, frequent=frequent).collect()
        assert sorted((r.id, r.ast_seq_enc) for r in got) == [("r1", [2, 4, 9, 5, 3]), ("r4", [2, 3])]


@pytest.mark.parametrize("frequent", [0, 3, 1000])
def test_two_tiers_code_like_one_dictionary(spark, frequent):
    rnd = random.Random(31)
    names = {f"w{i}": i * 10 for i in range(60)} | {"long" * 30: 7, "é": 8, "": 9}
    pool = [*names, *(f"w{i}" for i in (0, 1, 2) for _ in range(40)), "new", "other", None]
    rows = [(rnd.randrange(5), rnd.choices(pool, k=rnd.choice([0, 1, 7, 300])), "x") for _ in range(150)]
    rows += [(1, None, "x"), (None, ["hot"] * 4000, "x"), (2, ["w1"], "x"), (2, ["w1"], "x")]
    df = spark.createDataFrame(rows, "k int, v array<string>, __other string").repartition(4)
    table = spark.createDataFrame([(n, c, 100 - i) for i, (n, c) in enumerate(names.items())], "n string, c long, w int")
    got = code_arrays(df, "v", table, "n", "c", "w", "ids", frequent)
    assert got.columns == [*df.columns, "ids"]
    key = lambda r: (str(r[0]), str(r[1]))
    want = [(k, v, v and [names.get(x) for x in v] if v is not None else None) for k, v, _ in rows]
    assert sorted(((r.k, r.v, r.ids) for r in got.collect()), key=key) == sorted(want, key=key)
    back = code_arrays(got.select("k", "ids"), "ids", table, "c", "n", "w", "again", frequent).collect()
    texts = {c: n for n, c in names.items()}
    assert all(r.again == (None if r.ids is None else [texts.get(i) for i in r.ids]) for r in back) and len(back) == len(rows)
    assert code_arrays(df.limit(0), "v", table, "n", "c", "w", "ids", frequent).count() == 0


def test_nfkc(spark):
    df = spark.createDataFrame([("ﬁ Ａ²",), (None,)], "t string")
    assert [r[0] for r in df.select(vocab.normalise_nfkc(F.col("t"))).collect()] == ["fi A2", None]


def test_runs_of_unknown_characters(spark):
    table = spark.createDataFrame([("<pad>", 0), ("<unk>", 1), ("<s>", 2), ("</s>", 3), ("▁", 4), ("a", 5)],
                                  "piece string, id int")
    df = spark.createDataFrame([("a€€€a",), ("€ €",)], "t string")
    rows = vocab.encode_nl(df, "t", table, out_pieces="p").collect()
    assert [r.nl_enc for r in rows] == [[2, 4, 5, 1, 5, 3], [2, 4, 1, 4, 1, 3]]
    assert "".join(rows[0].p) == "▁a€€€a"


def test_decode_keeps_records(spark):
    table = spark.createDataFrame([("<unk>", 1, 0), ("▁ab", 4, 3)], "piece string, id long, cnt long")
    rows = spark.createDataFrame([("empty", [2, 3]), ("odd", [2, 4, 77, 3])], "i string, ids array<long>")
    assert {r.i: r.text for r in vocab.decode(rows, "ids", table).collect()} == {"empty": "", "odd": " ab<unk>"}


def test_characters_of_valid_texts(spark):
    df = spark.createDataFrame([("a b",), ("a\u20ac",), (None,)], "t string")
    assert sorted(r.ch for r in vocab.char_occurrences(df, "t").collect()) == ["a", "b", "▁"]


def test_many_merges_a_pass(spark, monkeypatch):
    """Guessed merges are checked against all units: few passes, and the same pieces however poor the guess."""
    counts = {f"▁{a}{b}{c}{a}{a}{a}": 1 + (7 * i + 3 * j + k) % 11 for i, a in enumerate("abcde")
              for j, b in enumerate("abcdef") for k, c in enumerate("acegh")}
    words = spark.createDataFrame(list(counts.items()), "word string, cnt long")
    expected, passes, once = plain_bpe(counts, 40, 16), [], subword.pair_changes
    monkeypatch.setattr(subword, "pair_changes", lambda *a: passes.append(1) or once(*a))
    got = lambda: [r.piece for r in vocab.bpe_vocab(words, 4 + 40 + 9, cut_every=15).orderBy("id").collect()][4:44]
    assert got() == expected and len(passes) <= 5
    monkeypatch.setattr(subword, "GUIDE_UNITS", 3)
    assert got() == expected


def test_values_that_are_not_asked_for_are_not_written(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, [])], "k int, v array<string>")
    table = spark.createDataFrame([("a", 1, 9), ("b", 2, 5), ("c", 3, 5)], "n string, c long, w int")
    for frequent in (0, 2, 3):  # equal weights stay out together where they do not fit
        got = code_arrays(df, "v", table, "n", "c", "w", "ids", frequent, keep=False)
        assert got.columns == ["k", "ids"] and {r.k: r.ids for r in got.collect()} == {1: [1, 2, 3, None], 2: []}
    assert [_heavy(table, "n", "c", "w", f).num_rows for f in (0, 2, 3)] == [0, 1, 3]


def test_texts_are_cut_in_slices(spark, monkeypatch):
    sizes = [len(s) for s in vocab.text_slices(pa.array(["a" * 600_000, "b" * 600_000, None, "", "c" * 3_000_000, "d"]))]
    assert sizes == [1, 3, 1, 1] and not list(vocab.text_slices(pa.array([], pa.string())))
    table = spark.createDataFrame([("<unk>", 1), ("a", 4), ("▁", 5), ("▁b", 6)], "piece string, id int")
    rows = [("b a",), ("x" * 400_000 + " b",), (None,), ("",), ("a" * 1_200_000,), ("b",)]
    df = spark.createDataFrame(rows, "t string").coalesce(1)
    got = vocab.encode_nl(df, "t", table).select("t", "nl_enc", vocab.decode_nl(F.col("nl_enc"), table).alias("back")).collect()
    assert [r.nl_enc and len(r.nl_enc) for r in got] == [5, 5, None, 2, 1_200_003, 3]
    assert [r.back for r in got] == ["b a", "<unk> b", None, "", "a" * 1_200_000, "b"]
    ids = spark.createDataFrame([([2],), ([],), ([2, None, 9, 3],), (None,)], "i array<int>")
    assert [r[0] for r in ids.select(vocab.decode_nl(F.col("i"), table)).collect()] == ["", "", "<unk><unk>", None]


def test_pieces_are_returned_only_where_asked_for(spark):
    table = spark.createDataFrame([("<unk>", 1), ("a", 4)], "piece string, id int")
    plan = lambda **k: vocab.encode_nl(spark.range(1).select(F.lit("a").alias("t")), "t", table, **k)._jdf.queryExecution().toString()
    assert "pieces" not in plan() and "pieces" in plan(out_pieces="p")
