"""Operators against plain Python on small inputs."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from nlcorpus.llm import boosted, crf, fertility, jaccard, semantic, spans, suffixes
from nlcorpus.llm.common import components, shingle_codes

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.collect()}


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(260)] + [(7, 7), (1000, 1001), (None, 5)]
    edges += [(i, i + 1) for i in range(2000, 2050)] + [(3000, i) for i in range(3001, 3100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((root(a), root(b)))
            parent[hi] = lo
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == {x: root(x) for x in parent}


def test_base_measures(documents, texts):
    from nlcorpus.llm.queries import piece_model

    for row in fertility.judge(documents, piece_model()).collect():
        text = texts[row["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
        covered = {i + j for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for j in range(3)}
        seen, repeated = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                repeated += line in seen
                seen.add(line)
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered))
        assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["kept"] and row["base_failed"])


def test_block_entropy():
    rng = np.random.default_rng(1)
    lists = [rng.integers(0, 9, n) for n in (0, 1, 10, 64, 65, 128, 200, 0)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists])])

    def entropy(ids):
        return -sum(c / len(ids) * math.log2(c / len(ids)) for c in Counter(ids.tolist()).values())

    want = []
    for ids in lists:
        blocks = [ids[i:i + 64] for i in range(0, len(ids) // 64 * 64, 64)] or [ids]
        want.append(sum(entropy(b) for b in blocks) / len(blocks) if len(ids) else 0.0)
    assert fertility.block_entropy(np.concatenate(lists), bounds) == pytest.approx(want)


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for match in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", match.group())
            fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in match.group().split(".")),
                    "card": 14 <= len(digits) <= 19 and crf.luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if fits:
                out.append((match.start(), match.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(BASE).index(s[2]), s[1]))


def test_base_spans(texts):
    random.seed(5)
    made = ["".join(random.choice("a1.@+-() 25é_") for _ in range(60)) for _ in range(4000)]
    made += ["a@b.c_d@e.f", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "0001.2.3.255", "4111 1111-1111 1111", "+1+1 (212) 555 0143-"]
    for text in [*texts.values(), *made]:
        assert crf.base_spans(text) == plain_base(text), text


def test_base_spans_on_long_runs_of_digits():
    zeros, nines = "0" * 5000, "9" * 5000
    assert crf.base_spans(f"{zeros}7.{zeros}.255.{zeros}1") == [(0, 15_008, "ip")]
    assert crf.base_spans(f"{zeros}256.1.1.1") == crf.base_spans(f"1.1.1.{nines}") == crf.base_spans(zeros + nines) == []


def test_field_decoder_is_exact(texts):
    model = crf.train(crf.LABELLED.strip().split("\n"))
    decoder = crf.Decoder(model)
    for row in crf.LABELLED.strip().split("\n"):  # it has learnt its table
        words, labels = crf.parse(row)
        places, found = decoder.labels(words, np.arange(len(words)) == 0)
        assert [labels[p] for p in np.flatnonzero(labels)] == list(found) and list(np.flatnonzero(labels)) == list(places)

    def viterbi(words):
        rows = [model.word(w) for w in words]
        emit = [r[0] + (rows[i - 1][1] if i else 0) + (rows[i + 1][2] if i + 1 < len(rows) else 0) for i, r in enumerate(rows)]
        best, back = emit[0] + model.moves[0], []
        for e in emit[1:]:
            ways = best[:, None] + model.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + e
        path = [int(best.argmax())]
        for came in reversed(back):
            path.append(int(came[path[-1]]))
        return path[::-1]

    random.seed(6)
    pool = [w for row in crf.LABELLED.split() for w in [re.sub(r"\[\w+\||\]", "", row)] if w] + ["zzz", "12b", "+1", "|", "a@b"]
    samples = [t.split()[:400] for t in texts.values()] + [random.choices(pool, k=30) for _ in range(200)]
    for words in filter(None, samples):
        places, labels = decoder.labels(words, np.arange(len(words)) == 0)
        got = np.zeros(len(words), int)
        got[places] = labels
        assert list(got) == viterbi(words)


def test_boosted_learns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(boosted.FEATURES)))
    y = ((x[:, 3] > 0.3) ^ (x[:, 5] > 0)).astype(float)
    scores = boosted.fit(x[:2000], y[:2000]).scores(x[2000:])
    assert ((scores > 0.5) == y[2000:]).mean() > 0.95
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = boosted.score(spark.read.parquet(f"{folder}/documents.parquet"), labels).join(labels, "doc_id").where("held_out")
    rows = scored.collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95


def test_signatures_meet():
    """Any two linked sets show a common signature, whatever the counts say."""
    rng = np.random.default_rng(4)
    for trial in range(400):
        size = int(rng.integers(1, 160))
        one = rng.choice(2**62, size, replace=False).astype(np.uint64)
        two = one[rng.random(size) < rng.uniform(0.75, 1)]
        two = np.concatenate([two, rng.choice(2**62, int(rng.integers(0, size // 4 + 1))).astype(np.uint64)])
        one, two = np.unique(one), np.unique(two)
        common = len(np.intersect1d(one, two))
        if not len(two) or 100 * common < 75 * (len(one) + len(two) - common):
            continue
        both = np.union1d(one, two)
        counts = np.where(rng.random(len(both)) < rng.uniform(0, 1.2), rng.integers(40, 3000, len(both)), 0)
        shown = [set(jaccard.signatures(s, counts[np.searchsorted(both, s)], 640)[0].tolist()) for s in (one, two)]
        assert shown[0] & shown[1]


def brute_classes(texts):
    sets = {}
    for name, text in texts.items():
        words = text.encode().lower().split()
        sets[name] = {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    label = {name: name for name in texts}
    holders = {}
    for name, own in sets.items():
        for shingle in own:
            holders.setdefault(shingle, []).append(name)
    pairs = {p for names in holders.values() for p in itertools.combinations(sorted(names), 2)}
    changed = True
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {name: (len(sets[name]), label[name]) for name in texts}


def test_classes_of_large_groups(spark, monkeypatch):
    """Groups beyond the direct limit, copies that differ in steps, and texts that share a passage only."""
    monkeypatch.setattr(jaccard, "DIRECT", 6)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 8)
    random.seed(8)
    passage = [f"p{i}" for i in range(40)]
    base = [f"b{i}" for i in range(80)]
    texts = {}
    for i in range(60):  # a chain of near copies of one text
        words = list(base)
        for j in random.sample(range(80), random.choice((0, 1, 1, 2, 3, 6))):
            words[j] = f"x{random.randrange(10**6)}"
        texts[i] = " ".join(words)
    for i in range(60, 110):  # a common passage, more or less of something else
        words = passage + [f"y{i}-{j}" for j in range(random.choice((0, 2, 8, 30, 60)))]
        texts[i] = " ".join(words)
    for i in range(110, 140):
        texts[i] = texts[random.randrange(110)]
    found = jaccard.link_classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute_classes(texts)


def test_meetings_are_linear(spark):
    """A group of many sets gives a row a member, with partners whose sizes allow a link; a small one all its pairs."""
    sizes = sorted(random.Random(3).choices(range(20, 60), k=300))
    rows = [(1, n, i, i, True) for i, n in enumerate(sizes)] + [(2, 30, i, i, False) for i in range(5)]
    rows += [(2, 30, 4, 9, False)]  # an equal set with a greater key
    frame = spark.createDataFrame(rows, "sig long, n int, fp long, k long, combined boolean")
    found = jaccard.meetings(frame.coalesce(1).sortWithinPartitions("sig", "n", "fp", "k")).collect()
    wide = [r for r in found if r["sig"] is not None]
    assert sorted(r["a"] for r in wide) == list(range(300))
    for r in wide:
        for size in (r["nb"], r["nc"]):
            assert size is None or 75 * max(size, r["na"]) <= 100 * min(size, r["na"])
        assert r["a"] == 0 or r["b"] is not None or r["c"] is not None  # some size is near everywhere here
    assert {(r["a"], r["b"]) for r in found if r["sig"] is None} == set(itertools.combinations(range(5), 2))


def test_linked_pairs(monkeypatch):
    """Matrix products over a few shingles at a time give what sets give."""
    monkeypatch.setattr(jaccard, "COLUMNS", 16)
    rng = random.Random(5)
    base = list(range(1, 90))
    sets = [set(rng.sample(base, rng.randrange(60, 89))) | {1000 + i for i in range(rng.choice((0, 3, 9)))} for _ in range(40)]
    sets += [{5000 + i} for i in range(3)]
    marks = np.array([i % 3 for i in range(len(sets))])
    one, two = jaccard.linked_pairs([np.array(sorted(x), dtype=np.uint64) for x in sets], marks)
    assert set(zip(one.tolist(), two.tolist())) == {
        (a, b) for a, b in itertools.combinations(range(len(sets)), 2)
        if marks[a] != marks[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}


def test_links_between_main_components(spark):
    """Two families, each one component of its own: what links their members is still found, in blocks of any kind."""
    shared = [f"s{i}" for i in range(58)]
    texts = {}
    for side in range(2):
        words = shared + [f"t{side}-{i}" for i in range(12)]
        for i in range(80):
            own = list(words)
            own[-1 - i % 3] = f"x{side}-{i}"
            texts[100 * side + i] = " ".join(own)
        texts[100 * side + 80] = " ".join(words[:66])  # only these two link across
    assert brute_classes({k: t for k, t in texts.items() if k not in (80, 180)})[100][1] == 100
    members = [(k, [7, 100 + k // 100], k // 100 * 100) for k in texts]
    found = jaccard.crossing(spark.createDataFrame(members, "k long, sigs array<long>, component long"),
                             spark.createDataFrame([(k, k // 100) for k in texts], "k long, family long"),
                             spark.createDataFrame(list(texts.items()), "k long, t string")).collect()
    assert {(r["a"], r["b"]) for r in found} == {(80, 180)}
    assert {c for _, c in brute_classes(texts).values()} == {0}


def test_suffix_tree(spark, documents, texts):
    rows = {r["doc_id"]: r for r in suffixes.score(documents).collect()}
    counts = Counter()
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    for name, own in tokens.items():
        if zlib.crc32(str(name).encode()) % 7 != 2:
            counts.update(own)
    total, distinct = sum(counts.values()), len(counts)
    for name, own in tokens.items():
        row = rows[name]
        assert row["n_tokens"] == len(own) and row["n_known"] == sum(w in counts for w in own)
        assert row["train_tokens"] == total
        assert row["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in own))
    held = [r for r in suffixes.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_texts_are_split_once_for_symbols_and_rare_words(spark):
    docs = spark.createDataFrame([(1, "a b B zz zz q", False), (1, "zz", False), (None, None, True)], "k long, t string, held boolean")
    codes = suffixes.WordCodes()([b"a", b"b"])
    order = np.argsort(codes)
    words = suffixes.Words(codes[order], np.array([5, 9])[order], np.array([2, 3])[order], 3, 20, 4)
    table = suffixes.coded(docs, words)
    rare = [[tuple(x) for x in r.rare] for r in table.collect()]
    assert rare == [[("zz", 2), ("q", 1)], [("zz", 1)], []]
    rows = suffixes.rare_words(table).collect()
    assert sorted((r.word, r.tf) for r in rows if r.word[0] != "\n") == [("q", 1), ("zz", 1), ("zz", 2)]
    assert len({r.word for r in rows if r.word[0] == "\n"}) == 2


def test_suffix_tree_sums_to_one():
    words = suffixes.Words(np.arange(3, dtype=np.uint64), np.array([50, 30, 20]), np.array([2, 3, 4]), 10, 150, 9)
    root = words.roots()
    tree = suffixes.Tree(words.alphabet, np.log10(root), [np.array([2, 3])], [np.array([1, 2])], np.array([0, 0, 0]),
                         np.zeros(3), np.empty(0, np.int64), np.empty(0))
    listed = {1: {3: 20, 4: 10}, 2: {2: 25}}
    for state, following in listed.items():
        total = 50 if state == 1 else 30
        rest = total - sum(following.values())
        tree.escape[state] = math.log10((rest + 1) / (total + 1) / (1 - sum(root[s] for s in following)))
        for symbol, count in following.items():
            tree.entries = np.append(tree.entries, state * words.alphabet + symbol)
            tree.values = np.append(tree.values, math.log10(count / (total + 1)))
    order = np.argsort(tree.entries)
    tree.entries, tree.values = tree.entries[order], tree.values[order]
    for state in range(3):
        logs = tree.logs(np.full(words.alphabet, state), np.arange(words.alphabet))
        assert (10.0 ** logs).sum() == pytest.approx(1)


def test_spans_against_brute_force(spark, documents, texts):
    found = {r["doc_id"]: r for r in spans.remove_repeats(documents).collect()}
    seen, gone = set(), {}
    for name in sorted(texts):
        cut = spans.sentences(texts[name])
        assert "".join(cut) == texts[name]
        solid = [(i, " ".join(s.encode().lower().decode().split(" "))) for i, s in enumerate(cut)]
        plain = [(i, b" ".join(cut[i].encode().lower().split())) for i, _ in solid]
        plain = [(i, s) for i, s in plain if s]
        for a in range(len(plain)):
            b = a + 3
            while b <= len(plain) and sum(len(s.split()) for _, s in plain[a:b]) < 10:
                b += 1
            if b > len(plain):
                continue
            span = tuple(s for _, s in plain[a:b])
            if span in seen:
                gone.setdefault(name, set()).update(range(plain[a][0], plain[b - 1][0] + 1))
            seen.add(span)
        left = "".join(s for i, s in enumerate(cut) if i not in gone.get(name, ()))
        assert found[name]["text"] == left and found[name]["n_removed"] == len(gone.get(name, ()))


def test_passages_inside_sentences(spark):
    """The second copy of 51 words without marks goes wherever it stands in a sentence, and nothing else does."""
    random.seed(12)
    texts, passages = {}, {}
    for i in range(60):
        passages[i] = [f"p{i}-{j}" for j in range(51)]
        for copy in range(2):
            sides = [[f"s{i}-{copy}-{side}-{j}" for j in range(random.randrange(30))] for side in range(2)]
            texts[2 * i + copy] = " ".join(sides[0] + passages[i] + sides[1])
    found = {r["doc_id"]: r for r in spans.remove_repeats(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, words in passages.items():
        assert found[2 * i]["n_removed"] == 0 and found[2 * i]["text"] == texts[2 * i]
        left = found[2 * i + 1]["text"].split()
        assert len(set(words) & set(left)) <= 51 - 18
        assert [w for w in texts[2 * i + 1].split() if w not in words] == [w for w in left if w not in words]


def test_retrieval_recall(spark):
    """Against a look at every passage and item: nine of ten leaks are found, and nothing that is none."""
    folder = "/root/testdata/sf0.01"
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]) for r in semantic.leaks(docs, bench).collect()}
    items = semantic.read_items(bench)
    want = set()
    for row in docs.collect():
        words = np.array([items.vocabulary.get(w, -1) for w in semantic.item_words(row["text"])])
        held = Counter(words.tolist())
        for key, pattern, answer in zip(items.keys, items.words, items.answers):
            if sum(min(c, held[w]) for w, c in Counter(pattern.tolist()).items()) < semantic.SOME * len(pattern):
                continue
            for passage in range(max(1, -(-len(words) // semantic.BLOCK) - 1)):
                window = words[max(0, passage * 24 - len(pattern)):(passage + 2) * 24 + len(pattern)]
                if semantic.judge(pattern, answer, window)[2]:
                    want.add((row["doc_id"], key))
    assert want and found <= want and len(found) >= 0.9 * len(want)
    gone = {" ".join(semantic.item_words(r["text"])): r["item_id"] for r in bench.collect()}
    for row in docs.collect():  # whole items are always found
        plain = " ".join(semantic.item_words(row["text"]))
        for text, key in gone.items():
            assert text not in plain or (row["doc_id"], key) in found


def test_common_subsequence():
    random.seed(9)
    for _ in range(300):
        a = [random.randrange(6) for _ in range(random.randrange(1, 70))]
        b = [random.randrange(-1, 6) for _ in range(random.randrange(0, 120))]
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, j in itertools.product(range(len(a)), range(len(b))):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert semantic.in_order(np.array(a), np.array(b)) == table[-1][-1]


def test_shingles():
    codes = np.arange(9, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert len(shingle_codes(codes)) == 5 and len(shingle_codes(codes[:3])) == 1 and not len(shingle_codes(codes[:0]))
    assert not np.intersect1d(shingle_codes(codes[:4]), shingle_codes(codes))[:].size


def test_personal_data_query(spark, texts):
    """Counts, digest and spans of the query against the plain rules."""
    import hashlib

    from nlcorpus.llm.queries import QUERIES

    for row in QUERIES["op3_field_pii"](spark, FOLDER).collect():
        base = plain_base(texts[row["doc_id"]])
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[2] == k for s in base) for k in BASE]
        listed = ",".join(f"{k}:{a}:{b}" for a, b, k in base)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


def test_sketches_rule_out_only_pairs_that_are_not_linked(spark):
    rnd = np.random.default_rng(5)
    ruled = {True: 0, False: 0}
    for size in (1, 3, 40, 64, 65, 300, 2000):
        for share in (0.0, 0.3, 0.6, 0.74, 0.75, 0.76, 0.8, 0.99):
            for other in (size, max(1, int(size * 0.8)), size * 2):
                common = min(int(share * (size + other) / (1 + share)), size, other)
                pool = rnd.integers(0, 2 ** 64, size + other, dtype=np.uint64)
                one, two = np.sort(pool[:size]), np.sort(pool[size - common:size - common + other])
                linked = 100 * common >= 75 * (size + other - common)
                out = jaccard.ruled_out(jaccard.sketch(one), jaccard.sketch(two), size + other)
                assert not (linked and out) and jaccard.ruled_out(jaccard.sketch(two), jaccard.sketch(one), size + other) == out
                ruled[linked] += out
                assert out or share or size < 40  # sets without a common shingle are told apart
    assert ruled[False] > 60
    sets = {1: rnd.integers(0, 2 ** 64, 300, dtype=np.uint64)}
    sets[2] = np.append(sets[1][:290], rnd.integers(0, 2 ** 64, 9, dtype=np.uint64))
    sets[3] = rnd.integers(0, 2 ** 64, 310, dtype=np.uint64)
    rows = [(k, len(c), bytearray(jaccard.sketch(c))) for k, c in sets.items()] + [(3, 300, bytearray(jaccard.sketch(sets[1])))]
    sketches = spark.createDataFrame(rows, "k long, n long, bits binary")
    pairs = spark.createDataFrame([(1, 2, 5), (2, 3, 6), (1, 4, 7)], "a long, b long, m long")
    assert sorted(tuple(r) for r in jaccard.plausible(pairs, sketches).collect()) == [(1, 2, 5), (2, 3, 6)]
    assert [tuple(r) for r in jaccard.plausible(pairs, sketches.where("n <> 300 or k <> 3")).collect()] == [(1, 2, 5)]


def test_only_wanted_texts_leave_their_place(spark):
    texts = spark.createDataFrame([(k, f"text {k}") for k in range(5000)] + [(7, "text 7"), (7, "other"), (None, "none")],
                                  "k long, t string").coalesce(2)
    keys = spark.createDataFrame([(7,), (7,), (4000,), (9999,)], "k long")
    found = jaccard.texts_of(texts, keys)
    assert sorted(tuple(r) for r in found.collect()) == [(7, "other"), (7, "text 7"), (4000, "text 4000")]
    assert jaccard.texts_of(texts, keys.limit(0)).count() == 0
