"""Fill-in-the-middle against plain Python on code points, and round trips."""

import hashlib
import random
import re

import numpy as np
import pytest

from nlcorpus.llm import infill

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text, seed=42, rate=50, first=80, unit="token"):
    text = text or ""
    units = TOKEN.findall(text) if unit == "token" else list(text)
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]
    i, j = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:i], units[i:j], units[j:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    spm = h[3] % 100 < first
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), "spm" if spm else "psm", len(prefix), len(middle), out


def samples():
    random.seed(11)
    alphabet = ["a", "Z", " ", "\n", "\t", "é", "ß", "汉", "😀", "<", "P", ">", "S", "M", "\x0b", "\x00", " "]
    rows = [(i, "".join(random.choices(alphabet, k=random.randrange(40)))) for i in range(900)]
    return rows + [(1000, None), (1001, ""), (1002, "   "), (1003, "x" * 300_000), (1004, "汉 " * 90_000), (1005, "a <P> b"),
                   (None, "no key at all"), (1008, "twice"), (1008, "twice"), (1006, "<<S<P"), (1007, "ends with space ")]


@pytest.mark.parametrize("recipe", [infill.Recipe(), infill.Recipe(seed=7, rate=100, suffix_first=30),
                                    infill.Recipe(rate=100, unit="char")], ids=["given", "always", "chars"])
def test_transform(spark, recipe):
    rows = samples()
    docs = spark.createDataFrame([(*r, "f", "o") for r in rows], "doc_id long, text string, form string, output string")
    changed = infill.restore(infill.transform(docs.repartition(3), recipe)).collect()
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in changed), key=str)
    want = sorted(((k, *brute(k, t, recipe.seed, recipe.rate, recipe.suffix_first, recipe.unit)) for k, t in rows), key=str)
    assert got == want
    texts = {k: t or "" for k, t in rows}
    assert all(r["restored"] == texts[r["doc_id"]] for r in changed)


def test_cases(docs, empty):
    rows = infill.restore(infill.transform(docs)).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert len(rows) == 15
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute(r["doc_id"], texts[r["doc_id"]])
    assert infill.restore(infill.transform(empty)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(docs, infill.Recipe(unit="line"))


def test_restore_keeps_columns(spark):
    rows = [(1, "<P>a<S>c<M>b", "psm", "old"), (2, "<S>c<P>a<M>b", "spm", "old"), (3, "abc", "plain", "old"), (4, None, "psm", "old")]
    frame = spark.createDataFrame(rows, "k int, output string, form string, restored string")
    out = infill.restore(frame)
    assert out.columns == ["k", "output", "form", "restored"]
    assert [r["restored"] for r in out.orderBy("k").collect()] == ["abc", "abc", "abc", None]


def test_exception_index():
    text = "aé汉😀 b" * 50 + "plain tail"
    data = np.frombuffer(text.encode(), np.uint8)
    index = infill.Exceptions(data)
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert index.chars(places).tolist() == list(range(len(text) + 1))
    assert index.bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    assert len(index.at_byte) == 150  # only the multibyte characters are recorded
