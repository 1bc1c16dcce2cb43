"""Segmentation against a plain reading of its rules on random and hand-made notebooks."""

import random

from nlcorpus.operators import clean, segment
from nlcorpus.sources import notebooks


def plain_pairs(cells):
    """Runs of text followed by runs of code, irregular cells ignored."""
    cells = [c for c in cells if c[0] in ("markdown", "code")]
    blocks, last = [], None
    for kind, text in cells:
        if kind == "markdown" and last != "markdown":
            blocks.append(([], []))
        if blocks:
            blocks[-1][kind == "code"].append(text)
        last = kind
    joined = [("\n".join(m), "\n".join(c)) for m, c in blocks]
    return [(m, c) for m, c in joined if m and c]


def cell_frame(spark, books):
    rows = [(nb, i, kind, text) for nb, cells in books.items() for i, (kind, text) in enumerate(cells)]
    return spark.createDataFrame(rows, "nb long, pos long, cell_type string, text string")


def test_random_notebooks(spark):
    rnd = random.Random(11)
    books = {nb: [(rnd.choice(["markdown", "code", "raw"]), rnd.choice(["", f"t{i}", f"u{i}"]))
                  for i in range(rnd.randint(1, 14))] for nb in range(60)}
    cells = cell_frame(spark, books)
    got = segment.pair_ids(segment.cells_to_pairs(cells), cells).collect()
    expected = {f"{nb + 1}_{i}": pair for nb, cs in books.items() for i, pair in enumerate(plain_pairs(cs), 1)}
    assert {r.id: (r.intent, r.snippet) for r in got} == expected


def test_nested_records(spark):
    md = lambda t: {"cell_type": "markdown", "nl_original": t, "code": None}
    code = lambda t: {"cell_type": "code", "nl_original": None, "code": t}
    raw = {"cell_type": "raw", "nl_original": "r", "code": "r"}
    books = [("a", [], "target"),  # no context, no pair
             ("b", [md("text"), code("lead")], "target"),  # leading code dropped (nearest first)
             ("c", [code("two"), raw, code("one"), md("m")], "three")]  # raw cell does not break the run
    frame = spark.createDataFrame(books, notebooks.NOTEBOOK_SCHEMA)
    got = segment.cells_to_pairs(notebooks.notebook_cells(frame)).collect()
    assert sorted((r.nb, r.intent, r.snippet) for r in got) == [("b", "text", "target"), ("c", "m", "one\ntwo\nthree")]
    irregular = clean.irregular_cells(notebooks.notebook_cells(frame)).collect()
    assert [(r.cell_type, r.n) for r in irregular] == [("raw", 1)]
