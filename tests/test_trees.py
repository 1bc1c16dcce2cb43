"""Parsing and tree walks on hand-made snippets, checked by independent readings of the tree."""

import ast

from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.operators import clean, grammar, trees

SNIPPETS = [
    "q7 = scale(3.0, tax=0.05)", "global a, b", "x = [1, 'two', None, b'3']", "def f(a, *b, c=1, **d) -> int:\n  return a",
    "class A(B):\n  '''doc'''\n  x: int = 0", "for i in range(3):\n  print(f'{i}!')", "lambda x: x['k']", "", "''",
    "try:\n  pass\nexcept (A, B) as e:\n  raise", "{1: 'a', **d}", "import a.b as c, d", "x = 1 if y else 'é'", "match x:\n  case [1, *_]: pass",
]
BROKEN = ["f(", "a b", "x = \x00"]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id int, snippet string")


def flat_tokens(node):
    """Independent reading: recursive lists from the tree itself."""
    out = [type(node).__name__]
    for _, value in ast.iter_fields(node):
        if isinstance(value, ast.expr_context):
            continue
        for item in value if isinstance(value, list) else [value]:
            if isinstance(item, ast.AST):
                out += flat_tokens(item)
            elif isinstance(item, (str, bytes)):
                out += (["<strtoken>"] if isinstance(value, list) else []) + [ascii(item) + "#strliteral", "</l>"]
            else:
                out.append(ascii(item) + "#literal")
        if isinstance(value, list):
            out.append("</l>")
    return out


def test_linearised_tokens(spark):
    rows = trees.parse_corpus(frame(spark, SNIPPETS + BROKEN), ("tokens",))
    got = {r.id: r.t for r in rows.withColumn("t", trees.linearised(F.col("tokens"))).collect()}
    for i, text in enumerate(SNIPPETS):
        assert got[i] == flat_tokens(ast.parse(text))
    assert all(got[len(SNIPPETS) + i] is None for i in range(len(BROKEN)))
    assert " ".join(got[1]) == ("Module Global <strtoken> 'a'#strliteral </l> <strtoken> 'b'#strliteral </l> </l> "
                                "</l> </l>")
    assert sorted(r.id for r in trees.failed_ids(rows, "id").collect()) == [
        len(SNIPPETS) + i for i in range(len(BROKEN))]


def test_string_parts(spark):
    rows = trees.parse_corpus(frame(spark, SNIPPETS), ("tokens",))
    got = {r.id: (r.s, r.p) for r in rows.select(
        "id", trees.string_values(trees.only_strings(F.col("tokens"))).alias("s"),
        trees.without_strings(F.col("tokens")).alias("p")).collect()}
    assert got[2][0] == ["x", "two", "3"]
    assert got[12][0] == ["x", "y", "é"]
    assert not any(t.endswith("#strliteral") for _, p in got.values() for t in p)


def test_positions_and_counts_describe_the_same_tree(spark):
    for r in trees.parse_corpus(frame(spark, SNIPPETS)).collect():
        assert len(r.tokens) == len(r.paths) == len(r.kinds) == len(r.fields)
        assert len({tuple(p) for p in r.paths}) == len(r.paths)  # every token has its own place
        # Pre-order is the order of root-first paths.
        assert [p[::-1] for p in r.paths] == sorted(p[::-1] for p in r.paths)
        places = {tuple(p): t for p, t in zip(r.paths, r.tokens)}
        for path, token, field in zip(r.paths, r.tokens, r.fields):
            if len(path) > 1:
                assert field.startswith(places[tuple(path[2:])] + "_")
        # A token's number of fields is the largest field ordinal below it.
        below = {}
        for path in r.paths:
            if len(path) > 2:
                below[tuple(path[2:])] = max(below.get(tuple(path[2:]), 0), path[1])
        nodes = [(e.label, e.cnt) for e in r.edge_counts if e.type in trees.TOKEN_KINDS]
        assert nodes == [(t, below.get(tuple(p), 0)) for t, p in zip(r.tokens, r.paths)]
        assert r.max_depth == max(map(len, r.paths)) - 1
        assert r.roundtrip_ok


def test_list_counts_include_the_end(spark):
    r = trees.parse_corpus(frame(spark, ["f(1, 2)"]), ("edge_counts",)).first()
    counts = {e.label: e.cnt for e in r.edge_counts if e.type == "list"}
    assert counts == {"Module_body": 2, "Name_id": 2, "Call_args": 3, "Call_keywords": 1, "Module_type_ignores": 1}


def test_piece_level_literals(spark):
    ids = {p: i for i, p in enumerate(["<pad>", "<unk>", "<s>", "</s>", "▁ab", "a", "b", "▁"])}
    r = trees.parse_corpus(frame(spark, ["ab('', 'ab b')"]), ("tokens", "edge_counts"), piece_ids=ids).first()
    text = [t for t in r.tokens if t.endswith("#strliteral") or t == "</l>"]
    assert text[:2] == ["▁#strliteral", "a#strliteral"]  # no merge to "▁ab" without its parts "▁a"
    assert "#strliteral" in text  # the empty string is one empty piece
    assert [e.cnt for e in r.edge_counts if e.label == "Constant_value"] == [2, 6]


def test_grammar_tables(spark):
    parsed = trees.parse_corpus(frame(spark, ["f(1)", "f('a', b)"]), ("tokens", "kinds", "fields"))
    edges = grammar.sentence_edges(trees.token_table(parsed, "id"))
    seen = {(r.field, r.child): r.cnt for r in edges.collect()}
    assert seen["Call_args", "Constant"] == 2 and seen["Call_args", "Name"] == 1 and seen["Call_args", "</l>"] == 2
    kinds = {r.field: r.kind for r in grammar.field_kinds(edges).collect()}
    assert kinds["Call_args"] == "list" and kinds["Call_func"] == "singleton" and kinds["Constant_value"] == "list"
    rows = grammar.field_children(edges, "child").collect()
    assert sorted(r.allowed for r in rows if r.field == "Constant_value" and not r.in_text) == [
        "'a'#strliteral", "1#literal", "</l>"]
    assert [r.in_text for r in rows if r.field == "Constant_kind"] == [False]
    steps = parsed.select(grammar.next_fields(F.col("fields"), F.col("kinds")).alias("n"), "tokens").first()
    assert steps.n[-1] is None and steps.n[0].field == "<s>_root" and not steps.n[0].in_text
    after_name = steps.n[steps.tokens.index("'f'#strliteral")]
    assert after_name.field == "Name_id" and after_name.in_text


def test_normalise(spark):
    df = spark.createDataFrame([("a=1",), ("f(",), (None,)], "c string")
    kept = [r[0] for r in df.select(clean.normalise_code(F.col("c"))).collect()]
    strict = [r[0] for r in df.select(clean.normalise_code_or_null(F.col("c"))).collect()]
    assert kept == ["a = 1", "f(", None] and strict == ["a = 1", None, None]


def test_literal_text_and_canonical_order(spark):
    df = spark.createDataFrame([(["▁ab", "c", "▁d"],), (["x▁y"],), ([],)], "p array<string>")
    assert [r[0] for r in df.select(trees.literal_text(F.col("p"))).collect()] == ["abc d", "x y", ""]
    assert [r[0] for r in df.select(trees.literal_text(F.col("p"), False)).collect()] == [" abc d", "x y", ""]
    kids = [(1, 1, "and", n, i) for i, n in enumerate(["to", "z", "from", "a", "flight"])] + [
        (1, 2, "list", n, i) for i, n in enumerate(["b", "a"])]
    rows = spark.createDataFrame(kids, "r int, pk int, parent string, name string, i int")
    got = trees.canonical_order(rows, "r", "pk", "parent", "name", "i").orderBy("pk", "new_index").collect()
    assert [r.name for r in got] == ["flight", "from", "to", "a", "z", "b", "a"]


def test_deep_code_is_a_failure_not_an_error(spark):
    deep = "(" * 90 + "1" + ")" * 90
    chain = "a" + ".b" * 3000
    rows = trees.parse_corpus(frame(spark, [deep, chain, "ok"]), ("tokens",)).collect()
    assert [r.parse_ok for r in sorted(rows, key=lambda r: r.id)][2]
    assert syntax.parse("x = = 1") is None


def test_copies_are_parsed_once_a_task(spark, monkeypatch):
    """Texts that come again in later batches are neither parsed nor converted again; forgetting changes no row."""
    seen = spark.sparkContext.accumulator(0)
    once = trees._profile

    def counted(text, walk, want):
        seen.add(1)
        return once(text, walk, want)

    monkeypatch.setattr(trees, "_profile", counted)
    texts = [*SNIPPETS, *BROKEN, *[f"q{i} = {i}" for i in range(6_000)]]
    rows = spark.createDataFrame(list(enumerate(texts * 3)), "id int, snippet string").coalesce(1)
    parsed = trees.parse_corpus(rows, ("tokens", "paths"))
    got = {r.id: (r.parse_ok, r.tokens, r.paths) for r in parsed.collect()}
    assert len(texts) <= seen.value <= len(texts) + 1
    assert all(got[i] == got[i + len(texts)] == got[i + 2 * len(texts)] for i in range(len(texts)))
    monkeypatch.setattr(trees, "MEMO_TEXTS", 5)
    assert got == {r.id: (r.parse_ok, r.tokens, r.paths) for r in trees.parse_corpus(rows, ("tokens", "paths")).collect()}


def test_copies_are_counted_before_parsing(spark, monkeypatch):
    """E6 and E7 hand every distinct text on once, with how often it is there."""
    from types import SimpleNamespace

    from nlcorpus.plans import catalog_trees

    items = [(o, n, 1.5, 0.25) for o in range(1, 41) for n in (1, 2)] + [(50, 1, 1.5, 0.25)]
    t = SimpleNamespace(lineitem=spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_quantity double, l_tax double"))
    given, once = [], trees.parse_corpus
    monkeypatch.setattr(trees, "parse_corpus", lambda df, *a: given.append(df.count()) or once(df, *a))
    edges = {(r.label, r.cnt): r.n for r in catalog_trees.edge_counts(t).collect()}
    assert edges["Name", 1] == 160 and edges["'q2'#strliteral", 0] == 40 and edges["1.5#literal", 0] == 80
    places = catalog_trees.tree_positions(t).collect()
    assert {r.l_linenumber for r in places} == {1, 2} and {r.n for r in places} == {40}
    assert given == [3, 3]
