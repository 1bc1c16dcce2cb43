"""A grammar store that grows: types, orders, ids that stay, batches once."""

from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.operators import grammar, trees
from nlcorpus.session import scratch_path
from nlcorpus.sources.stores import GrammarStore


def edges_of(spark, *snippets):
    pairs = spark.createDataFrame([(i, s) for i, s in enumerate(snippets)], "id int, snippet string")
    return grammar.sentence_edges(trees.token_table(trees.parse_corpus(pairs, ("tokens", "kinds", "fields")), "id"))


def test_grammar_grows(spark):
    store = GrammarStore(spark, scratch_path(spark, "grown"))
    assert [r.label for r in store.nodes().orderBy("id").collect()] == ["<pad>", "<unk>", "<s>", "</s>"] and store.list_end() is None
    assert store.extend("one", edges_of(spark, "x = 1")) and not store.extend("one", edges_of(spark, "y = f(2)"))
    first = {(r.label, r.parent): r for r in store.nodes().collect()}
    assert first["Assign", None].node_type == "node" and first["1#literal", None].node_type == "literal"
    assert first["Assign_targets", "Assign"].node_type == "list" and first["Constant_value", "Constant"].node_type == "singleton"
    assert [first[f"Assign_{f}", "Assign"].field_order for f in ("targets", "value", "type_comment")] == [1, 2, 3]
    assert first[syntax.LIST_END, None].id == store.list_end() and first["<s>_root", "<s>"].node_type == "singleton"
    assert sorted(r.id for r in first.values()) == list(range(len(first)))
    counts = {(r.field, r.child): r.cnt for r in store.named_edges().collect()}
    assert store.extend("two", edges_of(spark, "x = g(2, k=1)", "x = 1"))
    second = {(r.label, r.parent): r for r in store.nodes().collect()}
    assert all(second[k] == r for k, r in first.items())  # what was there keeps id, type and place
    assert sorted(r.id for r in second.values()) == list(range(len(second)))
    assert [second[f"Call_{f}", "Call"].field_order for f in ("func", "args", "keywords")] == [1, 2, 3]
    again = {(r.field, r.child): r.cnt for r in store.named_edges().collect()}
    once = {(r.field, r.child): r.cnt for r in edges_of(spark, "x = g(2, k=1)", "x = 1").collect()}
    assert again == {k: counts.get(k, 0) + once.get(k, 0) for k in {**counts, **once}}
    assert sorted(r.batch for r in store.batches().collect()) == ["one", "two"]


def test_singleton_becomes_list_and_orders_go_on(spark):
    store = GrammarStore(spark, scratch_path(spark, "grown"))
    schema = "field string, child string, kind string, cnt long, first_seen struct<id:int,pos:int>"
    store.extend("a", spark.createDataFrame([("P_one", "x", "node", 1, (0, 1))], schema))
    rows = [("P_zero", "x", "node", 1, (0, 0)), ("P_one", syntax.LIST_END, "special", 2, (0, 5)), ("Q_one", "P_one", "node", 1, (1, 1))]
    store.extend("b", spark.createDataFrame(rows, schema))
    fields = {r.label: (r.node_type, r.field_order) for r in store.nodes().where("parent is not null").collect()}
    assert fields == {"P_one": ("list", 1), "P_zero": ("singleton", 2), "Q_one": ("singleton", 1)}
    assert store.nodes().where("label = 'P_one'").count() == 2  # the field, and an object of that name
    empty = store.extend("c", spark.createDataFrame([], schema))
    assert empty and store.nodes().count() == len(set(r.id for r in store.nodes().collect()))


def test_broken_version_is_not_seen(spark):
    root = scratch_path(spark, "grown")
    store = GrammarStore(spark, root)
    store.extend("a", edges_of(spark, "x = 1"))
    before = store.nodes().count()
    store.nodes().limit(1).write.parquet(f"{root}/v00000002/nodes")  # an attempt that ended early
    assert store.nodes().count() == before
    assert store.extend("b", edges_of(spark, "y = f(1)")) and store.nodes().count() > before
    assert store.nodes().agg(F.countDistinct("id")).first()[0] == store.nodes().count()
