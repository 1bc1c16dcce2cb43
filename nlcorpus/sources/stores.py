"""Persisted grammar and vocabulary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nlcorpus.functions import syntax
from nlcorpus.functions.ordered import add_ordinal
from nlcorpus.session import matching

NODES = "id long, label string, node_type string, parent string, field_order int"
EDGES = "parent_id long, child_id long, cnt long"
#: The labels that every grammar holds from the start, with the ids of the special pieces.
SPECIAL = ((0, "<pad>"), (1, "<unk>"), (2, syntax.START), (3, syntax.END))


class GrammarStore:
    """A grammar below ``root`` that grows batch by batch; what it holds keeps its ids.

    ``nodes (id, label, node_type, parent, field_order)``: objects are ``node``, ``special``, ``literal`` or ``strliteral``;
    fields are ``list`` when any batch closed them with a list end, else ``singleton``, and have the label of their parent
    and their place among its fields, by first appearance. ``edges (parent_id, child_id, cnt)`` go from a field to an
    object. A batch writes a version of its own, whose last part makes it count: a broken attempt is not seen, and a batch
    that is there already changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        done = matching(self.spark, f"{self.root}/v*/batches/_SUCCESS")
        return sorted(int(path.split("/")[-3][1:]) for path in done)

    def _part(self, name: str, schema: str) -> DataFrame:
        last = self._versions()[-1:]
        if last:
            return self.spark.read.schema(schema).parquet(f"{self.root}/v{last[0]:08}/{name}")
        first = [(i, label, "special", None, None) for i, label in SPECIAL] if name == "nodes" else []
        return self.spark.createDataFrame(first, schema)

    def nodes(self) -> DataFrame:
        return self._part("nodes", NODES)

    def edges(self) -> DataFrame:
        return self._part("edges", EDGES)

    def batches(self) -> DataFrame:
        return self._part("batches", "batch string")

    def list_end(self) -> int | None:
        """Id of the list end, once a list was seen."""
        row = self.nodes().where(F.col("label") == syntax.LIST_END).select("id").first()
        return row["id"] if row else None

    def named_edges(self) -> DataFrame:
        """``(field, field_type, parent, field_order, child, child_type, cnt)``."""
        end = lambda side: self.nodes().select(F.col("id").alias(f"{side}_id"), F.struct("*").alias(side))
        rows = self.edges().join(end("parent"), "parent_id").join(end("child"), "child_id")
        return rows.select(F.col("parent.label").alias("field"), F.col("parent.node_type").alias("field_type"), "parent.parent",
                           "parent.field_order", F.col("child.label").alias("child"), F.col("child.node_type").alias("child_type"), "cnt")

    def extend(self, batch: str, edges: DataFrame) -> bool:
        """Add the edges ``(field, child, kind, cnt, first_seen)`` of a corpus; False if ``batch`` was added before.

        A field is called ``Parent_name``. New labels get the next ids by first appearance, then label; all others keep
        theirs. Counts add up. Labels are told apart by type as well, so a field never takes the id of an object.
        """
        if not self.batches().where(F.col("batch") == batch).isEmpty():
            return False
        owner = F.substring_index("field", "_", 1)
        objects = edges.select(F.col("child").alias("label"), F.col("kind").alias("node_type"), "first_seen").unionByName(
            edges.select(owner.alias("label"), F.lit(None).cast("string").alias("node_type"), "first_seen"))
        objects = objects.groupBy("label").agg(F.coalesce(F.min("node_type"), F.lit("node")).alias("node_type"),
                                               F.min("first_seen").alias("first_seen")).withColumn("parent", F.lit(None).cast("string"))
        closed = F.max(F.col("child") == syntax.LIST_END)
        fields = edges.groupBy(F.col("field").alias("label")).agg(
            F.when(closed, "list").otherwise("singleton").alias("node_type"), F.min("first_seen").alias("first_seen"),
            F.first(owner).alias("parent"))
        seen = objects.withColumn("is_field", F.lit(False)).unionByName(fields.withColumn("is_field", F.lit(True)))
        old = self.nodes().withColumn("is_field", F.col("parent").isNotNull())
        known = old.agg(F.max("id")).first()[0]
        new = add_ordinal(seen.join(old.select("label", "is_field"), ["label", "is_field"], "left_anti"),
                          ["first_seen", "label", "is_field"], "id", start=known + 1)
        # Places go on after those that the parent's fields have; a parent has as many fields as its kind of node.
        taken = old.where("is_field").groupBy("parent").agg(F.max("field_order").alias("__taken"))
        place = F.row_number().over(Window.partitionBy("parent").orderBy("id"))
        added = new.join(taken, "parent", "left").withColumn(
            "field_order", F.when(F.col("is_field"), F.coalesce("__taken", F.lit(0)) + place).cast("int"))
        lists = seen.where("is_field and node_type = 'list'").select("label", "is_field", F.lit("list").alias("__list"))
        columns = ["id", "label", "node_type", "parent", "field_order"]
        nodes = old.join(lists, ["label", "is_field"], "left").withColumn(
            "node_type", F.coalesce("__list", "node_type")).select(*columns).unionByName(added.select(*columns))
        target = f"{self.root}/v{max(self._versions(), default=0) + 1:08}"
        nodes.write.mode("overwrite").parquet(f"{target}/nodes")
        ids = self.spark.read.schema(NODES).parquet(f"{target}/nodes")
        end = lambda side, field: ids.where(F.col("parent").isNotNull() if field else F.col("parent").isNull()).select(
            F.col("label").alias(side), F.col("id").alias(f"{side}_id"))
        coded = edges.select(F.col("field").alias("parent"), "child", "cnt").join(end("parent", True), "parent").join(
            end("child", False), "child").select("parent_id", "child_id", "cnt")
        total = self.edges().unionByName(coded).groupBy("parent_id", "child_id").agg(F.sum("cnt").alias("cnt"))
        total.write.mode("overwrite").parquet(f"{target}/edges")
        done = self.batches().unionByName(self.spark.createDataFrame([(batch,)], "batch string"))
        done.write.mode("overwrite").parquet(f"{target}/batches")
        return True


def save_grammar(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("ignore").parquet(f"{path}/nodes")
    edges.write.mode("ignore").parquet(f"{path}/edges")


def load_grammar(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def save_vocab(vocab: DataFrame, path: str) -> None:
    """Write ``(piece, id, score)``; an existing vocabulary at ``path`` is left as it is."""
    vocab.write.mode("ignore").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
