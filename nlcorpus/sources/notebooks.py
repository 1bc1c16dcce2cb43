"""Nested notebook records and their cell table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nlcorpus.sources.files import read_json

NOTEBOOK_SCHEMA = ("nb string, context array<struct<cell_type:string,nl_original:string,code:string>>, "
                   "code string")


def read_notebooks(spark: SparkSession, path: str) -> DataFrame:
    """Notebook records; ``context`` holds the preceding cells nearest first, ``code`` the target cell."""
    return read_json(spark, path, NOTEBOOK_SCHEMA)


def notebook_cells(notebooks: DataFrame, id_column: str = "nb") -> DataFrame:
    """``(nb, pos, cell_type, text)`` in reading order, the target code last.

    A notebook with an empty context yields no cell, as it cannot form a pair.
    """
    context = F.transform(F.reverse("context"), lambda c: F.struct(
        c["cell_type"].alias("cell_type"),
        F.when(c["cell_type"] == "markdown", c["nl_original"])
        .when(c["cell_type"] == "code", c["code"]).alias("text")))
    target = F.array(F.struct(F.lit("code").alias("cell_type"), F.col("code").alias("text")))
    return (notebooks.where(F.size("context") > 0)
            .select(F.col(id_column).alias("nb"), F.posexplode(F.concat(context, target)).alias("pos", "c"))
            .select("nb", F.col("pos").cast("long").alias("pos"), "c.cell_type", "c.text"))
