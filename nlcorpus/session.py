"""Session defaults and the shared scratch area used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = 4_000_000  # of rows handed to a worker at once; see ``bound_batches``
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "nlcorpus", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; every setting can be overridden by the caller."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    It must be set on a cluster. Only where it is unset and the master is local, where driver and executors are
    one process, a temporary folder stands in, as in tests.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="nlcorpus-")
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; never reused, so writers need no overwrite."""
    return f"{shared_dir(spark)}/nlcorpus-{uuid.uuid4().hex[:12]}-{name}"


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, in any file system that Spark can reach."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return [status.getPath().toString() for status in found or []]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage, survives lost executors, and fixes nondeterministic columns for all later readers.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt into ``spark.nlcorpus.inputPartitions`` partitions if the caller set that, else as they were read.

    For inputs of one unsplittable file on a machine with more cores; by default the reader's splits stay.
    """
    parts = df.sparkSession.conf.get("spark.nlcorpus.inputPartitions", None)
    return df.repartition(int(parts)) if parts else df


def bound_batches(spark: SparkSession) -> None:
    """Rows reach Python workers in batches of at most ``BATCH_BYTES``, unless the caller set a limit.

    By Spark's own limits a batch is 10,000 rows or 64 MB, which a task holds in the executor's direct memory and in
    its worker besides what is made of it. A longer row makes a batch of its own.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nlcorpus-code-")) / "nlcorpus.zip"
    with zipfile.ZipFile(archive, "w") as bundle:
        for source in sorted(root.rglob("*.py")):
            bundle.write(source, source.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))
    _SHIPPED.add(app)
