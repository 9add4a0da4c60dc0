"""Session settings, shipping the package to executors, and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"
_BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(app_name: str = "weekloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC clocks."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # One numpy thread per task: Spark already fills the cores.
        .config("spark.executorEnv.OMP_NUM_THREADS", "1")
        .config("spark.executorEnv.OPENBLAS_NUM_THREADS", "1")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    context = spark.sparkContext
    if getattr(context, "_weekloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="weekloom-ship-")) / "weekloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, str(source.relative_to(root.parent)))
    context.addPyFile(str(archive))
    context._weekloom_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Where the setting is absent a folder is made only on a local master, as in tests; on a cluster
    a machine-local folder would be lost with its machine, so the setting is required there.
    """
    configured = spark.conf.get(_CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
    context = spark.sparkContext
    if not hasattr(context, "_weekloom_checkpoint"):
        context._weekloom_checkpoint = tempfile.mkdtemp(prefix="weekloom-checkpoint-")
    return context._weekloom_checkpoint


@contextmanager
def stage_folder(spark: SparkSession) -> Iterator[str]:
    """All tables written inside go to one folder, which is removed at the end, also after a failure.

    Nothing lazy that reads such a table may outlive the block.
    """
    context = spark.sparkContext
    outer = getattr(context, "_weekloom_stage", None)
    folder = f"{outer or checkpoint_root(spark) + '/weekloom'}/stage-{uuid.uuid4().hex}"
    context._weekloom_stage = folder
    try:
        yield folder
    finally:
        context._weekloom_stage = outer
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send Python workers so few rows at once: for tables whose rows are large."""
    before = spark.conf.get(_BATCH_KEY)
    spark.conf.set(_BATCH_KEY, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_KEY, before)


def new_table_path(spark: SparkSession, label: str) -> str:
    stage = getattr(spark.sparkContext, "_weekloom_stage", None)
    return f"{stage or checkpoint_root(spark) + '/weekloom'}/{label}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, executors may be lost.

    Reading back also gives Catalyst true sizes, so later joins broadcast only what really is small.
    """
    path = new_table_path(df.sparkSession, label)
    schema = df.schema
    if partition_by:
        # Few large files per partition value; adaptive execution splits the values that are large.
        df = df.hint("rebalance", *partition_by)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point MLlib's own periodic checkpoints at the same shared folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{checkpoint_root(spark)}/weekloom-mllib")


