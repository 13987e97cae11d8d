"""Session construction and the shared-folder helpers every iterative operator uses."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "notegraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE (coalescing and skew joins) and Arrow transfer.

    ``master`` is only set for local runs; on a cluster spark-submit supplies it.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``; only where none is set (tests, local mode) make a temporary one."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="notegraph-checkpoint-", dir=os.environ.get("TMPDIR"))
    context.setCheckpointDir(folder)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once per context: they need not have it on their path."""
    context = spark.sparkContext
    if getattr(context, "_notegraph_shipped", False):
        return
    folder = Path(tempfile.mkdtemp(prefix="notegraph-package-"))
    root = Path(__file__).resolve().parent
    with zipfile.ZipFile(folder / "notegraph.zip", "w") as z:
        for part in sorted(root.rglob("*.py")):
            z.write(part, Path("notegraph") / part.relative_to(root))
    context.addPyFile(str(folder / "notegraph.zip"))
    context._notegraph_shipped = True
