"""Spark session settings and the cutting of lineage."""

from __future__ import annotations

import io
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on. All are Spark's own switches: runtime re-planning,
# splitting of skewed join partitions, and UTC so that results do not move with the host.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "gaugeline", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; keyword settings use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Where the setting is empty, as in tests, a folder below the session's warehouse is used:
    the warehouse is shared by the driver and all executors.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and current:
        return current
    folder = configured or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_gaugeline"
    if current is None or folder.rstrip("/") not in current:
        context.setCheckpointDir(folder)
    return folder


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, once per application.

    Functions that run in Python workers are found there by module name; a cluster's
    workers have no copy of the driver's import path.
    """
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, Path("gaugeline") / source.relative_to(root))
    target = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gaugeline-{uuid.uuid4().hex}.zip"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    stream.write(archive.getvalue())
    stream.close()
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read on from there.

    Used where two branches of a plan must see the very same rows and where a
    recomputation after a lost executor must not change row positions. A written table is
    computed once (an eager ``checkpoint()`` computes its input twice) and later reads
    touch only the columns they need.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/gaugeline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
