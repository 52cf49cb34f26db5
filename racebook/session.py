"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "racebook", cores: str = "*", partitions: int = 8) -> SparkSession:
    """Local session for tests and benches; a cluster passes its own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # the feature and ticket projections generate long methods; past this size the JVM would
        # interpret them, so Spark should evaluate them outside whole-stage code instead
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        # the longest plans generate more classes than the default cache of 100 holds
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # a ticket plan keeps a dozen sorts open per task; small pages suit small local tasks
        .config("spark.buffer.pageSize", "1m")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def small_methods(spark: SparkSession) -> None:
    """Have projections whose generated method the JVM would only interpret evaluated in smaller ones.

    The feature, ticket and document plans generate such methods. A limit that the session has set itself stays.
    """
    limit = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(limit) == "65535":
        spark.conf.set(limit, "8000")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a folder of its own; on a cluster a
    machine-local folder would be lost with its executor, so the setting is required there.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not path:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="racebook-"))  # the session's setting is fixed by now
        path = context.getCheckpointDir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Point ``DataFrame.checkpoint`` and Spark ML at the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
