"""Session helpers: configuration the library relies on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every analysis assumes. UTC is part of the semantics (day buckets, date filters);
# AQE lets the runtime coalesce small shuffles and split skewed join partitions.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "murmuration") -> SparkSession:
    """Create (or fetch) a session with the settings the operators expect.

    On a cluster, leave ``master`` unset and let spark-submit decide; tests pass ``local[N]``.
    """
    builder = (SparkSession.builder.appName(app_name).config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false"))
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode runs every task in the driver JVM; only takes effect before it starts
            builder = builder.config("spark.driver.memory",
                                     os.environ.get("MURMURATION_DRIVER_MEMORY", "16g"))
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_conf(spark)
    return spark


def ensure_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable parts of REQUIRED_CONF to an existing session."""
    for k, v in REQUIRED_CONF.items():
        try:
            if spark.conf.get(k, None) != v:
                spark.conf.set(k, v)
        except Exception:  # static conf on a shared session: leave as is
            pass


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Uses ``spark.checkpoint.dir`` as the cluster names it. Only in local mode, where all tasks
    share the machine, a fresh temporary folder stands in for a missing setting; on a cluster
    executors could not see it, so there the setting is required.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        d = tempfile.mkdtemp(prefix="murmuration-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet table in the shared checkpoint folder and read it back.

    One job (a plain ``checkpoint()`` without a persisted input computes the plan twice), the
    lineage ends at the written files, so a lost executor re-reads them instead of recomputing
    upstream stages, and readers get column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"murmuration-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name)
