"""Session settings used by tests, the bench and local runs."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "reliq", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session. On a cluster, use the session the cluster gives you."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("RELIQ_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_WORK_DIR: list[str] = []


def run_dir(spark: SparkSession) -> str:
    """This application's own folder for intermediate tables inside ``work_dir``."""
    return f"{work_dir(spark)}/reliq-{spark.sparkContext.applicationId}"


def drop_intermediate(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application; call it once no result depends on them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset
    (tests, a laptop) does a temporary folder stand in.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    if not _LOCAL_WORK_DIR:
        _LOCAL_WORK_DIR.append(tempfile.mkdtemp(prefix="spark-"))
    return _LOCAL_WORK_DIR[0]


def spread(df: DataFrame, tasks: int = 0) -> DataFrame:
    """Use all cores on an input that arrives in fewer partitions than there are cores, in ``tasks`` parts if these are more.

    For CPU-heavy work on a small or single-file input. A large input already has
    more partitions than cores and passes through untouched, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, tasks)) if df.rdd.getNumPartitions() < cores else df
