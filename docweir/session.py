"""Session helpers: defaults for local runs and the shared scratch location."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "docweir") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


_stand_ins: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it.

    ``spark.checkpoint.dir`` names it.  Where that is unset, a session on one
    machine (``local[...]``) gets a folder of its own that goes with the process;
    any other session is refused, since a machine-local folder would not be seen
    by the other executors.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local[") and master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _stand_ins:
        _stand_ins[app] = tempfile.mkdtemp(prefix="spark-docweir-")
        atexit.register(shutil.rmtree, _stand_ins[app], ignore_errors=True)
    return _stand_ins[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used before paid or non-repeatable work so that a lost executor re-reads
    files instead of re-running the plan above them.  Once the files are written
    the shuffles that led to them are of no more use, so Spark is asked to delete
    them when the write ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"docweir/{name}")
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.mode("errorifexists").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, limit: int = 1 << 30) -> DataFrame:
    """Spread a small input that arrives in fewer splits than there are cores.

    A compressed file of a few megabytes fills one task however much work each
    row costs.  Inputs above ``limit`` bytes have splits enough and are returned
    unchanged, so no large input is ever shuffled for this.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > limit or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, *keys)
