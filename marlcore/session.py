"""Sessions, and tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster, use the session that the launcher makes."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("marlcore")
    settings = {
        "spark.sql.shuffle.partitions": str(partitions), "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false",
        "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of an Arrow batch: whole texts are long, and a batch is held by the JVM and by its Python worker.
ARROW_ROWS = 2000


def let_workers_import(spark: SparkSession) -> None:
    """Python workers get the folder of this package on their path, for sessions started elsewhere without it, and batches
    of at most ARROW_ROWS rows (a smaller setting of the session stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir; a temp folder only for a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = os.environ.setdefault("MARLCORE_LOCAL_CHECKPOINTS", tempfile.mkdtemp(prefix="marlcore-"))
    return f"file://{found}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/marlcore/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession) -> None:
    """Deletes all that materialize() wrote in this application; results that still read it must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once as Parquet under shared_dir and read back, so that lost executors cost no recomputing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() returned and nothing reads any more: what an operator needed only on its way."""
    for t in tables:
        if found := getattr(t, "scratch_path", None):
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(found)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
