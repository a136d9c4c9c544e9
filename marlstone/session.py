"""Session helpers: a local session for tests and bench, and reliable lineage cuts."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "marlstone", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and bench. On a cluster the caller brings its own session."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    settings = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("MARLSTONE_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    builder = SparkSession.builder.appName(app).master(f"local[{n}]")
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of our own only where that is unset."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="marlstone-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores. Only an input of fewer splits than cores is moved, which is at most a split a core;
    larger ones stay where they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, which survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def keep(df: DataFrame) -> DataFrame:
    """Cache with spilling to disk; lost blocks are computed again from the lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


#: Paths of the tables that ``cut_table`` has written and nothing has dropped yet.
_TABLES: set[str] = set()


def cut_table(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing ``df`` as Parquet below the checkpoint folder and reading it again: smaller
    than a checkpoint, and later reads take only the columns they need. The table goes with ``drop_table`` or, at
    the latest, when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.add(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_table = path
    return out


def drop_table(df: DataFrame | None) -> None:
    """Delete the table behind a result of ``cut_table`` that nothing will read again; others are left alone."""
    path = getattr(df, "_marlstone_table", None)
    if path in _TABLES:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _TABLES.discard(path)


@atexit.register
def _delete_tables() -> None:
    spark = SparkSession.getActiveSession() if _TABLES else None
    for path in list(_TABLES) if spark is not None else ():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended already
            return
