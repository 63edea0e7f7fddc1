"""Session construction shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC so day arithmetic equals the oracle's,
# AQE for runtime join choice / partition coalescing / skew-join splitting.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # an action's shuffle files go when it ends; a lost one is made again
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}
#: folder of each table that ``written`` made
_FOLDERS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def prepare(spark: SparkSession) -> None:
    """Session settings the jobs rely on; static ones are left alone."""
    for k, v in BASE_CONF.items():
        if spark.conf.isModifiable(k):
            spark.conf.set(k, v)


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "regula") -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("REGULA_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder that
    ``spark.checkpoint.dir`` names: smaller than a checkpoint of wide rows.
    Persisted where the setting is absent; a table it made is left as it is."""
    if df in _FOLDERS:
        return df
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    path = f"{folder.rstrip('/')}/regula-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.parquet(path)
    _FOLDERS[table] = path
    return table


def saved(spark: SparkSession, model, part: str) -> DataFrame:
    """Table ``part`` of a fitted model's saved form; ``release`` deletes the
    whole.  Saved in the shared folder that ``spark.checkpoint.dir`` names; only
    a session on a single machine may leave that unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="regula-")
    path = f"{folder.rstrip('/')}/regula-{uuid.uuid4().hex}"
    model.write().save(path)
    table = spark.read.parquet(f"{path}/{part}")
    _FOLDERS[table] = path
    return table


#: rows of one task of a join or an aggregation of whole rows
TASK_ROWS = 250_000


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` dealt out by ``keys`` where the session's shuffle partitions would
    give a task more than ``TASK_ROWS`` rows: the number of partitions follows
    from the number of rows, so that a task's share does not grow with the table.
    ``rows`` spares the count where it is known."""
    n = -(-(df.count() if rows is None else rows) // TASK_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made and no later step reads;
    other frames are left alone."""
    for table in tables:
        path = _FOLDERS.pop(table, None)
        if path:
            spark = table.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` and forget how it was made.

    The rows go to the shared folder that ``spark.checkpoint.dir`` names.
    Where the setting is absent (a single machine, tests) there is no shared
    folder, so the frame is only persisted and keeps its lineage."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()
