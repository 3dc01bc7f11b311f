"""Tables, snapshots, and what the executors' Python needs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        top = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp(prefix="tessera-")) / f"{top.name}-core.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(target))  # the driver serves it to the executors
        _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset and all runs in one process, a temporary one."""
    got = spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = set_before.get() if set_before.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared one; it goes with the session's JVM."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends there, and it outlives executors. It goes with the session's JVM."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*staged: DataFrame) -> None:
    """Deletes tables that stage() has written, once nothing reads them any more."""
    for df in staged:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/tessera/" not in folder:
                raise ValueError(f"not a staged table: {folder}")
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def freed(spark: SparkSession):
    """While it lasts, what an action shuffled goes from the executors' disks when the action ends (staged tables stay), and tasks are small enough to sort in memory."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m"}
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_snapshot(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK1-SNK6, SNK10, SNK16: a new snapshot folder; the one before stays until the caller drops it."""
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """SNK10, SNK11: append-only logs (usage events, audit)."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
