"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_made: list[tuple[SparkSession, str]] = []


def attach(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from the place the driver has it.

    On a cluster whose workers have no such folder, ship the package with --py-files.
    """
    env = spark.sparkContext.environment
    # Texts are long: batches of the default 10,000 rows would hold tens of megabytes on both sides, for each task.
    if spark.conf.get(BATCH_ROWS, "10000") == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where none is set (tests, a single machine)."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tracequarry-')}")
        found = sc.getCheckpointDir()
    return found.rstrip("/")


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder as Parquet and read it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracequarry-{uuid.uuid4().hex}/{label}"
    # Nobody looks for the mark of success. On local folders each file that the driver creates costs processes started from its JVM.
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def made() -> list[tuple[SparkSession, str]]:
    """What materialise() has written and release() has not deleted, oldest first."""
    return list(_made)


def release(some: list[tuple[SparkSession, str]] | None = None) -> None:
    """Delete what materialise() has written (or some of it); results that still read it must be stored before."""
    for entry in made() if some is None else some:
        if entry not in _made:
            continue
        _made.remove(entry)
        spark, path = entry
        try:
            jvm = spark.sparkContext._jvm
            parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
            parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(parent, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit
            return


atexit.register(release)
