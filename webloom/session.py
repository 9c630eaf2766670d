"""Session factory, shared-folder lookup and small helpers used by every subpackage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Bytes of rows that a Python worker gets in one Arrow batch, whatever the rows' number.
ARROW_BYTES = 16 << 20
#: Used only where the session names no shared folder (single-machine runs and tests).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def build_session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's option set: UTC, ANSI, AQE with skew joins, Arrow."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    return SparkSession.builder.master(master).config(map=settings | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, from spark.checkpoint.dir, or the one that the program has set; a local one only where both are
    unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = LOCAL_CHECKPOINTS
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/webloom-{uuid.uuid4().hex}/{name}"
    atexit.register(_remove, spark, path.rpartition("/")[0])
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the JVM may be gone at exit; what is left lies in the checkpoint folder
        pass


def _drop(spark: SparkSession, table_name: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")
    except Exception:  # the JVM may be gone at exit
        pass


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write `df` to the shared folder as Parquet and read it back.

    The committed files outlive any executor, later reads prune columns, and a plan that uses the
    result twice runs its input once.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, name: str, key: str) -> DataFrame:
    """materialise, as a table bucketed by `key` into as many buckets as a shuffle has partitions, so a join on it moves only the other side."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table_name = f"webloom_{name}_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name)
    atexit.register(_drop, spark, table_name)
    return spark.table(table_name)


def package_zip(folder: str) -> str:
    """This package's modules as a zip file in `folder`."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "webloom.zip")
    with zipfile.ZipFile(path, "w") as packed:
        for at, _, names in os.walk(here):
            for name in sorted(n for n in names if n.endswith(".py")):
                packed.write(os.path.join(at, name), os.path.join("webloom", os.path.relpath(os.path.join(at, name), here)))
    return path


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package, and bound what they are handed at once.

    Executors on the driver's machine find it where the driver did; to others it is sent, once a session. Vocabulary files are
    parameters: their path has to lead to them on every machine.
    """
    if not spark.sparkContext.master.startswith("local") and spark.conf.get("spark.webloom.shipped", "") == "":
        spark.sparkContext.addPyFile(package_zip(tempfile.mkdtemp()))  # the driver serves the file as long as the session lives
        spark.conf.set("spark.webloom.shipped", "yes")
    if int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
