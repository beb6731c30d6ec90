"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegerType, StructType

_made: list[str] = []

RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join side even where the parent then needs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # merge sessions before the shuffle, so a hot user ships one row per session
    "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    # what goes to Python at once is bounded in bytes: rows may hold very long texts
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the SQL settings the operators rely on to this session (the time zone too); all are
    settable at run time, and stay set."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, where that is unset the
    context's checkpoint folder. Only a session on one machine may go without (its warehouse is used);
    on a cluster it is an error, as a folder of one machine would lose tables."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_stages"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; ``drop_stages`` removes it."""
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def drop_stages(spark: SparkSession) -> None:
    """Delete the tables that this process has written to the shared folder so far. Frames that were
    made from them can no longer be read: call it when their results are stored."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the frame to the shared folder and read it back.

    The table survives the loss of any executor, and its true size is known to the planner, which
    then broadcasts it only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    path = scratch(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """The results of an iteration as one table in the shared folder, a partition per round."""

    def __init__(self, spark: SparkSession, schema: StructType):
        self._spark, self._schema = spark, schema
        self._path = scratch(spark, "rounds")
        self.count = 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write the next round and read it back."""
        part = f"{self._path}/round={self.count}"
        df.write.parquet(part)
        self.count += 1
        return self._spark.read.schema(self._schema).parquet(part)

    def all(self) -> DataFrame:
        """All rounds so far with their number in ``round``: one scan, however many there are."""
        schema = StructType(list(self._schema.fields)).add("round", IntegerType())
        return self._spark.read.schema(schema).parquet(self._path)
