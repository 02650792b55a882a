"""Session settings and the shared checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_OF_PART = 1024
#: Spark removes the shuffle files of an execution at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a table up to which it may go to all tasks.
FEW_ROWS = 10_000
_made: set[str] = set()


def build_session(master: str | None = None, app: str = "leafspark", **conf: str) -> SparkSession:
    """A session with adaptive execution on. Cluster settings given by spark-submit win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Split a hot key even where the join's output would have served a later step by the same key.
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only when none is named, and only in local mode, a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        if not context.getCheckpointDir():
            context.setCheckpointDir(named)
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="leafspark-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def work_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; removed when the driver's JVM ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/leafspark-{spark.sparkContext.applicationId}"
    if path not in _made:
        _made.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: computed once, with columns to choose from and
    statistics, and lost executors do not replay the past rounds. What was shuffled on the way is removed."""
    conf = df.sparkSession.conf
    path, kept = f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}", conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)
    finally:
        conf.unset(CLEANUP) if kept is None else conf.set(CLEANUP, kept)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def no_broadcasts(spark: SparkSession, on: bool = True):
    """Tables that are cut in here join without broadcasts by size: Spark goes by the size of files and shuffles, and pixels take up to fifty times as
    much on the driver."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if on else ()
    kept = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "-1")
    try:
        yield
    finally:
        for n, value in kept.items():
            spark.conf.unset(n) if value is None else spark.conf.set(n, value)


def beside(table: DataFrame) -> DataFrame:
    """The smaller side of a join: goes to all tasks if it has few rows, else never, whatever the size of its files."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table.hint("merge")


def drop_tables(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut_lineage` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(folder)
            if where.getParent().getName() == f"leafspark-{spark.sparkContext.applicationId}":
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def dealt(df: DataFrame) -> DataFrame:
    """df written once, in a part for each core if it has that many thousands of rows: a small file would else be one task in every pass."""
    rows, cores = df.count(), df.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, -(-rows // ROWS_OF_PART))
    return cut_lineage(df.repartition(parts) if df.rdd.getNumPartitions() < parts else df)
