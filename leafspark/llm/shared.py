"""What several operators need: the shared folder, written tables, safe column picking and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_own_folders: dict[str, str] = {}
_seen: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, a part of its own for this application.

    Only a local session without that setting gets a folder of this machine; a cluster without it is an error. The
    part is removed when the application ends, so written tables are for the application that wrote them.
    """
    app = spark.sparkContext.applicationId
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _own_folders.get(app)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="leafspark-")
    path = f"{folder.rstrip('/')}/llm-{app}"
    if path not in _seen:  # removed when the driver's JVM ends
        _seen.add(path)
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(where)
        store.deleteOnExit(where)
    return path


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written = path
    return table


def drop_table(table: DataFrame) -> None:
    """Delete what write_table wrote, once no plan reads it any more."""
    spark, path = table.sparkSession, getattr(table, "_written", None)
    if path:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by their exact names under new ones, whatever else df has (names that differ in case only included)."""
    names = df.columns
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"c{names.index(old)}").alias(new) for new, old in columns.items()])


def let(value: Column, use) -> Column:
    """use(value) with the value computed once for each row, wherever the optimizer moves the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root): the smallest node that each node of the undirected edges (a, b) reaches.

    Large and small stars in turn: a node's neighbours move to the smallest node near by, until nothing changes.
    Minima are pre-aggregated and joined back, so a node with very many neighbours is split by a skewed join and never
    gathered. Each round is a written table; the rounds grow with the logarithm of the longest path. Null ends and
    loops are ignored; no edges give an empty table.
    """
    kind = edges.schema["a"].dataType
    now = write_table(edges.select("a", F.col("b").cast(kind).alias("b")).where("a <> b").distinct(), label)
    stamp = None
    while True:
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select("b", "a"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        kept = down.join(low, "u")
        small = kept.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select("u", "m")).distinct()
        after = write_table(small, label)
        sums = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first()
        drop_table(now)
        now = after
        if tuple(sums) == stamp:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        stamp = tuple(sums)
