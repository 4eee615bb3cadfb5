"""Session helpers of the training-data operators: tables, scratch space, components."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; it goes
    when the driver's Python ends, as lazy results may read it until then.

    Only where all run in one process (tests, local mode) and none is set a local folder is
    taken; on a cluster that names none this is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", top)
    folder = f"{top.rstrip('/')}/llm-{uuid.uuid4().hex}"
    atexit.register(_remove, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


def _remove(jvm, conf, path: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, the folder never made
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives executors.

    Also what makes a join safe against hot keys: of two scans that meet in a join,
    adaptive execution can split a hot partition; of an aggregate over its own exchange it
    can't.
    """
    path = f"{folder}/{name}"
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, folder: str, *names: str) -> None:
    """Removes saved tables that nothing reads any more."""
    for name in names:
        _remove(spark._jvm, spark._jsc.hadoopConfiguration(), f"{folder}/{name}")


def as_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the least node of each.

    Min-label propagation with pointer jumping.  Every half round is written to the shared
    folder, so each join is of two scans and a node with very many edges, or a component
    with very many nodes, is split by adaptive execution; aggregates combine before they
    shuffle.  Nodes without edges to others appear only if given as (a, a).  An empty input
    gives no rows.
    """
    spark = edges.sparkSession
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = saved(both, folder, f"{name}-edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = saved(labels.select("node", F.least("node", "m").alias("component")), folder, f"{name}-0")
    for i in range(1, 100):
        near = both.join(labels.select(F.col("node").alias("b"), "component"), "b").select(F.col("a").alias("node"), "component", F.lit(None).cast("long").alias("before"))
        best = near.union(labels.select("node", "component", F.col("component").alias("before")))
        best = saved(best.groupBy("node").agg(F.min("component").alias("component"), F.max("before").alias("before")), folder, f"{name}-best-{i}")
        jump = best.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = best.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component"), "before")
        labels = saved(labels, folder, f"{name}-{i}")
        dropped(spark, folder, f"{name}-best-{i}", f"{name}-{i - 1}")
        if not labels.filter("component < before").limit(1).count():
            dropped(spark, folder, f"{name}-edges")
            return labels.drop("before")
    raise RuntimeError("components did not settle in 100 rounds")
