"""Durable tables in the shared folder, connected components on top of them, and the size of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an Arrow batch that goes to a Python worker, unless the session asks for less.
BATCH_BYTES = 2 << 20


def bounded(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, so that long texts can't fill a worker. The one
    place that sets it; it stays set."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int("".join(c for c in spark.conf.get(name) if c.isdigit()) or 0) > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, a temporary one on one machine (a local
    master, as in tests); on a cluster, where executors would each write to their own disk, an error."""
    conf = spark.sparkContext.getConf()
    where = conf.get("spark.checkpoint.dir") or spark.conf.get("docweir.shared.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-docweir-")
        spark.conf.set("docweir.shared.dir", where)
    return where.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: The folder of what this process writes, below the shared one, and the tables of the open scopes.
_RUN = f"docweir-{uuid.uuid4().hex}"
_scopes: list[list[str]] = []
_runs: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which is deleted when the process ends."""
    run = f"{shared_dir(spark)}/{_RUN}"
    if run not in _runs:
        _runs.add(run)
        atexit.register(_end, spark, run)
    return f"{run}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back, so that what follows neither
    repeats its work nor depends on an executor that may be lost. The process's tables are deleted when it
    ends, or as a scope() around them ends."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path, compression=codec)
    if _scopes:
        _scopes[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._docweir_path = path
    return out


def _end(spark: SparkSession, run: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        _delete(spark, run)


@contextlib.contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes the durable tables that are written inside as it ends, also after a failure. What is
    wanted of them must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _delete(spark, path)


def forget(df: DataFrame) -> None:
    """Deletes what durable() wrote for df; only for tables that nothing reads any more."""
    path = getattr(df, "_docweir_path", None)
    if path:
        _delete(df.sparkSession, path)


def components(edges: DataFrame, name: str = "components", max_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) for each end of an
    edge, component the smallest id that it reaches.

    Alternates large-star and small-star steps, which are joins with a minimum for each node; no
    neighbourhood is ever collected, and a hub's rows only meet one row of the other side, so that
    adaptive execution can split them. Rows with a null end are left out; no edges give no rows.
    """
    e = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    now = durable(e, name)
    for _ in range(max_rounds):
        if _stars(now):
            break
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the minima are written, so that adaptive execution can split a hub's rows in the join
        least = durable(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u <> v").distinct(), name)
        done = [now, least, large]
        least = durable(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = durable(small.union(least.select("u", F.col("m").alias("v"))).distinct(), name)
        for t in (*done, least):
            forget(t)
        now = after
    else:
        raise RuntimeError(f"components not found in {max_rounds} rounds")
    roots = now.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _stars(e: DataFrame) -> bool:
    """Whether every node points to one other node at most, and none that is pointed to points on."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("out")).union(e.select(F.col("v").alias("id"), F.lit(0).alias("out")))
    seen = ends.groupBy("id").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return seen.where("out > 1 or (out = 1 and least = 0)").isEmpty()
