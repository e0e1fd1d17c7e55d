"""What the operators share on the driver: tables in the shared folder, components, ordered scans."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Workspace:
    """Intermediate tables of one run, in the folder that all executors share.

    The folder is the one that ``spark.checkpoint.dir`` names. Only where a session on one machine leaves it unset (as in
    tests) a temporary folder takes its place; on a cluster that is an error. ``close`` deletes the tables once
    the results that rest on them have been written; as a context manager a workspace closes itself.
    """

    def __init__(self, spark: SparkSession, label: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "findling-shared")
        self.spark, self.path = spark, f"{base.rstrip('/')}/findling/{label}-{uuid.uuid4().hex[:12]}"
        here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
        if here not in known.split(os.pathsep):
            spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (here, known) if x)

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        """Writes the table and reads it again: a lost executor costs the tasks since then, not the whole run."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        self.delete(f"{self.path}/{name}")

    def close(self) -> None:
        """Deletes all tables."""
        self.delete(self.path)

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the input, from file sizes."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def spread(df: DataFrame, bytes_each: int) -> int:
    """A number of ranges or groups that keeps each near ``bytes_each`` at any input size.

    The optimiser knows the size of files, not of other sources; those get the session's shuffle partitions.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = input_bytes(df)
    return max(least, -(-size // bytes_each)) if size < 1 << 60 else least


#: Tasks that a list of work items is dealt to at most.
MOST_TASKS = 20_000


def dealt(items: DataFrame, each: int = 1) -> DataFrame:
    """Small rows that stand for much work (files, blocks), ``each`` to a task.

    A fixed number of partitions, since adaptive execution would join partitions of so few bytes into one.
    """
    return items.repartition(max(1, min(MOST_TASKS, -(-items.count() // each))))


ROW_KEY = "struct<d:bigint,t:bigint>"


def row_key() -> Column:
    """Identifies a row by ``doc_id`` and a hash of ``text``, so that rows of different ids never share a key."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("d"), F.xxhash64(F.col("text").cast("string"), F.col("doc_id").isNull()).alias("t"))


def components(space: Workspace, edges: DataFrame, label: str) -> DataFrame:
    """Connected components of ``edges (a, b)``: rows ``(node, component)``, the smallest node of each.

    Every round each node points to its least neighbour, if that is less than itself; pointers are followed to their
    ends, and the edges are contracted to those ends. Edges inside a component go at once, so that only what
    still joins two components is read again, and the rows of a call stay near the number of edges. All tables
    are written to the shared folder, and nothing is collected.
    """
    pair = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    pair = space.save(pair, f"{label}-edges-0")
    labels = None
    turn = 0
    while labels is None or not pair.isEmpty():
        turn += 1
        # Each edge points its greater end to its lesser one; what has no lesser neighbour is an end.
        ends = pair.select(F.explode(F.array(F.struct(F.col("b").alias("node"), "a"), F.struct(F.col("a").alias("node"), "a"))).alias("e"))
        up = space.save(ends.groupBy("e.node").agg(F.min("e.a").alias("component")), f"{label}-up-{turn}-0")
        hop = 0
        while True:
            hop += 1
            far = up.select(F.col("node").alias("component"), F.col("component").alias("higher"))
            moved = space.save(up.join(far, "component").select("node", F.col("higher").alias("component"), (F.col("higher") != F.col("component")).alias("open")), f"{label}-up-{turn}-{hop}")
            space.drop(f"{label}-up-{turn}-{hop - 1}")
            up = moved.select("node", "component")
            if moved.where("open").isEmpty():
                break
        of = lambda side, up=up: up.select(F.col("node").alias(side), F.col("component").alias(f"of_{side}"))
        met = pair.join(of("a"), "a").join(of("b"), "b").where("of_a <> of_b")
        pair = space.save(met.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b")).distinct(), f"{label}-edges-{turn}")
        space.drop(f"{label}-edges-{turn - 1}")
        labels = space.save(relabelled(labels, up) if labels is not None else up, f"{label}-{turn}")
        space.drop(f"{label}-up-{turn}-{hop}")
        if turn > 1:
            space.drop(f"{label}-{turn - 1}")
    return labels


def relabelled(labels: DataFrame, more: DataFrame) -> DataFrame:
    """``labels (node, component)`` after some of its components have joined others, as ``more (node, component)`` says."""
    more = more.select(F.col("node").alias("component"), F.col("component").alias("joined"))
    return labels.join(more, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))


def ordered(df: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Adds to a narrow table what depends on the total order of ``key``, without one task seeing all rows.

    Adds ``before`` (the sum of ``value`` over earlier rows; with no value, their number), and
    ``following`` (the next row's key, null for the last). Rows are range-partitioned; each range gets
    sums of its own, and one row for each range is carried across. Equal keys keep a fixed order by
    the whole row.
    """
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(1)
    names = df.columns
    ranged = df.repartitionByRange(F.col(key).asc_nulls_first()).withColumn("_range", F.spark_partition_id()).withColumn("_amount", amount.cast("long"))
    space = Workspace(df.sparkSession, "ordered")
    ranged = space.save(ranged, "ranged")
    order = [F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in names if c != key]]
    within = Window.partitionBy("_range").orderBy(*order)
    ranges = ranged.groupBy("_range").agg(F.sum("_amount").alias("_sum"), F.min(key).alias("_first"))
    across = Window.orderBy("_range")  # one row a range
    ranges = ranges.select("_range", (F.sum("_sum").over(across) - F.col("_sum")).alias("_before"), F.lead("_first").over(across).alias("_next"))
    return (
        ranged.withColumn("_inside", F.sum("_amount").over(within.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("_lead", F.lead(key).over(within))
        .withColumn("_last", F.lead(F.lit(1)).over(within).isNull())
        .join(F.broadcast(ranges), "_range")  # one row for each range
        .select(*names, (F.col("_before") + F.coalesce("_inside", F.lit(0))).alias("before"), F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead")).alias("following"))
    )
