"""Written intermediate tables and components over shared keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the folder that driver and executors share (``spark.checkpoint.dir``)."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of the largest table that one task of a dealt join should meet.
ROWS_A_TASK = 200_000


def tasks_for(table: DataFrame) -> int:
    """Partitions that the rows of a Parquet table ask for, at least one for each core; the count comes from footers."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // ROWS_A_TASK))


def dealt(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """``df`` in ``tasks`` hash partitions of ``keys``, so that a task's share does not grow with the tables, as it does where
    the session says how many partitions there are; None: as it is. Joins and groups on these keys use the partitions."""
    return df if tasks is None else df.repartition(tasks, *keys)


def components(pairs: DataFrame) -> DataFrame:
    """``node, key`` to ``node, root``: nodes that share keys, directly or through others, get the smallest node.

    Labels go from nodes to keys and back, then each node takes the label of its label, so long chains halve with
    every round; all steps are minima with partial aggregation, so a key of very many nodes costs no more than its
    rows. Rounds end when no label changes.

    Before the rounds every node takes the smallest node beside it. Only keys that have two labels after that, of longer
    chains, go through rounds, and with their labels instead of their nodes.
    """
    pairs = settled(pairs.select("node", "key").distinct(), "component-pairs")
    lowest = pairs.groupBy("key").agg(F.min("node").alias("low"))
    labels = settled(pairs.join(lowest, "key").groupBy("node").agg(F.min("low").alias("root")), "component-labels")
    mixed = pairs.join(labels, "node").groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    further = settled(pairs.join(labels, "node").join(mixed.select("key"), "key").select(F.col("root").alias("node"), "key").distinct(), "component-pairs")
    if further.isEmpty():
        return labels
    roots = _rounds(further).select(F.col("node").alias("root"), F.col("root").alias("lowest"))
    return labels.join(roots, "root", "left").select("node", F.coalesce("lowest", "root").alias("root"))


def _rounds(pairs: DataFrame) -> DataFrame:
    labels = settled(pairs.select("node", F.col("node").alias("root")).distinct(), "component-labels")
    while True:
        by_key = pairs.join(labels, "node").groupBy("key").agg(F.min("root").alias("low"))
        lower = pairs.join(by_key, "key").groupBy("node").agg(F.min("low").alias("low"))
        near = labels.join(lower, "node").select("node", F.col("root").alias("old"), F.least("root", "low").alias("root"))
        jump = near.select(F.col("node").alias("root"), F.col("root").alias("further"))
        new = near.join(jump, "root", "left").select("node", F.least("root", "further").alias("root"), "old")
        new = settled(new.select("node", "root", (F.col("root") < F.col("old")).alias("moved")), "component-labels")
        if new.filter("moved").isEmpty():
            return new.select("node", "root")
        labels = new.select("node", "root")


def linked_keys(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """``first, keys`` (64-bit keys of one node, and the first of them) to ``first, root``: first keys that stand for one
    component, and its smallest. First keys that nothing links to another are left out, each is one by itself.

    Nodes with the same first key are together without a search. Only keys that stand beside two different first keys
    link more, so the rounds of ``components`` run over those alone, and no round moves the nodes themselves. Keys are
    dealt to ``tasks`` once, to find those that link and what they stand beside.
    """
    beside = dealt(rows.select("first", F.explode("keys").alias("key")), tasks, "key")
    linking = beside.groupBy("key").agg(F.min("first").alias("low"), F.max("first").alias("high")).filter("low < high").select("key")
    return components(beside.join(linking, "key").select(F.col("first").alias("node"), "key")).select(F.col("node").alias("first"), "root")
