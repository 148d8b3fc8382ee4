"""Closures over catalogue dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def partition_tree(spark: SparkSession, edges: DataFrame, root: str) -> DataFrame:
    """Descendants of a partitioned table with their depth and whether they are
    leaves; the root alone for an ordinary table.  ``edges``: ``parent, child``."""
    edges.createOrReplaceTempView("lf_edges")
    tree = spark.sql(f"""
        WITH RECURSIVE t(name, depth) AS (
          SELECT '{root}', 0 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN lf_edges e ON e.parent = t.name)
        SELECT name, depth FROM t""")
    parents = edges.select(F.col("parent").alias("name")).distinct().withColumn("inner", F.lit(True))
    return tree.join(parents, "name", "left").select("name", "depth", F.col("inner").isNull().alias("is_leaf"))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """All nodes reachable from ``start`` (column ``node``), itself included.

    A frontier loop, so cycles end it: each round joins only the newly found
    nodes; rounds are checkpointed."""
    known = start.select("node").distinct().checkpoint()
    frontier = known
    while not frontier.isEmpty():
        found = frontier.join(edges, frontier.node == edges.source).select(F.col("target").alias("node")).distinct()
        frontier = found.join(known, "node", "left_anti").checkpoint()
        known = known.union(frontier).checkpoint()
    return known


def reachable(edges: DataFrame) -> DataFrame:
    """``source, target`` pairs connected by any number of edges; for graphs of a
    catalogue's size.  Paths double in every round; a round that finds nothing new
    ends it."""
    known = edges.select("source", "target").distinct().checkpoint()
    while True:
        longer = known.withColumnRenamed("target", "lf_mid").join(known.withColumnRenamed("source", "lf_mid"), "lf_mid").select("source", "target")
        fresh = longer.distinct().join(known, ["source", "target"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.union(fresh).checkpoint()


def foreign_key_edges(constraints: DataFrame) -> DataFrame:
    """``source, target`` edges from a constraint catalogue: the referring relation
    to the one it refers to, without references to itself."""
    edges = constraints.where("kind = 'f'").select(F.col("relation").alias("source"), F.col("refers_to").alias("target"))
    return edges.where("source <> target").distinct()


def sequence_owners(dependencies: DataFrame, selected: DataFrame, sequences: DataFrame) -> DataFrame:
    """``owner, sequence``: sequences that selected relations own or default to."""
    own = dependencies.join(selected.select(F.col("name").alias("source")), "source", "left_semi")
    own = own.join(sequences.select(F.col("name").alias("target")), "target", "left_semi")
    return own.select(F.col("source").alias("owner"), F.col("target").alias("sequence")).distinct()
