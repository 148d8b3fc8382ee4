"""Constraint validation as queries: what an index or constraint build would find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.render import normal_definition


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: list[str], parent_key: list[str]) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_key, child_key, strict=True)]).distinct()
    complete = F.lit(True)
    for c in child_key:
        complete = complete & F.col(c).isNotNull()
    return child.where(complete).join(known, child_key, "left_anti")


def unique_violations(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys without nulls that occur more than once."""
    complete = F.lit(True)
    for c in key:
        complete = complete & F.col(c).isNotNull()
    return df.where(complete).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def check_violations(df: DataFrame, check: Column) -> DataFrame:
    """Rows for which the check is false (null passes)."""
    return df.where(~F.coalesce(check, F.lit(True)))


def matched_definitions(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """``relation, definition, name, present_as``: each wanted index or constraint with
    the name of one of the same relation and normal definition, null if it has to be
    built.  Both sides: ``relation, name, definition``."""
    normal = normal_definition(F.col("definition"))
    have = present.groupBy("relation", normal.alias("definition")).agg(F.min("name").alias("present_as"))
    return wanted.select("relation", normal.alias("definition"), "name").join(have, ["relation", "definition"], "left")


def attach_order(partitions: DataFrame) -> DataFrame:
    """``name, parent, turn`` of partitioned indexes' attachments: the deepest first,
    so that a parent is valid once its last child is attached.  ``partitions``:
    ``name, parent, depth``, of a catalogue's size."""
    from pyspark.sql import Window as W

    return partitions.where("parent IS NOT NULL").select("name", "parent", F.row_number().over(W.orderBy(F.desc("depth"), "name")).cast("bigint").alias("turn"))
