"""Which relations' changes may be regrouped, and how identities decide that."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What, if a relation has any, makes the order of its changes matter.
COUNTED = ("triggers", "checks", "generated", "partial", "custom")


def foldable(catalogue: DataFrame) -> DataFrame:
    """``relation, foldable``: plain tables without row security, triggers or rules
    that fire, checks, generated columns, expression or partial indexes and types of
    their own.  The changes of the others are ordered barriers."""
    plain = (F.col("kind") == "r") & ~F.col("rls")
    for c in COUNTED:
        plain = plain & (F.col(c) == 0)
    return catalogue.select("relation", plain.alias("foldable"))


def foldable_map(catalogue: DataFrame) -> dict[str, bool]:
    """For ``apply_batch``: a row a relation."""
    return {r.relation: r.foldable for r in foldable(catalogue).collect()}


def key_covers(have: Column, need: Column) -> Column:
    """Whether a recorded key (an array of names) has all columns of a verification
    key."""
    return F.size(F.array_except(need, have)) == 0


def same_row(left: str, right: str, columns: list[str]) -> Column:
    """The null-safe identity of two rows by all their columns."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def one_sided_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """``name, in_source, in_target`` of columns that only one side has."""
    s, t = source.select("name", F.lit(True).alias("s")), target.select("name", F.lit(True).alias("t"))
    both = s.join(t, "name", "full_outer").select("name", F.col("s").isNotNull().alias("in_source"), F.col("t").isNotNull().alias("in_target"))
    return both.where(~(F.col("in_source") & F.col("in_target")))


def wrong_ordinals(affected: DataFrame, batch: DataFrame) -> DataFrame:
    """``ordinal, n`` of the rows of a batch that did not affect exactly one row.
    ``affected``: an ordinal for each affected row; ``batch``: all ordinals."""
    got = affected.groupBy("ordinal").agg(F.count("*").alias("n"))
    return batch.join(got, "ordinal", "left").select("ordinal", F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def generated_rows(spark, n: int, **generated: Column) -> DataFrame:
    """``n`` rows of a table without writable columns: what it computes, no more.
    An update of such a row changes nothing and is only counted."""
    return spark.range(n).select(*[c.alias(name) for name, c in generated.items()])


def noop_updates(changes: DataFrame, generated_only: DataFrame) -> DataFrame:
    """The changes without those updates that set nothing: of relations that have
    generated columns only."""
    none = generated_only.where("generated_only").select(F.col("table_name").alias("relation"), F.lit(True).alias("lf_none"))
    return changes.join(none, "relation", "left").where(~((F.col("kind") == "U") & F.coalesce("lf_none", F.lit(False)))).drop("lf_none")
