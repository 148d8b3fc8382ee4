"""Three-way difference of two keyed tables, and what is reported of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.render import key_identity, row_digest

CANDIDATES = 1000


def keyed_digests(df: DataFrame, key: list[str], columns: list[str] | None = None) -> DataFrame:
    """``key`` (JSON array of texts) and the row's ``digest``."""
    return df.select(key_identity(key).alias("key"), row_digest(df.schema, columns or df.columns).alias("digest"))


def full_diff(source: DataFrame, target: DataFrame) -> DataFrame:
    """``key, kind`` of the rows on one side only or different."""
    s, t = source.withColumnRenamed("digest", "ds"), target.withColumnRenamed("digest", "dt")
    kind = F.when(F.col("dt").isNull(), "source_only").when(F.col("ds").isNull(), "target_only").otherwise("different")
    both = s.join(t, "key", "full_outer").where(~F.col("ds").eqNullSafe(F.col("dt")))
    return both.select("key", kind.alias("kind"))


def candidates(diff: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """The first disagreements by key and kind."""
    return diff.orderBy("key", "kind").limit(most)


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("kind").agg(F.count("*").alias("n"))


def lookup(keys: DataFrame, table: DataFrame, on: list[str], broadcast_rows: int = 1_000_000) -> DataFrame:
    """Rows of the table with these keys; the keys are broadcast where they were
    counted to be few, else both sides are shuffled by the key.  They are kept from
    the count on, so that what made them runs once."""
    keys = keys.persist()
    small = keys.count() <= broadcast_rows
    return table.join(F.broadcast(keys) if small else keys, on, "inner")


def table_digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One order-independent digest of all rows: MD5 over their number and the sums
    of three words of 44, 44 and 40 bits of the row digests.  Sums of partial sums,
    so no row is gathered; equal rows count as often as they occur."""
    rows = df.select(row_digest(df.schema, columns).alias("digest"))
    word = lambda at, n: F.sum(F.conv(F.substring("digest", at, n), 16, 10).cast("decimal(20,0)")).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), word(1, 11).alias("a"), word(12, 11).alias("b"), word(23, 10).alias("c"))
    return sums.select(F.md5(F.concat_ws(",", "n", *[F.coalesce(F.col(c), F.lit(0)).cast("string") for c in "abc"])).alias("digest"))


def merge_findings(*checks: DataFrame) -> DataFrame:
    out = checks[0]
    for df in checks[1:]:
        out = out.unionByName(df)
    return out.orderBy("id")


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one of two sets only; empty for equal sets."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
