"""Splitting a table into disjoint, exhaustive, restartable parts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    table: str
    part_id: str
    predicate: str
    start: int | None
    end: int | None
    end_inclusive: bool
    bytes: int


def part_count(size: int, wanted: int, most: int) -> int:
    """1 for a table that is not split."""
    if most <= 1 or wanted <= 0 or size <= wanted:
        return 1
    return max(2, min(most, -(-size // wanted)))


def key_parts(table: str, key: str, low: int, high: int, size: int, wanted: int, most: int) -> list[Part]:
    """Half-open key ranges of equal width, the last closed; Python integers, so no
    bound overflows."""
    n = part_count(size, wanted, most)
    if n == 1 or high < low:
        return [Part(table, "all", "true", None, None, True, size)]
    width = -(-(high - low + 1) // n)
    starts = range(low, high + 1, width)
    return [
        Part(table, f"pk-{i:06d}", f"{key} >= {s} AND {key} {'<=' if s + width > high else '<'} {min(s + width, high)}" if s + width > high else f"{key} >= {s} AND {key} < {s + width}",
             s, high if s + width > high else s + width, s + width > high, size // n)
        for i, s in enumerate(starts)
    ]


def block_parts(table: str, blocks: int, size: int, wanted: int, most: int) -> list[Part]:
    """Half-open ranges of physical row blocks, for tables without an integer key."""
    n = part_count(size, wanted, most)
    if n == 1 or blocks < 2:
        return [Part(table, "all", "true", None, None, True, size)]
    width = -(-blocks // n)
    return [Part(table, f"block-{i:06d}", f"block >= {s} AND block < {min(s + width, blocks)}", s, min(s + width, blocks), False, size // n)
            for i, s in enumerate(range(0, blocks, width))]


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    """Smallest and largest key (from the Parquet footers) ."""
    return df.agg(F.min(key).alias("key_min"), F.max(key).alias("key_max"))


def with_blocks(df: DataFrame, rows_per_block: int) -> DataFrame:
    """Row blocks of a file table: a block is a run of rows of one file."""
    return df.withColumn("block", F.floor(F.col("_metadata.row_index") / rows_per_block).cast("bigint"))


def largest_first(parts: list[Part]) -> list[Part]:
    """A stable schedule, largest part first."""
    return sorted(parts, key=lambda p: -p.bytes)


def schedule(parts: DataFrame) -> DataFrame:
    """``turn`` of each part of a plan, largest first; a plan is small."""
    return parts.withColumn("turn", F.row_number().over(W.orderBy(F.desc("bytes"), "ordinal")).cast("bigint"))


def range_width(low: Column, high: Column, parts: Column) -> Column:
    """Width of equal key ranges over the whole 64-bit range, without overflow."""
    wide = lambda c: c.cast("decimal(25,0)")
    total = (wide(high) - wide(low) + wide(parts)).cast("decimal(26,0)")
    return F.call_function("div", total, wide(parts)).cast("decimal(20,0)")
