"""Table selection, key choice and readiness rules over catalogue DataFrames."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class FilterError(ValueError):
    """A filter line that is no rule."""


def glob_to_regex(pattern: str) -> str:
    """Anchored regular expression of a glob: ``*`` any run without a slash, ``?``
    one such character, ``[...]`` a class, backslash quotes."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            end = i + 1
            if end < len(pattern) and pattern[end] in "^!":
                end += 1
            start = end
            while end < len(pattern) and (pattern[end] != "]" or end == start):
                end += 2 if pattern[end] == "\\" else 1
            if end >= len(pattern):
                raise FilterError(f"unclosed class in {pattern!r}")
            body = pattern[i + 1 : end]
            negated = body.startswith("^")
            body = body[1:] if negated else body
            out.append("[" + ("^" if negated else "") + body.replace("[", "\\[") + "]")
            i = end
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise FilterError(f"trailing backslash in {pattern!r}")
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def parse_filter(text: str) -> list[tuple[int, str, bool]]:
    """(number, pattern, include) of the rules of a filter file."""
    rules = []
    for line, raw in enumerate(text.splitlines(), 1):
        value = raw.strip()
        if not value or value.startswith("#"):
            continue
        include = not value.startswith("!")
        value = value if include else value[1:].strip()
        if not value or value.count(".") != 1:
            raise FilterError(f"line {line}: {value!r} is no schema.table pattern")
        glob_to_regex(value)
        rules.append((len(rules) + 1, value, include))
    return rules


def normalized_filter(rules: list[tuple[int, str, bool]]) -> str:
    return "\n".join(("" if include else "!") + pattern for _, pattern, include in rules)


def filter_fingerprint(rules: list[tuple[int, str, bool]]) -> str:
    return hashlib.sha256(normalized_filter(rules).encode()).hexdigest()


def select_tables(tables: DataFrame, rules: list[tuple[int, str, bool]], name: str = "name") -> DataFrame:
    """``included`` by the last rule that matches; without one, included unless
    some rule includes.  The rules are a handful: a chain of conditions, no join."""
    included = F.lit(not any(include for _, _, include in rules))
    for _, pattern, include in rules:
        included = F.when(F.col(name).rlike(glob_to_regex(pattern)), F.lit(include)).otherwise(included)
    return tables.withColumn("included", included)


def choose_key(indexes: DataFrame) -> DataFrame:
    """One row per table: the primary key, else the narrowest unique index without
    nullable columns (ties by name), else none and the reason.

    ``indexes``: ``table_name, index_name, is_primary, is_unique, is_valid,
    is_partial, is_expression, ord, column, not_null``."""
    usable = F.col("is_valid") & (F.col("is_primary") | F.col("is_unique")) & ~F.col("is_partial") & ~F.col("is_expression")
    each = (
        indexes.groupBy("table_name", "index_name")
        .agg(F.bool_and(usable).alias("usable"), F.bool_or("is_primary").alias("is_primary"), F.bool_and("not_null").alias("not_null"),
             F.transform(F.array_sort(F.collect_list(F.struct("ord", "column"))), lambda x: x["column"]).alias("columns"))
    )
    fit = F.col("usable") & (F.col("is_primary") | F.col("not_null"))
    order = W.partitionBy("table_name").orderBy(fit.desc(), F.col("is_primary").desc(), F.size("columns"), "index_name")
    nullable = F.bool_or(F.col("usable") & ~F.col("not_null")).over(W.partitionBy("table_name"))
    best = each.withColumn("fit", fit).withColumn("nullable", nullable).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    reason = F.when(F.col("fit"), F.lit("")).when(F.col("nullable"), "its only unique index allows NULL in a key column").otherwise(
        "it has no primary key and no usable unique index")
    return best.select(
        "table_name", F.when(F.col("fit"), F.col("index_name")).alias("index_name"),
        F.when(F.col("fit"), F.array_join("columns", ",")).alias("key_columns"), reason.alias("reason"))


def needs_fallback(identity: Column, has_primary_key: Column, has_identity_index: Column) -> Column:
    """Whether rows of the relation can be told apart only by all their columns."""
    return (
        F.when(identity == "nothing", True).when(identity == "default", ~has_primary_key)
        .when(identity == "index", ~has_identity_index).when(identity == "full", False).otherwise(True))


def gate(findings: DataFrame, acknowledged: bool = False) -> DataFrame:
    """Findings that block: unresolved errors always, warnings unless acknowledged."""
    blocks = (F.col("severity") == "error") | ((F.col("severity") == "warning") & F.lit(not acknowledged))
    return findings.where(~F.col("resolved") & blocks).orderBy("id")


def inventory(spark: SparkSession, frames: dict[str, DataFrame], sizes: dict[str, int]) -> DataFrame:
    """``table_name, n_columns, bytes, rows`` of the given frames, largest first."""
    parts = None
    for name, df in frames.items():
        one = df.agg(F.count("*").alias("rows")).select(
            F.lit(name).alias("table_name"), F.lit(len(df.columns)).cast("bigint").alias("n_columns"), F.lit(sizes.get(name, 0)).cast("bigint").alias("bytes"), "rows")
        parts = one if parts is None else parts.unionByName(one)
    return parts.orderBy(F.desc("bytes"), "table_name")


def column_inventory(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    rows = [(name, i + 1, f.name, f.dataType.simpleString(), bool(f.metadata.get("generated", False))) for i, f in enumerate(df.schema)]
    return spark.createDataFrame(rows, "table_name string, ord int, column string, type string, generated boolean")


def index_columns(indexes: DataFrame) -> DataFrame:
    """``name, ord, col`` of indexes whose ``columns`` are a comma-separated list."""
    return indexes.select("name", F.posexplode(F.split("columns", ",")).alias("p", "col")).select("name", (F.col("p") + 1).cast("bigint").alias("ord"), "col")
