"""From a log's cells to typed change rows.

Rows of the segment source hold the cells of the old and new row with the columns'
names and type numbers; what is applied holds the table's own columns, typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Type numbers of the protocol and the Spark types that hold them.
TYPES = {
    16: "boolean", 17: "binary", 20: "bigint", 21: "smallint", 23: "int", 25: "string", 114: "string", 700: "float", 701: "double", 1042: "string",
    1043: "string", 1082: "date", 1114: "timestamp_ntz", 1184: "timestamp", 1700: "decimal(38,9)", 2950: "string", 3802: "string",
}


def _signed(hexadecimal: Column, bits: int) -> Column:
    wide = lambda n: F.lit(str(n)).cast("decimal(20,0)")
    value = F.conv(hexadecimal, 16, 10).cast("decimal(20,0)")
    wrapped = F.when(value >= wide(1 << (bits - 1)), value - wide(1 << bits)).otherwise(value)
    return wrapped.cast("decimal(20,0)").cast("string")


def binary_text(oid: Column, data: Column) -> Column:
    """A binary cell as text, by its type; null for a type without a known form."""
    h = F.hex(data)
    return (
        F.when(oid == 16, F.when(h == "01", "t").otherwise("f")).when(oid == 21, _signed(h, 16)).when(oid == 23, _signed(h, 32)).when(oid == 20, _signed(h, 64))
        .when(oid.isin(25, 114, 1042, 1043), F.decode(data, "utf-8")).when(oid == 17, F.concat(F.lit("\\x"), F.lower(h))))


def cell_text(cell: Column, oid: Column) -> Column:
    """A cell's text; null for null and unchanged ones."""
    return F.when(cell["kind"] == "t", F.decode(cell["data"], "utf-8")).when(cell["kind"] == "b", binary_text(oid, cell["data"]))


def where_key(kind: Column, old: Column, new: Column) -> Column:
    """What a change is found by: the old key, or the new one of an update that does
    not move it; an insert is not looked for."""
    return F.when(kind == "U", F.coalesce(old, new)).when(kind == "D", old)


def sampled_key(old: Column, new: Column) -> Column:
    """The key that a change is sampled by: where the row is afterwards, or was."""
    return F.coalesce(new, old)


def writable_columns(columns: DataFrame) -> DataFrame:
    """Per table the columns that are copied and applied, in order: not generated
    ones.  ``generated_only``: there are none.  ``columns``: ``table_name, ord, name,
    generated``."""
    own = F.filter(F.array_sort(F.collect_list(F.struct("ord", "name", "generated"))), lambda x: ~x["generated"])
    return columns.groupBy("table_name").agg(own.alias("own")).select(
        "table_name", F.transform("own", lambda x: x["name"]).alias("columns"), (F.size("own") == 0).alias("generated_only"))


def set_list(cells: DataFrame) -> DataFrame:
    """The columns that each update sets: no unchanged cells, no unchanged key
    columns.  ``cells``: ``change, name, is_key, cell, changed``."""
    keep = (F.col("cell") != "u") & ~(F.col("is_key") & ~F.col("changed"))
    return cells.groupBy("change").agg(F.array_sort(F.collect_list(F.when(keep, F.col("name")))).alias("columns"))


def unknown_relations(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes of relations that nobody announced; any is a divergence."""
    return changes.join(known.select("relation").distinct(), "relation", "left_anti")


def boundary_transactions(messages: DataFrame, prefix: str) -> DataFrame:
    """Boundary messages as empty transactions at their positions.  ``messages``:
    ``lsn, prefix, transactional``."""
    own = messages.where((F.col("prefix") == prefix) & ~F.col("transactional"))
    return own.select(F.col("lsn").alias("commit_lsn"), F.col("lsn").alias("end_lsn"), F.lit(0).cast("bigint").alias("changes"))


def typed_changes(rows: DataFrame, relation: str, schema: StructType, key: list[str], values: list[str]) -> DataFrame:
    """Canonical changes of one relation from the segment source's rows.

    ``relation, commit_lsn, end_lsn, seq, kind``, the key and value columns typed as
    in ``schema``, ``toast`` (values that the change leaves as they are) and the
    columns before it: ``old_<key>``, or without a key ``old_<column>`` of all."""
    own = rows.where(F.col("relation") == relation)
    names = F.transform("columns", lambda x: x["name"])
    oids = F.map_from_arrays(names, F.transform("columns", lambda x: x["type_oid"]))
    own = own.withColumn("lf_oids", oids).withColumn("lf_old", F.map_from_arrays(names, F.col("old"))).withColumn("lf_new", F.map_from_arrays(names, F.col("new")))
    typed = lambda side, c: cell_text(F.col(side)[c], F.col("lf_oids")[c]).cast(schema[c].dataType)
    # A delete has its key in the old row only.
    keys = [F.when(F.col("kind") == "D", typed("lf_old", k)).otherwise(typed("lf_new", k)).alias(k) for k in key]
    unchanged = F.filter(F.array(*[F.when(F.col("lf_new")[c]["kind"] == "u", F.lit(c)) for c in values]), lambda x: x.isNotNull())
    before = key or values
    return own.select(
        "relation", "commit_lsn", "end_lsn", "seq", "kind", *keys, *[typed("lf_new", c).alias(c) for c in values],
        unchanged.cast("array<string>").alias("toast"),
        *[F.when(F.col("kind").isin(["U"] if key else ["U", "D"]), typed("lf_old", c)).alias(f"old_{c}") for c in before])
