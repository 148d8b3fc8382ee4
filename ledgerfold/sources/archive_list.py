"""Parsing of an archive's table of contents, as ``--list`` prints it, and
selection of its entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All entry descriptions of the archive format.
KINDS = [
    "ACCESS METHOD", "ACL", "AGGREGATE", "BLOB", "BLOB METADATA", "BLOBS", "CAST", "CHECK CONSTRAINT", "COLLATION", "COMMENT", "CONSTRAINT", "CONVERSION",
    "DATABASE", "DATABASE PROPERTIES", "DEFAULT", "DEFAULT ACL", "DOMAIN", "ENCODING", "EVENT TRIGGER", "EXTENSION", "FK CONSTRAINT", "FOREIGN DATA WRAPPER",
    "FOREIGN TABLE", "FUNCTION", "INDEX", "INDEX ATTACH", "MATERIALIZED VIEW", "MATERIALIZED VIEW DATA", "OPERATOR", "OPERATOR CLASS", "OPERATOR FAMILY",
    "POLICY", "PROCEDURAL LANGUAGE", "PROCEDURE", "PUBLICATION", "PUBLICATION TABLE", "PUBLICATION TABLES IN SCHEMA", "ROW SECURITY", "RULE", "SCHEMA",
    "SEARCHPATH", "SECURITY LABEL", "SEQUENCE", "SEQUENCE OWNED BY", "SEQUENCE SET", "SERVER", "SHELL TYPE", "STATISTICS", "STATISTICS DATA", "STDSTRINGS",
    "SUBSCRIPTION", "SUBSCRIPTION TABLE", "TABLE", "TABLE ATTACH", "TABLE DATA", "TEXT SEARCH CONFIGURATION", "TEXT SEARCH DICTIONARY", "TEXT SEARCH PARSER",
    "TEXT SEARCH TEMPLATE", "TRANSFORM", "TRIGGER", "TYPE", "USER MAPPING", "VIEW", "pg_largeobject",
]


def entries(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a list file."""
    return parse(spark.read.text(path).select(F.col("value").alias("line")))


def parse(lines: DataFrame) -> DataFrame:
    """``line, dump_id, kind, namespace, tag, owner, rest`` of the entries; comments and
    blank lines are none.  The longest description that fits names the kind.  An
    object without a schema has ``-`` there (null here), one without an owner a blank
    at the line's end (empty here).  Anything else is an error: what is not
    understood must not be left out."""
    fail = lambda why: F.raise_error(F.concat(F.lit(f"{why}: "), F.col("line")))
    form = r"^\s*(\d+)\s*;\s*(\d+)\s+(\d+)\s+(\S.*)$"
    longest = "|".join(re.escape(k).replace("\\ ", r"\s+") for k in sorted(KINDS, key=len, reverse=True))
    none = (F.trim("line") == "") | F.ltrim("line").startswith(";")
    own = lines.where(~none)
    # Conditions are repeated in the values, as a filter after them may be evaluated with the one before.
    body = F.when(none, None).when(F.col("line").rlike(form), F.regexp_extract("line", form, 4)).otherwise(fail("no archive entry").cast("string"))
    found = F.regexp_extract("body", rf"^({longest})(?=\s|$)", 1)
    read = own.select("line", F.regexp_extract("line", form, 1).cast("bigint").alias("dump_id"), body.alias("body")).withColumn("found", found)
    kind = F.when(F.col("body").isNull(), None).when(F.col("found") != "", F.regexp_replace("found", r"\s+", " ")).otherwise(fail("unknown kind").cast("string"))
    words = F.filter(F.split(F.expr("substring(body, length(found) + 1)"), r"\s+"), lambda w: w != "")
    read = read.select("line", "dump_id", kind.alias("kind"), words.alias("words"), F.col("line").endswith(" ").alias("unowned"))
    needed = F.when(F.col("unowned"), 2).otherwise(3)
    checked = read.withColumn("words", F.when(F.col("words").isNull() | (F.size("words") >= needed), F.col("words")).otherwise(fail("incomplete entry").cast("array<string>")))
    last = F.size("words") - F.when(F.col("unowned"), 0).otherwise(1)
    return checked.select(
        "line", "dump_id", "kind", F.nullif(F.col("words")[0], F.lit("-")).alias("namespace"), F.array_join(F.slice("words", F.lit(2), last - 1), " ").alias("tag"),
        F.when(F.col("unowned"), "").otherwise(F.element_at("words", -1)).alias("owner"), F.array_join("words", " ").alias("rest"))


#: What each kind of entry is restored as; the rest is made first.
CLASSES = {
    "skipped": ["PUBLICATION", "PUBLICATION TABLE", "PUBLICATION TABLES IN SCHEMA", "SUBSCRIPTION", "SUBSCRIPTION TABLE", "TABLE DATA", "SEQUENCE SET",
                "MATERIALIZED VIEW DATA", "BLOB", "BLOB METADATA", "BLOBS", "pg_largeobject", "STATISTICS DATA"],
    "index": ["INDEX", "INDEX ATTACH"],
    "constraint": ["CONSTRAINT", "CHECK CONSTRAINT"],
    "deferred": ["COMMENT", "FK CONSTRAINT", "TRIGGER", "RULE", "POLICY"],
}


def restore_class(kind: Column, rest: Column) -> Column:
    """``pre-data``, ``index``, ``constraint``, ``deferred`` or ``skipped``: data
    and replication objects are made otherwise, and an extension brings its own
    comment."""
    out = F.when((kind == "COMMENT") & rest.rlike(r"^\S+ EXTENSION "), "skipped")
    for name, kinds in CLASSES.items():
        out = out.when(kind.isin(kinds), name)
    return out.otherwise("pre-data")


def use_list(found: DataFrame, phase: str) -> DataFrame:
    """The entries that a phase restores, in the archive's order."""
    return found.where(restore_class(F.col("kind"), F.col("rest")) == phase).orderBy("dump_id")
