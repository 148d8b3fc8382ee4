"""Inputs of the queries: tables, literal rows and change logs derived from tables.

Every input has a DuckDB counterpart in ``SQL`` or ``values``, so that an oracle
can be written for each query.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(spark: SparkSession) -> None:
    """Make sure that ``checkpoint()`` has a folder: the session's, or where it has
    none (tests, a laptop) one of our own."""
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerfold-"))


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the session's shared checkpoint folder."""
    checkpointed(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.removeprefix('file://').rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str) -> DataFrame:
    """What is computed once, and read from a table by all that comes after."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression for both engines."""
    body = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in rows)
    names = [c.split()[0] for c in columns.split(", ")]
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in columns.split(", "))
    return f"{name} AS (SELECT {casts} FROM (VALUES {body}) AS v({', '.join(names)}))"


def frame(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    ddl = ", ".join(f"{c.split()[0]} {c.split()[1]}" for c in columns.split(", ")).replace("VARCHAR", "string")
    return spark.createDataFrame(rows, ddl.lower())


# --- a snapshot and change logs over it ------------------------------------------

#: The customers that the target holds before the log; the others are absent.
SNAPSHOT_SQL = "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0"


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_acctbal", "c_mktsegment")


#: A log that always fits: the n-th event of a customer updates twice, deletes and
#: inserts in turn, beginning with an insert for an absent one.  Every third update
#: leaves the segment as it is, and some set it to null.
CHANGES_SQL = """
SELECT 'customer' AS relation, event_id * 8 + 8 AS end_lsn, 0 AS seq,
  CASE (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 + CASE WHEN user_id % 3 = 0 THEN 3 ELSE 0 END) % 4
    WHEN 0 THEN 'U' WHEN 1 THEN 'U' WHEN 2 THEN 'D' ELSE 'I' END AS kind,
  user_id AS c_custkey, value AS c_acctbal,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS c_mktsegment, event_id % 3 = 1 AS keeps
FROM events
"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1 + F.when(F.col("user_id") % 3 == 0, 3).otherwise(0)
    kind = F.element_at(F.array(*map(F.lit, "UUDI")), (turn % 4 + 1).cast("int"))
    log = table(spark, sf_dir, "events").select(
        F.lit("customer").alias("relation"), (F.col("event_id") * 8 + 8).alias("end_lsn"), F.lit(0).alias("seq"), kind.alias("kind"),
        F.col("user_id").alias("c_custkey"), F.col("value").alias("c_acctbal"),
        F.when(F.col("event_id") % 11 != 0, F.col("event_type")).alias("c_mktsegment"), (F.col("event_id") % 3 == 1).alias("keeps"))
    toast = F.when((F.col("kind") == "U") & F.col("keeps"), F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    return log.withColumn("toast", toast).drop("keeps")


#: A log with faults: the kind follows the event alone, whether it fits or not.
RAW_SQL = """
SELECT 'customer' AS relation, event_id * 8 + 8 AS end_lsn, 0 AS seq,
  CASE WHEN event_id % 10 < 5 THEN 'I' WHEN event_id % 10 < 9 THEN 'U' ELSE 'D' END AS kind, user_id AS c_custkey
FROM events
"""


def raw_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 10
    return table(spark, sf_dir, "events").select(
        F.lit("customer").alias("relation"), (F.col("event_id") * 8 + 8).alias("end_lsn"), F.lit(0).alias("seq"),
        F.when(turn < 5, "I").when(turn < 9, "U").otherwise("D").alias("kind"), F.col("user_id").alias("c_custkey"))


#: A log over several relations (one for each event type) with truncates.
MULTI_SQL = """
SELECT event_type AS relation, event_id * 8 + 8 AS end_lsn, 0 AS seq,
  CASE WHEN event_id % 997 = 0 THEN 'T' WHEN event_id % 10 < 5 THEN 'I' WHEN event_id % 10 < 9 THEN 'U' ELSE 'D' END AS kind,
  user_id AS k, value AS v
FROM events
"""


def multi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("event_id") % 10
    kind = F.when(F.col("event_id") % 997 == 0, "T").when(turn < 5, "I").when(turn < 9, "U").otherwise("D")
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("relation"), (F.col("event_id") * 8 + 8).alias("end_lsn"), F.lit(0).alias("seq"), kind.alias("kind"),
        F.col("user_id").alias("k"), F.col("value").alias("v"))


# --- source and target of a verification -----------------------------------------

#: A target with one fault of each kind: rows missing, changed and too many.
TARGET_SQL = """
SELECT c_custkey, c_name, CASE WHEN c_custkey % 53 = 0 THEN 5 ELSE c_nationkey END AS c_nationkey, c_acctbal,
  CASE WHEN c_custkey % 41 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 37 <> 0
UNION ALL SELECT c_custkey + 100000000, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 61 = 0
"""


def faulty_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    changed = c.where("c_custkey % 37 <> 0").selectExpr(
        "c_custkey", "c_name", "CASE WHEN c_custkey % 53 = 0 THEN 5 ELSE c_nationkey END AS c_nationkey", "c_acctbal",
        "CASE WHEN c_custkey % 41 = 0 THEN '' ELSE c_mktsegment END AS c_mktsegment")
    return changed.unionByName(c.where("c_custkey % 61 = 0").withColumn("c_custkey", F.col("c_custkey") + 100000000))


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def esc(column: str) -> str:
    """The escaping of ``render.escaped`` in DuckDB."""
    return rf"coalesce(replace(replace({column}, '\', '\\'), chr(31), '\x1f'), '\N')"


def customer_digest_sql() -> str:
    parts = [esc(f"CAST({c} AS VARCHAR)") if c != "c_acctbal" else esc("CAST(CAST(c_acctbal AS DECIMAL(30,6)) AS VARCHAR)") for c in CUSTOMER]
    return f"md5(concat_ws(chr(31), {', '.join(parts)}))"


def diff_ctes() -> str:
    d = customer_digest_sql()
    key = "'[\"' || c_custkey || '\"]'"
    return f"""
t AS ({TARGET_SQL}),
sd AS (SELECT {key} AS key, {d} AS ds FROM customer), td AS (SELECT {key} AS key, {d} AS dt FROM t),
diff AS (SELECT coalesce(sd.key, td.key) AS key, CASE WHEN dt IS NULL THEN 'source_only' WHEN ds IS NULL THEN 'target_only' ELSE 'different' END AS kind
  FROM sd FULL JOIN td ON sd.key = td.key WHERE ds IS DISTINCT FROM dt)"""
