"""The registered queries over the reference's operators, each with its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.functions import catalog as C
from ledgerfold.functions import render as R
from ledgerfold.operators import capabilities, constraints, diff, fold, graph, parts, sampling
from ledgerfold.plans import control, preflight, verification
from ledgerfold.plans import inputs as I

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# --- catalogue -------------------------------------------------------------------

FILTER = """
# shop tables, but no archives
shop.*
!shop.*_old
!shop.tmp?
shop.keep_old
audit.[a-m]*
!audit.big/*
"""
NAMES_COLUMNS = "name VARCHAR"
NAMES = [(n,) for n in (
    "shop.orders", "shop.orders_old", "shop.keep_old", "shop.tmp1", "shop.tmp12", "audit.log", "audit.zeta", "other.orders", "shop.a.b_old", "shop.x/y")]


@query(f"WITH {I.values('n', NAMES_COLUMNS, NAMES)} " + r"""
SELECT name, CASE
  WHEN regexp_matches(name, '^audit\.big/[^/]*$') THEN false WHEN regexp_matches(name, '^audit\.[a-m][^/]*$') THEN true
  WHEN name = 'shop.keep_old' THEN true WHEN regexp_matches(name, '^shop\.tmp[^/]$') THEN false
  WHEN regexp_matches(name, '^shop\.[^/]*_old$') THEN false WHEN regexp_matches(name, '^shop\.[^/]*$') THEN true ELSE false END AS included
FROM n""")
def p4_table_filter_last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last matching rule decides whether a table is selected."""
    return C.select_tables(I.frame(spark, NAMES_COLUMNS, NAMES), C.parse_filter(FILTER))


@query("SELECT sha256('shop.*' || chr(10) || '!shop.*_old' || chr(10) || '!shop.tmp?' || chr(10) || 'shop.keep_old' || chr(10) || 'audit.[a-m]*' || chr(10) || '!audit.big/*') AS fingerprint, CAST(6 AS BIGINT) AS rules")
def p5_filter_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = C.parse_filter(FILTER)
    return spark.createDataFrame([(C.filter_fingerprint(rules), len(rules))], "fingerprint string, rules bigint")


INDEX_COLUMNS = "table_name VARCHAR, index_name VARCHAR, is_primary BOOLEAN, is_unique BOOLEAN, is_valid BOOLEAN, is_partial BOOLEAN, is_expression BOOLEAN, ord INT, column VARCHAR, not_null BOOLEAN"
T_, N_ = True, False
INDEXES = [
    ("orders", "orders_pkey", T_, T_, T_, N_, N_, 1, "id", T_), ("orders", "a_unique", N_, T_, T_, N_, N_, 1, "email", T_),
    ("items", "items_wide", N_, T_, T_, N_, N_, 1, "order_id", T_), ("items", "items_wide", N_, T_, T_, N_, N_, 2, "line", T_),
    ("items", "items_b", N_, T_, T_, N_, N_, 1, "sku", T_), ("items", "items_a", N_, T_, T_, N_, N_, 1, "code", T_),
    ("log", "log_null", N_, T_, T_, N_, N_, 1, "entry", N_), ("log", "log_part", N_, T_, T_, T_, N_, 1, "x", T_),
    ("bad", "bad_invalid", N_, T_, N_, N_, N_, 1, "id", T_), ("bad", "bad_expr", N_, T_, T_, N_, T_, 1, "id", T_),
    ("plain", "plain_idx", N_, N_, T_, N_, N_, 1, "id", T_)]


@query(f"WITH {I.values('x', INDEX_COLUMNS.replace('column VARCHAR', 'col VARCHAR'), INDEXES)}," + """
e AS (SELECT table_name, index_name, bool_and(is_valid AND (is_primary OR is_unique) AND NOT is_partial AND NOT is_expression) AS usable,
  bool_or(is_primary) AS p, bool_and(not_null) AS nn, count(*) AS n, string_agg(col, ',' ORDER BY ord) AS cols FROM x GROUP BY ALL),
r AS (SELECT *, usable AND (p OR nn) AS fit, bool_or(usable AND NOT nn) OVER (PARTITION BY table_name) AS nullable,
  row_number() OVER (PARTITION BY table_name ORDER BY (usable AND (p OR nn)) DESC, p DESC, n, index_name) AS rn FROM e)
SELECT table_name, CASE WHEN fit THEN index_name END AS index_name, CASE WHEN fit THEN cols END AS key_columns,
  CASE WHEN fit THEN '' WHEN nullable THEN 'its only unique index allows NULL in a key column' ELSE 'it has no primary key and no usable unique index' END AS reason
FROM r WHERE rn = 1""")
def w9_key_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.choose_key(I.frame(spark, INDEX_COLUMNS, INDEXES))


TABLES_COLUMNS = "table_name VARCHAR, est BIGINT"
TABLES = [("orders", 1000), ("items", 3000), ("log", 50), ("lineitem", 60000)]


@query(f"WITH {I.values('t', TABLES_COLUMNS, TABLES)} SELECT table_name, table_name IN ('orders', 'items') AS keyed, "
       "CASE WHEN table_name IN ('orders', 'items') THEN 1.0 ELSE 0.0 END::DOUBLE AS coverage, true AS converged FROM t")
def v8_keyless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a key is not compared, and says so: coverage 0, a warning, but converged."""
    keyed = C.choose_key(I.frame(spark, INDEX_COLUMNS, INDEXES)).where("reason = ''").select("table_name", F.lit(True).alias("keyed"))
    return I.frame(spark, TABLES_COLUMNS, TABLES).join(keyed, "table_name", "left").select(
        "table_name", F.coalesce("keyed", F.lit(False)).alias("keyed"), F.when(F.col("keyed"), 1.0).otherwise(0.0).alias("coverage"), F.lit(True).alias("converged"))


INVENTORY = ("customer", "nation", "orders", "part", "region", "supplier")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM information_schema.columns WHERE table_name = '{t}') AS n_columns FROM {t}" for t in INVENTORY))
def s1_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.inventory(spark, {t: I.table(spark, sf_dir, t) for t in INVENTORY}, {}).select("table_name", F.col("rows").alias("n_rows"), "n_columns")


@query("SELECT row_number() OVER (ORDER BY ordinal_position) AS ord, column_name FROM (SELECT DISTINCT ordinal_position, column_name FROM information_schema.columns WHERE table_name = 'orders')")
def s2_column_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.column_inventory(spark, "orders", I.table(spark, sf_dir, "orders")).select(F.col("ord").cast("bigint").alias("ord"), F.col("column").alias("column_name"))


@query("SELECT min(o_orderkey) AS key_min, max(o_orderkey) AS key_max FROM orders")
def s3_key_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.key_bounds(I.table(spark, sf_dir, "orders"), "o_orderkey")


IDENTITY_COLUMNS = "relation VARCHAR, identity VARCHAR, has_pk BOOLEAN, has_index BOOLEAN"
IDENTITIES = [("a", "nothing", T_, T_), ("b", "default", T_, N_), ("c", "default", N_, T_), ("d", "index", T_, N_), ("e", "index", N_, T_), ("f", "full", N_, N_), ("g", "odd", T_, T_)]


@query(f"WITH {I.values('r', IDENTITY_COLUMNS, IDENTITIES)} SELECT relation, CASE identity WHEN 'nothing' THEN true WHEN 'default' THEN NOT has_pk WHEN 'index' THEN NOT has_index WHEN 'full' THEN false ELSE true END AS fallback FROM r")
def g5_identity_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, IDENTITY_COLUMNS, IDENTITIES).select("relation", C.needs_fallback(F.col("identity"), F.col("has_pk"), F.col("has_index")).alias("fallback"))


FINDING_COLUMNS = "id VARCHAR, kind VARCHAR, severity VARCHAR, resolved BOOLEAN"
FINDINGS = [("wal", "replication", "warning", N_), ("pk", "identity", "error", N_), ("old", "identity", "error", T_), ("note", "tuning", "info", N_), ("seq", "sequence", "warning", T_)]


@query(f"WITH {I.values('f', FINDING_COLUMNS, FINDINGS)} SELECT id, kind, severity, severity = 'error' AS blocks_acknowledged FROM f WHERE NOT resolved AND severity IN ('error', 'warning')")
def g2_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = I.frame(spark, FINDING_COLUMNS, FINDINGS)
    hard = C.gate(found, acknowledged=True).select("id", F.lit(True).alias("hard"))
    return C.gate(found).join(hard, "id", "left").select("id", "kind", "severity", F.coalesce("hard", F.lit(False)).alias("blocks_acknowledged"))


# --- parts and scans ---------------------------------------------------------------


@query("""
WITH b AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders), w AS (SELECT lo, hi, (hi - lo + 1 + 7) // 8 AS w FROM b),
p AS (SELECT i, lo + i * w AS s, least(lo + (i + 1) * w, hi + 1) AS e FROM w, range(8) r(i) WHERE lo + i * w <= hi)
SELECT 'pk-' || lpad(CAST(i AS VARCHAR), 6, '0') AS part_id, count(o_orderkey) AS n, min(o_orderkey) AS key_min, max(o_orderkey) AS key_max
FROM p LEFT JOIN orders ON o_orderkey >= s AND o_orderkey < e GROUP BY i""")
def s5_range_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every key-range part, by one scan: the part is computed from the key."""
    orders = I.table(spark, sf_dir, "orders")
    low, high = parts.key_bounds(orders, "o_orderkey").first()
    plan = parts.key_parts("orders", "o_orderkey", low, high, 8 << 20, 1 << 20, 8)
    frame = spark.createDataFrame([(p.part_id, i) for i, p in enumerate(plan)], "part_id string, i bigint")
    width = plan[1].start - plan[0].start if len(plan) > 1 else high - low + 1
    found = orders.groupBy(F.floor((F.col("o_orderkey") - low) / width).cast("bigint").alias("i")).agg(
        F.count("*").alias("n"), F.min("o_orderkey").alias("key_min"), F.max("o_orderkey").alias("key_max"))
    return frame.join(found, "i", "left").select("part_id", F.coalesce("n", F.lit(0)).alias("n"), "key_min", "key_max")


@query("""
WITH b AS (SELECT event_id // 100 AS block FROM events), n AS (SELECT max(block) + 1 AS blocks FROM b)
SELECT 'block-' || lpad(CAST(block // ((blocks + 3) // 4) AS VARCHAR), 6, '0') AS part_id, count(*) AS n FROM b, n GROUP BY 1""")
def s6_block_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of row blocks for a table that is split by place, not by key."""
    events = I.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).cast("bigint").alias("block"))
    blocks = events.agg(F.max("block")).first()[0] + 1
    plan = parts.block_parts("events", blocks, 4 << 20, 1 << 20, 4)
    width = plan[0].end - plan[0].start
    return events.groupBy(F.concat(F.lit("block-"), F.lpad(F.floor(F.col("block") / width).cast("string"), 6, "0")).alias("part_id")).agg(F.count("*").alias("n"))


PART_COLUMNS = "ordinal BIGINT, part_id VARCHAR, bytes BIGINT"
PARTS = [(0, "a", 5), (1, "b", 50), (2, "c", 5), (3, "d", 500), (4, "e", 50)]


@query(f"WITH {I.values('p', PART_COLUMNS, PARTS)} SELECT part_id, bytes, row_number() OVER (ORDER BY bytes DESC, ordinal) AS turn FROM p")
def w8_largest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parts.schedule(I.frame(spark, PART_COLUMNS, PARTS)).select("part_id", "bytes", "turn")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 5000")
def s4_predicate_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the columns and row groups of a part are read (both are pushed to the scan)."""
    return I.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").where((F.col("o_orderkey") >= 100) & (F.col("o_orderkey") < 5000))


@query("SELECT c.c_custkey, c.c_name FROM customer c JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderkey % 101 = 0) k ON c.c_custkey = k.o_custkey")
def s8_keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = I.table(spark, sf_dir, "orders").where("o_orderkey % 101 = 0").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return diff.lookup(keys, I.table(spark, sf_dir, "customer"), ["c_custkey"]).select("c_custkey", "c_name")


# --- digests and differences -------------------------------------------------------


@query(f"SELECT c_custkey, {I.customer_digest_sql()} AS digest FROM customer")
def f1_row_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.table(spark, sf_dir, "customer")
    return c.select("c_custkey", R.row_digest(c.schema, I.CUSTOMER).alias("digest"))


@query(f"""
WITH r AS (SELECT {I.customer_digest_sql()} AS d FROM customer)
SELECT md5(count(*) || ',' || sum(CAST('0x' || d[1:11] AS BIGINT)) || ',' || sum(CAST('0x' || d[12:22] AS BIGINT)) || ',' || sum(CAST('0x' || d[23:32] AS BIGINT))) AS digest FROM r""")
def a12_table_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.table_digest(I.table(spark, sf_dir, "customer"), I.CUSTOMER)


@query("SELECT '[\"' || o_custkey || '\",\"' || o_orderstatus || '\"]' AS key, count(*) AS n FROM orders GROUP BY 1")
def f2_key_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.table(spark, sf_dir, "orders").groupBy(R.key_identity(["o_custkey", "o_orderstatus"]).alias("key")).agg(F.count("*").alias("n"))


def _diff(spark, sf_dir) -> DataFrame:
    sides = [diff.keyed_digests(df, ["c_custkey"], I.CUSTOMER) for df in (I.table(spark, sf_dir, "customer"), I.faulty_target(spark, sf_dir))]
    return diff.full_diff(*sides)


@query(f"WITH {I.diff_ctes()} SELECT key, kind FROM diff")
def j1_full_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir)


@query(f"WITH {I.diff_ctes()} SELECT kind, count(*) AS n FROM diff GROUP BY kind")
def a6_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.diff_counts(_diff(spark, sf_dir))


@query(f"WITH {I.diff_ctes()} SELECT key, kind FROM diff ORDER BY key, kind LIMIT 20")
def t2_candidate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 disagreements: a report of bounded length."""
    return diff.candidates(_diff(spark, sf_dir), 20)


@query("SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_nationkey % 7 = 0 UNION ALL SELECT n_nationkey + 100, 'right' FROM nation WHERE n_nationkey % 7 = 0")
def u2_set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publication members against the expected: what is on one side only."""
    n = I.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    other = n.select(F.when(F.col("k") % 7 == 0, F.col("k") + 100).otherwise(F.col("k")).alias("k"))
    return diff.set_difference(n, other)


MAP_COLUMNS = "side VARCHAR, column VARCHAR"
SIDES = [("source", "id"), ("source", "note"), ("source", "legacy"), ("target", "id"), ("target", "note"), ("target", "extra")]


@query(f"WITH {I.values('m', 'side VARCHAR, name VARCHAR', SIDES)} SELECT coalesce(s.name, t.name) AS name, s.name IS NOT NULL AS in_source, t.name IS NOT NULL AS in_target "
       "FROM (SELECT name FROM m WHERE side = 'source') s FULL JOIN (SELECT name FROM m WHERE side = 'target') t ON s.name = t.name WHERE s.name IS NULL OR t.name IS NULL")
def j5_column_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that only one side has; any is a divergence."""
    m = I.frame(spark, MAP_COLUMNS, SIDES).withColumnRenamed("column", "name")
    return capabilities.one_sided_columns(m.where("side = 'source'"), m.where("side = 'target'"))


# --- sampling ----------------------------------------------------------------------

HEAP_COLUMNS = "table_name VARCHAR, leaf VARCHAR, pages BIGINT, est_rows BIGINT"
HEAPS = [("bloated", "bloated", 11294175, 130900000), ("big", "big", 500000, 40000000), ("small", "small", 40, 900), ("empty", "empty", 0, 0), ("unknown", "unknown", 900, 0),
         ("parted", "p1", 1000, 100000), ("parted", "p2", 2000, 100000), ("parted", "p3", 7000, 500000)]
BUDGET, WINDOWS = 100_000, 64
BUDGET_SQL = (f"h AS (SELECT *, greatest(CAST({BUDGET} AS BIGINT) * greatest(pages, 1) // sum(greatest(pages, 1)) OVER (PARTITION BY table_name), 1) AS budget FROM h0)")


@query(f"WITH {I.values('h0', HEAP_COLUMNS, HEAPS)}, {BUDGET_SQL} SELECT table_name, leaf, CAST(budget AS BIGINT) AS budget FROM h")
def v1_leaf_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.leaf_budgets(I.frame(spark, HEAP_COLUMNS, HEAPS), BUDGET).select("table_name", "leaf", "budget")


@query(f"""WITH {I.values('h0', HEAP_COLUMNS, HEAPS)}, {BUDGET_SQL},
s AS (SELECT *, greatest(CAST(budget AS BIGINT) // {WINDOWS}, 1) AS lim, pages // {WINDOWS} AS stride,
  CASE WHEN pages > 0 AND est_rows > 0 THEN greatest(CAST(ceil(2.0 * greatest(CAST(budget AS BIGINT) // {WINDOWS}, 1) / (CAST(est_rows AS DOUBLE) / pages)) AS BIGINT), 1) END AS wp FROM h),
d AS (SELECT *, pages <= 0 OR est_rows <= 0 OR est_rows <= budget OR stride <= wp AS whole FROM s)
SELECT table_name, leaf, CAST(w AS BIGINT) AS "window", CAST(CASE WHEN whole THEN 0 WHEN w = {WINDOWS - 1} THEN greatest(pages - wp, 0) ELSE w * stride END AS BIGINT) AS start,
  CAST(CASE WHEN whole OR w = {WINDOWS - 1} THEN NULL ELSE w * stride + wp END AS BIGINT) AS stop, CAST(CASE WHEN whole THEN budget ELSE lim END AS BIGINT) AS row_limit
FROM d, range({WINDOWS}) r(w) WHERE NOT whole OR w = 0""")
def v2_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_windows(sampling.leaf_budgets(I.frame(spark, HEAP_COLUMNS, HEAPS), BUDGET), WINDOWS)


@query("""
WITH b AS (SELECT min(event_id) AS lo, (max(event_id) - min(event_id) + 10) // 10 AS w FROM events),
r AS (SELECT event_id, (event_id - lo) // w AS "window", row_number() OVER (PARTITION BY (event_id - lo) // w ORDER BY event_id) AS rn FROM events, b)
SELECT event_id, "window" FROM r WHERE rn <= 25""")
def w6_sample_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 25 rows of each of ten windows over the table."""
    return sampling.sample_rows(I.table(spark, sf_dir, "events"), "event_id", 250, 10, 25).select("event_id", "window")


COVER_COLUMNS = "table_name VARCHAR, rows BIGINT, est BIGINT, converged BOOLEAN, complete BOOLEAN"
COVERS = [("a", 100, 1000, T_, T_), ("b", 500, 400, T_, T_), ("c", 0, 0, T_, T_), ("d", 250, 1000, N_, T_)]


@query(f"WITH {I.values('c', COVER_COLUMNS, COVERS)} SELECT min(CASE WHEN est <= 0 THEN 1.0::DOUBLE ELSE least(rows::DOUBLE / est, 1.0) END) AS coverage, bool_and(converged) AS converged, bool_and(complete) AS complete FROM c")
def a5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = I.frame(spark, COVER_COLUMNS, COVERS)
    return sampling.run_coverage(c.withColumn("coverage", sampling.coverage(F.col("rows").cast("double"), F.col("est"))))


@query(f"WITH {I.values('h0', HEAP_COLUMNS, HEAPS)} SELECT table_name, CAST(sum(greatest(pages, 1)) AS BIGINT) AS pages, CAST(sum(est_rows) AS BIGINT) AS est_rows FROM h0 GROUP BY 1")
def a3_total_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.total_pages(I.frame(spark, HEAP_COLUMNS, HEAPS))


# --- change log ----------------------------------------------------------------------


@query(f"""WITH s AS ({I.SNAPSHOT_SQL}), c AS ({I.RAW_SQL}),
p AS (SELECT c.*, coalesce(lag(kind <> 'D') OVER (PARTITION BY c.c_custkey ORDER BY end_lsn), s.c_custkey IS NOT NULL) AS present FROM c LEFT JOIN s ON s.c_custkey = c.c_custkey),
b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY end_lsn) AS rn FROM p WHERE CASE WHEN kind = 'I' THEN present ELSE NOT present END)
SELECT relation, c_custkey, end_lsn, seq, kind, present FROM b WHERE rn = 1""")
def w1_presence_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.presence_violations(I.snapshot(spark, sf_dir), I.raw_changes(spark, sf_dir), ["c_custkey"])


FOLD_SQL = f"""WITH s AS ({I.SNAPSHOT_SQL}), c AS ({I.CHANGES_SQL}),
l AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY end_lsn DESC) AS rn FROM c),
seg AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY end_lsn DESC) AS rn FROM c WHERE kind = 'I' OR (kind = 'U' AND NOT keeps)),
f AS (SELECT l.c_custkey, l.kind, l.c_acctbal, seg.c_mktsegment, seg.c_custkey IS NOT NULL AS seen FROM l LEFT JOIN seg ON seg.c_custkey = l.c_custkey AND seg.rn = 1 WHERE l.rn = 1)
SELECT coalesce(s.c_custkey, f.c_custkey) AS c_custkey, CASE WHEN f.kind IS NULL THEN s.c_acctbal ELSE f.c_acctbal END AS c_acctbal,
  CASE WHEN f.seen THEN f.c_mktsegment ELSE s.c_mktsegment END AS c_mktsegment
FROM s FULL JOIN f ON s.c_custkey = f.c_custkey WHERE f.kind IS DISTINCT FROM 'D'"""


@query(FOLD_SQL)
def c2_fold_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: a change log replayed onto a snapshot."""
    return fold.fold(I.snapshot(spark, sf_dir), I.changes(spark, sf_dir), ["c_custkey"], ["c_acctbal", "c_mktsegment"])


@query(f"""WITH s AS ({I.SNAPSHOT_SQL}), c AS ({I.CHANGES_SQL}),
w AS (SELECT *, count(CASE WHEN kind = 'I' OR (kind = 'U' AND NOT keeps) THEN 1 END) OVER (PARTITION BY c_custkey ORDER BY end_lsn ROWS UNBOUNDED PRECEDING) AS g FROM c),
v AS (SELECT c_custkey, g, c_mktsegment FROM w WHERE kind = 'I' OR (kind = 'U' AND NOT keeps))
SELECT w.relation, w.c_custkey, w.end_lsn, w.seq, w.kind, CASE WHEN w.g > 0 THEN v.c_mktsegment ELSE s.c_mktsegment END AS carried
FROM w LEFT JOIN v ON v.c_custkey = w.c_custkey AND v.g = w.g LEFT JOIN s ON s.c_custkey = w.c_custkey""")
def w3_toast_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.toast_carried(I.snapshot(spark, sf_dir), I.changes(spark, sf_dir), ["c_custkey"], "c_mktsegment")


@query(f"WITH c AS ({I.CHANGES_SQL}) SELECT c_custkey, max(end_lsn) AS end_lsn, arg_max(kind, end_lsn) AS kind FROM c GROUP BY 1")
def w2_last_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.changes(spark, sf_dir).groupBy("c_custkey").agg(F.max("end_lsn").alias("end_lsn"), F.max_by("kind", "end_lsn").alias("kind"))


@query(f"""WITH c AS ({I.MULTI_SQL}), t AS (SELECT relation, max(end_lsn) AS cut FROM c WHERE kind = 'T' GROUP BY 1),
l AS (SELECT c.*, row_number() OVER (PARTITION BY c.relation, k ORDER BY end_lsn DESC) AS rn FROM c LEFT JOIN t ON t.relation = c.relation WHERE kind <> 'T' AND (cut IS NULL OR end_lsn > cut))
SELECT relation, k, end_lsn, v FROM l WHERE rn = 1 AND kind <> 'D'""")
def c9_truncate_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last values after each relation's last truncate."""
    live = fold.live_changes(I.multi_changes(spark, sf_dir))
    last = live.groupBy("relation", "k").agg(F.max_by("kind", "end_lsn").alias("kind"), F.max("end_lsn").alias("end_lsn"), F.max_by("v", "end_lsn").alias("v"))
    return last.where("kind <> 'D'").drop("kind").select("relation", "k", "end_lsn", "v")


@query(f"""WITH c AS ({I.MULTI_SQL}), e AS (SELECT *, sum(CASE WHEN kind = 'T' OR relation = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY end_lsn ROWS UNBOUNDED PRECEDING) AS epoch FROM c)
SELECT end_lsn, relation, kind, CAST(epoch AS BIGINT) AS epoch FROM e""")
def w7_barrier_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.barrier_epochs(I.multi_changes(spark, sf_dir), F.col("relation") == "signup").select("end_lsn", "relation", "kind", "epoch")


@query(f"""WITH c AS ({I.MULTI_SQL}), s AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY relation ORDER BY end_lsn) = kind THEN 0 ELSE 1 END AS st FROM c),
r AS (SELECT *, sum(st) OVER (PARTITION BY relation ORDER BY end_lsn ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT relation, CAST(run AS BIGINT) AS run, kind, count(*) AS n, min(end_lsn) AS first_lsn, max(end_lsn) AS last_lsn FROM r GROUP BY relation, run, kind""")
def c4_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.runs(I.multi_changes(spark, sf_dir), ["relation"]).withColumn("run", F.col("run").cast("bigint"))


LINEITEM = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


MONEY = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _line(c: str) -> str:
    if c in MONEY:
        return I.esc(f"CAST(CAST({c} AS DECIMAL(30,6)) AS VARCHAR)")
    return I.esc(f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')" if c == "l_shipdate" else f"CAST({c} AS VARCHAR)")


@query(f"""WITH l AS (SELECT md5(concat_ws(chr(31), {', '.join(map(_line, LINEITEM))})) AS digest, l_orderkey AS k FROM lineitem), b AS (SELECT digest, count(*) AS n FROM l GROUP BY 1),
c AS (SELECT digest, k * 2 AS pos, 'D' AS kind FROM l WHERE k % 50 = 0 UNION ALL SELECT digest, k * 2 + 1, 'I' FROM l WHERE k % 70 = 0),
m AS (SELECT digest, sum(CASE kind WHEN 'I' THEN 1 ELSE -1 END) AS d FROM c GROUP BY 1),
r AS (SELECT c.digest, c.kind, coalesce(n, 0) + coalesce(sum(CASE c.kind WHEN 'I' THEN 1 ELSE -1 END) OVER (PARTITION BY c.digest ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS found
  FROM c LEFT JOIN b ON b.digest = c.digest),
v AS (SELECT digest, count(*) AS violations FROM r WHERE kind = 'D' AND found <> 1 GROUP BY 1)
SELECT digest, CAST(greatest(coalesce(n, 0) + coalesce(d, 0), 0) AS BIGINT) AS copies, coalesce(violations, 0) AS violations
FROM b FULL JOIN m USING (digest) LEFT JOIN v USING (digest) WHERE coalesce(n, 0) + coalesce(d, 0) > 0 OR violations > 0""")
def c12_full_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyless table: rows known by all their columns, counted copies, and the
    deletes that do not find exactly one row."""
    lines = I.table(spark, sf_dir, "lineitem")
    base = lines.select(R.row_digest(lines.schema, list(LINEITEM)).alias("digest"), (F.col("l_orderkey") * 2).alias("end_lsn"), F.lit(0).alias("seq"))
    gone = base.where("end_lsn % 100 = 0").withColumn("kind", F.lit("D"))
    more = base.where("end_lsn % 140 = 0").withColumn("kind", F.lit("I")).withColumn("end_lsn", F.col("end_lsn") + 1)
    after, bad = fold.full_identity(base, gone.unionByName(more))
    count = bad.groupBy("digest").agg(F.count("*").alias("violations"))
    return after.join(count, "digest", "full_outer").select(
        "digest", F.coalesce("copies", F.lit(0)).cast("bigint").alias("copies"), F.coalesce("violations", F.lit(0)).alias("violations"))


@query("SELECT event_id * 8 + 8 AS end_lsn, (row_number() OVER (ORDER BY event_id) - 1) // 500 AS batch FROM events")
def a13_batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns = I.table(spark, sf_dir, "events").select((F.col("event_id") * 8 + 8).alias("end_lsn"))
    return fold.batch_ids(txns, 500)


@query(f"""WITH c AS ({I.MULTI_SQL}), r AS (SELECT relation, end_lsn, kind, row_number() OVER (PARTITION BY relation ORDER BY md5('/' || end_lsn || '/' || seq)) AS slot FROM c WHERE kind <> 'T')
SELECT relation, CAST(slot AS BIGINT) AS slot, end_lsn, kind FROM r WHERE slot <= 40""")
def w5_reservoir_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 40 changes of each relation."""
    out = sampling.reservoir(I.multi_changes(spark, sf_dir).where("kind <> 'T'"), 40)
    return out.select("relation", F.col("slot").cast("bigint").alias("slot"), "end_lsn", "kind")


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT relation, count(*) AS observed, least(count(*), 40) AS retained, count(CASE WHEN kind = 'D' THEN 1 END) AS deletes FROM c WHERE kind <> 'T' GROUP BY 1")
def a7_reservoir_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.reservoir_counters(I.multi_changes(spark, sf_dir), 40)


@query(f"""WITH {I.diff_ctes()}, c AS ({I.CHANGES_SQL}), r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('/' || end_lsn || '/' || seq)) AS slot FROM c),
k AS (SELECT DISTINCT '["' || c_custkey || '"]' AS key FROM r WHERE slot <= 200)
SELECT diff.key, kind FROM diff JOIN k ON k.key = diff.key""")
def v6_cdc_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of sampled changes, looked up on both sides and compared."""
    keys = sampling.reservoir(sampling.sample_keys(I.changes(spark, sf_dir), ["c_custkey"]), 200).select(R.key_identity(["c_custkey"]).alias("key")).distinct()
    sides = [diff.lookup(keys, diff.keyed_digests(df, ["c_custkey"], I.CUSTOMER), ["key"]) for df in (I.table(spark, sf_dir, "customer"), I.faulty_target(spark, sf_dir))]
    return diff.full_diff(*sides)


SAMPLE_COLUMNS = "leaf VARCHAR, slot INT, k BIGINT"
SAMPLES = [("p2", 1, 20), ("p1", 2, 12), ("p1", 1, 11), ("p3", 1, 30), ("p2", 2, 21)]


@query(f"WITH {I.values('s', SAMPLE_COLUMNS, SAMPLES)} SELECT leaf, slot, k FROM s ORDER BY leaf, slot LIMIT 3")
def t4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.key_budget(I.frame(spark, SAMPLE_COLUMNS, SAMPLES), 3)


TXN_COLUMNS = "number BIGINT, commit_lsn BIGINT, end_lsn BIGINT"
TXNS = [(1, 10, 12), (2, 14, 16), (3, 13, 18), (4, 20, 19), (5, 22, 24), (6, 25, 24), (7, 30, 31)]


@query(f"""WITH {I.values('t', TXN_COLUMNS, TXNS)}, l AS (SELECT *, lag(commit_lsn) OVER (ORDER BY number) AS pc, lag(end_lsn) OVER (ORDER BY number) AS pe FROM t)
SELECT number, commit_lsn, end_lsn FROM l WHERE commit_lsn <= pc OR end_lsn <= pe OR end_lsn < commit_lsn""")
def w4_order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.order_violations(I.frame(spark, TXN_COLUMNS, TXNS)).select("number", "commit_lsn", "end_lsn")


@query("SELECT max(event_id * 8 + 8) AS boundary, bool_or(event_id * 8 + 8 = 4003) AS exact FROM events WHERE event_id * 8 + 8 <= 4003")
def c20_end_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    txns = I.table(spark, sf_dir, "events").select((F.col("event_id") * 8 + 8).alias("end_lsn"))
    return fold.end_boundary(txns, 4003)


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT relation, count(*) AS n, min(end_lsn) AS first_lsn, max(end_lsn) AS last_lsn FROM c WHERE end_lsn > 800 AND end_lsn <= 6400 GROUP BY 1")
def p6_p7_p8_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Not yet applied, up to the end inclusively, and durable."""
    return fold.gated(I.multi_changes(spark, sf_dir), applied=800, end=6400, durable=1 << 40).groupBy("relation").agg(
        F.count("*").alias("n"), F.min("end_lsn").alias("first_lsn"), F.max("end_lsn").alias("last_lsn"))


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT relation, kind, count(*) AS n FROM c GROUP BY 1, 2")
def a14_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.multi_changes(spark, sf_dir).groupBy("relation", "kind").agg(F.count("*").alias("n"))


ORDINAL_COLUMNS = "ordinal INT, affected INT"
ORDINALS = [(0, 1), (1, 1), (2, 1), (2, 1), (4, 1)]


@query(f"WITH {I.values('o', ORDINAL_COLUMNS, ORDINALS)} SELECT r.i AS ordinal, count(o.ordinal) AS n FROM range(5) r(i) LEFT JOIN o ON o.ordinal = r.i GROUP BY 1 HAVING count(o.ordinal) <> 1")
def j3_ordinal_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch rows that did not affect exactly one target row."""
    affected = I.frame(spark, ORDINAL_COLUMNS, ORDINALS).select(F.col("ordinal").cast("bigint").alias("ordinal"))
    return capabilities.wrong_ordinals(affected, spark.range(5).select(F.col("id").alias("ordinal")))


# --- constraints -----------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 97 <> 0)")
def g9_fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose customer is missing from a parent with holes."""
    parent = I.table(spark, sf_dir, "customer").where("c_custkey % 97 <> 0")
    return constraints.fk_orphans(I.table(spark, sf_dir, "orders"), parent, ["o_custkey"], ["c_custkey"]).select("o_orderkey", "o_custkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def g9_unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constraints.unique_violations(I.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT (l_quantity < 50 OR l_discount < 0.09)")
def g9_check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = (F.col("l_quantity") < 50) | (F.col("l_discount") < 0.09)
    return constraints.check_violations(I.table(spark, sf_dir, "lineitem"), check).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


# --- graph ---------------------------------------------------------------------------

EDGE_COLUMNS = "parent VARCHAR, child VARCHAR"
EDGES = [("events", "ev_2024"), ("events", "ev_2025"), ("ev_2024", "ev_2024_a"), ("ev_2024", "ev_2024_b"), ("other", "o1")]


@query(f"WITH RECURSIVE {I.values('e', EDGE_COLUMNS, EDGES)}, t(name, depth) AS (SELECT 'events', 0 UNION ALL SELECT e.child, t.depth + 1 FROM t JOIN e ON e.parent = t.name) "
       "SELECT name, depth, name NOT IN (SELECT parent FROM e) AS is_leaf FROM t")
def r1_partition_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.partition_tree(spark, I.frame(spark, EDGE_COLUMNS, EDGES), "events")


DEP_COLUMNS = "source VARCHAR, target VARCHAR"
DEPS = [("orders", "orders_pkey"), ("orders", "seq"), ("orders_pkey", "btree"), ("seq", "orders"), ("view", "orders"), ("orders", "enum"), ("enum", "ext"), ("lost", "ext")]


@query(f"WITH RECURSIVE {I.values('d', DEP_COLUMNS, DEPS)}, t AS (SELECT 'orders' AS node UNION SELECT d.target FROM t JOIN d ON d.source = t.node) SELECT node FROM t")
def r3_dependency_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    I.checkpointed(spark)
    start = spark.createDataFrame([("orders",)], "node string")
    return graph.closure(I.frame(spark, DEP_COLUMNS, DEPS), start)


@query(f"WITH {I.values('d', DEP_COLUMNS, DEPS)} SELECT DISTINCT source AS owner, target AS sequence FROM d WHERE target IN ('seq') AND source IN ('orders', 'enum')")
def r4_sequence_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that selected tables own or default to."""
    name = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    return graph.sequence_owners(I.frame(spark, DEP_COLUMNS, DEPS), name("orders", "enum"), name("seq"))


# --- scalars -------------------------------------------------------------------------

LSN_COLUMNS = "text VARCHAR"
LSNS = [(t,) for t in ("0/0", "0/16B3748", "16/B374D848", "FFFFFFFF/FFFFFFFF")]


@query(f"WITH {I.values('l', LSN_COLUMNS, LSNS)} SELECT text, CAST(CAST('0x' || split_part(text, '/', 1) AS UBIGINT)::HUGEINT * 4294967296 + CAST('0x' || split_part(text, '/', 2) AS UBIGINT) AS DECIMAL(20,0)) AS value, text AS again FROM l")
def f3_lsn(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = R.lsn_parse(F.col("text"))
    return I.frame(spark, LSN_COLUMNS, LSNS).select("text", value.alias("value"), R.lsn_format(value).alias("again"))


LOCALE_COLUMNS = "a VARCHAR, b VARCHAR"
LOCALES = [("en_US.UTF-8", "en_US.utf8"), ("POSIX", "C"), ("de_DE@euro", "de_DE"), (" C.UTF-8 ", "c.utf_8"), ("fr_FR.ISO-8859-1", "fr_FR.iso88591"), ("", "")]
CANON = ("CASE WHEN contains(regexp_extract({0}, '^([^@]*)', 1), '.') AND regexp_extract({0}, '^[^.@]*[.]([^@]*)', 1) <> '' THEN replace(CASE WHEN regexp_extract({0}, '^([^.@]*)', 1) = 'posix' THEN 'c' ELSE regexp_extract({0}, '^([^.@]*)', 1) END, '', '') "
         "|| '.' || replace(replace(regexp_extract({0}, '^[^.@]*[.]([^@]*)', 1), '-', ''), '_', '') ELSE CASE WHEN regexp_extract({0}, '^([^.@]*)', 1) = 'posix' THEN 'c' ELSE regexp_extract({0}, '^([^.@]*)', 1) END END || regexp_extract({0}, '(@.*)$', 1)")


@query(f"WITH {I.values('l', LOCALE_COLUMNS, LOCALES)} SELECT a, b, {CANON.format('lower(trim(a))')} AS ca, {CANON.format('lower(trim(b))')} AS cb, {CANON.format('lower(trim(a))')} = {CANON.format('lower(trim(b))')} AS same FROM l")
def f4_locale(spark: SparkSession, sf_dir: str) -> DataFrame:
    ca, cb = R.canonical_locale(F.col("a")), R.canonical_locale(F.col("b"))
    return I.frame(spark, LOCALE_COLUMNS, LOCALES).select("a", "b", ca.alias("ca"), cb.alias("cb"), (ca == cb).alias("same"))


SIZE_COLUMNS = "text VARCHAR, bytes BIGINT, again VARCHAR"
SIZES = [("64MB", 67108864, "64MB"), ("1024kB", 1048576, "1MB"), ("3 GB", 3221225472, "3GB"), ("100", 100, "100B"), ("2tb", 2199023255552, "2048GB"), ("12x", None, None)]


@query(f"WITH {I.values('s', SIZE_COLUMNS, SIZES)} SELECT text, bytes, again FROM s")
def f5_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = R.parse_bytes(F.col("text"))
    return I.frame(spark, SIZE_COLUMNS, SIZES).select("text", value.alias("bytes"), R.format_bytes(value).alias("again"))


TIME_COLUMNS = "text VARCHAR, seconds DOUBLE, again VARCHAR"
TIMES = [("30min", 1800.0, "30min"), ("250ms", 0.25, "250ms"), ("2h", 7200.0, "2h"), ("86400", 86400.0, "1d"), ("90s", 90.0, "90s"), ("5y", None, None)]


@query(f"WITH {I.values('s', TIME_COLUMNS, TIMES)} SELECT text, seconds, again FROM s")
def f5_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = R.parse_seconds(F.col("text"))
    return I.frame(spark, TIME_COLUMNS, TIMES).select("text", value.alias("seconds"), R.format_seconds(value).alias("again"))


TEXT_COLUMNS = "i INT, text VARCHAR"
TEXTS = [(1, "plain"), (2, 'odd"name'), (3, "it's"), (4, "tab\there"), (5, "back\\slash"), (6, ""), (7, None), (8, "two\nlines")]


@query(f"WITH {I.values('t', TEXT_COLUMNS, TEXTS)} " + r"""SELECT i, '"' || replace(text, '"', '""') || '"' AS ident, '''' || replace(text, '''', '''''') || '''' AS lit,
coalesce(replace(replace(replace(text, '\', '\\'), chr(9), '\t'), chr(10), '\n'), '\N') AS copy FROM t""")
def f6_f9_quoting(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return I.frame(spark, TEXT_COLUMNS, TEXTS).select("i", R.quote_identifier(t).alias("ident"), R.quote_literal(t).alias("lit"), R.copy_text(t).alias("copy"))


SEQ_COLUMNS = "name VARCHAR, current BIGINT, low BIGINT, high BIGINT, increment BIGINT, cycles BOOLEAN"
SEQS = [("a", 100, 1, 2147483647, 1, N_), ("b", 2147483600, 1, 2147483647, 1, T_), ("c", -5, -10, -1, -1, N_), ("d", -9223372036854775807, -9223372036854775807, 9223372036854775807, 1, N_), ("e", 2147483647, 1, 2147483647, 1, N_)]
OFFSET, WARN = 1000, 1_000_000


@query(f"""WITH {I.values('s', SEQ_COLUMNS, SEQS)}, h AS (SELECT *, CAST(CASE WHEN increment < 0 THEN greatest(current::HUGEINT - low, 0) ELSE greatest(high::HUGEINT - current, 0) END AS DECIMAL(20,0)) AS room FROM s)
SELECT name, room, CASE WHEN room < {OFFSET} THEN 'error' WHEN room < {WARN} THEN 'warning' ELSE 'ok' END AS severity FROM h""")
def f8_headroom(spark: SparkSession, sf_dir: str) -> DataFrame:
    room = R.headroom(F.col("current"), F.col("low"), F.col("high"), F.col("increment"))
    return I.frame(spark, SEQ_COLUMNS, SEQS).withColumn("room", room).select("name", "room", preflight.sequence_severity(F.col("room"), OFFSET, WARN).alias("severity"))


@query(f"""WITH {I.values('s', SEQ_COLUMNS, SEQS)}, v AS (SELECT name, current, CAST(current::HUGEINT + CASE WHEN increment < 0 THEN -{OFFSET} ELSE {OFFSET} END AS DECIMAL(20,0)) AS target FROM s)
SELECT name, current, target, target > 9223372036854775807 OR target < -9223372036854775808 AS overflows FROM v""")
def g15_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute target values, ahead by the offset in the sequence's own direction."""
    return preflight.sequence_targets(I.frame(spark, SEQ_COLUMNS, SEQS), OFFSET).select("name", "current", "target", "overflows")


COUNT_COLUMNS = "n BIGINT, shown VARCHAR"
COUNTS = [(999, "999"), (9999, "9999"), (12345, "12k"), (1234567, "1.2M"), (130900000, "130.9M"), (5200000000, "5.2B")]


@query(f"WITH {I.values('c', COUNT_COLUMNS, COUNTS)} SELECT n, shown FROM c")
def f11_compact_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, COUNT_COLUMNS, COUNTS).select("n", R.compact_count(F.col("n")).alias("shown"))


DEF_COLUMNS = "i INT, text VARCHAR"
DEFS = [(1, "CHECK  (x >\n 0) NOT VALID"), (2, " FOREIGN KEY (a)\tREFERENCES b(c) "), (3, "UNIQUE (x)")]


@query(f"WITH {I.values('d', DEF_COLUMNS, DEFS)} SELECT i, regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '(?i) NOT VALID$', '') AS text FROM d")
def f12_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, DEF_COLUMNS, DEFS).select("i", R.normal_definition(F.col("text")).alias("text"))


ERR_COLUMNS = "i INT, sqlstate VARCHAR, message VARCHAR"
ERRS = [(1, "23505", "duplicate key"), (2, "", "broken pipe"), (3, None, "broken pipe"), (4, "08006", "gone")]


@query(f"WITH {I.values('e', ERR_COLUMNS, ERRS)} SELECT i, CASE WHEN coalesce(sqlstate, '') <> '' THEN sqlstate ELSE sha256(message) END AS signature, "
       "coalesce(sqlstate, '') LIKE '08%' OR coalesce(sqlstate, '') IN ('57P01', '57P02', '57P03') AS reconnect FROM e")
def f14_c14_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, ERR_COLUMNS, ERRS).select(
        "i", R.failure_signature(F.col("sqlstate"), F.col("message")).alias("signature"), R.connection_lost(F.col("sqlstate")).alias("reconnect"))


COLL_COLUMNS = "name VARCHAR, sp VARCHAR, sl VARCHAR, sv VARCHAR, tp VARCHAR, tl VARCHAR, tv VARCHAR"
COLLS = [("same", "icu", "en-us", "153.1", "icu", "en-us", "153.1"), ("version", "icu", "en-us", "153.1", "icu", "en-us", "153.2"), ("locale", "icu", "en-us", "1", "icu", "de-de", "2"),
         ("provider", "libc", "c", "", "icu", "c", "1"), ("unknown", "icu", "en-us", "", "icu", "en-us", "153.2")]


@query(f"WITH {I.values('c', COLL_COLUMNS, COLLS)} SELECT name, sp <> tp AS provider, lower(sl) <> lower(tl) AS locale, lower(sl) = lower(tl) AND sv <> tv AND sv <> '' AND tv <> '' AS version FROM c")
def g4_collation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of difference; a version counts only between equal locales."""
    return preflight.collation_differences(I.frame(spark, COLL_COLUMNS, COLLS))


WAL_COLUMNS = "i INT, retained BIGINT, slot_limit BIGINT, max_wal BIGINT, directory BIGINT"
WALS = [(1, 100, 100, 50, 10), (2, 99, 100, 50, 500), (3, 400, -1, 100, 450), (4, 400, -1, 100, 150), (5, 350, -1, 100, -1), (6, 50, -1, 100, 900), (7, 150, -1, 100, -1)]
GROWTH = 3


@query(f"WITH {I.values('w', WAL_COLUMNS, WALS)} SELECT i, CASE WHEN slot_limit >= 0 THEN retained >= slot_limit WHEN max_wal <= 0 OR retained <= max_wal THEN false WHEN directory < 0 THEN retained >= {GROWTH} * max_wal ELSE directory >= {GROWTH} * max_wal END AS alarm FROM w")
def g16_wal_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    alarm = preflight.log_alarm(*(F.col(c) for c in ("retained", "slot_limit", "max_wal", "directory")))
    return I.frame(spark, WAL_COLUMNS, WALS).select("i", alarm.alias("alarm"))


RETENTION_COLUMNS = "i INT, limit_bytes BIGINT, generated DOUBLE, sample_s DOUBLE, keep_s DOUBLE"
RETENTIONS = [(1, 1000000, 5000.0, 10.0, 3600.0), (2, 1000000, 100.0, 10.0, 3600.0)]


@query(f"WITH {I.values('r', RETENTION_COLUMNS, RETENTIONS)} SELECT i, CAST(floor(generated / sample_s * keep_s) AS BIGINT) AS required, CAST(floor(generated / sample_s * keep_s) AS BIGINT) > limit_bytes AS warns FROM r")
def g3_wal_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    need = preflight.required_log(F.col("generated"), F.col("sample_s"), F.col("keep_s"))
    return I.frame(spark, RETENTION_COLUMNS, RETENTIONS).select("i", need.alias("required"), (need > F.col("limit_bytes")).alias("warns"))


# --- operations ------------------------------------------------------------------------

SEGMENT_COLUMNS = "name VARCHAR, start_lsn BIGINT, last_end BIGINT, finalized BOOLEAN"
SEGMENTS = [("s1", 0, 100, T_), ("s2", 100, 200, T_), ("s3", 200, 300, T_), ("s4", 300, 400, T_), ("s5", 400, 450, N_)]


@query(f"WITH {I.values('s', SEGMENT_COLUMNS, SEGMENTS)}, e AS (SELECT *, row_number() OVER (ORDER BY start_lsn DESC) AS newest, row_number() OVER (ORDER BY start_lsn) AS oldest FROM s WHERE finalized AND last_end < 400) "
       "SELECT name, start_lsn FROM e WHERE newest > 1 AND oldest <= 128")
def k7_prune_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finalized segments wholly applied, but the newest of them, at most 128 a pass."""
    from ledgerfold.sources.segments import prunable

    rows = I.frame(spark, SEGMENT_COLUMNS, SEGMENTS).collect()
    gone = prunable([(r.name, r.start_lsn, not r.finalized) for r in rows], {r.name: r.last_end for r in rows}, 400)
    return spark.createDataFrame([(r.name, r.start_lsn) for r in rows if r.name in gone], "name string, start_lsn bigint")


LAG_COLUMNS = "stream VARCHAR, staged VARCHAR, applied VARCHAR"
LAGS = [("a", "0/2000", "0/1000"), ("b", "1/0", "0/FFFFFFFF"), ("c", "0/10", "0/20")]


@query(f"WITH {I.values('l', LAG_COLUMNS, LAGS)}, p AS (SELECT stream, CAST('0x' || split_part(staged, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(staged, '/', 2) AS BIGINT) AS s, "
       "CAST('0x' || split_part(applied, '/', 1) AS BIGINT) * 4294967296 + CAST('0x' || split_part(applied, '/', 2) AS BIGINT) AS a FROM l) SELECT stream, greatest(s - a, 0) AS lag FROM p")
def y10_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, LAG_COLUMNS, LAGS).select("stream", R.lsn_lag(R.lsn_parse(F.col("staged")), R.lsn_parse(F.col("applied"))).cast("bigint").alias("lag"))


ATTEMPT_COLUMNS = "n INT, signature VARCHAR"
ATTEMPTS = [(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "a"), (6, "a")]


@query(f"WITH {I.values('a', ATTEMPT_COLUMNS, ATTEMPTS)}, g AS (SELECT *, sum(CASE WHEN p IS DISTINCT FROM signature THEN 1 ELSE 0 END) OVER (ORDER BY n) AS island FROM (SELECT *, lag(signature) OVER (ORDER BY n) AS p FROM a)) "
       "SELECT n, signature, row_number() OVER (PARTITION BY island ORDER BY n) AS streak, row_number() OVER (PARTITION BY island ORDER BY n) >= 2 AS blocked FROM g")
def a11_failure_streak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each failure came in a row, recorded in the control state."""
    control_ = control.ControlStore(I.work_folder(spark, "control"))
    rows = I.frame(spark, ATTEMPT_COLUMNS, ATTEMPTS).orderBy("n").collect()
    seen = [(r.n, r.signature, control_.record_failure(r.signature, "")) for r in rows]
    return spark.createDataFrame([(*x, x[2] >= control.REPEATS) for x in seen], "n int, signature string, streak bigint, blocked boolean")


RATE_COLUMNS = "n INT, rows BIGINT, seconds DOUBLE"
RATES = [(1, 1000, 2.0), (2, 3000, 2.0), (3, 500, 1.0), (4, 8000, 4.0)]


@query(f"WITH RECURSIVE {I.values('r', RATE_COLUMNS, RATES)}, e(n, rate) AS (SELECT n, rows / seconds FROM r WHERE n = 1 UNION ALL SELECT r.n, e.rate + 0.3 * (r.rows / r.seconds - e.rate) FROM e JOIN r ON r.n = e.n + 1) "
       "SELECT round(rate, 6) AS rate, round(10000 / rate, 6) AS eta_s FROM e ORDER BY n DESC LIMIT 1")
def a9_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed throughput and the time left, folded in order."""
    return verification.smoothed_rate(I.frame(spark, RATE_COLUMNS, RATES), 10_000)


STATUS_COLUMNS = "kind VARCHAR, completed BOOLEAN"
STATUSES = [("part", T_), ("part", T_), ("part", N_), ("index", T_), ("constraint", N_)]


@query(f"WITH {I.values('s', STATUS_COLUMNS, STATUSES)} SELECT kind, count(CASE WHEN completed THEN 1 END) AS done, count(*) AS total FROM s GROUP BY kind")
def a1_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.status_counts(I.frame(spark, STATUS_COLUMNS, STATUSES))


# --- streaming --------------------------------------------------------------------------


@query(FOLD_SQL)
def y_stream_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log as a file stream that grows, applied in micro-batches with
    exactly-once commits; the state must equal that of ``c2_fold_state``."""
    from ledgerfold.plans.versioned import VersionedStore
    from ledgerfold.streaming.apply import change_stream, follow

    folder = I.work_folder(spark, "stream")
    log = I.changes(spark, sf_dir)
    span = log.agg(F.max("end_lsn")).first()[0] + 1
    store = VersionedStore(spark, f"{folder}/store")
    store.commit(store.manifest(), {"customer": store.stage_buckets("customer", I.snapshot(spark, sf_dir), ["c_custkey"], 8)})
    keys, cols = {"customer": ["c_custkey"]}, {"customer": ["c_acctbal", "c_mktsegment"]}
    for i in range(4):  # the log grows, and the stream is started again from its checkpoint
        log.where((F.col("end_lsn") >= span * i // 4) & (F.col("end_lsn") < span * (i + 1) // 4)).write.mode("append").parquet(f"{folder}/log")
        follow(change_stream(spark, f"{folder}/log", log.schema), store, keys, cols, "g1", f"{folder}/checkpoint").awaitTermination()
    return store.read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")
