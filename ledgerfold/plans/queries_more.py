"""Further registered queries: projections, joins on catalogues, apply rules,
verification runs, sources and sinks, control rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


from ledgerfold.functions import catalog
from ledgerfold.functions import render as R
from ledgerfold.operators import capabilities, diff, fold, graph, parts, sampling
from ledgerfold.plans import control, preflight, verification
from ledgerfold.plans import inputs as I
from ledgerfold.plans.queries import BUDGET, BUDGET_SQL, FINDING_COLUMNS, FINDINGS, HEAP_COLUMNS, HEAPS, N_, T_, WINDOWS, query
from ledgerfold.sources import changes

# --- projections and predicates ---------------------------------------------------

COLUMN_COLUMNS = "table_name VARCHAR, ord INT, name VARCHAR, generated BOOLEAN"
COLUMNS = [("items", 1, "id", N_), ("items", 2, "note", N_), ("items", 3, "note_length", T_), ("totals", 1, "answer", T_)]


@query(f"WITH {I.values('c', COLUMN_COLUMNS, COLUMNS)} SELECT table_name, coalesce(string_agg(CASE WHEN NOT generated THEN name END, ',' ORDER BY ord), '') AS columns, count(CASE WHEN NOT generated THEN 1 END) = 0 AS generated_only FROM c GROUP BY 1")
def p1_column_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated columns are never copied or applied."""
    return changes.writable_columns(I.frame(spark, COLUMN_COLUMNS, COLUMNS)).select("table_name", F.array_join("columns", ",").alias("columns"), "generated_only")


@query("SELECT '[\"' || n_nationkey || '\"]' AS key, md5(CAST(n_nationkey AS VARCHAR) || chr(31) || n_name || chr(31) || n_regionkey) AS digest FROM nation")
def p2_key_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.keyed_digests(I.table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


ROW_COLUMNS = "id INT, a VARCHAR, b VARCHAR"
LEFT, RIGHT = [(1, "x", None), (2, "", "y"), (3, None, None), (4, "q", "r")], [(10, "x", None), (20, None, "y"), (30, None, None), (40, "q", "r")]


@query(f"WITH {I.values('l', ROW_COLUMNS, LEFT)}, {I.values('r', ROW_COLUMNS, RIGHT)} SELECT l.id, r.id AS found FROM l JOIN r ON l.a IS NOT DISTINCT FROM r.a AND l.b IS NOT DISTINCT FROM r.b")
def p9_identity_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows found by all their columns, null-safe; empty is not null."""
    left, right = I.frame(spark, ROW_COLUMNS, LEFT).alias("l"), I.frame(spark, ROW_COLUMNS, RIGHT).alias("r")
    return left.join(right, capabilities.same_row("l", "r", ["a", "b"])).select(F.col("l.id").alias("id"), F.col("r.id").alias("found"))


SET_COLUMNS = "change INT, name VARCHAR, is_key BOOLEAN, cell VARCHAR, changed BOOLEAN"
SETS = [(1, "id", T_, "t", N_), (1, "note", N_, "u", N_), (1, "qty", N_, "t", T_), (2, "id", T_, "t", T_), (2, "note", N_, "n", T_), (3, "id", T_, "t", N_), (3, "note", N_, "u", N_)]


@query(f"WITH {I.values('s', SET_COLUMNS, SETS)} SELECT change, coalesce(string_agg(CASE WHEN cell <> 'u' AND NOT (is_key AND NOT changed) THEN name END, ',' ORDER BY name), '') AS set_list FROM s GROUP BY 1")
def p10_set_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns an update sets: no unchanged cells, no unchanged key columns."""
    return changes.set_list(I.frame(spark, SET_COLUMNS, SETS)).select("change", F.array_join("columns", ",").alias("set_list"))


ENTRY_COLUMNS = "line VARCHAR, dump_id BIGINT, kind VARCHAR, phase VARCHAR"
ENTRIES = [
    ("215; 1259 16389 TABLE public orders owner", 215, "TABLE", "pre-data"), ("3300; 0 16389 TABLE DATA public orders owner", 3300, "TABLE DATA", "skipped"),
    ("3160; 2606 16393 FK CONSTRAINT public orders fk owner", 3160, "FK CONSTRAINT", "deferred"), ("7; 1259 1 INDEX public i owner", 7, "INDEX", "index"),
    ("9; 0 0 SEQUENCE SET public s owner", 9, "SEQUENCE SET", "skipped"), ("11; 2620 5 TRIGGER public orders t owner", 11, "TRIGGER", "deferred"), ("12; 0 0 INDEX ATTACH public p owner", 12, "INDEX ATTACH", "index"),
    ("13; 0 0 COMMENT - EXTENSION citext ", 13, "COMMENT", "skipped"), ("14; 0 0 COMMENT public TABLE orders owner", 14, "COMMENT", "deferred"), ("15; 0 0 CONSTRAINT public pk owner", 15, "CONSTRAINT", "constraint")]


@query(f"WITH {I.values('e', ENTRY_COLUMNS, ENTRIES)} SELECT dump_id, kind, phase FROM e")
def p11_s17_archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ledgerfold.sources import archive_list

    return archive_list.parse(I.frame(spark, ENTRY_COLUMNS, ENTRIES).select("line")).select("dump_id", "kind", archive_list.restore_class(F.col("kind"), F.col("rest")).alias("phase"))


MESSAGE_COLUMNS = "lsn BIGINT, prefix VARCHAR, transactional BOOLEAN"
MESSAGES = [(10, "cut", N_), (20, "cut", T_), (30, "other", N_), (40, "cut", N_)]


@query(f"WITH {I.values('m', MESSAGE_COLUMNS, MESSAGES)} SELECT lsn AS commit_lsn, lsn AS end_lsn, CAST(0 AS BIGINT) AS changes FROM m WHERE prefix = 'cut' AND NOT transactional")
def p12_boundary_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary messages are empty transactions at their position."""
    return changes.boundary_transactions(I.frame(spark, MESSAGE_COLUMNS, MESSAGES), "cut")


# --- joins on catalogues ---------------------------------------------------------------


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT relation, count(*) AS n FROM c WHERE relation NOT IN ('click', 'view') GROUP BY 1")
def j4_unknown_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes whose relation is not announced: each is a divergence."""
    known = spark.createDataFrame([("click",), ("view",)], "relation string")
    return changes.unknown_relations(I.multi_changes(spark, sf_dir), known).groupBy("relation").agg(F.count("*").alias("n"))


PROGRESS_COLUMNS = "name VARCHAR, done BIGINT"
PROGRESS = [("orders", 10), ("gone", 5)]
STOCK_COLUMNS = "name VARCHAR, total BIGINT"
STOCK = [("orders", 40), ("items", 7)]


@query(f"WITH {I.values('s', STOCK_COLUMNS, STOCK)}, {I.values('p', PROGRESS_COLUMNS, PROGRESS)} SELECT s.name, total, coalesce(done, 0) AS done FROM s LEFT JOIN p ON p.name = s.name")
def j6_status_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.progress_of(I.frame(spark, STOCK_COLUMNS, STOCK), I.frame(spark, PROGRESS_COLUMNS, PROGRESS))


@query(f"WITH {I.values('s', STOCK_COLUMNS, STOCK)}, {I.values('p', PROGRESS_COLUMNS, PROGRESS)} SELECT name, done FROM p WHERE name IN (SELECT name FROM s)")
def j8_recorded_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded relations that still exist."""
    return control.still_there(I.frame(spark, PROGRESS_COLUMNS, PROGRESS), I.frame(spark, STOCK_COLUMNS, STOCK))


COVER_COLUMNS = "relation VARCHAR, have VARCHAR, need VARCHAR"
COVERS = [("a", "id,day", "id"), ("b", "id", "id,day"), ("c", "x,y", "y,x")]


@query(f"WITH {I.values('c', COVER_COLUMNS, COVERS)} SELECT relation, len(list_filter(string_split(need, ','), lambda x: NOT list_contains(string_split(have, ','), x))) = 0 AS usable FROM c")
def j9_key_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorded key serves a verification key if it has all its columns."""
    return I.frame(spark, COVER_COLUMNS, COVERS).select("relation", capabilities.key_covers(F.split("have", ","), F.split("need", ",")).alias("usable"))


# --- aggregates ------------------------------------------------------------------------

RUN_COLUMNS = "table_name VARCHAR, converged BOOLEAN, complete BOOLEAN, warning VARCHAR"
RUNS = [("a", T_, T_, None), ("b", T_, T_, "b was not compared"), ("c", N_, T_, None), ("d", T_, T_, "b was not compared")]


@query(f"WITH {I.values('r', RUN_COLUMNS, RUNS)} SELECT bool_and(converged) AS converged, bool_and(complete) AS complete, string_agg(DISTINCT warning, ';') AS warnings FROM r")
def a4_run_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run is as good as its worst table; what was warned of is told once."""
    rows = I.frame(spark, RUN_COLUMNS, RUNS).collect()
    summary = verification.roll_up([verification.TableResult(r.table_name, converged=r.converged, complete=r.complete, warnings=[r.warning] if r.warning else []) for r in rows])
    return spark.createDataFrame([(summary["converged"], summary["complete"], ";".join(summary["warnings"]))], "converged boolean, complete boolean, warnings string")


@query(f"""WITH {I.values('h0', HEAP_COLUMNS, HEAPS)}, {BUDGET_SQL} SELECT table_name, count(DISTINCT leaf) AS heaps FROM h GROUP BY 1""")
def a8_distinct_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps that the sample windows of each table read."""
    windows = sampling.sample_windows(sampling.leaf_budgets(I.frame(spark, HEAP_COLUMNS, HEAPS), BUDGET), WINDOWS)
    return sampling.heaps_read(windows)


# --- apply rules -----------------------------------------------------------------------

CAP_COLUMNS = "relation VARCHAR, kind VARCHAR, rls BOOLEAN, triggers INT, checks INT, generated INT, partial INT, custom INT"
CAPS = [("plain", "r", N_, 0, 0, 0, 0, 0), ("view", "v", N_, 0, 0, 0, 0, 0), ("rls", "r", T_, 0, 0, 0, 0, 0), ("trig", "r", N_, 1, 0, 0, 0, 0), ("chk", "r", N_, 0, 2, 0, 0, 0), ("cust", "r", N_, 0, 0, 0, 0, 1)]


@query(f"WITH {I.values('c', CAP_COLUMNS, CAPS)} SELECT relation, kind = 'r' AND NOT rls AND triggers = 0 AND checks = 0 AND generated = 0 AND partial = 0 AND custom = 0 AS foldable FROM c")
def c5_capability_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations whose changes may be regrouped; the others are ordered barriers."""
    return capabilities.foldable(I.frame(spark, CAP_COLUMNS, CAPS))


TUPLE_COLUMNS = "change INT, kind VARCHAR, old_key BIGINT, new_key BIGINT"
TUPLES = [(1, "I", None, 5), (2, "U", None, 5), (3, "U", 5, 6), (4, "D", 6, None)]


@query(f"WITH {I.values('t', TUPLE_COLUMNS, TUPLES)} SELECT change, CASE kind WHEN 'U' THEN coalesce(old_key, new_key) WHEN 'D' THEN old_key END AS where_key, coalesce(new_key, old_key) AS sampled_key FROM t")
def c10_v7_predicate_and_sample_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key that a change is found by, and the one that is sampled for it."""
    old, new = F.col("old_key"), F.col("new_key")
    return I.frame(spark, TUPLE_COLUMNS, TUPLES).select("change", changes.where_key(F.col("kind"), old, new).alias("where_key"), changes.sampled_key(old, new).alias("sampled_key"))


@query("""SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer""")
def c11_key_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that move keys, as deletes and inserts, folded and checked."""
    base = I.table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    log = base.where("c_custkey % 10 = 0").select(
        F.lit("customer").alias("relation"), (F.col("c_custkey") * 8).alias("end_lsn"), F.lit(0).alias("seq"), F.lit("U").alias("kind"),
        (F.col("c_custkey") + 10000000).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.array().cast("array<string>").alias("toast"), F.col("c_custkey").alias("old_c_custkey"))
    return fold.checked_fold(base, fold.split_key_changes(log, ["c_custkey"]), ["c_custkey"], ["c_acctbal"])


GUARD_COLUMNS = "stored VARCHAR, given VARCHAR, copied BOOLEAN"
GUARDS = [(None, "g1", N_), ("g1", "g1", T_), ("g1", "g2", T_), (None, "g1", T_)]


@query(f"WITH {I.values('g', GUARD_COLUMNS, GUARDS)} SELECT stored, given, copied, CASE WHEN stored IS NULL THEN copied ELSE stored <> given END AS fatal FROM g")
def c19_generation_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress of another stream, or none after a finished copy, is fatal."""
    from ledgerfold.plans.versioned import generation_fatal

    rows = I.frame(spark, GUARD_COLUMNS, GUARDS).collect()
    return spark.createDataFrame([(*r, generation_fatal(r.stored, r.given, r.copied)) for r in rows], "stored string, given string, copied boolean, fatal boolean")


INDEX_COLUMNS = "name VARCHAR, columns VARCHAR"
INDEXES = [("a", "id,day"), ("b", "x")]


@query(f"WITH {I.values('i', INDEX_COLUMNS, INDEXES)} SELECT name, o AS ord, string_split(columns, ',')[o] AS col FROM i, unnest(generate_series(1, len(string_split(columns, ',')))) AS g(o)")
def w10_ordinality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.index_columns(I.frame(spark, INDEX_COLUMNS, INDEXES))


@query(f"WITH {I.values('f', FINDING_COLUMNS, FINDINGS)} SELECT id, severity, row_number() OVER (ORDER BY id) AS turn FROM f UNION ALL SELECT 'zz', 'info', (SELECT count(*) FROM f) + 1")
def t5_u4_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of several checks, appended and in order."""
    f = I.frame(spark, FINDING_COLUMNS, FINDINGS)
    more = spark.createDataFrame([("zz", "tuning", "info", False)], f.schema)
    return diff.merge_findings(f, more).select("id", "severity", F.row_number().over(W.orderBy("id")).cast("bigint").alias("turn"))


FILE_COLUMNS = "name VARCHAR, start_lsn BIGINT, partial BOOLEAN"
FILES = [("c", 30, T_), ("a", 10, N_), ("b", 30, N_)]


@query(f"WITH {I.values('f', FILE_COLUMNS, FILES)} SELECT name, row_number() OVER (ORDER BY start_lsn, partial) AS turn FROM f")
def t6_segment_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment files in the order of their starts, finalized before partial."""
    from ledgerfold.sources import segments, shared

    folder = I.work_folder(spark, "listing")
    files, names = shared.shared_folder(folder), {}
    for name, start, partial in FILES:
        file = f"{start:016x}.seg" + (".partial" if partial else "")
        names[file] = name
        files.create(file, b"")
    found = [names[path.rpartition("/")[2]] for path, _, _ in segments.list_segments(folder)]
    return spark.createDataFrame([(n, i + 1) for i, n in enumerate(found)], "name string, turn bigint")


TYPE_COLUMNS = "source VARCHAR, target VARCHAR"
TYPES = [("moods", "mood"), ("code", "text_ci"), ("text_ci", "ext:citext"), ("mood", "text"), ("loop_a", "loop_b"), ("loop_b", "loop_a")]


@query(f"WITH RECURSIVE {I.values('d', TYPE_COLUMNS, TYPES)}, t AS (SELECT 'code' AS node UNION SELECT 'loop_a' UNION SELECT d.target FROM t JOIN d ON d.source = t.node) SELECT node FROM t")
def r2_u1_type_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types to base types to extensions; cycles end the search."""
    I.checkpointed(spark)
    return graph.closure(I.frame(spark, TYPE_COLUMNS, TYPES), spark.createDataFrame([("code",), ("loop_a",)], "node string"))


# --- scalars ---------------------------------------------------------------------------

BOUND_COLUMNS = "lo BIGINT, hi BIGINT, n BIGINT"
BOUNDS = [(-9223372036854775807, 9223372036854775807, 4), (0, 99, 8), (5, 5, 2)]


@query(f"WITH {I.values('b', BOUND_COLUMNS, BOUNDS)} SELECT lo, hi, n, CAST((hi::HUGEINT - lo + 1 + n - 1) // n AS DECIMAL(20,0)) AS width FROM b")
def f7_range_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths of key ranges over the whole 64-bit range, without overflow."""
    return I.frame(spark, BOUND_COLUMNS, BOUNDS).withColumn("width", parts.range_width(F.col("lo"), F.col("hi"), F.col("n")))


CELL_COLUMNS = "oid INT, hex VARCHAR, shown VARCHAR"
CELLS = [(16, "01", "t"), (21, "FFFE", "-2"), (23, "0000002A", "42"), (20, "FFFFFFFFFFFFFFFF", "-1"), (25, "6869", "hi"), (17, "00FF", "\\x00ff"), (9999, "00", None)]


@query(f"WITH {I.values('c', CELL_COLUMNS, CELLS)} SELECT oid, hex, shown FROM c")
def f10_binary_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary cells as text by type; an unknown type gives none."""
    return I.frame(spark, CELL_COLUMNS, CELLS).select("oid", "hex", changes.binary_text(F.col("oid"), F.unhex("hex")).alias("shown"))


@query("SELECT sha256('cluster-1/shop') AS source, sha256('cluster-1/shop' || chr(10) || 'shop.*') AS generation, substr(sha256('cluster-1/shop'), 1, 16) AS name")
def f13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = "cluster-1/shop"
    row = (control.source_fingerprint(source), control.generation_of(source, "shop.*"), control.stream_name(source))
    return spark.createDataFrame([row], "source string, generation string, name string")


TOOL_COLUMNS = "line VARCHAR, major INT"
TOOLS = [("pg_dump (PostgreSQL) 17.2", 17), ("pg_restore (PostgreSQL) 16.10 (Debian)", 16), ("no version", None)]


@query(f"WITH {I.values('t', TOOL_COLUMNS, TOOLS)} SELECT line, major FROM t")
def f15_tool_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.frame(spark, TOOL_COLUMNS, TOOLS).select("line", R.tool_major(F.col("line")).alias("major"))


# --- verification -----------------------------------------------------------------------


@query(f"""WITH {I.diff_ctes()}, b AS (SELECT min(c_custkey) AS lo, (max(c_custkey) - min(c_custkey) + 16) // 16 AS w FROM customer),
s AS (SELECT '["' || c_custkey || '"]' AS key, row_number() OVER (PARTITION BY (c_custkey - lo) // w ORDER BY c_custkey) AS rn FROM customer, b)
SELECT diff.key, kind FROM diff JOIN s ON s.key = diff.key WHERE rn <= 20""")
def v3_window_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled windows of the source against keyed look-ups of the target."""
    source = I.table(spark, sf_dir, "customer")
    left = diff.keyed_digests(sampling.sample_rows(source, "c_custkey", 320, 16, 20), ["c_custkey"], I.CUSTOMER)
    right = diff.lookup(left.select("key"), diff.keyed_digests(I.faulty_target(spark, sf_dir), ["c_custkey"], I.CUSTOMER), ["key"])
    return diff.full_diff(left, right)


@query(f"WITH {I.diff_ctes()} SELECT key, kind FROM diff WHERE kind <> 'source_only'")
def v4_recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains when the target is read again at a later position, at which the
    rows in flight (the missing ones) have arrived."""
    from ledgerfold.plans.verification import recheck

    I.checkpointed(spark)
    source, stale = I.table(spark, sf_dir, "customer"), I.faulty_target(spark, sf_dir)
    late = stale.unionByName(source.where("c_custkey % 37 = 0"))
    sides = [diff.keyed_digests(df, ["c_custkey"], I.CUSTOMER) for df in (source, stale)]
    return recheck(lambda: source, lambda position: stale if position is None else late, diff.full_diff(*sides), ["c_custkey"], mark=lambda: 7, wait=lambda p: None, rounds=2, columns=I.CUSTOMER)


# --- sources and sinks -------------------------------------------------------------------


@query("SELECT * FROM orders")
def k2_snapshot_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table copied part by part with markers, committed once, and read back."""
    from ledgerfold.plans.versioned import VersionedStore, copy_snapshot

    source = I.table(spark, sf_dir, "orders")
    low, high = parts.key_bounds(source, "o_orderkey").first()
    store = VersionedStore(spark, I.work_folder(spark, "copy"))
    copy_snapshot(store, "orders", source, parts.key_parts("orders", "o_orderkey", low, high, 4 << 20, 1 << 20, 4))
    return store.read("orders")


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT 'log.' || relation AS relation, kind, count(*) AS n, sum(end_lsn)::BIGINT AS lsns FROM c GROUP BY 1, 2")
def s12_segment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change log written to checksummed segment files by tasks, read by the data
    source."""
    from ledgerfold.sources import segments

    folder = I.work_folder(spark, "segments")
    text = lambda c: F.struct(F.lit("t").alias("kind"), F.encode(F.col(c).cast("string"), "utf-8").alias("data"))
    row = F.array(text("k"), text("v"))
    columns = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(o).cast("bigint").alias("type_oid"), F.lit(k).alias("is_key")) for n, o, k in (("k", 20, True), ("v", 701, False))])
    rows = I.multi_changes(spark, sf_dir).select(
        F.concat(F.lit("log."), "relation").alias("relation"), F.pmod(F.crc32(F.col("relation").cast("binary")), F.lit(1 << 31)).cast("bigint").alias("oid"),
        (F.col("end_lsn") - 1).alias("commit_lsn"), "end_lsn", F.lit(0).cast("bigint").alias("commit_us"), "seq", "kind",
        F.when(F.col("kind") == "D", row).alias("old"), F.when(F.col("kind").isin("I", "U"), row).alias("new"), columns.alias("columns"),
        F.lit(False).alias("truncate_cascade"), F.lit(False).alias("truncate_restart"))
    segments.write_segments(rows, folder, files=4).collect()  # a row a file
    spark.dataSource.register(segments.SegmentSource)
    return spark.read.format("change_segments").option("path", folder).load().groupBy("relation", "kind").agg(F.count("*").alias("n"), F.sum("end_lsn").alias("lsns"))


@query("SELECT i AS row_number, i * 2 AS doubled FROM range((SELECT count(*) FROM nation)) r(i)")
def k4_generated_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without writable columns: as many rows as the source has, their
    columns computed."""
    n = I.table(spark, sf_dir, "nation").count()
    return capabilities.generated_rows(spark, n, row_number=F.col("id"), doubled=F.col("id") * 2)


SLOT_COLUMNS = "batch INT, relation VARCHAR, slot INT, k BIGINT"
SLOTS = [(1, "a", 1, 10), (1, "a", 2, 11), (2, "a", 1, 12), (2, "b", 1, 20), (3, "a", 2, 13)]


@query(f"WITH {I.values('s', SLOT_COLUMNS, SLOTS)} SELECT relation, slot, arg_max(k, batch) AS k FROM s GROUP BY 1, 2")
def k12_sample_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.upsert_slots(I.frame(spark, SLOT_COLUMNS, SLOTS))


REPLAY_COLUMNS = "arrival INT, end_lsn BIGINT"
REPLAYS = [(1, 10), (2, 20), (3, 10), (4, 20), (5, 30), (6, 25), (7, 40)]


@query(f"WITH {I.values('r', REPLAY_COLUMNS, REPLAYS)}, m AS (SELECT *, max(end_lsn) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r) SELECT arrival, end_lsn FROM m WHERE seen IS NULL OR end_lsn > seen")
def y4_k6_replay_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions at or before the last one kept are repeats after a reconnect."""
    from ledgerfold.sources.segments import fresh_transactions

    arrivals = [(r.arrival, r.end_lsn) for r in I.frame(spark, REPLAY_COLUMNS, REPLAYS).orderBy("arrival").collect()]
    return spark.createDataFrame(list(fresh_transactions(arrivals)), "arrival int, end_lsn bigint")


# --- control ---------------------------------------------------------------------------

MEMORY_COLUMNS = "memory BIGINT, workers BIGINT"
MEMORIES = [(1 << 30, 2), (256 << 20, 8), (1 << 40, 2), (64 << 30, 4)]
LEAST, MOST = 64 << 20, 16 << 30


@query(f"WITH {I.values('m', MEMORY_COLUMNS, MEMORIES)} SELECT memory, workers, greatest({LEAST}, least({MOST}, memory // 2 // workers)) AS work_memory FROM m")
def g6_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.frame(spark, MEMORY_COLUMNS, MEMORIES).collect()
    return spark.createDataFrame([(*r, control.work_memory(r.memory, r.workers)) for r in rows], "memory bigint, workers bigint, work_memory bigint")


@query("SELECT a.i AS now, b.i AS wanted, b.i - a.i IN (0, 1) AS allowed FROM range(10) a(i), range(10) b(i)")
def g11_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases go forward by exactly one; the same again is nothing."""
    pairs = [(i, j, control.allowed(a, b)) for i, a in enumerate(control.PHASES) for j, b in enumerate(control.PHASES)]
    return spark.createDataFrame(pairs, "now bigint, wanted bigint, allowed boolean")


@query("SELECT i AS attempt, CAST(100 * pow(2, i) AS BIGINT) AS wait_ms FROM range(5) r(i)")
def g17_retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(i, round(1000 * w)) for i, w in enumerate(control.retry_waits(5))], "attempt bigint, wait_ms bigint")


TIMEOUT_COLUMNS = "side VARCHAR, name VARCHAR, ms BIGINT"
TIMEOUTS = [("source", "statement_timeout", 30000), ("target", "idle_session_timeout", 0), ("target", "statement_timeout", 1500)]


@query(f"WITH {I.values('t', TIMEOUT_COLUMNS, TIMEOUTS)} SELECT side || '-' || replace(name, '_', '-') AS id, 'warning' AS severity FROM t WHERE ms <> 0")
def g3_timeout_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = I.frame(spark, TIMEOUT_COLUMNS, TIMEOUTS).select("side", "name", F.col("ms").cast("string").alias("value"))
    return preflight.check_timeouts({"settings": settings}).select("id", "severity")