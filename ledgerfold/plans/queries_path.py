"""Registered queries of whole paths: captured messages to tables, a readiness run,
logs read in ranges and as streams, resumed samples, maintenance, cutover."""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.operators import capabilities, constraints, diff, fold, graph, sampling
from ledgerfold.plans import control, preflight, verification
from ledgerfold.plans import inputs as I
from ledgerfold.plans.queries import FOLD_SQL, N_, T_, query

# --- from messages to tables -------------------------------------------------------------

#: Number, name, identity and columns (name, type, part of the key) of the relations.
RELATIONS = {
    1: ("customer", "d", (("c_custkey", 20, True), ("c_acctbal", 701, False), ("c_mktsegment", 25, False))),
    2: ("nation", "d", (("n_nationkey", 20, True), ("n_name", 25, False), ("n_regionkey", 20, False))),
    3: ("region", "f", (("r_regionkey", 20, True), ("r_name", 25, True)))}
NATIONS, REGIONS = 1 << 40, 1 << 41


def announcements(spark: SparkSession) -> DataFrame:
    rows = []
    for n, (oid, (name, identity, columns)) in enumerate(RELATIONS.items()):
        data = b"R" + struct.pack(">I", oid) + b"public\0" + name.encode() + b"\0" + identity.encode() + struct.pack(">H", len(columns))
        for column, kind, key in columns:
            data += struct.pack(">B", int(key)) + column.encode() + b"\0" + struct.pack(">Ii", kind, -1)
        rows.append((n - len(RELATIONS), bytearray(data)))
    return spark.createDataFrame(rows, "number bigint, data binary")


def messages_of(changes: DataFrame) -> DataFrame:
    """Three messages a change, each a transaction: ``oid, kind, end_lsn, old, new,
    unchanged`` with cells as texts, ``unchanged`` the places that an update leaves."""

    def number(x, width: int) -> Column:
        return F.unhex(F.lpad(F.hex(x), 2 * width, "0"))

    def cell(x: Column) -> Column:
        """As hexadecimal digits."""
        return F.when(x.isNull(), "6E").otherwise(F.concat(F.lit("74"), F.lpad(F.hex(F.octet_length(x)), 8, "0"), F.hex(x)))

    def row(mark: Column, cells: str, unchanged=None) -> Column:
        """A mark and a tuple; nothing for one that is not there."""
        one = lambda x, i: cell(x) if unchanged is None else F.when(F.array_contains(unchanged, i), "75").otherwise(cell(x))
        return F.coalesce(F.concat(mark, number(F.size(cells), 2), F.unhex(F.array_join(F.transform(cells, one), ""))), F.lit(b""))

    whole = [oid for oid, (_, identity, _) in RELATIONS.items() if identity == "f"]
    end, zeros = F.col("end_lsn"), lambda n: F.lit(bytes(n))
    body = F.concat(F.encode("kind", "utf-8"), number("oid", 4), row(F.when(F.col("oid").isin(whole), F.lit(b"O")).otherwise(F.lit(b"K")), "old"), row(F.lit(b"N"), "new", "unchanged"))
    begin = F.concat(F.lit(b"B"), number(end - 1, 8), zeros(8), number(F.lit(1), 4))
    commit = F.concat(F.lit(b"C"), zeros(1), number(end - 1, 8), number(end, 8), zeros(8))
    three = F.array(*(F.struct((end * 4 + i).alias("number"), data.alias("data")) for i, data in enumerate((begin, body, commit))))
    return changes.select(F.inline(three))


def capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of a log over three relations: a keyed one, one whose keys move
    while a column stays as it is, and one that is known by whole rows."""
    text = lambda *cs: F.array(*[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cs])
    none, ints = F.lit(None).cast("array<string>"), "array<int>"
    log = I.changes(spark, sf_dir)
    kept = F.when(F.size("toast") > 0, F.array(F.lit(2)))
    customer = log.select(
        F.lit(1).alias("oid"), "kind", "end_lsn", F.when(F.col("kind") == "D", text("c_custkey", F.lit(None), F.lit(None))).alias("old"),
        F.when(F.col("kind") != "D", text("c_custkey", "c_acctbal", "c_mktsegment")).alias("new"), kept.cast(ints).alias("unchanged"))
    n = I.table(spark, sf_dir, "nation").where("n_nationkey % 5 = 0")
    nation = n.select(
        F.lit(2).alias("oid"), F.lit("U").alias("kind"), (F.lit(NATIONS) + F.col("n_nationkey") * 8).alias("end_lsn"), text("n_nationkey", F.lit(None), F.lit(None)).alias("old"),
        text(F.col("n_nationkey") + 100, "n_name", "n_regionkey").alias("new"), F.array(F.lit(1)).cast(ints).alias("unchanged"))
    r = I.table(spark, sf_dir, "region")
    whole = text("r_regionkey", "r_name")
    at = lambda k: (F.lit(REGIONS) + F.col("r_regionkey") * 64 + k).alias("end_lsn")
    region = r.where("r_regionkey % 2 = 0").select(F.lit(3).alias("oid"), F.lit("U").alias("kind"), at(8), whole.alias("old"), text("r_regionkey", F.concat("r_name", F.lit("!"))).alias("new"), F.lit(None).cast(ints).alias("unchanged"))
    region = region.unionByName(r.where("r_regionkey = 1").select(F.lit(3).alias("oid"), F.lit("D").alias("kind"), at(8), whole.alias("old"), none.alias("new"), F.lit(None).cast(ints).alias("unchanged")))
    region = region.unionByName(r.where("r_regionkey = 3").select(F.lit(3).alias("oid"), F.lit("I").alias("kind"), at(8), none.alias("old"), whole.alias("new"), F.lit(None).cast(ints).alias("unchanged")))
    return announcements(spark).unionByName(messages_of(customer.unionByName(nation).unionByName(region)))


PATH_SQL = f"""
SELECT 'public.customer' AS relation, CAST(c_custkey AS VARCHAR) AS k, c_mktsegment AS v, c_acctbal AS amount FROM ({FOLD_SQL})
UNION ALL SELECT 'public.nation', CAST(CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 100 ELSE n_nationkey END AS VARCHAR), n_name, CAST(n_regionkey AS DOUBLE) FROM nation
UNION ALL SELECT 'public.region', CAST(r_regionkey AS VARCHAR), CASE WHEN r_regionkey % 2 = 0 THEN r_name || '!' ELSE r_name END, NULL FROM region WHERE r_regionkey <> 1
UNION ALL SELECT 'public.region', CAST(r_regionkey AS VARCHAR), r_name, NULL FROM region WHERE r_regionkey = 3"""


@query(PATH_SQL)
def s10_s11_c11_messages_to_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured messages, decoded in parallel, written as segments, read back, typed and
    applied in one commit: folds, key moves with unchanged columns, whole rows."""
    from ledgerfold.plans.versioned import VersionedStore, apply_batch
    from ledgerfold.sources import changes, messages, segments

    I.checkpointed(spark)
    folder = I.work_folder(spark, "path")
    capture(spark, sf_dir).write.parquet(f"{folder}/capture")
    rows = I.stored(messages.change_rows(messages.captured(spark, f"{folder}/capture"), tasks=4), f"{folder}/rows")
    segments.write_segments(rows, f"{folder}/log", files=4).collect()  # a row a file
    spark.dataSource.register(segments.SegmentSource)
    log = I.stored(spark.read.format("change_segments").option("path", f"{folder}/log").load(), f"{folder}/read")
    store = VersionedStore(spark, f"{folder}/store")
    sides = {
        "public.customer": (I.snapshot(spark, sf_dir), ["c_custkey"], ["c_acctbal", "c_mktsegment"]),
        "public.nation": (I.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), ["n_nationkey"], ["n_name", "n_regionkey"]),
        "public.region": (I.table(spark, sf_dir, "region").select("r_regionkey", "r_name"), [], ["r_regionkey", "r_name"])}
    store.commit(store.manifest(), {name: store.stage_buckets(name, df, key or values, 4) for name, (df, key, values) in sides.items()})
    typed = None
    for name, (df, key, values) in sides.items():
        one = changes.typed_changes(log, name, df.schema, key, values)
        typed = one if typed is None else typed.unionByName(one, allowMissingColumns=True)
    apply_batch(store, typed, {n: key for n, (_, key, _) in sides.items()}, {n: values for n, (_, _, values) in sides.items()}, "g1")
    out = lambda name, k, v, amount: store.read(name).select(F.lit(name).alias("relation"), F.col(k).cast("string").alias("k"), F.col(v).alias("v"), amount.cast("double").alias("amount"))
    return out("public.customer", "c_custkey", "c_mktsegment", F.col("c_acctbal")).unionByName(
        out("public.nation", "n_nationkey", "n_name", F.col("n_regionkey"))).unionByName(out("public.region", "r_regionkey", "r_name", F.lit(None)))


LOG_SQL = f"WITH c AS ({I.CHANGES_SQL})"


def _log(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the customer log as segments."""
    from ledgerfold.sources import messages, segments

    folder, work = I.work_folder(spark, "segments"), I.work_folder(spark, "capture")
    own = I.changes(spark, sf_dir)
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    rows = own.select(
        F.lit(1).alias("oid"), "kind", "end_lsn", F.when(F.col("kind") == "D", text(F.col("c_custkey"), F.lit(None), F.lit(None))).alias("old"),
        F.when(F.col("kind") != "D", text(F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment"))).alias("new"), F.lit(None).cast("array<int>").alias("unchanged"))
    captured = I.stored(announcements(spark).unionByName(messages_of(rows)), f"{work}/messages")
    segments.write_segments(I.stored(messages.change_rows(captured, tasks=4), f"{work}/rows"), folder, files=8).collect()  # a row a file
    spark.dataSource.register(segments.SegmentSource)
    return folder


@query(f"{LOG_SQL} SELECT kind, count(*) AS n, min(end_lsn) AS first_lsn, max(end_lsn) AS last_lsn FROM c WHERE end_lsn > 1600 AND end_lsn <= 4000 GROUP BY 1")
def s14_range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is durable after a position; files before it are not opened."""
    read = spark.read.format("change_segments").options(path=_log(spark, sf_dir), after=1600, durable=4000).load()
    return read.groupBy("kind").agg(F.count("*").alias("n"), F.min("end_lsn").alias("first_lsn"), F.max("end_lsn").alias("last_lsn"))


@query(f"{LOG_SQL} SELECT kind, count(*) AS n, sum(end_lsn)::BIGINT AS lsns FROM c GROUP BY 1")
def y1_segment_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a stream whose offsets are end positions."""
    folder = I.work_folder(spark, "stream-out")
    stream = spark.readStream.format("change_segments").option("path", _log(spark, sf_dir)).load().select("kind", "end_lsn")
    sink = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("kind string, end_lsn bigint").parquet(f"{folder}/rows").groupBy("kind").agg(F.count("*").alias("n"), F.sum("end_lsn").alias("lsns"))


REFERENCE_COLUMNS = "relation VARCHAR, referrer VARCHAR"
REFERENCES = [("click", "view"), ("view", "purchase"), ("purchase", "click")]


@query(f"""WITH RECURSIVE c AS ({I.MULTI_SQL}), {I.values('f', REFERENCE_COLUMNS, REFERENCES)}, t AS (SELECT relation, end_lsn FROM c WHERE kind = 'T' UNION SELECT f.referrer, t.end_lsn FROM t JOIN f ON f.relation = t.relation)
SELECT relation, end_lsn FROM t""")
def c9_cascaded_truncates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truncates that cascade, for every relation that refers to the truncated one."""
    I.checkpointed(spark)
    log = I.multi_changes(spark, sf_dir).withColumn("truncate_cascade", F.col("kind") == "T")
    return fold.cascaded(log, I.frame(spark, REFERENCE_COLUMNS, REFERENCES)).where("kind = 'T'").select("relation", "end_lsn").distinct()


@query(f"WITH c AS ({I.MULTI_SQL}) SELECT relation, kind, count(*) AS n FROM c WHERE NOT (relation = 'view' AND kind = 'U') GROUP BY 1, 2")
def c15_generated_only_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates of a relation with generated columns only set nothing."""
    generated = spark.createDataFrame([("view", True), ("click", False)], "table_name string, generated_only boolean")
    return capabilities.noop_updates(I.multi_changes(spark, sf_dir), generated).groupBy("relation", "kind").agg(F.count("*").alias("n"))


@query(FOLD_SQL)
def c3_ordered_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation whose changes may not be regrouped, replayed in order: the state is
    that of the fold."""
    from ledgerfold.plans.versioned import VersionedStore, apply_batch

    I.checkpointed(spark)
    store = VersionedStore(spark, I.work_folder(spark, "ordered"))
    store.commit(store.manifest(), {"customer": store.stage_buckets("customer", I.snapshot(spark, sf_dir), ["c_custkey"], 8)})
    apply_batch(store, I.changes(spark, sf_dir), {"customer": ["c_custkey"]}, {"customer": ["c_acctbal", "c_mktsegment"]}, "g1", foldable={"customer": False})
    return store.read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")


@query(FOLD_SQL)
def k8_g10_deltas_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches applied as deltas, then folded into the buckets that they touch."""
    from ledgerfold.plans.versioned import VersionedStore, apply_batch

    folder = I.work_folder(spark, "deltas")
    store = VersionedStore(spark, f"{folder}/store")
    store.commit(store.manifest(), {"customer": store.stage_buckets("customer", I.snapshot(spark, sf_dir), ["c_custkey"], 16)})
    log = I.changes(spark, sf_dir)
    middle = log.agg(F.max("end_lsn")).first()[0] // 2
    for part in (log.where(F.col("end_lsn") <= middle), log):  # the second one repeats the first
        apply_batch(store, part, {"customer": ["c_custkey"]}, {"customer": ["c_acctbal", "c_mktsegment"]}, "g1")
    control.maintain(control.ControlStore(f"{folder}/control"), store, ["customer"])
    return store.read("customer").select("c_custkey", "c_acctbal", "c_mktsegment")


# --- verification --------------------------------------------------------------------------


@query(f"""WITH c AS ({I.MULTI_SQL}), r AS (SELECT relation, end_lsn, kind, row_number() OVER (PARTITION BY relation ORDER BY md5('/' || end_lsn || '/' || seq)) AS slot FROM c WHERE kind <> 'T')
SELECT relation, CAST(slot AS BIGINT) AS slot, end_lsn, kind FROM r WHERE slot <= 40""")
def y7_resumed_reservoir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample kept across three parts of a log, stored between them."""
    folder, log = I.work_folder(spark, "reservoir"), I.multi_changes(spark, sf_dir).where("kind <> 'T'")
    last = log.agg(F.max("end_lsn")).first()[0]
    stored = None
    for i in range(3):
        part = log.where((F.col("end_lsn") > last * i // 3) & (F.col("end_lsn") <= last * (i + 1) // 3))
        fresh = sampling.reservoir(part, 40)
        (fresh if stored is None else sampling.merge_reservoirs(stored, fresh, 40)).write.parquet(f"{folder}/{i}")
        stored = spark.read.parquet(f"{folder}/{i}")
    return stored.select("relation", F.col("slot").cast("bigint").alias("slot"), "end_lsn", "kind")


@query(f"""WITH {I.diff_ctes()}, c AS ({I.CHANGES_SQL}), r AS (SELECT c_custkey, kind, row_number() OVER (ORDER BY md5('/' || end_lsn || '/' || seq)) AS slot FROM c),
k AS (SELECT DISTINCT '["' || c_custkey || '"]' AS key FROM r WHERE slot <= 200), d AS (SELECT count(*) AS deletes FROM r WHERE slot <= 200 AND kind = 'D')
SELECT diff.key, diff.kind, d.deletes FROM diff JOIN k ON k.key = diff.key, d""")
def v6_verify_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stratum of changed keys as part of a run: what stays different, and how
    many of the sampled changes were deletes."""
    I.checkpointed(spark)
    sample = sampling.reservoir(sampling.sample_keys(I.changes(spark, sf_dir), ["c_custkey"]), 200)
    source, target = I.table(spark, sf_dir, "customer").select(*I.CUSTOMER), I.faulty_target(spark, sf_dir)
    found = verification.verify_changes("customer", sample, lambda: source, lambda position: target, ["c_custkey"], recorded_key=["c_custkey"])
    return spark.createDataFrame([(k, kind, found.deletes) for k, kind in found.differences], "key string, kind string, deletes bigint")


DUTY_COLUMNS = "elapsed DOUBLE, duty DOUBLE, converged BOOLEAN, complete BOOLEAN"
DUTIES = [(3.0, 0.25, T_, T_), (2.0, 1.0, T_, N_), (1.0, 0.5, N_, T_), (4.0, 0.0, T_, T_)]


@query(f"WITH {I.values('d', DUTY_COLUMNS, DUTIES)} SELECT elapsed, duty, CASE WHEN duty >= 1 OR duty <= 0 THEN 0.0 ELSE elapsed * (1 / duty - 1) END AS idle, CASE WHEN converged AND complete THEN 0 ELSE 1 END AS code FROM d")
def v10_v11_pace_and_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = I.frame(spark, DUTY_COLUMNS, DUTIES).collect()
    code = lambda r: verification.exit_code({"converged": r.converged, "complete": r.complete})
    return spark.createDataFrame([(r.elapsed, r.duty, verification.throttle(r.elapsed, r.duty), code(r)) for r in rows], "elapsed double, duty double, idle double, code int")


# --- readiness ---------------------------------------------------------------------------------

SETTING_COLUMNS = "side VARCHAR, name VARCHAR, value VARCHAR"
SETTINGS = [("source", "major", "17"), ("target", "major", "17"), ("source", "wal_level", "replica"), ("source", "free_replication_slots", "3"), ("source", "free_wal_senders", "0"),
            ("source", "statement_timeout", "30000"), ("target", "lock_timeout", "0"), ("target", "idle_session_timeout", "1500")]
RELATION_COLUMNS = "oid INT, namespace VARCHAR, name VARCHAR, kind VARCHAR, persistence VARCHAR, identity VARCHAR, owned BOOLEAN, selected BOOLEAN"
RELATION_ROWS = [(1, "shop", "orders", "r", "p", "default", T_, T_), (2, "shop", "log", "r", "p", "default", T_, T_), (3, "shop", "foreign", "r", "p", "nothing", N_, T_), (4, "shop", "cache", "r", "u", "default", T_, T_),
                 (5, "shop", "events", "p", "p", "default", T_, T_), (6, "shop", "other", "r", "p", "nothing", T_, N_), (7, "shop", "by_index", "r", "p", "index", T_, T_), (8, "shop", "whole", "r", "p", "full", T_, T_)]
INDEX_COLUMNS = "oid INT, is_primary BOOLEAN, is_unique BOOLEAN, is_valid BOOLEAN, is_identity BOOLEAN"
INDEX_ROWS = [(1, T_, T_, T_, N_), (2, N_, N_, T_, N_), (4, T_, T_, T_, N_), (7, N_, T_, N_, T_)]
SEQUENCE_COLUMNS = "oid INT, namespace VARCHAR, name VARCHAR, current BIGINT, low BIGINT, high BIGINT, increment BIGINT, cycles BOOLEAN"
SEQUENCE_ROWS = [(21, "shop", "near", 2147483000, 1, 2147483647, 1, N_), (22, "shop", "soon", 2140000000, 1, 2147483647, 1, T_), (23, "shop", "far", 10, 1, 9223372036854775807, 1, N_), (24, "shop", "unused", 2147483647, 1, 2147483647, 1, N_)]
DEPEND_COLUMNS = "oid INT, on_oid INT"
DEPEND_ROWS = [(21, 1), (22, 2), (23, 1), (24, 6)]
TARGET_COLUMNS = "namespace VARCHAR, name VARCHAR, kind VARCHAR"
TARGET_ROWS = [("public", "left_over", "r"), ("pg_catalog", "pg_class", "r"), ("shop", "i", "i"), ("shop", "v", "v")]
OBJECT_COLUMNS = "kind VARCHAR, name VARCHAR"
OBJECT_ROWS = [("large-object", "1"), ("large-object", "2"), ("event-trigger", "t"), ("unknown-kind", "x")]
SIDE_COLUMNS = "side VARCHAR, name VARCHAR"
EXTENSIONS = [("source", "citext"), ("source", "postgis"), ("target", "citext")]
PRIVILEGE_COLUMNS = "side VARCHAR, object VARCHAR, privilege VARCHAR, granted BOOLEAN"
PRIVILEGES = [("source", "shop.orders", "select", T_), ("source", "shop.log", "select", N_), ("target", "database", "create", T_)]
TOOL_COLUMNS = "name VARCHAR, line VARCHAR"
TOOLS = [("dump", "pg_dump (PostgreSQL) 17.2"), ("restore", "pg_restore (PostgreSQL) 16.1")]
COLLATION_COLUMNS = "name VARCHAR, sp VARCHAR, sl VARCHAR, sv VARCHAR, tp VARCHAR, tl VARCHAR, tv VARCHAR"
COLLATIONS = [("default", "icu", "en-US", "153.1", "icu", "en-US", "153.2")]
WAL_COLUMNS = "limit_bytes BIGINT, generated DOUBLE, sample_s DOUBLE, keep_s DOUBLE"
WALS = [(1000000, 5000.0, 10.0, 3600.0)]


def planted_catalogue(spark: SparkSession) -> dict[str, DataFrame]:
    tables = {
        "settings": (SETTING_COLUMNS, SETTINGS), "relations": (RELATION_COLUMNS, RELATION_ROWS), "indexes": (INDEX_COLUMNS, INDEX_ROWS), "sequences": (SEQUENCE_COLUMNS, SEQUENCE_ROWS),
        "dependencies": (DEPEND_COLUMNS, DEPEND_ROWS), "target_relations": (TARGET_COLUMNS, TARGET_ROWS), "objects": (OBJECT_COLUMNS, OBJECT_ROWS), "extensions": (SIDE_COLUMNS, EXTENSIONS),
        "privileges": (PRIVILEGE_COLUMNS, PRIVILEGES), "tools": (TOOL_COLUMNS, TOOLS), "collations": (COLLATION_COLUMNS, COLLATIONS), "wal": (WAL_COLUMNS, WALS)}
    return {name: I.frame(spark, columns, rows) for name, (columns, rows) in tables.items()}


OFFSET = 1000
CATALOGUE_SQL = ", ".join([
    I.values("settings", SETTING_COLUMNS, SETTINGS), I.values("rel", RELATION_COLUMNS, RELATION_ROWS), I.values("ix", INDEX_COLUMNS, INDEX_ROWS), I.values("seq", SEQUENCE_COLUMNS, SEQUENCE_ROWS),
    I.values("dep", DEPEND_COLUMNS, DEPEND_ROWS), I.values("tgt", TARGET_COLUMNS, TARGET_ROWS), I.values("obj", OBJECT_COLUMNS, OBJECT_ROWS), I.values("ext", SIDE_COLUMNS, EXTENSIONS),
    I.values("priv", PRIVILEGE_COLUMNS, PRIVILEGES), I.values("tools", TOOL_COLUMNS, TOOLS), I.values("coll", COLLATION_COLUMNS, COLLATIONS), I.values("wal", WAL_COLUMNS, WALS)])
IDENTITY_SQL = """SELECT oid, owned, CASE identity WHEN 'nothing' THEN true WHEN 'full' THEN false
  WHEN 'default' THEN NOT EXISTS (SELECT 1 FROM ix WHERE ix.oid = rel.oid AND is_valid AND is_primary)
  WHEN 'index' THEN NOT EXISTS (SELECT 1 FROM ix WHERE ix.oid = rel.oid AND is_valid AND is_identity AND is_unique) ELSE true END AS fallback FROM rel WHERE selected AND kind = 'r'"""


@query(f"""WITH {CATALOGUE_SQL}, ident AS ({IDENTITY_SQL})
SELECT 'wal-level' AS id, 'replication' AS kind, 'error' AS severity FROM settings WHERE side = 'source' AND name = 'wal_level' AND value <> 'logical'
UNION ALL SELECT CASE name WHEN 'free_wal_senders' THEN 'wal-sender-capacity' ELSE 'replication-slot-capacity' END, 'replication', 'error' FROM settings WHERE side = 'source' AND name LIKE 'free%' AND CAST(value AS BIGINT) < 1
UNION ALL SELECT side || '-' || replace(name, '_', '-'), 'timeout', 'warning' FROM settings WHERE name LIKE '%timeout' AND value <> '0'
UNION ALL SELECT 'wal-retention', 'replication', 'warning' FROM wal WHERE floor(generated / sample_s * keep_s) > limit_bytes
UNION ALL SELECT 'table-' || oid || '-replica-identity', 'replica-identity', CASE WHEN owned THEN 'warning' ELSE 'error' END FROM ident WHERE fallback
UNION ALL SELECT 'table-' || oid || '-unlogged', 'replication', 'error' FROM rel WHERE selected AND persistence = 'u'
UNION ALL SELECT 'sequence-' || oid || '-headroom', 'sequence', CASE WHEN high - current < {OFFSET} THEN 'error' ELSE 'warning' END FROM seq
  WHERE high::HUGEINT - current < 10000000 AND oid IN (SELECT dep.oid FROM dep JOIN rel ON rel.oid = dep.on_oid WHERE rel.selected)
UNION ALL SELECT 'target-not-empty', 'target', 'error' WHERE EXISTS (SELECT 1 FROM tgt WHERE kind IN ('r', 'p', 'v', 'm', 'S', 'f') AND NOT starts_with(namespace, 'pg_'))
UNION ALL SELECT DISTINCT 'source-' || kind, 'object', 'warning' FROM obj WHERE kind IN ('large-object', 'event-trigger')
UNION ALL SELECT 'extension-' || name, 'extension', 'error' FROM ext WHERE side = 'source' AND name NOT IN (SELECT name FROM ext WHERE side = 'target')
UNION ALL SELECT side || '-' || privilege || '-' || object, 'privilege', 'error' FROM priv WHERE NOT granted
UNION ALL SELECT name || '-version', 'tool', 'error' FROM tools WHERE CAST(regexp_extract(line, '\\) (\\d+)', 1) AS INT) < (SELECT CAST(value AS INT) FROM settings WHERE side = 'source' AND name = 'major')
UNION ALL SELECT 'collation-' || name, 'collation', 'warning' FROM coll WHERE sv <> tv""")
def g1_g3_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All checks over a planted catalogue."""
    return preflight.run(spark, planted_catalogue(spark), OFFSET)[0].select("id", "kind", "severity")


@query("SELECT 'collation-default' AS id, 'collation' AS kind, 'error' AS severity, false AS complete")
def g1_g4_collation_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collation that blocks ends the run: nothing else is looked at."""
    other = I.frame(spark, COLLATION_COLUMNS, [("default", "icu", "en-US", "153.1", "icu", "de-DE", "153.1")])
    found, complete = preflight.run(spark, planted_catalogue(spark) | {"collations": other}, OFFSET)
    return found.select("id", "kind", "severity", F.lit(complete).alias("complete"))


@query(f"WITH {CATALOGUE_SQL}, ident AS ({IDENTITY_SQL}) SELECT oid, owned, fallback FROM ident")
def j7_identity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations joined with their valid indexes."""
    return preflight.identities(planted_catalogue(spark)).select("oid", "owned", "fallback")


@query(f"WITH {CATALOGUE_SQL} SELECT oid, name FROM seq WHERE EXISTS (SELECT 1 FROM dep JOIN rel ON rel.oid = dep.on_oid WHERE dep.oid = seq.oid AND rel.selected)")
def j7_used_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of selected relations, by dependencies."""
    return preflight.used_sequences(planted_catalogue(spark)).select("oid", "name")


CONSTRAINT_COLUMNS = "relation VARCHAR, kind VARCHAR, refers_to VARCHAR"
CONSTRAINTS = [("orders", "f", "customers"), ("orders", "p", None), ("items", "f", "orders"), ("tree", "f", "tree"), ("items", "f", "orders"), ("customers", "f", "regions")]


@query(f"WITH RECURSIVE {I.values('c', CONSTRAINT_COLUMNS, CONSTRAINTS)}, e AS (SELECT DISTINCT relation AS s, refers_to AS t FROM c WHERE kind = 'f' AND relation <> refers_to), "
       "r AS (SELECT s, t FROM e UNION SELECT r.s, e.t FROM r JOIN e ON e.s = r.t) SELECT s AS source, t AS target FROM r")
def r3_foreign_key_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a constraint catalogue, and everything they reach."""
    I.checkpointed(spark)
    return graph.reachable(graph.foreign_key_edges(I.frame(spark, CONSTRAINT_COLUMNS, CONSTRAINTS)))


DEFINITION_COLUMNS = "relation VARCHAR, name VARCHAR, definition VARCHAR"
WANTED = [("orders", "fk", "FOREIGN KEY (a)  REFERENCES b(c) NOT VALID"), ("orders", "ck", "CHECK (x > 0)"), ("items", "uq", "UNIQUE (x)")]
PRESENT = [("orders", "fk_built", " FOREIGN KEY (a) REFERENCES b(c)"), ("orders", "uq", "UNIQUE (x)")]
NORMAL = "regexp_replace(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '(?i) NOT VALID$', '')"


@query(f"WITH {I.values('w', DEFINITION_COLUMNS, WANTED)}, {I.values('p', DEFINITION_COLUMNS, PRESENT)} SELECT w.relation, {NORMAL.format('w.definition')} AS definition, w.name, p.name AS present_as "
       f"FROM w LEFT JOIN p ON p.relation = w.relation AND {NORMAL.format('p.definition')} = {NORMAL.format('w.definition')}")
def g9_matched_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes and constraints that are there already, whatever their names."""
    return constraints.matched_definitions(I.frame(spark, DEFINITION_COLUMNS, WANTED), I.frame(spark, DEFINITION_COLUMNS, PRESENT))


ATTACH_COLUMNS = "name VARCHAR, parent VARCHAR, depth INT"
ATTACHMENTS = [("root", None, 0), ("a", "root", 1), ("b", "root", 1), ("a1", "a", 2), ("a2", "a", 2)]


@query(f"WITH {I.values('a', ATTACH_COLUMNS, ATTACHMENTS)} SELECT name, parent, row_number() OVER (ORDER BY depth DESC, name) AS turn FROM a WHERE parent IS NOT NULL")
def g9_attach_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions' indexes are attached from the leaves up."""
    return constraints.attach_order(I.frame(spark, ATTACH_COLUMNS, ATTACHMENTS))


# --- control ------------------------------------------------------------------------------------


@query("SELECT unnest(['cleanup', 'drain', 'sequences']) AS step, 99 AS end_position, 1 AS done")
def g12_g14_cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cutover that fails once at its sequences and is run again: every step is done
    once, and the end position stays."""
    folder = I.work_folder(spark, "cutover")
    state, done, broken = control.ControlStore(f"{folder}/control"), [], [True]

    def sequences():
        if broken and broken.pop():
            raise OSError("lost")
        done.append("sequences")

    run = lambda: control.cutover(state, 99, lambda end: done.append("drain"), sequences, lambda: done.append("cleanup"), f"{folder}/report.json")
    try:
        run()
    except OSError:
        report = run()
    return spark.createDataFrame([(s, report["end_position"], done.count(s)) for s in report["steps"]], "step string, end_position int, done int")


@query("SELECT * FROM nation")
def k3_retried_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy whose second part fails half-way, and the copy after it."""
    from ledgerfold.operators.parts import key_parts
    from ledgerfold.plans.versioned import VersionedStore, copy_snapshot

    store, source = VersionedStore(spark, I.work_folder(spark, "retry")), I.table(spark, sf_dir, "nation")
    plan = key_parts("nation", "n_nationkey", 0, 24, 1000, 100, 4)
    broken = source.withColumn("n_name", F.when(F.col("n_nationkey") < 10, F.col("n_name")).otherwise(F.raise_error(F.lit("lost"))))
    try:
        copy_snapshot(store, "nation", broken, plan)
    except Exception as e:  # noqa: BLE001
        if "lost" not in str(e):
            raise
    copy_snapshot(store, "nation", source, plan)
    return store.read("nation")
