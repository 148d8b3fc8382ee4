"""Readiness checks over catalogue tables.

Every check takes DataFrames of a catalogue and returns findings: ``id, kind,
severity`` (error, warning, info), ``message, resolved``.  ``run`` asks for the
collations first and stops there if they block, as nothing that a later check finds
would matter on a target that has to be made anew.  A check that fails is itself a
finding, of kind ``probe``; the others still run.

The catalogue's tables (what a check does not need may be missing):

* ``settings``: ``side, name, value``;  ``tools``: ``name, line``;
* ``relations``: ``oid, namespace, name, kind, persistence, identity, owned, selected`` of
  the source;  ``target_relations``: ``namespace, name, kind``;
* ``indexes``: ``oid, is_primary, is_unique, is_valid, is_identity``;
* ``sequences``: ``oid, namespace, name, current, low, high, increment, cycles``;
* ``dependencies``: ``oid, on_oid`` (a sequence on the relation that owns or uses it);
* ``objects``: ``kind, name`` of source objects that are not carried over;
* ``extensions``: ``side, name``;  ``privileges``: ``side, object, privilege, granted``;
* ``collations``: ``name, sp, sl, sv, tp, tl, tv`` (provider, locale and version of both
  sides);  ``wal``: ``limit_bytes, generated, sample_s, keep_s``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.functions import catalog as C
from ledgerfold.functions import render as R

FINDING = "id string, kind string, severity string, message string, resolved boolean"
#: Room of a sequence below which it is mentioned.
LEAST_ROOM = 10_000_000
#: Times the largest log size from which retained log raises an alarm.
GROWTH = 3
#: Settings that end sessions or statements.
TIMEOUTS = ("statement_timeout", "lock_timeout", "idle_in_transaction_session_timeout", "idle_session_timeout", "transaction_timeout")
#: Kinds of relations that make a target not empty.
USER_KINDS = ("r", "p", "v", "m", "S", "f")


def finding(id_: Column | str, kind: str, severity: Column | str, message: Column | str) -> list[Column]:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return [as_column(id_).alias("id"), F.lit(kind).alias("kind"), as_column(severity).alias("severity"), as_column(message).alias("message"), F.lit(False).alias("resolved")]


def in_user_schema(namespace: Column) -> Column:
    return ~namespace.startswith("pg_") & (namespace != "information_schema") & (namespace != "ledgerfold_internal")


# --- collation -----------------------------------------------------------------------


def collation_differences(collations: DataFrame) -> DataFrame:
    """``provider, locale, version`` of each pair: what differs.  A version counts
    only between equal locales, where both sides know theirs."""
    same = R.canonical_locale(F.col("sl")) == R.canonical_locale(F.col("tl"))
    version = same & (F.col("sv") != F.col("tv")) & (F.col("sv") != "") & (F.col("tv") != "")
    return collations.select("name", (F.col("sp") != F.col("tp")).alias("provider"), (~same).alias("locale"), version.alias("version"))


def disposition(differences: DataFrame, allowed: bool, structural_risks: int = 0) -> DataFrame:
    """What a difference means: a version alone, or one that was allowed and that no
    structure depends on, warns; the others block."""
    differs = F.col("provider") | F.col("locale")
    severity = F.when(differs & F.lit(not allowed or structural_risks > 0), "error").when(differs | F.col("version"), "warning").otherwise("info")
    return differences.withColumn("severity", severity).where(differs | F.col("version"))


def check_collations(catalogue: dict[str, DataFrame], allowed: bool = False, structural_risks: int = 0) -> DataFrame:
    found = disposition(collation_differences(catalogue["collations"]), allowed, structural_risks)
    what = F.concat_ws(", ", F.when(F.col("provider"), "provider"), F.when(F.col("locale"), "locale"), F.when(F.col("version"), "version"))
    return found.select(*finding(F.concat(F.lit("collation-"), "name"), "collation", F.col("severity"), F.concat(F.lit("source and target differ in "), what)))


# --- settings -------------------------------------------------------------------------


def _setting(catalogue, side: str, name: str) -> DataFrame:
    return catalogue["settings"].where((F.col("side") == side) & (F.col("name") == name)).select("value")


def check_timeouts(catalogue: dict[str, DataFrame]) -> DataFrame:
    on = catalogue["settings"].where(F.col("name").isin(*TIMEOUTS) & (F.col("value").cast("bigint") != 0))
    ms = F.col("value").cast("bigint")
    shown = F.when(ms % 1000 == 0, F.concat((ms / 1000).cast("bigint").cast("string"), F.lit("s"))).otherwise(F.concat(ms.cast("string"), F.lit("ms")))
    return on.select(*finding(
        F.concat("side", F.lit("-"), F.replace(F.col("name"), F.lit("_"), F.lit("-"))), "timeout", "warning", F.concat("side", F.lit(" sets "), "name", F.lit(" to "), shown)))


def check_replication(catalogue: dict[str, DataFrame]) -> DataFrame:
    source = catalogue["settings"].where(F.col("side") == "source")
    level = source.where((F.col("name") == "wal_level") & (F.col("value") != "logical")).select(
        *finding("wal-level", "replication", "error", "the log level must be logical"))
    short = source.where(F.col("name").isin("free_replication_slots", "free_wal_senders") & (F.col("value").cast("bigint") < 1))
    id_ = F.when(F.col("name") == "free_wal_senders", "wal-sender-capacity").otherwise("replication-slot-capacity")
    return level.unionByName(short.select(*finding(id_, "replication", "error", F.concat(F.lit("none left: "), "name"))))


def required_log(generated: Column, sample_s: Column, keep_s: Column) -> Column:
    """Log that a source makes in the time that it has to be kept, from a sample."""
    return F.floor(generated / sample_s * keep_s).cast("bigint")


def check_retention(catalogue: dict[str, DataFrame]) -> DataFrame:
    need = required_log(F.col("generated"), F.col("sample_s"), F.col("keep_s"))
    return catalogue["wal"].where((F.col("limit_bytes") >= 0) & (need > F.col("limit_bytes"))).select(*finding(
        "wal-retention", "replication", "warning", F.concat(F.lit("the log of that time needs "), R.format_bytes(need))))


def log_alarm(retained: Column, slot_limit: Column, most: Column, held: Column) -> Column:
    """Whether retained log endangers the source: at a slot's limit if it has one;
    else where it is more than the largest size and the directory (or, if unknown,
    what is retained) is GROWTH times that."""
    return (
        F.when(slot_limit >= 0, retained >= slot_limit).when((most <= 0) | (retained <= most), False)
        .when(held < 0, retained >= GROWTH * most).otherwise(held >= GROWTH * most))


def check_tools(catalogue: dict[str, DataFrame]) -> DataFrame:
    version = _setting(catalogue, "source", "major").select(F.col("value").cast("int").alias("source_major"))
    major = R.tool_major(F.col("line"))
    return catalogue["tools"].crossJoin(F.broadcast(version.limit(1))).where(major.isNull() | (major < F.col("source_major"))).select(*finding(
        F.concat("name", F.lit("-version")), "tool", "error", F.when(major.isNull(), "no version").otherwise(F.concat(F.lit("older than the source: "), major.cast("string")))))


def check_versions(catalogue: dict[str, DataFrame]) -> DataFrame:
    major = catalogue["settings"].where(F.col("name") == "major").groupBy().pivot("side", ["source", "target"]).agg(F.max(F.col("value").cast("int")))
    return major.where("target < source").select(*finding("version-order", "version", "error", "the target is older than the source"))


# --- relations ------------------------------------------------------------------------


def identities(catalogue: dict[str, DataFrame]) -> DataFrame:
    """Selected relations with whether they need all columns to tell rows apart: a
    join of relations with their valid indexes."""
    valid = catalogue["indexes"].where("is_valid").groupBy("oid").agg(
        F.bool_or(F.col("is_primary")).alias("has_pk"), F.bool_or(F.col("is_identity") & F.col("is_unique")).alias("has_index"))
    joined = catalogue["relations"].where("selected").join(valid, "oid", "left")
    fallback = C.needs_fallback(F.col("identity"), F.coalesce("has_pk", F.lit(False)), F.coalesce("has_index", F.lit(False)))
    # Rows are in the leaves of a partitioned table.
    return joined.where("kind = 'r'").withColumn("fallback", fallback)


def check_identities(catalogue: dict[str, DataFrame]) -> DataFrame:
    need = identities(catalogue).where("fallback")
    name = F.concat("namespace", F.lit("."), "name")
    found = need.select(*finding(
        F.concat(F.lit("table-"), F.col("oid").cast("string"), F.lit("-replica-identity")), "replica-identity", F.when(F.col("owned"), "warning").otherwise("error"),
        F.concat(name, F.when(F.col("owned"), " will be replicated by whole rows").otherwise(" can not tell rows apart and is not ours to change"))))
    unlogged = catalogue["relations"].where("selected AND persistence = 'u'").select(*finding(
        F.concat(F.lit("table-"), F.col("oid").cast("string"), F.lit("-unlogged")), "replication", "error", F.concat(name, F.lit(" is unlogged"))))
    return found.unionByName(unlogged)


def used_sequences(catalogue: dict[str, DataFrame]) -> DataFrame:
    """Sequences that a selected relation owns or defaults to."""
    selected = catalogue["relations"].where("selected").select(F.col("oid").alias("on_oid"))
    used = catalogue["dependencies"].join(selected, "on_oid", "left_semi").select("oid").distinct()
    return catalogue["sequences"].join(used, "oid", "left_semi")


def sequence_severity(room: Column, offset: int, least: int = LEAST_ROOM) -> Column:
    return F.when(F.lit(offset > 0) & (room < offset), "error").when(room < least, "warning").otherwise("ok")


def sequence_targets(sequences: DataFrame, offset: int) -> DataFrame:
    """``target``: the value to set on the target, ahead by the offset in the
    sequence's own direction, and whether that overflows 64 bits."""
    wide = lambda v: F.lit(v).cast("decimal(20,0)")
    target = (F.col("current").cast("decimal(20,0)") + F.when(F.col("increment") < 0, -offset).otherwise(offset)).cast("decimal(20,0)")
    over = (F.col("target") > wide("9223372036854775807")) | (F.col("target") < wide("-9223372036854775808"))
    return sequences.withColumn("target", target).withColumn("overflows", over)


def check_sequences(catalogue: dict[str, DataFrame], offset: int) -> DataFrame:
    room = R.headroom(F.col("current"), F.col("low"), F.col("high"), F.col("increment"))
    near = used_sequences(catalogue).withColumn("room", room).withColumn("severity", sequence_severity(F.col("room"), offset)).where("severity <> 'ok'")
    return near.select(*finding(
        F.concat(F.lit("sequence-"), F.col("oid").cast("string"), F.lit("-headroom")), "sequence", F.col("severity"),
        F.concat("namespace", F.lit("."), "name", F.lit(" has "), F.col("room").cast("string"), F.lit(" values left"), F.when(F.col("cycles"), " and cycles").otherwise(""))))


def check_target_empty(catalogue: dict[str, DataFrame]) -> DataFrame:
    user = catalogue["target_relations"].where(F.col("kind").isin(*USER_KINDS) & in_user_schema(F.col("namespace")))
    return user.agg(F.count("*").alias("n")).where("n > 0").select(*finding(
        "target-not-empty", "target", "error", F.concat(F.lit("the target has "), F.col("n").cast("string"), F.lit(" relations"))))


#: Kinds of source objects that replication does not carry, and what
#: they mean.
NOT_CARRIED = {
    "large-object": "warning", "foreign-table": "info", "materialized-view": "info", "prepared-transaction": "error", "event-trigger": "warning",
    "publication": "info", "subscription": "warning"}


def check_objects(catalogue: dict[str, DataFrame]) -> DataFrame:
    severity = F.create_map(*[F.lit(x) for kv in NOT_CARRIED.items() for x in kv])
    counted = catalogue["objects"].groupBy("kind").agg(F.count("*").alias("n")).withColumn("means", severity[F.col("kind")]).where(F.col("means").isNotNull())
    return counted.select(*finding(F.concat(F.lit("source-"), "kind"), "object", F.col("means"), F.concat(F.col("n").cast("string"), F.lit(" are not carried over"))))


def check_extensions(catalogue: dict[str, DataFrame]) -> DataFrame:
    side = lambda s: catalogue["extensions"].where(F.col("side") == s).select("name").distinct()
    return side("source").join(side("target"), "name", "left_anti").select(*finding(
        F.concat(F.lit("extension-"), "name"), "extension", "error", F.concat("name", F.lit(" is not available on the target"))))


def check_privileges(catalogue: dict[str, DataFrame]) -> DataFrame:
    return catalogue["privileges"].where(~F.col("granted")).select(*finding(
        F.concat("side", F.lit("-"), "privilege", F.lit("-"), "object"), "privilege", "error", F.concat("privilege", F.lit(" is missing on "), "object")))


# --- the run --------------------------------------------------------------------------


def run(spark: SparkSession, catalogue: dict[str, DataFrame], offset: int = 0, allow_collation_change: bool = False, structural_risks: int = 0) -> tuple[DataFrame, bool]:
    """(findings by id, whether all checks were made)."""
    checks: list[tuple[str, str, Callable[[], DataFrame]]] = [
        ("versions", "settings", lambda: check_versions(catalogue)),
        ("collation", "collations", lambda: check_collations(catalogue, allow_collation_change, structural_risks)),
        ("timeouts", "settings", lambda: check_timeouts(catalogue)), ("source-replication", "settings", lambda: check_replication(catalogue)),
        ("wal-retention", "wal", lambda: check_retention(catalogue)), ("replica-identity", "relations", lambda: check_identities(catalogue)),
        ("source-sequences", "sequences", lambda: check_sequences(catalogue, offset)), ("target-empty", "target_relations", lambda: check_target_empty(catalogue)),
        ("source-objects", "objects", lambda: check_objects(catalogue)), ("extensions", "extensions", lambda: check_extensions(catalogue)),
        ("privileges", "privileges", lambda: check_privileges(catalogue)), ("tools", "tools", lambda: check_tools(catalogue))]
    rows = []
    for name, needs, check in checks:
        if needs not in catalogue:
            continue
        try:
            rows += check().collect()  # findings of one check
        except Exception as e:  # noqa: BLE001  a probe that fails is a finding
            rows.append((name, "probe", "error", str(e).splitlines()[0][:200], False))
        if name == "collation" and any(r[1] == "collation" and r[2] == "error" for r in rows):
            return spark.createDataFrame(rows, FINDING).orderBy("id"), False
    return spark.createDataFrame(rows, FINDING).orderBy("id"), True
