"""Tables as immutable files under one manifest.

A commit writes new directories and then creates the manifest of the next version;
creating it fails if another commit was first.  The manifest also holds the applied
position and the stream's generation, so data and progress change together or not at
all.  Readers pin the manifest they opened.  What no manifest names is garbage.

A table's entry is a directory, or

* ``base``: directories by hash bucket of the key (``buckets`` of them; a table that
  was copied in parts has one entry a part and no buckets);
* ``deltas``: directories of canonical changes applied since, oldest first.

Applying a batch of changes reads the key columns of the buckets that it touches and
writes the changes; a read folds base and deltas.  After ``COMPACT_AFTER`` deltas the
buckets that they touch, and no others, are written anew.  So the cost of a batch
grows with the batch, and of a bucket's rewrite with the bucket, not with the table.

All paths are below one folder, local or remote (``sources/shared.py``).
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerfold.functions.render import row_digest
from ledgerfold.operators.fold import (
    DivergenceError, check_order, first_misfit, fold, full_identity, live_changes, ordered_fold, split_key_changes)
from ledgerfold.sources.shared import shared_folder

EMPTY = {"version": 0, "remote_lsn": 0, "generation": None, "tables": {}}
BUCKET = "lf_bucket"
#: Deltas of a table after which the buckets that they touch are rewritten.
COMPACT_AFTER = 16
#: Parts copied at the same time.
COPIES = 4
#: Manifests kept for readers that opened them.
KEPT = 10


class VersionedStore:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, shared_folder(folder, spark)
        self.folder = self.files.folder

    @staticmethod
    def manifest_name(version: int) -> str:
        return f"manifest-{version:020d}.json"

    def manifest(self) -> dict:
        while names := [n for n in self.files.names() if n.startswith("manifest-")]:
            if (data := self.files.read(names[-1])) is not None:  # else removed since it was listed
                return json.loads(data)
        return json.loads(json.dumps(EMPTY))

    # --- reading -----------------------------------------------------------------

    def entry(self, name: str, manifest: dict | None = None) -> dict:
        found = (manifest or self.manifest())["tables"][name]
        return found if isinstance(found, dict) else {"base": {"all": found}, "deltas": [], "buckets": 0}

    def _load(self, paths: list[str], schema: dict | None = None) -> DataFrame:
        schema = StructType.fromJson(schema) if schema is not None else None
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return reader.parquet(*[self.files.path(p) for p in paths])

    def base(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        entry = self.entry(name, manifest)
        keep = [p for b, p in sorted(entry["base"].items()) if buckets is None or not entry["buckets"] or int(b) in buckets]
        return self._load(keep, entry.get("schema"))

    def read(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The table, or what it holds in some buckets, after its deltas."""
        entry = self.entry(name, manifest)
        out = self.base(name, manifest, buckets)
        if not entry["deltas"]:
            return out.select(*columns) if columns else out
        log = self._load(entry["deltas"])
        if buckets is not None and entry["buckets"]:
            log = log.where(bucket_of(entry["key"], entry["buckets"]).isin(buckets))
        values = [c for c in out.columns if c not in entry["key"] and (columns is None or c in columns)]
        return fold(out.select(*entry["key"], *values), log, entry["key"], values, cleared=False).select(*(columns or out.columns))

    # --- writing -----------------------------------------------------------------

    def stage(self, name: str, df: DataFrame) -> str:
        """Write a new version of a table; not visible before a commit."""
        path = f"{name}/v-{uuid.uuid4().hex}"
        df.write.parquet(self.files.path(path))
        return path

    def stage_buckets(self, name: str, df: DataFrame, by: list[str], buckets: int, key: list[str] | None = None, only: list[int] | None = None) -> dict:
        """An entry for rows dealt to hash buckets of ``by``, one file a bucket."""
        path = f"{name}/v-{uuid.uuid4().hex}"
        dealt = df.withColumn(BUCKET, bucket_of(by, buckets))
        tasks = max(1, len(only) if only is not None else buckets)
        dealt.repartition(min(tasks, 10_000), BUCKET).write.partitionBy(BUCKET).parquet(self.files.path(path))
        found = {n.partition("=")[2]: f"{path}/{n}" for n in self.files.names(path) if n.startswith(f"{BUCKET}=")}
        return {"base": found, "deltas": [], "buckets": buckets, "by": by, "key": key or by, "schema": schema_of(df)}

    def commit(self, base: dict, tables: dict, remote_lsn: int | None = None, generation: str | None = None) -> dict:
        """Create the next manifest if nobody else has."""
        now = self.manifest()
        moved = RuntimeError(f"manifest moved on from version {base['version']}")
        if now["version"] != base["version"]:
            raise moved
        check_generation(now["generation"], generation)
        new = {
            "version": now["version"] + 1, "remote_lsn": now["remote_lsn"] if remote_lsn is None else remote_lsn,
            "generation": generation or now["generation"], "tables": now["tables"] | tables}
        if new["remote_lsn"] < now["remote_lsn"]:
            raise DivergenceError("progress can not move back")
        if not self.files.create(self.manifest_name(new["version"]), json.dumps(new).encode()):
            raise moved
        if new["version"] > KEPT:
            self.files.delete(self.manifest_name(new["version"] - KEPT))
        return new

    def paths(self, manifest: dict) -> set[str]:
        """All directories that a manifest names."""
        entries = [self.entry(name, manifest) for name in manifest["tables"]]
        return {p for e in entries for p in (*e["base"].values(), *e["deltas"])}

    def sweep(self) -> list[str]:
        """Remove directories of tables that the last manifest does not name.  Not to
        be run beside a commit or a reader of an older manifest."""
        kept, gone = self.paths(self.manifest()), []
        for name in self.files.names():
            for inner in self.files.names(name):
                path = f"{name}/{inner}"
                begun = inner == "copy" and name not in self.manifest()["tables"]  # a copy that is not finished
                if not begun and not any(p == path or p.startswith(path + "/") for p in kept):
                    self.files.delete(path)
                    gone.append(path)
        return gone

    def compact(self, name: str, manifest: dict | None = None, buckets: list[int] | None = None) -> dict:
        """The table's entry with the buckets that deltas touch written anew."""
        entry = self.entry(name, manifest)
        if not entry["deltas"]:
            return entry
        if not entry["buckets"]:
            return entry | {"base": {"all": self.stage(name, self.read(name, manifest))}, "deltas": []}
        if buckets is None:
            log = self._load(entry["deltas"])
            buckets = [r.b for r in log.select(bucket_of(entry["key"], entry["buckets"]).alias("b")).distinct().collect()]  # at most ``buckets``
        new = self.stage_buckets(name, self.read(name, manifest, buckets), entry["by"], entry["buckets"], entry["key"], buckets)
        kept = {b: p for b, p in entry["base"].items() if int(b) not in buckets}
        return entry | {"base": kept | new["base"], "deltas": []}


def schema_of(df: DataFrame) -> dict:
    return json.loads(df.schema.json())


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in key]), F.lit(buckets)).cast("int")


def check_generation(stored: str | None, given: str | None, copied: bool = False) -> None:
    """Progress of another stream, or none where a copy was finished, is fatal."""
    if generation_fatal(stored, given, copied):
        raise DivergenceError(f"progress belongs to generation {stored}, not {given}")


def generation_fatal(stored: str | None, given: str | None, copied: bool = False) -> bool:
    return copied if stored is None else given is not None and stored != given


def _touched(changes: DataFrame, entry: dict) -> list[int] | None:
    if not entry["buckets"]:
        return None
    return [r.b for r in changes.where("kind <> 'T'").select(bucket_of(entry["by"], entry["buckets"]).alias("b")).distinct().collect()]  # at most ``buckets``


def _summary(changes: DataFrame, keys: dict[str, list[str]]) -> dict:
    """What a batch holds, by relation: ``last`` position, whether there are
    ``truncates``, key ``moves``, and moves that leave columns unchanged
    (``carries``).  One aggregation, a row a relation."""
    moved = F.lit(False)
    for name, key in keys.items():
        for k in key:
            if f"old_{k}" in changes.columns:
                moved = moved | ((F.col("relation") == name) & (F.col("kind") == "U") & F.col(f"old_{k}").isNotNull() & ~F.col(f"old_{k}").eqNullSafe(F.col(k)))
    moved = F.coalesce(moved, F.lit(False))
    rows = changes.groupBy("relation").agg(
        F.max("end_lsn").alias("last"), F.bool_or(F.col("kind") == "T").alias("truncates"), F.bool_or(moved).alias("moves"),
        F.bool_or(moved & (F.size("toast") > 0)).alias("carries")).collect()
    return {r.relation: r for r in rows}


def _apply_keyed(store: VersionedStore, base: dict, name: str, changes: DataFrame, key: list[str], values: list[str], foldable: bool, holds) -> dict:
    entry = store.entry(name, base) | {"key": key}
    entry.setdefault("by", key)
    old = [c for c in (f"old_{k}" for k in key) if c in changes.columns]
    moves, carries = holds.moves, holds.carries
    if holds.truncates:
        live = live_changes(changes).drop("cleared")
        schema = store.base(name, base).schema
        empty = store.spark.createDataFrame([], schema)
        entry |= {"base": {}, "deltas": [], "schema": json.loads(schema.json())}
        if not entry["buckets"]:
            entry["base"] = {"all": store.stage(name, empty)}
        base, changes = base | {"tables": base["tables"] | {name: entry}}, live
    # Buckets of both keys of a move.
    split = split_key_changes(changes, key).drop(*old) if moves else changes.drop(*old)
    touched = _touched(split, entry)
    if not foldable or carries:  # one change after the other, in the groups that moves connect
        whole = store.read(name, base, touched)
        replayed = ordered_fold(whole, changes, key, values)
        if touched is None:
            return entry | {"base": {"all": store.stage(name, replayed)}, "deltas": []}
        entry = store.compact(name, base, touched) if entry["deltas"] else entry
        new = store.stage_buckets(name, replayed, entry["by"], entry["buckets"], key, touched)
        return entry | {"base": {b: p for b, p in entry["base"].items() if int(b) not in touched} | new["base"]}
    first_misfit(store.read(name, base, touched, key), split.select("relation", *key, "end_lsn", "seq", "kind"), key)
    delta = f"{name}/d-{uuid.uuid4().hex}"
    split.select("relation", "end_lsn", "seq", "kind", *key, *values, "toast").write.parquet(store.files.path(delta))
    entry = entry | {"deltas": [*entry["deltas"], delta], "schema": entry.get("schema") or schema_of(store.base(name, base))}
    if len(entry["deltas"]) >= COMPACT_AFTER:
        entry = store.compact(name, base | {"tables": base["tables"] | {name: entry}})
    return entry


def _apply_full(store: VersionedStore, base: dict, name: str, changes: DataFrame, columns: list[str], holds) -> dict:
    """A relation whose rows are known only as a whole: deletes and updates name the
    old row by all its columns (``old_<column>``), and must find exactly one."""
    entry = store.entry(name, base)
    if holds.truncates:
        schema = store.base(name, base).schema
        empty = store.spark.createDataFrame([], schema)
        entry = {"base": {"all": store.stage(name, empty)}, "deltas": [], "buckets": 0}
        base, changes = base | {"tables": base["tables"] | {name: entry}}, live_changes(changes).drop("cleared")
    side = lambda kinds, kind, prefix, step: changes.where(F.col("kind").isin(*kinds)).select(
        F.lit(kind).alias("kind"), "end_lsn", (F.col("seq") * 2 + step).alias("seq"), *[F.col(prefix + c).alias(c) for c in columns])
    log = side(["U", "D"], "D", "old_", 0).unionByName(side(["U", "I"], "I", "", 1))
    touched = None
    if entry["buckets"]:
        touched = [r.b for r in log.select(bucket_of(entry["by"], entry["buckets"]).alias("b")).distinct().collect()]  # at most ``buckets``
    rows = store.base(name, base, touched).select(*columns)
    digest = row_digest(rows.schema, columns).alias("digest")
    keyed, moved = rows.select(digest, F.struct(*columns).alias("row")), log.select("kind", "end_lsn", "seq", digest, F.struct(*columns).alias("row"))
    after, bad = full_identity(keyed, moved)
    first = bad.orderBy("end_lsn", "seq").limit(1).collect()
    if first:
        raise DivergenceError(f"change {first[0].asDict()} does not find exactly one row")
    one = keyed.unionByName(moved.where("kind = 'I'").select("digest", "row")).groupBy("digest").agg(F.any_value("row").alias("row"))
    out = after.join(one, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
    if touched is None:
        return entry | {"base": {"all": store.stage(name, out)}}
    new = store.stage_buckets(name, out, entry["by"], entry["buckets"], entry["key"], touched)
    return entry | {"base": {b: p for b, p in entry["base"].items() if int(b) not in touched} | new["base"]}


def apply_batch(store: VersionedStore, changes: DataFrame, keys: dict[str, list[str]], values: dict[str, list[str]], generation: str,
                foldable: dict[str, bool] | None = None) -> dict:
    """Apply the changes not applied yet, of all relations, in one commit.

    Any change that does not affect exactly one row raises, and nothing changes; so
    do changes out of order.  ``old_<key>`` columns, if there are any, hold the key
    before an update.  A relation with an empty key is known by whole rows.  One that
    is not ``foldable`` (``operators/capabilities.py``) is replayed in order."""
    base = store.manifest()
    check_generation(base["generation"], generation)
    fresh = changes.where(F.col("end_lsn") > base["remote_lsn"]).persist()
    try:
        found = _summary(fresh, keys)
        if not found:
            return base
        check_order(fresh)
        tables = {}
        for name, holds in sorted(found.items()):
            if name not in keys:
                raise DivergenceError(f"change of unknown relation {name}")
            own = fresh.where(F.col("relation") == name)
            if keys[name]:
                tables[name] = _apply_keyed(store, base, name, own, keys[name], values[name], (foldable or {}).get(name, True), holds)
            else:
                tables[name] = _apply_full(store, base, name, own, values[name], holds)
        last = max(h.last for h in found.values())
        return store.commit(base, tables, last, generation)
    finally:
        fresh.unpersist()


def copy_snapshot(store: VersionedStore, name: str, source: DataFrame, plan: list, key: str | None = None) -> dict:
    """Copy a table part by part, ``COPIES`` at a time, the largest first.

    A part is a directory written whole and a marker beside it; finished parts are
    skipped on the next attempt, and a part without a marker is written anew.  The
    parts themselves become the table, so nothing is copied twice."""
    from ledgerfold.operators.parts import largest_first

    base, schema = store.manifest(), schema_of(source)

    def copy(part) -> tuple[str, str]:
        path, marker = f"{name}/copy/{part.part_id}", f"{name}/copy/{part.part_id}.done"
        if store.files.read(marker) is None:
            rows = source if part.start is None else source.where(F.expr(part.predicate))
            seen = Observation()
            rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(store.files.path(path))
            store.files.create(marker, json.dumps({"part": part.part_id, "rows": seen.get["rows"]}).encode())
        return part.part_id, path

    with ThreadPoolExecutor(COPIES) as pool:
        done = dict(pool.map(copy, largest_first(plan)))
    return store.commit(base, {name: {"base": done, "deltas": [], "buckets": 0, "schema": schema} | ({"key": [key], "by": [key]} if key else {})})
