"""Shared folders, deltas and buckets, plans of log-sized inputs, readiness, pace."""

import json
import time

import pytest
from pyspark.sql import functions as F

from ledgerfold.operators import fold, sampling
from ledgerfold.operators.fold import DivergenceError
from ledgerfold.plans import control, preflight, verification, versioned
from ledgerfold.plans.versioned import VersionedStore, apply_batch
from ledgerfold.sources import archive_list, changes, messages, pgoutput, segments, shared

LOG = "relation string, end_lsn bigint, seq int, kind string, k bigint, v string, toast array<string>, old_k bigint"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("cp")))


@pytest.mark.parametrize("kind", ["local", "hadoop"])
def test_shared_folder(spark, tmp_path, kind):
    make = (lambda: shared.LocalFolder(str(tmp_path))) if kind == "local" else (lambda: shared.HadoopFolder(spark, f"file://{tmp_path}"))
    one, two = make(), make()
    assert one.read("a/b.json") is None and one.names() == []
    assert one.create("a/b.json", b"1") and not two.create("a/b.json", b"2") and two.read("a/b.json") == b"1"
    two.replace("a/b.json", b"3")
    assert one.read("a/b.json") == b"3" and one.names("a") == ["b.json"] and one.names() == ["a"]
    one.delete("a")
    assert two.names() == [] and two.read("a/b.json") is None


def test_store_and_control_over_hadoop_file_systems(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.files = shared.HadoopFolder(spark, f"file://{tmp_path}/store")
    store.folder = store.files.folder
    store.commit(store.manifest(), {"t": store.stage_buckets("t", spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string"), ["k"], 4)})
    log = spark.createDataFrame([("t", 5, 0, "U", 1, "c", [], None)], LOG)
    apply_batch(store, log, {"t": ["k"]}, {"t": ["v"]}, "g")
    assert {(r.k, r.v) for r in store.read("t").collect()} == {(1, "c"), (2, "b")}
    other = store.manifest()
    store.commit(other, {})
    with pytest.raises(RuntimeError):
        store.commit(other, {})  # somebody else was first
    state = control.ControlStore(str(tmp_path / "control"))
    state.files = shared.HadoopFolder(spark, f"file://{tmp_path}/control")
    state.transition("schema")
    assert state.load()["phase"] == "schema" and state.lock("me") and not state.lock("you")
    state.unlock("me")
    state.event("began", n=1)
    assert state.lock("you") and [e["event"] for e in state.events()] == ["began"]
    assert state.report("verify", {"ok": True}) == state.report("verify", {"ok": False}) == {"ok": True}


def test_only_touched_buckets_are_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versioned, "COMPACT_AFTER", 2)
    store = VersionedStore(spark, str(tmp_path))
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    store.commit(store.manifest(), {"t": store.stage_buckets("t", rows, ["k"], 16)})
    first = store.entry("t")["base"]
    run = lambda *rows_: apply_batch(store, spark.createDataFrame(list(rows_), LOG), {"t": ["k"]}, {"t": ["v"]}, "g")
    run(("t", 5, 0, "U", 7, "y", [], None))
    assert store.entry("t")["base"] == first and len(store.entry("t")["deltas"]) == 1
    run(("t", 6, 0, "D", 8, None, [], None), ("t", 7, 0, "I", 1000, "z", [], None))
    after = store.entry("t")
    changed = {b for b in first if after["base"].get(b) != first[b]}
    want = {str(r.b) for r in spark.createDataFrame([(7,), (8,), (1000,)], "k bigint").select(versioned.bucket_of(["k"], 16).alias("b")).collect()}
    assert after["deltas"] == [] and changed == want and len(changed) < 4
    got = {r.k: r.v for r in store.read("t").collect()}
    assert len(got) == 200 and got[7] == "y" and 8 not in got and got[1000] == "z"
    run(("t", 9, 0, "U", 2000, "moved", ["v"], 9))  # the value stays that of the old key
    got = {r.k: r.v for r in store.read("t").collect()}
    assert got[2000] == "x" and 9 not in got
    run(("t", 10, 0, "T", None, None, [], None), ("t", 11, 0, "I", 1, "only", [], None))
    assert [(r.k, r.v) for r in store.read("t").collect()] == [(1, "only")]
    assert store.sweep() and store.read("t").count() == 1


def test_disorder_is_corruption(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    store.commit(store.manifest(), {"t": store.stage("t", spark.createDataFrame([(1, "a")], "k bigint, v string"))})
    twice = spark.createDataFrame([("t", 5, 0, "U", 1, "b", [], None), ("t", 5, 0, "U", 1, "c", [], None)], LOG)
    late = spark.createDataFrame([("t", 5, 0, "U", 1, "b", [], None)], LOG).withColumn("commit_lsn", F.lit(9))
    for bad in (twice, late):
        with pytest.raises(DivergenceError):
            apply_batch(store, bad, {"t": ["k"]}, {"t": ["v"]}, "g")
    assert store.manifest()["version"] == 1


def test_ordered_and_folded_replay_agree(spark, tmp_path):
    rows = [("t", 8 * i + 8, 0, "IUUD"[i % 4], i // 4 % 5, str(i), ["v"] if i % 4 == 2 else [], None) for i in range(80)]
    states = []
    for foldable in (True, False):
        store = VersionedStore(spark, str(tmp_path / str(foldable)))
        store.commit(store.manifest(), {"t": store.stage_buckets("t", spark.createDataFrame([(9, "a")], "k bigint, v string"), ["k"], 4)})
        apply_batch(store, spark.createDataFrame(rows[:78], LOG), {"t": ["k"]}, {"t": ["v"]}, "g", foldable={"t": foldable})
        states.append(sorted((r.k, r.v) for r in store.read("t").collect()))
    assert states[0] == states[1] and len(states[0]) == 2


@pytest.mark.parametrize("make", [
    lambda log: fold.order_violations(log.select(F.col("end_lsn").alias("number"), F.col("end_lsn").alias("commit_lsn"), "end_lsn")),
    lambda log: fold.barrier_epochs(log, F.lit(False)), lambda log: fold.batch_ids(log, 10), lambda log: fold.runs(log, ["relation"])])
def test_no_window_over_the_whole_log(spark, make):
    """Rows of the log are only ever sorted inside a band; what is ordered as a whole
    has a row a band."""
    log = spark.range(100_000).select(F.lit("r").alias("relation"), (F.col("id") * 100).alias("end_lsn"), F.lit(0).alias("seq"), F.lit("U").alias("kind"))
    out = make(log)
    out.write.format("noop").mode("overwrite").save()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows
    for line in windows:
        over_bands = "windowspecdefinition(band#" in line or "windowspecdefinition(relation#" in line and ", band#" in line.split("ASC")[0]
        assert "band#" in line.rsplit("], [", 2)[-2 if line.count("], [") >= 2 else -1] or over_bands, line


def test_bands_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(fold, "BAND", 8)
    monkeypatch.setattr(fold, "MOST_BANDS", 50)
    log = spark.range(2000).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("relation"), (F.col("id") * 7).alias("end_lsn"), F.lit(0).alias("seq"),
                                   F.element_at(F.array(*map(F.lit, "IUUUD")), (F.col("id") / 4 % 5 + 1).cast("int")).alias("kind"))
    assert fold.banded(log, "end_lsn").select("band").distinct().count() <= 51
    rows, want, last = log.orderBy("end_lsn").collect(), {}, {}
    for r in rows:
        n, kind = last.get(r.relation, (0, None))
        n += r.kind != kind
        last[r.relation] = (n, r.kind)
        want[(r.relation, n)] = (r.kind, want.get((r.relation, n), (None, 0))[1] + 1)
    assert {(r.relation, r.run): (r.kind, r.n) for r in fold.runs(log, ["relation"]).collect()} == want
    epochs = {r.end_lsn: r.epoch for r in fold.barrier_epochs(log, F.col("kind") == "D").collect()}
    seen = 0
    for r in rows:
        seen += r.kind == "D"
        assert epochs[r.end_lsn] == seen


def test_sample_reads_only_window_beginnings(spark, tmp_path):
    keys = [k for k in range(0, 40_000) if k % 4 == 0 or k < 2000 or 30_000 < k < 38_000 and k % 500 == 1]
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, v string").repartitionByRange(8, "k").write.parquet(path)
    table = spark.read.parquet(path)
    for windows, each in ((1, 5), (7, 13), (64, 3), (10, 100_000)):
        low, width = min(keys), -(-(max(keys) - min(keys) + 1) // windows)
        want = {k for w in range(windows) for k in sorted(x for x in keys if (x - low) // width == w)[:each]}
        assert {r.k for r in sampling.sample_rows(table, "k", 10**9, windows, each).collect()} == want
    sparse = table.where("k % 1000 = 3 OR k < 50")  # most windows begin with nothing
    assert sampling.sample_rows(sparse, "k", 10**9, 4, 2).count() <= 8


def test_messages_over_task_borders_and_reannouncements(spark, tmp_path):
    import struct

    def announce(columns):
        out = b"R" + struct.pack(">I", 7) + b"s\0t\0d" + struct.pack(">H", len(columns))
        return out + b"".join(b"\1" + c + b"\0" + struct.pack(">Ii", 25, -1) for c in columns)

    def tx(i, *values):
        row = struct.pack(">H", len(values)) + b"".join(b"t" + struct.pack(">i", len(v)) + v for v in values)
        return [b"B" + struct.pack(">QqI", i, 0, 1), b"I" + struct.pack(">I", 7) + b"N" + row, b"C" + struct.pack(">BQQq", 0, i, i + 1, 0)]

    stream = [announce([b"a"])]
    for i in range(10, 400, 2):
        stream += tx(i, b"x")
    stream.append(announce([b"a", b"b"]))  # a column more
    for i in range(400, 800, 2):
        stream += tx(i, b"x", b"y")
    frame = spark.createDataFrame([(n, bytearray(m)) for n, m in enumerate(stream)], "number bigint, data binary")
    rows = messages.change_rows(frame, tasks=5).collect()
    assert len(rows) == 395 and {(len(r.columns), r.end_lsn > 400) for r in rows} == {(1, False), (2, True)}
    decoder = pgoutput.Decoder()
    want = [t["end_lsn"] for m in stream if (t := decoder.decode(m))]
    assert sorted(r.end_lsn for r in rows) == want
    files = segments.write_segments(spark.createDataFrame(rows, segments.SCHEMA), str(tmp_path / "log"), files=3, rotate_bytes=4000).collect()
    assert len(files) > 3 and sum(f.transactions for f in files) == 395
    spark.dataSource.register(segments.SegmentSource)
    back = spark.read.format("change_segments").option("path", str(tmp_path / "log")).load()
    assert sorted(r.end_lsn for r in back.collect()) == want
    found = segments.list_segments(str(tmp_path / "log"))
    assert len(segments.needed(found, after=700)) < len(found) and segments.needed(found, -1) == found
    typed = changes.typed_changes(back, "s.t", spark.createDataFrame([], "a string, b string").schema, ["a"], ["b"])
    assert typed.where("b = 'y'").count() == 200


def test_partial_segment_finalized_while_reading(tmp_path):
    writer = segments.SegmentWriter(str(tmp_path))
    tx = {"commit_us": 0, "relations": [], "changes": []}
    for i in range(5):
        writer.append(tx | {"commit_lsn": 10 * i + 10, "end_lsn": 10 * i + 11})
    writer.sync()
    listed = segments.list_segments(str(tmp_path))
    writer.rotate()
    assert [t["end_lsn"] for t in segments.read_segment(listed[0][0], True)] == [11, 21, 31, 41, 51]


def test_a_table_cut_short_is_incomplete(spark):
    def slow():
        time.sleep(3)
        return verification.TableResult("t")

    out = verification.timed("t", spark, slow, 0.2)
    assert not out.complete and not out.converged and verification.exit_code(verification.roll_up([out])) == 1
    assert verification.timed("t", spark, lambda: verification.TableResult("t"), 30).complete


def test_changes_stratum_reports_what_it_leaves_out(spark):
    sample = spark.createDataFrame([("D", 1), ("U", 2)], "kind string, k bigint")
    table = spark.createDataFrame([(2, "a")], "k bigint, v string")
    same = verification.verify_changes("t", sample, lambda: table, lambda p: table, ["k"])
    assert same.converged and same.deletes == 1 and same.rows == 2
    assert "gone" in verification.verify_changes("t", sample, lambda: table, lambda p: table, ["k"], dropped=True).warnings[0]
    assert "cover" in verification.verify_changes("t", sample, lambda: table, lambda p: table, ["k", "day"], recorded_key=["k"]).warnings[0]


def test_retries_only_lost_connections():
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("08006")
        return "done"

    assert control.with_retries(work, str, sleep=waits.append) == "done" and waits == [0.1, 0.2, 0.4]
    with pytest.raises(ValueError):
        control.with_retries(lambda: (_ for _ in ()).throw(ValueError("23505")), str, sleep=waits.append)
    calls.clear()
    with pytest.raises(OSError):
        control.with_retries(lambda: (_ for _ in ()).throw(OSError("08006")), str, sleep=lambda w: calls.append(w))
    assert len(calls) == 4


def test_state_of_an_older_form_is_migrated(tmp_path):
    folder = shared.LocalFolder(str(tmp_path))
    folder.create(f"control-{1:020d}.json", json.dumps({"phase": "copy", "steps": {}, "end_position": None, "snapshot": None}).encode())
    state = control.ControlStore(str(tmp_path))
    assert state.load()["form"] == control.FORM and state.record_failure(None, "x") == 1


def test_tuning_is_applied_and_reverted(spark, tmp_path):
    state, before = control.ControlStore(str(tmp_path)), spark.conf.get("spark.sql.shuffle.partitions")
    control.apply_tuning(spark, state, control.tuning(8 << 30, 4, 6))
    assert spark.conf.get("spark.sql.shuffle.partitions") == "24"
    control.apply_tuning(spark, state, control.tuning(8 << 30, 4, 9))
    control.revert_tuning(spark, state)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert control.server_settings(spark).where("name = 'spark.app.name'").count() == 1
    assert control.log_usage(spark, str(tmp_path)).first().files >= 1


def test_a_failing_check_is_a_finding(spark):
    broken = {"extensions": spark.range(1), "privileges": spark.createDataFrame([("source", "t", "select", False)], "side string, object string, privilege string, granted boolean")}
    found, complete = preflight.run(spark, broken)
    assert complete and {(r.id, r.kind) for r in found.collect()} == {("extensions", "probe"), ("source-select-t", "privilege")}


def test_stale_copy_is_begun_anew(spark, tmp_path):
    store, state = VersionedStore(spark, str(tmp_path / "s")), control.ControlStore(str(tmp_path / "c"))
    state.step("copy", lambda: None)
    lost = store.stage("t", spark.range(3))
    assert lost in control.recover_stale(state, store) and state.load()["steps"] == {}


def test_archive_entries_in_full(spark):
    lines = [
        "; Archive created", "", "  215; 1259 16389 TABLE  public orders owner", "3300; 0 16389 TABLE DATA public orders owner", "13; 0 0 COMMENT - EXTENSION citext ",
        "14; 0 0 COMMENT public TABLE orders owner", "15; 3079 1 EXTENSION - citext ", "16; 1255 9 FUNCTION public f(integer, text) owner", "17; 2606 5 FK CONSTRAINT public orders orders_fk owner"]
    got = {r.dump_id: r for r in archive_list.parse(spark.createDataFrame([(x,) for x in lines], "line string")).collect()}
    assert set(got) == {215, 3300, 13, 14, 15, 16, 17}
    assert (got[215].kind, got[215].namespace, got[215].tag, got[215].owner) == ("TABLE", "public", "orders", "owner")
    assert (got[13].kind, got[13].namespace, got[13].tag, got[13].owner) == ("COMMENT", None, "EXTENSION citext", "")
    assert (got[16].tag, got[17].tag, got[15].namespace) == ("f(integer, text)", "orders orders_fk", None)
    parsed = archive_list.parse(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [r.dump_id for r in archive_list.use_list(parsed, "deferred").collect()] == [14, 17]
    bad = archive_list.parse(spark.createDataFrame([("not an entry",)], "line string"))
    with pytest.raises(Exception, match="no archive entry"):
        bad.collect()
    unknown = archive_list.parse(spark.createDataFrame([("9; 0 0 WIDGET public x owner",)], "line string"))
    with pytest.raises(Exception, match="unknown kind"):
        unknown.collect()
