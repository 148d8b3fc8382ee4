"""Binary log, versioned commits, control plane, verification and streaming."""

import os
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.operators.fold import DivergenceError
from ledgerfold.operators.parts import key_parts
from ledgerfold.plans import control, verification
from ledgerfold.plans.versioned import VersionedStore, apply_batch, copy_snapshot
from ledgerfold.sources import archive_list, pgoutput, segments

TX = {
    "commit_lsn": 10, "end_lsn": 12, "commit_us": 1_700_000_000_123_456,
    "relations": [{"oid": 7, "namespace": "public", "name": "widgets", "identity": "d", "columns": [{"name": "id", "type_oid": 23, "is_key": True}, {"name": "note", "type_oid": 25, "is_key": False}]}],
    "changes": [
        {"oid": 7, "kind": "I", "old": None, "new": [("t", b"1"), ("t", b"")], "cascade": False, "restart": False},
        {"oid": 7, "kind": "U", "old": [("t", b"1"), ("n", None)], "new": [("t", b"2"), ("u", None)], "cascade": False, "restart": False},
        {"oid": 7, "kind": "D", "old": [("b", b"\0\1"), ("n", None)], "new": None, "cascade": False, "restart": False},
        {"oid": 7, "kind": "T", "old": None, "new": None, "cascade": True, "restart": False}]}


def at(commit, end):
    return TX | {"commit_lsn": commit, "end_lsn": end}


def test_codec_round_trip_and_checksum():
    assert segments.decode(segments.encode(TX)) == TX
    assert segments.crc32c(b"123456789") == 0xE3069283
    with pytest.raises(segments.CorruptLog):
        segments.decode(segments.encode(TX) + b"x")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60), st.integers(0, 200))
def test_damaged_payloads_are_refused(noise, cut):
    data = segments.encode(TX)
    for bad in (noise, data[:cut] + noise):
        try:
            segments.decode(bad)
        except (segments.CorruptLog, UnicodeDecodeError, struct.error):
            pass


def test_segments_write_recover_read_prune(spark, tmp_path):
    folder = str(tmp_path)
    writer = segments.SegmentWriter(folder, rotate_bytes=400)
    assert [writer.append(at(10 * i, 10 * i + 2)) for i in range(1, 8)] == [True] * 7
    assert not writer.append(at(70, 72)) and writer.sync() == 72
    writer.close()
    spark.dataSource.register(segments.SegmentSource)
    read = lambda **o: spark.read.format("change_segments").options(path=folder, **o).load()
    assert read().count() == 28 and read(after=32).count() == 16 and read(durable=52).count() == 20
    row = read().where("kind = 'U'").first()
    assert row.relation == "public.widgets" and row.new[1].kind == "u" and row.old[0].data == b"1" and row.columns[0].is_key
    tail = [p for p, _, partial in segments.list_segments(folder) if partial]
    if not tail:  # the last frame ended a file: begin another
        writer = segments.SegmentWriter(folder)
        writer.append(at(80, 82))
        writer.close()
        tail = [p for p, _, partial in segments.list_segments(folder) if partial]
    with open(tail[0], "ab") as f:
        f.write(b"\x10\0\0\0torn")
    last = segments.recover(folder)
    again = segments.SegmentWriter(folder)
    assert again.last == last and again.append(at(200, 202))
    again.close()
    finals = [p for p, _, partial in segments.list_segments(folder) if not partial]
    gone = segments.prune(folder, 1000)
    assert gone == finals[:-1]
    with open(finals[-1], "r+b") as f:
        f.seek(20)
        f.write(b"\xff")
    with pytest.raises(segments.CorruptLog):
        list(segments.read_segment(finals[-1], False))


def message(kind, *parts):
    return kind + b"".join(parts)


def cells(*values):
    out = struct.pack(">H", len(values))
    for v in values:
        out += b"n" if v is None else b"u" if v is ... else b"t" + struct.pack(">i", len(v)) + v
    return out


def test_pgoutput_golden_transaction():
    relation = message(b"R", struct.pack(">I", 7), b"public\0widgets\0d", struct.pack(">H", 2), b"\1id\0", struct.pack(">Ii", 23, -1), b"\0note\0", struct.pack(">Ii", 25, -1))
    begin = message(b"B", struct.pack(">QqI", 100, 5, 1))
    d = pgoutput.Decoder("cut")
    seen = [d.decode(m) for m in (
        relation, begin, message(b"I", struct.pack(">I", 7), b"N", cells(b"1", b"")), message(b"U", struct.pack(">I", 7), b"K", cells(b"1", None), b"N", cells(b"2", ...)),
        message(b"D", struct.pack(">I", 7), b"O", cells(b"2", None)), message(b"T", struct.pack(">IB", 1, 3), struct.pack(">I", 7)))]
    assert seen == [None] * 6
    tx = d.decode(message(b"C", struct.pack(">BQQq", 0, 100, 108, 6)))
    assert [c["kind"] for c in tx["changes"]] == list("IUDT") and tx["end_lsn"] == 108 and tx["commit_us"] == pgoutput.EPOCH_US + 6
    assert tx["changes"][0]["new"] == [("t", b"1"), ("t", b"")] and tx["changes"][1]["new"][1] == ("u", None) and tx["changes"][3]["cascade"]
    assert segments.decode(segments.encode(tx)) == tx
    assert d.decode(message(b"M", struct.pack(">BQ", 0, 200), b"cut\0", struct.pack(">I", 0)))["end_lsn"] == 200
    assert d.decode(message(b"M", struct.pack(">BQ", 0, 200), b"other\0", struct.pack(">I", 0))) is None
    for bad in (b"", message(b"C", struct.pack(">BQQq", 0, 1, 2, 3)), message(b"I", struct.pack(">I", 9), b"N", cells(b"1"))):
        with pytest.raises(pgoutput.DecodeError):
            d.decode(bad)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=40), max_size=5))
def test_pgoutput_survives_noise(messages):
    d = pgoutput.Decoder()
    for m in messages:
        try:
            d.decode(m)
        except (pgoutput.DecodeError, UnicodeDecodeError, struct.error):
            assert d.current is None or not m


def test_archive_list(spark):
    lines = ["; comment", "215; 1259 16389 TABLE public orders owner", "3300; 0 16389 TABLE DATA public orders owner", "3160; 2606 16393 FK CONSTRAINT public orders fk owner", "7; 0 0 INDEX public i owner"]
    got = archive_list.parse(spark.createDataFrame([(x,) for x in lines], "line string")).withColumn("phase", archive_list.restore_class(F.col("kind"), F.col("rest"))).collect()
    assert {(r.dump_id, r.kind, r.phase) for r in got} == {(215, "TABLE", "pre-data"), (3300, "TABLE DATA", "skipped"), (3160, "FK CONSTRAINT", "deferred"), (7, "INDEX", "index")}


LOG = "relation string, end_lsn bigint, seq int, kind string, k bigint, v string, toast array<string>"


def store_of(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "store"))
    store.commit(store.manifest(), {"t": store.stage("t", spark.createDataFrame([(1, "a")], "k bigint, v string"))})
    return store


def test_apply_is_exactly_once_and_all_or_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    good = spark.createDataFrame([("t", 5, 0, "I", 2, "b", []), ("t", 6, 0, "U", 1, "c", [])], LOG)
    one = apply_batch(store, good, {"t": ["k"]}, {"t": ["v"]}, "g1")
    assert one["remote_lsn"] == 6 and apply_batch(store, good, {"t": ["k"]}, {"t": ["v"]}, "g1") == one
    pinned = store.manifest()
    bad = spark.createDataFrame([("t", 7, 0, "I", 3, "x", []), ("t", 8, 0, "I", 2, "y", [])], LOG)
    with pytest.raises(DivergenceError):
        apply_batch(store, bad, {"t": ["k"]}, {"t": ["v"]}, "g1")
    assert store.manifest() == pinned and {(r.k, r.v) for r in store.read("t").collect()} == {(1, "c"), (2, "b")}
    with pytest.raises(DivergenceError):
        apply_batch(store, spark.createDataFrame([("t", 9, 0, "D", 1, None, [])], LOG), {"t": ["k"]}, {"t": ["v"]}, "g2")
    orphan = store.stage("t", store.read("t"))  # staged, never committed
    assert orphan in store.sweep() and store.read("t").count() == 2


def test_copy_resumes_by_parts(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path / "copy"))
    source = spark.range(100).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    plan = key_parts("t", "k", 0, 99, 1000, 100, 4)
    broken = source.withColumn("v", F.when(F.col("k") < 50, F.col("v")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        copy_snapshot(store, "t", broken, plan)
    done = [n for n in os.listdir(tmp_path / "copy/t/copy") if n.endswith(".done")]
    assert len(done) == 2 and store.manifest()["version"] == 0
    copy_snapshot(store, "t", source, plan)
    assert store.read("t").count() == 100 and store.read("t").distinct().count() == 100


def test_control_plane(tmp_path):
    c = control.ControlStore(str(tmp_path))
    c.transition("schema")
    c.transition("schema")
    with pytest.raises(control.ControlError):
        c.transition("follow")
    done = []
    calls = {"fail": True}

    def sequences():
        if calls.pop("fail", False):
            raise OSError("gone")
        done.append("sequences")

    run = lambda: control.cutover(c, 99, lambda end: done.append(end), sequences, lambda: done.append("cleanup"), str(tmp_path / "report.json"))
    with pytest.raises(OSError):
        run()
    assert run()["steps"] == ["cleanup", "drain", "sequences"] and done == [99, "sequences", "cleanup"]
    with pytest.raises(control.ControlError):
        c.set_once("end_position", 100)
    assert [c.record_failure(s, "m") for s in ("a", "a", "b", "b")] == [1, 2, 1, 2]
    assert "lag_bytes" in control.status(c, {"remote_lsn": 5, "tables": {}}, 9) and "ledgerfold_lag_bytes 4" in control.metrics({"remote_lsn": 5, "version": 1}, 9)


def test_verification_tells_in_flight_from_diverged(spark):
    source = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    stale = source.where("k <> 7").withColumn("v", F.when(F.col("k") == 9, "old").otherwise(F.col("v")))
    fixed = source.withColumn("v", F.when(F.col("k") == 9, "old").otherwise(F.col("v")))
    target = lambda position: stale if position is None else fixed
    out = verification.verify_table("t", lambda: source, target, ["k"], budget=200, windows=4, mark=lambda: 1, wait=lambda p: None, rounds=2)
    assert out.differences == [('["9"]', "different")] and out.in_flight == 1 and out.coverage == 1.0 and not out.converged
    none = verification.verify_table("u", lambda: source, target, None, "no key")
    summary = verification.roll_up([out, none])
    assert summary["coverage"] == 0.0 and summary["warnings"] and verification.exit_code(summary) == 1
    assert verification.throttle(3.0, 0.25) == 9.0
