"""Files and tasks of a log grow in number with it; its bytes stay what they are."""

import struct

import pyarrow as pa
import pytest

from ledgerfold.sources import messages, pgoutput, segments


def log_rows(n: int) -> list[dict]:
    """Rows of SCHEMA: transactions of one to three changes of two relations."""
    columns = {1: [{"name": "k", "type_oid": 20, "is_key": True}, {"name": "v", "type_oid": 25, "is_key": False}], 2: [{"name": "ü", "type_oid": 17, "is_key": False}]}
    out = []
    for i in range(n):
        for seq in range(i % 3 + 1):
            oid, kind = 1 + (i + seq) % 2, "IUDT"[(i + seq) % 4]
            old = [("t", b"%d" % i), ("n", None)] if kind in "UD" else None
            new = [("b", b"\0"), ("u", None), ("t", b"")] if kind == "U" else [] if kind == "I" else None
            struct = lambda xs: None if xs is None else [{"kind": k, "data": d} for k, d in xs]
            out.append({"relation": f"s.r{oid}", "oid": oid, "commit_lsn": 10 * i + 1, "end_lsn": 10 * i + 5, "commit_us": 1_700_000_000_123_456 + i, "seq": seq, "kind": kind,
                        "old": struct(old), "new": struct(new), "columns": columns[oid], "truncate_cascade": kind == "T", "truncate_restart": False})
    return out


def test_payloads_of_columns_equal_those_of_transactions(spark):
    rows = log_rows(60)
    schema = pa.schema(spark.createDataFrame([], segments.SCHEMA).toArrow().schema)
    got = list(segments.payloads(pa.RecordBatch.from_pylist(rows[i : i + 7], schema=schema) for i in range(0, len(rows), 7)))
    pairs = lambda xs: None if xs is None else [(x["kind"], x["data"]) for x in xs]
    want = []
    for i in range(60):
        own = [r for r in rows if r["commit_lsn"] == 10 * i + 1]
        relations = {r["oid"]: {"oid": r["oid"], "namespace": "s", "name": r["relation"][2:], "identity": "d", "columns": r["columns"]} for r in own}
        changes = [{"oid": r["oid"], "kind": r["kind"], "old": pairs(r["old"]), "new": pairs(r["new"]), "cascade": r["truncate_cascade"], "restart": False} for r in own]
        want.append((10 * i + 1, segments.encode({"commit_lsn": 10 * i + 1, "end_lsn": 10 * i + 5, "commit_us": own[0]["commit_us"], "relations": list(relations.values()), "changes": changes})))
    assert got == want


def test_files_grow_with_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "CHANGES_A_FILE", 40)
    rows = log_rows(400)
    table = spark.createDataFrame(rows, segments.SCHEMA)
    files = segments.write_segments(table, str(tmp_path), files=2).collect()
    assert 15 <= len(files) <= 30 and sum(f.transactions for f in files) == 400 and max(f.transactions for f in files) < 80
    last = -1
    for path, start, _ in segments.list_segments(str(tmp_path)):
        ends = [t["end_lsn"] for t in segments.read_segment(path, False)]
        assert last < start < ends[0] and ends == sorted(ends)
        last = ends[-1]
    spark.dataSource.register(segments.SegmentSource)
    back = spark.read.format("change_segments").option("path", str(tmp_path)).load()
    assert back.orderBy("end_lsn", "seq").collect() == table.orderBy("end_lsn", "seq").collect()


def captured(spark, n: int, torn: int | None = None):
    announced = b"R" + struct.pack(">I", 7) + b"s\0t\0d" + struct.pack(">H", 1) + b"\1a\0" + struct.pack(">Ii", 25, -1)
    stream = [(-1, announced)]
    for i in range(n):
        row = b"I" + struct.pack(">I", 7) + b"N" + struct.pack(">H", 1) + b"t" + struct.pack(">i", 1) + b"x"
        own = [b"B" + struct.pack(">QqI", i + 1, 0, 1), row, row, b"C" + struct.pack(">BQQq", 0, i + 1, i + 2, 0)]
        far = 2**60 if i >= n - 2 else 0  # bands of equal width would hold all the others in one
        stream += [(far + 4 * i + j, m) for j, m in enumerate(own[:3] if i == torn else own)]
    return spark.createDataFrame([(at, bytearray(m)) for at, m in stream], "number bigint, data binary")


def test_tasks_of_a_capture_grow_with_it(spark, monkeypatch):
    monkeypatch.setattr(messages, "MESSAGES_A_PART", 100)
    rows = messages.change_rows(captured(spark, 500), tasks=2)
    sizes = [len(x) for x in rows.select("end_lsn").rdd.glom().collect()]
    assert sum(sizes) == 1000 and 12 <= len(sizes) <= 21 and max(sizes) < 200
    assert sorted((r.end_lsn, r.seq) for r in rows.collect()) == [(i + 2, seq) for i in range(500) for seq in (0, 1)]


def test_a_torn_transaction_before_a_part_is_refused(spark, monkeypatch):
    monkeypatch.setattr(messages, "MESSAGES_A_PART", 4)  # a transaction a part, about
    for torn in (3, 4, 5):
        with pytest.raises(Exception, match="begin inside a transaction"):
            messages.change_rows(captured(spark, 40, torn), tasks=1).collect()
    assert messages.change_rows(captured(spark, 40, 39), tasks=1).count() == 78  # the capture ends in it


@pytest.mark.parametrize("name", ["s14_range_read", "y1_segment_stream"])
def test_messages_of_a_log_are_made_once(spark, sf_dir, monkeypatch, name):
    from ledgerfold.plans import inputs, queries_path

    made, make = spark.sparkContext.accumulator(0), queries_path.messages_of

    def counted(changes):
        def run(batches):
            for batch in batches:
                made.add(batch.num_rows)
                yield batch

        rows = make(changes)
        return rows.mapInArrow(run, rows.schema)

    monkeypatch.setattr(queries_path, "messages_of", counted)
    assert getattr(queries_path, name)(spark, sf_dir).count() == 3
    assert made.value == 3 * inputs.table(spark, sf_dir, "events").count()
