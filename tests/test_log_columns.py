"""What is read and made by columns is what is read and made one by one."""

import io
import random
import struct

import pyarrow as pa
import pytest

from ledgerfold.sources import columns, messages, pgoutput, segments


def relation(oid: int, width: int) -> dict:
    return {"oid": oid, "namespace": "s", "name": f"r{oid}ü", "identity": "d", "columns": [{"name": f"c{i}", "type_oid": 20 + i, "is_key": i == 0} for i in range(width)]}


RELATIONS = {oid: relation(oid, width) for oid, width in ((1, 3), (2, 1), (7, 0))}


def transactions(n: int, large: int = 41) -> list[dict]:
    """Of none to five changes over up to two relations; some are large."""
    chance, out = random.Random(5), []
    cell = lambda: chance.choice([("n", None), ("u", None), ("t", b"x" * chance.randrange(9)), ("b", b"\0\xff"), ("t", "ü".encode())])
    for i in range(n):
        changes = []
        for _ in range(chance.randrange(6)):
            oid, kind = chance.choice([1, 2] if i % 5 else [7]), chance.choice("IUDT")
            cells = lambda: [cell() for _ in range(len(RELATIONS[oid]["columns"]))]  # noqa: B023, E731
            changes.append({"oid": oid, "kind": kind, "old": cells() if kind == "D" or (kind == "U" and chance.random() < 0.5) else None, "new": cells() if kind in "IU" else None,
                            "cascade": kind == "T" and chance.random() < 0.5, "restart": kind == "T" and chance.random() < 0.5})
        if i % large == large - 1:
            changes.append({"oid": 2, "kind": "I", "old": None, "new": [("t", b"y" * (segments.SIDE_BY_SIDE + 1))], "cascade": False, "restart": False})
        used = dict.fromkeys(c["oid"] for c in changes)
        out.append({"commit_lsn": 10 * i + 3, "end_lsn": 10 * i + 5, "commit_us": (-1) ** i * (10**15 + i), "relations": [RELATIONS[oid] for oid in used], "changes": changes})
    return out


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", len(payload), segments.crc32c(payload)) + payload


def read(path, partial=False, after=-1, durable=None) -> list[dict] | str:
    """Rows, or the error."""
    rows = []
    try:
        for batch in segments.segment_rows(segments.SegmentFile(str(path), partial, after, durable)):
            rows += batch.to_pylist()
    except (segments.CorruptLog, UnicodeDecodeError, KeyError, OverflowError, pa.ArrowInvalid) as e:
        return f"{type(e).__name__}: {e}"
    return rows


def both_ways(monkeypatch, *args, **options):
    got = read(*args, **options)
    with monkeypatch.context() as m:
        m.setattr(segments, "LANES", 1 << 40)
        assert read(*args, **options) == got
    return got


def test_segments_are_read_side_by_side(tmp_path, monkeypatch):
    made = transactions(300)
    path = tmp_path / f"{3:016x}.seg"
    path.write_bytes(b"".join(frame(segments.encode(t)) for t in made))
    rows = both_ways(monkeypatch, path)
    assert [(r["end_lsn"], r["seq"], r["kind"], r["truncate_cascade"]) for r in rows] == [(t["end_lsn"], i, c["kind"], c["cascade"]) for t in made for i, c in enumerate(t["changes"])]
    assert {r["commit_us"] for r in rows} == {t["commit_us"] for t in made if t["changes"]}
    for after, durable in ((-1, 0), (1005, 2000), (1004, 1005), (0, None), (5000, None), (2999, 2000)):
        some = both_ways(monkeypatch, path, after=after, durable=durable)
        assert some == [r for r in rows if r["end_lsn"] > after and (durable is None or r["end_lsn"] <= durable)]
    small = [t for t in made if len(segments.encode(t)) < segments.SIDE_BY_SIDE]
    path.write_bytes(b"".join(frame(segments.encode(t)) for t in small))
    monkeypatch.setattr(segments, "decode_changes", lambda *_: pytest.fail("a change by itself"))
    assert len(read(path)) == sum(len(t["changes"]) for t in small)


def test_damaged_segments_say_the_same(tmp_path, monkeypatch):
    made = [segments.encode(t) for t in transactions(60, large=1000)]
    framed = [frame(p) for p in made]
    good = b"".join(framed)
    path = tmp_path / f"{3:016x}.seg"
    for data in (good[:-3], good[:-3 - len(made[-1])], good + b"\1", good[:4000] + bytes([good[4000] ^ 1]) + good[4001:], good + frame(made[0]), b""):
        path.write_bytes(data)
        for partial in (False, True):
            both_ways(monkeypatch, path, partial)
    chance, refused = random.Random(6), 0
    for _ in range(200):  # what a checksum holds and a decoder may not
        i = chance.randrange(len(made))
        bad = bytearray(made[i])
        for _ in range(chance.choice([1, 1, 2])):
            bad[chance.randrange(len(bad))] = chance.choice([0, 1, 2, 3, 255, chance.randrange(256)])
        bad = bytes(bad) if chance.random() < 0.8 else bytes(bad[: chance.randrange(len(bad))])
        path.write_bytes(b"".join([*framed[:i], frame(bad), *framed[i + 1 :]]))
        refused += isinstance(both_ways(monkeypatch, path), str)
    assert refused > 50


def test_payloads_are_joined_from_slices(monkeypatch, tmp_path):
    made = [t for t in transactions(80) if t["changes"]]
    path = tmp_path / f"{3:016x}.seg"
    path.write_bytes(b"".join(frame(segments.encode(t)) for t in made))
    batches = list(segments.segment_rows(segments.SegmentFile(str(path), False, -1, None)))
    want = [(t["commit_lsn"], segments.encode(t)) for t in made]
    for most in (segments.JOINED, 4000, 1):
        monkeypatch.setattr(segments, "JOINED", most)
        assert list(segments.payloads(batches)) == want
    sizes = [b.nbytes for b in segments._slices(batches)]
    assert len(sizes) == sum(map(len, batches))  # a row each, at the smallest


def test_frames_of_a_file_are_checked(monkeypatch):
    monkeypatch.setattr(segments, "CHECKED_TOGETHER", 50)
    data = [bytes([i]) * 20 for i in range(10)]
    whole = b"".join(map(frame, data))
    assert [p for ps, _ in segments.checked(io.BytesIO(whole)) for p in ps] == data
    broken = list(segments.checked(io.BytesIO(whole[: 28 * 4 + 10] + b"\xff" + whole[28 * 4 + 11 :])))
    assert [p for ps, _ in broken for p in ps] == data[:4] and broken[-1][1] == "checksum mismatch"


def message_cells(chance) -> bytes:
    cells = [b"n", b"u", b"t" + struct.pack(">i", 2) + b"ab", b"b" + struct.pack(">i", 0)]
    return struct.pack(">H", 3) + b"".join(chance.choice(cells) for _ in range(3))


def message_transactions(chance, n: int) -> list[bytes]:
    out = []
    for i in range(n):
        out.append(b"B" + struct.pack(">QqI", 4 * i + 1, -i, 7))
        for _ in range(chance.randrange(4)):
            kind, oid, old = chance.choice("IUD"), struct.pack(">I", chance.choice([1, 2])), chance.choice([b"K", b"O", b""])
            old = old + message_cells(chance) if old and kind != "I" else b"" if kind != "D" else b"K" + message_cells(chance)
            out.append(kind.encode() + oid + old + (b"N" + message_cells(chance) if kind != "D" else b""))
        out.append(b"C" + struct.pack(">BQQq", 0, 4 * i + 1, 4 * i + 2, 10**12 - i))
    return out


def decoders() -> pgoutput.Decoder:
    decoder = pgoutput.Decoder()
    for oid in (1, 2):
        columns = b"".join(bytes([i == 0]) + b"c%d\0" % i + struct.pack(">Ii", 25, -1) for i in range(3))
        decoder.decode(b"R" + struct.pack(">I", oid) + b"s\0t%d\0d" % oid + struct.pack(">H", 3) + columns)
    return decoder


def one_by_one(stream: list[bytes]) -> list[dict]:
    decoder, rows = decoders(), segments.ChangeRows()
    for data in stream:
        tx = decoder.decode(data)
        for seq, c in enumerate(tx["changes"] if tx else ()):
            r = decoder.relations[c["oid"]]
            rows.add(tx, f"{r['namespace']}.{r['name']}", r["columns"], seq, c)
    if decoder.current is not None:
        raise pgoutput.DecodeError("it ends in a transaction")
    return rows.batch().to_pylist()


def together(stream: list[bytes]) -> list[dict]:
    return messages.side_by_side(*columns.spans(pa.array([b"?", *stream], pa.binary())[1:]), decoders().relations).to_pylist()


def test_messages_are_decoded_side_by_side():
    chance = random.Random(7)
    stream = message_transactions(chance, 200)
    rows = together(stream)
    assert rows == one_by_one(stream) and len(rows) == len(stream) - 400
    irregular = 0
    for _ in range(400):  # whatever is decoded side by side is what one by one gives
        own = message_transactions(chance, 4)
        i = chance.randrange(len(own))
        if chance.random() < 0.2:
            own.insert(i, chance.choice([b"", own[0], own[-1], b"Y", b"T" + struct.pack(">IBI", 1, 0, 1)]))
        else:
            bad = bytearray(own[i])
            bad[chance.randrange(len(bad))] = chance.choice([0, 1, 255, *b"NKOtbnuBCIUD"])
            own[i] = bytes(bad) if chance.random() < 0.7 else own[i][: chance.randrange(len(own[i]))]
        try:
            rows = together(own)
        except columns.Irregular:
            irregular += 1
            continue
        assert rows == one_by_one(own)
    assert 50 < irregular < 400


def test_captured_messages_are_those_of_the_protocol(spark):
    from ledgerfold.plans import queries_path

    schema = "oid int, kind string, end_lsn bigint, old array<string>, new array<string>, unchanged array<int>"
    rows = [(1, "I", 8, None, ["1", None, "ü"], None), (2, "U", 1 << 41, ["1", None, None], ["2", "", "x" * 300], [1]), (3, "U", 24, ["1", "a"], ["1", "b"], None),
            (1, "D", 32, ["1", None, None], None, [2]), (1, "U", 40, None, ["1", "2", "3"], [2, 5]), (3, "I", 48, None, [], [])]
    cell = lambda x: b"n" if x is None else b"t" + struct.pack(">i", len(x.encode())) + x.encode()
    want = []
    for oid, kind, end, old, new, unchanged in rows:
        data = kind.encode() + struct.pack(">I", oid)
        for mark, cells, kept in ((b"O" if oid == 3 else b"K", old, ()), (b"N", new, unchanged or ())):
            if cells is not None:
                data += mark + struct.pack(">H", len(cells)) + b"".join(b"u" if i in kept else cell(x) for i, x in enumerate(cells))
        want += [(end * 4, b"B" + struct.pack(">QqI", end - 1, 0, 1)), (end * 4 + 1, data), (end * 4 + 2, b"C" + struct.pack(">BQQq", 0, end - 1, end, 0))]
    made = queries_path.messages_of(spark.createDataFrame(rows, schema))
    assert not [line for line in made._jdf.queryExecution().toString().splitlines() if "InArrow" in line or "Python" in line]
    assert sorted((r.number, bytes(r.data)) for r in made.collect()) == sorted(want)
