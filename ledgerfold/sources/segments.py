"""Segment files of a durable, checksummed, ordered change log.

A file ``<16 hex digits of the first commit position>.seg`` (``.seg.partial`` while
it grows) is a sequence of frames: payload length and CRC-32C as little-endian
32-bit numbers, then the payload of one transaction.  A transaction is described by
its own payload, so every frame can be decoded alone.

``SegmentSource`` ("change_segments") reads a folder of them as rows of changes, in a
batch or as a stream: one partition a file, changes streamed one by one, only what is
durable, without the files that were applied.  ``write_segments`` writes them from
tasks, a file for each range of positions; ``SegmentWriter`` appends to one as a
receiver does.  Folders are paths or URIs.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ledgerfold.sources import columns as C
from ledgerfold.sources.shared import list_files, open_file, publish, shared_folder

#: Fixed values of the payload format: magic, versions, change and cell kinds.
MAGIC = b"PGMC"
VERSION = 2
READABLE = (1, 2)
CHANGE_KINDS = {1: "I", 2: "U", 3: "D", 4: "T"}
CELL_KINDS = {0: "n", 1: "t", 2: "b", 3: "u"}
CHANGE_CODES = {v: k for k, v in CHANGE_KINDS.items()}
CELL_CODES = {v: k for k, v in CELL_KINDS.items()}
ROTATE_BYTES = 1 << 30
SYNC_BYTES = 4 << 20


class CorruptLog(RuntimeError):
    """A finalized segment that is not what was written; never repaired."""


def _crc_table() -> list[int]:
    """CRC-32C (reversed polynomial 0x82F63B78)."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        table.append(n)
    return table


_CRC = np.array(_crc_table(), np.uint32)


def _advance(crc: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The states of all lanes after one more byte of each."""
    return crc >> np.uint32(8) ^ _CRC[(crc ^ data) & np.uint32(255)]


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """The checksums of many payloads, byte by byte over all of them at once: the
    longest first, so that at every byte the payloads that still have one lead."""
    sizes = np.array([len(p) for p in payloads])
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    flat = np.frombuffer(b"".join(payloads), np.uint8)
    starts = (np.cumsum([0, *[len(p) for p in payloads]])[:-1])[order] if len(payloads) else np.zeros(0, int)
    crc = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    left = len(payloads)
    for at in range(int(sizes[0]) if len(sizes) else 0):
        while left and sizes[left - 1] <= at:
            left -= 1
        if left < LANES:  # few long ones remain: each by itself
            break
        crc[:left] = _advance(crc[:left], flat[starts[:left] + at].astype(np.uint32))
    else:
        at = int(sizes[0]) if len(sizes) else 0
    for i in range(left):
        crc[i] = _crc_long(int(crc[i]), flat[starts[i] + at : starts[i] + sizes[i]])
    out = np.empty(len(payloads), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


#: Payloads from which a step over all of them beats one after the other.
LANES = 8


def _matrix_times(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map of 32-bit words (the images of the single bits) applied."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where(x >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


def _zeros_map(n: int) -> np.ndarray:
    """What ``n`` zero bytes make of a state, by repeated squaring."""
    one = np.array([1 << b for b in range(32)], np.uint32)
    power = _advance(one, np.zeros(32, np.uint32))
    result = one
    while n:
        if n & 1:
            result = _matrix_times(power, result)
        power = _matrix_times(power, power)
        n >>= 1
    return result


def _crc_long(crc: int, data: np.ndarray) -> int:
    """The state after one long run of bytes: lanes of equal length side by side,
    joined by what the bytes behind a lane make of its state."""
    lanes = min(1024, len(data) // 64)
    if lanes < 2:
        for b in data.tolist():
            crc = crc >> 8 ^ int(_CRC[(crc ^ b) & 255])
        return crc
    width = len(data) // lanes
    states = np.zeros(lanes, np.uint32)
    states[0] = crc
    block = data[: lanes * width].reshape(lanes, width)
    for i in range(width):
        states = _advance(states, block[:, i].astype(np.uint32))
    shift, out = _zeros_map(width), np.zeros(1, np.uint32)
    for state in states:
        out = _matrix_times(shift, out) ^ state
    return _crc_long(int(out[0]), data[lanes * width :])


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


# --- payload -------------------------------------------------------------------


def _sized(data: bytes) -> bytes:
    return struct.pack("<I", len(data)) + data


def _cells(cells) -> bytes:
    if cells is None:
        return b"\0"
    out = [b"\1", struct.pack("<I", len(cells))]
    for kind, data in cells:
        out.append(bytes([CELL_CODES[kind]]))
        if kind in "tb":
            out.append(_sized(data))
        elif data is not None:
            raise ValueError("a null or unchanged cell has no data")
    return b"".join(out)


def _relation(r: dict) -> bytes:
    out = [struct.pack("<I", r["oid"]), r["identity"].encode("latin-1"), _sized(r["namespace"].encode()), _sized(r["name"].encode()), struct.pack("<I", len(r["columns"]))]
    for c in r["columns"]:
        out += [struct.pack("<IB", c["type_oid"], int(c["is_key"])), _sized(c["name"].encode())]
    return b"".join(out)


def _payload(commit: int, end: int, commit_us: int, relations: list[bytes], changes: list[bytes]) -> bytes:
    """A payload of encoded relations and changes (three pieces a change)."""
    seconds, micros = divmod(commit_us, 1_000_000)
    head = [MAGIC, _HEAD.pack(VERSION, commit, end, seconds, micros * 1000), _U32.pack(len(relations))]
    return b"".join([*head, *relations, _U32.pack(len(changes) // 3), *changes])


def encode(tx: dict) -> bytes:
    """The payload of a transaction; equal transactions give equal bytes."""
    out = []
    for c in tx["changes"]:
        options = bytes([c["cascade"] | c["restart"] << 1]) if c["kind"] == "T" else b""
        out += [_CHANGE.pack(c["oid"], CHANGE_CODES[c["kind"]]), options, _cells(c["old"]) + _cells(c["new"])]
    return _payload(tx["commit_lsn"], tx["end_lsn"], tx["commit_us"], [_relation(r) for r in tx["relations"]], out)


_U32, _CHANGE, _HEAD, _RELATION, _FRAME = (struct.Struct("<" + form) for form in ("I", "IB", "BQQqI", "IB", "II"))
#: The same as packed types, for columns of them.
_HEADS = np.dtype([("magic", "S4"), ("version", "u1"), ("commit", "<u8"), ("end", "<u8"), ("seconds", "<i8"), ("nanos", "<u4")])
_CHANGES = np.dtype([("oid", "<u4"), ("kind", "u1")])


class _Payload:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        end = self.at + n
        if end > len(self.data):
            raise CorruptLog("payload ends early")
        out = self.data[self.at : end]
        self.at = end
        return out

    def unpack(self, form: struct.Struct):
        return form.unpack(self.take(form.size))

    def byte(self) -> int:
        return self.take(1)[0]

    def count(self, least: int) -> int:
        """A count that the rest of the payload can hold, so it bounds memory."""
        n = int.from_bytes(self.take(4), "little")
        if n * least > len(self.data) - self.at:
            raise CorruptLog(f"count {n} is larger than the payload")
        return n

    def sized(self) -> bytes:
        return self.take(int.from_bytes(self.take(4), "little"))

    def cells(self):
        data, at, end = self.data, self.at + 1, len(self.data)
        present = self.byte()
        if present > 1:
            raise CorruptLog("bad tuple mark")
        if not present:
            return None
        n, at = self.count(1), at + 4
        out = []
        for _ in range(n):
            if at >= end:
                raise CorruptLog("payload ends early")
            kind = CELL_KINDS.get(data[at])
            at += 1
            if kind is None:
                raise CorruptLog("bad cell kind")
            if kind in "tb":
                start = at + 4
                at = start + int.from_bytes(data[at:start], "little")
                if start > end or at > end:
                    raise CorruptLog("payload ends early")
                out.append((kind, data[start:at]))
            else:
                out.append((kind, None))
        self.at = at
        return out

    def relations(self) -> list[dict]:
        out = []
        for _ in range(self.count(17)):
            oid, identity = self.unpack(_RELATION)
            namespace, name = self.sized().decode(), self.sized().decode()
            columns = []
            for _ in range(self.count(9)):
                kind, flags = self.unpack(_RELATION)
                columns.append({"name": self.sized().decode(), "type_oid": kind, "is_key": bool(flags & 1)})
            out.append({"oid": oid, "namespace": namespace, "name": name, "identity": chr(identity), "columns": columns})
        return out


def decode_head(p: _Payload, known: tuple[bytes, list[dict]] | None = None) -> tuple[dict, int, int]:
    """A payload's transaction without its changes, their number and the version.
    ``known``: the bytes of a description of relations that was read before, and what
    it says; a log repeats the same one in most of its transactions."""
    if p.take(4) != MAGIC:
        raise CorruptLog("not a transaction payload")
    version, commit, end, seconds, nanos = p.unpack(_HEAD)
    if version not in READABLE or nanos >= 1_000_000_000:
        raise CorruptLog("unknown version or bad time")
    if known and p.data.startswith(known[0], p.at):
        relations = known[1]
        p.at += len(known[0])
    else:
        relations = p.relations()
    head = {"commit_lsn": commit, "end_lsn": end, "commit_us": seconds * 1_000_000 + nanos // 1000, "relations": relations}
    return head, p.count(7), version


def decode_changes(p: _Payload, count: int, version: int) -> Iterator[dict]:
    """The changes of a payload one by one: a large transaction is never held as
    objects, only as its bytes."""
    for _ in range(count):
        oid, code = p.unpack(_CHANGE)
        kind = CHANGE_KINDS.get(code)
        if kind is None:
            raise CorruptLog(f"bad change kind {code}")
        options = p.byte() if version >= 2 and kind == "T" else 0
        if options & ~3:
            raise CorruptLog("bad truncate options")
        yield {"oid": oid, "kind": kind, "old": p.cells(), "new": p.cells(), "cascade": bool(options & 1), "restart": bool(options & 2)}
    if p.at != len(p.data):
        raise CorruptLog("trailing bytes")


def decode(payload: bytes) -> dict:
    p = _Payload(payload)
    head, count, version = decode_head(p)
    return head | {"changes": list(decode_changes(p, count, version))}


# --- files ---------------------------------------------------------------------


def segment_name(name: str) -> tuple[int, bool] | None:
    """(start position, partial) of a segment's file name."""
    partial = name.endswith(".seg.partial")
    base = name.removesuffix(".partial").removesuffix(".seg")
    if len(base) != 16 or not name.endswith((".seg", ".seg.partial")):
        return None
    try:
        return int(base, 16), partial
    except ValueError:
        return None


def list_segments(folder: str) -> list[tuple[str, int, bool]]:
    """(path, start, partial) by start; finalized before partial."""
    found = [(path, *s) for path, _ in list_files(folder) if (s := segment_name(os.path.basename(path)))]
    return sorted(found, key=lambda x: (x[1], x[2]))


def needed(found: list[tuple[str, int, bool]], after: int, upto: int | None = None) -> list[tuple[str, int, bool]]:
    """The files that can hold transactions that end after ``after`` and by ``upto``:
    one whose successor starts at or before ``after`` can not."""
    later = [start for _, start, _ in found[1:]] + [None]
    return [x for x, following in zip(found, later, strict=True) if (following is None or following > after) and (upto is None or x[1] <= upto)]


def open_segment(path: str):
    """The file, also if it was finalized since it was listed."""
    try:
        return open_file(path)
    except FileNotFoundError:
        return open_file(path.removesuffix(".partial"))


#: Bytes of frames whose checksums are computed together.
CHECKED_TOGETHER = 4 << 20


def checked(source) -> Iterator[tuple[list[bytes], str | None]]:
    """Payloads of a file's frames whose checksums were computed together, and the
    problem behind them, if there is one; it ends them."""
    held: list[tuple[bytes, int]] = []
    size, problem = 0, None
    while True:
        head = source.read(8)
        payload = b""
        if head and len(head) < 8:
            problem = "short frame header"
        elif head:
            length, want = _FRAME.unpack(head)
            payload = source.read(length)
            if len(payload) < length:
                problem = "short payload"
            else:
                held.append((payload, want))
                size += length
        if problem or not head or size >= CHECKED_TOGETHER:
            payloads = [data for data, _ in held]
            wrong = np.flatnonzero(crc32c_many(payloads) != np.array([want for _, want in held], np.uint32))
            if len(wrong):
                yield payloads[: wrong[0]], "checksum mismatch"
                return
            yield payloads, problem
            held, size = [], 0
            if problem or not head:
                return


class Transactions:
    """What is read of a file, in its order.  A torn tail ends a partial file; in a
    finalized one it is corruption.  Order is checked in both."""

    def __init__(self, path: str, partial: bool, durable: int | None = None):
        self.name, self.partial, self.durable = os.path.basename(path), partial, durable
        self.commit = self.end = -1
        self.known, self.ended = None, False

    def stop(self, problem: str) -> None:
        self.ended = True
        if not self.partial:
            raise CorruptLog(f"{self.name}: {problem}")

    def of(self, payloads: list[bytes], problem: str | None = None) -> Iterator[tuple[dict, _Payload, int, int]]:
        """(head, payload, number of changes, version) of the next ones."""
        for data in payloads:
            p = _Payload(data)
            head, count, version = decode_head(p, self.known)
            if self.known is None or head["relations"] is not self.known[1]:
                self.known = (data[4 + _HEAD.size : p.at - 4], head["relations"])  # up to the number of changes
            if head["commit_lsn"] <= self.commit or head["end_lsn"] <= self.end or head["end_lsn"] < head["commit_lsn"]:
                self.stop("positions out of order")
                return
            if self.durable is not None and head["end_lsn"] > self.durable:
                self.ended = True
                return
            self.commit, self.end = head["commit_lsn"], head["end_lsn"]
            yield head, p, count, version
        if problem:
            self.stop(problem)


def read_payloads(path: str, partial: bool, durable: int | None = None) -> Iterator[tuple[dict, _Payload, int, int]]:
    """(head, payload, number of changes, version) of a file's transactions."""
    state = Transactions(path, partial, durable)
    with open_segment(path) as source:
        for payloads, problem in checked(source):
            yield from state.of(payloads, problem)
            if state.ended:
                return


def read_segment(path: str, partial: bool, durable: int | None = None) -> Iterator[dict]:
    """The transactions of a file, whole."""
    for head, p, count, version in read_payloads(path, partial, durable):
        yield head | {"changes": list(decode_changes(p, count, version))}


def recover(folder: str) -> int:
    """Cut a torn tail off the partial file; returns the last end position."""
    last = 0
    for path, _, partial in list_segments(folder):
        size = 0
        for tx in read_segment(path, partial):
            last = tx["end_lsn"]
            size += 8 + len(encode(tx))
        if partial and os.path.getsize(path) != size:
            with open(path, "r+b") as out:
                out.truncate(size)
                os.fsync(out.fileno())
    return last


class SegmentWriter:
    """Appends transactions in order; ``durable`` is the last synced end position.

    Transactions at or before the last end are repeats after a reconnect and are
    skipped.  Syncs are grouped; a file is finalized at ``rotate_bytes``."""

    def __init__(self, folder: str, rotate_bytes: int = ROTATE_BYTES, sync_bytes: int = SYNC_BYTES):
        os.makedirs(folder, exist_ok=True)
        self.folder, self.rotate_bytes, self.sync_bytes = folder, rotate_bytes, sync_bytes
        self.last = self.durable = recover(folder)
        tail = [p for p, _, partial in list_segments(folder) if partial]
        self.path = tail[-1] if tail else None
        self.out = open(self.path, "ab") if tail else None
        self.pending = 0

    def append(self, tx: dict) -> bool:
        if tx["end_lsn"] <= self.last:
            return False
        if self.out is None:
            self.path = os.path.join(self.folder, f"{tx['commit_lsn']:016x}.seg.partial")
            self.out = open(self.path, "ab")
        payload = encode(tx)
        self.out.write(struct.pack("<II", len(payload), crc32c(payload)) + payload)
        self.last, self.pending = tx["end_lsn"], self.pending + len(payload)
        if self.pending >= self.sync_bytes:
            self.sync()
        if self.out.tell() >= self.rotate_bytes:
            self.rotate()
        return True

    def sync(self) -> int:
        if self.out is not None:
            self.out.flush()
            os.fsync(self.out.fileno())
        self.durable, self.pending = self.last, 0
        return self.durable

    def rotate(self):
        self.sync()
        if self.out is not None:
            self.out.close()
            os.replace(self.path, self.path.removesuffix(".partial"))
        self.out = self.path = None

    def close(self):
        self.sync()
        if self.out is not None:
            self.out.close()
        self.out = None


def prunable(found: list[tuple[str, int, bool]], ends: dict[str, int], applied: int, most: int = 128) -> list[str]:
    """Finalized segments wholly before the applied position, but the newest of
    them, at most so many a pass, oldest first."""
    done = [name for name, _, partial in sorted(found, key=lambda x: x[1]) if not partial and name in ends and ends[name] < applied]
    return done[:-1][:most]


def prune(folder: str, applied: int, most: int = 128) -> list[str]:
    """Remove the prunable segments; returns their paths.  A segment's end is only
    read where its successor does not already start beyond the position."""
    found, ends = list_segments(folder), {}
    for path, start, partial in found:
        if not partial and start < applied:
            last = [head["end_lsn"] for head, *_ in read_payloads(path, partial)]
            if last:
                ends[path] = last[-1]
    gone = prunable(found, ends, applied, most)
    files = shared_folder(folder)
    for path in gone:
        files.delete(os.path.basename(path))
    return gone


def fresh_transactions(arrivals):
    """Those of (arrival, end position) pairs that come after all kept before: after
    a reconnect the source sends again what it has no acknowledgement for."""
    last = -1
    for arrival, end in arrivals:
        if end > last:
            last = end
            yield arrival, end


# --- Spark ---------------------------------------------------------------------

CELLS = "array<struct<kind:string,data:binary>>"
SCHEMA = (
    "relation string, oid bigint, commit_lsn bigint, end_lsn bigint, commit_us bigint, seq int, kind string, "
    f"old {CELLS}, new {CELLS}, columns array<struct<name:string,type_oid:bigint,is_key:boolean>>, truncate_cascade boolean, truncate_restart boolean"
)


class SegmentFile(InputPartition):
    def __init__(self, path: str, partial: bool, after: int, durable: int | None):
        self.path, self.partial, self.after, self.durable = path, partial, after, durable


#: Changes of an Arrow batch that the source hands over.
BATCH_CHANGES = 8192


class _Cells:
    """Tuples of cells as one Arrow column, built from flat lists."""

    def __init__(self):
        self.kinds, self.data, self.ends, self.missing = [], [], [0], []

    def add(self, cells) -> None:
        self.missing.append(cells is None)
        for kind, data in cells or ():
            self.kinds.append(kind)
            self.data.append(data)
        self.ends.append(len(self.kinds))

    def array(self):
        flat = pa.StructArray.from_arrays([pa.array(self.kinds, pa.string()), pa.array(self.data, pa.binary())], names=["kind", "data"])
        return pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), flat, mask=pa.array(self.missing, pa.bool_()))


def change_batch(described: list[tuple[str, list[dict]]], which, oid, commit, end, us, seq, kind, old, new, cascade, restart) -> pa.RecordBatch:
    """Rows of SCHEMA from their columns; ``which`` of the described relations (name,
    columns) each is of."""
    which = pa.array(which, pa.int32())
    flat = [c for _, cs in described for c in cs]
    ends = np.cumsum([0, *(len(cs) for _, cs in described)]).astype(np.int32)
    columns = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(
        [pa.array([c["name"] for c in flat], pa.string()), pa.array([c["type_oid"] for c in flat], pa.int64()), pa.array([c["is_key"] for c in flat], pa.bool_())],
        names=["name", "type_oid", "is_key"])).take(which)
    relation = pa.array([name for name, _ in described], pa.string()).take(which)
    numbers = [pa.array(x, pa.int64()) for x in (oid, commit, end, us)]
    return pa.RecordBatch.from_arrays(
        [relation, *numbers, pa.array(seq, pa.int32()), kind, old, new, columns, pa.array(cascade, pa.bool_()), pa.array(restart, pa.bool_())],
        names=["relation", "oid", "commit_lsn", "end_lsn", "commit_us", "seq", "kind", "old", "new", "columns", "truncate_cascade", "truncate_restart"])


class ChangeRows:
    """Rows of SCHEMA as Arrow batches; a relation's columns are described once a
    batch."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.plain, self.described, self.places, self.at, self.old, self.new = [], [], {}, [], _Cells(), _Cells()

    def __len__(self) -> int:
        return len(self.plain)

    def add(self, tx: dict, name: str, columns: list[dict], seq: int, c: dict) -> None:
        place = self.places.get((name, id(columns)))
        if place is None:
            place = self.places[name, id(columns)] = len(self.described)
            self.described.append((name, columns))  # also keeps the list, and so its id
        self.at.append(place)
        self.plain.append((c["oid"], tx["commit_lsn"], tx["end_lsn"], tx["commit_us"], seq, c["kind"], c["cascade"], c["restart"]))
        self.old.add(c["old"])
        self.new.add(c["new"])

    def batch(self):
        """What was added since the last batch."""
        oid, commit, end, us, seq, kind, cascade, restart = map(list, zip(*self.plain, strict=True)) if self.plain else ([] for _ in range(8))
        out = change_batch(self.described, self.at, oid, commit, end, us, seq, pa.array(kind, pa.string()), self.old.array(), self.new.array(), cascade, restart)
        self.clear()
        return out


#: Payloads up to so many bytes are decoded side by side.
SIDE_BY_SIDE = 16 << 10
#: Different descriptions of relations among payloads decoded side by side.
MOST_DESCRIBED = 32
_CELL_PLACES = np.full(256, 255, np.uint8)
_CELL_PLACES[list(CELL_KINDS)] = [C.KINDS.index(k) for k in CELL_KINDS.values()]
_CHANGE_NAMES = pa.array(["", *CHANGE_KINDS.values()])


def _described(payloads: list[bytes], buffer, at, ends) -> tuple[list[list[dict]], np.ndarray, np.ndarray]:
    """Relations that payloads describe, which of them each one does, and the places
    behind."""
    found, which, after, left = [], np.zeros(len(at), np.int32), at.copy(), np.arange(len(at))
    while len(left):
        if len(found) == MOST_DESCRIBED:
            raise C.Irregular("many descriptions")
        p = _Payload(payloads[left[0]])
        p.at = begin = int(at[left[0]] - ends[left[0]]) + len(p.data)
        relations = p.relations()
        text = np.frombuffer(p.data[begin : p.at], np.uint8)
        same = at[left] + len(text) <= ends[left]
        same[same] = (buffer[at[left[same]][:, None] + np.arange(len(text))] == text).all(axis=1)
        mine = left[same]
        which[mine], after[mine] = len(found), at[mine] + len(text)
        found.append(relations)
        left = left[~same]
    return found, which, after


def side_by_side(payloads: list[bytes], state: Transactions, after: int) -> pa.RecordBatch:
    """The changes of the next payloads that end after a position, as ``state.of`` and
    ``decode_changes`` read them; ``Irregular`` if these should."""
    ends = np.cumsum([len(p) for p in payloads])
    at = ends - [len(p) for p in payloads]
    buffer = np.frombuffer(b"".join(payloads), np.uint8)
    heads = C.fields(buffer, at, ends, _HEADS)
    commit, end = heads["commit"], heads["end"]
    regular = (heads["magic"] == MAGIC) & np.isin(heads["version"], READABLE) & (heads["nanos"] < 1_000_000_000) & (commit <= end) & (end < 1 << 63) & (heads["seconds"] < 1 << 43) & (heads["seconds"] > -(1 << 43))
    commit, end = commit.astype(np.int64), end.astype(np.int64)
    if not regular.all() or (np.diff(commit, prepend=state.commit) <= 0).any() or (np.diff(end, prepend=state.end) <= 0).any():
        raise C.Irregular("not transactions in order")
    relations, which, at = _described(payloads, buffer, at + _HEADS.itemsize, ends)
    counts = C.fields(buffer, at, ends, "<u4").astype(np.int64)
    at = at + 4
    if (counts * 7 > ends - at).any():
        raise C.Irregular("more changes than bytes")
    first, last = np.searchsorted(end, after, side="right"), len(end) if state.durable is None else np.searchsorted(end, state.durable, side="right")
    own = np.arange(first, max(first, last))
    steps = []  # the n-th change of each payload that has one
    for n in range(int(counts[own].max(initial=0))):
        lanes = own[counts[own] > n]
        here, stop = at[lanes], ends[lanes]
        change = C.fields(buffer, here, stop, _CHANGES)
        here = here + _CHANGES.itemsize
        options = np.zeros(len(lanes), np.uint8)
        told = np.flatnonzero((change["kind"] == CHANGE_CODES["T"]) & (heads["version"][lanes] >= 2))
        options[told] = C.fields(buffer, here[told], stop[told], "u1")
        here[told] += 1
        if not np.isin(change["kind"], list(CHANGE_KINDS)).all() or (options > 3).any():
            raise C.Irregular("an unknown change")
        sides = []
        for _ in ("old", "new"):
            mark = C.fields(buffer, here, stop, "u1")
            if (mark > 1).any():
                raise C.Irregular("bad tuple mark")
            there = mark == 1
            own_lanes = np.flatnonzero(there)
            here = here + 1
            cells = C.fields(buffer, here[own_lanes], stop[own_lanes], "<u4").astype(np.int64)
            behind, *flat = C.cells_at(buffer, here[own_lanes] + 4, stop[own_lanes], cells, _CELL_PLACES, "<u4")
            here[own_lanes] = behind
            sides.append((there, cells, *flat))
        at[lanes] = here
        steps.append((lanes, np.full(len(lanes), n), change["oid"], change["kind"], options, sides))
    if (at[own] != ends[own]).any():
        raise C.Irregular("trailing bytes")
    rows = _rows_of_steps(buffer, heads, commit, end, relations, which, steps)
    if last:
        state.commit, state.end = int(commit[last - 1]), int(end[last - 1])
    state.ended = bool(last < len(end))
    return rows


def _rows_of_steps(buffer, heads, commit, end, relations, which, steps) -> pa.RecordBatch:
    """Rows of SCHEMA, by transaction and change, of what was read step by step."""
    whole = lambda i, kind: np.concatenate([np.zeros(0, kind), *(s[i] for s in steps)]).astype(kind)
    tx, seq, oid, kind, options = (whole(i, t) for i, t in enumerate((np.int64, np.int32, np.int64, np.uint8, np.uint8)))
    order = np.lexsort((seq, tx))
    sides = []
    for i in range(2):
        there = np.concatenate([np.zeros(0, bool), *(s[5][i][0] for s in steps)])
        counts = np.zeros(len(there), np.int64)
        counts[there] = np.concatenate([np.zeros(0, np.int64), *(s[5][i][1] for s in steps)])
        flat = [np.concatenate([np.zeros(0, t), *(s[5][i][k] for s in steps)]) for k, t in ((2, np.uint8), (3, np.int64), (4, np.int64))]
        if len(steps) > 1:  # cells follow their changes
            begin, there, counts = (np.cumsum(counts) - counts)[order], there[order], counts[order]
            cell = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            flat = [f[cell] for f in flat]
        sides.append(C.cells_column(buffer, there, counts[there], *flat))
    tx, seq, oid, kind, options = (x[order] for x in (tx, seq, oid, kind, options))
    described, place = [], {}
    for n, own in enumerate(relations):
        for r in own:
            place[n, r["oid"]] = len(described)
            described.append((f"{r['namespace']}.{r['name']}", r["columns"]))
    pairs, at = np.unique(which[tx].astype(np.int64) << 32 | oid, return_inverse=True)
    try:
        places = np.array([place[p >> 32, p & 0xFFFFFFFF] for p in pairs.tolist()], np.int32)[at]
    except KeyError:
        raise C.Irregular("a change of a relation that is not described") from None
    us = heads["seconds"] * 1_000_000 + heads["nanos"] // 1000
    return change_batch(described, places, oid, commit[tx], end[tx], us[tx], seq, _CHANGE_NAMES.take(pa.array(kind)), *sides, options & 1 == 1, options & 2 == 2)


def _apart(payloads: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of small payloads, and large ones alone."""
    start = 0
    for i in [i for i, p in enumerate(payloads) if len(p) > SIDE_BY_SIDE]:
        yield payloads[start:i]
        yield payloads[i : i + 1]
        start = i + 1
    yield payloads[start:]


def segment_rows(partition: SegmentFile):
    """Arrow batches of a file's changes."""
    rows = ChangeRows()
    named = None, {}
    state = Transactions(partition.path, partition.partial, partition.durable)
    with open_segment(partition.path) as source:
        for payloads, problem in checked(source):
            for some in _apart(payloads):
                batch = None
                if len(some) >= LANES and not state.ended:
                    try:
                        batch = side_by_side(some, state, partition.after)
                    except (C.Irregular, CorruptLog, UnicodeDecodeError):
                        pass  # read one by one, it says what is wrong
                if batch is not None:
                    if len(rows):
                        yield rows.batch()
                    for at in range(0, len(batch), BATCH_CHANGES):
                        yield batch.slice(at, BATCH_CHANGES)
                elif not state.ended:
                    for head, p, count, version in state.of(some):
                        if head["end_lsn"] <= partition.after:
                            continue
                        if head["relations"] is not named[0]:
                            named = head["relations"], {r["oid"]: (f"{r['namespace']}.{r['name']}", r["columns"]) for r in head["relations"]}
                        for seq, c in enumerate(decode_changes(p, count, version)):
                            rows.add(head, *named[1][c["oid"]], seq, c)
                            if len(rows) == BATCH_CHANGES:
                                yield rows.batch()
            if problem and not state.ended:
                state.stop(problem)
            if state.ended:
                break
    if len(rows):
        yield rows.batch()


def _partitions(options: dict, after: int, upto: int | None) -> list[SegmentFile]:
    return [SegmentFile(p, partial, after, upto) for p, _, partial in needed(list_segments(options["path"]), after, upto)]


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        upto = int(self.options["durable"]) if "durable" in self.options else None
        return _partitions(self.options, int(self.options.get("after", -1)), upto)

    def read(self, partition: SegmentFile):
        return segment_rows(partition)


class SegmentStreamReader(DataSourceStreamReader):
    """Offsets are end positions: a micro-batch is what was appended since."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self):
        return {"end": int(self.options.get("after", -1))}

    def latestOffset(self):
        last = int(self.options.get("after", -1))
        for path, _, partial in reversed(list_segments(self.options["path"])):
            ends = [head["end_lsn"] for head, *_ in read_payloads(path, partial)]
            if ends:  # an empty partial file has its end in the one before
                last = max(last, ends[-1])
                break
        upto = int(self.options["durable"]) if "durable" in self.options else last
        return {"end": min(last, upto)}

    def partitions(self, start: dict, end: dict):
        return _partitions(self.options, start["end"], end["end"])

    def read(self, partition: SegmentFile):
        return segment_rows(partition)

    def commit(self, end: dict):
        pass


class SegmentSource(DataSource):
    """``spark.read.format("change_segments")``, or ``readStream``, with options
    ``path``, ``after`` (changes already applied are skipped) and ``durable``."""

    @classmethod
    def name(cls):
        return "change_segments"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return SegmentReader(dict(self.options))

    def streamReader(self, schema):
        return SegmentStreamReader(dict(self.options))


#: Changes of a file that ``write_segments`` writes, about.
CHANGES_A_FILE = 100_000
#: Values looked at for each part that a range is cut into.
LOOKED_AT = 64


def parts_for(rows: int, each: int, least: int = 1) -> int:
    """Parts of about ``each`` rows, so that their number grows with the input."""
    return max(least, -(-rows // each))


def cuts(df: DataFrame, column: str, rows: int, parts: int) -> list[int]:
    """Values of a column that cut its ``rows`` rows into about equal parts.  They
    are values that occur, and are chosen from some by their hash: what is looked at
    decides where parts end, not what is in them."""
    some = df.where(F.pmod(F.xxhash64(column), F.lit(max(1, rows // (parts * LOOKED_AT)))) == 0)
    found = sorted(tuple(r) for r in some.groupBy(column).count().collect())
    share, seen, out = sum(n for _, n in found) / parts, 0, []
    for value, n in found:
        if seen >= share * (len(out) + 1):
            out.append(value)
        seen += n
    return out


def part_of(column: str, at: list[int]):
    """The number of the part that a value is in."""
    at = np.array(at, np.int64)
    return F.pandas_udf(lambda x: type(x)(np.searchsorted(at, x.to_numpy(), side="right")).astype("int32"), "int", F.PandasUDFType.SCALAR)(column)


def _tuples(batch, column: str) -> pa.Array:
    """``_cells`` of a whole column."""
    tuples = batch.column(column)
    flat, there = tuples.flatten(), tuples.is_valid().to_numpy(zero_copy_only=False)
    counts = tuples.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    kinds, data = flat.field("kind"), flat.field("data")
    codes = pc.index_in(kinds, pa.array([CELL_KINDS[i] for i in range(len(CELL_KINDS))])).fill_null(-1).to_numpy().astype(np.int64)
    has = (codes == CELL_CODES["t"]) | (codes == CELL_CODES["b"])
    if (codes < 0).any() or (has != data.is_valid().to_numpy(zero_copy_only=False)).any():
        raise ValueError("a null or unchanged cell has no data, any other one has")
    data = data.fill_null(b"")
    sizes = pc.binary_length(data).to_numpy().astype("<u4")
    cells = C.joined(C.pieces(codes.astype(np.uint8)), C.pieces(sizes[has], has), data)
    return C.joined(C.pieces(there.astype(np.uint8)), C.pieces(counts[there].astype("<u4"), there), C.grouped(cells, np.concatenate([[0], np.cumsum(counts)])))


def _descriptions(batch, told: dict) -> np.ndarray:
    """Of every row the place in ``told`` of what describes its relation; ``told`` has
    the encoded relations by that, in order."""
    columns = batch.column("columns")
    counts = columns.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = columns.flatten()
    plain = np.zeros(len(flat), [("type", "<i8"), ("key", "u1")])
    plain["type"], plain["key"] = flat.field("type_oid").to_numpy(), flat.field("is_key").to_numpy(zero_copy_only=False)
    each = C.grouped(C.joined(C.pieces(plain), C.sized(flat.field("name"))), np.concatenate([[0], np.cumsum(counts)]))
    key = C.joined(C.pieces(batch.column("oid").to_numpy().astype("<i8")), C.sized(batch.column("relation")), each).dictionary_encode()
    codes = key.indices.to_numpy()
    _, rows = np.unique(codes, return_index=True)
    places = []
    for text, row in zip(key.dictionary.to_pylist(), rows.tolist(), strict=True):
        if text not in told:
            namespace, _, name = batch.column("relation")[row].as_py().partition(".")
            oid = batch.column("oid")[row].as_py()
            told[text] = len(told), oid, _relation({"oid": oid, "namespace": namespace, "name": name, "identity": "d", "columns": columns[row].as_py() or []})
        places.append(told[text][0])
    return np.array(places, np.int64)[codes]


def _payload_column(commit, end, us, relations: list[list[bytes]], counts, changes: pa.Array) -> pa.Array:
    """``_payload`` of many transactions."""
    heads = np.zeros(len(commit), _HEADS.descr + [("relations", "<u4")])
    heads["magic"], heads["version"], heads["commit"], heads["end"] = MAGIC, VERSION, commit, end
    heads["seconds"], heads["nanos"] = us // 1_000_000, us % 1_000_000 * 1000
    heads["relations"] = [len(r) for r in relations]
    return C.joined(C.pieces(heads), pa.array([b"".join(r) for r in relations], pa.large_binary()), C.pieces(counts.astype("<u4")), changes)


#: Bytes of rows that payloads are joined from at once, about.
JOINED = 32 << 20


def _slices(batches) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    for batch in batches:
        rows = max(1, len(batch) * JOINED // max(JOINED, batch.nbytes))
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def payloads(batches) -> Iterator[tuple[int, bytes]]:
    """(commit position, payload) of the transactions in Arrow batches of rows of
    SCHEMA, in their order; each is what ``encode`` makes of it."""
    told: dict = {}
    head, relations, count, changes = None, {}, 0, []  # of the transaction that may go on in the next batch

    def whole() -> tuple[int, bytes]:
        lone = C.grouped(pa.array(changes, pa.large_binary()), np.array([0, len(changes)]))
        text = _payload_column(*(np.array([x]) for x in head), [list(relations.values())], np.array([count]), lone)
        return int(head[0]), text[0].as_py()

    for batch in _slices(batches):
        commit, end, us = (batch.column(c).to_numpy() for c in ("commit_lsn", "end_lsn", "commit_us"))
        kind = pc.index_in(batch.column("kind"), _CHANGE_NAMES).fill_null(0).to_numpy().astype(np.uint8)
        if (kind == 0).any() or (commit < 0).any() or (end < 0).any():
            raise ValueError("an unknown kind of change, or a negative position")
        cut = np.zeros(len(batch), _CHANGES)
        cut["oid"], cut["kind"] = batch.column("oid").to_numpy(), kind
        truncates = kind == CHANGE_CODES["T"]
        cascade, restart = (batch.column(c).filter(pa.array(truncates)).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("truncate_cascade", "truncate_restart"))
        rows = C.joined(C.pieces(cut), C.pieces(cascade | restart << 1, truncates), _tuples(batch, "old"), _tuples(batch, "new"))
        places = _descriptions(batch, told)
        texts = [(oid, text) for _, oid, text in told.values()]
        starts = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        bounds = np.append(starts, len(batch))
        own = [[texts[p][1]] for p in places[starts].tolist()]
        for i in np.flatnonzero(np.minimum.reduceat(places, starts) != np.maximum.reduceat(places, starts)).tolist():
            own[i] = list(dict(texts[p] for p in places[bounds[i] : bounds[i + 1]].tolist()).values())
        counts, merged = np.diff(bounds), C.grouped(rows, bounds)
        first, last = 0, len(starts) - 1
        if head is not None and end[0] == head[1]:
            relations.update(texts[p] for p in places[: bounds[1]].tolist())
            count, first = count + int(counts[0]), 1
            changes.append(merged[0].as_py())
        if first > last:
            continue
        if head is not None:
            yield whole()
        inner = starts[first:last]
        made = _payload_column(commit[inner], end[inner], us[inner], own[first:last], counts[first:last], merged.slice(first, last - first))
        yield from zip(commit[inner].tolist(), made.to_pylist(), strict=True)
        at = starts[last]
        head, count, changes = (commit[at], end[at], us[at]), int(counts[last]), [merged[last].as_py()]
        relations = dict(texts[p] for p in places[at:].tolist())
    if head is not None:
        yield whole()


def write_segments(changes: DataFrame, folder: str, files: int, rotate_bytes: int = ROTATE_BYTES) -> DataFrame:
    """Write rows of SCHEMA as segment files, each from the task that holds its range
    of positions; a transaction's changes are in one range.  There are ``files``
    ranges, or one for each CHANGES_A_FILE if these are more.  The positions are read
    twice before: ``changes`` should be a table.  Returns ``path, transactions`` of
    the written files."""

    def run(batches):
        def file_of(first: int):
            final = f"{folder.rstrip('/')}/{first:016x}.seg"
            return final, open_file(f"{final}.writing", "wb")

        out, final, size, count, flushed, done = None, None, 0, 0, 0, []
        for commit, payload in payloads(batches):
            if out is None:
                final, out = file_of(commit)
                held, flushed = [], 0
            held.append(payload)
            size, count = size + len(payload), count + 1
            if size - flushed >= CHECKED_TOGETHER or size >= rotate_bytes:
                _flush(out, held)
                held, flushed = [], size
            if size >= rotate_bytes:
                out.close()
                publish(f"{final}.writing", final)
                done.append((final, count))
                out, size, count = None, 0, 0
        if out is not None:
            _flush(out, held)
            out.close()
            publish(f"{final}.writing", final)
            done.append((final, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "transactions"])

    rows = changes.count()
    at = cuts(changes, "end_lsn", rows, parts_for(rows, CHANGES_A_FILE, files))
    dealt = changes.repartitionById(len(at) + 1, part_of("end_lsn", at)).sortWithinPartitions("end_lsn", "seq")
    return dealt.mapInArrow(run, "path string, transactions bigint")


def _flush(out, payloads: list[bytes]) -> None:
    heads = map(_FRAME.pack, map(len, payloads), crc32c_many(payloads).tolist())
    out.write(b"".join(x for frame in zip(heads, payloads, strict=True) for x in frame))
