"""A captured stream of replication messages, decoded in parallel.

``number`` (the order of arrival) and ``data`` (the message's bytes) are all that a
capture holds; Parquet files of them, or anything else with those columns, are the
source, in a batch or as a file stream.  The stream is cut at begin messages into
parts that grow in number with it, so transactions are dealt to tasks whole; the
messages that announce relations, of a catalogue's size, go to every task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerfold.sources import columns as C
from ledgerfold.sources.pgoutput import EPOCH_US, DecodeError, Decoder
from ledgerfold.sources.segments import BATCH_CHANGES, SCHEMA, ChangeRows, change_batch, cuts, part_of, parts_for

#: The bytes that begin a message that announces a relation, begins and ends a transaction.
RELATION, BEGIN, COMMIT = b"R", b"B", b"C"
#: Announcements that are told to every task.
MOST_RELATIONS = 1_000_000
#: Messages that a task decodes, about.
MESSAGES_A_PART = 300_000


#: Messages fewer than these are decoded one by one.
TOGETHER = 32
_CELL_PLACES = np.full(256, 255, np.uint8)
_CELL_PLACES[[ord(k) for k in C.KINDS]] = range(len(C.KINDS))
_NAMES = "IUD"
_BEGINS = np.dtype([("commit", ">u8"), ("us", ">i8")])
_COMMITS = np.dtype([("flags", "u1"), ("commit", ">u8"), ("end", ">u8"), ("us", ">i8")])
_CHANGES = np.dtype([("oid", ">u4"), ("mark", "u1")])


def side_by_side(buffer, at, ends, relations: dict[int, dict]) -> pa.RecordBatch:
    """The segment source's rows of whole transactions of inserts, updates and
    deletes, as the decoder reads them; ``Irregular`` if it should."""
    if (at == ends).any():
        raise C.Irregular("an empty message")
    first, at = buffer[at], at + 1
    begins, commits = first == ord("B"), first == ord("C")
    rows = np.flatnonzero(np.isin(first, [ord(k) for k in _NAMES]))
    inside = np.cumsum(begins) - np.cumsum(commits)
    if begins.sum() + commits.sum() + len(rows) != len(first) or (inside != ~commits).any():
        raise C.Irregular("not only transactions of rows")
    begun, done = C.fields(buffer, at[begins], ends[begins], _BEGINS), C.fields(buffer, at[commits], ends[commits], _COMMITS)
    if (begun["commit"] != done["commit"]).any() or (done["end"] < done["commit"]).any() or (done["end"] >= 1 << 63).any():
        raise C.Irregular("a commit does not fit its begin")
    commit, end, us = done["commit"].astype(np.int64), done["end"].astype(np.int64), done["us"].astype(np.int64) + EPOCH_US
    if (us < done["us"]).any():
        raise C.Irregular("a time beyond those that there are")
    tx, kind, here, stop = (np.cumsum(begins) - 1)[rows], first[rows], at[rows], ends[rows]
    change = C.fields(buffer, here, stop, _CHANGES)
    oid, mark, here = change["oid"].astype(np.int64), change["mark"], here + _CHANGES.itemsize
    before, insert, delete = np.isin(mark, [ord("K"), ord("O")]), kind == ord("I"), kind == ord("D")
    if ((insert & before) | (delete & ~before) | (~before & (mark != ord("N")))).any():
        raise C.Irregular("a change without its row")
    sides = []
    for side, there in (("old", before), ("new", ~delete)):
        if side == "new":  # behind an old row it has a mark of its own
            moved = np.flatnonzero(before & there)
            if (C.fields(buffer, here[moved], stop[moved], "u1") != ord("N")).any():
                raise C.Irregular("an update without a new row")
            here[moved] += 1
        own = np.flatnonzero(there)
        counts = C.fields(buffer, here[own], stop[own], ">u2").astype(np.int64)
        here[own], *flat = C.cells_at(buffer, here[own] + 2, stop[own], counts, _CELL_PLACES, ">i4")
        sides.append(C.cells_column(buffer, there, counts, *flat))
    known, which = np.unique(oid, return_inverse=True)
    if not all(o in relations for o in known.tolist()):
        raise C.Irregular("a change of an unknown relation")
    described = [(f"{r['namespace']}.{r['name']}", r["columns"]) for r in (relations[o] for o in known.tolist())]
    place, none = np.zeros(256, np.int32), np.zeros(len(rows), bool)
    place[[ord(k) for k in _NAMES]] = range(len(_NAMES))
    starts = np.searchsorted(tx, np.arange(len(commit)))
    return change_batch(described, which, oid, commit[tx], end[tx], us[tx], np.arange(len(rows)) - starts[tx], pa.array(list(_NAMES)).take(pa.array(place[kind])), *sides, none, none)


def captured(spark: SparkSession, path: str) -> DataFrame:
    """``number, data`` of a capture."""
    return spark.read.schema("number bigint, data binary").parquet(path)


def change_rows(messages: DataFrame, tasks: int, boundary_prefix: str | None = None) -> DataFrame:
    """The segment source's rows of the transactions in a capture, decoded by
    ``tasks`` tasks, or one for each MESSAGES_A_PART if these are more.  A message
    that the protocol does not allow where it stands fails the job.  The
    announcements before a transaction are those in force when it began.  The
    messages are read three times before they are decoded: a capture, not a
    computation."""
    spark = messages.sparkSession
    first = F.substring("data", 1, 1)
    announced = messages.where(first == F.lit(RELATION)).select("number", "data").orderBy("number").limit(MOST_RELATIONS + 1).collect()
    if len(announced) > MOST_RELATIONS:
        raise ValueError("more announcements than can be told to every task")
    relations = spark.sparkContext.broadcast([(r.number, bytes(r.data)) for r in announced])
    begins = messages.where(first == F.lit(BEGIN)).select("number")
    held = messages.agg(F.count("*").alias("messages"), F.count_if(first == F.lit(BEGIN)).alias("begins")).first()
    at = cuts(begins, "number", held.begins, parts_for(held.messages, MESSAGES_A_PART, tasks))
    last = at[-1] if at else None

    def run(batches):
        decoder, told, number = Decoder(boundary_prefix), 0, None
        rows, known = ChangeRows(), {}

        def tell(number):
            nonlocal told
            while told < len(relations.value) and relations.value[told][0] < number:
                decoder.decode(relations.value[told][1])
                told += 1

        def one_by_one(batch):
            for number, data in zip(batch.column("number").to_pylist(), batch.column("data").to_pylist(), strict=True):
                tell(number)
                tx = decoder.decode(data)
                if not tx:
                    continue
                for r in tx["relations"]:
                    if known.get(r["oid"], (None,))[0] is not r:
                        known[r["oid"]] = r, f"{r['namespace']}.{r['name']}"
                for seq, c in enumerate(tx["changes"]):
                    r, name = known[c["oid"]]
                    rows.add(tx, name, r["columns"], seq, c)
                    if len(rows) >= BATCH_CHANGES:
                        yield rows.batch()

        def together(batch):
            """Whole transactions between which nothing is announced, if it is so."""
            numbers = batch.column("number")
            tell(numbers[0].as_py())
            if told < len(relations.value) and relations.value[told][0] < numbers[-1].as_py():
                return None
            try:
                return side_by_side(*C.spans(batch.column("data")), decoder.relations)
            except C.Irregular:  # one by one, it is read or refused
                return None

        for batch in batches:
            if not len(batch):
                continue
            number = batch.column("number")[-1].as_py()
            ends = np.flatnonzero(pc.equal(pc.binary_slice(batch.column("data"), 0, 1), COMMIT).fill_null(False).to_numpy(zero_copy_only=False)) + 1
            start = 0 if decoder.current is None else int(ends[0]) if len(ends) else len(batch)
            stop = int(ends[-1]) if len(ends) else start
            yield from one_by_one(batch.slice(0, start))
            if stop - start >= TOGETHER and decoder.current is None and (done := together(batch.slice(start, stop - start))) is not None:
                if len(rows):
                    yield rows.batch()
                yield done
            else:
                yield from one_by_one(batch.slice(start, stop - start))
            yield from one_by_one(batch.slice(stop))
        if decoder.current is not None and last is not None and number < last:
            raise DecodeError("begin inside a transaction")  # the one that the next part begins with
        if len(rows):
            yield rows.batch()

    dealt = messages.select("number", "data").repartitionById(len(at) + 1, part_of("number", at)).sortWithinPartitions("number")
    return dealt.mapInArrow(run, SCHEMA)
