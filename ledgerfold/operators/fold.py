"""Replaying keyed changes onto a table: folds, presence checks, barriers.

Canonical change row: ``relation, end_lsn, seq, kind`` (I U D T), the key columns,
the value columns (of the new row), ``toast`` (array of names of value columns
that the change leaves as they are).  ``(end_lsn, seq)`` is a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

ORDER = ("end_lsn", "seq")


class DivergenceError(RuntimeError):
    """The changes do not fit the target; never retried."""


def position() -> Column:
    return F.struct(*ORDER)


def live_changes(changes: DataFrame) -> DataFrame:
    """The changes after the last truncate of their relation, and whether there was
    one (``cleared``)."""
    cuts = changes.where(F.col("kind") == "T").groupBy("relation").agg(F.max(position()).alias("cut"))
    joined = changes.where(F.col("kind") != "T").join(cuts, "relation", "left")  # a row a relation, small enough to be broadcast or not
    return joined.where(F.col("cut").isNull() | (position() > F.col("cut"))).withColumn("cleared", F.col("cut").isNotNull()).drop("cut")


def has_truncate(changes: DataFrame) -> bool:
    return not changes.where(F.col("kind") == "T").isEmpty()


def fold(target: DataFrame, changes: DataFrame, key: list[str], values: list[str], cleared: bool | None = None) -> DataFrame:
    """The target after the changes of one relation, for changes that fit.

    The fold is an aggregation with partial sums on the map side (the last kind,
    and for every value column the last row that set it), so a hot key costs one
    row a task; then one full outer join with the target on the key."""
    cleared = has_truncate(changes) if cleared is None else cleared
    log = live_changes(changes) if cleared else changes
    at = position()
    aggs = [F.max_by("kind", at).alias("last_kind")]
    for c in values:
        sets = (F.col("kind") != "D") & ~F.coalesce(F.array_contains("toast", c), F.lit(False))
        aggs.append(F.max_by(F.struct(F.col(c).alias("v")), F.when(sets, at)).alias(f"set_{c}"))
    folded = log.groupBy(*key).agg(*aggs)
    base = target.select(*key, *values).withColumn("was", F.lit(True))
    if cleared:
        base = base.where(F.lit(False))
    both = base.join(folded, key, "full_outer")
    keep = F.coalesce(F.col("last_kind") != "D", F.lit(True))
    # A wrapped value tells a column set to null from one that was never set.
    out = [F.when(F.col(f"set_{c}").isNotNull(), F.col(f"set_{c}")["v"]).otherwise(F.col(c)).alias(c) for c in values]
    return both.where(keep).select(*key, *out)


def misfits(target: DataFrame, changes: DataFrame, key: list[str], insert_checked: bool = True, cleared: bool | None = None) -> DataFrame:
    """The changes that find their key absent or present when it should not be, if
    every change before took effect."""
    cleared = has_truncate(changes) if cleared is None else cleared
    log = live_changes(changes) if cleared else changes
    base = target.select(*key).withColumn("was", F.lit(True))
    if cleared:
        base = base.where(F.lit(False))
    order = W.partitionBy("relation", *key).orderBy(*ORDER)
    before = F.lag(F.col("kind") != "D").over(order)
    present = F.coalesce(before, F.coalesce("was", F.lit(False)))
    wrong = F.when(F.col("kind") == "I", present & F.lit(insert_checked)).otherwise(~present)
    return log.join(base, key, "left").withColumn("present", present).withColumn("wrong", wrong).where("wrong")


def presence_violations(target: DataFrame, changes: DataFrame, key: list[str], insert_checked: bool = True) -> DataFrame:
    """The first change of each key that does not affect exactly one row: an insert
    of a present key, an update or delete of an absent one.

    Later ones of the key are consequences.  ``insert_checked`` is false for a
    relation without a unique key, where an insert always fits."""
    first = F.row_number().over(W.partitionBy("relation", *key).orderBy(*ORDER))
    bad = misfits(target, changes, key, insert_checked).withColumn("rn", first).where("rn = 1")
    return bad.select("relation", *key, *ORDER, "kind", "present")


def checked_fold(target: DataFrame, changes: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """The fold, or ``DivergenceError`` if any change does not fit."""
    cleared = has_truncate(changes)
    first_misfit(target, changes.select("relation", *key, *ORDER, "kind"), key, cleared)
    return fold(target, changes, key, values, cleared)


def first_misfit(target: DataFrame, changes: DataFrame, key: list[str], cleared: bool = False) -> None:
    """Raise for the first change that does not fit."""
    first = misfits(target, changes, key, cleared=cleared).orderBy(*ORDER).limit(1).collect()
    if first:
        raise DivergenceError(f"change {first[0].asDict()} does not affect exactly one row")


def check_order(changes: DataFrame) -> None:
    """Raise where the log's order is broken: a commit after its transaction's end,
    or two changes at one place.  Order is the position; nothing is ever late."""
    if "commit_lsn" in changes.columns:
        bad = changes.where(F.col("end_lsn") < F.col("commit_lsn")).limit(1).collect()
        if bad:
            raise DivergenceError(f"positions out of order: {bad[0].asDict()}")
    twice = changes.groupBy(*ORDER).agg(F.count("*").alias("changes"), F.count_if(F.col("kind") == "T").alias("truncates")).where("changes > 1 AND truncates = 0").limit(1).collect()
    if twice:
        raise DivergenceError(f"two changes at one position: {twice[0].asDict()}")


def cascaded(changes: DataFrame, references: DataFrame) -> DataFrame:
    """Truncates with ``truncate_cascade`` also for the relations that refer to the
    truncated one, directly or not.  ``references``: ``relation, referrer``, of a
    catalogue's size."""
    from ledgerfold.operators.graph import reachable

    wide = changes.where((F.col("kind") == "T") & F.col("truncate_cascade"))
    pairs = reachable(references.select(F.col("relation").alias("source"), F.col("referrer").alias("target")))
    more = wide.join(pairs.select(F.col("source").alias("relation"), F.col("target").alias("referrer")), "relation").withColumn("relation", F.col("referrer")).drop("referrer")
    return changes.unionByName(more.select(*changes.columns).distinct())


def toast_carried(target: DataFrame, changes: DataFrame, key: list[str], column: str) -> DataFrame:
    """Each change with the column's value after it, unchanged ones filled in from
    the changes before or the target."""
    order = W.partitionBy("relation", *key).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    sets = (F.col("kind") != "D") & ~F.array_contains("toast", column)
    last = F.last(F.when(sets, F.struct(F.col(column).alias("v"))), ignorenulls=True).over(order)
    base = target.select(*key, F.col(column).alias("base_value"))
    joined = changes.where(F.col("kind") != "T").join(base, key, "left").withColumn("seen", last)
    value = F.when(F.col("seen").isNotNull(), F.col("seen")["v"]).otherwise(F.col("base_value"))
    return joined.select("relation", *key, *ORDER, "kind", value.alias("carried"))


def split_key_changes(changes: DataFrame, key: list[str], old_prefix: str = "old_") -> DataFrame:
    """Updates that move a key become a delete of the old and an insert of the new
    key.  Columns left unchanged by such an update belong to the old key's row, so
    those changes need ``ordered_fold``."""
    moved = F.coalesce(F.col("kind") == "U", F.lit(False))
    differs = F.lit(False)
    for k in key:
        differs = differs | (F.col(old_prefix + k).isNotNull() & ~F.col(old_prefix + k).eqNullSafe(F.col(k)))
    moves = changes.where(moved & differs)
    rest = changes.where(~(moved & differs)).withColumn("step", F.lit(0))
    gone = moves.withColumn("kind", F.lit("D")).withColumn("step", F.lit(0))
    for k in key:
        gone = gone.withColumn(k, F.col(old_prefix + k))
    born = moves.withColumn("kind", F.lit("I")).withColumn("step", F.lit(1))
    out = rest.unionByName(gone).unionByName(born)
    return out.withColumn("seq", F.col("seq") * 2 + F.col("step")).drop("step")


def ordered_fold(target: DataFrame, changes: DataFrame, key: list[str] | str, values: list[str], old_prefix: str = "old_") -> DataFrame:
    """Replay in commit order, one group of keys that moves connect at a time.

    For relations whose changes may not be regrouped, and for key moves that leave
    columns unchanged.  Groups are the connected keys, found by smallest-label
    propagation, so one group is as large as its chain of moves, not the relation;
    a key that never moves is a group of its own.  The key before an update stands
    in ``old_<key>`` (a single one's in ``old_key``); null if it stays."""
    key = [key] if isinstance(key, str) else key
    own = F.to_json(F.array(*[F.col(k).cast("string") for k in key]))
    known = {k: old_prefix + k for k in key if old_prefix + k in changes.columns}
    if len(key) == 1 and "old_key" in changes.columns:
        known.setdefault(key[0], "old_key")
    before = F.to_json(F.array(*[(F.coalesce(F.col(known[k]), F.col(k)) if k in known else F.col(k)).cast("string") for k in key]))
    log = changes.withColumn("lf_k", own).withColumn("lf_was", F.when(F.col("kind") == "U", before).otherwise(own))
    labels = _move_groups(log) if known else None
    if labels is None:
        group = lambda df: df.withColumn("lf_g", F.col("lf_k"))
    else:
        group = lambda df: df.join(labels, "lf_k", "left").withColumn("lf_g", F.coalesce("lf_g", "lf_k"))
    columns = [*key, *values]
    schema = StructType([StructField(f.name, f.dataType) for f in target.select(*columns).schema])  # a change may set null
    left = group(target.select(own.alias("lf_k"), *columns))
    right = group(log.select("lf_k", "lf_was", "kind", "toast", *ORDER, *[F.col(c).cast(schema[c].dataType).alias(c) for c in columns]))
    # A group's rows of the target have no position and come before its changes.
    both = left.unionByName(right, allowMissingColumns=True).repartition("lf_g").sortWithinPartitions("lf_g", *ORDER)
    return both.mapInArrow(_replayer(columns), schema)


def _move_groups(log: DataFrame) -> DataFrame | None:
    """``lf_k, lf_g``: the smallest key that moves connect with each key that moves
    touch; None where nothing moves."""
    moves = log.where(F.col("lf_was") != F.col("lf_k")).select(F.col("lf_was").alias("a"), F.col("lf_k").alias("b"))
    edges = moves.union(moves.select("b", "a")).distinct().checkpoint()
    if edges.isEmpty():
        return None
    labels = edges.groupBy(F.col("a").alias("lf_k")).agg(F.least(F.col("lf_k"), F.min("b")).alias("lf_g"))
    while True:
        near = edges.join(labels.withColumnRenamed("lf_k", "b"), "b").groupBy(F.col("a").alias("lf_k")).agg(F.min("lf_g").alias("m"))
        after = labels.join(near, "lf_k").select("lf_k", F.least("lf_g", "m").alias("lf_g"), (F.col("m") < F.col("lf_g")).alias("moved")).checkpoint()
        labels = after.select("lf_k", "lf_g")
        if after.where("moved").isEmpty():
            return labels


def _replayer(columns: list[str]):
    """Replays Arrow batches of many groups one after the other.

    Only keys and kinds become Python objects: a row of the state is the place, or
    the place of each column, of the input row that it was set by.  What is held is a
    batch and the state of the group at hand."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table, group, rows = None, None, {}

        def taken(places) -> pa.Table:
            if not any(isinstance(x, tuple) for x in places):
                return table.take(pa.array(places, pa.int64()))
            each = zip(*[x if isinstance(x, tuple) else (x,) * len(columns) for x in places], strict=True)
            return pa.table([c.take(pa.array(at, pa.int64())) for c, at in zip(table.columns, each, strict=True)], names=columns)

        for batch in batches:
            kept = taken(list(rows.values())) if rows else None
            rows = {k: i for i, k in enumerate(rows)}
            before = len(rows)
            table = pa.Table.from_batches([batch]).select(columns)
            if kept is not None:
                table = pa.concat_tables([kept.cast(table.schema), table]).combine_chunks()
            text = lambda c: batch.column(c).to_numpy(zero_copy_only=False).tolist()  # noqa: E731, B023
            toast = batch.column("toast")
            ends = np.cumsum(toast.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            unchanged, start, done = toast.flatten().to_pylist(), 0, []
            for i, (g, k, was, kind, end) in enumerate(zip(text("lf_g"), text("lf_k"), text("lf_was"), text("kind"), ends, strict=True), before):
                if g != group:
                    done.extend(rows.values())
                    group, rows = g, {}
                left_alone, start = unchanged[start:end], end
                if kind is None:
                    rows[k] = i
                    continue
                at = lambda: "/".join(str(batch.column(c)[i - before].as_py()) for c in ORDER)  # noqa: E731, B023
                if (was in rows) == (kind == "I"):
                    raise DivergenceError(f"change at {at()} does not affect exactly one row")
                old = rows.pop(was, None)
                if kind != "D":
                    if k in rows:
                        raise DivergenceError(f"change at {at()} moves to a key that is taken")
                    if left_alone and old is not None:
                        old = old if isinstance(old, tuple) else (old,) * len(columns)
                        rows[k] = tuple(o if c in left_alone else i for c, o in zip(columns, old, strict=True))
                    else:
                        rows[k] = i
            if done:
                yield from taken(done).combine_chunks().to_batches()
        if rows:
            yield from taken(list(rows.values())).combine_chunks().to_batches()

    return run


def full_identity(target: DataFrame, changes: DataFrame, digest: str = "digest") -> tuple[DataFrame, DataFrame]:
    """(multiplicities after the changes, violations) for rows known only as a whole.

    ``target``: one row a table row; ``changes``: kind I or D (an update is both).
    A delete must find exactly one equal row."""
    base = target.groupBy(digest).agg(F.count("*").alias("copies"))
    step = F.when(F.col("kind") == "I", 1).otherwise(-1)
    moved = changes.groupBy(digest).agg(F.sum(step).alias("change"))
    after = base.join(moved, digest, "full_outer").select(digest, (F.coalesce("copies", F.lit(0)) + F.coalesce("change", F.lit(0))).alias("copies"))
    before = W.partitionBy(digest).orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    running = changes.withColumn("moved", F.coalesce(F.sum(step).over(before), F.lit(0))).join(base, digest, "left")
    found = F.coalesce("copies", F.lit(0)) + F.col("moved")
    bad = running.withColumn("found", found).where((F.col("kind") == "D") & (F.col("found") != 1))
    return after.where("copies > 0"), bad.select(digest, *ORDER, "found")


# --- order, batches, barriers ----------------------------------------------------


BAND = 4096
#: Bands of a log at most; one row a band is ordered as a whole, in one task.
MOST_BANDS = 100_000


def banded(df: DataFrame, position: str) -> DataFrame:
    """``band``: ranges of positions of equal width, at most MOST_BANDS and one of
    them, so that sums over bands stay small however long the log is, and a band's
    own rows are what one task sorts."""
    low, high = df.agg(F.min(position), F.max(position)).first()
    width = max(BAND, (int(high) - int(low)) // MOST_BANDS + 1) if low is not None else BAND
    return df.withColumn("band", F.floor(F.col(position) / width))


def order_violations(transactions: DataFrame) -> DataFrame:
    """Transactions that break the log's order: both positions must grow, and the
    end must not precede the commit.  ``transactions``: ``number, commit_lsn,
    end_lsn``; broken order is corruption, not lateness.

    The previous row comes from the same band of numbers, or for a band's first
    row from the last of the bands before."""
    within = banded(transactions, "number")
    last = within.groupBy("band").agg(F.max_by(F.struct("commit_lsn", "end_lsn"), "number").alias("last"))
    earlier = last.select("band", F.lag("last").over(W.orderBy("band")).alias("earlier"))
    own = F.lag(F.struct("commit_lsn", "end_lsn")).over(W.partitionBy("band").orderBy("number"))
    out = within.withColumn("own", own).join(earlier, "band").withColumn("prev", F.coalesce("own", "earlier"))
    bad = (F.col("commit_lsn") <= F.col("prev.commit_lsn")) | (F.col("end_lsn") <= F.col("prev.end_lsn")) | (F.col("end_lsn") < F.col("commit_lsn"))
    return out.where(bad).drop("band", "own", "earlier", "prev")


def barrier_epochs(changes: DataFrame, unsafe: Column) -> DataFrame:
    """``epoch``: grows at each ordered barrier (a change of an unsafe relation, or
    a truncate); inside one, relations are independent.

    The running count is built from per-band counts, so it needs no global sort."""
    barrier = (unsafe | (F.col("kind") == "T")).cast("bigint")
    tagged = banded(changes.withColumn("barrier", barrier), "end_lsn")
    sums = tagged.groupBy("band").agg(F.sum("barrier").alias("n"))
    base = sums.withColumn("base", F.coalesce(F.sum("n").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inner = F.sum("barrier").over(W.partitionBy("band").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0))
    return tagged.withColumn("inner", inner).join(base, "band").withColumn("epoch", F.col("base") + F.col("inner")).drop("band", "base", "inner", "barrier")


def runs(changes: DataFrame, by: list[str]) -> DataFrame:
    """Runs of adjacent changes of one kind in each partition: gaps and islands.

    Neighbours are found inside a band; a band's first row is compared with the last
    of the partition's bands before, so that a relation with most of the log is
    spread over as many tasks as it has bands."""
    tagged = banded(changes, "end_lsn")
    inside, over_bands = W.partitionBy(*by, "band").orderBy(*ORDER), W.partitionBy(*by).orderBy("band")
    last = tagged.groupBy(*by, "band").agg(F.max_by("kind", position()).alias("last"))
    last = last.withColumn("earlier", F.lag("last").over(over_bands)).drop("last")
    before = F.coalesce(F.lag("kind").over(inside), F.col("earlier"))
    marked = tagged.join(last, [*by, "band"]).withColumn("starts", F.when(before == F.col("kind"), 0).otherwise(1))
    sums = marked.groupBy(*by, "band").agg(F.sum("starts").alias("n"))
    base = sums.select(*by, "band", F.coalesce(F.sum("n").over(over_bands.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inner = F.sum("starts").over(inside.rowsBetween(W.unboundedPreceding, 0))
    numbered = marked.withColumn("inner", inner).join(base, [*by, "band"]).withColumn("run", F.col("base") + F.col("inner"))
    return numbered.groupBy(*by, "run", "kind").agg(F.count("*").alias("n"), F.min("end_lsn").alias("first_lsn"), F.max("end_lsn").alias("last_lsn"))


def batch_ids(transactions: DataFrame, most: int) -> DataFrame:
    """Batches of a fixed number of transactions in log order: ranks from counts
    of bands of positions and a window inside a band."""
    within = banded(transactions, "end_lsn")
    counts = within.groupBy("band").agg(F.count("*").alias("n"))
    base = counts.select("band", F.coalesce(F.sum("n").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(W.partitionBy("band").orderBy("end_lsn")) - 1
    ranked = within.withColumn("rank", rank).join(base, "band")
    return ranked.withColumn("batch", F.floor((F.col("base") + F.col("rank")) / most).cast("bigint")).drop("band", "base", "rank")


def greedy_batches(sizes, most_txns: int = 16384, most_changes: int = 131072, most_bytes: int = 32 << 20, alone: int = 256):
    """Greedy batches of (changes, bytes) transactions, in order, as lists of
    indexes; a transaction of more than ``alone`` changes is a batch of its own."""
    batch, changes, size = [], 0, 0
    for i, (n, b) in enumerate(sizes):
        if n > alone:
            if batch:
                yield batch
            yield [i]
            batch, changes, size = [], 0, 0
            continue
        if batch and (len(batch) + 1 > most_txns or changes + n > most_changes or size + b > most_bytes):
            yield batch
            batch, changes, size = [], 0, 0
        batch.append(i)
        changes, size = changes + n, size + b
    if batch:
        yield batch


def gated(changes: DataFrame, applied: int, end: int | None, durable: int) -> DataFrame:
    """Changes not yet applied, up to the end position (inclusive), and durable."""
    out = changes.where((F.col("end_lsn") > applied) & (F.col("end_lsn") <= durable))
    return out if end is None else out.where(F.col("end_lsn") <= end)


def end_boundary(transactions: DataFrame, requested: int) -> DataFrame:
    """The newest transaction boundary not after the requested end, and whether it
    is that position exactly."""
    found = transactions.where(F.col("end_lsn") <= requested).agg(F.max("end_lsn").alias("boundary"))
    return found.withColumn("exact", F.coalesce(F.col("boundary") == requested, F.lit(False)))
