"""Operator 6: mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their identifiers, are laid end to
end and cut into blocks of whole documents: a document belongs to the block in which
it starts, and a block is as long as its documents are, about ``total / blocks``
characters, more where documents are longer.  With weight ``a / parts`` a source's
block from character ``x`` (of this source) to ``y`` is released at the clock
``floor(x * parts / a)`` and due by ``ceil(y * parts / a)``; the clock counts the
characters of the mix.  Whenever a block ends, the released block with the earliest
deadline goes next.  So at the end of every block every source has had its share of
the clock to within less than the largest block.

There are at most ``blocks`` blocks and one more a source; only their sizes come to
the driver, which schedules them.  Every document finds its slot, the place of its
block in the mix, by a join on the block's number.

A source that runs out leaves its later time empty: the clock moves on to the next
release.  The mix goes on while the sources that have run out are due ``MISSING`` of
it together at most, so that small sources are in it whole and don't end it, and
ends at the clock where more is missing: up to there the proportions hold within
that share, the documents beyond are not in this mix (``kept`` is false, ``slot`` is
null).

Positions come from sums over 4096 hash ranges of each source and a window inside a
range, so that a source with a third of all rows is spread over as many tasks.

Without given weights the target is the sources' sizes to the power ``alpha``,
which lowers the weight of a dominant source.  With given weights, the sources
without one are the stream ``(rest)`` if that has a weight, else not in the mix.
Every other source is a stream of its own; more than ``max_streams`` of them are
refused (``ValueError``), as the schedule is made on the driver.

Defined results: a null source is the empty name, a null text counts one
character, as an empty one does; a very long text is one block of its own size;
rows that repeat an identifier in a source start together, where the first of them
does; a null ``doc_id`` is ordered as the empty text; equal deadlines go by the
streams' names; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerfold.llm.common import cut, discard, table, text_of

BLOCKS = 65_536
#: Weights are whole numbers of so many parts.
PARTS = 1 << 20
ALPHA = 0.75
MAX_STREAMS = 65_536
#: Share of the targets up to which sources may run out before the mix ends.
MISSING = 0.02
#: Hexadecimal digits of the hash that name a range: 16 ** 3 ranges a stream.
RANGE_DIGITS = 3
REST = "(rest)"


def whole_weights(targets: dict[str, float], parts: int) -> dict[str, int]:
    """Parts of each stream, at least one, by largest remainders; they sum to
    ``parts``."""
    total = sum(targets.values())
    share = {k: v / total * parts for k, v in targets.items()}
    out = {k: max(1, int(v)) for k, v in share.items()}
    order = sorted(targets, key=lambda k: (int(share[k]) - share[k], k))
    for i in range(parts - sum(out.values())):
        out[order[i % len(order)]] += 1
    over = sum(out.values()) - parts
    for k in sorted(out, key=lambda k: (-out[k], k)):  # the least weights took more than their share
        if over <= 0:
            break
        gives = min(over, out[k] // 2)
        out[k], over = out[k] - gives, over - gives
    return out


def horizon(weights: dict[str, int], sizes: dict[str, int], targets: dict[str, float]) -> int:
    """The clock at which a stream is due more than it has, after the streams that
    run out earlier and have at most MISSING of the targets together."""
    parts = sum(weights.values())
    left = MISSING * sum(targets.values())
    for end, k in sorted((-(-sizes[k] * parts // a), k) for k, a in weights.items()):
        left -= targets[k]
        if left < 0:
            return end
    raise AssertionError("all streams ran out")


def schedule(weights: dict[str, int], blocks: dict[str, list[int]], end: int | None = None) -> list[tuple[str, int, int]]:
    """(stream, index of its block, clock at its start) in the order of the mix, by
    earliest deadline first among released blocks, up to the clock ``end`` and the
    blocks due by then.

    ``blocks`` are the sizes of each stream's blocks in its order."""
    parts = sum(weights.values())
    # Release, deadline, stream, index, and where the block ends in its stream.
    window = lambda k, i, at: (at * parts // weights[k], -(-(at + blocks[k][i]) * parts // weights[k]), k, i, at + blocks[k][i])
    coming = [window(k, 0, 0) for k in sorted(weights) if blocks.get(k)]
    heapq.heapify(coming)
    ready: list[tuple[int, str, int, int]] = []
    out, clock = [], 0
    while ready or coming:
        while coming and coming[0][0] <= clock:
            heapq.heappush(ready, heapq.heappop(coming)[1:])
        if end is not None and clock >= end and (not ready or ready[0][0] > end):
            break
        if not ready:
            clock = coming[0][0]
            continue
        _, k, i, upto = heapq.heappop(ready)
        out.append((k, i, clock))
        clock += blocks[k][i]
        if i + 1 < len(blocks[k]):
            heapq.heappush(coming, window(k, i + 1, upto))
    return out


def mix(docs: DataFrame, weights: dict[str, float] | None = None, id_column: str = "doc_id", source_column: str = "source",
        text_column: str = "text", alpha: float = ALPHA, blocks: int = BLOCKS, max_streams: int = MAX_STREAMS,
        read: list[str] | None = None) -> DataFrame:
    """``id, source, stream, key, size, block, slot, kept`` of every row.  ``read``:
    gets the path of the table that the result reads."""
    spark, scratch = docs.sparkSession, []
    rows = docs.select(
        F.col(id_column).alias("id"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"),
        F.greatest(F.length(text_of(text_column)), F.lit(1)).cast("bigint").alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("key"))
    stream = F.col("source")
    if weights is not None:
        own = sorted(set(weights) - {REST})
        if len(own) > max_streams:
            raise ValueError(f"{len(own)} sources have weights, at most {max_streams} can be scheduled")
        named = spark.createDataFrame([(k, k) for k in own] or [("", REST)], "source string, stream string")
        rows = rows.join(F.broadcast(named), "source", "left")  # at most max_streams names
        stream = F.coalesce("stream", F.lit(REST))
    rows = cut(rows.withColumn("stream", stream), "mix-rows", scratch)  # the texts are read once, for their lengths
    ranged = rows.withColumn("range", F.substring("key", 1, RANGE_DIGITS))
    ranges = cut(ranged.groupBy("stream", "range").agg(F.sum("size").alias("size")), "mix-ranges", scratch)
    found = ranges.groupBy("stream").agg(F.sum("size").alias("size")).limit(max_streams + 2).collect()
    if len(found) > max_streams + 1:
        raise ValueError(f"more than {max_streams} sources: give weights to some and to {REST}")
    sizes = {r.stream: r.size for r in found}
    targets = {k: weights.get(k, 0.0) if weights is not None else float(v) ** alpha for k, v in sizes.items()}
    targets = {k: v for k, v in targets.items() if v > 0}
    if sizes and not targets:
        raise ValueError("no source of the table has a positive weight")
    block = max(1, -(-sum(sizes.values()) // blocks))

    before = W.partitionBy("stream").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # at most 16 ** 3 rows a stream
    starts = ranges.select("stream", "range", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("stream", "range").orderBy("key", "ident", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = (
        ranged.withColumn("ident", F.coalesce(F.col("id").cast("string"), F.lit("")))
        .withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .withColumn("inner", F.min("inner").over(W.partitionBy("stream", "range", "key", "ident")))
        .join(starts, ["stream", "range"])
        .select("id", "source", "stream", "key", "size", F.floor((F.col("base") + F.col("inner")) / block).cast("bigint").alias("block"))
    )
    placed = cut(placed, "mix-placed", read)
    discard(spark, scratch)
    if not sizes:
        return placed.selectExpr("*", "cast(null as bigint) as slot", "false as kept")
    # A row a block, of which there are ``blocks`` and one a stream at most.
    sums = placed.where(F.col("stream").isin(*targets)) if len(targets) < len(sizes) else placed
    by_block = sums.groupBy("stream", "block").agg(F.sum("size").alias("size")).collect()
    numbers: dict[str, list[tuple[int, int]]] = {}
    for r in sorted(by_block):
        numbers.setdefault(r.stream, []).append((r.block, r["size"]))
    shares = whole_weights(targets, max(PARTS, 2 * len(targets)))
    order = schedule(shares, {k: [n for _, n in v] for k, v in numbers.items()}, horizon(shares, sizes, targets))
    plan = spark.createDataFrame([(k, numbers[k][i][0], t) for t, (k, i, _) in enumerate(order)], "stream string, block bigint, slot bigint")
    return placed.join(F.broadcast(plan), ["stream", "block"], "left").select(
        "id", "source", "stream", "key", "size", "block", "slot", F.col("slot").isNotNull().alias("kept"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, with their columns.  The kept documents of a
    stream are a prefix of its hash order, so one bound for each stream is enough
    and the texts are not shuffled."""
    spark = docs.sparkSession
    read: list[str] = []
    placed = mix(docs, read=read, **options)
    ident = F.coalesce(F.col("id").cast("string"), F.lit(""))
    # At most max_streams + 1 rows; the names of streams of their own are the sources'.
    bounds = placed.where("kept").groupBy("stream").agg(F.max(F.struct(F.col("key"), ident.alias("id"))).alias("last"))
    last = {r.stream: (r.last.key, r.last.id) for r in bounds.collect()}
    discard(spark, read)
    if not last:
        return docs.where(F.lit(False))
    id_column, source_column, weights = options.get("id_column", "doc_id"), options.get("source_column", "source"), options.get("weights")
    stream, key, name = (f"lf_{x}_{uuid.uuid4().hex}" for x in ("stream", "key", "id"))  # no column of the input
    limits = spark.createDataFrame([(k, *v) for k, v in last.items()], f"{stream} string, {key} string, {name} string")
    key_id = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    source = F.coalesce(F.col(source_column).cast("string"), F.lit(""))
    if weights is not None:
        source = F.when(source.isin(*(set(weights) - {REST})), source).otherwise(F.lit(REST))
    kept = docs.withColumn(stream, source).join(F.broadcast(limits), stream)
    return kept.where(F.struct(F.md5(key_id), key_id) <= F.struct(F.col(key), F.col(name))).select(*[docs[c] for c in docs.columns])


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's block and slot in the mix."""
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "source", "stream", "block", "slot", "kept")


QUERIES = {"op6_source_mixing": op6_source_mixing}
ORACLE: dict[str, str] = {}
