"""Sampled verification: budgets, windows, sample scans, coverage, reservoirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADROOM = 2.0


def leaf_budgets(heaps: DataFrame, budget: int) -> DataFrame:
    """The row budget of each heap of a table, by its pages."""
    pages = F.greatest("pages", F.lit(1))
    total = F.sum(pages).over(W.partitionBy("table_name"))
    return heaps.withColumn("budget", F.greatest(F.expr(f"({budget}L * greatest(pages, 1L))") / total, F.lit(1)).cast("bigint"))


def sample_windows(budgets: DataFrame, windows: int) -> DataFrame:
    """``start, stop, row_limit`` page windows of each heap: the whole heap where it
    is small, unknown or would be covered anyway; else windows on an even stride,
    the last at the end.  A null ``stop`` means to the end as of reading."""
    limit = F.greatest(F.expr(f"budget div {windows}"), F.lit(1))
    density = F.col("est_rows") / F.nullif(F.col("pages"), F.lit(0).cast("bigint"))
    sized = (
        budgets.withColumn("per_window", limit).withColumn("stride", F.expr(f"pages div {windows}"))
        .withColumn("window_pages", F.greatest(F.ceil(F.lit(HEADROOM) * F.col("per_window") / F.nullif(density, F.lit(0.0))), F.lit(1)))
    )
    whole = (
        (F.col("budget") <= 0) | (F.col("pages") <= 0) | (F.col("est_rows") <= 0) | (F.col("est_rows") <= F.col("budget"))
        | (F.col("stride") <= F.col("window_pages")))
    each = sized.withColumn("whole", F.coalesce(whole, F.lit(True))).withColumn(
        "w", F.explode(F.when(F.col("whole"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.lit(windows - 1)))))
    last = F.col("w") == windows - 1
    start = F.when(F.col("whole"), 0).when(last, F.greatest(F.col("pages") - F.col("window_pages"), F.lit(0))).otherwise(F.col("w") * F.col("stride"))
    stop = F.when(F.col("whole") | last, None).otherwise(F.col("w") * F.col("stride") + F.col("window_pages"))
    return each.select(
        "table_name", "leaf", F.col("w").cast("bigint").alias("window"), start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"),
        F.when(F.col("whole"), F.col("budget")).otherwise(F.col("per_window")).cast("bigint").alias("row_limit"))


def sample_rows(df: DataFrame, order: str, rows: int, windows: int, per_window: int) -> DataFrame:
    """The first ``per_window`` rows by ``order`` of each of ``windows`` equal
    ranges of the key: a sample that anyone can repeat.

    Only the beginnings of the windows are read: ranges that should hold HEADROOM
    times the rows at the table's mean density, as predicates on the key that reach
    the scan.  Windows that turn out sparser are read again in ranges four times
    as long until they have their rows or end."""
    most = min(per_window, rows)
    low, high, total = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    window = lambda w: F.lit(w).cast("bigint").alias("window")
    if low is None:
        return df.select("*", window(0)).where(F.lit(False))
    width = max(1, -(-(high - low + 1) // windows))
    reach = min(width, max(1, int(HEADROOM * most * (high - low + 1) / total) + 1))
    starts = {w: low + w * width for w in range(windows) if low + w * width <= high}
    number = F.floor((F.col(order) - F.lit(low)) / width).cast("bigint")

    def inside(of, upto: int):
        out = F.lit(False)
        for w in of:
            out = out | ((F.col(order) >= starts[w]) & (F.col(order) < starts[w] + min(upto, width)))
        return out

    rank = F.row_number().over(W.partitionBy("window").orderBy(order))
    first = lambda d: d.withColumn("window", number).withColumn("rn", rank).where(F.col("rn") <= most).drop("rn")
    out, open_ = None, list(starts)
    while open_ and reach < width:
        read = first(df.where(inside(open_, reach))).persist()  # some HEADROOM times the sample at most
        full = {r.window for r in read.groupBy("window").agg(F.count("*").alias("n")).collect() if r.n >= most}  # a row a window
        if full:
            done = read.where(F.col("window").isin(*full))
            out = done if out is None else out.unionByName(done)
        open_, reach = [w for w in open_ if w not in full], reach * 4
    if open_:
        rest = first(df.where(inside(open_, width)))
        out = rest if out is None else out.unionByName(rest)
    return out


def coverage(rows: Column, estimated: Column) -> Column:
    return F.when(estimated <= 0, 1.0).otherwise(F.least(rows / estimated, F.lit(1.0)))


def run_coverage(tables: DataFrame) -> DataFrame:
    """The run is covered as well as its worst table."""
    return tables.agg(F.min("coverage").alias("coverage"), F.bool_and("converged").alias("converged"), F.bool_and("complete").alias("complete"))


def sample_keys(changes: DataFrame, key: list[str]) -> DataFrame:
    """The key each committed change touched: the new one of an insert or update,
    the old one of a delete; truncates and unchanged keys give none."""
    return changes.where((F.col("kind") != "T") & ~F.arrays_overlap(F.coalesce("toast", F.array().cast("array<string>")), F.array(*map(F.lit, key)))).select(
        "relation", "end_lsn", "seq", "kind", *key)


def reservoir(changes: DataFrame, cap: int, salt: str = "") -> DataFrame:
    """A uniform sample of at most ``cap`` changes of each relation: those with the
    smallest hashes of their positions.  The same rows whatever the partitioning,
    and samples of parts merge into the sample of the whole.

    The cap is the feature.  A bound on the hash from the relation's count leaves
    ``cap`` rows and eight standard deviations more to be ranked; a relation that it
    should leave too few of is ranked whole."""
    tagged = changes.withColumn("h", F.md5(F.concat_ws("/", F.lit(salt), "end_lsn", "seq")))
    share = F.lit(cap + 8 * cap**0.5 + 16) / F.col("n")
    bound = F.when(share >= 1, F.lit(1 << 60)).otherwise((share * (1 << 60)).cast("bigint"))
    place = F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint")
    bounds = changes.groupBy("relation").agg(F.count("*").alias("n")).withColumn("bound", bound)
    kept = tagged.join(bounds, "relation").withColumn("low", place < F.col("bound"))
    few = kept.groupBy("relation").agg(F.count_if("low").alias("held"), F.any_value("n").alias("n")).where(F.col("held") < F.least(F.col("n"), F.lit(cap)))
    few = [r.relation for r in few.select("relation").collect()]  # as good as never any
    kept = kept.where(F.col("low") | F.col("relation").isin(few)) if few else kept.where("low")
    ranked = kept.drop("n", "bound", "low").withColumn("slot", F.row_number().over(W.partitionBy("relation").orderBy("h")))
    return ranked.where(F.col("slot") <= cap)


def merge_reservoirs(stored: DataFrame, fresh: DataFrame, cap: int) -> DataFrame:
    """The sample of everything seen, from the sample so far and that of new changes
    (``relation, h`` and the changes' columns)."""
    both = stored.drop("slot").unionByName(fresh.drop("slot"), allowMissingColumns=True)
    return both.withColumn("slot", F.row_number().over(W.partitionBy("relation").orderBy("h"))).where(F.col("slot") <= cap)


def upsert_slots(batches: DataFrame) -> DataFrame:
    """The last key written to each slot; ``batch`` orders the writes."""
    return batches.groupBy("relation", "slot").agg(F.max_by("k", "batch").alias("k"))


def reservoir_counters(changes: DataFrame, cap: int) -> DataFrame:
    n = F.count("*")
    return changes.where(F.col("kind") != "T").groupBy("relation").agg(
        n.alias("observed"), F.least(n, F.lit(cap)).alias("retained"), F.count_if(F.col("kind") == "D").alias("deletes"))


def key_budget(samples: DataFrame, budget: int) -> DataFrame:
    """The first keys over all leaves, in leaf and slot order."""
    return samples.orderBy("leaf", "slot").limit(budget)


def total_pages(heaps: DataFrame) -> DataFrame:
    """``table_name, pages, est_rows`` over a table's leaves; an empty leaf is one page."""
    return heaps.groupBy("table_name").agg(F.sum(F.greatest("pages", F.lit(1))).alias("pages"), F.sum("est_rows").alias("est_rows"))


def heaps_read(windows: DataFrame) -> DataFrame:
    """``table_name, heaps``: how many heaps a table's sample windows read."""
    return windows.groupBy("table_name").agg(F.countDistinct("leaf").alias("heaps"))
