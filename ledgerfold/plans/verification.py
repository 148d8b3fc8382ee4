"""A verification run: sampled comparison, recheck at a fixed position, and a
second stratum of the keys that changes touched."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerfold.functions.render import key_identity
from ledgerfold.operators.diff import candidates, full_diff, keyed_digests, lookup
from ledgerfold.operators.sampling import sample_rows


@dataclass
class TableResult:
    table: str
    rows: int = 0
    coverage: float = 0.0
    converged: bool = True
    complete: bool = True
    in_flight: int = 0
    unchecked: int = 0
    deletes: int = 0
    differences: list[tuple[str, str]] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)


def recheck(read_source: Callable[[], DataFrame], read_target: Callable[[int | None], DataFrame], found: DataFrame, key: list[str],
            mark: Callable[[], int] | None = None, wait: Callable[[int], None] | None = None, rounds: int = 5, pause: float = 0.0, columns=None) -> DataFrame:
    """Disagreements that stay when the source is read again, the log position
    marked, and the target read at or after that position.  Without ``mark`` there
    is one pass, which decides."""
    for _ in range(rounds if mark else 1):
        keys = found.select("key").distinct().checkpoint()
        source = lookup(keys, keyed_digests(read_source(), key, columns), ["key"]).checkpoint()
        position = mark() if mark else None
        if wait and position is not None:
            wait(position)
        target = lookup(keys, keyed_digests(read_target(position), key, columns), ["key"])
        found = full_diff(source, target).checkpoint()
        if found.isEmpty():
            break
        time.sleep(pause)
    return found


def verify_table(name: str, source: Callable[[], DataFrame], target: Callable[[int | None], DataFrame], key: list[str] | None, reason: str = "",
                 order: str | None = None, budget: int = 100_000, windows: int = 64, estimated: int | None = None, most: int = 1000, **hooks) -> TableResult:
    """Compare a sample of windows; a table without a key is skipped, loudly."""
    out = TableResult(name)
    if not key:
        out.warnings.append(f"{name} was not compared: {reason or 'it has no key'}")
        return out
    columns = source().columns
    sample = sample_rows(source(), order or key[0], budget, windows, max(1, budget // windows)).drop("window").checkpoint()
    out.rows = sample.count()
    estimated = estimated if estimated is not None else source().count()  # from the files' footers
    out.coverage = min(out.rows / estimated, 1.0) if estimated else 1.0
    left = keyed_digests(sample, key, columns)
    right = lookup(left.select("key"), keyed_digests(target(None), key, columns), ["key"])
    found = full_diff(left, right).checkpoint()
    total = found.count()
    if total:
        first = candidates(found, most)
        out.unchecked = max(0, total - most)
        stays = recheck(source, target, first, key, columns=columns, **hooks)
        out.differences = [(r.key, r.kind) for r in stays.orderBy("key", "kind").collect()]  # at most ``most`` rows
        out.in_flight = min(total, most) - len(out.differences)
        out.converged = not out.differences and not out.unchecked
    return out


def smoothed_rate(rates: DataFrame, left: int, alpha: float = 0.3) -> DataFrame:
    """Smoothed throughput, folded in order, and the seconds that ``left`` rows take.
    ``rates``: ``n, rows, seconds``, one row a measurement of one run."""
    ordered = rates.agg(F.array_sort(F.collect_list(F.struct("n", (F.col("rows") / F.col("seconds")).alias("rate")))).alias("xs"))
    rate = F.aggregate(F.slice("xs", 2, 1 << 30), F.element_at("xs", 1)["rate"], lambda acc, x: acc + alpha * (x["rate"] - acc))
    return ordered.select(rate.alias("rate")).select(F.round("rate", 6).alias("rate"), F.round(F.lit(left) / F.col("rate"), 6).alias("eta_s"))


def verify_changes(name: str, sample: DataFrame, source: Callable[[], DataFrame], target: Callable[[int | None], DataFrame], key: list[str],
                   dropped: bool = False, recorded_key: list[str] | None = None, most: int = 1000, **hooks) -> TableResult:
    """The second stratum: the keys that sampled changes touched, compared on both
    sides.  ``sample``: ``kind`` and the key columns.  Deleted keys are looked for
    like the others (both sides must lack them) and counted; a relation that is gone
    warns; a recorded key that does not cover the verification key is skipped."""
    out = TableResult(f"{name} (changes)")
    if dropped:
        out.warnings.append(f"{name} is gone; its recorded changes were not compared")
        return out
    if recorded_key is not None and not set(key) <= set(recorded_key):
        out.warnings.append(f"{name}: recorded keys ({', '.join(recorded_key)}) do not cover the key ({', '.join(key)})")
        return out
    out.deletes = sample.where("kind = 'D'").count()
    keys = sample.select(key_identity(key).alias("key")).distinct().checkpoint()
    out.rows, out.coverage = keys.count(), 1.0
    columns = source().columns
    sides = [lookup(keys, keyed_digests(df, key, columns), ["key"]) for df in (source(), target(None))]
    found = full_diff(*sides).checkpoint()
    total = found.count()
    if total:
        stays = recheck(source, target, candidates(found, most), key, columns=columns, **hooks)
        out.unchecked = max(0, total - most)
        out.differences = [(r.key, r.kind) for r in stays.orderBy("key", "kind").collect()]  # at most ``most`` rows
        out.in_flight = min(total, most) - len(out.differences)
        out.converged = not out.differences and not out.unchecked
    return out


def timed(name: str, spark, work: Callable[[], TableResult], seconds: float) -> TableResult:
    """A table's comparison, cut short after so many seconds: then it is incomplete,
    and so not converged.  Its jobs are cancelled."""
    tag, done = f"verify-{uuid.uuid4().hex}", {}

    def run():
        spark.addTag(tag)
        try:
            done["result"] = work()
        except Exception as e:  # noqa: BLE001
            done["error"] = e
        finally:
            spark.removeTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        spark.interruptTag(tag)
        thread.join(10)
        return TableResult(name, complete=False, converged=False, warnings=[f"{name} was cut short after {seconds:g} s"])
    if "error" in done:
        raise done["error"]
    return done["result"]


def roll_up(results: list[TableResult]) -> dict:
    """Coverage of the worst table, and whether everything agreed and was finished."""
    return {
        "coverage": min((r.coverage for r in results), default=1.0), "converged": all(r.converged and r.complete for r in results),
        "complete": all(r.complete for r in results), "warnings": sorted({w for r in results for w in r.warnings}),
        "tables": {r.table: {"rows": r.rows, "differences": len(r.differences), "in_flight": r.in_flight, "unchecked": r.unchecked} for r in results}}


def exit_code(summary: dict) -> int:
    return 0 if summary["converged"] and summary["complete"] else 1


def throttle(elapsed: float, duty: float) -> float:
    """Idle seconds after ``elapsed`` seconds of work at a duty cycle."""
    return 0.0 if duty >= 1 or duty <= 0 else elapsed * (1 / duty - 1)
