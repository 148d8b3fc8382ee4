"""Operators of the engine against sequential replay and hand-made cases."""

import random

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerfold.functions import catalog, render
from ledgerfold.operators import diff, fold, parts, sampling

CHANGE = "relation string, end_lsn bigint, seq int, kind string, k bigint, v string, w string, toast array<string>"


def replay(base, log):
    """One row at a time, in order; the first change that does not fit, or None."""
    rows = {k: {"v": v, "w": w} for k, v, w in base}
    for _, lsn, seq, kind, k, v, w, toast in sorted(log, key=lambda c: (c[1], c[2])):
        if kind == "T":
            rows.clear()
        elif (k in rows) == (kind == "I"):
            return rows, (lsn, seq, k)
        elif kind == "D":
            del rows[k]
        else:
            old = rows.get(k, {})
            rows[k] = {c: old.get(c) if c in toast else x for c, x in (("v", v), ("w", w))}
    return rows, None


def make_log(seed, n, truncates=True, faults=False):
    rng, present, log = random.Random(seed), {1, 2, 3}, []
    for i in range(n):
        k = rng.randrange(6)
        if truncates and rng.random() < 0.05:
            log.append(("r", i, 0, "T", None, None, None, []))
            present = set()
            continue
        kind = rng.choice("UD") if k in present else "I"
        if faults and rng.random() < 0.15:
            kind = rng.choice("IUD")
        present = present - {k} if kind == "D" else present | {k}
        toast = rng.sample(["v", "w"], rng.randrange(3)) if kind == "U" else []
        log.append(("r", i, 0, kind, k, rng.choice([None, "", f"v{i}"]), rng.choice([None, f"w{i}"]), toast))
    return log


BASE = [(1, "a", "A"), (2, "", None), (3, None, "C")]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6), st.integers(0, 40))
def test_fold_equals_replay(spark, seed, n):
    log = make_log(seed, n)
    want, bad = replay(BASE, log)
    assert bad is None
    target = spark.createDataFrame(BASE, "k bigint, v string, w string")
    got = fold.checked_fold(target, spark.createDataFrame(log, CHANGE), ["k"], ["v", "w"]).collect()
    assert {r.k: {"v": r.v, "w": r.w} for r in got} == want and len(got) == len(want)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(0, 10**6))
def test_first_violation_equals_replay(spark, seed):
    log = make_log(seed, 30, truncates=False, faults=True)
    _, bad = replay(BASE, log)
    target = spark.createDataFrame(BASE, "k bigint, v string, w string")
    changes = spark.createDataFrame(log, CHANGE)
    found = fold.presence_violations(target, changes, ["k"]).orderBy("end_lsn").collect()
    assert (found[0].end_lsn, found[0].seq, found[0].k) == bad if bad else not found
    if bad:
        with pytest.raises(fold.DivergenceError):
            fold.checked_fold(target, changes, ["k"], ["v", "w"])


def test_key_change_with_unchanged_columns(spark):
    base = spark.createDataFrame([(1, "long", "A"), (2, "b", "B"), (9, "z", "Z")], "k bigint, v string, w string")
    rows = [("r", 1, 0, "U", 5, None, "moved", ["v"], 1), ("r", 2, 0, "U", 6, None, "again", ["v"], 5), ("r", 3, 0, "D", 2, None, None, [], None), ("r", 4, 0, "I", 2, "new", "N", [], None)]
    log = spark.createDataFrame(rows, CHANGE + ", old_key bigint")
    got = {(r.k, r.v, r.w) for r in fold.ordered_fold(base, log, "k", ["v", "w"]).collect()}
    assert got == {(6, "long", "again"), (2, "new", "N"), (9, "z", "Z")}
    plain = log.where("end_lsn < 3").withColumn("toast", F.array().cast("array<string>")).withColumn("v", F.lit("x")).withColumnRenamed("old_key", "old_k")
    split = fold.split_key_changes(plain, ["k"])
    assert {(r.kind, r.k) for r in split.collect()} == {("D", 1), ("I", 5), ("D", 5), ("I", 6)}
    assert {r.k for r in fold.checked_fold(base, split, ["k"], ["v", "w"]).collect()} == {6, 2, 9}


def test_ordered_fold_replays_many_groups_in_one_call(spark):
    """No call and no pair of Pandas frames a key; groups over the borders of batches;
    large and absent integers as they are."""
    big = 2**60 + 1
    base = spark.range(300).select(F.col("id").alias("k"), (F.col("id") + big).alias("v"), F.lit("w").alias("w"))
    rows = [("r", 10 * i + t, 0, kind, k, v, f"{i}/{t}", toast, was) for i in range(300) for t, (kind, k, v, toast, was) in enumerate([
        ("U", i, None, ["v"], None), ("U", i + 1000, None, ["v"] if i % 2 else [], i), ("D", i + 1000, None, [], None), ("I", i, big + 7 if i % 3 else None, [], None), ("U", i + 2000, None, ["v"], i)])]
    log = spark.createDataFrame(rows, CHANGE.replace("v string", "v bigint") + ", old_k bigint")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = fold.ordered_fold(base, log, ["k"], ["v", "w"])
        assert {tuple(r) for r in out.collect()} == {(i + 2000, big + 7 if i % 3 else None, f"{i}/4") for i in range(300)}
        half = fold.ordered_fold(base, log.where("end_lsn % 10 < 2"), ["k"], ["v", "w"])
        assert {tuple(r) for r in half.collect()} == {(i + 1000, i + big if i % 2 else None, f"{i}/1") for i in range(300)}
        with pytest.raises(Exception, match="change at 2992/0 does not affect exactly one row"):
            fold.ordered_fold(base, log.where("end_lsn <> 2991"), ["k"], ["v", "w"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert "CoGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_full_identity_finds_missing_and_double_rows(spark):
    base = spark.createDataFrame([("a",), ("a",), ("b",)], "digest string")
    log = spark.createDataFrame([("a", 1, 0, "D"), ("b", 2, 0, "D"), ("b", 3, 0, "D"), ("c", 4, 0, "I")], "digest string, end_lsn bigint, seq int, kind string")
    after, bad = fold.full_identity(base, log)
    assert {(r.digest, r.found) for r in bad.collect()} == {("a", 2), ("b", 0)}
    assert {(r.digest, r.copies) for r in after.where("digest = 'c'").collect()} == {("c", 1)}


def test_greedy_batches():
    sizes = [(10, 10)] * 3 + [(300, 10)] + [(10, 90), (10, 20), (5, 5)]
    assert list(fold.greedy_batches(sizes, most_txns=2, most_bytes=100)) == [[0, 1], [2], [3], [4], [5, 6]]


@pytest.mark.parametrize("low,high", [(0, 99), (-(1 << 63), (1 << 63) - 1), (5, 5), (1, 1001)])
def test_key_parts_are_disjoint_and_whole(low, high):
    plan = parts.key_parts("t", "k", low, high, 1000, 100, 8)
    assert plan[0].start == low and plan[-1].end == high and plan[-1].end_inclusive
    for a, b in zip(plan, plan[1:], strict=False):
        assert a.end == b.start and not a.end_inclusive
    assert parts.key_parts("t", "k", low, high, 10, 100, 8)[0].part_id == "all"


def test_filter_rules(spark):
    rules = catalog.parse_filter("# all\n\n app.*\n!app.log_?\n")
    assert catalog.normalized_filter(rules) == "app.*\n!app.log_?"
    names = spark.createDataFrame([("app.a",), ("app.log_1",), ("app.log_12",), ("x.a",)], "name string")
    assert {r.name: r.included for r in catalog.select_tables(names, rules).collect()} == {"app.a": True, "app.log_1": False, "app.log_12": True, "x.a": False}
    for bad in ("nodot", "a.b.c", "!", "a.[b"):
        with pytest.raises(catalog.FilterError):
            catalog.parse_filter(bad)


def test_digest_tells_null_empty_and_separator_apart(spark):
    rows = [(None, "x"), ("", "x"), ("\\N", "x"), ("a\x1f", "b"), ("a", "\x1fb")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(render.row_digest(df.schema, ["a", "b"]).alias("d")).distinct().count() == len(rows)


def test_diff_and_table_digest(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "z"), (4, "q")], "k int, v string")
    found = diff.full_diff(diff.keyed_digests(a, ["k"]), diff.keyed_digests(b, ["k"]))
    assert {(r.key, r.kind) for r in found.collect()} == {('["2"]', "different"), ('["3"]', "source_only"), ('["4"]', "target_only")}
    one = diff.table_digest(a, ["k", "v"]).first()[0]
    assert one == diff.table_digest(a.orderBy(F.desc("k")).repartition(3), ["k", "v"]).first()[0] != diff.table_digest(b, ["k", "v"]).first()[0]


def test_reservoir_is_uniform_and_bounded(spark):
    log = spark.range(4000).select(F.lit("r").alias("relation"), F.col("id").alias("end_lsn"), F.lit(0).alias("seq"), F.lit("U").alias("kind"))
    for cap in (10, 400, 5000):
        assert sampling.reservoir(log, cap).count() == min(cap, 4000)
    taken = pd.Series([r.end_lsn for r in sampling.reservoir(log, 400).collect()])
    assert all(60 < n < 140 for n in pd.cut(taken, [-1, 999, 1999, 2999, 3999]).value_counts())
    halves = [sampling.reservoir(log.where(c), 400) for c in ("end_lsn < 1500", "end_lsn >= 1500")]
    merged = sampling.reservoir(halves[0].unionByName(halves[1]).drop("slot", "h"), 400)
    assert {r.end_lsn for r in merged.collect()} == set(taken)


def test_order_violations_across_bands(spark):
    rows = [(i, i * 2, i * 2 + 1) for i in range(1, 9000)]
    rows[4095] = (4096, 4, 5)
    bad = fold.order_violations(spark.createDataFrame(rows, "number bigint, commit_lsn bigint, end_lsn bigint"))
    assert {r.number for r in bad.collect()} == {4096}
