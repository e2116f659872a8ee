"""Folds over slices, moving ranges, interval joins and trees against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from kbspark.operators import cluster, intervals, ranges, trees
from kbspark.operators.folds import fold


# Folds
def test_one_hot_key_is_spread_over_the_tasks(spark):
    """Half of all rows have one key: every slice has a part of it, and the result is that of one pass."""
    rng = random.Random(1)
    rows = [(7 if i % 2 else rng.randrange(40), rng.randrange(10**6), i) for i in range(4000)] + [(None, 5, 5000), (None, 3, 5001)]
    frame = spark.createDataFrame(rows, "key long, t long, id long")

    def step(state, t):  # never forgets: a running sum with a turn of sign
        return (state[0] + t, -state[1]), state[0] * state[1]

    got = fold(frame, "key", ["t", "id"], ["t"], (0, 1), step, "x", LongType())
    want, states = {}, {}
    for key, t, i in sorted(rows, key=lambda r: r[1:]):
        states[key], want[i] = step(states.get(key, (0, 1)), t)
    assert {r["id"]: r["x"] for r in got.collect()} == want
    held = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count_if(F.col("key") == 7).alias("hot"), F.count("*").alias("n")).collect()
    assert len(held) >= 4 and sum(r["hot"] > 0 for r in held) >= 2 and max(r["n"] for r in held) < 0.5 * len(rows)


def test_limits_of_a_hot_key(spark):
    rng = random.Random(2)
    rows = [("hot" if i % 2 else f"k{i % 9}", rng.randrange(200_000), i) for i in range(3000)]
    frame = spark.createDataFrame(rows, "key string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r["id"]: r["limited"] for r in cluster.limited(frame.select("key", "ts", "id"), 3).collect()}
    want, state = {}, {}
    for key, s, i in sorted(rows, key=lambda r: r[1:]):
        begun, n = state.get(key, (None, 0))
        begun, n = (s, 1) if begun is None or s >= begun + 3600 else (begun, n + 1)
        state[key], want[i] = (begun, n), n > 3
    assert got == want
    assert cluster.limited(frame.select("key", "ts", "id").limit(0), 3).count() == 0


# Moving ranges
def plain_rate(samples, window, step):
    out = {}
    everything = [s for v in samples.values() for s, _ in v]
    first, last = -(-min(everything) // step) * step, max(everything) // step * step
    for key, points in samples.items():
        best = {}
        for s, v in points:
            best[s] = max(v, best.get(s, v))
        points = sorted(best.items())
        t = first
        while t <= last:
            held = [(s, v) for s, v in points if t - window <= s <= t]
            if len(held) > 1:
                gain = sum(b if b < a else b - a for (_, a), (_, b) in zip(held, held[1:]))
                span = held[-1][0] - held[0][0]
                mean = span / (len(held) - 1)
                left, right = held[0][0] - (t - window), t - held[-1][0]
                left = left if left < mean * 1.1 else mean / 2
                if gain > 0 and held[0][1] >= 0:
                    left = min(left, span * held[0][1] / gain)
                right = right if right < mean * 1.1 else mean / 2
                out[key, t] = gain * (span + left + right) / span / window
            t += step
    return out


def test_range_rates_with_resets_gaps_and_edges(spark):
    rng = random.Random(3)
    samples = {}
    for key in range(6):
        s, v, held = 1000 + key, 0.0, []
        for _ in range(150):
            s += rng.choice([15, 15, 15, 30, 700 if key % 2 else 15])
            v = rng.random() if rng.random() < 0.06 else v + rng.choice([0, 1, 2.5])
            held.append((s, v))
        samples[key] = held
    samples[9] = [(1500, 4.0)]  # alone: no rate
    samples[10] = [(1200, 1.0), (1500, 3.0), (1500, 4.0), (1800, 4.5)]  # samples on the edges of ranges, two at one time
    rows = spark.createDataFrame([(k, s, v) for k, p in samples.items() for s, v in p], "k long, s long, v double").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r["k"], r["t"]): r["rate"] for r in ranges.range_rate(rows, ["k"], 300, 60, value="v").collect()}
    assert got == pytest.approx(plain_rate(samples, 300, 60))
    assert ranges.range_rate(rows.limit(0), ["k"], 300, 60, value="v").count() == 0


def test_the_work_of_ranges_does_not_follow_their_overlap(spark):
    rows = spark.range(2000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"))
    for window in (600, 60_000):
        found = ranges.range_rate(rows, ["k"], window, 600)
        assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
        assert found.where("t > 60000").select(F.round("rate", 6)).distinct().count() == 1  # 1 a minute whatever the window


def test_stale_values_are_left_out(spark):
    rows = spark.createDataFrame([("a", 0, 1.0), ("a", 100, 2.0), ("b", 590, 7.0), ("a", 1200, 9.0)], "k string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    got = sorted((r["k"], r["t"], r["value"]) for r in ranges.instant(rows, ["k"], 300).collect())
    assert got == [("a", 0.0, 1.0), ("a", 300.0, 2.0), ("a", 1200.0, 9.0), ("b", 600.0, 7.0)]


# Intervals
def test_overlaps_by_bins(spark):
    rng = random.Random(4)
    spans = [(rng.randrange(3), i, a, a + rng.choice([0, 1, 5, 300, -1])) for i in range(150) for a in [rng.randrange(-200, 600)]] + [(1, 900, None, 5), (1, 901, 5, None)]
    dots = [(rng.randrange(3), 1000 + i, rng.randrange(-200, 900)) for i in range(200)] + [(1, 2000, None)]
    left, right = spark.createDataFrame(spans, "d long, c long, first long, last long"), spark.createDataFrame(dots, "d long, i long, e long")
    for reach in ((0, 0), (3, 70)):
        got = Counter((r["c"], r["i"]) for r in intervals.overlapping(left, right, ["d"], "first", "last", "e", reach).collect())
        assert got == Counter((c, i) for d, c, a, z in spans for x, i, e in dots if d == x and None not in (a, z, e) and a <= z and a - reach[0] <= e <= z + reach[1])


def test_rows_joined_grow_with_the_result_in_one_long_document(spark):
    """A document of 100,000 elements: the join hands on about as many rows as belong together, not 10^10."""
    n = 100_000
    chunks = spark.range(n // 5).select(F.lit(1).alias("d"), F.col("id").alias("c"), (F.col("id") * 5).alias("first"), (F.col("id") * 5 + 2).alias("last"), F.floor(F.col("id") / 10).alias("page"))
    images = spark.range(n).select(F.lit(1).alias("d"), F.col("id").alias("i"), F.col("id").alias("e"), F.floor(F.col("id") / 50).alias("image_page"))
    assert intervals.overlapping(chunks, images, ["d"], "first", "last", "e").count() == 3 * n // 5
    bins = chunks.where("first <= last").select(F.explode(F.sequence(F.floor(F.col("first") / intervals.BIN), F.floor(F.col("last") / intervals.BIN))))
    assert bins.count() < 1.1 * n / 5
    assert intervals.chunk_images(chunks, images).where("strategy = 'within_range'").count() == 3 * n // 5


def test_nearest_by_one_sweep(spark):
    rng = random.Random(5)
    asked = [(rng.randrange(4), i, rng.randrange(60)) for i in range(80)] + [(0, 200, None), (9, 201, 5)]
    dots = [(rng.randrange(4), 1000 + i, rng.randrange(60)) for i in range(40)] + [(0, 3000, None)]
    got = {r["a"]: r["i"] for r in intervals.nearest(spark.createDataFrame(asked, "d long, a long, at long"), spark.createDataFrame(dots, "d long, i long, to long"), ["d"], "at", "to", "i").collect()}
    want = {}
    for d, a, at in asked:
        near = sorted((abs(to - at), to, i) for x, i, to in dots if x == d and to is not None) if at is not None else []
        want[a] = near[0][2] if near else None
    assert got == want


# Trees
def plain_levels(parent):
    out = {}
    for node in parent:
        seen, at = [node], node
        while parent.get(at) in parent and parent[at] is not None and len(seen) <= len(parent):
            at = parent[at]
            seen.append(at)
        out[node] = (at, len(seen)) if len(seen) <= len(parent) else (None, None)
    return out


def test_levels_roots_and_cycles(spark):
    rng = random.Random(6)
    parent = {i: (rng.randrange(i) if i % 15 else None) for i in range(1, 24)} | {0: None}
    parent |= {1000: 1001, 1001: 1002, 1002: 1000, 1003: 1000, 1004: 1003, 1005: 1005, 1006: 999_999}  # cycles, what hangs on one, a lost parent
    frame = spark.createDataFrame(list(parent.items()), "id long, parent long")
    got = {r["id"]: (r["root"], r["level"]) for r in trees.levels(frame).collect()}
    assert got == plain_levels(parent)
    assert {node for node, (root, _) in got.items() if root is None} == {1000, 1001, 1002, 1003, 1004, 1005}
    paths = {r["id"]: r["path"] for r in trees.paths(frame).collect()}
    for node, (root, level) in got.items():
        if root is not None:
            steps = [node]
            while len(steps) < level:
                steps.append(parent[steps[-1]])
            assert paths[node] == "/".join(map(str, reversed(steps)))
    sums = {r["id"]: r["total"] for r in trees.subtree_sums(frame.withColumn("v", F.col("id") + 1), F.col("v")).collect()}
    want = defaultdict(int)
    for node, (root, level) in got.items():
        at = node
        for _ in range(level or 0):
            want[at] += node + 1
            at = parent[at]
    assert sums == dict(want)


def test_a_chain_of_two_hundred_and_fifty_takes_eight_rounds(spark, monkeypatch):
    rounds = []
    real = trees.checkpointed
    monkeypatch.setattr(trees, "checkpointed", lambda df: (rounds.append(1), real(df))[1])
    chain = spark.range(250).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = trees.levels(chain).agg(F.max("level"), F.min("root"), F.max("root"), F.count_if(F.col("level") == F.col("id") + 1)).first()
    assert tuple(found) == (250, 0, 0, 250) and len(rounds) <= 9


def test_cascade_over_two_links(spark):
    one = lambda rows, kinds: spark.createDataFrame(rows, kinds)
    tables = {"a": one([(1,), (2,), (None,)], "k long"), "b": one([(10, 1), (11, 2), (12, None)], "i long, k long"), "c": one([(10, 2), (11, 2), (12, 1), (None, 2)], "i long, k long")}
    left = trees.cascade(tables, [("b", "k", "a", "k"), ("c", "i", "b", "i"), ("c", "k", "a", "k")], "a", one([(1,), (5,)], "k long"))
    rows = {n: sorted(map(tuple, d.collect()), key=str) for n, d in left.items()}
    assert rows == {"a": [(2,), (None,)], "b": [(11, 2), (12, None)], "c": [(11, 2), (None, 2)]}


def test_leaves_take_no_part_in_rounds(spark, monkeypatch):
    """What is written in the rounds of a flat tree grows with its inner nodes; leaves are written a fixed number of times."""
    rows = [("t", None, 1)] + [(f"m{i}", "t", 2) for i in range(3)] + [(f"l{i}", f"m{i % 3}", 3) for i in range(300)] + [("a", "b", 5), ("b", "a", 5), ("c", "b", 7), ("s", "s", 9), ("o", "none", 4)]
    nodes = spark.createDataFrame(rows, "id string, parent string, value long")
    written, kept = [], trees.checkpointed
    monkeypatch.setattr(trees, "checkpointed", lambda df: written.append(kept(df)) or written[-1])
    got = {r.id: r.total for r in trees.subtree_sums(nodes, F.col("value")).collect()}
    assert got == {"t": 907, "o": 4} | {f"m{i}": 302 for i in range(3)} | {f"l{i}": 3 for i in range(300)}
    assert sum(w.count() > 100 for w in written) <= 2
    found = {r.id: (r.root, r.level) for r in trees.levels(nodes).collect()}
    assert found["t"] == ("t", 1) and found["m1"] == ("t", 2) and found["l299"] == ("t", 3) and found["o"] == ("o", 1) and len(found) == len(rows)
    assert all(found[x] == (None, None) for x in "abcs")
