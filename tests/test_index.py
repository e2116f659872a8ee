"""The segmented search index and the vector index: equal to plain scans, and reading and writing no more than they must."""

import json
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kbspark.operators import cells, indexed
from kbspark.sources import segments

ROWS = "chunk_id string, source string, content string"
TOKEN = re.compile(r"\w+")


def texts(n, seed, most=80):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(60)] + ["Licence", "LICENSE", "réseau", "all", "rights", "reserved"]
    return {f"c{i}": (f"s{i % 3}", " ".join(rng.choices(pool, k=rng.randrange(most))) + rng.choice(["", ".", " — end"])) for i in range(n)}


def frame(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()], ROWS)


def tokens(rows):
    return {k: TOKEN.findall(t.lower()) for k, (_, t) in rows.items()}


def plain_bm25(rows, terms, k=None):
    words = tokens(rows)
    n, mean = len(words), sum(map(len, words.values())) / max(len(words), 1)
    df = {t: sum(t in w for w in words.values()) for t in terms}
    out = {}
    for key, w in words.items():
        c = Counter(w)
        if any(c[t] for t in terms):
            out[key] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in terms)
    ordered = sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))
    return ordered[:k] if k else ordered


def compare(spark, index, rows, full=False):
    """Readers against plain versions over the live rows; all of them if ``full``."""
    words = tokens(rows)
    got = {r["chunk_id"]: (r["source"], r["content"]) for r in segments.rows_of(index).collect()}
    assert got == rows and (index.n, index.total) == (len(rows), sum(map(len, words.values())))
    keys = lambda df: sorted(r["chunk_id"] for r in df.collect())
    for phrase in (["all", "rights"], ["w1", "w2"], ["w3", "w3"])[: 3 if full else 1]:
        assert keys(indexed.phrase(index, phrase)) == sorted(k for k, w in words.items() if f" {' '.join(phrase)} " in f" {' '.join(w)} ")
    assert keys(indexed.boolean(index, "(w1 OR w2) AND NOT w3")) == sorted(k for k, w in words.items() if ("w1" in w or "w2" in w) and "w3" not in w)
    for terms in (["w1"], ["w1", "w2", "rights"], ["w5", "unheard"])[:: 1 if full else 3]:
        want = plain_bm25(rows, terms)
        whole = {r["chunk_id"]: r["score"] for r in indexed.bm25(index, terms).collect()}
        assert whole == pytest.approx(dict(want))
        top = [(r["chunk_id"], r["score"]) for r in indexed.bm25(index, terms, 7).collect()]
        assert sorted(s for _, s in top) == pytest.approx(sorted(s for _, s in want[:7])) and all(whole[k] == pytest.approx(s) for k, s in top)
    if not full:
        return
    assert keys(indexed.match(index, ["W1", "réseau"])) == sorted(k for k, w in words.items() if {"w1", "réseau"} & set(w))
    assert keys(indexed.boolean(index, "NOT w1")) == sorted(k for k, w in words.items() if "w1" not in w)
    assert keys(indexed.wildcard(index, "lic*se")) == sorted(k for k, w in words.items() if "license" in w)
    assert keys(indexed.by_pattern(index, "w1[0-3]")) == sorted(k for k, w in words.items() if {"w10", "w11", "w12", "w13"} & set(w))
    near = lambda w: w in ("licence", "license")
    assert sorted((r["chunk_id"], r["asked"]) for r in indexed.fuzzy(index, ["licence"]).collect()) == sorted((k, "licence") for k, w in words.items() if any(map(near, w)))


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files)


def test_readers_through_upserts_deletes_and_compaction(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BLOCK_ROWS", 40)
    monkeypatch.setattr(indexed, "FIRST_BLOCKS", 1)
    rows = texts(400, 1) | {"none": ("s0", ""), "again": ("s1", "all rights reserved w1 w1 w3 w3")}
    index = segments.create(frame(spark, rows), str(tmp_path))
    compare(spark, index, rows)
    changed = {k: ("s9", v[1] + " w1") for k, v in texts(30, 2).items()} | {"new": ("s9", "w2 w3 w3")}
    rows |= changed
    index = segments.upsert(index, frame(spark, changed))
    gone = [f"c{i}" for i in range(20, 60)]
    rows = {k: v for k, v in rows.items() if k not in gone}
    index = segments.delete(index, spark.createDataFrame([(g,) for g in [*gone, "unknown", None]], "chunk_id string"))
    assert [e["kind"] for e in index.entries] == ["segment", "segment", "dead"]
    compare(spark, index, rows, full=True)
    back = {"c25": ("s1", "all rights w1")}
    rows |= back
    index = segments.upsert(index, frame(spark, back))
    compare(spark, index, rows)
    whole = segments.compact(index, all_of_it=True)
    assert len(whole.entries) == 1
    compare(spark, whole, rows, full=True)
    # Older versions can be read until they are swept.
    assert segments.rows_of(segments.open_index(spark, str(tmp_path), 1)).count() == 402
    assert segments.sweep(whole)
    compare(spark, segments.open_index(spark, str(tmp_path)), rows)


def test_small_upserts_write_little_and_are_merged_in_tiers(spark, tmp_path):
    rows = texts(3000, 3)
    index = segments.create(frame(spark, rows), str(tmp_path))
    before = size_of(tmp_path)
    for i in range(segments.TIER + 1):
        changed = {f"c{i * 30 + j}": ("s8", f"changed number {i} {j}") for j in range(30)}
        rows |= changed
        began = size_of(tmp_path)
        index = segments.upsert(index, frame(spark, changed))
        assert size_of(tmp_path) - began < before / 4
    kinds = [e["rows"] for e in index.entries]
    assert kinds[0] == 3000 and len(kinds) <= segments.TIER
    compare(spark, index, rows)


def test_a_dead_writer_and_a_rival_change_nothing(spark, tmp_path):
    rows = texts(50, 4)
    index = segments.create(frame(spark, rows), str(tmp_path))
    segments.write_segment(frame(spark, {"c1": ("x", "half written")}), str(tmp_path), "chunk_id", "content")  # and no manifest
    compare(spark, segments.open_index(spark, str(tmp_path)), rows)
    first = segments.upsert(index, frame(spark, {"c1": ("s1", "from one")}))
    with pytest.raises(RuntimeError, match="another writer"):
        segments.upsert(index, frame(spark, {"c2": ("s1", "from the other")}))
    rows["c1"] = ("s1", "from one")
    compare(spark, segments.open_index(spark, str(tmp_path)), rows)
    assert len(segments.sweep(first)) == 2  # both writers' leavings
    compare(spark, segments.open_index(spark, str(tmp_path)), rows)


def test_only_the_named_terms_are_read(spark, tmp_path):
    rows = texts(300, 5)
    index = segments.create(frame(spark, rows), str(tmp_path))
    files = segments.postings_of(index).inputFiles()
    lists = indexed.lists_of(index, ["w1"])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    wanted = spark.range(1).select(segments.bucket_of(F.lit("w1"))).first()[0]
    assert f"PartitionFilters: [bucket#" in plan and "PushedFilters: [In(term, [w1])" in plan or "EqualTo(term,w1)" in plan
    read = {f for f in lists.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert read and all(f"bucket={wanted}/" in f for f in read) and len(read) < len(files) / 4
    assert "content" not in plan


def test_index_of_nothing_and_awkward_rows(spark, tmp_path):
    rows = spark.createDataFrame([(None, "s", "no key"), ("a", None, None), ("b", "s", ""), ("c", "s", "One one ONE"), ("c", "s", "One one ONE"), ("d", "s", "x " * 30_000)], ROWS)
    index = segments.create(rows, str(tmp_path / "one"))
    assert (index.n, index.total) == (4, 30_003)
    assert [r["chunk_id"] for r in indexed.phrase(index, ["one", "one", "one"]).collect()] == ["c"]
    assert {r["chunk_id"] for r in indexed.boolean(index, "NOT x").collect()} == {"a", "b", "c"}
    none = segments.create(rows.limit(0), str(tmp_path / "none"))
    assert indexed.match(none, ["x"]).count() == indexed.bm25(none, ["x"], 5).count() == indexed.phrase(none, ["x"]).count() == 0
    assert segments.upsert(none, rows).n == 4


def test_deletion_neighbours_find_what_distances_find(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choices("abcé", k=rng.randrange(1, 9))) for _ in range(500)})
    asked = sorted(set(rng.sample(words, 20)) | {"ab", "abc", "abcabc"})
    frame_ = spark.createDataFrame([(w,) for w in words], "term string")
    got = {(r["asked"], r["term"]) for r in indexed.near_terms(frame_, asked).collect()}

    def distance(a, b):
        line = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            line, last = [i] + [0] * len(b), line
            for j, y in enumerate(b, 1):
                line[j] = min(last[j] + 1, line[j - 1] + 1, last[j - 1] + (x != y))
        return line[-1]

    assert got == {(a, w) for a in asked for w in words if distance(a, w) <= indexed.edits_of(a)}


# Vectors
def points(n, seed, dim=16, kinds=12):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(kinds, dim))
    return centre[rng.integers(0, kinds, n)] + 0.4 * rng.normal(size=(n, dim))


def plain_nearest(rows, queries, k):
    unit = lambda v: None if v is None or len(v) != 16 or not np.isfinite(v).all() or not np.any(v) else np.array(v) / np.linalg.norm(v)
    out = {}
    for q, v in queries:
        a = unit(v)
        scores = sorted(((0.0 if a is None or unit(w) is None else float(a @ unit(w))), i) for i, w in rows.items())
        out[q] = sorted(((round(s, 9), i) for s, i in scores), key=lambda x: (-x[0], x[1]))[:k]
    return out


def test_cells_are_exact_at_factor_one_and_near_beyond(spark, tmp_path):
    v = points(3000, 7)
    rows = {i: list(map(float, x)) for i, x in enumerate(v)}
    rows |= {3000 + i: rows[5] for i in range(30)}  # ties go by key
    rows |= {4000: [0.0] * 16, 4001: [float("nan")] * 16, 4002: None}
    table = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    index = cells.create(table, str(tmp_path), cells=24)
    asked = [(i, list(map(float, x))) for i, x in enumerate(points(40, 8))] + [(50, rows[5]), (51, [0.0] * 16), (52, None)]
    queries = spark.createDataFrame(asked, "query_id long, q array<double>")
    want = plain_nearest(rows, asked, 20)
    got = defaultdict(list)
    for r in cells.nearest(index, queries, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((round(r["score"], 9), r["vec_id"]))
    assert got == want
    near = cells.nearest(index, queries.where("query_id <= 50"), 20, factor=2.5).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    recall = np.mean([len(set(r["ids"]) & {i for _, i in want[r["query_id"]]}) / 20 for r in near])
    assert recall >= 0.9


def test_cells_outside_the_probes_are_not_read(spark, tmp_path):
    table = spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(points(2000, 9, kinds=30))], "vec_id long, embedding array<double>")
    index = cells.create(table, str(tmp_path), cells=30)
    asks = cells.bounds(index, spark.createDataFrame([(1, list(map(float, points(1, 10)[0])))], "query_id long, q array<double>"), 1.0).where("place < 3")
    asked = {r["cell"] for r in asks.collect()}
    few = cells.rows_of(index).where(F.col("cell").isin(*asked))
    read = {f for f in few.select(F.input_file_name()).distinct().toPandas().iloc[:, 0]}
    assert {int(re.search(r"cell=(-?\d+)", f)[1]) for f in read} == asked and len(asked) == 3
    assert "PartitionFilters: [cell#" in few._jdf.queryExecution().executedPlan().toString()


def test_replaced_vectors_are_found_in_their_new_cells_only(spark, tmp_path):
    v = points(600, 11)
    rows = {i: list(map(float, x)) for i, x in enumerate(v)}
    index = cells.create(spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>"), str(tmp_path), cells=8)
    fresh = {i: list(map(float, -v[i])) for i in range(0, 600, 5)} | {700: rows[1]}
    before = size_of(tmp_path)
    index = cells.add(index, spark.createDataFrame(list(fresh.items()), "vec_id long, embedding array<double>"))
    assert size_of(tmp_path) < 1.6 * before
    rows |= fresh
    asked = [(i, rows[i]) for i in (0, 1, 5, 7, 700)]
    want = plain_nearest(rows, asked, 10)
    got = defaultdict(list)
    for r in cells.nearest(cells.open_cells(spark, str(tmp_path)), spark.createDataFrame(asked, "query_id long, q array<double>"), 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((round(r["score"], 9), r["vec_id"]))
    assert got == want


def test_cells_of_nothing(spark, tmp_path):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    index = cells.create(none, str(tmp_path))
    asked = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<double>")
    assert cells.nearest(index, asked, 5).count() == 0
    index = cells.add(index, spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    assert cells.nearest(index, asked, 5).count() == 1
    assert json.loads(open(tmp_path / "manifest" / "2.json").read())["names"] == index.names


def test_a_segment_is_written_without_shuffling_texts(spark, tmp_path):
    """Twelve rows of unlike texts; two of them have one key."""
    texts = [" ".join(f"w{i}x{j}" for j in range(200)) for i in range(12)]
    rows = spark.createDataFrame([(min(i, 10), t) for i, t in enumerate(texts)], "chunk_id long, content string")
    index = segments.create(rows, f"{tmp_path}/i")
    kept = {r.chunk_id: r.content for r in segments.rows_of(index).collect()}
    assert kept == {i: t for i, t in enumerate(texts[:10])} | {10: max(texts[10:])}
    held = spark.read.parquet(f"{tmp_path}/i/segments/{index.entries[0]['name']}/rows")
    blocks = segments.build_blocks(held.select("chunk_id", "dl", "content"), "chunk_id", "content")
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    assert {r.chunk_id for r in indexed.match(index, ["w3x7", "w11x0", "w10x0"]).collect()} == {3, 10}
