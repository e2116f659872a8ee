"""Lexical search, tokenizer alignment and k-d shards against plain versions on small tables."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kbspark.llm import kdshards, lexical, tokenalign
from tests.conftest import SF

PATHS = [public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
DOC = "doc_id long, text string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(n, seed, size=60, words=200):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{int(x)}" for x in np.minimum(rng.zipf(1.3, rng.integers(0, size)), words))) for i in range(n)]


# Ranked lexical search
def plain_rank(docs, items, k=10):
    held = [(d, Counter(WORDS.findall((t or "").translate(LOWER)))) for d, t in docs]
    n = sum(bool(c) for _, c in held)
    total = sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        asked = Counter(WORDS.findall((text or "").translate(LOWER)))
        found = []
        for d, c in held:
            m = 25 + (75 * c.total() * n) // total if total else 25
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return out


def ranked(spark, docs, items, **how):
    found = lexical.search(lexical.index(spark.createDataFrame(docs, DOC), **how), spark.createDataFrame(items, "item_id long, text string"))
    return [tuple(r) for r in found.collect()]


def test_ranked_search_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_DOCS", 16)
    monkeypatch.setattr(lexical, "FIRST_VISIT", 2)
    docs = texts(900, 1)
    docs += [(1000 + i, docs[5][1]) for i in range(40)]  # equal scores go by id
    items = [(i, t) for i, t in texts(25, 2, 12)] + [(90, docs[5][1]), (91, "W1 w1, w1;W2"), (92, "unheard of"), (93, None), (94, "")]
    got, want = ranked(spark, docs, items, levels=3), plain_rank(docs, items)
    assert sorted(got) == sorted(want)
    assert {r[0] for r in got} >= {90, 91} and not {r[0] for r in got} & {92, 93, 94}


def test_ranked_search_awkward_rows(spark):
    docs = [(None, "a b c"), (1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "É é straße Ⅷ\x7fx"), (5, "x " * 5000), (6, "--- ...")]
    items = [(1, "a c"), (1, "a c"), (2, "É"), (None, "b"), (3, "x straße"), (4, "")]
    want = plain_rank(docs, [(1, "a c"), (2, "É"), (None, "b"), (3, "x straße"), (4, "")])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(ranked(spark, docs, items), key=key) == sorted(want, key=key)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []


def test_shards_stop_early(spark, monkeypatch):
    """Topics lie apart after bisection, so an item of one topic leaves the shards of the others unvisited."""
    monkeypatch.setattr(lexical, "SHARD_DOCS", 25)
    monkeypatch.setattr(lexical, "FIRST_VISIT", 2)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(f"t{i % 8}x{int(w)}" for w in rng.integers(0, 60, 30))) for i in range(1600)]
    held = lexical.index(spark.createDataFrame(docs, DOC), levels=3)
    shards = held.where("term = X''").count()
    pure = held.where("term <> X''").groupBy("shard").agg(F.count_distinct(F.substring(F.col("term").cast("string"), 1, 2)).alias("n")).where("n <= 2").count()
    assert pure > 0.8 * shards
    visited = []
    real = lexical.scored
    monkeypatch.setattr(lexical, "scored", lambda touched, asked, *rest: (visited.append(asked.count()), real(touched, asked, *rest))[1])
    items = [(0, "t3x1 t3x2 t3x3")]
    got = [tuple(r) for r in lexical.search(held, spark.createDataFrame(items, "item_id long, text string")).collect()]
    assert sorted(got) == sorted(plain_rank(docs, items)) and sum(visited) <= shards / 4


def test_bisection_separates_communities():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, 40) + 400 * (i % 2)).astype(np.int32) for i in range(400)]
    weights, border = lexical.plan(sets, 1)
    side = [lexical.leaf(s, weights, border) for s in sets]
    assert len(set(side[::2])) == len(set(side[1::2])) == 1 and side[0] != side[1]


# Alignment of tokenizers
def plain_alignment(docs):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(PATHS[0]), SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    byte = tokenalign.byte_letters()
    of = {c: i for i, c in enumerate(byte)}
    rows, holders = [], Counter()
    for d, text in docs:
        one, two = [], []
        if text:
            one = a.encode(" " + text, add_special_tokens=False).ids
            two = b.encode(text)
        spans = []
        for side, ids in ((0, one), (1, two)):
            at, out = 0, []
            for i in ids:
                raw = bytes(of[c] for c in a.id_to_token(i)) if side == 0 else bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
                out.append((i, at, at + len(raw), raw))
                at += len(raw)
            spans.append(out)
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(s[3] for s in side) != whole for side in spans):
            spans = [[], []]
        ends = sorted({s[2] for s in spans[0]} & {s[2] for s in spans[1]})
        groups, start = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e, _ in side if start <= s and e <= end) for side in spans))
            start = end
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        holders.update(set(links))
        rows.append((d, len(spans[0]), len(spans[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (x, _), n in holders.items():
        most[x] = max(most[x], n)
    return [(d, na, nb, g, len(k), sum(holders[p] == most[p[0]] for p in k), sum(holders[p] for p in k), h) for d, na, nb, g, k, h in rows]


ODD = [
    (1, "Tokenizers disagree about unbelievable, well-known words."), (2, "naïve café – 🙂 漢字 ̀x"), (3, None), (4, ""), (5, " "), (6, "two  blanks\tand\nlines"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (8, "a" * 3000), (9, "ﬁne Ⅷ ½ ＡＢＣ"), (None, "null id"), (1, "Tokenizers disagree about unbelievable, well-known words."), (10, "▁ already"), (11, "\x00\x7f"), (12, " lead"), (13, "trail "),
]
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("most", [tokenalign.MOST_BROADCAST, 0])
def test_alignment_brute_force(spark, most):
    docs = ODD + [(100 + i, t) for i, t in texts(60, 5)]
    frame = spark.createDataFrame(docs, DOC).withColumn("keys", F.lit(1)).withColumn("n", F.lit("x"))
    got = [tuple(r) for r in tokenalign.align(frame, *PATHS, most=most).select(*ALIGNED).collect()]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(got, key=key) == sorted(plain_alignment(docs), key=key)


def test_alignment_of_the_smallest_tables_and_of_none(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    got = [tuple(r) for r in tokenalign.align(spark.createDataFrame(docs, DOC), *PATHS).select(*ALIGNED).collect()]
    assert sorted(got) == sorted(plain_alignment(docs))
    assert tokenalign.align(spark.createDataFrame([], DOC), *PATHS).count() == 0


def test_first_vocabulary_is_merged_as_its_library_does():
    from tokenizers import Tokenizer

    library, pair = Tokenizer.from_file(PATHS[0]), tokenalign.Pair(*PATHS)
    library.encode_special_tokens = True
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 16_384):
        asked = [f" x{chr(c)}y {chr(c)}{chr(c)} 1{chr(c)}2\n{chr(c)} 's" for c in points[at : at + 16_384]]
        assert [e.ids for e in library.encode_batch(asked, add_special_tokens=False)] == [pair.first.encode_ordinary(t) for t in asked]


# Shards
META = "doc_id long, text string, source string, lang string"


def checked(rows, frame):
    """Every row once, sizes and checksums right, slots without gaps; bytes by shard."""
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    got = frame.collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots, held = defaultdict(list), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        held[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got, held


def test_shards_are_near_equal(spark):
    rng = np.random.default_rng(6)
    hot = "one text that a third of all rows hold " * 5
    rows = [(i, hot if i % 3 == 0 else "y" * int(rng.integers(1, 400)), f"src{int(min(rng.zipf(1.5), 9))}", ["en", "de", None][i % 3]) for i in range(6000)]
    _, held = checked(rows, kdshards.shard(spark.createDataFrame(rows, META)))
    mean = sum(held.values()) / 40
    assert sorted(held) == list(range(40)) and max(held.values()) < mean * 1.04 and min(held.values()) > mean * 0.96


def test_cuts_fall_along_the_widest_dimension(spark):
    """Two sources of equal bytes: the first cut parts them, whatever their texts and languages are."""
    rows = [(i, "z" * (50 + i % 7), "ab"[i % 2], "xy"[i // 2 % 2]) for i in range(400)]
    got, _ = checked(rows, kdshards.shard(spark.createDataFrame(rows, META), shards=4))
    sides = defaultdict(set)
    for r in got:
        sides[r["shard"]].add((rows[r["doc_id"]][2], rows[r["doc_id"]][3]))
    # Sizes of the sources differ by a few bytes, so at most one document of a cut lies beyond it.
    per = Counter((r["shard"], rows[r["doc_id"]][2]) for r in got)
    assert sum(max(per[s, "a"], per[s, "b"]) for s in range(4)) >= 396


def test_shards_by_target_bytes_and_awkward_rows(spark):
    rows = [(None, "a", "s", "l"), (1, None, None, None), (2, "", "s", None), (3, "long " * 40_000, None, "l"), (4, "t", "s", "l"), (4, "t", "s", "l")]
    frame = spark.createDataFrame(rows, META).withColumn("size", F.lit("clash")).withColumn("shard", F.lit(-1)).withColumn("node", F.lit(0))
    _, held = checked(rows, kdshards.shard(frame, shards=5))
    assert set(held) <= set(range(5))
    whole = sum(len((t or "").encode()) + 16 for _, t, *_ in rows)
    _, held = checked(rows, kdshards.shard(frame, target_bytes=whole // 3 + 1))
    assert set(held) <= {0, 1, 2}
    assert kdshards.shard(frame.limit(0)).count() == 0
    assert kdshards.shard(frame.select("doc_id", "text"), shards=3).count() == 6


def test_no_python_in_the_sharding_plan(spark):
    plan = kdshards.shard(spark.createDataFrame([(1, "a", "s", "l")], META).repartition(1), shards=2)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_slots_of_a_shard_over_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(kdshards, "ROWS_PER_BUCKET", 50)
    rows = [(i, "q" * (i % 30), "s", "l") for i in range(1000)]
    checked(rows, kdshards.shard(spark.createDataFrame(rows, META), shards=3))
