"""Line-level dedup: documents that share rare runs of lines are aligned in pairs, common blocks deleted."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.common import cut, keyed_text, lookup, rows, strings, table

#: Words of a shared run of lines from which it is deleted.
MIN_WORDS = 20


def windows(sizes: list[int], min_words: int) -> list[tuple[int, int]]:
    """The shortest runs of lines with ``min_words`` words that start at a line, and those that end
    at one, as places of their first and last line. Lines have ``sizes`` words, one at least.

    They cover every longer run: from a line of it to its end there are enough words, or from its
    start to the line, or else the shortest run from its start goes beyond the line.
    """
    sums = [0, *accumulate(sizes)]
    least = max(1, min_words)
    found = {(i, bisect_left(sums, sums[i] + least) - 1) for i in range(len(sizes)) if sums[-1] - sums[i] >= least}
    found |= {(bisect_right(sums, sums[i + 1] - least) - 1, i) for i in range(len(sizes)) if sums[i + 1] >= least}
    return sorted(found)


def runs_of(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows ``(doc_id, th, hi, lo, nth, place, rows)``, one for each window of non-blank lines of a document.

    ``hi`` and ``lo`` hash the trimmed lines of the window, ``nth`` counts its equals in the document
    from 0, ``place`` is the number of its first line among the non-blank ones, ``rows`` are the lines' numbers among all lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"hi": pa.int64(), "lo": pa.int64(), "nth": pa.int32(), "place": pa.int32(), "rows": pa.list_(pa.int32())}
        for b in rows(batches, 256):
            of, out = [], []
            for at, text in enumerate(strings(b.column(1))):
                kept = [(i, x) for i, x in enumerate(map(str.strip, text.split("\n"))) if x]
                digests = [xxhash.xxh3_128_digest(x.encode()) for _, x in kept]
                seen: Counter[int] = Counter()
                for first, last in windows([len(x.split()) for _, x in kept], min_words):
                    wide = xxhash.xxh3_128_intdigest(b"".join(digests[first : last + 1]))
                    of.append(at)
                    out.append(((wide >> 64) - (1 << 63), (wide & (1 << 64) - 1) - (1 << 63), seen[wide], first, [i for i, _ in kept[first : last + 1]]))
                    seen[wide] += 1
            cols = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds.values(), strict=True)]
            whose = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(whose), b.column(2).take(whose), *cols], ["doc_id", "th", *kinds])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "th").mapInArrow(run, f"doc_id {kind}, th long, hi long, lo long, nth int, place int, rows array<int>")


def rising(places: list[int]) -> list[int]:
    """Indexes of the longest strictly rising sequence of ``places``, by patience sorting: each place
    goes on the leftmost pile whose top is not below it, and remembers the top of the pile before."""
    tops: list[int] = []
    ends: list[int] = []
    before = [-1] * len(places)
    for i, place in enumerate(places):
        at = bisect_left(tops, place)
        before[i] = ends[at - 1] if at else -1
        tops[at : at + 1], ends[at : at + 1] = [place], [i]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Blocks ``(first, last, at)`` of a document's lines that stand from line ``at`` on in another.

    ``found`` holds their shared windows as first line here, number of lines and first line there; each
    is unique in both, as equal windows are told apart by their count. The patience alignment is the
    longest sequence of their lines that rises in both documents, so a line has one partner at most
    and what crosses the sequence is left alone. A block is a stretch of it that holds whole windows.
    """
    # Of the partners of one line a rising sequence can take one: the greater ones come first.
    pairs = sorted({(here + k, -(there + k)) for here, n, there in found for k in range(n)})
    path = [(pairs[i][0], -pairs[i][1]) for i in rising([-at for _, at in pairs])]
    run_of: dict[tuple[int, int], int] = {}  # the stretch that each pair of the path is in
    for i, (here, there) in enumerate(path):
        run_of[here, there] = run_of[path[i - 1]] if i and path[i - 1] == (here - 1, there - 1) else i
    blocks: list[list[int]] = []
    for here, n, there in sorted(found):
        run = run_of.get((here, there))
        if run is not None and run_of.get((here + n - 1, there + n - 1)) == run:
            if blocks and blocks[-1][3] == run and here <= blocks[-1][1] + 1:
                blocks[-1][1] = max(blocks[-1][1], here + n - 1)
            else:
                blocks.append([here, here + n - 1, there, run])
    return [(first, last, at) for first, last, at, _ in blocks]


def ranges(rows: set[int]) -> list[dict]:
    """Row numbers as ranges, both ends included."""
    out: list[dict] = []
    for row in sorted(rows):
        if out and out[-1]["b"] == row - 1:
            out[-1]["b"] = row
        else:
            out.append({"a": row, "b": row})
    return out


def deletions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``(doc_id, th, gone, blocks)`` for documents ``(doc_id, text, th)`` that have lines to delete.

    A line such as a heading is common, a run of lines that just reaches ``min_words`` words is rare:
    its hash, with the count of its equals before it in the document, is what overlapping documents
    find each other by. Each goes to its earliest holder (least id, then text hash), found by an
    algebraic minimum that is summed before the shuffle, so a passage of any frequency gives each later
    document one partner for each run and no pairs within its group; the runs of very frequent
    passages are dealt over many tasks. Then every pair of a document and a partner is aligned, and
    the lines of the aligned blocks go. A document's runs, two for each of its lines at most, are
    one row of that step.
    """
    runs = runs_of(docs, min_words)
    key = F.struct("doc_id", "th", F.col("place").alias("at"))
    holders = cut(
        runs.groupBy("hi", "lo", "nth")
        .agg(F.min(key).alias("e"), F.max(key).alias("last"), F.count("*").alias("n_runs"))
        .where(~(F.col("e.doc_id").eqNullSafe(F.col("last.doc_id")) & (F.col("e.th") == F.col("last.th"))))
        .select("hi", "lo", "nth", "n_runs", *[F.col(f"e.{c}").alias(f"e_{c}") for c in ("doc_id", "th", "at")])
    )
    later = lookup(runs, holders, ["hi", "lo", "nth"], "n_runs")
    later = later.where(~(F.col("doc_id").eqNullSafe(F.col("e_doc_id")) & (F.col("th") == F.col("e_th"))))
    pair = F.struct(F.col("e_doc_id").alias("doc_id"), F.col("e_th").alias("th"), F.col("e_at").alias("at"), "place", "rows")
    grouped = later.groupBy("doc_id", "th").agg(F.collect_set(pair).alias("found"))  # a set: repeated rows count once
    names = {"gone": pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])), "blocks": None}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 64):
            gone, blocks = [], []
            for found in b.column(2).to_pylist():
                pairs: dict[tuple, list[tuple[int, int, int]]] = {}
                row: dict[int, int] = {}
                for f in found:
                    pairs.setdefault((f["doc_id"], f["th"]), []).append((f["place"], len(f["rows"]), f["at"]))
                    row.update(enumerate(f["rows"], f["place"]))
                made = [(a, z, p[0], at) for p, w in pairs.items() for a, z, at in align(w)]
                gone.append(ranges({row[i] for a, z, *_ in made for i in range(a, z + 1)}))  # blank lines within a block stay
                made = [(row[a], row[z], doc, at) for a, z, doc, at in made]
                blocks.append([dict(zip(("first", "last", "doc_id", "at"), b, strict=True)) for b in sorted(made, key=lambda b: b[:2])])
            block = pa.struct([("first", pa.int32()), ("last", pa.int32()), ("doc_id", b.column(0).type), ("at", pa.int32())])
            cols = [pa.array(gone, names["gone"]), pa.array(blocks, pa.list_(block))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], ["doc_id", "th", *names])

    block = f"array<struct<first: int, last: int, doc_id: {kind}, at: int>>"
    return grouped.mapInArrow(run, f"doc_id {kind}, th long, gone array<struct<a: int, b: int>>, blocks {block}")


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", blocks: bool = False) -> DataFrame:
    """``docs`` with the repeated blocks cut from ``text_col``, and a column ``n_lines_deleted`` (long)
    behind them; with ``blocks`` also ``deleted_blocks``: first and last line, and the earlier
    document and its non-blank line, from 0, from which the same lines stand there.

    All columns and rows of ``docs`` stay, in whatever number; a column of these two names is
    replaced. Documents are ordered by id, null ids first, and rows of one id by a hash of their
    texts; rows equal in both are one document. Blank lines and blocks under ``min_words`` words
    stay, as do repetitions within one document. Null texts stay null, empty ones empty. Each
    deleted line is kept by an earlier document, since the earliest holder never loses it.
    """
    made = ["n_lines_deleted", *["deleted_blocks"] * blocks]
    docs = docs.drop(*made)
    mark = "__line_hash"
    hashed = docs.withColumn(mark, F.xxhash64(F.col(text_col).cast("string")))
    few = keyed_text(docs, id_col, text_col).withColumn("th", F.xxhash64("text"))
    gone = deletions(few, min_words)
    gone = gone.select(F.col("doc_id").alias("__line_doc"), F.col("th").alias("__line_th"), F.col("gone").alias("__line_gone"), F.col("blocks").alias("__line_blocks"))
    both = hashed.join(gone, hashed[id_col].eqNullSafe(gone["__line_doc"]) & (hashed[mark] == gone["__line_th"]), "left")
    inside = lambda i: F.exists("__line_gone", lambda g: (i >= g["a"]) & (i <= g["b"]))
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda x, i: ~inside(i))
    text = F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    count = F.coalesce(F.aggregate("__line_gone", F.lit(0).cast("long"), lambda n, g: n + g["b"] - g["a"] + 1), F.lit(0).cast("long"))
    extra = [count.alias(made[0]), *[F.col("__line_blocks").alias(c) for c in made[1:]]]
    return both.select(*[text.alias(c) if c == text_col else hashed[c] for c in docs.columns], *extra)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its text without the blocks that it shares with earlier ones, how many lines went, and
    the blocks as ``first-last=doc_id@line``, comma-joined."""
    found = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), blocks=True)
    one = lambda b: F.concat(b["first"], F.lit("-"), b["last"], F.lit("="), F.coalesce(b["doc_id"].cast("string"), F.lit("")), F.lit("@"), b["at"])
    return found.withColumn("deleted_blocks", F.coalesce(F.array_join(F.transform("deleted_blocks", one), ","), F.lit("")))
