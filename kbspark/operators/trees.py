"""Trees given by parent pointers: roots, levels, cycles, subtree sums and cascades, by pointer jumping.

Each round doubles the distance that a pointer spans, so a tree of depth n needs about log2(n) rounds,
whatever its shape. Rounds are cut by checkpoints in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kbspark.operators.skew import join_found
from kbspark.sources.scratch import checkpointed


def _known(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """``(id, up)`` of distinct nodes; a pointer to a node that is not there is none."""
    few = nodes.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).where("id IS NOT NULL").groupBy("id").agg(F.min("up").alias("up"))
    counts = few.groupBy("up").agg(F.count("*").alias("n_")).where("up IS NOT NULL")
    there = counts.join(few.select(F.col("id").alias("up")), "up", "left_semi")
    kept = join_found(few.where("up IS NOT NULL"), there.select("up", "n_", F.lit(True).alias("ok")), ["up"], "n_", how="left")
    return few.where("up IS NULL").unionByName(kept.select("id", F.when(F.col("ok"), F.col("up")).alias("up")))


def levels(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", most_rounds: int = 64) -> DataFrame:
    """``(id, root, level)``: the top of each node's tree and the number of nodes from there to it, 1 for tops.

    ``root`` and ``level`` are null for nodes on a cycle or below one. A node that is named as its own
    parent is a cycle of one. Of several parents of an id the least counts; a parent that is no node
    counts as none.
    """
    return _levels(*_peeled(_known(nodes, id_col, parent_col)), most_rounds).select("id", "root", "level")


def _peeled(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(id, up, n_)`` that others hang on, with how many those are, and ``(id, up)`` of the leaves. Leaves are
    often nearly all nodes and need no rounds: what they need is with their parent."""
    held = checkpointed(known)
    below = checkpointed(held.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_")))
    return held.join(below, "id"), held.join(below, "id", "left_anti")


def _levels(inner: DataFrame, leaves: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(id, root, level, first)``; ``first`` is the node's parent."""
    rows = checkpointed(inner.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), F.when(F.col("up").isNull(), 1).alias("level"), F.lit(1).cast("long").alias("span"), F.col("up").alias("first"), F.col("n_").alias("below")))
    total = rows.count()
    for i in range(most_rounds):
        open_ = rows.where("root IS NULL")
        if (1 << i) > total or open_.isEmpty():
            break
        asked = open_.groupBy("up").agg(F.count("*").alias("n_"))
        known = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("root").alias("its_root"), F.col("level").alias("its_level"), F.col("span").alias("its_span"))
        found = join_found(open_.select("id", "up", "span", "first", "below"), known.join(asked, "up"), ["up"], "n_")
        moved = found.select("id", F.col("next").alias("up"), F.col("its_root").alias("root"), (F.col("its_level") + F.col("span")).cast("int").alias("level"), (F.col("span") + F.col("its_span")).alias("span"), "first", "below")
        rows = checkpointed(rows.where("root IS NOT NULL").unionByName(moved.select(*rows.columns)))
    over = rows.select(F.col("id").alias("up"), "root", F.col("level").alias("its_level"), F.col("below").alias("n_"))
    hung = join_found(leaves.where("up IS NOT NULL").select("id", "up"), over, ["up"], "n_")
    tops = leaves.where("up IS NULL").select("id", F.col("id").alias("root"), F.lit(1).alias("level"), F.col("up").alias("first"))
    ended = hung.select("id", "root", (F.col("its_level") + 1).cast("int").alias("level"), F.col("up").alias("first"))
    return rows.select("id", "root", "level", "first").unionByName(tops).unionByName(ended)


def cycles(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(id)`` of the nodes on a cycle or below one."""
    return levels(nodes, id_col, parent_col).where("root IS NULL").select("id")


def subtree_sums(nodes: DataFrame, value: Column, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """``(id, total)``: a node's value and those of all below it.

    After k rounds a node has the sum of what is less than 2^k steps below; those that far below a
    node whose pointer of 2^k steps leads here come next. Nodes on cycles and below are left out.
    """
    inner, leaves = _peeled(_known(nodes, id_col, parent_col))
    sound = _levels(inner, leaves).where("root IS NOT NULL").select("id", F.col("first").alias("up"))
    base = nodes.groupBy(F.col(id_col).alias("id")).agg(F.sum(value).alias("total"))
    all_ = checkpointed(base.join(sound, "id").join(inner.select("id", F.lit(True).alias("inner")), "id", "left"))
    ends = all_.where("inner IS NULL")
    # A leaf is its own sum, and adds to its parent's once.
    added = ends.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("more"))
    own = all_.where("inner").join(added, "id", "left")
    rows = checkpointed(own.select("id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), "up"))
    while True:
        sums = rows.where("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(F.sum("total").alias("more"), F.count("*").alias("n_"))
        if sums.isEmpty():
            return rows.select("id", "total").unionByName(ends.select("id", "total"))
        ups = rows.select(F.col("id").alias("up"), F.col("up").alias("next"))
        hot = sums.select(F.col("id").alias("up"), "n_")
        moved = join_found(rows.where("up IS NOT NULL"), ups.join(hot, "up"), ["up"], "n_").select("id", "total", F.col("next").alias("up"))
        stay = rows.where("up IS NULL").select("id", "total", "up")
        both = stay.unionByName(moved).join(sums.select("id", "more"), "id", "left")
        rows = checkpointed(both.select("id", (F.col("total") + F.coalesce("more", F.lit(0))).alias("total"), "up"))


def paths(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", sep: str = "/") -> DataFrame:
    """``(id, level, path)``: the ids from the top down to each node, joined; a path is as long as its level.

    Whole stretches of paths are put together each round. Nodes on cycles and below are left out.
    """
    sound = levels(nodes, id_col, parent_col).where("root IS NOT NULL").select("id", "level")
    rows = checkpointed(_known(nodes, id_col, parent_col).join(sound, "id").select("id", "level", "up", F.col("id").cast("string").alias("path")))
    while not (open_ := rows.where("up IS NOT NULL")).isEmpty():
        asked = open_.groupBy("up").agg(F.count("*").alias("n_"))
        known = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("before"))
        found = join_found(open_, known.join(asked, "up"), ["up"], "n_")
        moved = found.select("id", "level", F.col("next").alias("up"), F.concat("before", F.lit(sep), "path").alias("path"))
        rows = checkpointed(rows.where("up IS NULL").unionByName(moved.select(*rows.columns)))
    return rows.select("id", "level", "path")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], start: str, keys: DataFrame) -> dict[str, DataFrame]:
    """What is left of ``tables`` once the rows of ``start`` with one of ``keys`` (first column: its key) go, and with them all that
    hangs on them.

    ``links`` are ``(child, column, parent, column)``, parents before their children. Only keys are
    joined; a child goes if any of its parents does. Null references hang on nothing.
    """
    gone = {start: tables[start].join(keys.select(F.col(keys.columns[0])).distinct(), keys.columns[0], "left_semi")}
    left = {start: tables[start].join(keys.select(F.col(keys.columns[0])).distinct(), keys.columns[0], "left_anti")}
    for child in dict.fromkeys(c for c, *_ in links):
        rest, lost = tables[child], None
        for _, column, parent, to in (x for x in links if x[0] == child):
            if parent in gone:
                dead = gone[parent].select(F.col(to).alias(column)).where(F.col(column).isNotNull()).distinct()
                part = rest.join(dead, column, "left_semi").select(*tables[child].columns)
                lost = part if lost is None else lost.unionByName(part)
                rest = rest.join(dead, column, "left_anti").select(*tables[child].columns)
        left[child] = rest
        if lost is not None:
            gone[child] = lost
    return {name: left.get(name, rows) for name, rows in tables.items()}
