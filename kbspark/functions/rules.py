"""Rules on answers, logs, accounts and permissions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType

from kbspark.operators.folds import fold

#: Fixed word lists and matrices.
HEDGES = ("可能", "大概", "或许", "也许", "似乎", "看起来", "估计", "推测")
DOC_ACTIONS = ("doc:view", "doc:upload", "doc:edit", "doc:delete")
ROLE_ACTIONS = {
    "owner": ("kb:view", "kb:edit", "kb:delete", "kb:manage_members", *DOC_ACTIONS),
    "admin": ("kb:view", "kb:edit", "kb:manage_members", *DOC_ACTIONS),
    "editor": ("kb:view", *DOC_ACTIONS),
    "viewer": ("kb:view", "doc:view"),
}
NO_ERROR = ("NO ERROR", "NO WARNING", "NO EXCEPTION", "IGNORED ERROR")
LEVELS = ("ERROR", "WARNING", "WARN", "FATAL", "CRITICAL")
LOUD = ("ERROR", "WARNING", "FATAL", "CRITICAL")
FAILS, LOCK_MINUTES = 5, 30
SCORES = {"cpu": 0.3, "memory": 0.3, "disk": 0.2, "cache": 0.2}


def without_hedges(text: Column, confidence: Column) -> Column:
    """From a confidence of 0.8 on, hedging words go and blanks collapse; else the text stays."""
    t = F.regexp_replace(text, "(?:" + "|".join(HEDGES) + ")", "")
    return F.when(confidence >= 0.8, F.trim(F.regexp_replace(t, r"\s+", " "))).otherwise(text)


def role_actions(spark: SparkSession) -> DataFrame:
    """The matrix of roles and what they may do."""
    return spark.createDataFrame([(r, a) for r, actions in ROLE_ACTIONS.items() for a in actions], "role string, action string")


def is_error_line(line: Column) -> Column:
    """Whether a log line reports an error: the lines that only mention one are told first."""
    t = F.upper(line)
    any_of = lambda parts: t.rlike("|".join(f"\\Q{p}\\E" for p in parts))
    marks = [f"{before}{level}{after}" for level in LEVELS for before, after in ((" ", " "), (" ", ":"), (" ", "]"), ("[", ""))]
    hit = any_of([*marks, "EXCEPTION", ".ERROR", ".WARN", ".FATAL", "JAVA.LANG.", "JAVA.NET.", "JAVA.IO.", "CAUSED BY:"]) | t.rlike("^(" + "|".join(LOUD) + ")")
    return F.coalesce(~any_of(NO_ERROR) & hit, F.lit(False))


def field_changes(before: Column, after: Column, fields: list[str]) -> Column:
    """``field:before>after`` of the fields of two structs of strings that differ; none where there is no state before."""
    value = lambda s, f: F.coalesce(s[f], F.lit(""))
    each = [F.when(before.isNotNull() & ~before[f].eqNullSafe(after[f]), F.concat(F.lit(f"{f}:"), value(before, f), F.lit(">"), value(after, f))) for f in fields]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def lockouts(logins: DataFrame) -> DataFrame:
    """``(user_id, id, locked)`` of ``logins(user_id, ts, id, ok)``: from the fifth failure in a row an
    account is locked for half an hour; a success resets it, attempts while locked change nothing.
    The attempts of an account pass in order."""

    def step(state: tuple[int, int], t: int, ok: bool) -> tuple[tuple[int, int], bool]:
        fails, until = state
        if t < until:
            return state, True
        fails = 0 if ok else fails + 1
        return ((0, t + LOCK_MINUTES * 60_000_000) if fails >= FAILS else (fails, 0)), False

    timed = logins.withColumn("t_", F.unix_micros(F.col("ts").cast("timestamp")))
    return fold(timed, "user_id", ["t_", "id"], ["t_", "ok"], (0, 0), step, "locked", BooleanType()).select("user_id", "id", "locked")


def log_context(lines: DataFrame, most: int, by: str = "user_id") -> DataFrame:
    """The ``most`` lines of ``lines(by, pos, priority)`` that are kept for each ``by``.

    Few lines all stay; without a priority line the last ones do. Else priority lines and those up
    to three from one stay: too many are cut to all priority lines and the nearest others, too few
    filled with the latest others.
    """
    w = W.partitionBy(by)
    order = w.orderBy("pos")
    seen = lines.withColumns({
        "n_": F.count("*").over(w), "any_": F.max(F.col("priority").cast("int")).over(w),
        "back_": F.col("pos") - F.max(F.when(F.col("priority"), F.col("pos"))).over(order),
        "ahead_": F.min(F.when(F.col("priority"), F.col("pos"))).over(order.rowsBetween(0, W.unboundedFollowing)) - F.col("pos"),
    })
    far = F.least(F.col("back_"), F.col("ahead_"))
    group = F.when(far <= 3, far).otherwise(F.lit(4))
    rank = F.row_number().over(w.orderBy(group, F.when(group == 4, -F.col("pos")).otherwise(F.col("pos"))))
    last = F.row_number().over(w.orderBy(F.desc("pos")))
    ranked = seen.withColumns({"rank_": rank, "last_": last})
    kept = F.when(F.col("n_") <= most, True).when(F.col("any_") == 0, F.col("last_") <= most).otherwise(F.col("rank_") <= most)
    return ranked.where(kept).select(*lines.columns)


def health(digits: int = 2, **shares: Column) -> Column:
    """The weighted score of ``cpu, memory, disk`` and ``cache`` use in percent; 100 is idle."""
    return F.round(sum((F.greatest(F.lit(0.0), 100 - shares[k]) * w for k, w in SCORES.items()), F.lit(0.0)), digits)


def health_label(score: Column) -> Column:
    return F.when(score >= 80, "excellent").when(score >= 60, "good").when(score >= 40, "warning").otherwise("critical")


def noise(lines: DataFrame, page: str, text: str = "text", most: int = 80) -> DataFrame:
    """``lines`` without headers and footers: texts of at most ``most`` characters that, digits and case
    apart, stand on two pages or more."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), "[0-9]", ""), r"\s+", " "))
    marked = lines.withColumn("plain_", F.when(F.length(text) <= most, plain))
    often = marked.where("plain_ IS NOT NULL").groupBy("plain_").agg(F.min(page).alias("a_"), F.max(page).alias("b_")).where("a_ <> b_").select("plain_")
    return marked.join(often, "plain_", "left_anti").drop("plain_")


def fragments(text: Column, term: str, around: int = 30, most: int = 3, size: int = 150) -> Column:
    """Up to three fragments around the places of a term, which is marked in them."""
    places = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda k: F.length(F.call_function("substring_index", text, F.lit(term), k)) + 1)
    found = F.filter(F.array_distinct(places), lambda p: p + len(term) - 1 <= F.length(text))
    cut = lambda p: F.substring(text, F.greatest(p - around, F.lit(1)), F.lit(size))
    return F.transform(found, lambda p: F.replace(cut(p), F.lit(term), F.lit(f"<mark>{term}</mark>")))
