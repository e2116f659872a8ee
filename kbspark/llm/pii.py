"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier trained on it decides."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kbspark.llm.bpe import slices
from kbspark.llm.common import cut, keyed_text, strings, table

KINDS = ("email", "ip", "card", "phone")

#: Fixed patterns of the base kinds. An address is found from its @: the part before is the run of
#: its letters up to there, the part after this one; so long runs without @ cost nothing.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){11,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Gazetteers and cue words of the labelers.
TITLES = ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "señor", "señora")
GIVEN = (
    "james", "john", "robert", "michael", "william", "david", "richard", "joseph", "thomas", "mary", "patricia",
    "jennifer", "linda", "elizabeth", "barbara", "susan", "jessica", "sarah", "karen", "hans", "peter", "wolfgang",
    "jürgen", "ursula", "sabine", "jean", "pierre", "michel", "marie", "nathalie", "isabelle", "josé", "antonio",
    "manuel", "carmen", "maría", "ana", "anna", "paul", "daniel", "maria", "emma", "laura",
)
STREETS = ("street", "st", "avenue", "ave", "road", "rd", "lane", "drive", "boulevard", "straße", "strasse", "rue", "calle")
CUES = {
    "person": ("name", "contact", "signed", "dear", "sincerely", "author", "nom", "nombre"),
    "street": ("address", "live", "lives", "residence", "adresse", "dirección", "at"),
    "ssn": ("ssn", "social", "security", "tax"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "birth": ("born", "birth", "dob", "birthday", "geboren", "né", "née", "nacido", "nacida"),
}
#: Capitalised words before a name that are no part of it.
GREETINGS = ("dear", "hello", "hi", "contact", "name", "author", "signed", "nom", "nombre")
#: Candidates of the kinds that the method adds; the group is the span.
CANDIDATES = {
    "person": re.compile(r"\b(?:(?i:" + "|".join(TITLES) + r")\.? |(?:" + "|".join(w.title() for w in GREETINGS) + r") )?([A-ZÀ-Þ][\w’'-]{1,24} [A-ZÀ-Þ][\w’'-]{1,24})\b"),
    "street": re.compile(r"\b([0-9]{1,5} (?:[A-ZÀ-Þ][\w’'-]{1,24} ){1,3}(?i:" + "|".join(STREETS) + r"))\b"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "iban": re.compile(r"\b([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?)\b"),
    "birth": re.compile(r"(?<![0-9])((?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3]?[0-9][/.][01]?[0-9][/.](?:19|20)[0-9]{2})(?![0-9])"),
}
#: Capitalised words that stand in titles, licences and addresses, not in names of persons.
NOT_NAMES = frozenset(
    "the a an and or of for in on at by to with from this that it is license licence public general apache software "
    "rights reserved copyright version university street avenue road new north south east west saint united states "
    "january february march april may june july august september october november december monday tuesday wednesday "
    "thursday friday saturday sunday der die das und ein eine le la les un une des et el los las una y".split()
)
WORD = re.compile(r"\w+")
LABELERS = ("pattern", "gazetteer", "context", "form")
NEAR = 48  # code points before a span in which the context labeler reads
#: Candidates of each kind and vote pattern that the span classifier is fitted on, about.
FIT_PER_PATTERN = 500


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        if at >= done and (m := DOMAIN.match(text, at + 1)):
            start = at
            while start > done and not NOT_LOCAL.match(text, start - 1):
                start -= 1
            if start < at:
                found.append((start, m.end()))
                done = m.end()
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the base kinds, by start and then kind."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if text.count(".") >= 3:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if len(m[0]) <= 40 and 12 <= len(number := digits(m[0])) <= 19 and luhn(number):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def iban_ok(text: str) -> bool:
    compact = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def form(kind: str, span: str) -> bool | None:
    """The form labeler: an inner check of the kind, None where it has no opinion."""
    if kind == "iban":
        return iban_ok(span)
    if kind == "ssn":
        area, group, serial = span.split("-")
        return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
    if kind == "birth":
        year = int(re.search(r"(?:19|20)[0-9]{2}", span)[0])
        return None if 1900 <= year <= 2025 else False  # most dates of today pass, so passing says nothing
    if kind == "person":
        words = [w.lower() for w in span.split()]
        return None if all(w.istitle() for w in span.split()) and len(set(words)) == len(words) else False
    return None


def vote(kind: str, titled: bool, words: list[str], cued: bool, span: str) -> tuple[int, ...]:
    """The votes of the labelers on a candidate: 1 for, -1 against, 0 for no opinion."""
    if kind == "person":
        known = 1 if any(w in GIVEN for w in words) else -1 if any(w in NOT_NAMES for w in words) else 0
        pattern = 1 if titled else 0
    else:  # a pattern that all candidates of the kind have says nothing about any of them
        known = (1 if words[-1] != "st" else 0) if kind == "street" else 0
        pattern = 0
    checked = form(kind, span)
    # Names mostly stand without any cue, the other kinds mostly with one.
    return pattern, known, 1 if cued else 0 if kind == "person" else -1, 0 if checked is None else 1 if checked else -1


def describe(kind: str, span: str, before: str, after: str, words: list[str], cue_at: int) -> list[float]:
    """Features of a span and its surroundings; those of the labelers are not among them."""
    n = len(span)
    return [
        math.log(n), len(words) / 4, sum(c.isupper() for c in span) / n, sum(c.isdigit() for c in span) / n,
        sum(map(len, words)) / max(len(words), 1) / 10, float(len(set(words)) < len(words)), float(span.isupper()),
        float(all(w[:1].isupper() or w[:1].isdigit() for w in WORD.findall(span))), float(before[-1:] in ("", "\n")),
        float(before.rstrip()[-1:] in (":", ",", "(")), float(before.rstrip()[-1:] in (".", "!", "?", "")),
        float(after[:1] in (".", ",", ")", ";", "\n", "")), 1 / (1 + cue_at) if cue_at >= 0 else 0.0,
        max((v for w in words for v in [sum(c in "aeiouyáéíóúäöüèêà" for c in w) / len(w)]), default=0.0),
    ]


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...], list[float]]]:
    """``(kind, start, end, votes, features)`` of all candidates of the added kinds in a whole text."""
    found = []
    for kind, pattern in CANDIDATES.items():
        for m in pattern.finditer(text):
            start, end = m.span(1)
            span = m[1]
            words = [w.lower() for w in WORD.findall(span)]
            before = text[max(0, start - NEAR) : start]
            near = [w.lower() for w in WORD.findall(before)][::-1]
            cue_at = next((i for i, w in enumerate(near) if w in CUES[kind]), -1)
            titled = kind == "person" and m.start() < start and text[m.start() : start - 1].lower() not in GREETINGS
            votes = vote(kind, titled, words, cue_at >= 0, span)
            found.append((kind, start, end, votes, describe(kind, span, before, text[end : end + 2], words, cue_at)))
    return found


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50, kinds: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, dict[str, float]]:
    """EM on counted vote patterns: posteriors, each labeler's accuracy where it votes, a prior for
    each kind (all of one kind where none are given).

    Every labeler is right with its own probability, alike for both classes, and independent of the
    others given the class. It starts at 0.7, the prior at 0.3, and is smoothed by ten votes of which seven are right,
    a prior by one candidate of each class, so that neither becomes certain.
    """
    kinds = kinds or [""] * len(votes)
    right, prior = np.full(votes.shape[1], 0.7), {k: 0.3 for k in kinds}
    post, of = np.zeros(len(votes)), np.array(kinds)
    for _ in range(rounds if len(votes) else 0):
        strength = np.log(right / (1 - right))
        odds = np.array([math.log(prior[k] / (1 - prior[k])) for k in kinds])
        post = 1 / (1 + np.exp(-(odds + votes @ strength)))
        for j in range(votes.shape[1]):
            v = votes[:, j]
            agree = (counts * np.where(v > 0, post, np.where(v < 0, 1 - post, 0))).sum()
            right[j] = (agree + 7) / ((counts * (v != 0)).sum() + 10)
        right = right.clip(0.55, 0.98)
        for k in prior:
            at = of == k
            prior[k] = float(((counts[at] * post[at]).sum() + 1) / (counts[at].sum() + 2))
    return post, right, prior


def design(kinds: list[str], seen: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Rows of the classifier: kind, span and surroundings, votes."""
    names = list(CANDIDATES)
    one_hot = np.array([[k == n for n in names] for k in kinds], float).reshape(-1, len(names))
    return np.hstack([one_hot, seen, votes])


def span_classifier(x: np.ndarray, soft: np.ndarray, weight: np.ndarray, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression on the EM posteriors, by Newton steps with a small ridge."""
    w, share = np.zeros(x.shape[1]), weight / max(weight.sum(), 1e-9)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        hessian = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(hessian, x.T @ (share * (soft - p)) - 1e-3 * w)
    return w


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``(doc_id, base, added)``: arrays of ``(kind, start, end)``, ``added`` with the classifier's
    ``p`` behind them; offsets in code points.

    One pass over the texts finds base spans and candidates with votes and features; what it finds is
    checkpointed, as it is small beside the texts. Vote patterns, at most kinds times 3 to the power
    of labelers, are counted over all documents, and EM runs on these counts. The classifier is fitted
    on about ``FIT_PER_PATTERN`` candidates of each pattern, chosen by a hash and weighted to stand
    for all of them, and then scores every candidate. Null and empty texts have no spans; repeated
    rows and null ids pass through one by one. Where a corpus has no candidates, nothing is added.
    """
    few = keyed_text(docs, id_col, text_col)
    kind = few.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]
        cand_type = pa.list_(pa.struct([*place, ("votes", pa.list_(pa.int32())), ("x", pa.list_(pa.float64()))]))
        for b in slices(batches):
            base, cand = [], []
            for text in strings(b.column(1)):
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text)])
                cand.append([{"kind": k, "start": s, "end": e, "votes": list(v), "x": x} for k, s, e, v, x in candidates(text)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, pa.list_(pa.struct(place))), pa.array(cand, cand_type)], ["doc_id", "base", "cand"])

    span = "kind: string, start: long, end: long"
    seen = cut(few.mapInArrow(run, f"doc_id {kind}, base array<struct<{span}>>, cand array<struct<{span}, votes: array<int>, x: array<double>>>"))
    each = seen.select("doc_id", F.explode("cand").alias("c"))
    counted = sorted(each.groupBy("c.kind", "c.votes").count().collect(), key=lambda r: (r["kind"], r["votes"]))
    if not counted:
        return seen.select("doc_id", "base", F.expr(f"CAST(array() AS array<struct<{span}, p: double>>)").alias("added"))
    votes, counts = np.array([r["votes"] for r in counted], float), np.array([r["count"] for r in counted], float)
    post, _, _ = reliabilities(votes, counts, kinds=[r["kind"] for r in counted])
    number = {(r["kind"], tuple(r["votes"])): i for i, r in enumerate(counted)}
    # At most so many of each pattern, by a hash of the place; a row's own number parts repeated rows.
    rows_ = seen.select("doc_id", F.monotonically_increasing_id().alias("row"), F.explode("cand").alias("c"))
    order = W.partitionBy("c.kind", "c.votes").orderBy(F.xxhash64("doc_id", "c.start", "c.end", "c.kind"), F.xxhash64("row"))
    drawn_ = rows_.withColumn("place", F.row_number().over(order)).where(F.col("place") <= FIT_PER_PATTERN)
    sample = drawn_.select("c.kind", "c.votes", "c.x").collect()
    which = np.array([number[r["kind"], tuple(r["votes"])] for r in sample])
    x = design([r["kind"] for r in sample], np.array([r["x"] for r in sample]), np.array([r["votes"] for r in sample], float))
    drawn = np.bincount(which, minlength=len(counts))
    w = span_classifier(x, post[which], counts[which] / drawn[which]).tolist()

    def p(c: Column) -> Column:
        kinds = F.create_map(*[F.lit(v) for pair in zip(CANDIDATES, w, strict=False) for v in pair])
        values = F.concat(c["x"], c["votes"].cast("array<double>"))
        terms = F.zip_with(values, F.array(*[F.lit(v) for v in w[len(CANDIDATES) :]]), lambda a, b: a * b)
        return 1 / (1 + F.exp(-F.aggregate(terms, kinds[c["kind"]], lambda a, b: a + b)))

    marked = F.transform("cand", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), p(c).alias("p")))
    return seen.select("doc_id", "base", F.filter(marked, lambda c: c["p"] >= threshold).alias("added"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of the base spans of each document, and all spans, the method's included."""
    found = find(table(spark, sf_dir, "documents"))
    rank = F.array(*[F.lit(k) for k in (*KINDS, *CANDIDATES)])
    of_kind = lambda k: lambda s: s["kind"] == k
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    place = lambda s: F.struct(s["start"].alias("at"), F.array_position(rank, s["kind"]).alias("k"), s["end"].alias("to"), s["kind"].alias("kind"))
    joined = F.array_sort(F.concat(F.transform("base", place), F.transform("added", place)))
    everything = F.array_join(F.transform(joined, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["to"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *[F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", text), ","), 256).alias("base_sha256"),
        everything.alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
