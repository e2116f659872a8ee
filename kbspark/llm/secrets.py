"""Secret scanning: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

import json
import math
import random
import re
import string
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark.llm.bpe import slices, vocabulary
from kbspark.llm.common import strings, table

#: Shapes of candidates: a run of key characters of this length with letters and digits in it, with
#: padding behind; or whatever is assigned to a name with a secret word in it, from a lower length.
LEAST, LEAST_ASSIGNED = 16, 6
CANDIDATE = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{%d,}={0,2}" % LEAST)
ASSIGNED = re.compile(
    r"(?i:passwor[dt]|passwd|pwd|secret|token|api_?key|credential)[\w-]{0,20}[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>,;]{%d,})"
    % LEAST_ASSIGNED
)
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
WORD, CASE_RISES = re.compile(r"[a-z]+"), re.compile(r"([a-z])([A-Z])")

#: Words that stand near secrets, words that stand near other random strings, and words of names.
NEAR_SECRET = ("token", "secret", "key", "apikey", "api", "password", "passwd", "pwd", "auth", "bearer", "credential", "private", "access")
NEAR_OTHER = ("commit", "sha", "md5", "checksum", "digest", "uuid", "guid", "hash", "etag", "revision", "image", "id", "version", "example", "sample", "placeholder", "dummy")
NAMES = (
    "account", "admin", "application", "article", "background", "button", "change", "class", "client", "code", "color",
    "config", "content", "data", "default", "document", "element", "error", "example", "file", "form", "function", "header",
    "html", "image", "index", "input", "item", "key", "label", "library", "link", "list", "main", "message", "module",
    "name", "number", "object", "output", "page", "password", "path", "placeholder", "port", "process", "project",
    "property", "public", "query", "request", "response", "result", "sample", "script", "secret", "server", "service",
    "session", "size", "source", "start", "string", "style", "system", "table", "template", "test", "text", "time",
    "title", "token", "type", "update", "user", "value", "version", "view", "window", "your",
)
RISKY_PATH, TAME_PATH = re.compile(r"(?i)\.env|config|settings|credential|deploy|\.ya?ml|\.ini|\.tf"), re.compile(r"(?i)test|example|sample|docs?/|fixture|mock|\.md|lock")
#: Code points before and after a candidate in which neighbouring words are read.
BEFORE, AFTER = 40, 20
#: Lengths of the dictionary's words; they are those of the public tokenizer's vocabulary.
SHORTEST, LONGEST = 4, 14

#: The forest, and how many labelled findings it is fitted on at most.
TREES, DEPTH, LEAF, MOST_FINDINGS = 40, 8, 4, 20_000
KEEP_FROM = 0.5


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


@lru_cache(maxsize=2)
def dictionary(path: str) -> frozenset[str]:
    """The whole words in ASCII letters of a tokenizer's vocabulary."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ends = model["end_of_word_suffix"]
    words = (t[: -len(ends)] for t in model["vocab"] if t.endswith(ends))
    return frozenset(w for w in words if SHORTEST <= len(w) <= LONGEST and WORD.fullmatch(w))


def coverage(run: str) -> tuple[float, float, float]:
    """How dictionary words cover the letters of a candidate, from the left and longest first, words
    also ending where the case rises: their share, that of the longest, and the letters in none by
    word found."""
    words, letters, found = dictionary(vocabulary()), 0, []
    for part in WORD.findall(CASE_RISES.sub(r"\1 \2", run).lower()):
        letters, at = letters + len(part), 0
        while at < len(part):
            n = next((k for k in range(min(LONGEST, len(part) - at), SHORTEST - 1, -1) if part[at : at + k] in words), 0)
            found += [n] * bool(n)
            at += max(n, 1)
    covered = sum(found)
    return (covered / letters, max(found, default=0) / letters, (letters - covered) / (1 + len(found))) if letters else (0.0, 0.0, 0.0)


def features(run: str, before: str, after: str, path: str) -> list[float]:
    lower = run.lower()
    kinds = [kind(c) for c in run]
    share = [kinds.count(k) / len(run) for k in range(4)]
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (len(run) - 1)
    counts = Counter(run)
    entropy = -sum(n / len(run) * math.log2(n / len(run)) for n in counts.values())
    pairs = Counter(zip(lower, lower[1:], strict=False))
    vowels = sum(c in "aeiou" for c in lower) / max(1, sum(c.isalpha() for c in lower))
    near = WORD.findall((before + " " + after).lower())
    return [
        math.log(len(run)), *share, moves, entropy, len(pairs) / (len(run) - 1), vowels, *coverage(run),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", run))), float(len(run) in (32, 40, 64, 128)), float(run.count("-")),
        float(sum(any(w.endswith(k) for k in NEAR_SECRET) for w in near)), float(sum(w in NEAR_OTHER for w in near)),
        float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and before != ""),
        float(bool(RISKY_PATH.search(path))), float(bool(TAME_PATH.search(path))),
    ]


def candidates(text: str, path: str) -> list[tuple[int, int, list[float]]]:
    """``(start, end, features)`` of all candidates of a text, those of the two shapes that overlap once."""
    places = []
    for m in CANDIDATE.finditer(text):
        run = m[0].rstrip("-/")
        if len(run) >= LEAST and DIGIT.search(run) and LETTER.search(run):
            places.append((m.start(), m.start() + len(run)))
    runs = len(places)
    for m in ASSIGNED.finditer(text):
        a, b = m.start(1), m.start(1) + len(m[1].rstrip(".)]}"))
        if b - a >= LEAST_ASSIGNED:
            i = bisect_left(places, (a, 0), 0, runs)
            if not any(x < b and a < y for x, y in places[max(0, i - 1) : min(runs, i + 1)]):
                places.append((a, b))
    found = []
    for a, b in sorted(places):
        found.append((a, b, features(text[a:b], text[max(0, a - BEFORE) : a], text[b : b + AFTER], path)))
    return found


#: Makers of the values of synthetic findings, by family: ``r`` draws, ``t(alphabet, n)`` a text.
ALNUM, HEX = string.ascii_letters + string.digits, "0123456789abcdef"
SECRET_FAMILIES = {
    "cloud": lambda r, t: "AKIA" + t(string.ascii_uppercase + string.digits, 16),
    "forge": lambda r, t: r.choice(("ghp_", "gho_", "glpat-")) + t(ALNUM, r.choice((20, 36))),
    "payment": lambda r, t: r.choice(("sk_live_", "rk_live_")) + t(ALNUM, 24),
    "chat": lambda r, t: "xoxb-" + t(string.digits, 12) + "-" + t(ALNUM, 24),
    "maps": lambda r, t: "AIza" + t(ALNUM + "_-", 35),
    "hex": lambda r, t: t(HEX, r.choice((32, 40, 64))),
    "base64": lambda r, t: t(ALNUM + "+/", r.choice((22, 40, 43))) + r.choice(("", "=", "==")),
    "alnum": lambda r, t: t(ALNUM, r.randint(18, 48)),
    "password": lambda r, t: "".join(r.sample(t(string.ascii_letters, r.randint(5, 9)) + t(string.digits, 2) + t("!$%&*?#@", 2), k=9)),
    "token_pair": lambda r, t: "eyJ" + t(ALNUM, r.randint(30, 60)),
}
OTHER_FAMILIES = {
    "uuid": lambda r, t: str(uuid.UUID(int=r.getrandbits(128))),
    "digest": lambda r, t: t(HEX, r.choice((32, 40, 64))),
    "kebab": lambda r, t: "-".join(r.choices(NAMES, k=3)) + str(r.randint(1, 99)),
    "snake": lambda r, t: "_".join(r.choices(NAMES, k=4)) + "_" + str(r.randint(0, 9)),
    "camel": lambda r, t: "".join(w.title() for w in r.choices(NAMES, k=4)) + str(r.randint(0, 99)),
    "filler": lambda r, t: r.choice(("x", "0a", "abc123")) * r.randint(8, 20) + "1",
    "hint": lambda r, t: r.choice(("your_", "insert_", "my_")) + r.choice(NAMES) + r.choice(("_token_here1", "_key_goes_here2", "_0000_value")),
    "prose": lambda r, t: t(string.ascii_lowercase, r.randint(14, 24)) + str(r.randint(0, 99)),
    "time": lambda r, t: f"{r.randint(2000, 2030)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{t(string.digits, 7)}",
    "path": lambda r, t: "/".join(r.choices(NAMES, k=4)) + f"/v{r.randint(1, 9)}",
    "word": lambda r, t: r.choice(NAMES) + r.choice(("", "s", "_value", "()", ".get")),
}


def labelled_findings(n: int = 6_000, seed: int = 11, secret: tuple[str, ...] = tuple(SECRET_FAMILIES), other: tuple[str, ...] = tuple(OTHER_FAMILIES)) -> list[tuple[str, str, int]]:
    """Synthetic labelled findings ``(text, path, is_secret)`` of the named families: keys in their
    usual company, and look-alikes, a third of which stand where a secret would."""
    r = random.Random(seed)
    t = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    filler = lambda: " ".join(t(string.ascii_lowercase, r.randint(2, 9)) for _ in range(r.randint(2, 6)))
    assigned = ("{n} = '{s}'", "{n}: {s}", '"{n}": "{s}"', "export {n}={s}", "{n}={s}", "--{n} {s}", "{n} = \"{s}\"")
    out = []
    for i in range(n):
        family = r.choice(secret if i % 2 else other)
        value = (SECRET_FAMILIES if i % 2 else OTHER_FAMILIES)[family](r, t)
        alone = family in ("cloud", "forge", "payment", "chat", "maps") and r.random() < 0.3
        # A value that looks random either way is told by its company alone.
        tempting = family not in ("uuid", "digest") and r.random() < 0.33
        if i % 2 and not alone or tempting or family == "word":
            name = r.choice(("", "app_", "db_", "service_")) + r.choice(NEAR_SECRET)
            name, form = r.choice((name, name.upper())), r.choice(assigned)
        else:
            name, form = r.choice(NEAR_OTHER), r.choice(("{n} {s}", "{n}: {s}", '{n} = "{s}"', "see {s}", "{s}", "({s})", 'class="{s}"'))
        risky = r.random() < (0.5 if i % 2 else 0.2)
        path = r.choice(("app/config.py", ".env", "deploy/settings.yml") if risky else ("tests/test_app.py", "docs/readme.md", "main.c", "crawl", ""))
        out.append((f"{filler()} {form.format(n=name, s=value)} {filler()}", path, i % 2))
    return out


class Forest:
    """A random forest for two classes: bootstrap rows, random features at each split, Gini gain."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            self.trees.append(self._grow(x[rows], y[rows], depth, leaf, rng))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, leaf: int, rng: np.random.Generator):
        share = float(y.mean())
        if depth == 0 or len(y) < 2 * leaf or share in (0.0, 1.0):
            return share
        best = (1e-9, None, None)
        for f in rng.choice(x.shape[1], max(1, int(x.shape[1] ** 0.5)), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(y))
            p, q = ones[:-1] / n, (ones[-1] - ones[:-1]) / (len(y) - n)
            gain = share * (1 - share) - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
            gain[(v[1:] <= v[:-1]) | (n < leaf) | (len(y) - n < leaf)] = 0
            at = int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], int(f), float((v[at] + v[at + 1]) / 2))
        if best[1] is None:
            return share
        left = x[:, best[1]] <= best[2]
        return best[1], best[2], self._grow(x[left], y[left], depth - 1, leaf, rng), self._grow(x[~left], y[~left], depth - 1, leaf, rng)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            stack = [(tree, np.arange(len(x)))]
            while stack:
                node, rows = stack.pop()
                if not len(rows):
                    continue
                if isinstance(node, float):
                    total[rows] += node
                else:
                    left = x[rows, node[0]] <= node[1]
                    stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return total / len(self.trees)


def fit(findings: list[tuple[str, str, int]]) -> Forest:
    """A forest on labelled findings; each must hold one candidate, which the label is about."""
    x, y = [], []
    for text, path, label in findings[:MOST_FINDINGS]:
        for _, _, row in candidates(text, path)[:1]:
            x.append(row)
            y.append(label)
    return Forest(np.array(x), np.array(y, float))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return fit(labelled_findings())


def scan(docs: DataFrame, forest: Forest | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", keep_from: float = KEEP_FROM) -> DataFrame:
    """``(doc_id, n_candidates, n_secrets, findings)`` for each row; no shuffle.

    ``findings`` are ``(start, end, score)`` in code points of the candidates that the forest keeps.
    Without a forest, one is fitted on the labelled findings above and sent along. Null and empty
    texts have none, a null path counts as empty; repeated rows and null ids pass one by one.
    """
    few = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(path_col).cast("string").alias("path"))

    model = forest or default_forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for b in slices(batches):
            each = [candidates(t, p) for t, p in zip(strings(b.column(1)), strings(b.column(2)), strict=True)]
            flat = [row for c in each for *_, row in c]
            score = iter(model.predict(np.array(flat)).tolist() if flat else [])
            kept = [[{"start": a, "end": e, "score": s} for (a, e, _), s in zip(c, score) if s >= keep_from] for c in each]  # noqa: B905
            cols = [pa.array([len(c) for c in each], pa.int64()), pa.array([len(k) for k in kept], pa.int64()), pa.array(kept, found_type)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_candidates", "n_secrets", "findings"])

    name = few.schema["doc_id"].dataType.simpleString()
    return few.mapInArrow(run, f"doc_id {name}, n_candidates long, n_secrets long, findings array<struct<start: long, end: long, score: double>>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and places of the candidates that the forest keeps in each document, and the highest score."""
    found = scan(table(spark, sf_dir, "documents"))
    place = lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))
    return found.select(
        "doc_id", "n_candidates", "n_secrets", F.array_join(F.transform("findings", place), ",").alias("secrets"),
        F.coalesce(F.array_max(F.transform("findings", lambda s: s["score"])), F.lit(0.0)).alias("score"),
    )
