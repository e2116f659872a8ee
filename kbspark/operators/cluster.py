"""Rules, joins and state on cluster resources, metrics and logs."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import BooleanType

from kbspark.operators.folds import fold

#: Fixed names and limits of the rules.
OWNERS = ("deployment", "statefulset", "daemonset")
UNHEALTHY, WAITING = ("pending", "failed", "unknown"), ("CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull")
CPU, MEMORY, RESTARTS = 0.8, 1.5 * 1024**3, 1.0
PRESSURES = ("MemoryPressure", "DiskPressure", "PIDPressure")
FULL_WINDOW_SECONDS = 300


def selected(services: DataFrame, pods: DataFrame) -> DataFrame:
    """``(namespace, service, pod)`` of ``services(namespace, service, selector)`` and
    ``pods(namespace, pod, labels)``: all pairs of a selector are among the pod's labels; an empty
    selector matches nothing.

    Pods join on one pair, the selector's least, by hash; the others are checked on the joined rows.
    """
    pairs = services.where(F.size("selector") > 0).withColumn("pair", F.array_sort(F.map_entries("selector"))[0])
    offered = pods.select("namespace", "pod", "labels", F.explode(F.map_entries("labels")).alias("pair"))
    both = pairs.join(offered, ["namespace", "pair"])
    holds = F.forall(F.map_entries("selector"), lambda e: F.coalesce(F.try_element_at("labels", e["key"]) == e["value"], F.lit(False)))
    return both.where(holds).select("namespace", "service", "pod")


def owners(pods: DataFrame, resources: DataFrame) -> DataFrame:
    """``(pod, kind, owner, ...)``: the owners of ``pods(namespace, pod, owner_refs)`` that are one of the
    three kinds, with their row of ``resources(namespace, kind, owner, ...)``."""
    refs = pods.select("namespace", "pod", F.explode("owner_refs").alias("r")).select("namespace", "pod", F.lower("r.kind").alias("kind"), F.col("r.name").alias("owner"))
    return refs.where(F.col("kind").isin(*OWNERS)).join(resources, ["namespace", "kind", "owner"])


def references(spec: Column) -> tuple[Column, Column]:
    """Names of the config maps and secrets that a pod's volumes and containers name, sorted, once each."""
    env = F.flatten(F.transform(F.coalesce(spec["containers"], F.array()), lambda c: F.coalesce(c["envFrom"], F.array())))
    volumes = F.coalesce(spec["volumes"], F.array())

    def names(of_volume: Column, of_env: Column) -> Column:
        return F.array_sort(F.array_distinct(F.filter(F.concat(of_volume, of_env), lambda n: n.isNotNull())))

    maps = names(F.transform(volumes, lambda v: v["configMap"]["name"]), F.transform(env, lambda e: e["configMapRef"]["name"]))
    return maps, names(F.transform(volumes, lambda v: v["secret"]["secretName"]), F.transform(env, lambda e: e["secretRef"]["name"]))


def _found(*rules: tuple[Column, Column | str]) -> Column:
    each = [F.when(F.coalesce(test, F.lit(False)), F.lit(name) if isinstance(name, str) else name) for test, name in rules]
    return F.filter(F.array(*each), lambda r: r.isNotNull())


def pod_rules(phase: Column, waiting: Column, cpu: Column, memory: Column, restarts: Column, log: Column) -> Column:
    """The rules that a pod breaks, as an array of names. ``waiting`` is an array of reasons."""
    text = F.lower(log)
    reasons = F.transform(F.filter(F.array_distinct(F.coalesce(waiting, F.array().cast("array<string>"))), lambda r: r.isin(*WAITING)), lambda r: F.concat(F.lit("POD_"), F.upper(r)))
    return F.concat(
        _found((F.lower(phase).isin(*UNHEALTHY), "POD_UNHEALTHY")),
        reasons,
        _found(
            (cpu > CPU, "HIGH_CPU_USAGE"), (memory > MEMORY, "HIGH_MEMORY_USAGE"), (restarts > RESTARTS, "RESTART_LOOP"),
            (text.contains("oom") | text.contains("out of memory"), "LOG_OOM"), (text.contains("crashloop") | text.contains("back-off"), "LOG_CRASH_LOOP"),
        ),
    )


def node_rules(conditions: Column, cpu: Column) -> Column:
    """The rules that a node breaks; ``conditions`` is a map of condition to status."""
    status = lambda c: F.lower(F.try_element_at(conditions, F.lit(c)))
    ready = (status("Ready") != "true", "NODE_NOT_READY")
    return _found(ready, *[(status(p) == "true", f"NODE_{p.upper()}") for p in PRESSURES], (cpu > CPU, "NODE_HIGH_CPU"))


def service_rules(connections: Column) -> Column:
    return _found((connections == 0, "SERVICE_NO_CONNECTIONS"))


def deployment_rules(desired: Column, ready: Column) -> Column:
    return _found((F.coalesce(ready, F.lit(0)) < desired, "DEPLOYMENT_REPLICAS_NOT_READY"))


#: Fixed advice by rule.
ADVICE = {
    "POD_CRASHLOOPBACKOFF": "check the logs of the last start and the start command",
    "POD_IMAGEPULLBACKOFF": "check the image's name, tag and pull secret",
    "POD_ERRIMAGEPULL": "check the image's name, tag and pull secret",
    "HIGH_CPU_USAGE": "raise the limit or spread the load",
    "HIGH_MEMORY_USAGE": "raise the limit or look for a leak",
    "RESTART_LOOP": "check probes and exit codes",
    "LOG_OOM": "raise the memory limit",
    "NODE_NOT_READY": "check the node's agent and network",
}


def advised(findings: DataFrame) -> DataFrame:
    """``findings`` with ``advice`` for their ``rule``, null where there is none."""
    table = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    return findings.withColumn("advice", F.try_element_at(table, "rule"))


def counter_rate(samples: DataFrame, width: str, by: list[str], ts: str = "ts", value: str = "value") -> DataFrame:
    """``(by, start, rate)``: the increase a second of counters within tumbling windows; after a reset
    the whole new value counts."""
    before = F.lag(value).over(W.partitionBy(*by).orderBy(ts, value))
    up = F.when(F.col(value) >= before, F.col(value) - before).when(before.isNotNull(), F.col(value)).otherwise(F.lit(0.0))
    seen = samples.withColumn("up_", up).groupBy(*by, F.window(F.col(ts), width).alias("w"))
    seconds = F.unix_timestamp(F.col("w.end").cast("timestamp")) - F.unix_timestamp(F.col("w.start").cast("timestamp"))
    return seen.agg(F.sum("up_").alias("u")).select(*by, F.col("w.start").alias("start"), (F.col("u") / seconds).alias("rate"))


def expand(template: str, context: dict[str, object]) -> str:
    """A query template with its named places filled; a missing name is an error that lists all such."""
    names = [name for _, name, _, _ in string.Formatter().parse(template) if name]
    if missing := [n for n in names if n not in context]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return template.format(**context)


def run_template(spark: SparkSession, sql: str, names: list[str], context: dict[str, object]) -> DataFrame:
    """A SQL template with ``:name`` parameters, which are bound, not pasted."""
    if missing := [n for n in names if n not in context]:
        raise ValueError(f"missing parameters: {', '.join(missing)}")
    return spark.sql(sql, args={n: context[n] for n in names})


def incremental(last_sync: Column, now: Column, interval_seconds: Column, version: Column, forced: Column | None = None) -> Column:
    """Whether a sync may be incremental: it has a cursor, is not forced, and the last one is younger than
    five minutes and a third of the interval."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last_sync.cast("timestamp"))
    young = age < F.least(F.lit(float(FULL_WINDOW_SECONDS)), interval_seconds / 3)
    return F.coalesce(young & version.isNotNull() & ~F.coalesce(forced if forced is not None else F.lit(False), F.lit(False)), F.lit(False))


def drift(before: Column, after: Column) -> Column:
    """``array<struct<field, before, after>>``: resources and environment of the first container that differ."""
    one = lambda s, f: F.coalesce(F.to_json(F.get(s["containers"], F.lit(0))[f]), F.lit("null"))
    each = [F.when(one(before, f) != one(after, f), F.struct(F.lit(f).alias("field"), one(before, f).alias("before"), one(after, f).alias("after"))) for f in ("resources", "env")]
    return F.filter(F.array(*each), lambda d: d.isNotNull())


def final_confidence(first: Column, knowledge: Column, has_refs: Column, extended: Column, web: Column, computed: Column, least: float = 0.8) -> Column:
    """The confidence of the first stage that is sure enough, else of the first that has any, else the computed one."""
    c = lambda x: F.coalesce(x, F.lit(0.0))
    return (
        F.when(c(first) >= least, first).when(has_refs & (c(knowledge) >= least), knowledge).when(c(extended) >= least, extended)
        .when(c(web) > 0, web).when(c(first) > 0, first).when(c(extended) > 0, extended).otherwise(computed)
    )


def claim(requests: DataFrame, seconds: int = 600) -> DataFrame:
    """``requests(key, ts, id)`` with ``granted``: a keyed lock is held for ``seconds`` from each grant.
    Grants follow one another, so each key's requests pass in order."""
    wait = seconds * 1_000_000

    def step(until: int | None, t: int) -> tuple[int | None, bool]:
        granted = until is None or t >= until
        return (t + wait if granted else until), granted

    timed = requests.withColumn("t_", F.unix_micros(F.col("ts").cast("timestamp")))
    return fold(timed, "key", ["t_", "id"], ["t_"], None, step, "granted", BooleanType()).drop("t_")


def cached(requests: DataFrame, seconds: int = 300) -> DataFrame:
    """``requests(params, ts, id)`` with the ``cache_key`` of their parameters and ``hit``: an answer is
    held for ``seconds`` from the request that made it."""
    made = claim(requests.withColumn("key", F.sha2("params", 256)), seconds)
    return made.withColumnRenamed("key", "cache_key").withColumn("hit", ~F.col("granted")).drop("granted")


def limited(requests: DataFrame, most: int, seconds: int = 3600) -> DataFrame:
    """``requests(key, ts, id)`` with ``limited``: more than ``most`` since the counter of the key began; it
    begins with a request and is forgotten ``seconds`` later."""
    wait = seconds * 1_000_000

    def step(state: tuple[int, int] | None, t: int) -> tuple[tuple[int, int], bool]:
        begun, n = (t, 1) if state is None or t >= state[0] + wait else (state[0], state[1] + 1)
        return (begun, n), n > most

    timed = requests.withColumn("t_", F.unix_micros(F.col("ts").cast("timestamp")))
    return fold(timed, "key", ["t_", "id"], ["t_"], None, step, "limited", BooleanType()).drop("t_")
