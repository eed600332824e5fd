"""URL filters by host and path prefix, as a range join with a sorted sweep.

A host is keyed by its labels from the top one down, each followed by a dot (``m.example.net`` is ``net.example.m.``), so
a rule for a host and all its subdomains is an interval of keys: those that begin with the rule's. Intervals of prefixes
nest or are apart. Points and the ends of intervals are sorted once over the cluster; a running sum of starts and ends gives
the depth of nested rules at every place, and the rule on each level of the stack is the last start of that level
before it. Levels that were opened in an earlier partition come from a table of the last start per partition and level.

Two sweeps judge a URL: one over distinct hosts finds the stack of rule hosts that are active there; one over (rule host,
path) finds for each of these the innermost rule whose path begins the URL's path. The longest rule wins.

URLs fold to distinct (host, path) before anything is sorted, and verdicts come back to the rows by ``lookup.attach``, so a host
or URL that many rows share is no task of its own. Range partitions split by key and a hash, whatever the host. Everything
is column expressions; the sorted rows are written before they are numbered, so a lost executor changes nothing.

Defined results: the host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z
lowered; ports and user names are part of it. The path goes on up to ``?``, ``#`` or the end and may be empty, and an empty path
begins with no rule but one of an empty path. A null URL or one without ``://`` has an empty host and path. Of two rules of equal
length that fit one URL the one with the longer host wins; of rules that are equal a block wins; rules without a host are left
out. Repeated rows are judged alike. Columns named like an output column are replaced, others pass. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from works_risk.llm.tiles import written
from works_risk.operators.lookup import attach

ALLOW, BLOCK = "allow", "block"
OUTPUT = ("host", "path", "rule", "verdict")
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Kinds of places in the order in which they count at one key.
_END, _START, _POINT = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), F.lit("")), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def host_key(host: Column) -> Column:
    """The labels of a host from the top one down, each with a dot behind it."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) rules as a table."""
    made = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("verdict", "host", "path"), rule, strict=True)]) for rule in rules])
    return spark.range(1).select(F.inline(made))


def sweep(points: DataFrame, intervals: DataFrame, whole_stack: bool) -> DataFrame:
    """The active intervals at each point: (point, interval, level), all of the stack or the innermost only.

    ``points`` (key string, point) and ``intervals`` (key string, interval); an interval covers the keys that begin with its
    own. Keys of intervals are distinct.
    """
    key = F.encode(F.make_valid_utf8("key"), "utf-8")
    past = F.concat(key, F.unhex(F.lit("ff")))  # no UTF-8 text that begins with the key sorts behind this
    p_type, i_type = points.schema["point"].dataType, intervals.schema["interval"].dataType
    no_point, no_interval = F.lit(None).cast(p_type).alias("point"), F.lit(None).cast(i_type).alias("interval")

    def places(of: DataFrame, at: Column, kind: int, *ids: Column) -> DataFrame:
        return of.select(at.alias("key"), F.lit(kind).alias("kind"), *ids)

    every = (
        places(points, key, _POINT, F.col("point"), no_interval)
        .unionAll(places(intervals, key, _START, no_point, F.col("interval")))
        .unionAll(places(intervals, past, _END, no_point, no_interval))
        .withColumn("tie", F.xxhash64("point"))
    )
    order = ["key", "kind", "tie"]
    laid = every.repartitionByRange(*order).sortWithinPartitions(*order)
    step = F.when(F.col("kind") == _START, 1).when(F.col("kind") == _END, -1).otherwise(0)
    laid = laid.select("kind", "point", "interval", step.alias("step"), F.spark_partition_id().alias("part"))
    laid = written(laid.withColumn("at", F.monotonically_increasing_id()), "sweep-places")

    # Depth: the starts and ends so far, in this partition and in all before it (one row per partition).
    sums = laid.groupBy("part").agg(F.sum("step").alias("sum"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    open_before = sums.select("part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("open"))
    so_far = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    deep = laid.join(F.broadcast(open_before), "part")
    deep = deep.withColumn("depth", (F.col("open") + F.sum("step").over(so_far)).cast("int"))

    # Starts offer their interval on their level; points ask on the levels of the stack below them.
    deep = deep.filter((F.col("kind") != _END) & (F.col("depth") > 0))
    asked = F.when(F.col("kind") == _START, F.array("depth"))
    asked = asked.otherwise(F.sequence(F.lit(1), F.col("depth")) if whole_stack else F.array("depth"))
    levels = deep.select("part", "at", "kind", "point", "interval", F.explode(asked).alias("level"))
    levels = written(levels, "sweep-levels")

    lasts = levels.groupBy("part", "level").agg(F.max_by("interval", F.when(F.col("kind") == _START, F.col("at"))).alias("last"))
    parts_before = Window.partitionBy("level").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = lasts.select("part", "level", F.last("last", ignorenulls=True).over(parts_before).alias("carried"))
    here = Window.partitionBy("part", "level").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = levels.withColumn("here", F.last("interval", ignorenulls=True).over(here)).filter(F.col("kind") == _POINT)
    return met.join(carried, ["part", "level"]).select("point", F.coalesce("here", "carried").alias("interval"), "level")


def judge(pages: DataFrame, rules: DataFrame, default: str = ALLOW, url: str = "url") -> DataFrame:
    """``pages`` with host, path, the winning rule (host and path as one text, or null) and the verdict.

    ``rules`` (verdict, host, path).
    """
    host = F.translate("host", _UPPER, _UPPER.lower())
    book = rules.filter(F.col("host").isNotNull()).select("verdict", host.alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    book = book.groupBy("host", "path").agg(F.max(F.col("verdict") == BLOCK).alias("blocks"))
    book = written(book, "url-rules")

    columns = [c for c in pages.columns if c.lower() not in OUTPUT]
    own = pages.select(*[F.col(f"`{c}`") for c in columns])
    own = own.withColumns({"host": host_of(F.col(f"`{url}`")), "path": path_of(F.col(f"`{url}`"))})
    # A host has no "/" and a path begins with one or is empty, so both together still tell them apart.
    own = own.withColumn("place", F.concat("host", "path"))
    places = own.groupBy("place").agg(F.first("host").alias("host"), F.first("path").alias("path"), F.count(F.lit(1)).alias("n"))
    places = written(places, "url-places")

    # Sweep 1: the rule hosts that cover each host.
    hosts = places.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    points = hosts.select(host_key(F.col("host")).alias("key"), F.col("host").alias("point"))
    covers = book.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("interval"))
    active = sweep(points, covers, whole_stack=True).groupBy("point").agg(F.collect_list("interval").alias("stack"))
    hosts = written(hosts.join(active, F.col("host") == F.col("point"), "left").select("host", "n", "stack"), "url-hosts")

    # Sweep 2: of each such rule host the innermost rule for the path.
    met = attach(places.select("place", "host", "path"), hosts, "host", F.xxhash64("place"))
    in_host = lambda h: F.concat(host_key(h), F.lit("/"), F.col("path"))
    probes = met.select("place", "path", F.explode("stack").alias("rule_host"))
    probes = probes.select(in_host(F.col("rule_host")).alias("key"), F.col("place").alias("point"))
    fits = book.select(in_host(F.col("host")).alias("key"), F.struct("host", "path", "blocks").alias("interval"))
    found = sweep(probes, fits, whole_stack=False)
    rule = F.concat("interval.host", "interval.path")
    best = found.groupBy("point").agg(
        F.max(F.struct(F.length(rule).alias("size"), F.length("interval.host").alias("host_size"), rule.alias("rule"), F.col("interval.blocks").alias("blocks"))).alias("best")
    )
    facts = places.select("place", "n").join(best, F.col("place") == F.col("point"), "left").select("place", "n", "best.rule", "best.blocks")
    judged = attach(own, written(facts, "url-verdicts"), "place", F.xxhash64(*[F.col(f"`{c}`") for c in columns]))
    verdict = F.when(F.col("blocks"), BLOCK).when(~F.col("blocks"), ALLOW).otherwise(default)
    return judged.select(*[F.col(f"`{c}`") for c in columns], "host", "path", "rule", verdict.alias("verdict"))
