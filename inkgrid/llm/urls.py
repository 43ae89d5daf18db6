"""URL filters: rules for hosts and paths, the longest that fits decides. DataFrame functions only.

The key of a host has its labels in reverse order, each with a dot behind it, so a rule's host is a prefix of the keys of all hosts it fits: an interval of keys. Within a
host, a rule's path is a prefix of the paths it fits: an interval of paths. Intervals of one kind are nested or apart. A sweep in key order keeps a stack of the
active ones, which changes only at their ends. The first sweep gives each host of a page the stack of the rules' hosts around it, outermost first; the second gives each path
below each of these hosts the rule on top of the stack there. The longest rule so found decides.

A sweep is a sort: points and ends are dealt by ranges of keys, a point takes the last end before it in its range, or what the ranges before left open. Ranges
are cut by number of rows, within a host or a path too, so no key is too much for one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkgrid.llm.common import keep

RULES = "host string, path string, verdict string"
_TOP = "struct<n:int,host:int,rule:string,verdict:string>"


def _lower(c: F.Column) -> F.Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host: what follows the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end. Both empty if
    the url is null or has no ://."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*", 0)
    path = F.regexp_extract(F.coalesce(rest, F.lit("")), r"^[^/?#]*([^?#]*)", 1)
    return _lower(host), path


def reversed_host(host: F.Column) -> F.Column:
    """Labels in reverse order, with commas: com,example,www."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ",")


def host_key(host: F.Column) -> F.Column:
    """Labels in reverse order, each with a dot behind it: com.example.www. (a dot can't stand in a label, so prefixes are parents)."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _end(c: F.Column) -> F.Column:
    """The end of a prefix's interval: UTF-8 has no byte FF."""
    return F.concat(c.cast("binary"), F.expr("X'FF'"))


def around(intervals: DataFrame, group: list[str], start: str) -> DataFrame:
    """intervals: prefixes (`start`, all different) in groups. Adds up: the next prefix around each, null for the outermost ones.

    In the order of starts and ends, the number of open intervals is the height of the stack. What lies below an interval is the last one that
    opened at the height below.
    """
    opens = intervals.select(*group, start, F.col(start).cast("binary").alias("at"), F.lit(1).alias("step"))
    both = opens.unionByName(intervals.select(*group, start, _end(F.col(start)).alias("at"), F.lit(-1).alias("step")))
    order = Window.partitionBy(*group).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    levels = both.withColumn("level", F.sum("step").over(order)).where("step = 1").drop("step")
    ask = levels.select(*group, start, "at", "level", F.lit(None).cast("string").alias("below"))
    tell = levels.select(*group, F.lit(None).cast("string").alias(start), "at", (F.col("level") + 1).alias("level"), F.col(start).alias("below"))
    last = Window.partitionBy(*group, "level").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return ask.unionByName(tell).withColumn("up", F.last("below", ignorenulls=True).over(last)).where(F.col(start).isNotNull()).select(*group, start, "up")


def sweep(points: DataFrame, ends: DataFrame, order: list[str], value: str) -> DataFrame:
    """points with `value`: that of the last end at or before them in the order of the columns `order`, null before the first. ends: order, value; at the same place the value
    that isn't null counts. Both have the columns of `order`; points have others besides, and `row`."""
    kind = ends.schema[value].dataType
    p = points.withColumn("set", F.lit(None).cast(f"struct<v:{kind.simpleString()}>")).withColumn("point", F.lit(1))
    e = ends.select(*order, F.struct(F.col(value).alias("v")).alias("set"), F.lit(0).alias("point"))
    by = [*order, "point", F.col("set.v").isNotNull(), "row"]
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(p.unionByName(e, allowMissingColumns=True).repartitionByRange(parts, *order, "point", "row").withColumn("part", F.spark_partition_id()), "urls-dealt")
    own = Window.partitionBy("part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    last = dealt.where("point = 0").groupBy("part").agg(F.max_by("set", F.struct(*order, F.col("set.v").isNotNull())).alias("left"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    every = dealt.select("part").distinct().join(last, "part", "left").withColumn("carried", F.last("left", ignorenulls=True).over(before)).select("part", "carried")  # a row for each part
    got = dealt.withColumn("set", F.last("set", ignorenulls=True).over(own)).where("point = 1").join(every, "part")
    return got.withColumn(value, F.coalesce("set", "carried")["v"]).drop("part", "point", "set", "carried")


def _stacks(rules: DataFrame, hosts: DataFrame) -> DataFrame:
    """(host, under): for each host that any rule's host fits, the keys of these, by a sweep over host keys."""
    own = rules.select("key").distinct()
    # the stack at each rule's host: itself and what is around it, label by label
    labels = F.split("key", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    stack = own.select("key", F.explode(parents).alias("p")).join(own.select(F.col("key").alias("p")), "p").groupBy("key").agg(F.sort_array(F.collect_set("p")).alias("stack"))
    starts = stack.select(F.col("key").cast("binary").alias("at"), "stack")
    stops = stack.select(_end(F.col("key")).alias("at"), F.when(F.size("stack") > 1, F.slice("stack", F.lit(1), F.size("stack") - 1)).alias("stack"))
    points = hosts.select(host_key(F.col("host")).cast("binary").alias("at"), "host", F.xxhash64("host").alias("row"))
    found = sweep(points, starts.unionByName(stops), ["at"], "stack")
    return found.where("stack is not null").select("host", F.col("stack").alias("under"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), a row for each row of pages: the longest rule (host and path together) that fits, as text,
    and its verdict; null and `default` if none fits. rules: (host, path, verdict); A-Z of hosts count as a-z.

    A null url, or one without ://, has an empty host and path and no rule. Rows that repeat are judged each; an empty table gives an empty result. Further columns
    are ignored. If two rules of the same length fit, that with the longer host decides; of rules that repeat, block wins. A rule with a null host fits nothing, a
    null path is empty.
    """
    host, path = host_path(F.col(url_col))
    rows = keep(pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id()), "urls-pages")
    r = rules.select(_lower(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = keep(r.withColumn("key", host_key(F.col("host"))), "urls-rules")
    stacks = keep(_stacks(r, rows.where("host <> ''").select("host").distinct()), "urls-stacks")
    below = keep(rows.join(stacks, "host").select("row", F.col("path").cast("binary").alias("at"), F.explode("under").alias("key")), "urls-below")
    top = F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("host"), F.concat("host", "path").alias("rule"), "verdict").cast(_TOP)
    tops = r.select("key", "path", top.alias("top"))
    up = around(r, ["key"], "path").join(tops.select("key", F.col("path").alias("up"), "top"), ["key", "up"], "left")
    ends = tops.select("key", F.col("path").cast("binary").alias("at"), "top").unionByName(up.select("key", _end(F.col("path")).alias("at"), "top"))
    found = sweep(below, ends, ["key", "at"], "top").where("top is not null")
    best = found.groupBy("row").agg(F.max("top").alias("best"))
    return rows.join(best, "row", "left").select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
