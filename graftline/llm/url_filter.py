"""URL filters by a sort-merge range join.

A host's canonical key is its labels from last to first, each with a dot behind it; the hosts that a rule fits are then
the keys that begin with the rule's key, an interval.  Rules of one host form a node, and a node
knows the chain of nodes whose intervals enclose it.  The distinct hosts and the nodes' starts are swept in key order: the
last node that started carries the whole stack, from which those that have ended by the host are
popped.  The sweep runs side by side in ranges of the first ``RANGE_LETTERS`` code points of the keys; a range begins with
the innermost node that started before it and covers it whole.  A range of more than ``RANGE_HOSTS`` hosts (all of a hosting domain's) is swept in
lanes: hosts are dealt to lanes by a hash, and every lane meets all nodes of the range.  Pages take their host's stack, and of its rules whose path
begins the page's path the longest (key, then path) decides.

Defined results: a null url or one without :// has empty host and path, which only a rule without either fits; a page that no rule fits gets the
default verdict and a null rule; of rules with equal host and path, block wins; repeated pages are judged alike; null rule parts count
as empty; an empty table gives an empty result; other columns are ignored by judge().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graftline.staging import stage

RANGE_LETTERS, RANGE_HOSTS = 8, 50_000
DEFAULT_VERDICT = "allow"

# The rules of the production query, as (verdict, host, path).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, "[.]", -1)), "."), F.lit("."))


def default_rules(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in RULES])
    return spark.range(1).select(F.inline(rows))


def _nodes(rules: DataFrame) -> DataFrame:
    """key, chain: array of (key, rules) from the node itself outwards; rules: array of (path, verdict, rule)."""
    host, path = F.coalesce("host", F.lit("")), F.coalesce("path", F.lit(""))
    own = rules.select(host_key(lower_ascii(host)).alias("key"), F.struct(path.alias("path"), F.col("verdict"), F.concat(host, path).alias("rule")).alias("r")).groupBy("key").agg(F.sort_array(F.collect_set("r")).alias("rules"))
    # the nodes that enclose a node have a prefix of its key that ends in a dot
    ends = F.filter(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", i, F.lit(1)) == ".")
    outer = own.select("key", F.explode(F.transform(ends, lambda i: F.substring("key", F.lit(1), i))).alias("outer"))
    chained = outer.join(own.select(F.col("key").alias("outer"), "rules"), "outer").groupBy("key").agg(F.sort_array(F.collect_list(F.struct(F.length("outer").alias("n"), F.col("outer").alias("key"), "rules")), False).alias("chain"))
    return chained


def _range_of(key: Column) -> Column:
    return F.substring(key, 1, RANGE_LETTERS)


def sweep(hosts: DataFrame, rules: DataFrame, range_hosts: int = RANGE_HOSTS) -> DataFrame:
    """key, stack: for each distinct host key, the active nodes from the innermost outwards."""
    nodes = _nodes(rules)
    short = F.length("key") < RANGE_LETTERS
    keys = stage(hosts.select("key").distinct().withColumn("range", _range_of(F.col("key"))), "hosts")
    ranges = stage(keys.groupBy("range").agg(F.ceil(F.count("*") / range_hosts).cast("int").alias("lanes")), "ranges")
    lane = F.pmod(F.xxhash64("key"), F.col("lanes")).cast("int")
    each = ranges.select("range", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"))
    # short nodes may cover many ranges: each range that has hosts opens with the longest of them that is a prefix of it
    prefixes = ranges.select("range", F.explode(F.transform(F.sequence(F.lit(1), F.length("range")), lambda i: F.substring("range", F.lit(1), i))).alias("prefix"))
    opening = prefixes.join(nodes.filter(short).withColumnRenamed("key", "prefix"), "prefix").groupBy("range").agg(F.max_by("chain", F.length("prefix")).alias("chain"))
    inner = nodes.filter(~short).select(_range_of(F.col("key")).alias("range"), "key", F.lit(1).alias("turn"), "chain")
    started = opening.select("range", F.col("range").alias("key"), F.lit(0).alias("turn"), "chain").unionByName(inner).join(each, "range")
    events = started.unionByName(keys.join(ranges, "range").select("range", "key", F.lit(2).alias("turn"), F.lit(None).alias("chain"), lane.alias("lane")))
    order = Window.partitionBy("range", "lane").orderBy("key", "turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = events.withColumn("started", F.last("chain", ignorenulls=True).over(order)).filter("turn = 2")
    active = F.filter(F.coalesce("started", F.array()), lambda n: F.startswith(F.col("key"), n["key"]))
    return met.select("key", active.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, range_hosts: int = RANGE_HOSTS) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    met = cut.join(sweep(cut, rules, range_hosts), "key", "left")
    fitting = F.flatten(F.transform("stack", lambda n: F.transform(F.filter(n["rules"], lambda r: F.startswith(F.col("path"), r["path"])), lambda r: F.struct((n["n"] + F.length(r["path"])).alias("length"), n["n"].alias("n"), r["verdict"].alias("verdict"), r["rule"].alias("rule")))))
    best = F.array_max(fitting)
    return met.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
