"""URL rules by a sorted sweep over reversed hosts, in DataFrame functions only.

A host is written from its last label to its first, each label ended by a dot, so a rule for a host and its
subdomains covers one interval of the sorted hosts, and intervals nest or are apart. Hosts and rule starts are dealt
to ranges of this key and swept in key order. The sweep keeps the stack of nested rules: for each depth the rule
opened last. A rule opened last at its depth whose key does not begin the host's key has been closed.
Ranges begin with the stack that the ranges before them end with: one row per range.

Only distinct hosts are swept, so a hot host costs one row; pages find their host's rules by a salted join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxfare.llm.common import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPREAD = 16
#: Labels of a host name; RFC 1035 bounds names at 255 octets, hence 127 labels.
MOST_LABELS = 127
NO_RULES = "array<struct<rule:string,path:string,verdict:string,key:string>>"


def url_host(url: Column) -> Column:
    """Text after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """Text after the host up to ``?``, ``#`` or the end; empty for a null or a url without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(verdict, rule) pairs as a table of rule, verdict; a rule is a host and a path that begins with a slash."""
    return spark.createDataFrame([(r, v) for v, r in rules], "rule string, verdict string")


def _rule_hosts(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key, its number of labels, and its rules. Repeated rules count once; of two
    verdicts for one rule the smaller (allow) holds. Rules without a host, a slash or a verdict are left out."""
    parts = rules.filter("instr(rule, '/') > 1 and verdict is not null").select(
        F.concat(F.translate(F.substring_index("rule", "/", 1), UPPER, LOWER), F.expr("substring(rule, instr(rule, '/'))")).alias("rule"), "verdict"
    )
    single = parts.groupBy("rule").agg(F.min("verdict").alias("verdict"))
    host = F.substring_index("rule", "/", 1)
    keyed = single.select("rule", F.expr("substring(rule, instr(rule, '/'))").alias("path"), "verdict", host_key(host).alias("key"))
    grouped = keyed.groupBy("key").agg(F.collect_list(F.struct("rule", "path", "verdict", "key")).alias("here"))
    return grouped.withColumn("depth", F.size(F.split("key", r"\.", -1)) - 1)


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``hosts`` (host, salt) with ``active``, the rules whose interval holds the host."""
    spark = hosts.sparkSession
    opened = stored(_rule_hosts(rules), "url-rules")
    depths = sorted(r["depth"] for r in opened.select("depth").distinct().limit(MOST_LABELS + 1).collect())
    if len(depths) > MOST_LABELS:
        raise ValueError(f"rule hosts have more than {MOST_LABELS} depths")
    if not depths:
        return hosts.withColumn("active", F.array().cast(NO_RULES))
    points = hosts.select(host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), "host", "salt", F.lit(None).cast("int").alias("depth"), F.lit(None).cast(NO_RULES).alias("here"))
    starts = opened.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("int").alias("salt"), "depth", "here")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.unionByName(starts).repartitionByRange(parts, "key").withColumn("seg", F.spark_partition_id())
    dealt = stored(dealt, "url-sweep")
    sweep = W.partitionBy("seg").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, 0)
    slot = {d: F.when(F.col("depth") == d, F.struct("key", "here")) for d in depths}
    open_now = [F.last(slot[d], ignorenulls=True).over(sweep).alias(f"open_{d}") for d in depths]
    swept = dealt.select("*", *open_now).filter("kind = 1")
    ends = dealt.groupBy("seg").agg(*[F.max_by(slot[d], F.when(F.col("depth") == d, F.col("key"))).alias(f"end_{d}") for d in depths])
    before = W.orderBy("seg").rowsBetween(W.unboundedPreceding, -1)  # one row per range
    carried = ends.select("seg", *[F.last(f"end_{d}", ignorenulls=True).over(before).alias(f"carry_{d}") for d in depths])
    stack = F.array(*[F.coalesce(f"open_{d}", f"carry_{d}") for d in depths])
    still = F.filter(stack, lambda s: s.isNotNull() & F.col("key").startswith(s["key"]))
    joined = swept.join(carried, "seg")
    return joined.select("host", "salt", F.flatten(F.transform(still, lambda s: s["here"])).alias("active"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """``key``, host, path, rule and verdict of each row: the longest rule that fits decides, else ``default``.

    Among fitting rules of equal length the one with the longer host wins. A null url has an empty host and path
    and gets the default; repeated rows each give a row; an empty table gives an empty result, and with no rules
    all rows get the default. Other columns are not read.
    """
    read = pages.select(F.col(key).alias("id"), url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"), F.pmod(F.xxhash64(key, url), F.lit(SPREAD)).cast("int").alias("salt"))
    known = host_rules(read.select("host", "salt").distinct(), rules)
    matched = read.join(known, ["host", "salt"], "left")
    fits = F.filter("active", lambda r: F.col("path").startswith(r["path"]))
    ranked = F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("size"), F.length(r["key"]).alias("host_size"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    best = matched.withColumn("best", F.array_max(ranked))
    return best.select(F.col("id").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
