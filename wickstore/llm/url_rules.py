"""URL filters by a sort-merge range join, with DataFrame functions alone.

A host is written with its labels reversed and a point after each (``org.example.``), so a rule's host and all
its subdomains are the keys that start with the rule's: an interval. Below one host, so are the paths that start
with the rule's path. Intervals of this kind are nested or apart. Keys and interval ends are sorted together and
dealt into ranges; a sweep over each range counts the open intervals, which is the height of the stack of active
rules, and the rule at a height is the last one that was opened there.

Two sweeps judge a URL: the first over hosts finds the hosts with rules that it lies under, the second looks, for
each of them, for the longest rule that its path starts with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, POINT, END = 0, 1, 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _sweep(points: DataFrame, rules: DataFrame, innermost: bool) -> DataFrame:
    """(row, path, rule) for each point and each open rule, or only for the innermost one.

    ``points`` has ``row`` (unique), ``path`` and ``key``; ``rules`` has ``prefix`` (unique) and ``rule``, a struct
    that goes along. Points of one key are dealt by ``row``, so a hot key fills many ranges. A rule is opened
    again at the start of each further range that it reaches into.
    """
    spark = points.sparkSession
    start = F.encode("prefix", "UTF-8")
    none = points.schema["row"].dataType
    no_row, no_path = F.lit(None).cast(none).alias("row"), F.lit(None).cast("string").alias("path")

    def edges(of: DataFrame, *further: str) -> DataFrame:
        # No UTF-8 text has the byte FF: it closes an interval behind all keys with the prefix.
        ends = F.array(
            F.struct(start.alias("at"), F.lit(START).alias("kind")),
            F.struct(F.concat(start, F.unhex(F.lit("FF"))).alias("at"), F.lit(END).alias("kind")),
        )
        return of.select(F.inline(ends), no_row, no_path, "prefix", "rule", *further)

    nothing = rules.schema["rule"].dataType
    placed = points.select(
        F.encode("key", "UTF-8").alias("at"),
        F.lit(POINT).alias("kind"),
        "row",
        "path",
        F.lit(None).cast("string").alias("prefix"),
        F.lit(None).cast(nothing).alias("rule"),
    ).union(edges(rules))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["at", "kind", "row"]
    dealt = placed.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id())
    dealt, _ = kept_copy(dealt, "ranges")

    reach = (
        dealt.filter(F.col("kind") != POINT)
        .groupBy("prefix")
        .agg(F.min("part").alias("first"), F.max("part").alias("last"), F.min("rule").alias("rule"))
        .select("prefix", "rule", F.explode(F.sequence("first", "last")).alias("part"))
    )
    events = dealt.filter(F.col("kind") == POINT).unionByName(edges(reach, "part"))
    so_far = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    height = F.sum(F.lit(1) - F.col("kind")).over(so_far).cast("int")
    stacked = events.withColumn("height", height).filter(f"kind < {END} and height > 0")
    if innermost:
        levels = F.array("height")
    else:
        levels = F.when(F.col("kind") == POINT, F.sequence(F.lit(1), "height")).otherwise(F.array("height"))
    levelled = stacked.withColumn("level", F.explode(levels))
    opened = Window.partitionBy("part", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    active = F.last("rule", ignorenulls=True).over(opened)
    return levelled.withColumn("rule", active).filter(f"kind = {POINT}").select("row", "path", "rule")


def judged(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict`` (allow or block). A rule fits a URL whose host is the rule's
    or a subdomain of it and whose path starts with the rule's. The longest rule wins, of equally long ones that
    with the longer host; ``rule`` is its host and path. Without one, ``rule`` is null and ``verdict`` is ``default``.

    A null URL or one without ``://`` has empty host and path. A rule with an empty host fits every host, one with
    an empty path every path; a rule with a null, or one whose host holds a separator or whose path does not
    begin with ``/``, fits nothing. Of repeated rules with different verdicts block holds. Null and repeated page ids
    and repeated rows are kept row by row; further columns are ignored. Empty tables give no rows, or no rule.
    """
    host, path = host_and_path(F.col("url"))
    rows, _ = kept_copy(
        pages.select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row")),
        "urls",
    )
    rule_host = F.translate("host", _UPPER, _LOWER)
    usable = (
        rules.dropna(subset=["host", "path", "verdict"])
        .filter(~F.col("host").rlike("[/?#]") & ((F.col("path") == "") | F.startswith("path", F.lit("/"))))
        .groupBy(rule_host.alias("host"), "path")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("below", F.when(F.col("host") == "", "").otherwise(reversed_host(F.col("host"))))
    )
    hosts = usable.select(F.col("below").alias("prefix")).distinct().withColumn("rule", F.struct("prefix"))
    points = rows.select("row", "path", reversed_host(F.col("host")).alias("key"))
    under = _sweep(points, hosts, innermost=False)
    under, path_under = kept_copy(under.withColumn("key", F.concat("rule.prefix", "path")).drop("rule"), "under")
    weight = F.length("host") + F.length("path")
    told = F.struct(
        weight.alias("length"),
        F.length("host").alias("host_length"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    )
    paths = usable.select(F.concat("below", "path").alias("prefix"), told.alias("rule"))
    best = _sweep(under, paths, innermost=True).groupBy("row").agg(F.max("rule").alias("best"))
    best, _ = kept_copy(best.select("row", "best.rule", "best.verdict"), "best")
    drop_copy(rows.sparkSession, path_under)
    return rows.join(best, "row", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
