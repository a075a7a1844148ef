"""Balanced sharding by label propagation over linked documents.

Documents with equal texts are linked. Each starts in a shard by hash; rounds of Spark joins move whole groups
towards the shard where most of their members are, as far as the shards' quotas allow; at last documents
without links move until all shards have the same number of rows, give or take one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy

ROUNDS = 6
#: Largest unit that moves at once, as a share of a shard; larger groups are dealt into several units.
UNIT = 0.5
#: Rows that are numbered in one task, about.
NUMBERED = 20_000


def _ranked(rows: DataFrame, count: int, shards: int, *first: str) -> DataFrame:
    """``rows`` with ``rank``: from 0 without gaps in each shard, ordered by ``first`` and then by hash.

    Rows are numbered inside buckets; a bucket's offset comes from the counts of those before it.
    """
    buckets = max(64, -(-count // (shards * NUMBERED)))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    keys = ["shard", *first, "bucket"]
    before = Window.partitionBy("shard").orderBy(*first, "bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) - 1
    return (
        rows.withColumn("within", within)
        .join(offsets, keys)
        .withColumn("rank", F.col("offset") + F.col("within"))
        .drop("offset", "within", "bucket")
    )


def _by_shard(values: list[float], shard: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), shard + 1)


def _loads(df: DataFrame, shards: int) -> list[int]:
    loads = [0] * shards
    for row in df.groupBy("shard").agg(F.count("*").alias("n")).collect():
        loads[row["shard"]] = row["n"]
    return loads


def propagated(members: DataFrame, capacity: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``members`` (row, unit, shard, ...) with new shards after rounds of label propagation.

    Each unit wishes for the shard that holds most of its members; ties fall differently each round. A shard
    accepts units by hash with the chance at which its members meet its quota; documents without links don't
    count, since they make room later. Only counts per pair of shards come to the driver.
    """
    spark = members.sparkSession
    rest = [c for c in members.columns if c != "shard"]
    members, path = kept_copy(members, "members")
    for turn in range(rounds):
        votes = members.groupBy("unit", "shard").agg(F.count("*").alias("n"))
        wish = votes.groupBy("unit").agg(
            F.max(F.struct("n", F.xxhash64("unit", "shard", F.lit(turn)).alias("tie"), "shard"))["shard"].alias("wish")
        )
        wishes, wish_path = kept_copy(wish, "wishes")
        flows = (
            votes.join(wishes, "unit").filter("shard != wish").groupBy("shard", "wish").agg(F.sum("n").alias("n")).collect()
        )
        loads = _loads(members, shards)
        incoming, outgoing = [0] * shards, [0] * shards
        for flow in flows:
            outgoing[flow["shard"]] += flow["n"]
            incoming[flow["wish"]] += flow["n"]
        if not sum(incoming):
            drop_copy(spark, wish_path)
            break
        room = [max(0.0, capacity - load + out) for load, out in zip(loads, outgoing)]
        chance = [min(1.0, r / i) if i else 1.0 for r, i in zip(room, incoming)]
        drawn = F.pmod(F.xxhash64("unit", F.lit(turn)), F.lit(1_000_000)) / 1_000_000
        moved = members.join(wishes, "unit").withColumn(
            "shard", F.when(drawn < _by_shard(chance, F.col("wish")), F.col("wish")).otherwise(F.col("shard"))
        )
        moved, next_path = kept_copy(moved.select(*rest, "shard"), "members")
        drop_copy(spark, path)
        drop_copy(spark, wish_path)
        members, path = moved, next_path
    return members


def balanced(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard, group_rows.

    The law is ``rows``: shards differ by one row at most. ``size`` is the text's UTF-8 bytes plus one,
    ``slot`` counts from 0 without gaps in each shard, ``grown_shard`` is null under this law, ``group_rows``
    says how many rows have the same text; null and empty texts are the same. Equal texts share a shard unless
    their group is larger than what a shard has room for; then its parts do. Repeated rows are rows of
    their own; further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g1"),
        F.xxhash64(F.lit(1), text).alias("g2"),
    ).withColumn("row", F.monotonically_increasing_id())
    rows, rows_path = kept_copy(rows, "rows")
    count = rows.count()
    capacity = -(-count // shards)
    groups = rows.groupBy("g1", "g2").agg(F.count("*").alias("group_rows")).filter("group_rows > 1")
    start = F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).cast("int")
    sized = rows.join(groups, ["g1", "g2"], "left").withColumns(
        {"group_rows": F.coalesce("group_rows", F.lit(1)), "shard": start}
    )
    sized, sized_path = kept_copy(sized, "sized")
    drop_copy(spark, rows_path)
    most = max(1, int(capacity * UNIT))
    parts = F.ceil(F.col("group_rows") / most)
    unit = F.xxhash64("g1", "g2", F.pmod(F.xxhash64("row"), parts))
    members = sized.filter("group_rows > 1").select("row", unit.alias("unit"), "shard")
    alone = sized.filter("group_rows = 1")
    moved = propagated(members, capacity, shards, rounds)
    placed, placed_path = kept_copy(
        alone.select("doc_id", "size", "text_crc32", "row", "group_rows", "shard").unionByName(
            sized.filter("group_rows > 1").drop("shard").join(moved.select("row", "shard"), "row")
            .select("doc_id", "size", "text_crc32", "row", "group_rows", "shard")
        ),
        "placed",
    )
    drop_copy(spark, sized_path)
    loads = _loads(placed, shards)
    fuller = sorted(range(shards), key=lambda s: (-loads[s], s))[: count % shards]
    targets = [count // shards + (s in fuller) for s in range(shards)]
    surplus = [max(0, load - t) for load, t in zip(loads, targets)]
    taken = [sum(surplus[:s]) for s in range(shards)]
    # first those without links, then those whose group is in several parts anyway, then small groups
    late = F.when(F.col("group_rows") == 1, 0).when(F.col("group_rows") > most, 1)
    late = late.otherwise(2 + F.ceil(F.log2(F.col("group_rows")))).cast("int")
    ranked = _ranked(placed.withColumn("late", late), count, shards, "late")
    leaving = F.col("rank") < _by_shard(surplus, F.col("shard"))
    number = F.col("rank") + _by_shard(taken, F.col("shard"))
    goes, filled = F.lit(None).cast("int"), sum(surplus)
    for s in reversed(range(shards)):
        need = max(0, targets[s] - loads[s])
        filled -= need
        if need:
            goes = F.when((number >= filled) & (number < filled + need), F.lit(s)).otherwise(goes)
    settled, _ = kept_copy(
        ranked.withColumn("shard", F.when(leaving, goes).otherwise(F.col("shard"))).drop("rank", "late"), "settled"
    )
    drop_copy(spark, placed_path)
    return _ranked(settled, count, shards).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.col("rank").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "group_rows",
    )
