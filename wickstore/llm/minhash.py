"""Near-duplicate documents by b-bit MinHash.

A document's set holds its distinct 5-word shingles. Documents with equal sets are one class from the start.
Each class keeps the low four bits of 128 minima, packed into 64 bytes. Bands of five whole minima give
candidates; the packed bits of two candidates, counted and corrected for chance agreement, estimate their
similarity; what may reach the threshold is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy, rows_with, rows_without
from wickstore.llm.graph import components
from wickstore.llm.text import LOWER, filled, mixed, shingle_sets, slices

HASHES, BITS = 128, 4
BANDS, ROWS = 25, 5
#: Classes of one bucket that are compared in one block.
BLOCK = 2048
#: Buckets with more classes compare full sets in blocks of this size; smaller ones make pairs.
FEW, SETS = 64, 1024
#: Columns of a block's incidence matrix at a time.
COLUMNS = 4096
#: Standard deviations below the threshold at which an estimate still counts.
MARGIN = 5.0

_SEEDS = np.random.default_rng(20240101)
_FLIPS = _SEEDS.integers(0, 2**32, HASHES, dtype=np.uint32)
_ODDS = _SEEDS.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_NIBBLES = np.uint64(0x1111111111111111)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of ``HASHES`` minima for each non-empty set."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    values = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    out = np.empty((len(sets), HASHES), np.uint32)
    for p in range(HASHES):
        scrambled = (values ^ _FLIPS[p]) * _ODDS[p]
        scrambled ^= scrambled >> np.uint32(15)
        scrambled *= np.uint32(0x2C1B3C6D)
        out[:, p] = np.minimum.reduceat(scrambled, starts)
    return out


def packed(rows: np.ndarray) -> np.ndarray:
    """The low bits of the minima, 64 / BITS of them in each 64-bit word."""
    low = (rows & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(len(rows), -1, 64 // BITS)
    shifts = np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(low << shifts, axis=2)


def bands(rows: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(rows), BANDS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys + rows[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + np.arange(BANDS, dtype=np.uint64))
        keys += np.uint64(r + 1)
    return mixed(keys ^ (np.arange(BANDS, dtype=np.uint64) << np.uint64(56)))


def estimates(signature: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity of one packed signature with others, corrected for bits that agree by chance."""
    differ = signature ^ others
    differ |= differ >> np.uint64(2)
    differ |= differ >> np.uint64(1)
    same = HASHES - np.bitwise_count(differ & _NIBBLES).sum(axis=1, dtype=np.int64)
    chance = 2.0**-BITS
    return (same / HASHES - chance) / (1 - chance)


def lowest_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    agree = chance + (1 - chance) * threshold
    return threshold - MARGIN * (agree * (1 - agree) / HASHES) ** 0.5 / (1 - chance)


SIGNATURES = "doc_id long, n_shingles long, set binary, signature binary, bands array<long>"


def signatures(docs: DataFrame) -> DataFrame:
    """Per document: size and 128-bit digest of its shingle set, packed signature and band keys (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(filled(part.column("text")), LOWER, short=True)
                full = [d for d, s in enumerate(sets) if len(s)]
                digests: list = [None] * len(sets)
                packs: list = [None] * len(sets)
                keys: list = [None] * len(sets)
                if full:
                    rows = minima([sets[d] for d in full])
                    for d, pack, band in zip(full, packed(rows), bands(rows).view(np.int64)):
                        digests[d] = xxhash.xxh3_128_digest(sets[d].tobytes())
                        packs[d], keys[d] = pack.tobytes(), band
                yield pa.record_batch(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(packs, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set", "signature", "bands"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURES)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    """(sets, signatures, labels) of each bucket block, from rows sorted by bucket and block."""
    now, sets, packs, labels = None, [], [], []
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("key", "block", "set", "signature", "label")]
        for key, block, node, pack, label in zip(*columns):
            if (key, block) != now:
                if len(sets) > 1:
                    yield sets, packs, labels
                now, sets, packs, labels = (key, block), [], [], []
            sets.append(node)
            packs.append(pack)
            labels.append(label)
    if len(sets) > 1:
        yield sets, packs, labels


def _emit(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.record_batch(
        [pa.array([p[n] for p in pairs], pa.binary()) for n in (0, 1)], names=["a", "b"]
    )


def _nearest(least: float, links: int):
    """Each class with its most similar classes of the block, as far as they may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, bytes]] = set()
        for sets, packs, _ in _runs(batches):
            table = np.frombuffer(b"".join(packs), np.uint64).reshape(len(sets), -1)
            for i in range(len(sets)):
                near = estimates(table[i], table)
                near[i] = -1
                best = np.argpartition(-near, links)[:links] if len(near) > links else range(len(near))
                found.update(
                    (min(sets[i], sets[j]), max(sets[i], sets[j])) for j in best if near[j] >= least
                )
            if len(found) > 50_000:
                yield _emit(list(found))
                found.clear()
        yield _emit(list(found))

    return run


def _across(least: float):
    """All pairs of a block whose classes are not yet connected and may reach the threshold.

    Rows with a null label belong to the bucket's largest component; they meet the others, not each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[bytes, bytes]] = set()
        for sets, packs, labels in _runs(batches):
            table = np.frombuffer(b"".join(packs), np.uint64).reshape(len(sets), -1)
            codes = {x: n for n, x in enumerate(dict.fromkeys(labels))}
            names = np.array([codes[x] for x in labels])
            for i in [i for i, x in enumerate(labels) if x is not None]:
                near = (estimates(table[i], table) >= least) & (names != names[i])
                found.update(
                    (min(sets[i], sets[j]), max(sets[i], sets[j])) for j in np.flatnonzero(near)
                )
                if len(found) > 50_000:
                    yield _emit(list(found))
                    found.clear()
        yield _emit(list(found))

    return run


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                members = [s.tobytes() for s in shingle_sets(filled(part.column("text")), LOWER, short=True)]
                yield pa.record_batch(
                    [
                        pa.array([xxhash.xxh3_128_digest(m) for m in members], pa.binary()),
                        pa.array(members, pa.binary()),
                    ],
                    names=["set", "members"],
                )

    return docs.select("text").mapInArrow(run, "set binary, members binary")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, as products of their incidence matrix.

    Members of one set only share nothing and are left out.
    """
    members = np.concatenate(sets)
    values, column, counts = np.unique(members, return_inverse=True, return_counts=True)
    places = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = counts[column] > 1
    row, column = row[common], places[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((counts > 1).sum()), COLUMNS):
        low, high = np.searchsorted(column, [first, first + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[row[low:high], column[low:high] - first] = 1
        total += part @ part.T
    return total


def _joined(percent: int):
    """Links between classes of a block, one for each two components that they join."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, members, labels in _runs(batches):
            sets = [np.frombuffer(m, np.uint64) for m in members]
            codes = {x: n for n, x in enumerate(dict.fromkeys(labels))}
            label = np.array([codes[x] for x in labels])
            sizes = np.array([len(s) for s in sets])
            both = shared_counts(sets)
            linked = (100 * both >= percent * (sizes[:, None] + sizes - both)) & (label[:, None] < label)
            owner = list(range(len(codes)))
            found = []
            for i, j in zip(*np.nonzero(linked)):
                a, b = int(label[i]), int(label[j])
                while owner[a] != a:
                    owner[a] = a = owner[owner[a]]
                while owner[b] != b:
                    owner[b] = b = owner[owner[b]]
                if a != b:
                    owner[max(a, b)] = min(a, b)
                    found.append((min(names[i], names[j]), max(names[i], names[j])))
            if found:
                yield _emit(found)

    return run


def _full_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> tuple[DataFrame, str]:
    """(set, members) of the classes in ``nodes``, from the text of one of their documents."""
    ids, path = kept_copy(classes.join(nodes, "set").select(F.col("first").alias("doc_id")), "ids")
    spark = docs.sparkSession
    texts = rows_with(docs.select("doc_id", "text"), ids.distinct(), "doc_id", ids.count())
    if not ids.filter("doc_id is null").isEmpty():
        # A class of rows without an id is found by its text alone.
        texts = texts.unionByName(docs.select("doc_id", "text").filter("doc_id is null"))
    members, members_path = kept_copy(
        _sets(texts).join(nodes, "set", "left_semi").dropDuplicates(["set"]), "sets"
    )
    drop_copy(spark, path)
    return members, members_path


def confirmed(docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class digests whose full sets reach the threshold."""
    nodes = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    members, members_path = _full_sets(docs, classes, nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x = np.frombuffer(left.as_buffer(), np.uint64)
                y = np.frombuffer(right.as_buffer(), np.uint64)
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sided = pairs.join(members.select(F.col("set").alias("a"), F.col("members").alias("left")), "a").join(
        members.select(F.col("set").alias("b"), F.col("members").alias("right")), "b"
    )
    links, _ = kept_copy(
        sided.select("a", "b", "left", "right").mapInArrow(run, "a binary, b binary"), "confirmed"
    )
    drop_copy(docs.sparkSession, members_path)
    return links


def near_duplicates(docs: DataFrame, percent: int = 85, nearest: int = 3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets have ``100 * intersection >= percent * union``. ``component_id`` is the
    smallest doc_id reachable. A null, empty or blank text has an empty set, is linked with nothing and is
    its own component. Fewer than five words make one shingle. Rows that repeat an id and text give repeated
    rows. A null id never names a component that has another id. Further columns are ignored; an empty table
    gives an empty result.

    A bucket of many classes is dealt into blocks. First each class is confirmed against its ``nearest``
    candidates of the block, which connects groups of copies with few pairs; then only classes of one bucket
    that are still in different components are compared with each other, all of them: as pairs in small
    buckets; in large ones block by block on the full sets inside a task, which gives one link for each two
    components that it joins.
    """
    spark = docs.sparkSession
    least = lowest_estimate(percent / 100)
    signed, _ = kept_copy(signatures(docs), "signatures")
    classes, classes_path = kept_copy(
        signed.filter("set is not null")
        .groupBy("set")
        .agg(F.min("doc_id").alias("first"), F.first("signature").alias("signature"), F.first("bands").alias("bands")),
        "classes",
    )
    keys = classes.select("set", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = keys.join(shared, "key")
    buckets, buckets_path = kept_copy(members, "buckets")
    packs = classes.select("set", "signature")
    block = F.pmod(F.hash("set"), F.ceil(F.col("n") / BLOCK)).cast("int")

    def compared(rows: DataFrame, task) -> DataFrame:
        rows = rows.select("key", "block", "set", "signature", "label")
        ordered = rows.repartition("key", "block").sortWithinPartitions("key", "block")
        return ordered.mapInArrow(task, "a binary, b binary").distinct()

    rows = buckets.join(packs, "set").withColumns({"block": block, "label": F.lit(None).cast("binary")})
    pairs, pairs_path = kept_copy(compared(rows, _nearest(least, nearest)), "pairs")
    links = confirmed(docs, classes, pairs, percent)
    labels = components(links, "a", "b")

    named = buckets.join(labels, buckets["set"] == labels["node"], "left").select(
        "key", "n", "set", F.coalesce("component", "set").alias("label")
    )
    counts = named.groupBy("key", "label").agg(F.count("*").alias("k"))
    largest = counts.groupBy("key").agg(
        F.max(F.struct("k", "label"))["label"].alias("main"), F.count("*").alias("labels")
    )
    open_buckets, open_path = kept_copy(named.join(largest.filter("labels > 1"), "key"), "open")
    others = F.col("label") != F.col("main")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    spread = open_buckets.filter(F.col("n") <= FEW).withColumns(
        {
            "block": F.explode(
                F.when(others, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(block))
            ),
            "label": F.when(others, F.col("label")),
        }
    )
    across, across_path = kept_copy(compared(spread.join(packs, "set"), _across(least)), "pairs")
    fresh = across.join(pairs, ["a", "b"], "left_anti")
    more = confirmed(docs, classes, fresh, percent)

    many = open_buckets.filter(F.col("n") > FEW)
    members, members_path = _full_sets(docs, classes, many.select("set").distinct())
    sides = F.ceil(F.col("n") / SETS).cast("int")
    side = F.pmod(F.hash("set"), sides)
    others = F.filter(F.sequence(F.lit(0), F.greatest(sides - 1, F.lit(1))), lambda x: (x != side))
    pair = F.transform(
        F.when(sides > 1, F.filter(others, lambda x: x < sides)).otherwise(F.array(F.lit(0))),
        lambda x: F.least(x, side) * sides + F.greatest(x, side),
    )
    dealt = many.withColumn("block", F.explode(pair)).join(members, "set")
    dealt = dealt.select("key", "block", "set", F.col("members").alias("signature"), "label")
    joined = dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(
        _joined(percent), "a binary, b binary"
    )
    joined, _ = kept_copy(joined.distinct(), "joined")
    drop_copy(spark, members_path)
    more = more.union(joined)
    if not more.isEmpty():
        labels = components(links.union(more), "a", "b")
    grouped = (
        classes.join(labels, classes["set"] == labels["node"], "left")
        .select("set", "first", F.coalesce("component", "set").alias("component"))
    )
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = kept_copy(grouped.join(smallest, "component").select("set", "component_id"), "components")
    for path in (classes_path, buckets_path, pairs_path, across_path, open_path):
        drop_copy(spark, path)
    return (
        signed.select("doc_id", "n_shingles", "set")
        .join(named, "set", "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def representatives(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs``, all columns, that ``near_duplicates`` keeps: one document of each group.

    Of rows that repeat an id and text one stays. Rows without an id cannot be told apart and stay, as do
    texts without words.
    """
    rows, _ = kept_copy(near_duplicates(docs, percent), "near")
    gone, _ = kept_copy(rows.filter("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    rest = rows_without(docs, gone, "doc_id", gone.count())
    again = rows.filter("kept and n_shingles > 0 and doc_id is not null").groupBy("doc_id").count().filter("count > 1")
    again, _ = kept_copy(again.select("doc_id"), "again")
    count = again.count()
    if not count:
        return rest.select(*docs.columns)
    repeated = rows_with(rest, again, "doc_id", count).dropDuplicates(["doc_id", "text"])
    return rows_without(rest, again, "doc_id", count).unionByName(repeated).select(*docs.columns)
