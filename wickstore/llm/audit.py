"""Filter interaction audit over a sparse document-term matrix.

Blocks of documents are read once: their words become codes into a dictionary that some blocks of one task share,
their counts a compressed sparse row (CSR) shard. One shuffle by word brings the dictionaries together and gives
each distinct word of the corpus one id; a second one takes the ids back to the blocks, where they replace the
codes. Row sums of the shards are the word counts, their stored entries per row the distinct words.

Documents are then counted by part and by the set of filters that they fail, at most 32 sets a part. Everything
that is asked about an order of the filters follows from those counts.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy
from wickstore.llm.text import filled, raw, slices, words

FILTERS = "ABCDE"
BIT = {name: 1 << n for n, name in enumerate(FILTERS)}
SETS = range(1 << len(FILTERS))
MARKS = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))
#: Text of the blocks that share a dictionary; a block has up to 8 MB, or one longer document.
DICTIONARY_BYTES = 32 << 20

_ROWS = "dictionary long, doc_id array<long>, part array<string>, digest array<binary>, marks array<int>"
_MATRIX = f"{_ROWS}, starts binary, counts binary, columns binary"
_BLOCKS = f"{_ROWS}, starts binary, counts binary, codes binary, words array<string>"
#: How the numbers of a CSR shard lie in its buffers.
STARTS, COUNTS, CODES, COLUMNS = "<i8", "<i4", "<i4", "<i8"


BLOCK_TYPES = [
    pa.int64(),
    pa.list_(pa.int64()),
    pa.list_(pa.string()),
    pa.list_(pa.binary()),
    pa.list_(pa.int32()),
    *[pa.binary()] * 3,
    pa.list_(pa.string()),
]


def _sparse(codes: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CSR of documents given as word codes: row starts, columns, counts."""
    width = max(width, 1)
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    cells, counts = np.unique(owner * width + codes, return_counts=True)
    return np.searchsorted(cells, np.arange(len(starts)) * width), cells % width, counts


def _lists(*values) -> list[pa.Array]:
    """One row that holds each of the arrays as a list."""
    return [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]


def blocks(docs: DataFrame) -> DataFrame:
    """A row for each block of documents with its CSR shard by code, and one for each dictionary with its ``words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        known, held = pa.array([], pa.string()), 0
        names = _names(_BLOCKS)

        def named() -> pa.RecordBatch:
            empty = [pa.nulls(1, kind) for kind in BLOCK_TYPES[1:-1]]
            return pa.record_batch([pa.array([number], pa.int64()), *empty, *_lists(known)], names=names)

        for batch in batches:
            for part in slices(batch):
                texts = filled(part.column("text"))
                data, offsets = raw(texts)
                view = data.tobytes()
                if held and held + len(data) > DICTIONARY_BYTES:
                    yield named()
                    number, known, held = number + 1, known[:0], 0
                held += len(data)
                found = words(texts)
                at = pc.index_in(found.vocabulary, value_set=known)
                new = found.vocabulary.filter(pc.is_null(at))
                code = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
                code[code < 0] = len(known) + np.arange(len(new))
                known = pa.concat_arrays([known, new])
                starts, codes, counts = _sparse(code[found.codes], found.starts, len(known))

                def sums(flags: np.ndarray) -> np.ndarray:
                    before = np.concatenate([[0], np.cumsum(flags)])
                    return before[offsets[1:]] - before[offsets[:-1]]

                capitals = sums((data >= 65) & (data <= 90))
                points = sums((data & 0xC0) != 0x80)
                marks = BIT["C"] * (100 * capitals > 5 * points) + BIT["D"] * (sums(MARKS[data]) > 0)
                digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch(
                    [
                        pa.array([number], pa.int64()),
                        *_lists(
                            part.column("doc_id").cast(pa.int64()),
                            filled(part.column("source")),
                            pa.array(digests, pa.binary()),
                            pa.array(marks.astype(np.int32)),
                        ),
                        *[
                            pa.array([values.astype(kind).tobytes()], pa.binary())
                            for values, kind in ((starts, STARTS), (counts, COUNTS), (codes, CODES))
                        ],
                        pa.nulls(1, BLOCK_TYPES[-1]),
                    ],
                    names=names,
                )
        if held:
            yield named()

    rows = docs.select("doc_id", "text", F.col("source").cast("string").alias("source"))
    return rows.mapInArrow(run, _BLOCKS)


def word_ids(local: DataFrame) -> DataFrame:
    """(dictionary, code, id): each word's id in the whole corpus beside its code in each dictionary that has it.

    Words are dealt by hash into one range per shuffle partition and numbered inside it; ids of the ranges
    interleave, so they are unique and close to gapless. A word is in a dictionary once, however often it occurs.
    """
    ranges = int(local.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = local.select("dictionary", F.posexplode("words").alias("code", "word"))
    dealt = pairs.withColumn("range", F.pmod(F.xxhash64("word"), F.lit(ranges)))
    number = F.dense_rank().over(Window.partitionBy("range").orderBy("word")).cast("long") - 1
    return dealt.select("dictionary", "code", (number * ranges + F.col("range")).alias("id"))


def vocabulary(local: DataFrame, ids: DataFrame) -> DataFrame:
    """(word, id) of each distinct word."""
    named = local.select("dictionary", F.posexplode("words").alias("code", "word"))
    return named.join(ids, ["dictionary", "code"]).select("word", "id").distinct()


def sparse_shards(local: DataFrame, ids: DataFrame) -> DataFrame:
    """The CSR shards by word id: ids go back to their blocks and take the place of the codes.

    A row has ``doc_id``, ``part`` (the source), ``digest`` (of the text) and ``marks`` (filters C and D that a text
    fails) of its documents, and as little-endian buffers the ``starts`` of their rows and one more, ``counts``
    and ``columns`` (word ids, ascending in a row).
    """

    def encode(given: pa.Table, own: pa.Table) -> pa.Table:
        ids = np.zeros(own.num_rows, np.int64)
        ids[own.column("code").to_numpy()] = own.column("id").to_numpy()
        sorted_counts, columns = [], []
        for n in range(given.num_rows):
            starts, counts, codes = (
                np.frombuffer(given.column(name)[n].as_buffer(), kind)
                for name, kind in (("starts", STARTS), ("counts", COUNTS), ("codes", CODES))
            )
            found = ids[codes]
            order = np.lexsort((found, np.repeat(np.arange(len(starts) - 1), np.diff(starts))))
            sorted_counts.append(counts[order].tobytes())
            columns.append(found[order].tobytes())
        kept = [given.column(name) for name in _names(_MATRIX)[:-2]]
        buffers = [pa.array(values, pa.binary()) for values in (sorted_counts, columns)]
        return pa.table([*kept, *buffers], names=_names(_MATRIX))

    given = local.filter("words is null").drop("words").groupBy("dictionary")
    return given.cogroup(ids.groupBy("dictionary")).applyInArrow(encode, _MATRIX)


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


def document_flags(matrix: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) for each document; ``mask`` has the bits of A to D that it fails."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                lists = [batch.column(name).slice(n, 1).flatten() for name in ("doc_id", "part", "digest", "marks")]
                starts = np.frombuffer(batch.column("starts")[n].as_buffer(), STARTS)
                counts = np.frombuffer(batch.column("counts")[n].as_buffer(), COUNTS)
                before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                total = before[starts[1:]] - before[starts[:-1]]
                distinct = np.diff(starts)
                mask = lists[3].to_numpy() + BIT["A"] * (total < 50) + BIT["B"] * (100 * distinct < 65 * total)
                yield pa.record_batch(
                    [*lists[:3], pa.array(mask.astype(np.int32))],
                    names=["doc_id", "part", "digest", "mask"],
                )

    rows = matrix.select("doc_id", "part", "digest", "marks", "starts", "counts")
    return rows.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def failure_sets(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the set of filters A to E that they fail.

    Copies are counted per text before texts are compared, so a text of very many copies is a few rows. Labels of
    one document are taken together: it is good or toxic if any of them says so.
    """
    told = (
        labels.filter("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    )
    # Rows without an id have no label; they stay out of the join, where they would be one key.
    unnamed = flags.filter("doc_id is null").withColumns({n: F.lit(None).cast("int") for n in ("good", "toxic")})
    rows = flags.filter("doc_id is not null").join(told, "doc_id", "left").unionByName(unnamed)
    rows = rows.fillna(0, ["good", "toxic"])
    group = ["digest", "part", "mask", "good", "toxic"]
    named = F.col("doc_id").isNotNull()
    copies = (
        rows.groupBy(*group, "doc_id")
        .agg(F.count("*").alias("n"))
        .groupBy(*group)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.when(named, F.col("n")).otherwise(0)).alias("named"),
            F.min(F.when(named, F.struct("doc_id", "n"))).alias("lowest"),
        )
    )
    copies, _ = kept_copy(copies, "copies")
    several = (
        copies.groupBy("digest")
        .agg(F.min("lowest.doc_id").alias("first"), F.sum("n").alias("all"))
        .filter("all > 1 and first is not null")
        .select("digest", "first")
    )
    at_first = F.when(F.col("lowest.doc_id") == F.col("first"), F.col("lowest.n")).otherwise(0)
    later = F.when(F.col("first").isNotNull(), F.col("named") - at_first).otherwise(0)
    split = F.array(
        F.struct("mask", (F.col("n") - F.col("later")).alias("n")),
        F.struct((F.col("mask") + BIT["E"]).alias("mask"), F.col("later").alias("n")),
    )
    return (
        copies.join(several, "digest", "left")
        .withColumn("later", later)
        .select("part", "good", "toxic", F.inline(split))
        .filter("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


def _steps() -> list[dict]:
    """All orders of the filters and their steps, with the bits of the filters before and of its own."""
    return [
        {
            "filter_order": "".join(order),
            "step": step,
            "before": sum(BIT[name] for name in order[: step - 1]),
            "own": BIT[order[step - 1]],
        }
        for order in permutations(FILTERS)
        for step in range(1, len(FILTERS) + 1)
    ]


def _survivors(column: str) -> Column:
    """For each set of filters, ``column`` summed over the documents that fail none of it."""
    return F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(column)).otherwise(0)) for s in SETS])


def _shapley(own: int) -> Column:
    """What the filter removes, summed over all orders: each set of others comes first in so many of them."""
    terms = []
    for before in SETS:
        if not before & own:
            size = before.bit_count()
            orders = factorial(size) * factorial(len(FILTERS) - 1 - size)
            terms.append((F.col("alive")[before] - F.col("alive")[before | own]) * orders)
    return sum(terms[1:], terms[0])


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """How the filters A to E act on each other: a row per part, order of the filters and step.

    Filters fail texts with under 50 words (A), with under 65 % distinct words (B), with over 5 % ``[A-Z]`` (C),
    with one of ``#$%&*|`` (D), and with the text of a smaller doc_id anywhere (E). Parts are sources, null the
    empty one. For each step: documents ``kept`` after and ``removed`` by it, ``redundant`` ones that fail it but
    were removed before, ``unique_fails`` that fail it alone, ``good_lost`` and ``toxic_lost`` removed ones by
    label, and ``shapley``, what its filter removes summed over all orders.

    A null text is empty. Rows without an id count, have no label and never fail E; of rows with the same id none
    is smaller. Further columns are ignored; an empty table has no parts and gives no row.
    """
    spark = docs.sparkSession
    local, local_path = kept_copy(blocks(docs), "blocks", compression="zstd")
    ids, ids_path = kept_copy(word_ids(local), "words", compression="zstd")
    matrix, matrix_path = kept_copy(sparse_shards(local, ids), "matrix", compression="zstd")
    drop_copy(spark, local_path)
    drop_copy(spark, ids_path)
    flags, _ = kept_copy(document_flags(matrix), "flags")
    drop_copy(spark, matrix_path)
    sets, _ = kept_copy(failure_sets(flags, labels), "sets")
    parts = sets.groupBy("part").agg(
        _survivors("n").alias("alive"),
        _survivors("good").alias("alive_good"),
        _survivors("toxic").alias("alive_toxic"),
        *[F.sum(F.when(F.col("mask") == b, F.col("n")).otherwise(0)).alias(f"only_{b}") for b in BIT.values()],
    )
    by_own = {
        "only": F.create_map(*[x for b in BIT.values() for x in (F.lit(b), F.col(f"only_{b}"))]),
        "value": F.create_map(*[x for b in BIT.values() for x in (F.lit(b), _shapley(b))]),
    }
    kind = "array<struct<filter_order: string, step: int, before: int, own: int>>"
    steps = parts.withColumns(by_own).select(
        "*", F.inline(F.from_json(F.lit(json.dumps(_steps())), kind))
    )
    after = F.col("before").bitwiseOR(F.col("own"))

    def lost(column: str) -> Column:
        return F.col(column)[F.col("before")] - F.col(column)[after]

    fails = F.col("alive")[0] - F.col("alive")[F.col("own")]
    return steps.select(
        "part",
        "filter_order",
        "step",
        F.col("alive")[after].alias("kept"),
        lost("alive").alias("removed"),
        (fails - lost("alive")).alias("redundant"),
        F.col("only")[F.col("own")].alias("unique_fails"),
        lost("alive_good").alias("good_lost"),
        lost("alive_toxic").alias("toxic_lost"),
        F.col("value")[F.col("own")].alias("shapley"),
    )
