"""Token ids in Simple-8b words.

A word has a 4-bit selector and 60 bits for as many ids as fit in equal widths. Selector 0 is an escape for an
id beyond 60 bits; selector 15 repeats one id. Ids are coded in blocks of ``BLOCK``; a segment keeps where each
block's words and escapes begin, so blocks decode at once, without reading earlier ones.

Segment: ``W8B1``; int64 counts of documents, ids, blocks, words, escapes; int64 id and id count of each
document and a null flag (one byte); int64 first word and first escape of each block; words; escapes. All numbers
are little-endian.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickstore.llm.common import kept_copy
from wickstore.llm.tokens import encode_batches

BLOCK = 1024
# Ids per word and bits per id for selectors 1 to 14.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE, RUN = 0, 15
RUN_COUNT_BITS, RUN_VALUE_BITS = 20, 40
#: A run is coded as such from this length on; no other selector holds as many ids.
LEAST_RUN = 61
MAGIC = b"W8B1"


def _runs(ids: np.ndarray) -> np.ndarray | None:
    """How many equal ids stand from each place to the end of its block; None if no run is worth coding."""
    n = len(ids)
    breaks = np.flatnonzero(np.append(ids[1:] != ids[:-1], True)) + 1
    if np.diff(breaks, prepend=0).max() < LEAST_RUN:
        return None
    ends = np.repeat(breaks, np.diff(breaks, prepend=0))
    at = np.arange(n)
    return np.minimum(ends, np.minimum((at // BLOCK + 1) * BLOCK, n)) - at


def _steps(ids: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, selector and number of ids of each word: always the selector that takes the most ids.

    All blocks step through their ids side by side. Beyond a block's end stand zeros, which fit any width.
    """
    n = len(ids)
    bits = np.zeros((blocks, BLOCK + int(COUNTS.max())), np.uint8)
    needed = np.zeros(blocks * BLOCK, np.uint8)
    needed[:n] = np.frexp(ids.astype(np.float64))[1]
    big = np.flatnonzero(ids >= 1 << 52)
    needed[big] = [int(ids[i]).bit_length() for i in big]
    bits[:, :BLOCK] = needed.reshape(blocks, BLOCK)
    sizes = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    runs = _runs(ids)
    place = np.zeros(blocks, np.int64)
    live = np.arange(blocks)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        here = place[live]
        kind = np.zeros(len(live), np.int8)
        step = np.ones(len(live), np.int64)
        rows, columns = live, here
        widest = np.zeros(len(live), np.uint8)
        fitting = np.arange(len(live))
        reached = 0
        for s in range(len(COUNTS), 0, -1):
            count, width = int(COUNTS[s - 1]), int(WIDTHS[s - 1])
            for j in range(reached, count):
                widest = np.maximum(widest, bits[rows, columns + j])
            reached = count
            fits = widest <= width
            if not fits.all():
                rows, columns, widest, fitting = rows[fits], columns[fits], widest[fits], fitting[fits]
            if not len(fitting):
                break
            kind[fitting], step[fitting] = s, count
        step = np.minimum(step, sizes[live] - here)
        if runs is not None:
            same = runs[live * BLOCK + here]
            run = (same >= LEAST_RUN) & (ids[live * BLOCK + here] < 1 << RUN_VALUE_BITS)
            kind[run], step[run] = RUN, same[run]
        found.append((live * BLOCK + here, kind, step))
        place[live] = here + step
        live = live[place[live] < sizes[live]]
    starts, kinds, steps = (np.concatenate(c) for c in zip(*found))
    order = np.argsort(starts)
    return starts[order], kinds[order], steps[order]


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, escapes, and each block's first word and first escape, of unsigned 64-bit ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        none = np.zeros(0, np.int64)
        return ids, ids, none, none
    starts, kinds, counts = _steps(ids, blocks)
    words = np.zeros(len(starts), np.uint64)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS), 1):
        rows = np.flatnonzero(kinds == s)
        if not len(rows):
            continue
        lanes = np.arange(count)
        places = starts[rows][:, None] + lanes
        inside = lanes < counts[rows][:, None]
        values = np.where(inside, ids[np.minimum(places, n - 1)], np.uint64(0))
        shifted = values << (lanes * width + 4).astype(np.uint64)
        words[rows] = np.bitwise_or.reduce(shifted, axis=1) | np.uint64(s)
    rows = np.flatnonzero(kinds == RUN)
    words[rows] = (
        np.uint64(RUN) | counts[rows].astype(np.uint64) << np.uint64(4)
        | ids[starts[rows]] << np.uint64(4 + RUN_COUNT_BITS)
    )
    escaped = kinds == ESCAPE
    block_of = starts // BLOCK
    first_word = np.searchsorted(block_of, np.arange(blocks))
    first_escape = np.concatenate([[0], np.cumsum(escaped)])[first_word]
    return words, ids[starts[escaped]], first_word, first_escape


def decode(words: np.ndarray, escapes: np.ndarray, first_word: np.ndarray, n: int) -> np.ndarray:
    """The ids of all blocks of a segment of ``n`` ids."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    kinds = (words & np.uint64(15)).astype(np.int64)
    per_word = np.concatenate([[1], COUNTS, [0]])[kinds]
    run = kinds == RUN
    per_word[run] = (words[run] >> np.uint64(4)) & np.uint64((1 << RUN_COUNT_BITS) - 1)
    before = np.cumsum(per_word) - per_word
    block = np.searchsorted(first_word, np.arange(len(words)), side="right") - 1
    starts = block * BLOCK + before - before[first_word][block]
    ends = np.minimum((block + 1) * BLOCK, n)
    for s, (count, width) in enumerate(zip(COUNTS, WIDTHS), 1):
        rows = np.flatnonzero(kinds == s)
        if not len(rows):
            continue
        lanes = np.arange(count)
        values = words[rows][:, None] >> (lanes * width + 4).astype(np.uint64) & np.uint64((1 << int(width)) - 1)
        places = starts[rows][:, None] + lanes
        inside = places < ends[rows][:, None]
        out[places[inside]] = values[inside]
    for row in np.flatnonzero(run):
        out[starts[row] : starts[row] + per_word[row]] = words[row] >> np.uint64(4 + RUN_COUNT_BITS)
    out[starts[kinds == ESCAPE]] = escapes
    return out


def pack_segment(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    words, escapes, first_word, first_escape = encode(ids)
    counts = np.array([len(doc_ids), len(ids), len(first_word), len(words), len(escapes)], "<i8")
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    parts = [counts, names, sizes.astype("<i8"), nulls, first_word.astype("<i8"), first_escape.astype("<i8")]
    return MAGIC + b"".join(p.tobytes() for p in (*parts, words.astype("<u8"), escapes.astype("<u8")))


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    if data[:4] != MAGIC:
        raise ValueError("not a segment of coded ids")
    docs, ids, blocks, words, escapes = (int(x) for x in np.frombuffer(data, "<i8", 5, 4))
    at = 44

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        values = np.frombuffer(data, kind, count, at)
        at += values.nbytes
        return values

    names, sizes, nulls = take("<i8", docs), take("<i8", docs), take("u1", docs)
    first_word, _ = take("<i8", blocks), take("<i8", blocks)
    coded, rest = take("<u8", words), take("<u8", escapes)
    named = [None if z else int(d) for d, z in zip(names, nulls)]
    return named, sizes, decode(coded, rest, first_word, ids)


def write_ids(docs: DataFrame, tokenizer: str, end: int, path: str | None = None) -> DataFrame:
    """Encode every whole text, append ``end`` and write segments of Simple-8b words in ascending doc_id order.

    ``docs`` has doc_id and text; null texts count as empty, null ids come first, rows of one id are ordered by
    a hash of the text and repeated rows are all written. Rows: shard (range of ids), segment, n_ids,
    payload. Segments are rows of Parquet files, so that any file system Spark writes to will do; without a
    ``path`` they go to the shared folder. An empty table gives no segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        for number, (part, ids, starts) in enumerate(encode_batches(tokenizer, batches)):
            sizes = np.diff(starts) + 1
            places = np.cumsum(sizes)
            out = np.full(places[-1], end, np.uint32)
            keep = np.ones(len(out), bool)
            keep[places - 1] = False
            out[keep] = ids
            payload = pack_segment(part.column("doc_id").to_pylist(), sizes, out)
            yield pa.record_batch(
                [pa.array([x], t) for x, t in ((shard, pa.int32()), (number, pa.int32()), (len(out), pa.int64()), (payload, pa.binary()))],
                names=["shard", "segment", "n_ids", "payload"],
            )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    tie = [F.xxhash64("text").alias("tie"), F.xxhash64(F.monotonically_increasing_id()).alias("row")]
    ordered = chosen.select("*", *tie).repartitionByRange("doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    segments = ordered.select("doc_id", "text").mapInArrow(
        run, "shard int, segment int, n_ids long, payload binary"
    )
    if path is None:
        return kept_copy(segments, "ids")[0]
    segments.write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def read_ids(segments: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document of written segments: doc_id, start, n_tokens, ids_crc32, shard and, if asked for, the ids.

    ``start`` counts the ids of all documents before it in the order of writing; offsets of shards are summed
    over the shards' totals, those of documents inside their shard.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, segment, payload in zip(*(batch.column(c) for c in ("shard", "segment", "payload"))):
                names, sizes, ids = unpack_segment(payload.as_buffer().to_pybytes())
                little = ids.astype("<u4")
                ends = np.cumsum(sizes)
                view = memoryview(little.tobytes())
                sums = [zlib.crc32(view[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                columns = [
                    pa.array([shard.as_py()] * len(names), pa.int32()),
                    pa.array([segment.as_py()] * len(names), pa.int32()),
                    pa.array(np.arange(len(names)), pa.int64()),
                    pa.array(names, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                named = ["shard", "segment", "place", "doc_id", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64))))
                    named.append("ids")
                yield pa.record_batch(columns, names=named)

    schema = "shard int, segment int, place long, doc_id long, n_tokens long, ids_crc32 long"
    rows = segments.mapInArrow(run, schema + ", ids array<long>" * with_ids)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = (
        segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
        .select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("shard").orderBy("segment", "place").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(shards, "shard")
        .select(
            "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32", "shard",
            *(["ids"] if with_ids else []),
        )
    )


def coded_documents(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """What ``read_ids`` finds in the segments that ``write_ids`` writes for ``docs``."""
    return read_ids(write_ids(docs, tokenizer, end))
