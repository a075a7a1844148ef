"""Packing by Karmarkar-Karp multiway differencing.

Documents are cut into full windows and smaller pieces. Pieces are dealt by hash into groups of bounded size;
in each group partial partitions with the largest imbalances are merged against each other, the fullest
windows of one with the emptiest of the other, until one partition is left. If a window of it exceeds the
capacity, the group starts again with one window more.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import kept_copy, small_batches
from wickstore.llm.text import SMALL_SLICE_BYTES
from wickstore.llm.tokens import encode_batches

CAPACITY = 2048
#: Longest piece that shares a window; smaller pieces balance better, larger ones cut fewer documents.
PIECE = 512
#: Windows of one group, about.
WINDOWS = 64


def differenced(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` windows of nearly equal sums.

    A partial partition holds (sum, indices) of its windows that are not empty, largest sums first.
    """
    heap = [(-size, n, [(size, [n])]) for n, size in enumerate(sizes)]
    heapq.heapify(heap)
    ticket = len(sizes)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        spare = windows - len(a)
        alone, met = b[:spare], b[spare:]
        merged = a[: len(a) - len(met)] + alone
        for (x, left), (y, right) in zip(reversed(a), met):
            merged.append((x + y, left + right))
        merged.sort(key=lambda w: -w[0])
        smallest = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (smallest - merged[0][0], ticket, merged))
        ticket += 1
    return [indices for _, indices in heap[0][2]] if heap else []


def packed(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity`` for ``sizes`` that are each no larger."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differenced(sizes, windows)
        if all(sum(sizes[i] for i in w) <= capacity for w in found):
            return found
        windows += 1


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Full windows and smaller pieces of each document's ids, with their checksums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, starts in encode_batches(tokenizer, batches, limit=SMALL_SLICE_BYTES):
            data = memoryview(ids.astype("<u4").tobytes())
            tail = int(end).to_bytes(4, "little")
            rows: list[tuple] = []
            for doc, first, last in zip(part.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                total = last - first + 1
                cut = 0
                while cut < total:
                    left = total - cut
                    size = CAPACITY if left >= CAPACITY else min(left, PIECE)
                    stop = cut + size
                    check = zlib.crc32(data[4 * (first + cut) : 4 * (first + min(stop, total - 1))])
                    if stop == total:
                        check = zlib.crc32(tail, check)
                    rows.append((doc, cut, size, check, total))
                    cut = stop
            yield pa.record_batch(
                [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 5)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def sequences(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every text is encoded whole and gets ``end``; null texts count as empty, so they have that id alone. Each
    id lies in exactly one piece; a sequence has at most 2048 ids, its pieces stand at ``offset`` without gaps.
    Documents give a full sequence for each 2048 ids and at most four pieces for the rest. Sequence ids are
    unique, not gapless. Repeated rows are rows of their own; further columns are ignored; an empty table
    gives an empty result.
    """
    with small_batches(docs):
        cut, _ = kept_copy(pieces(docs, tokenizer, end), "pieces")
    cut = cut.withColumn("row", F.monotonically_increasing_id())
    whole = cut.filter(F.col("length") == CAPACITY).select(
        *[c for c in cut.columns if c != "row"],
        (F.col("row") * 2 + 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    small = cut.filter(F.col("length") < CAPACITY)
    tokens = small.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, tokens // (WINDOWS * CAPACITY))

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row", ignore_index=True)
        lengths = frame["length"].tolist()
        order, names, offsets = [], [], []
        for window, indices in enumerate(packed(lengths)):
            indices = sorted(indices)
            order += indices
            names += [window] * len(indices)
            offsets += (np.cumsum([lengths[i] for i in indices]) - [lengths[i] for i in indices]).tolist()
        out = frame.iloc[order]
        base = frame["group"].iloc[0] << 17
        return out.assign(sequence_id=[base + 2 * w for w in names], offset=offsets)[
            ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        ]

    dealt = small.withColumn("group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    shared = dealt.groupBy("group").applyInPandas(pack, PIECES + ", sequence_id long, offset long")
    return whole.unionByName(shared)
