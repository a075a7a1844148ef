"""Benchmark decontamination: short test items found inside long documents.

Items are dealt into partitions by the size of their shingle set. An item of ``q`` shingles that a document
contains to ``percent`` has at most ``q - ceil(q * percent / 100)`` of them missing, so one MinHash value more
than that, taken from the bottom of its hash order, always includes one that the document has. Each size
partition therefore has its own sketch length. Documents probe the sketches of all partitions; an item whose
sketch is met is verified by counting all of its shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy, rows_without
from wickstore.llm.text import PLAIN, filled, shingle_sets, slices

#: Shingles of test items that one pass over the documents looks for, 16 bytes each in every worker.
BLOCK_SHINGLES = 1_000_000


class ItemIndex:
    """Sketches and full sets of one block of items, as sorted arrays."""

    def __init__(self, ids: list, sets: list[np.ndarray], percent: int):
        self.ids = np.array(ids, np.int64)
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.needed = -(-self.sizes * percent // 100)
        lengths = self.sizes - self.needed + 1
        sketches = []
        for partition in np.unique(np.ceil(np.log2(self.sizes))) if len(sets) else []:
            inside = np.flatnonzero(np.ceil(np.log2(self.sizes)) == partition)
            longest = int(lengths[inside].max())
            sketches += [sets[i][:longest] for i in inside]  # sets are sorted: the bottom of the hash order
        self.sketch = np.unique(np.concatenate([*sketches, np.zeros(0, np.uint64)]))
        items = np.repeat(np.arange(len(sets)), self.sizes)
        hashes = np.concatenate([*sets, np.zeros(0, np.uint64)])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.items = hashes[order], items[order]

    def matches(self, members: np.ndarray) -> list[tuple[int, int, int]]:
        """(item id, its size, shared shingles) for a document's sorted set."""
        if not len(self.sketch) or not len(members):
            return []
        at = np.minimum(np.searchsorted(self.sketch, members), len(self.sketch) - 1)
        if not (self.sketch[at] == members).any():
            return []
        low = np.searchsorted(self.hashes, members, side="left")
        counts = np.searchsorted(self.hashes, members, side="right") - low
        low, counts = low[counts > 0], counts[counts > 0]
        found = self.items[np.repeat(low - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
        items, shared = np.unique(found, return_counts=True)
        return [
            (int(self.ids[i]), int(self.sizes[i]), int(n))
            for i, n in zip(items, shared)
            if n >= self.needed[i]
        ]


MATCHES = "doc_id long, item_id long, n_item_shingles long, n_shared long"


def item_sets(items: DataFrame) -> DataFrame:
    """(item_id, members) of items with at least one 5-word shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingle_sets(filled(part.column("text")), PLAIN, short=False)
                full = [n for n, s in enumerate(sets) if len(s)]
                yield pa.record_batch(
                    [
                        part.column("item_id").cast(pa.int64()).take(pa.array(full, pa.int64())),
                        pa.array([sets[n].tobytes() for n in full], pa.binary()),
                    ],
                    names=["item_id", "members"],
                )

    return items.select("item_id", "text").mapInArrow(run, "item_id long, members binary")


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) for each document that contains an item.

    A document contains an item if it has at least ``percent`` of the item's distinct 5-word shingles, after
    A-Z are lower-cased and ASCII punctuation is white space. Items with fewer than five words, without text
    or without an id cannot be told from chance and are not searched. A document without text contains
    nothing. Rows that repeat an item or a document give repeated rows. All documents and all items are
    compared, the items in blocks of bounded size; with no items the result is empty.
    """
    spark = docs.sparkSession
    sets, path = kept_copy(item_sets(items.filter("item_id is not null")), "items")
    total = sets.agg(F.sum(F.expr("length(members) div 8"))).first()[0] or 0
    blocks = int(total // BLOCK_SHINGLES) + 1
    found = []
    for block in range(blocks):
        chosen = sets.filter(F.pmod(F.xxhash64("members"), F.lit(blocks)) == block).collect()
        chosen.sort(key=lambda r: (r.item_id, r.members))
        index = ItemIndex(
            [r.item_id for r in chosen], [np.frombuffer(r.members, np.uint64) for r in chosen], percent
        )
        found.append(_probe(docs, spark.sparkContext.broadcast(index)))
    drop_copy(spark, path)
    result = found[0]
    for part in found[1:]:
        result = result.union(part)
    return result.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def _probe(docs: DataFrame, index) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                ids = part.column("doc_id")
                rows = [
                    (ids[d].as_py(), *match)
                    for d, members in enumerate(shingle_sets(filled(part.column("text")), PLAIN, short=False))
                    for match in index.value.matches(members)
                ]
                yield pa.record_batch(
                    [pa.array([r[c] for r in rows], pa.int64()) for c in range(4)],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, MATCHES)


def clean_documents(docs: DataFrame, items: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item; a row's text decides, not its id."""
    hits, _ = kept_copy(
        contained_items(docs.select(F.xxhash64("text").alias("doc_id"), "text"), items, percent), "hits"
    )
    bad, _ = kept_copy(hits.select(F.col("doc_id").alias("_text")).distinct(), "bad")
    marked = docs.withColumn("_text", F.xxhash64("text"))
    return rows_without(marked, bad, "_text", bad.count()).select(*docs.columns)
