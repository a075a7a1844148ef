"""Repeated passages by content-defined chunking.

A gear hash rolls over the bytes of a text; where it is least among its neighbours a chunk ends, so cuts depend
on the bytes nearby only and an insertion shifts no later cut. Chunks are compared by digest over all documents;
runs of repeated chunks are extended byte by byte against their first place, and what is long enough then is a
repeated passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, settled_copy
from wickstore.llm.text import filled, raw, slices

WINDOW = 16
#: Least bytes on either side of a run of chunks that are compared with its first place; a longer chunk that
#: adjoins the run is compared whole.
MARGIN = 1024
GEAR = np.random.default_rng(64).integers(0, 2**16, 256, dtype=np.uint16)


def cuts(data: np.ndarray, average: int, most: int) -> np.ndarray:
    """Ends of the chunks of one text's bytes; the last is its length.

    A chunk ends where the hash is least within ``average // 2`` bytes on either side. Chunks are longer than that,
    and two texts that share some 150 bytes share a chunk all but surely.
    """
    rolled = GEAR[data]
    width = 1
    while width < WINDOW:  # sums over 1, 2, 4, ... bytes, the older half shifted left
        rolled[width:] = rolled[width:] + (rolled[:-width] << np.uint16(width))
        width *= 2
    half, around = average // 2, 2 * (average // 2) + 1
    edge = np.full(half, 65535, np.uint16)
    low, width = np.concatenate([edge, rolled, edge]), 1
    while 2 * width <= around:  # least of 1, 2, 4, ... hashes from here on
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(data)], low[around - width :])
    ends = np.flatnonzero(rolled == low) + 1
    ends = ends[ends >= WINDOW]
    if (np.diff(ends) <= half).any():  # equal hashes, as in text that repeats a few bytes
        kept = [int(ends[0])]
        for end in ends.tolist():
            if end > kept[-1] + half:
                kept.append(end)
        ends = np.array(kept)
    if not len(ends) or ends[-1] != len(data):
        ends = np.append(ends, len(data))
    gaps = np.diff(ends, prepend=0)
    if (gaps > most).any():
        pieces = -(-gaps // most)
        begins = np.repeat(ends - gaps, pieces)
        steps = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces) + 1
        ends = np.minimum(begins + steps * most, np.repeat(ends, pieces))
    return ends


CHUNKS = "doc_id long, text_hash long, chunk int, start int, length int, before int, after int, digest long"


def chunked(docs: DataFrame, average: int, most: int) -> DataFrame:
    """The chunks of every text (doc_id, text_hash, text): place in bytes, lengths of both neighbours, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                data, offsets = raw(filled(part.column("text")))
                counts, starts, lengths, digests = [], [], [], []
                digest = xxhash.xxh3_64_intdigest
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    text = data[a:b]
                    ends = cuts(text, average, most) if b > a else np.zeros(0, np.int64)
                    begins = np.concatenate([[0], ends[:-1]]) if b > a else ends
                    view = memoryview(text)
                    digests += [digest(view[x:y]) for x, y in zip(begins.tolist(), ends.tolist())]
                    counts.append(len(ends))
                    starts.append(begins)
                    lengths.append(ends - begins)
                rows = np.repeat(np.arange(len(counts)), counts)
                first = np.cumsum(counts) - counts
                sizes = np.concatenate(lengths).astype(np.int32)
                own = np.arange(len(rows)) - first[rows]
                before = np.where(own > 0, np.roll(sizes, 1), 0)
                after = np.where(own + 1 < np.array(counts)[rows], np.roll(sizes, -1), 0)
                yield pa.record_batch(
                    [
                        part.column("doc_id").take(pa.array(rows, pa.int64())),
                        part.column("text_hash").take(pa.array(rows, pa.int64())),
                        pa.array(own.astype(np.int32)),
                        pa.array(np.concatenate(starts).astype(np.int32)),
                        *[pa.array(values.astype(np.int32)) for values in (sizes, before, after)],
                        pa.array(np.array(digests, np.uint64).view(np.int64)),
                    ],
                    names=[column.split()[0] for column in CHUNKS.split(", ")],
                )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, CHUNKS)


def margins(docs: DataFrame, links: DataFrame) -> DataFrame:
    """(source_hash, a, b, near, far, before, after): ``near`` and ``far`` bytes around the bytes a to b of first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                text = (row["text"] or "").encode()
                found = [
                    (row["text_hash"], *r.values(), text[max(0, r["a"] - r["near"]) : r["a"]], text[r["b"] : r["b"] + r["far"]])
                    for r in row["ranges"]
                ]
                kinds = (*[pa.int64()] * 5, pa.binary(), pa.binary())
                yield pa.record_batch(
                    [pa.array(values, kind) for values, kind in zip(zip(*found), kinds)],
                    names=["source_hash", "a", "b", "near", "far", "before", "after"],
                )

    ranges = links.groupBy("source_id", "source_hash").agg(
        F.collect_set(F.struct("a", "b", "near", "far")).alias("ranges")
    )
    same = F.col("doc_id").eqNullSafe(F.col("source_id")) & (F.col("text_hash") == F.col("source_hash"))
    rows = docs.join(ranges, same).select("text_hash", "text", "ranges").dropDuplicates(["text_hash"])
    return rows.mapInArrow(run, "source_hash long, a long, b long, near long, far long, before binary, after binary")


LETTER = np.array([n >= 128 or chr(n).isalnum() for n in range(256)]).tolist()
BLANK = b" \t\n\v\f\r"


def _shared(a: bytes, b: bytes) -> int:
    """Bytes that two texts have in common at their start."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(apart[0]) if len(apart) else n


def extended(text: bytes, start: int, end: int, before: bytes, after: bytes) -> tuple[int, int]:
    """A run of chunks with the bytes around it that its first place has too, from whole word to whole word."""
    inside = lambda n: 0 < n < len(text) and LETTER[text[n - 1]] and LETTER[text[n]]
    first = start - _shared(text[max(0, start - len(before)) : start][::-1], before[::-1])
    last = end + _shared(text[end : end + len(after)], after)
    a, b = first, last
    while a <= start and inside(a):
        a += 1
    while b >= end and inside(b):
        b -= 1
    a, b = (first if a > start else a), (last if b < end else b)  # a script without spaces
    while a < b and text[a] in BLANK:
        a += 1
    while b > a and text[b - 1] in BLANK:
        b -= 1
    return a, b


SPANS = "doc_id long, text_hash long, start long, end long, first_doc_id long, n long, is_first boolean"


def spans(docs: DataFrame, links: DataFrame, least_bytes: int, least_words: int) -> DataFrame:
    """Extended links of ``least_bytes`` bytes or ``least_words`` words, and the same bytes at their first places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                text, own = (row["text"] or "").encode(), row["doc_id"]
                for x in row["links"]:
                    a, b = extended(text, x["start"], x["end"], x["before"], x["after"])
                    if b - a >= least_bytes or len(text[a:b].split()) >= least_words:
                        source, shift = x["source_id"], x["start"] - x["a"]
                        found.append((own, row["text_hash"], a, b, source, x["n"], False))
                        found.append((source, x["source_hash"], a - shift, b - shift, source, x["n"], True))
            if found:
                kinds = [pa.int64()] * 6 + [pa.bool_()]
                names = [column.split()[0] for column in SPANS.split(", ")]
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=names)

    bytes_around, path = settled_copy(margins(docs, links), "margins")
    around = links.join(bytes_around, ["source_hash", "a", "b", "near", "far"])
    listed = around.groupBy(F.col("doc_id").alias("own_id"), F.col("text_hash").alias("own_hash")).agg(
        F.collect_list(F.struct("start", "end", "a", "n", "source_id", "source_hash", "before", "after")).alias("links")
    )
    same = F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))
    found, _ = settled_copy(docs.join(listed, same).select("doc_id", "text_hash", "text", "links").mapInArrow(run, SPANS), "spans")
    drop_copy(docs.sparkSession, path)
    return found


def _merged(found: list[dict]) -> list[list]:
    """Spans [start, end, first_doc_id, n] with those that overlap as one."""
    out: list[list] = []
    for x in sorted(found, key=lambda x: (x["start"], x["end"])):
        if out and x["start"] < out[-1][1]:
            ids = [i for i in (out[-1][2], x["first_doc_id"]) if i is not None]
            out[-1][1:] = [max(out[-1][1], x["end"]), max(ids, default=None), max(out[-1][3], x["n"])]
        else:
            out.append([x["start"], x["end"], x["first_doc_id"], x["n"]])
    return out


def disjoint(found: list[dict], least_bytes: int) -> list[tuple]:
    """(start, length, first_doc_id, n_places, is_first) of one text; what repeats an earlier place is no first copy."""
    again = _merged([x for x in found if not x["is_first"]])
    out = [(a, b - a, i, n, False) for a, b, i, n in again]
    at = 0
    for a, b, i, n in _merged([x for x in found if x["is_first"]]):
        while at < len(again) and again[at][1] <= a:
            at += 1
        begin, k, cut = a, at, False
        while k < len(again) and again[k][0] < b:
            if again[k][0] - begin >= least_bytes:
                out.append((begin, again[k][0] - begin, i, n, True))
            begin, k, cut = again[k][1], k + 1, True
        if begin < b and (not cut or b - begin >= least_bytes):
            out.append((begin, b - begin, i, n, True))
    return out


PASSAGES = "doc_id long, start long, length long, first_doc_id long, n_places long, is_first boolean"


def _place() -> Column:
    """Where a chunk stands, in order; a null doc_id comes last."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "start")


def repeated_passages(
    docs: DataFrame, average: int = 32, most: int = 4096, least_bytes: int = 160, least_words: int = 50
) -> DataFrame:
    """(doc_id, start, length, first_doc_id, n_places, is_first) of the repeated passages of all documents.

    ``start`` and ``length`` count UTF-8 bytes. Each chunk that occurs more than once has a first place: the
    smallest doc_id that holds it, and there the smallest start. Runs of chunks whose first places adjoin too are
    extended on both sides by the bytes that both places share, over ``MARGIN`` bytes or the chunk that adjoins; those of ``least_bytes`` bytes or
    ``least_words`` words are passages, here and at the first place. So are runs of ``least_bytes`` bytes of chunks
    whose first places are scattered. A passage holds either first copies or repeats of an earlier place, never
    both, and ``is_first`` says which: a dedup that keeps first copies keeps the former and may drop the latter,
    also where the earlier place is in the same document. Passages of one text don't overlap. ``first_doc_id`` is
    the largest of the first doc_ids in the passage, so that chunks met by chance in earlier documents don't
    hide where it came from. ``n_places`` is the most places that one of its chunks has. Null and empty texts have no chunks; a
    null doc_id comes after all others. A text with several rows of one id counts each row. Further columns are
    ignored; an empty table gives an empty result.

    Digests are grouped with a partial count per task before the shuffle, and only digests that occur twice
    go on, so a passage that everyone shares is one row until it is joined back.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [column.split()[0] for column in PASSAGES.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.bool_()]
        for batch in batches:
            found = [(row["doc_id"], *x) for row in batch.to_pylist() for x in disjoint(row["spans"], least_bytes)]
            if found:
                yield pa.record_batch([pa.array(v, k) for v, k in zip(zip(*found), kinds)], names=names)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    chunks = chunked(docs, average, most)
    places = (
        chunks.groupBy("digest", "length")
        .agg(F.count("*").alias("n"), F.min(_place()).alias("first"))
        .filter("n > 1")
    )
    spark = docs.sparkSession
    shared, shared_path = settled_copy(places, "digests")
    hits = chunks.join(shared, ["digest", "length"]).dropDuplicates(["doc_id", "text_hash", "chunk"])
    hits, hits_path = settled_copy(
        hits.select(
            "doc_id", "text_hash", "chunk", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("length")).cast("long").alias("end"),
            "before", "after", "n", (F.col("first") == _place()).alias("is_first"), F.col("first.doc_id").alias("source_id"),
            F.col("first.text_hash").alias("source_hash"), F.col("first.start").cast("long").alias("a"),
        ),
        "hits",
    )
    drop_copy(spark, shared_path)
    text = Window.partitionBy("doc_id", "text_hash", "is_first").orderBy("chunk")
    runs = (
        hits.withColumn("run", F.col("chunk") - F.row_number().over(text))
        .groupBy("doc_id", "text_hash", "is_first", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("source_id").alias("first_doc_id"), F.max("n").alias("n"))
        .filter(F.col("end") - F.col("start") >= least_bytes)
        .select("doc_id", "text_hash", "start", "end", "first_doc_id", "n", "is_first")
    )
    line = ["doc_id", "text_hash", "source_id", "source_hash", "shift"]
    # Repeated chunks in a row, whatever their first places, one chunk on either side of them, and the bytes that
    # decide on a cut: what a run shares with its first place ends there at the latest, as all cuts further inside
    # are the same in both texts.
    slack = average // 2 + WINDOW
    whole = Window.partitionBy("doc_id", "text_hash")
    area = Window.partitionBy("doc_id", "text_hash", "area")
    areas = hits.withColumn("area", F.col("chunk") - F.row_number().over(whole.orderBy("chunk"))).withColumns(
        {
            "low": F.min(F.col("start") - F.col("before") - slack).over(area),
            "high": F.max(F.col("end") + F.col("after") + slack).over(area),
        }
    )
    later = areas.filter(~F.col("is_first")).withColumn("shift", F.col("start") - F.col("a"))
    links = (
        later.withColumn("run", F.col("chunk") - F.row_number().over(Window.partitionBy(*line).orderBy("chunk")))
        .groupBy(*line, "run")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.min("a").alias("a"),
            F.max("n").alias("n"),
            F.min_by("before", "chunk").alias("before"),
            F.max_by("after", "chunk").alias("after"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
        )
        .withColumn("b", F.col("end") - F.col("shift"))
    )
    # An area too short for a passage holds none: fifty words have forty-nine blanks between them.
    links = links.filter(F.col("high") - F.col("low") >= min(least_bytes, 2 * least_words - 1))
    reach = {
        "near": F.least(F.col("start") - F.col("low"), F.greatest(F.lit(MARGIN), F.col("before") + slack)),
        "far": F.least(F.col("high") - F.col("end"), F.greatest(F.lit(MARGIN), F.col("after") + slack)),
    }
    links = links.withColumns({name: bound.cast("long") for name, bound in reach.items()})
    links = links.drop("shift", "run", "before", "after", "low", "high")
    links, links_path = settled_copy(links, "links")
    found = runs.union(spans(docs, links, least_bytes, least_words))
    found, _ = settled_copy(found, "found")
    drop_copy(spark, links_path)
    drop_copy(spark, hits_path)
    once = found.groupBy("doc_id", "text_hash", "start", "end", "is_first").agg(
        F.max("first_doc_id").alias("first_doc_id"), F.max("n").alias("n")
    )
    listed = once.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.struct("start", "end", "first_doc_id", "n", "is_first")).alias("spans")
    )
    return listed.select("doc_id", "spans").mapInArrow(run, PASSAGES)
