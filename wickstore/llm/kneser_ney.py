"""Quality classifier: interpolated modified Kneser-Ney model of byte n-grams trained on trusted text.

All n-grams of all trusted documents are counted once, apart for two halves of them. Three models come from these
counts side by side, as columns of the same tables: one of each half and one of both. Continuation counts,
discounts and interpolated probabilities are joins and aggregations over the count tables. The tables are dealt into shards of bounded
size by the byte before the predicted one; each shard scores every document's bytes that fall to it, and the
sums give each document's perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy, rows_with, rows_without, small_batches
from wickstore.llm.text import SMALL_SLICE_BYTES, filled, raw, slices

ORDER = 5
#: Entries of one shard of the model, 12 bytes each in every worker.
SHARD_ENTRIES = 2_000_000
#: Trusted documents of a language at which its own limits count half against the shared ones.
PRIOR = 300
#: Models of either half of the trusted documents, and of all of them.
MODELS = (0, 1, 2)
WHOLE = 2
#: N-grams that a task holds before it hands its counts on.
HELD = 2_000_000


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each byte the n-gram that it ends, as a number; zero bytes stand before a text."""
    keys = data.astype(np.int64)
    since = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    for back in range(1, ORDER):
        earlier = np.zeros(len(data), np.int64)
        earlier[back:] = data[:-back] if back <= len(data) else 0
        earlier[since < back] = 0
        keys |= earlier << (8 * back)
    return keys


def gram_counts(texts: DataFrame) -> DataFrame:
    """(gram, c0, c1, c2): how often each n-gram ends in texts of ``half`` 0, of half 1, and of both.

    Counted in each task, then summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            grams_, halves = keys & ((1 << (8 * ORDER)) - 1), keys >> (8 * ORDER)
            return pa.record_batch(
                [pa.array(grams_), *[pa.array(np.where(halves == half, counts, 0)) for half in (0, 1)]],
                names=["gram", "c0", "c1"],
            )

        for batch in batches:
            for part in slices(batch, limit=SMALL_SLICE_BYTES):
                data, offsets = raw(filled(part.column("text")))
                half = part.column("half").to_numpy().astype(np.int64)
                own = grams(data, offsets) | np.repeat(half, np.diff(offsets)) << (8 * ORDER)
                found, times = np.unique(own, return_counts=True)
                both = np.concatenate([keys, found])
                keys, back = np.unique(both, return_inverse=True)
                counts = np.bincount(back, np.concatenate([counts, times]), len(keys)).astype(np.int64)
                if len(keys) > HELD:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        yield out()

    counted = texts.select("text", "half").mapInArrow(run, "gram long, c0 long, c1 long")
    sums = [F.sum(f"c{m}").alias(f"c{m}") for m in (0, 1)]
    return counted.groupBy("gram").agg(*sums).withColumn("c2", F.col("c0") + F.col("c1"))


def discounts(counts: DataFrame) -> list[list[float]]:
    """For each model, what is taken off counts of one, two, and three or more."""
    row = counts.agg(
        *[F.count(F.when(F.col(f"c{m}") == n, 1)).alias(f"m{m}n{n}") for m in MODELS for n in range(1, 5)]
    ).first()
    found = []
    for m in MODELS:
        n1, n2, n3, n4 = (max(1, row[f"m{m}n{n}"]) for n in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        given = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        found.append([min(max(d, 0.1), n) for n, d in enumerate(given, 1)])
    return found


def _entry(order: int, weight: bool, key: Column) -> Column:
    """Key of a probability of an n-gram, or of the weight that its context leaves to the next lower order."""
    return key.bitwiseOR(F.lit(_tag(order, weight)))


def _tag(order: int, weight: bool) -> int:
    return (2 * order + weight) << 44


def model(counts: DataFrame) -> tuple[DataFrame, str]:
    """(model, entry, value, byte): log probabilities and weights of all orders, and the folder they are read from.

    ``byte`` is the last of the context. The highest order has counts, each lower one the number of different
    bytes before its n-grams. Every table of an order is written once and deleted when the next ones have it.
    """
    spark = counts.sparkSession
    tables, used = [counts], []
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit((1 << (8 * order)) - 1)).alias("gram")
        preceded = [F.count(F.when(F.col(f"c{m}") > 0, 1)).alias(f"c{m}") for m in MODELS]
        table, path = kept_copy(tables[-1].groupBy(shorter).agg(*preceded), "continued")
        tables.append(table)
        used.append(path)
    parts, below = [], None
    for order, table in enumerate(reversed(tables), 1):
        off = {
            m: F.when(F.col(f"c{m}") == 0, 0.0).when(F.col(f"c{m}") == 1, d1).when(F.col(f"c{m}") == 2, d2).otherwise(d3)
            for m, (d1, d2, d3) in enumerate(discounts(table))
        }
        context = F.shiftright("gram", 8).alias("context")
        contexts = table.groupBy(context).agg(
            *[F.sum(f"c{m}").alias(f"total{m}") for m in MODELS],
            *[F.try_divide(F.sum(off[m]), F.sum(f"c{m}")).alias(f"weight{m}") for m in MODELS],
        )
        joined = table.withColumn("context", context).join(contexts, "context")
        if below is None:
            joined = joined.withColumns({f"lower{m}": F.lit(1 / 256) for m in MODELS})
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1))
            lower = below.select(F.col("gram").alias("suffix"), *[F.col(f"p{m}").alias(f"lower{m}") for m in MODELS])
            joined = joined.withColumn("suffix", suffix).join(lower, "suffix")
        p = [
            F.when(
                F.col(f"c{m}") > 0,
                F.greatest(F.col(f"c{m}") - off[m], F.lit(0.0)) / F.col(f"total{m}") + F.col(f"weight{m}") * F.col(f"lower{m}"),
            ).alias(f"p{m}")
            for m in MODELS
        ]
        below, path = kept_copy(joined.select("gram", *p), "order")
        used.append(path)
        last = F.shiftright("gram", 8).bitwiseAND(F.lit(255)) if order > 1 else F.lit(-1).cast("long")
        parts.append(_entries(below, _entry(order, False, F.col("gram")), "p", last))
        last = F.col("context").bitwiseAND(F.lit(255)) if order > 1 else F.lit(-1).cast("long")
        parts.append(_entries(contexts, _entry(order, True, F.col("context")), "weight", last))
    entries, path = kept_copy(reduce(DataFrame.union, parts), "model")
    for old in used:
        drop_copy(spark, old)
    return entries, path


def _entries(table: DataFrame, entry: Column, value: str, byte: Column) -> DataFrame:
    """A row for each model that has the n-gram or context."""
    each = F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"{value}{m}").alias("value")) for m in MODELS])
    rows = table.select(entry.alias("entry"), byte.alias("byte"), F.inline(each)).filter("value is not null")
    return rows.select("model", "entry", F.log("value").alias("value"), "byte")


class Shard:
    """The part of the model for contexts whose last byte falls to one shard."""

    def __init__(self, entries: np.ndarray, values: np.ndarray, shard: int, shards: int):
        self.shard, self.shards = shard, shards
        self.tables = {}
        for order in range(1, ORDER + 1):
            for weight in (False, True):
                inside = (entries >> 44) == 2 * order + weight
                self.tables[order, weight] = (entries[inside] ^ _tag(order, weight), values[inside])

    def log_probabilities(self, keys: np.ndarray) -> np.ndarray:
        """Of n-grams; those that the training text lacks fall back to lower orders, at last to 1/256."""
        total = np.zeros(len(keys))
        rows = np.arange(len(keys))
        for order in range(ORDER, 0, -1):
            own = keys[rows] & ((1 << (8 * order)) - 1)
            at, values = self._find(order, False, own)
            seen = at >= 0
            total[rows[seen]] += values[at[seen]]
            rows, own = rows[~seen], own[~seen]
            if not len(rows):
                return total
            at, values = self._find(order, True, own >> 8)
            seen = at >= 0
            total[rows[seen]] += values[at[seen]]
        total[rows] -= np.log(256)
        return total

    def _find(self, order: int, weight: bool, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, values = self.tables[order, weight]
        found = pc.index_in(pa.array(keys), value_set=pa.array(known))
        return pc.fill_null(found, -1).to_numpy(zero_copy_only=False), values

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sum of the log probabilities of each text's bytes that fall to this shard."""
        keys = grams(data, offsets)
        if self.shards > 1:
            keys = np.where((keys >> 8 & 255) % self.shards == self.shard, keys, -1)
        logs = np.zeros(len(keys))
        own = keys >= 0
        logs[own] = self.log_probabilities(keys[own])
        sums = np.concatenate([[0], np.cumsum(logs)])
        return sums[offsets[1:]] - sums[offsets[:-1]]


SCORES = "row long, doc_id long, lang string, n_bytes long, log_p double"


def scores(docs: DataFrame, entries: DataFrame, size: int) -> DataFrame:
    """(row, doc_id, lang, n_bytes, log_p): ``row`` tells texts apart, ``log_p`` is the sum over a text's bytes."""
    spark = docs.sparkSession
    shards = min(256, size // SHARD_ENTRIES + 1)
    parts = []
    for shard in range(shards):
        chosen = entries.filter((F.col("byte") < 0) | (F.pmod("byte", F.lit(shards)) == shard))
        rows = chosen.select("entry", "value").toArrow()
        order = np.argsort(rows["entry"].to_numpy())
        part = Shard(rows["entry"].to_numpy()[order], rows["value"].to_numpy()[order], shard, shards)
        parts.append(_scored(docs, spark.sparkContext.broadcast(part)))
    if shards == 1:
        return parts[0]
    rows = reduce(DataFrame.union, [p.withColumn("shard", F.lit(n)) for n, p in enumerate(parts)])
    one = rows.groupBy("row", "doc_id", "lang", "n_bytes", "shard").agg(
        F.first("log_p").alias("log_p"), F.count("*").alias("k")
    )
    summed = one.groupBy("row", "doc_id", "lang", "n_bytes").agg(F.sum("log_p").alias("log_p"), F.max("k").alias("k"))
    return summed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("k").cast("int")))).drop("copy", "k")


def _scored(docs: DataFrame, shard) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SMALL_SLICE_BYTES):
                data, offsets = raw(filled(part.column("text")))
                yield pa.record_batch(
                    [
                        part.column("row"),
                        part.column("doc_id"),
                        part.column("lang"),
                        pa.array(np.diff(offsets)),
                        pa.array(shard.value(data, offsets)),
                    ],
                    names=["row", "doc_id", "lang", "n_bytes", "log_p"],
                )

    chosen = docs.select(
        F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text"
    )
    return chosen.mapInArrow(run, SCORES)


def left_out(docs: DataFrame, entries: DataFrame, trusted: DataFrame, size: int) -> DataFrame:
    """(lang, perplexity) of the trusted documents, each under the model of the half that it is not in."""
    parts = []
    for half in (0, 1):
        held = rows_with(docs.select("doc_id", "text", "lang"), trusted.filter(F.col("half") == 1 - half), "doc_id", size)
        other = entries.filter(F.col("model") == half)
        rows, _ = kept_copy(scores(held, other, other.count()), "held")
        parts.append(rows.filter("n_bytes > 0").select("lang", F.exp(-F.col("log_p") / F.col("n_bytes")).alias("perplexity")))
    return parts[0].union(parts[1])


def rated(docs: DataFrame, trusted: DataFrame, low: float = 0.001, high: float = 0.997) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): row, doc_id, lang, n_bytes, perplexity, lowest, highest, kept.

    ``trusted`` holds the doc_id of trusted documents. The model is trained on the whole texts of all of them.
    A document is kept if its perplexity per byte lies within the limits of its language. They come from the
    ``low`` and ``high`` quantiles of trusted documents under a model that has not seen them, and hold the quantiles
    under the whole model too. Those of a language are blended with those of all trusted documents by its count
    of them, and never narrower than its own; a language without any takes the quantiles of all. Null
    and empty texts have no perplexity and are rejected. Without any trusted text every document with text is
    kept. Rows that repeat an id and text are rated alike; ``row`` is a hash of the text; further columns are
    ignored; an empty table gives an empty result.
    """
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).dropna().distinct()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    trusted, _ = kept_copy(trusted.withColumn("half", half.cast("int")), "trusted")
    size = trusted.count()
    texts = rows_with(docs.select("doc_id", "text"), trusted, "doc_id", size).withColumn("half", half)
    with small_batches(docs):
        counts, counts_path = kept_copy(gram_counts(texts), "grams")
    entries, entries_path = model(counts)
    drop_copy(docs.sparkSession, counts_path)
    whole = entries.filter(F.col("model") == WHOLE)
    with small_batches(docs):
        rows, _ = kept_copy(scores(docs, whole, whole.count()), "scores")
        held, _ = kept_copy(left_out(docs, entries, trusted, size), "held")
    drop_copy(docs.sparkSession, entries_path)
    rows = rows.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))
    known = rows.join(trusted, "doc_id", "left_semi").filter("perplexity is not null").select("lang", "perplexity")
    bounds = F.percentile_approx("perplexity", [low, high], 100_000)
    found = []
    for part in (known, held):
        found.append(part.groupBy(F.col("lang").alias("known_lang")).agg(bounds.alias("own"), F.count("*").alias("n")))
        found.append(part.agg(bounds.alias("all")).first()["all"])
    wide = [r for r in (found[1], found[3]) if r is not None]
    shared = [min(r[0] for r in wide), max(r[1] for r in wide)] if wide else [None, None]
    own = found[0].union(found[2]).groupBy("known_lang").agg(
        F.min(F.col("own")[0]).alias("least"), F.max(F.col("own")[1]).alias("most"), F.max("n").alias("n")
    )
    weight = F.col("n") / (F.col("n") + PRIOR)
    edges = [F.lit(v).cast("double") for v in shared]
    blend = [F.exp(weight * F.log(c) + (1 - weight) * F.log(e)) for c, e in zip(("least", "most"), edges)]
    limits = rows.join(own, rows["lang"].eqNullSafe(F.col("known_lang")), "left").withColumn(
        "limits",
        F.when(F.col("n").isNull(), F.array(*edges)).otherwise(
            F.array(F.least("least", blend[0]), F.greatest("most", blend[1]))
        ),
    )
    inside = F.col("perplexity").between(F.col("limits")[0], F.col("limits")[1])
    return limits.select(
        "row",
        "doc_id",
        "lang",
        "n_bytes",
        "perplexity",
        F.col("limits")[0].alias("lowest"),
        F.col("limits")[1].alias("highest"),
        (F.col("perplexity").isNotNull() & F.coalesce(inside, F.lit(True))).alias("kept"),
    )


def good_documents(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that ``rated`` keeps."""
    rejected = rated(docs, trusted).filter(~F.col("kept"))
    gone, _ = kept_copy(rejected.select(F.xxhash64("row", "lang").alias("_row")).distinct(), "rejected")
    marked = docs.withColumn("_row", F.xxhash64(F.xxhash64("text"), F.col("lang").cast("string")))
    return rows_without(marked, gone, "_row", gone.count()).select(*docs.columns)
