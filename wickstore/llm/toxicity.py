"""Toxicity: a convolutional text classifier in numpy over hashed word embeddings.

A word's vector is the sum of the embeddings of its hashed features: the word and its first three to eight
bytes. Filters over one, two and three words are max-pooled in windows of ``POOL`` words; the largest and the
mean of the windows' maxima enter a logistic layer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import kept_copy
from wickstore.llm.text import PLAIN, Words, filled, mixed, raw, slices, translated, words

BUCKETS = 1 << 15
DIMENSIONS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
POOL = 32
PREFIXES = (3, 4, 5, 6, 7, 8)


def features(vocabulary: pa.StringArray) -> np.ndarray:
    """Buckets of each word's features, one row a word; missing prefixes have bucket 0, which stays zero."""
    data, offsets = raw(vocabulary)
    starts, lengths = offsets[:-1], np.diff(offsets)
    out = np.zeros((len(starts), len(PREFIXES) + 1), np.int32)
    state = np.zeros(len(starts), np.uint64)
    limit = int(lengths.max(initial=0))
    for n in range(limit):
        live = np.flatnonzero(lengths > n)
        letters = data[starts[live] + n].astype(np.uint64)
        state[live] = (state[live] + letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        state[live] ^= state[live] >> np.uint64(29)
        if n + 1 in PREFIXES:
            out[live, PREFIXES.index(n + 1)] = 1 + mixed(state[live]) % np.uint64(BUCKETS - 1)
    out[:, -1] = 1 + mixed(state ^ np.uint64(0xABCDEF)) % np.uint64(BUCKETS - 1)
    return out


class Network:
    """Embeddings, filters and logistic layer, with forward and backward passes and Adam steps."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.embedding[0] = 0
        self.filters = [
            rng.normal(0, 0.5, (w, DIMENSIONS, FILTERS)).astype(np.float32) for w in WIDTHS
        ]
        self.offsets = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        width = len(WIDTHS) * FILTERS
        self.weights = rng.normal(0, 0.2, 2 * width).astype(np.float32)
        self.bias = np.zeros(1, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.offsets, self.weights, self.bias]

    def vectors(self, vocabulary: pa.StringArray) -> np.ndarray:
        """Embedding of each word of a vocabulary."""
        rows = features(vocabulary)
        total = self.embedding[rows[:, 0]]
        for column in range(1, rows.shape[1]):
            total = total + self.embedding[rows[:, column]]
        return total

    def pooled(self, vectors: np.ndarray, starts: np.ndarray, trace: bool = False):
        """Window maxima of all filters (windows x filters), the first window of each text, and, to trace,
        the word at which each maximum stands.

        A filter reads zeros beyond the end of its text. A text without words has one window of zeros.
        """
        lengths = np.diff(starts)
        windows = np.maximum(-(-lengths // POOL), 1)
        first = np.concatenate([[0], np.cumsum(windows)])
        text = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(vectors)) - starts[text]
        row = first[text] + place // POOL
        out = np.zeros((first[-1], len(WIDTHS) * FILTERS), np.float32)
        where = np.full(out.shape, -1, np.int64) if trace else None
        if not len(vectors):
            return out, first, where
        heads = np.flatnonzero(np.diff(row, prepend=-1))
        for k, (kernel, offset) in enumerate(zip(self.filters, self.offsets)):
            made = vectors @ kernel[0]
            for j in range(1, kernel.shape[0]):
                ahead = np.zeros_like(made)
                ahead[:-j] = (vectors @ kernel[j])[j:] if len(vectors) > j else 0
                ahead[place >= lengths[text] - j] = 0
                made += ahead
            made += offset
            columns = slice(k * FILTERS, (k + 1) * FILTERS)
            best = np.maximum.reduceat(made, heads, axis=0)
            out[row[heads], columns] = np.maximum(best, 0)
            if trace:
                hit = made == best[np.searchsorted(row[heads], row)]
                for f in range(FILTERS):
                    at = np.flatnonzero(hit[:, f] & (made[:, f] > 0))
                    where[row[at], k * FILTERS + f] = at
        return out, first, where

    def summary(self, maxima: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(first)[:, None]
        return np.hstack(
            [np.maximum.reduceat(maxima, first[:-1]), np.add.reduceat(maxima, first[:-1]) / counts * 4]
        )

    def logits(self, found: Words) -> np.ndarray:
        vectors = self.vectors(found.vocabulary)[found.codes]
        maxima, first, _ = self.pooled(vectors, found.starts)
        return self.summary(maxima, first) @ self.weights + self.bias[0]

    def gradients(self, found: Words, labels: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        rows = features(found.vocabulary)
        vectors = self.embedding[rows].sum(axis=1)[found.codes]
        maxima, first, where = self.pooled(vectors, found.starts, trace=True)
        seen = self.summary(maxima, first)
        p = 1 / (1 + np.exp(-(seen @ self.weights + self.bias[0])))
        loss = -np.mean(weight * np.where(labels == 1, np.log(p + 1e-9), np.log(1 - p + 1e-9)))
        gap = (weight * (p - labels) / len(labels)).astype(np.float32)
        width = maxima.shape[1]
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        back = gap[text, None] * self.weights[width:] * 4 / np.diff(first)[text, None]
        top = np.maximum.reduceat(maxima, first[:-1])[text] == maxima
        back = np.where(top, back + gap[text, None] * self.weights[:width], back)
        into = np.zeros_like(vectors)
        kernels = [np.zeros_like(k) for k in self.filters]
        offsets = [np.zeros_like(o) for o in self.offsets]
        owner = np.repeat(np.arange(len(found.starts) - 1), np.diff(found.starts))
        ends = found.starts[1:]
        for k, kernel in enumerate(self.filters):
            for f in range(FILTERS):
                column = k * FILTERS + f
                live = np.flatnonzero(where[:, column] >= 0)
                at, slope = where[live, column], back[live, column]
                offsets[k][f] = slope.sum()
                for j in range(kernel.shape[0]):
                    inside = at + j < ends[owner[at]] if len(at) else np.zeros(0, bool)
                    spot, s = at[inside] + j, slope[inside]
                    kernels[k][j, :, f] = s @ vectors[spot]
                    for d in range(DIMENSIONS):
                        into[:, d] += np.bincount(spot, s * kernel[j, d, f], len(into))
        table = np.zeros((len(rows), DIMENSIONS), np.float32)
        for d in range(DIMENSIONS):
            table[:, d] = np.bincount(found.codes, into[:, d], len(rows))
        embedding = np.zeros_like(self.embedding)
        for d in range(DIMENSIONS):
            embedding[:, d] = np.bincount(
                rows.ravel(), np.repeat(table[:, d], rows.shape[1]), len(embedding)
            )
        embedding[0] = 0
        return [embedding, *kernels, *offsets, gap @ seen, gap.sum(keepdims=True)], float(loss)


def fitted(texts: list[str], labels: np.ndarray, prior: float, epochs: int = 8, batch: int = 64, rate: float = 0.01) -> Network:
    """A network trained by Adam on texts with labels 0 and 1.

    ``prior`` is the share of label 1 outside of the sample; the bias is shifted to it at the end. With one
    label only, or none, the network gives that prior everywhere.
    """
    network = Network()
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        network.weights[:] = 0
        network.bias[:] = np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))
        return network
    rng = np.random.default_rng(11)
    means = [np.zeros_like(p) for p in network.parameters()]
    squares = [np.zeros_like(p) for p in network.parameters()]
    order = np.argsort([len(t) for t in texts], kind="stable")
    groups = [order[n : n + batch] for n in range(0, len(order), batch)]
    step = 0
    for epoch in range(epochs):
        for g in rng.permutation(len(groups)):
            chosen = groups[g]
            found = words(translated(pa.array([texts[i] for i in chosen], pa.string()), PLAIN))
            slopes, _ = network.gradients(found, labels[chosen], np.ones(len(chosen), np.float32))
            step += 1
            pace = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for p, slope, m, v in zip(network.parameters(), slopes, means, squares):
                m += 0.1 * (slope - m)
                v += 0.001 * (slope * slope - v)
                p -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
            network.embedding[0] = 0
    network.bias += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return network


def is_held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, each: int, most_bytes: int) -> tuple[list[str], np.ndarray, float]:
    """Texts and labels to fit on, and the share of label 1 among all labelled rows that may be learnt from.

    At most ``each`` documents of either label, of ``most_bytes`` bytes at most, chosen by hash of the text.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~is_held_out())
    known, _ = kept_copy(known.dropDuplicates(["doc_id"]), "known")
    row = known.agg(F.avg("toxic").alias("share"), F.count("*").alias("n")).first()
    if not row["n"]:
        return [], np.zeros(0, np.float32), 0.0
    order = F.xxhash64(F.lit(3), "doc_id")
    chosen = [known.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(2 * each) for label in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes)
    rows = []
    for part in chosen:
        found = texts.join(F.broadcast(part), "doc_id").orderBy(F.xxhash64("text"), "doc_id").limit(each)
        rows += found.select("text", "toxic").collect()
    rows = [r for r in rows if r["text"]]
    share = min(max(row["share"], 1e-3), 1 - 1e-3)
    return [r["text"] for r in rows], np.array([r["toxic"] for r in rows], np.float32), share


def thresholds(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """(lang, threshold): the score above which flags agree best (F1) with the labels that may be learnt from.

    Scores are counted in hundredths per language and label; only these counts reach one task per language.
    """
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)").filter(~is_held_out())
    bins = (
        scored.join(known.dropDuplicates(["doc_id"]), "doc_id")
        .groupBy("lang", F.floor(F.col("score") * 100).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("ones"))
    )

    def best(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bin", ascending=False)
        flagged, right = frame["n"].cumsum(), frame["ones"].cumsum()
        f1 = 2 * right / (flagged + frame["ones"].sum())
        limit = 0.5 if not frame["ones"].sum() else frame["bin"].iloc[int(f1.argmax())] / 100
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "threshold": [float(limit)]})

    return bins.groupBy("lang").applyInPandas(best, "lang string, threshold double")


def scored(docs: DataFrame, labels: DataFrame, each: int = 2000, most_bytes: int = 16384) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, held_out, score, predicted, lang_threshold, flagged.

    ``labels`` has doc_id and toxic. A document is held out if crc32 of its id as text is divisible by five;
    the network learns from a bounded sample of the others, at most ``each`` of either label and
    ``most_bytes`` bytes each, and scores every whole text. The text alone makes the score; ``predicted`` is
    1 from 0.5 on; ``flagged`` holds the score against a threshold calibrated on the other labelled rows of
    the language (0.5 where there are none). Null and empty texts are scored like a text without words.
    Without labels every score is 0.001. A null id is not held out. Repeated rows give repeated rows; further
    columns are ignored; an empty table gives an empty result.
    """
    texts, marks, prior = sample(docs, labels, each, most_bytes)
    network = docs.sparkSession.sparkContext.broadcast(fitted(texts, marks, prior))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                found = words(translated(filled(part.column("text")), PLAIN))
                score = 1 / (1 + np.exp(-np.clip(network.value.logits(found).astype(float), -60, 60)))
                yield pa.record_batch(
                    [part.column("doc_id"), part.column("lang"), pa.array(score)],
                    names=["doc_id", "lang", "score"],
                )

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows, _ = kept_copy(chosen.mapInArrow(run, "doc_id long, lang string, score double"), "scores")
    limits = thresholds(rows, labels).select(F.col("lang").alias("known_lang"), "threshold")
    limit = F.coalesce("threshold", F.lit(0.5))
    return rows.join(limits, rows["lang"].eqNullSafe(F.col("known_lang")), "left").select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("lang_threshold"),
        (F.col("score") >= limit).alias("flagged"),
    )
