"""Quality rules by robust multivariate outliers.

Statistics of each text are transformed to roughly normal scales. Per language and source, concentration
steps find the minimum-covariance-determinant estimate: mean and covariance of the rows that lie closest to
them. One reweighting step takes the estimate of all rows that are not outlying under it. A group's estimate is
regularised towards that of its language with a fixed weight in rows, which decides in groups of a few rows and
vanishes in large ones. A row is rejected when its Mahalanobis distance is beyond a chi-square quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.llm.common import drop_copy, kept_copy
from wickstore.llm.text import SHINGLE, filled, raw, slices, windows, words

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
BLANKS = b" \t\n\v\f\r"
GROUP = ("lang", "source")
#: Share of the rows that a concentration step keeps.
CORE = 0.75
STEPS = 4
#: Quantile within which rows count in the reweighting step.
INSIDE = 0.99
#: Rows of its language that a group's covariance and its center weigh in.
COVARIANCE_ROWS = 30
CENTER_ROWS = 3
#: Least variance of each transformed statistic, so that one that hardly varies rejects nothing by itself.
FLOOR = 0.02

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FURTHER = ("n_capitals", "n_marks", "n_digits")
#: Counts that enter as shares of the characters, with the scale of their square root.
SHARES = {"n_symbols": 5, "n_capitals": 5, "n_marks": 5, "n_digits": 2}
#: Words of the average text that smooth a text's shares.
PRIOR_WORDS = 40


def _repeated_words(hashes: np.ndarray, starts: np.ndarray) -> list[int]:
    values, at = windows(hashes, starts)
    out = []
    for a, b, first, end in zip(at[:-1], at[1:], starts[:-1], starts[1:]):
        own = values[a:b]
        unique, back, counts = np.unique(own, return_inverse=True, return_counts=True)
        if len(unique) == len(own):
            out.append(0)
            continue
        covered = np.zeros(end - first + 1, np.int64)
        again = np.flatnonzero(counts[back] > 1)
        np.add.at(covered, again, 1)
        np.add.at(covered, again + SHINGLE, -1)
        out.append(int((np.cumsum(covered)[:-1] > 0).sum()))
    return out


def _dup_lines(text: bytes) -> int:
    seen, again = set(), 0
    for line in text.split(b"\n"):
        if line.strip(BLANKS):
            again += line in seen
            seen.add(line)
    return again


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts for each document, with its language and source.

    ``n_words`` words of the whole text; ``word_chars`` code points in them; ``n_symbols`` of ``#*$%&|<>``;
    ``n_dup_lines`` lines with a word that equal an earlier line; ``n_repeat_words`` words inside 5-word
    windows found twice or more in the text; ASCII capitals, punctuation marks (no digits) and digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
            before = np.concatenate([[0], np.cumsum(flags)])
            return before[offsets[1:]] - before[offsets[:-1]]

        for batch in batches:
            for part in slices(batch):
                texts = filled(part.column("text"))
                data, offsets = raw(texts)
                found = words(texts)
                code_points = (data & 0xC0) != 0x80
                blank = (data == 32) | ((data >= 9) & (data <= 13))
                capital = (data >= 65) & (data <= 90)
                digit = (data >= 48) & (data <= 57)
                mark = (data > 32) & (data < 127) & ~capital & ~digit & ~((data >= 97) & (data <= 122))
                view = data.tobytes()
                lines = [_dup_lines(view[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
                columns = [
                    np.diff(found.starts),
                    sums(code_points & ~blank, offsets),
                    sums(SYMBOLS[data], offsets),
                    np.array(lines, np.int64),
                    np.array(_repeated_words(found.hashes(), found.starts), np.int64),
                    sums(capital, offsets),
                    sums(mark, offsets),
                    sums(digit, offsets),
                ]
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), part.column("lang"), part.column("source")]
                    + [pa.array(c.astype(np.int64)) for c in columns],
                    names=["doc_id", *GROUP, *COUNTS, *FURTHER],
                )

    schema = "doc_id long, lang string, source string, " + ", ".join(
        f"{name} long" for name in (*COUNTS, *FURTHER)
    )
    return docs.select("doc_id", *[F.col(g).cast("string") for g in GROUP], "text").mapInArrow(run, schema)


def vector(stats: DataFrame) -> list[Column]:
    """The transformed statistics: sizes by logarithm, shares of characters or words by square root.

    Shares and the mean word length of a text are smoothed by ``PRIOR_WORDS`` words like those of all ``stats``,
    so that a handful of words is no outlier for its few counts. Digits have a low scale: most texts have none
    and good ones have numbers, so only many of them stand out.
    """
    totals = stats.agg(*[F.sum(n).alias(n) for n in ("n_words", "word_chars", *SHARES)]).first()
    words = float(totals["n_words"] or 1)
    prior_chars = PRIOR_WORDS * (totals["word_chars"] or 0) / words
    count = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars") + prior_chars, F.lit(1.0))

    def share(name: str, scale: int) -> Column:
        return F.sqrt((F.col(name) + PRIOR_WORDS * (totals[name] or 0) / words) / chars) * scale

    return [
        F.log(count) / 2,
        F.log(chars / (count + PRIOR_WORDS)) * 3,
        *[share(name, scale) for name, scale in SHARES.items()],
    ]


DIMENSIONS = 6
FITS = "lang string, source string, center array<double>, inverse array<double>, scale double"


def _chi_square(p: float, d: int) -> float:
    """Quantile of the chi-square distribution by Wilson and Hilferty's cube."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * math.sqrt(2 / (9 * d))) ** 3


def _distance() -> Column:
    """Squared Mahalanobis distance of ``v`` from ``center`` under ``inverse``."""
    gaps = [F.col("v")[i] - F.col("center")[i] for i in range(DIMENSIONS)]
    terms = [
        F.col("inverse")[i * DIMENSIONS + j] * gaps[i] * gaps[j]
        for i in range(DIMENSIONS)
        for j in range(DIMENSIONS)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]


def _moments(rows: DataFrame) -> DataFrame:
    """Count, sums and sums of products per group and of its language, pre-aggregated in each task.

    A language's products ``w`` are summed around the centers of its groups.
    """
    aggregates = [F.count("*").alias("n")]
    aggregates += [F.sum(F.col("v")[i]).alias(f"s{i}") for i in range(DIMENSIONS)]
    aggregates += [F.sum(F.col("v")[i] * F.col("v")[j]).alias(f"p{i}_{j}") for i, j in PAIRS]
    groups = rows.groupBy(*GROUP).agg(*aggregates)
    around = [F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")) for i, j in PAIRS]
    languages = groups.groupBy(F.col("lang").alias("of")).agg(
        F.sum("n").alias("all_n"),
        *[F.sum(f"s{i}").alias(f"all_s{i}") for i in range(DIMENSIONS)],
        *[total.alias(f"w{i}_{j}") for (i, j), total in zip(PAIRS, around)],
    )
    return groups.join(languages, F.col("lang").eqNullSafe(F.col("of"))).drop("of")


def _fits(moments: DataFrame) -> DataFrame:
    """Center and inverse covariance of each group from its sums, regularised towards its language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            centers, inverses = [], []
            for row in frame.to_dict("records"):
                n = row["n"]
                sums = np.array([row[f"s{i}"] for i in range(DIMENSIONS)])
                mean = sums / n
                shared = np.array([row[f"all_s{i}"] for i in range(DIMENSIONS)]) / row["all_n"]
                cov = np.empty((DIMENSIONS, DIMENSIONS))
                for i, j in PAIRS:
                    own = row[f"p{i}_{j}"] - n * mean[i] * mean[j]
                    weighed = COVARIANCE_ROWS * row[f"w{i}_{j}"] / row["all_n"]
                    cov[i, j] = cov[j, i] = (own + weighed) / (n + COVARIANCE_ROWS)
                cov[np.diag_indices(DIMENSIONS)] = np.maximum(cov.diagonal(), 0) + FLOOR
                centers.append((sums + CENTER_ROWS * shared) / (n + CENTER_ROWS))
                inverses.append(np.linalg.inv(cov).ravel())
            yield pd.DataFrame(
                {
                    "lang": frame["lang"],
                    "source": frame["source"],
                    "center": centers,
                    "inverse": inverses,
                    "scale": 1.0,
                }
            )

    return moments.mapInPandas(run, FITS)


def _with_fit(rows: DataFrame, fits: DataFrame) -> DataFrame:
    same = [rows[g].eqNullSafe(fits[g]) for g in GROUP]
    return rows.join(fits, same[0] & same[1], "left").select(
        rows["*"], *[fits[c] for c in fits.columns if c not in GROUP]
    )


def _scaled(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """``rows`` with ``distance``: the squared distance, scaled down where its median in the group is too large.

    The median is regularised towards the language's like the covariance, or a lone row would excuse itself.
    """
    measured = _with_fit(rows, fits).withColumn("d", _distance()).drop("center", "inverse", "scale")
    median = F.percentile_approx("d", 0.5, 2000)
    shared = measured.groupBy(F.col("lang").alias("of")).agg(median.alias("all_middle"))
    own = measured.groupBy(*GROUP).agg(F.count("*").alias("n"), median.alias("own_middle"))
    weighed = F.col("n") * F.col("own_middle") + COVARIANCE_ROWS * F.col("all_middle")
    middle = own.join(shared, F.col("lang").eqNullSafe(F.col("of"))).select(
        *GROUP, (weighed / (F.col("n") + COVARIANCE_ROWS)).alias("middle")
    )
    half = _chi_square(0.5, DIMENSIONS)
    distance = F.col("d") * half / F.greatest("middle", F.lit(half))
    return _with_fit(measured, middle).withColumn("distance", distance).drop("d", "middle")


def outliers(stats: DataFrame, quantile: float = 0.99999) -> DataFrame:
    """``stats`` with ``distance`` and ``outlier``.

    The start is the median of each statistic with its quartile spread; each of the ``STEPS`` concentration
    steps keeps the ``CORE`` of a group closest to the estimate and takes their mean and covariance; the last
    step keeps the rows within ``INSIDE``, and the earlier estimate of a group without any. All rows take part; none is sampled. Covariances get ``FLOOR`` added
    on the diagonal. Groups with a null language or source are groups like others. Distances with a median
    beyond that of a chi-square distribution are scaled down to it.
    """
    rows = stats.filter(F.col("n_words") > 0)
    rows, _ = kept_copy(rows.withColumn("v", F.array(*vector(rows))), "vectors")
    quartiles = rows.groupBy(*GROUP).agg(
        *[F.percentile_approx(F.col("v")[i], [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i in range(DIMENSIONS)]
    )
    spread = [F.pow((F.col(f"q{i}")[2] - F.col(f"q{i}")[0]) / 1.35, 2) + FLOOR for i in range(DIMENSIONS)]
    fits = quartiles.select(
        *GROUP,
        F.array(*[F.col(f"q{i}")[1] for i in range(DIMENSIONS)]).alias("center"),
        F.array(
            *[1 / spread[i] if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
        ).alias("inverse"),
        F.lit(1.0).alias("scale"),
    )
    fits, path = kept_copy(fits, "fits")
    for _ in range(STEPS):
        measured = _with_fit(rows, fits).withColumn("d", _distance())
        limits = measured.groupBy(*GROUP).agg(F.percentile_approx("d", CORE, 2000).alias("limit"))
        core = _with_fit(measured.drop("center", "inverse", "scale"), limits).filter("d <= limit")
        fits, next_path = kept_copy(_fits(_moments(core)), "fits")
        drop_copy(stats.sparkSession, path)
        path = next_path
    inner = _scaled(rows, fits).filter(F.col("distance") <= _chi_square(INSIDE, DIMENSIONS))
    again, again_path = kept_copy(_fits(_moments(inner)), "fits")
    none_inside = fits.join(again, [fits[g].eqNullSafe(again[g]) for g in GROUP], "left_anti")
    fits, _ = kept_copy(again.unionByName(none_inside), "fits")
    drop_copy(stats.sparkSession, path)
    drop_copy(stats.sparkSession, again_path)
    limit = _chi_square(quantile, DIMENSIONS)
    return _scaled(rows, fits).drop("v").withColumn(
        "outlier", F.col("distance") > limit
    ).unionByName(
        stats.filter(F.col("n_words") == 0).withColumns(
            {"distance": F.lit(None).cast("double"), "outlier": F.lit(True)}
        )
    )


def quality(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, source): the counts, ``base_failed``, ``distance``, ``kept``.

    A text fails the base rule with fewer than ten words or with more than a fifth of its words in repeated
    5-word windows; a null, empty or blank text has no words and fails. Other texts are kept unless they are
    outliers of their language and source. Repeated rows are rated alike; further columns are ignored; an
    empty table gives an empty result.
    """
    stats, _ = kept_copy(statistics(docs), "stats")
    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        outliers(stats)
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("outlier"))
    )
