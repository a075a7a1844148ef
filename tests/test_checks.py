"""What landed against what was planned, and a copy against its original."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from helpers import DAY_1, candle, frame, hours
from wickstore.operators import sets
from wickstore.schema import HOUR_MS, KEY, TS, VALUES
from wickstore.sources import pages

LIMIT = 10
ANSWER = "data_type string, exchange string, coin string, interval string, since long, candles array<array<string>>"


def planned(spark, spans):
    """The plan for (coin, first hour, end hour) requests."""
    rows = [("ohlcv", "binance", coin, "1h", DAY_1 + a * HOUR_MS, DAY_1 + b * HOUR_MS) for coin, a, b in spans]
    requests = spark.createDataFrame(rows, "data_type string, exchange string, coin string, interval string, start long, end long")
    return pages.page_plan(requests, LIMIT)


def landed(spark, answers):
    """Answers as (coin, hour asked for, hours of the candles)."""
    return spark.createDataFrame(
        [
            ("ohlcv", "Binance", coin, "1H", DAY_1 + since * HOUR_MS, [[str(DAY_1 + h * HOUR_MS), "1"] for h in got])
            for coin, since, got in answers
        ],
        ANSWER,
    )


def open_parts(spark, spans, answers):
    found = pages.pages_to_fetch(planned(spark, spans), landed(spark, answers), LIMIT).collect()
    hour = lambda ms: (ms - DAY_1) // HOUR_MS
    return sorted((r.coin, r.page, hour(r.fetch_start), hour(r.fetch_end), r.reason) for r in found)


def brute(spans, answers):
    out = []
    for coin, first, end in spans:
        for page, start in enumerate(range(first, end, LIMIT)):
            stop, covered, empty = min(start + LIMIT, end), set(), False
            for c, since, got in answers:
                got = [h for h in got if h >= since]
                if c == coin and got:
                    covered |= set(range(since, max(got) + 1))
                if c == coin and not got and start <= since < stop:
                    empty = True
            inside = covered & set(range(start, stop))
            reason = "short" if inside else "empty" if empty else "absent"
            left = [h for h in range(start, stop) if h not in covered]
            while left:
                n = 1
                while n < len(left) and left[n] == left[0] + n:
                    n += 1
                out.append((coin, page, left[0], left[0] + n, reason))
                left = left[n:]
    return sorted(out)


def test_parts_to_fetch_by_reason(spark):
    spans = [("A", 0, 35), ("B", 3, 9)]
    answers = [("A", 0, range(10)), ("A", 10, [10, 14]), ("A", 12, [13]), ("A", 17, [17]), ("A", 20, [])]
    want = [("A", 1, 15, 17, "short"), ("A", 1, 18, 20, "short"), ("A", 2, 20, 30, "empty"), ("A", 3, 30, 35, "absent")]
    assert open_parts(spark, spans, answers) == want + [("B", 0, 3, 9, "absent")]
    assert open_parts(spark, spans, answers * 50) == open_parts(spark, spans, answers)


def test_parts_to_fetch_against_brute_force(spark):
    random.seed(8)
    spans = [("A", 0, 200), ("B", 7, 93), ("C", 50, 51)]
    answers = []
    for _ in range(45):
        since = random.randint(-15, 190)
        got = sorted(random.sample(range(since - 2, since + random.choice([5, 12, 40])), random.randint(0, 4)))
        answers.append((random.choice("ABC"), since, got))
    assert open_parts(spark, spans, answers) == brute(spans, answers)
    assert open_parts(spark, spans, []) == brute(spans, [])


def test_complete_answers_leave_nothing(spark):
    answers = [("A", n, range(n, n + 10)) for n in range(0, 40, 10)]
    assert open_parts(spark, [("A", 0, 40)], answers) == []
    spark_empty = landed(spark, [("A", 0, [])]).withColumn("candles", F.lit(None).cast("array<array<string>>"))
    assert pages.pages_to_fetch(planned(spark, [("A", 0, 4)]), spark_empty, LIMIT).first().reason == "empty"


# ------------------------------------------------------------------------ verify


def told(spark, a, b):
    rows = sets.verify(frame(spark, a), frame(spark, b)).collect()
    return Counter({(tuple(r)[: len(KEY) + 1 + len(VALUES)], r.side): r.copies for r in rows})


def test_one_changed_one_doubled_one_lost(spark):
    rows = hours(DAY_1, 200) + hours(DAY_1, 50, "ETH_USD")
    changed = (*rows[70][:8], 1.0, rows[70][9])
    copy = rows[:70] + [changed] + rows[71:150] + rows[151:] + [rows[210]]
    random.shuffle(copy)
    want = {(rows[70], "a"): 1, (changed, "b"): 1, (rows[150], "a"): 1, (rows[210], "b"): 1}
    assert told(spark, rows, copy) == want
    assert told(spark, rows, rows[::-1]) == {}


@pytest.mark.parametrize("extra", [1, 3])
def test_copies_are_counted(spark, extra):
    rows = hours(DAY_1, 5) + hours(DAY_1, 2) * 4
    assert told(spark, rows, rows + [rows[0]] * extra) == {(rows[0], "b"): extra}
    # Two rows that swap a value keep every sum of values, but not of digests.
    a, b = candle(DAY_1, value=1.0), candle(DAY_1 + HOUR_MS, value=2.0)
    swapped = [(*a[:5], *b[5:]), (*b[:5], *a[5:])]
    assert sum(told(spark, [a, b], swapped).values()) == 4


def test_nulls_and_columns_in_another_order(spark):
    rows = frame(spark, hours(DAY_1, 30)).withColumn("close", F.when(F.col(TS) > DAY_1, F.col("close")))
    rows = rows.withColumn("coin", F.when(F.col("open") < 120, F.col("coin")))
    assert sets.verify(rows, rows.select(*reversed(rows.columns))).isEmpty()
    assert sets.verify(rows, rows.filter("coin is not null")).count() == 10
    assert sets.verify(rows.limit(0), rows.limit(0)).isEmpty()
