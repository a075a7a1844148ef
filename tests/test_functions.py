import datetime as dt

import pytest
from pyspark.sql import functions as F

from wickstore.functions import candles, epoch, keys
from wickstore.schema import (
    BASE_RECORD,
    CANDLE_RECORD,
    SeriesKey,
    record_type,
    register_record_type,
)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def lits(*parts):
    return [F.lit(part).cast("string") for part in parts]


def test_encode_path(spark):
    assert (
        value(spark, keys.encode_path(*lits("ohlcv", "Binance", "btc/usd", "1h")))
        == "ohlcv/binance/BTC_USD/1h"
    )


@pytest.mark.parametrize(
    "parts, reason",
    [
        ((None, "BTC", "1h"), "missing key"),
        (("binance", None, "1h"), "missing key"),
        (("binance", "BTC", None), "missing key"),
        (("", "BTC", "1h"), "empty key"),
        (("binance", "", "1h"), "empty key"),
        (("binance", "BTC", " \t"), "empty key"),
    ],
)
def test_invalid_keys(spark, parts, reason):
    assert value(spark, keys.encode_path(*lits("ohlcv", *parts))) is None
    assert value(spark, keys.key_error(*lits(*parts))) == reason


def test_outer_spaces_of_an_exchange_become_underscores(spark):
    assert value(spark, keys.normalise_exchange(F.lit(" My Exchange "))) == "_my_exchange_"
    assert keys.normalise_part("exchange", " My Exchange ") == "_my_exchange_"


def test_driver_and_column_rules_agree(spark):
    samples = [" btc/usd ", "　eth ", "a b/c", "\tX\n", "", "BTC/USDT:USDT"]
    for name in ("exchange", "coin", "interval"):
        for sample in samples:
            column = value(spark, keys.normalise(name, F.lit(sample)))
            assert column == keys.normalise_part(name, sample), (name, sample)


def test_path_prefix_stops_at_the_first_missing_part(spark):
    def prefix(*parts):
        return value(spark, keys.path_prefix(*lits(*parts)))

    assert prefix("ohlcv", None, "BTC", "1h") == "ohlcv"
    assert prefix("ohlcv", "Coinex", None, "1h") == "ohlcv/coinex"
    assert prefix("ohlcv", "Coinex", "eth/usd", None) == "ohlcv/coinex/ETH_USD"
    assert prefix("ohlcv", "Coinex", "eth/usd", "4H") == "ohlcv/coinex/ETH_USD/4h"


@pytest.mark.parametrize(
    "path, error",
    [
        ("ohlcv/coinex/ETH_USD/4h", None),
        ("/ohlcv/coinex/ETH_USD/4h/year=2024/", None),
        ("", "invalid path"),
        ("ohlcv/coinex/ETH_USD", "invalid path"),
        ("trades/coinex/ETH_USD/4h", "wrong data type"),
        (None, "invalid path"),
    ],
)
def test_decode_path(spark, path, error):
    decoded = value(spark, keys.decode_path(F.lit(path).cast("string")))
    assert decoded.error == error
    wanted = (None,) * 4 if error else ("ohlcv", "coinex", "ETH_USD", "4h")
    assert tuple(decoded)[:4] == wanted


@pytest.mark.parametrize(
    "text, any_ms, client_ms, service_ms",
    [
        ("1m", 60_000, 60_000, 60_000),
        ("5m", 300_000, 300_000, 300_000),
        ("4h", 14_400_000, 14_400_000, None),
        ("1w", 604_800_000, 604_800_000, None),
        ("1mo", 2_592_000_000, 300_000, 2_592_000_000),
        ("1y", 31_536_000_000, 300_000, 31_536_000_000),
        ("0m", None, 300_000, None),
        ("m", None, 300_000, None),
        ("9999999999999999999h", None, 300_000, None),
        ("1 h", None, 300_000, None),
    ],
)
def test_intervals(spark, text, any_ms, client_ms, service_ms):
    assert value(spark, epoch.interval_ms(F.lit(text))) == any_ms
    assert value(spark, epoch.client_interval_ms(F.lit(text))) == client_ms
    assert value(spark, epoch.service_interval_ms(F.lit(text))) == service_ms
    if any_ms is None:
        with pytest.raises(ValueError):
            epoch.interval_to_ms(text)
    else:
        assert epoch.interval_to_ms(text) == any_ms


@pytest.mark.parametrize("ms", [0, -1, -86_400_001, 1_704_067_199_999, 1_704_067_200_000])
def test_date_parts_are_utc(spark, ms):
    moment = dt.datetime(1970, 1, 1) + dt.timedelta(milliseconds=ms)
    parts = epoch.date_parts(F.lit(ms))
    row = spark.range(1).select(*[part.alias(name) for name, part in parts.items()]).first()
    assert tuple(row) == (moment.year, moment.month, moment.day)


def test_bounds():
    assert epoch.to_ms(None) is None
    assert epoch.to_ms(1_700_000_000, seconds_allowed=True) == 1_700_000_000_000
    assert epoch.to_ms(1_700_000_000) == 1_700_000_000
    assert epoch.to_ms(dt.datetime(2024, 1, 1)) == 1_704_067_200_000
    east = dt.timezone(dt.timedelta(hours=2))
    assert epoch.to_ms(dt.datetime(2024, 1, 1, 2, tzinfo=east)) == 1_704_067_200_000
    for bad in (True, 1.5, "2024"):
        with pytest.raises(TypeError):
            epoch.to_ms(bad)


def test_floor_of_negative_values(spark):
    for number in (-7, -5, -1, 0, 1, 9):
        assert value(spark, epoch.floor_div(F.lit(number), 5)) == number // 5
        assert value(spark, epoch.floor_ms(F.lit(number), 5)) == number // 5 * 5


def test_repair_ignores_absent_and_nan_prices(spark):
    rows = spark.createDataFrame(
        [(1.0, 0.5, 3.0, 2.0), (1.0, None, float("nan"), 4.0)],
        "open double, high double, low double, close double",
    )
    got = rows.select(candles.repaired_high(), candles.repaired_low()).collect()
    assert [tuple(row) for row in got] == [(2.0, 1.0), (4.0, 1.0)]


def test_unpack_short_candle_gives_nulls(spark):
    row = spark.range(1).select(*candles.unpack(F.array(F.lit("1"), F.lit("2")))).first()
    assert tuple(row) == ("1", "2", None, None, None, None)


def test_record_types():
    assert record_type("ohlcv") is CANDLE_RECORD
    for bad in (None, "", "trades"):
        with pytest.raises(ValueError):
            record_type(bad)
    register_record_type("base-for-test", BASE_RECORD)
    assert record_type("base-for-test") is BASE_RECORD


def test_series_key_is_normalised():
    key = SeriesKey(exchange="Coin Ex", coin="eth/usd")
    assert key.given() == {"data_type": "ohlcv", "exchange": "coin_ex", "coin": "ETH_USD"}
