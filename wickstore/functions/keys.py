"""Series keys as columns: normalise, encode to a path, decode from a path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickstore.schema import KEY

# The characters stripped from both ends of a key part (Unicode white space).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITE_SPACE))


def normalise_exchange(col: Column) -> Column:
    # Spaces turn into underscores before the ends are stripped, so outer spaces stay visible.
    return _strip(F.replace(F.lower(col), F.lit(" "), F.lit("_")))


def normalise_coin(col: Column) -> Column:
    return _strip(F.replace(F.upper(col), F.lit("/"), F.lit("_")))


def normalise_interval(col: Column) -> Column:
    return _strip(F.lower(col))


_NORMALISERS = {
    "data_type": lambda col: col,
    "exchange": normalise_exchange,
    "coin": normalise_coin,
    "interval": normalise_interval,
}


def normalise(name: str, col: Column) -> Column:
    return _NORMALISERS[name](col)


def normalised(df: DataFrame, names: Sequence[str] = KEY) -> DataFrame:
    """``df`` with its key columns as they are stored, so that ``BTC/USD`` meets ``BTC_USD``."""
    present = [name for name in names if name in df.columns and name in _NORMALISERS]
    return df.withColumns({name: normalise(name, F.col(name)) for name in present})


def comparable(name: str, col: Column) -> Column:
    """A key part as it is stored; any other column as it is."""
    return normalise(name, col) if name in _NORMALISERS else col


def normalise_part(name: str, value: str) -> str:
    """The same rules for one value on the driver, for lookups."""
    if name == "exchange":
        return value.lower().replace(" ", "_").strip(WHITE_SPACE)
    if name == "coin":
        return value.upper().replace("/", "_").strip(WHITE_SPACE)
    if name == "interval":
        return value.lower().strip(WHITE_SPACE)
    return value


def key_error(exchange: Column, coin: Column, interval: Column) -> Column:
    """Why a key cannot be stored, or null when it can."""
    parts = [normalise_exchange(exchange), normalise_coin(coin), normalise_interval(interval)]
    missing = exchange.isNull() | coin.isNull() | interval.isNull()
    empty = (parts[0] == "") | (parts[1] == "") | (parts[2] == "")
    return F.when(missing, F.lit("missing key")).when(empty, F.lit("empty key"))


def encode_path(data_type: Column, exchange: Column, coin: Column, interval: Column) -> Column:
    """``data_type/exchange/COIN/interval``, or null when the key is invalid."""
    path = F.concat_ws(
        "/",
        data_type,
        normalise_exchange(exchange),
        normalise_coin(coin),
        normalise_interval(interval),
    )
    return F.when(key_error(exchange, coin, interval).isNull(), path)


def path_prefix(data_type: Column, exchange: Column, coin: Column, interval: Column) -> Column:
    """The longest prefix the given parts allow; a missing part ends the prefix."""
    has_coin = exchange.isNotNull() & coin.isNotNull()
    has_interval = has_coin & interval.isNotNull()
    return F.concat_ws(
        "/",
        data_type,
        normalise_exchange(exchange),
        F.when(has_coin, normalise_coin(coin)),
        F.when(has_interval, normalise_interval(interval)),
    )


def decode_path(path: Column, data_type: str = "ohlcv") -> Column:
    """Struct of the key parts and ``error``; parts are null when the path is invalid."""
    parts = F.split(F.btrim(path, F.lit("/")), "/")
    error = F.when(path.isNull() | (F.size(parts) < 4), F.lit("invalid path")).when(
        F.get(parts, 0) != data_type, F.lit("wrong data type")
    )
    valid = error.isNull()
    return F.struct(
        F.when(valid, F.get(parts, 0)).alias("data_type"),
        F.when(valid, F.get(parts, 1)).alias("exchange"),
        F.when(valid, F.get(parts, 2)).alias("coin"),
        F.when(valid, F.get(parts, 3)).alias("interval"),
        error.alias("error"),
    )
