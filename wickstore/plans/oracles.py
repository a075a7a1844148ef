"""The same results in SQL for DuckDB, one statement per query."""

from __future__ import annotations

JAN_5, JAN_9, JAN_10, JAN_15, JAN_20 = (
    1704412800000,
    1704758400000,
    1704844800000,
    1705276800000,
    1705708800000,
)
HOUR, MINUTE, DAY = 3600000, 60000, 86400000
KEY = 'data_type, exchange, coin, "interval"'
ROW = f'{KEY}, "timestamp", open, high, low, close, volume'


def _candles(interval: str, step: int) -> str:
    return f"""
SELECT 'ohlcv' AS data_type, 'synthetic' AS exchange, upper(event_type) AS coin,
       '{interval}' AS "interval", (epoch_us(ts) // 1000) // {step} * {step} AS "timestamp",
       arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close,
       CAST(sum(CAST(value AS DECIMAL(18, 2))) AS DOUBLE) AS volume
FROM events GROUP BY ALL"""


_DAILY = f"""
SELECT 'ohlcv' AS data_type, 'synthetic' AS exchange, upper(o_orderpriority) AS coin,
       '1d' AS "interval", (epoch_us(o_orderdate) // 1000) // {DAY} * {DAY} AS "timestamp",
       arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open,
       max(o_totalprice) AS high, min(o_totalprice) AS low,
       arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS volume
FROM orders GROUP BY ALL"""

H = f"WITH h AS ({_candles('1h', HOUR)})"
M = f"WITH m AS ({_candles('1m', MINUTE)})"
HM = f"{H}, m AS ({_candles('1m', MINUTE)})"
HD = f"{H}, d AS ({_DAILY})"

_REQUESTED = f"""requested AS (
  SELECT DISTINCT {KEY} FROM h
  UNION SELECT DISTINCT data_type, exchange, 'UNKNOWN', "interval" FROM h)"""

_PARTLY = f"""partly AS (SELECT * FROM h WHERE "timestamp" < {JAN_20} OR coin = 'VIEW')"""

_STALE = f"""as_of AS (SELECT max("timestamp") + 1000 AS now FROM h),
newest AS (SELECT {KEY}, max("timestamp") AS latest_ts FROM partly GROUP BY ALL),
stale AS (
  SELECT data_type, exchange, coin, "interval", latest_ts,
         latest_ts IS NULL OR now - latest_ts > {HOUR} AS needs_sync
  FROM requested LEFT JOIN newest USING (data_type, exchange, coin, "interval"), as_of)"""

_WINDOWS = f"""windows AS (
  SELECT {KEY}, coalesce(latest_ts, now - {DAY}) AS sync_start, now AS sync_end
  FROM stale, as_of WHERE needs_sync)"""

_REMOVED = f"""removed AS (
  SELECT * FROM h
  WHERE ("timestamp" >= {JAN_5} AND "timestamp" < {JAN_5 + DAY})
     OR ("timestamp" >= {JAN_10 - 3 * HOUR} AND "timestamp" < {JAN_10 + 3 * HOUR}))"""


def _grid(frame: str, step: int) -> str:
    return f"""spans AS (
  SELECT {KEY}, min("timestamp") AS lo, max("timestamp") AS hi FROM {frame} GROUP BY ALL),
grid AS (SELECT {KEY}, unnest(range(lo, hi + 1, {step})) AS "timestamp" FROM spans)"""


def _missing(frame: str) -> str:
    return (
        f'SELECT {KEY}, "timestamp" FROM grid ANTI JOIN {frame} '
        f'USING (data_type, exchange, coin, "interval", "timestamp")'
    )


def _gaps(frame: str, step: int) -> str:
    return f"""
SELECT {KEY}, "timestamp" + {step} AS gap_start, next_ts - {step} AS gap_end,
       (next_ts - "timestamp") // {step} - 1 AS n_missing
FROM (SELECT *, lead("timestamp") OVER (PARTITION BY {KEY} ORDER BY "timestamp") AS next_ts
      FROM {frame})
WHERE next_ts - "timestamp" > {step}"""


def _place(frame: str) -> str:
    return f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY "timestamp") - 1 AS pos
  FROM {frame})"""


def _newest(frame: str, keys: str) -> str:
    return f"""SELECT {ROW} FROM {frame}
QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY "timestamp" DESC) = 1"""


_PLAN = f"""s AS (SELECT {KEY}, min("timestamp") AS lo, max("timestamp") + {MINUTE} AS hi
      FROM m GROUP BY ALL),
p AS (SELECT *, unnest(range(lo, hi, {1000 * MINUTE})) AS page_start FROM s),
plan AS (SELECT {KEY}, (page_start - lo) // {1000 * MINUTE} AS page, page_start,
                least(page_start + {1000 * MINUTE}, hi) AS page_end FROM p)"""

_CUSTOMER_KEYS = """
WITH k AS (
  SELECT c_custkey, 'ohlcv' AS data_type,
    CASE WHEN c_custkey % 11 <> 0 THEN 'The ' || c_mktsegment END AS exchange,
    CASE WHEN c_custkey % 7 = 0 THEN '  '
         WHEN c_custkey % 13 <> 0 THEN ' ' || lower(c_name) || '/usd ' END AS coin,
    CASE WHEN c_custkey % 17 <> 0 THEN CAST(c_custkey % 5 AS VARCHAR) || 'H ' END AS "interval"
  FROM customer),
n AS (
  SELECT c_custkey, data_type,
    trim(replace(lower(exchange), ' ', '_')) AS exchange,
    trim(replace(upper(coin), '/', '_')) AS coin,
    trim(lower("interval")) AS "interval"
  FROM k)"""

_UNIT = "['m', 'h', 'd', 'w', 'mo', 'y', 'x', ''][event_id % 8 + 1]"
_UNIT_MS = (
    f"CASE event_id % 8 WHEN 0 THEN {MINUTE} WHEN 1 THEN {HOUR} WHEN 2 THEN {DAY} "
    f"WHEN 3 THEN {7 * DAY} WHEN 4 THEN {30 * DAY} WHEN 5 THEN {365 * DAY} END"
)

_PROBLEMS = """
WITH raw AS (
  SELECT event_id, value,
    event_id % 13 = 0 AS bad_ts, event_id % 7 = 0 AS no_open,
    event_id % 11 = 0 AS bad_close, event_id % 17 = 0 AS bad_volume, (epoch_us(ts) // 1000) AS ms
  FROM events)"""

ORACLES: dict[str, str] = {
    "candles_1h": f"{H} SELECT * FROM h",
    "candles_1m": f"{M} SELECT * FROM m",
    "candles_1d": f"WITH d AS ({_DAILY}) SELECT * FROM d",
    "raw_pages_to_candles": f"{H} SELECT * FROM h",
    "candles_small_sizes": f"""{H},
v AS (SELECT upper(event_type) AS coin, (epoch_us(ts) // 1000) // {HOUR} * {HOUR} AS "timestamp",
             CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / 100000000 AS volume
      FROM events GROUP BY ALL)
SELECT h.* REPLACE (v.volume AS volume) FROM h JOIN v USING (coin, "timestamp")""",
    "pages_landed": f"{H} SELECT * FROM h UNION ALL SELECT * FROM h",
    "fetch_clip": (
        f'{M} SELECT * FROM m WHERE "timestamp" >= {JAN_10} AND "timestamp" < {JAN_20}'
    ),
    "fetch_page_plan": f"{M}, {_PLAN} SELECT * FROM plan",
    "validate_split": f"""{_PROBLEMS},
checked AS (
  SELECT *, concat_ws(',', CASE WHEN bad_ts THEN 'timestamp' END,
                           CASE WHEN bad_close THEN 'close' END,
                           CASE WHEN bad_volume THEN 'volume' END) AS wrong
  FROM raw)
SELECT event_id, CASE WHEN NOT bad_ts THEN ms END AS "timestamp",
  CASE WHEN NOT no_open THEN value END AS open, value AS high, value AS low,
  CASE WHEN NOT bad_close THEN value END AS close,
  CASE WHEN NOT bad_volume THEN value END AS volume,
  CASE WHEN no_open THEN 'missing: open'
       WHEN wrong <> '' THEN 'type: ' || wrong END AS reject_reason
FROM checked""",
    "candle_casts": """
SELECT event_id,
  TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS DOUBLE)
    AS as_number,
  user_id AS as_epoch
FROM events""",
    "ohlc_repair": f"""{M}
SELECT {KEY}, "timestamp", open, close, greatest(open, low, close) AS high,
       least(open, high + 1, close) AS low
FROM m""",
    "infer_types": """
WITH entries AS (
  SELECT unnest(json_keys(props)) AS "column", props FROM events),
kinds AS (
  SELECT "column", json_type(props, '$."' || "column" || '"') AS kind FROM entries)
SELECT "column",
  CASE WHEN bool_or(kind NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN', 'NULL'))
         OR (bool_or(kind = 'BOOLEAN') AND bool_or(kind IN ('BIGINT', 'UBIGINT', 'DOUBLE')))
       THEN 'STRING'
       WHEN bool_or(kind = 'BOOLEAN') THEN 'BOOLEAN'
       WHEN bool_or(kind = 'DOUBLE') THEN 'DOUBLE'
       WHEN bool_or(kind IN ('BIGINT', 'UBIGINT')) THEN 'BIGINT'
       ELSE 'STRING' END AS "type"
FROM kinds GROUP BY "column" """,
    "schema_union": """
WITH records AS (
  SELECT to_json(struct_pack("timestamp" := (epoch_us(o_orderdate) // 1000), amount := o_totalprice,
                             label := o_orderstatus, note := CAST(NULL AS VARCHAR))) AS r
  FROM orders
  UNION ALL
  SELECT to_json(struct_pack("timestamp" := (epoch_us(ts) // 1000), amount := user_id,
                             label := value > 100, flag := user_id > 10)) AS r
  FROM events),
entries AS (SELECT unnest(json_keys(r)) AS "column", r FROM records),
kinds AS (SELECT "column", json_type(r, '$."' || "column" || '"') AS kind FROM entries)
SELECT "column",
  CASE WHEN bool_or(kind NOT IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN', 'NULL'))
         OR (bool_or(kind = 'BOOLEAN') AND bool_or(kind IN ('BIGINT', 'UBIGINT', 'DOUBLE')))
       THEN 'STRING'
       WHEN bool_or(kind = 'BOOLEAN') THEN 'BOOLEAN'
       WHEN bool_or(kind = 'DOUBLE') THEN 'DOUBLE'
       WHEN bool_or(kind IN ('BIGINT', 'UBIGINT')) THEN 'BIGINT'
       ELSE 'STRING' END AS "type"
FROM kinds GROUP BY "column" """,
    "normalise_key": f"{_CUSTOMER_KEYS} SELECT * FROM n",
    "encode_path": f"""{_CUSTOMER_KEYS}
SELECT c_custkey,
  CASE WHEN exchange <> '' AND coin <> '' AND "interval" <> ''
       THEN data_type || '/' || exchange || '/' || coin || '/' || "interval" END AS path,
  CASE WHEN exchange IS NULL OR coin IS NULL OR "interval" IS NULL THEN 'missing key'
       WHEN exchange = '' OR coin = '' OR "interval" = '' THEN 'empty key' END AS error
FROM n""",
    "path_prefix": f"""{_CUSTOMER_KEYS}
SELECT c_custkey,
  CASE WHEN exchange IS NULL THEN data_type
       WHEN coin IS NULL THEN data_type || '/' || exchange
       WHEN "interval" IS NULL THEN data_type || '/' || exchange || '/' || coin
       ELSE data_type || '/' || exchange || '/' || coin || '/' || "interval" END AS prefix
FROM n""",
    "decode_path": """
WITH p AS (
  SELECT c_custkey, concat_ws('/',
    CASE WHEN c_custkey % 3 = 0 THEN '' END,
    CASE WHEN c_custkey % 5 = 0 THEN 'trades' ELSE 'ohlcv' END,
    lower(c_mktsegment),
    CASE WHEN c_custkey % 7 <> 0 THEN upper(c_name) END,
    '1h',
    CASE WHEN c_custkey % 4 = 0 THEN 'year=2024' END) AS path
  FROM customer),
s AS (SELECT c_custkey, string_split(trim(path, '/'), '/') AS parts FROM p),
e AS (
  SELECT *, CASE WHEN len(parts) < 4 THEN 'invalid path'
                 WHEN parts[1] <> 'ohlcv' THEN 'wrong data type' END AS error
  FROM s)
SELECT c_custkey, error,
  CASE WHEN error IS NULL THEN parts[1] END AS data_type,
  CASE WHEN error IS NULL THEN parts[2] END AS exchange,
  CASE WHEN error IS NULL THEN parts[3] END AS coin,
  CASE WHEN error IS NULL THEN parts[4] END AS "interval"
FROM e""",
    "ms_roundtrip": "SELECT event_id, (epoch_us(ts) // 1000) AS ms, (epoch_us(ts) // 1000) AS ms_again FROM events",
    "date_parts": """
SELECT event_id, CAST(year(ts) AS INTEGER) AS "year", CAST(month(ts) AS INTEGER) AS "month",
       CAST(day(ts) AS INTEGER) AS "day", strftime(ts, '%Y-%m-%d %H:%M:%S') AS wall_clock
FROM events""",
    "epoch_normalise": """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000)
                      ELSE (epoch_us(ts) // 1000) // 1000 * 1000 END AS bound
FROM events""",
    "interval_ms": f"""
SELECT event_id, CAST(user_id % 7 AS VARCHAR) || {_UNIT} AS "text",
  CASE WHEN user_id % 7 > 0 THEN CAST(user_id % 7 * {_UNIT_MS} AS BIGINT) END AS any_ms,
  CAST(CASE WHEN user_id % 7 > 0 AND event_id % 8 < 4 THEN user_id % 7 * {_UNIT_MS}
            ELSE {5 * MINUTE} END AS BIGINT) AS client_ms,
  CAST(CASE WHEN user_id % 7 = 1 AND event_id % 8 IN (0, 1, 2, 4, 5) THEN {_UNIT_MS}
            WHEN user_id % 7 = 5 AND event_id % 8 = 0 THEN {5 * MINUTE} END AS BIGINT)
    AS service_ms
FROM events""",
    "store_roundtrip": f"{H} SELECT * FROM h",
    "store_by_month": f"WITH d AS ({_DAILY}) SELECT * FROM d",
    "store_unpartitioned": f"{H} SELECT * FROM h",
    "store_overwrite_series": f"""{H}
SELECT * REPLACE (CASE WHEN coin IN ('CLICK', 'VIEW') THEN volume * 2 ELSE volume END AS volume)
FROM h WHERE coin NOT IN ('CLICK', 'VIEW') OR "timestamp" >= {JAN_15}""",
    "store_schema_merge": f"""{H}
SELECT *, CASE WHEN "timestamp" >= {JAN_15} THEN high - low END AS spread FROM h""",
    "store_skip_empty": f"{H} SELECT * FROM h",
    "store_missing_empty": f"{H} SELECT * FROM h",
    "range_closed": f'{H} SELECT * FROM h WHERE "timestamp" BETWEEN {JAN_5} AND {JAN_9}',
    "range_open_ended": f'{H} SELECT * FROM h WHERE "timestamp" >= {JAN_20}',
    "project_columns": f"{H} SELECT coin, close FROM h",
    "filter_tuples": f"""{H}
SELECT * FROM h WHERE coin IN ('CLICK', 'VIEW', 'ERROR') AND coin <> 'ERROR'
  AND close > 20 AND volume <= 400 AND "timestamp" >= {JAN_5}""",
    "series_filter": f"{H} SELECT * FROM h WHERE coin = 'CLICK'",
    "resolve_ts_column": """
SELECT event_id, value FROM events
WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'""",
    "latest_wins": f"""{H}
SELECT * REPLACE (CASE WHEN "timestamp" >= {JAN_15} THEN close + 1 ELSE close END AS close)
FROM h""",
    "list_coins": f"{H} SELECT DISTINCT coin FROM h ORDER BY coin",
    "series_exists": f"{H}, {_REQUESTED} SELECT *, coin <> 'UNKNOWN' AS is_stored FROM requested",
    "store_inventory": f"""{H}
SELECT {KEY}, count(*) AS n_rows, min("timestamp") AS first_ts, max("timestamp") AS last_ts,
       count(DISTINCT "timestamp" // {DAY}) AS n_files
FROM h GROUP BY ALL""",
    "drop_series": f"{H} SELECT * FROM h WHERE coin <> 'VIEW'",
    "latest_lookback": f"""{M}, now AS (SELECT max("timestamp") + 1000 AS as_of FROM m),
recent AS (SELECT m.* FROM m, now WHERE "timestamp" BETWEEN as_of - {DAY} AND as_of)
{_newest('recent', KEY)}""",
    "latest_full": f"{H} {_newest('h', KEY)}",
    "latest_by_symbol_interval": f"""{HM},
u AS (SELECT * FROM h UNION ALL SELECT * FROM m)
{_newest('u', 'coin, "interval"')}""",
    "series_count": f"{M} SELECT {KEY}, count(*) AS n_rows FROM m GROUP BY ALL",
    "coverage": f"""{M}
SELECT {KEY}, min("timestamp") AS first_ts, max("timestamp") AS last_ts, count(*) AS n_rows
FROM m GROUP BY ALL""",
    "count_tolerance": f"""{H},
e AS (SELECT CAST((max("timestamp") - min("timestamp")) // {HOUR} + 1 AS DOUBLE) AS n_expected FROM h),
c AS (SELECT {KEY}, count(*) AS n_rows FROM h GROUP BY ALL)
SELECT *, abs(n_rows - n_expected) <= n_expected * 0.06 AS within FROM c, e""",
    "list_directories": f"""{HD}
SELECT DISTINCT coin AS name FROM (SELECT coin FROM h UNION ALL SELECT coin FROM d)""",
    "page_limit_offset": f"""{M}, {_place('m')}
SELECT * EXCLUDE (pos) FROM placed WHERE pos >= 250 AND pos < 350""",
    "page_with_copies": f"""{H}, u AS (SELECT * FROM h UNION ALL SELECT * FROM h), {_place('u')}
SELECT * EXCLUDE (pos) FROM placed WHERE pos >= 333 AND pos < 434""",
    "page_one_series": f"""{H}
SELECT * FROM h WHERE coin = 'VIEW' ORDER BY "timestamp" LIMIT 10 OFFSET 20""",
    "page_all": f"{H} SELECT * FROM h",
    "page_disjoint": f"""{M}, {_place('m')}
SELECT * EXCLUDE (pos), CAST(pos // 50 + 1 AS INTEGER) AS page FROM placed WHERE pos < 100""",
    "page_overlap": f"""{M}, {_place('m')}
SELECT count(*) AS n_shared FROM placed WHERE pos >= 40 AND pos < 50""",
    "chunks": f"""{M}, {_place('m')}
SELECT * EXCLUDE (pos), pos // 500 AS chunk_id FROM placed""",
    "market_available": f"""{H}, {_REQUESTED}
SELECT *, coin <> 'UNKNOWN' AND coin <> (SELECT max(coin) FROM h) AS is_available
FROM requested""",
    "remove_windows": f"""{H}, {_REMOVED}
SELECT * FROM h ANTI JOIN removed USING (data_type, exchange, coin, "interval", "timestamp")""",
    "membership_split": f"""{H}
SELECT *, "timestamp" IN (SELECT "timestamp" FROM h WHERE high > 300) AS is_member FROM h""",
    "union_batches": f"""{HD}
SELECT *, CAST(NULL AS VARCHAR) AS origin FROM h
UNION ALL
SELECT * REPLACE (CAST(NULL AS DOUBLE) AS volume), 'orders' AS origin FROM d""",
    "expected_grid": f"{H}, {_grid('h', HOUR)} SELECT * FROM grid",
    "missing_ts": f"{H}, {_grid('h', HOUR)} {_missing('h')}",
    "missing_ts_1m": f"{M}, {_grid('m', MINUTE)} {_missing('m')}",
    "gap_ranges": f"{H} {_gaps('h', HOUR)}",
    "gap_ranges_1m": f"{M} {_gaps('m', MINUTE)}",
    "gap_fill": f"""{H}, {_REMOVED},
kept AS (SELECT * FROM h ANTI JOIN removed
         USING (data_type, exchange, coin, "interval", "timestamp")),
{_grid('kept', HOUR)},
missing AS ({_missing('kept')})
SELECT {ROW} FROM h
SEMI JOIN missing USING (data_type, exchange, coin, "interval", "timestamp")""",
    "completeness": f"""{H}, {_REQUESTED},
present AS (SELECT {KEY}, count(DISTINCT "timestamp") AS n FROM h GROUP BY ALL),
e AS (SELECT (max("timestamp") - min("timestamp")) // {HOUR} + 1 AS n_expected FROM h)
SELECT {KEY}, n_expected, coalesce(n, 0) AS n_present, coalesce(n, 0) = n_expected AS is_complete
FROM requested LEFT JOIN present USING (data_type, exchange, coin, "interval"), e""",
    "staleness": f"{H}, {_REQUESTED}, {_PARTLY}, {_STALE} SELECT * FROM stale",
    "sync_windows": f"{H}, {_REQUESTED}, {_PARTLY}, {_STALE}, {_WINDOWS} SELECT * FROM windows",
    "sync_increment": f"""{H}, {_REQUESTED}, {_PARTLY}, {_STALE}, {_WINDOWS}
SELECT h.* FROM h JOIN windows w ON h.data_type = w.data_type AND h.exchange = w.exchange
  AND h.coin = w.coin AND h."interval" = w."interval"
WHERE h."timestamp" >= sync_start AND h."timestamp" < sync_end""",
    "idempotent_append": f"{H} SELECT * FROM h",
    "sync_raw_symbols": f"{H} SELECT * FROM h",
    "sync_revised": f"""{H},
l AS (SELECT coin, max("timestamp") AS last FROM h WHERE "timestamp" < {JAN_20} GROUP BY coin)
SELECT h.*, CAST(CASE WHEN "timestamp" = last THEN 2 ELSE 1 END AS BIGINT) AS n_versions FROM h JOIN l USING (coin)""",
    "page_walk": f"""{M} SELECT * REPLACE ("timestamp" // {HOUR} * {HOUR} AS "timestamp") FROM m""",
    "read_through": f"""{H}, late AS (SELECT * FROM h WHERE "timestamp" >= {JAN_15}),
{_place('late')}
SELECT * EXCLUDE (pos) FROM placed WHERE pos >= 100 AND pos < 300""",
    "stream_dedup": f"{H} SELECT * FROM h",
    "page_coverage": f"""{M}, {_PLAN},
kind AS (SELECT *, page % 5 AS kind FROM plan),
answers AS (
  SELECT k.data_type, k.exchange, k.coin, k."interval", k.page, k.page_start, skip, page_start + skip AS since,
         max("timestamp") + {MINUTE} AS until
  FROM (SELECT *, unnest(CASE WHEN kind = 2 THEN [0, {300 * MINUTE}] ELSE [0] END) AS skip FROM kind WHERE kind <> 1) k
  LEFT JOIN m ON m.coin = k.coin AND k.kind <> 3
    AND "timestamp" >= page_start + skip AND "timestamp" < page_end
    AND (k.kind <> 2 OR (skip = 0 AND "timestamp" < page_start + {500 * MINUTE})
         OR (skip > 0 AND "timestamp" <= page_start + {700 * MINUTE}))
  GROUP BY ALL),
minutes AS (SELECT *, unnest(range(page_start, page_end, {MINUTE})) AS moment FROM plan),
uncovered AS (SELECT * FROM minutes n WHERE NOT EXISTS (
  SELECT 1 FROM answers a WHERE a.coin = n.coin AND a.page = n.page AND moment >= since AND moment < until)),
runs AS (SELECT *, moment - {MINUTE} * row_number() OVER (PARTITION BY coin, page ORDER BY moment) AS run FROM uncovered)
SELECT data_type, exchange, coin, "interval", page, page_start, page_end,
       min(moment) AS fetch_start, max(moment) + {MINUTE} AS fetch_end,
       CASE WHEN (SELECT count(until) FROM answers a WHERE a.coin = r.coin AND a.page = r.page) > 0 THEN 'short'
            WHEN page % 5 <> 1 THEN 'empty' ELSE 'absent' END AS reason
FROM runs r GROUP BY data_type, exchange, coin, "interval", page, page_start, page_end, run""",
    "verify_copy": f"""{M}, f AS (SELECT *, "timestamp" // {MINUTE} % 997 AS fate FROM m)
SELECT * EXCLUDE (fate), CASE fate WHEN 1 THEN 'b' ELSE 'a' END AS side, CAST(1 AS BIGINT) AS copies
FROM f WHERE fate < 3
UNION ALL
SELECT * EXCLUDE (fate) REPLACE (close + 1 AS close), 'b', 1 FROM f WHERE fate = 2""",
    "store_compact": f"""{M}, d AS (SELECT *, make_timestamp("timestamp" * 1000) AS moment FROM m)
SELECT {KEY}, CAST(year(moment) AS INTEGER) AS "year", CAST(month(moment) AS INTEGER) AS "month",
       CAST(day(moment) AS INTEGER) AS "day", count(*) AS n_rows, CAST(1 AS BIGINT) AS n_files FROM d GROUP BY ALL""",
    "store_page": f"""{M}, {_place('m')}
SELECT * EXCLUDE (pos) FROM placed WHERE pos >= 250 AND pos < 350""",
    "store_last_timestamps": f"""{M} SELECT {KEY}, max("timestamp") AS latest_ts FROM m GROUP BY ALL""",
    "page_stable": f"""{H},
early AS (SELECT * FROM h WHERE coin IN ('CLICK', 'ERROR') OR "timestamp" // {HOUR} % 3 > 0),
u AS (SELECT * FROM early UNION ALL SELECT * FROM early WHERE high > 300), {_place('u')},
size AS (SELECT CAST(ceil(max(n) / 4.0) AS BIGINT) AS size FROM (SELECT count(*) AS n FROM u GROUP BY coin))
SELECT placed.* EXCLUDE (pos), CAST(pos // size AS INTEGER) AS page FROM placed, size""",
    "stream_quarantine": f"""{H}
SELECT *, NULL::VARCHAR AS reject_reason FROM h WHERE "timestamp" // {HOUR} % 13 <> 0
UNION ALL
SELECT {KEY}, "timestamp", NULL, NULL, NULL, NULL, NULL, 'type: close' FROM h WHERE "timestamp" // {HOUR} % 13 = 0""",
    "stream_candles_1h": f"{H} SELECT * FROM h",
}
