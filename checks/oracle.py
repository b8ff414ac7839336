"""SQL for every registered query, written from the definitions and independent of the package.

State is defined by validity intervals here (a version holds until the next one of its key), where the package
uses running sums and ordered passes.
"""

from __future__ import annotations

EV = """
ev AS (
  SELECT event_id AS seq,
    event_id // 12 + 1 AS height,
    (event_id % 12) // 4 AS tx_index,
    event_id % 4 AS event_index,
    user_id, event_type,
    'T' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS token0,
    'T' || lpad(CAST(user_id % 10 + 1 AS VARCHAR), 2, '0') AS token1,
    (user_id // 10) % 2 AS side,
    CAST(json_extract_string(props, '$.k') AS INT) % 12 - 6 AS tick,
    CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 20 END AS fee,
    CAST(round(value * 100) AS BIGINT) AS amount,
    CASE WHEN event_type IN ('error', 'view', 'signup') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) END AS reserves,
    CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 1 WHEN 'click' THEN 0 END AS marker,
    CASE WHEN (event_id // 12 + 1) % 10 = 0 AND (event_id % 12) // 4 = 2 THEN 5 ELSE 0 END AS code,
    ts
  FROM events),
block AS (SELECT height, CAST(round(epoch(min(ts))) AS BIGINT) AS time_unix,
    strftime(min(ts), '%Y-%m-%dT%H:%M:%S.%fZ') AS time FROM ev GROUP BY height),
p AS (SELECT max(height) AS newest, max(height) - 1 AS last, max(height) // 2 AS half,
    max(time_unix) // 60 * 60 AS now FROM block),
v AS (SELECT *, CASE WHEN side = 0 THEN token0 ELSE token1 END AS token_in,
    last_value(marker IGNORE NULLS) OVER (PARTITION BY height, tx_index ORDER BY event_index
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS msg_type
  FROM ev WHERE code = 0)"""

CHANGES = """
lagged AS (SELECT *, lag(reserves) OVER (PARTITION BY token0, token1, token_in, tick, fee ORDER BY seq) AS prev FROM v),
chg AS (SELECT *, lead(seq) OVER (PARTITION BY token0, token1, token_in, tick, fee ORDER BY seq) AS until
  FROM lagged WHERE prev IS DISTINCT FROM reserves)"""

DIFFS = """
diffs AS (SELECT * FROM (SELECT *, reserves - coalesce(lag(reserves) OVER (
    PARTITION BY token0, token1, token_in, tick ORDER BY seq), 0) AS reserves_diff FROM v) WHERE reserves_diff <> 0),
swaps AS (SELECT d.*, time_unix FROM diffs d JOIN block USING (height) WHERE msg_type = 3)"""

VERSIONS = """
versions AS (SELECT token0, token1, token_in AS token, tick, fee, height, arg_max(reserves, seq) AS reserves
  FROM chg GROUP BY token0, token1, token_in, tick, fee, height)"""

LATEST = """
latest AS (SELECT token0, token1, token, tick, fee, arg_max(reserves, height) AS reserves, max(height) AS height
  FROM versions, p WHERE height <= p.last GROUP BY token0, token1, token, tick, fee)"""

# the state of a side right after a change: all versions whose interval holds that change
AFTER = """
after AS (SELECT e.seq, e.height, e.token0, e.token1, e.token_in, e.side,
    sum(s.reserves) AS total, min(CASE WHEN s.reserves > 0 THEN s.tick END) AS best
  FROM chg e JOIN chg s ON s.token0 = e.token0 AND s.token1 = e.token1 AND s.token_in = e.token_in
    AND s.seq <= e.seq AND (s.until IS NULL OR s.until > e.seq)
  GROUP BY ALL)"""

RESERVES = """
reserves AS (SELECT seq, height, token0, token1,
    CAST(coalesce(last_value(CASE WHEN side = 0 THEN total END IGNORE NULLS) OVER w, 0) AS DOUBLE) AS reserves0,
    CAST(coalesce(last_value(CASE WHEN side = 1 THEN total END IGNORE NULLS) OVER w, 0) AS DOUBLE) AS reserves1
  FROM (SELECT * FROM (SELECT *, lag(total) OVER (PARTITION BY token0, token1, token_in ORDER BY seq) AS before
    FROM after) WHERE total IS DISTINCT FROM before)
  WINDOW w AS (PARTITION BY token0, token1 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

PRICE = """
moves AS (SELECT * FROM (SELECT *, lag(best) OVER (PARTITION BY token0, token1, token_in ORDER BY seq) AS before
  FROM after) WHERE best IS DISTINCT FROM before),
sides AS (SELECT *,
    last_value(CASE WHEN side = 0 THEN seq END IGNORE NULLS) OVER w AS seq0,
    last_value(CASE WHEN side = 1 THEN seq END IGNORE NULLS) OVER w AS seq1
  FROM moves WINDOW w AS (PARTITION BY token0, token1 ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
price AS (SELECT s.seq, s.height, s.token0, s.token1, -a.best AS best0, b.best AS best1,
    coalesce(CASE WHEN s.side = 0 THEN -a.best ELSE b.best END, CASE WHEN s.side = 0 THEN b.best ELSE -a.best END) AS last
  FROM sides s LEFT JOIN moves a ON a.seq = s.seq0 LEFT JOIN moves b ON b.seq = s.seq1)"""

RAW = """
raw AS (SELECT *, row_number() OVER (PARTITION BY height, tx_index ORDER BY event_index, sub) - 1 AS idx FROM (
    SELECT *, 0 AS sub, 'message' AS type, CASE marker WHEN 3 THEN '/neutron.dex.MsgPlaceLimitOrder'
      WHEN 1 THEN '/neutron.dex.MsgDeposit' ELSE '/other.bank.MsgSend' END AS action FROM ev WHERE marker IS NOT NULL
    UNION ALL
    SELECT *, 1, 'message', CASE event_type WHEN 'signup' THEN 'DepositLP' WHEN 'view' THEN 'WithdrawLP'
      ELSE 'PlaceLimitOrder' END FROM ev WHERE event_type IN ('signup', 'view', 'purchase')
    UNION ALL
    SELECT *, 2, 'TickUpdate', 'TickUpdate' FROM ev)),
r AS (SELECT *, CASE WHEN side = 0 THEN token0 ELSE token1 END AS token_in,
    height * 4294967296 + row_number() OVER (PARTITION BY height ORDER BY tx_index, idx) - 1 AS rseq FROM raw WHERE code = 0),
m AS (SELECT *, last_value(CASE WHEN sub = 0 THEN rseq END IGNORE NULLS) OVER w AS msg_seq,
    nullif(last_value(CASE WHEN sub = 0 THEN marker END IGNORE NULLS) OVER w, 0) AS raw_msg_type
  FROM r WINDOW w AS (PARTITION BY height, tx_index ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

DICTIONARY = """
slots AS (
  SELECT rseq, 0 AS slot, token0 AS token FROM r WHERE sub > 0
  UNION ALL SELECT rseq, 1, token1 FROM r WHERE sub > 0
  UNION ALL SELECT rseq, 2, token_in FROM r WHERE action IN ('PlaceLimitOrder', 'TickUpdate')),
tokens AS (SELECT row_number() OVER (ORDER BY min(rseq * 8 + slot)) AS id, token, min(rseq) AS first_seq
  FROM slots GROUP BY token),
pairs AS (SELECT row_number() OVER (ORDER BY min(rseq)) AS id, token0, token1, min(rseq) AS first_seq
  FROM r WHERE sub > 0 GROUP BY token0, token1)"""

PARTS = """
parts AS (SELECT *, 'T' || CASE WHEN p_partkey < 10 THEN '0' || CAST(p_partkey AS VARCHAR)
      ELSE CAST(p_partkey AS VARCHAR) END AS name,
    'channel-' || CAST(p_size AS VARCHAR) AS channel FROM part),
usd AS (SELECT 'coin-' || CAST(p_partkey AS VARCHAR) AS price_id, p_partkey,
    p_retailprice / 1000 AS usd, CASE WHEN p_partkey % 5 = 0 THEN 100 ELSE 200 END AS last_updated_at
  FROM part WHERE p_partkey % 4 <> 3)"""


def sql(*parts: str) -> str:
    """WITH clause of the given parts, then the query."""
    return "WITH " + ",".join([EV, *parts[:-1]]) + "\n" + parts[-1]


def larger(value: str) -> str:
    """Text of ``10**40 + 1`` times a number."""
    digits = f"CAST(abs({value}) AS VARCHAR)"
    return f"""CASE WHEN {value} = 0 THEN '0' ELSE CASE WHEN {value} < 0 THEN '-' ELSE '' END || {digits} || lpad({digits}, 40, '0') END"""


def bucket(time: str, resolution: str, offset: int | str = 0) -> str:
    return f"CAST(epoch(date_trunc('{resolution}', make_timestamp(({time} - ({offset})) * 1000000))) AS BIGINT) + ({offset})"


def bounds(resolution: str, low: str = "0", high: str = "p.last") -> str:
    """Aligned time bounds of the height range (low, high] for an alias with ``time_unix``."""
    first = f"coalesce((SELECT arg_min(time_unix, height) FROM block WHERE height > {low}), 0)"
    return f"""time_unix >= {bucket(first, resolution)}
    AND time_unix <= coalesce((SELECT arg_max(time_unix, height) FROM block WHERE height <= {high}), 0)"""


def height_at(time: str) -> str:
    return f"least((SELECT last FROM p), coalesce((SELECT max(height) FROM block WHERE time_unix <= {time}), 0))"


def ohlc_of(resolution: str, low: str = "0", high: str = "(SELECT last FROM p)", offset: str = "0") -> str:
    return f"""SELECT token0, token1, {bucket('time_unix', resolution, offset)} AS time_unix,
    arg_min(last, seq) AS open, max(last) AS high, min(last) AS low, arg_max(last, seq) AS close
  FROM price JOIN block USING (height) WHERE last IS NOT NULL AND {bounds(resolution, low, high)} GROUP BY 1, 2, 3"""


def tvl_of(resolution: str, low: str = "0", high: str = "(SELECT last FROM p)", offset: str = "0") -> str:
    return f"""SELECT token0, token1, {bucket('time_unix', resolution, offset)} AS time_unix,
    arg_max(reserves0, seq) AS amount0, arg_max(reserves1, seq) AS amount1
  FROM reserves JOIN block USING (height) WHERE {bounds(resolution, low, high)} GROUP BY 1, 2, 3"""


def volume_of(resolution: str, low: str = "0", high: str = "(SELECT last FROM p)", offset: str = "0") -> str:
    def total(side: str, value: str) -> str:
        return f"sum(CASE WHEN token_in = {side} AND reserves_diff > 0 THEN {value} ELSE 0 END)"

    return f"""SELECT token0, token1, {bucket('time_unix', resolution, offset)} AS time_unix,
    CAST({total('token0', 'reserves_diff')} AS DOUBLE) AS amount0,
    CAST({total('token1', 'reserves_diff')} AS DOUBLE) AS amount1,
    CAST({total('token0', 'reserves_diff * fee')} AS DOUBLE) / 10000 AS fee0,
    CAST({total('token1', 'reserves_diff * fee')} AS DOUBLE) / 10000 AS fee1
  FROM swaps WHERE {bounds(resolution, low, high)} GROUP BY 1, 2, 3
  HAVING {total('token0', 'reserves_diff')} > 0 OR {total('token1', 'reserves_diff')} > 0"""


def digits(whole: str, n: int) -> str:
    """Half-up rounding of a whole number to n significant digits, in whole-number arithmetic."""
    unit = f"CAST(pow(10, greatest(length(CAST({whole} AS VARCHAR)) - {n}, 0)) AS BIGINT)"
    return f"(({whole} + {unit} // 2) // {unit} * {unit})"


DAY_OFFSET = "((SELECT now FROM p) % 86400)"
NOW = "(SELECT now FROM p)"
LAST = "(SELECT last FROM p)"
HALF = "(SELECT half FROM p)"
LAST_48H = (height_at(f"{NOW} - 172800"), height_at(NOW))

CLOSES = f"""
daily AS ({ohlc_of('day', height_at(f'{NOW} - 22 * 86400'), height_at(NOW))}),
closes AS (SELECT token0, token1, day, {NOW} // 86400 * 86400 - day * 86400 AS time_unix, close FROM (
    SELECT token0, token1, day, (SELECT arg_max(close, time_unix) FROM daily d WHERE d.token0 = s.token0
      AND d.token1 = s.token1 AND d.time_unix <= {NOW} // 86400 * 86400 - day * 86400) AS close
    FROM (SELECT DISTINCT token0, token1 FROM daily) s, (SELECT unnest(range(1, 22)) AS day))
  WHERE close IS NOT NULL),
returns AS (SELECT a.token0, a.token1, row_number() OVER (PARTITION BY a.token0, a.token1 ORDER BY a.day) AS position,
    pow(1.0001, a.close) / pow(1.0001, b.close) - 1 AS change
  FROM closes a JOIN closes b ON a.token0 = b.token0 AND a.token1 = b.token1 AND b.day = a.day + 1)"""

VOLATILITY = f"""SELECT token0, token1, {NOW} // 86400 * 86400 - days * 86400 AS time_unix,
    round(sqrt(252) * CASE WHEN days = 10 THEN newest ELSE before END, 9) AS volatility
  FROM (SELECT token0, token1, count(*) AS n,
      stddev_samp(CASE WHEN position <= 10 THEN change END) AS newest,
      stddev_samp(CASE WHEN position BETWEEN 11 AND 20 THEN change END) AS before
    FROM returns GROUP BY token0, token1), (SELECT unnest([10, 20]) AS days)"""

STATE_COLUMNS = "token0, token1, token, tick, fee, reserves, height"


def pair_reserves(upto: str) -> str:
    return f"""SELECT token0, token1, arg_max(reserves0, seq) AS reserves0, arg_max(reserves1, seq) AS reserves1
    FROM reserves WHERE height <= {upto} GROUP BY token0, token1"""


UNIT_PRICES = PARTS + """,
unit AS (SELECT name AS token, pow(10.0, -(p_size % 7)) * coalesce(usd, 0.0) AS unit_price
  FROM parts LEFT JOIN usd ON usd.p_partkey = parts.p_partkey)"""


def valued(name: str, upto: str) -> str:
    return f"""{name} AS (SELECT r.token0, r.token1, reserves0, reserves1, coalesce(a.unit_price, 0.0) AS price0,
    coalesce(b.unit_price, 0.0) AS price1,
    reserves0 * coalesce(a.unit_price, 0.0) + reserves1 * coalesce(b.unit_price, 0.0) AS value
  FROM ({pair_reserves(upto)}) r LEFT JOIN unit a ON a.token = r.token0 LEFT JOIN unit b ON b.token = r.token1)"""


def ranking(name: str, source: str) -> str:
    return f"""{name} AS (SELECT row_number() OVER (ORDER BY value DESC, token0, token1) AS rank, token0, token1,
    CAST({digits('CAST(reserves0 AS BIGINT)', 4)} AS DOUBLE) AS reserves0,
    CAST({digits('CAST(reserves1 AS BIGINT)', 4)} AS DOUBLE) AS reserves1 FROM {source})"""


def liquidity_of(rows: str) -> str:
    return f"""SELECT token0, token1, token, -tick AS tick,
    CAST({digits('CAST(sum(reserves) AS BIGINT)', 3)} AS DOUBLE) AS reserves FROM {rows}
  GROUP BY token0, token1, token, tick"""


CHANGED = """
touched AS (SELECT DISTINCT token0, token1, token, tick FROM versions, p WHERE height > p.half AND height <= p.last)"""
FRAMES = """
frames AS (SELECT token0, token1, token, tick, height, arg_max(total, seq) AS reserves FROM (
    SELECT token0, token1, token_in AS token, tick, height, seq,
      CAST(sum(reserves - coalesce(prev, 0)) OVER (PARTITION BY token0, token1, token_in, tick ORDER BY seq
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS total FROM chg)
  GROUP BY token0, token1, token, tick, height)"""

STATE = (CHANGES, VERSIONS, LATEST)
TOTALS = (CHANGES, AFTER, RESERVES)
BEST = (CHANGES, AFTER, PRICE)

UPDATE_JSON = """'{"action":"TickUpdate","note":"","module":"dex","TokenZero":"' || token0 || '","TokenOne":"' || token1
    || '","TokenIn":"' || token_in || '","TickIndex":"' || tick || '","Fee":"' || fee || '","Reserves":"' || reserves || '"}'"""


def typed_json(action: str, zero: str, one: str, shares: str) -> str:
    return f"""'{{"module":"dex","action":"{action}","Creator":"u' || user_id || '","Receiver":"u' || user_id
    || '","TokenZero":"' || token0 || '","TokenOne":"' || token1 || '","TickIndex":"' || tick || '","Fee":"' || fee
    || '","{zero}":"' || amount || '","{one}":"' || (amount + 1) || '","{shares}":"' || (amount * 2) || '"}}'"""


ORDER_JSON = """'{"module":"dex","action":"PlaceLimitOrder","Creator":"u' || user_id || '","Receiver":"u' || user_id
    || '","TokenZero":"' || token0 || '","TokenOne":"' || token1 || '","TokenIn":"' || token_in || '","AmountIn":"' || amount
    || '","LimitTick":"' || tick || '","OrderType":"GOOD_TIL_CANCELLED","Shares":"' || amount || '","TrancheKey":"k' || seq || '"}'"""

ATTRIBUTES = f"""CASE WHEN sub = 0 THEN '{{"action":"' || action || '"}}' WHEN sub = 2 THEN {UPDATE_JSON}
    WHEN action = 'DepositLP' THEN {typed_json('DepositLP', 'ReservesZeroDeposited', 'ReservesOneDeposited', 'SharesMinted')}
    WHEN action = 'WithdrawLP' THEN {typed_json('WithdrawLP', 'ReservesZeroWithdrawn', 'ReservesOneWithdrawn', 'SharesRemoved')}
    ELSE {ORDER_JSON} END"""

FLAGS = """
flags AS (SELECT m.*, CASE WHEN action = 'PlaceLimitOrder' THEN pairs.id ELSE 0 END AS pair_swap,
    CASE WHEN action = 'DepositLP' THEN pairs.id ELSE 0 END AS pair_deposit,
    CASE WHEN action = 'WithdrawLP' THEN pairs.id ELSE 0 END AS pair_withdraw
  FROM m JOIN pairs ON pairs.token0 = m.token0 AND pairs.token1 = m.token1)"""

PLACE = "rseq AS seq, height, tx_index, idx AS event_index"
TIMES = "times AS (SELECT seq, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM ev)"
MAPPING = PARTS + """,
mapping AS (SELECT name AS denom, 'T' || CASE WHEN p_partkey + 1 < 10 THEN '0' || CAST(p_partkey + 1 AS VARCHAR)
    ELSE CAST(p_partkey + 1 AS VARCHAR) END AS real_denom FROM parts WHERE p_partkey % 2 = 0)"""

ORACLES: dict[str, str] = {
    "read_tx_log": sql(RAW, """SELECT height, md5(height || '-' || tx_index) AS txhash, max(code) AS code,
        count(*) AS n_events FROM raw GROUP BY height, tx_index
        HAVING bool_or(sub = 1) AND height >= (SELECT half FROM p)"""),
    "read_headers_join": sql("""SELECT DISTINCT height, md5(height || '-' || tx_index) AS txhash, time AS timestamp
        FROM ev JOIN block USING (height)"""),
    "normalise_tx": sql(RAW, """SELECT (height - 1) * 3 + tx_index AS position, height, md5(height || '-' || tx_index) AS txhash,
        max(code) AS code, '' AS info, CASE WHEN max(code) = 0 THEN '' ELSE 'dex' END AS codespace, '200000' AS gas_wanted,
        CAST(height * 10 + tx_index AS VARCHAR) AS gas_used, count(*) AS n_events FROM raw GROUP BY height, tx_index"""),
    "load_blocks": sql("SELECT height, time, time_unix FROM block"),
    "load_txs": sql("""SELECT DISTINCT height, tx_index, md5(height || '-' || tx_index) AS hash, code,
        CAST(NULL AS VARCHAR) AS data, '' AS info, '200000' AS gas_wanted,
        CAST(height * 10 + tx_index AS VARCHAR) AS gas_used, '' AS codespace FROM v"""),
    "load_events": sql(RAW, DICTIONARY, FLAGS, f"""SELECT {PLACE}, type, {ATTRIBUTES} AS attributes, msg_seq,
        raw_msg_type AS msg_type, pair_swap, pair_deposit, pair_withdraw FROM flags"""),
    "load_dimensions": sql(RAW, DICTIONARY, """SELECT 'token' AS kind, id, token AS name, '' AS second, first_seq FROM tokens
        UNION ALL SELECT 'pair', id, token0, token1, first_seq FROM pairs"""),
    "upsert_latest": sql(CHANGES, """SELECT token0, token1, token_in, tick, fee, height, max(seq) AS seq,
        arg_max(reserves, seq) AS reserves FROM chg GROUP BY ALL"""),
    "read_token_prices": sql(PARTS, "SELECT price_id, round(usd, 9) AS usd, last_updated_at FROM usd"),
    "read_assets": sql(PARTS, """SELECT name AS base, 'D' || name AS display, 'coin-' || p_partkey
        || CASE WHEN p_partkey % 3 <> 0 THEN '-new' ELSE '' END AS price_id, p_size % 7 AS exponent FROM parts"""),
    "browse_tables": sql("""SELECT * FROM (SELECT height AS key, 'block' AS table_name FROM block ORDER BY height DESC LIMIT 100)
        UNION ALL SELECT * FROM (SELECT o_orderkey, 'orders' FROM orders ORDER BY 1 DESC LIMIT 100)
        UNION ALL SELECT * FROM (SELECT seq, 'tick_update' FROM v ORDER BY 1 DESC LIMIT 100)"""),
    "valid_txs": sql("""SELECT DISTINCT height, (height - 1) * 3 + tx_index AS position,
        md5(height || '-' || tx_index) AS txhash, code FROM v"""),
    "decode_events": sql(RAW, """SELECT rseq AS seq, idx AS event_index, type, action, CASE WHEN sub = 2 THEN '' END AS note,
        CASE WHEN sub = 0 THEN 1 WHEN sub = 2 THEN 9 WHEN action = 'PlaceLimitOrder' THEN 12 ELSE 11 END AS n_attributes FROM r"""),
    "decode_placed_log": sql(RAW, f"""SELECT {PLACE}, type, msg_seq, raw_msg_type AS msg_type FROM m
        WHERE height > (SELECT half FROM p)"""),
    "dex_events": sql(RAW, "SELECT rseq AS seq, type, action FROM r WHERE sub > 0"),
    "route_by_action": sql(RAW, "SELECT action, rseq AS seq FROM r WHERE sub > 0"),
    "event_deposit": sql(RAW, f"""SELECT {PLACE}, 'u' || user_id AS creator, 'u' || user_id AS receiver, token0, token1, tick, fee,
        amount AS deposited0, amount + 1 AS deposited1, amount * 2 AS shares FROM r WHERE action = 'DepositLP'"""),
    "event_withdraw": sql(RAW, f"""SELECT {PLACE}, 'u' || user_id AS creator, 'u' || user_id AS receiver, token0, token1, tick, fee,
        amount AS withdrawn0, amount + 1 AS withdrawn1, amount * 2 AS shares_removed FROM r WHERE action = 'WithdrawLP'"""),
    "event_place_order": sql(RAW, f"""SELECT {PLACE}, 'u' || user_id AS creator, 'u' || user_id AS receiver, token0, token1, token_in,
        CASE WHEN token_in = token0 THEN token1 ELSE token0 END AS token_out, amount AS amount_in, tick AS limit_tick,
        'GOOD_TIL_CANCELLED' AS order_type, amount AS shares, 'k' || seq AS tranche FROM r WHERE action = 'PlaceLimitOrder'"""),
    "event_tick_update": sql(RAW, f"""SELECT {PLACE}, msg_seq, raw_msg_type AS msg_type, token0, token1, token_in, tick, fee,
        reserves FROM m WHERE sub = 2"""),
    "pair_action_flags": sql(RAW, DICTIONARY, FLAGS, "SELECT rseq AS seq, pair_swap, pair_deposit, pair_withdraw FROM flags"),
    "block_range": sql("SELECT seq, height FROM v, p WHERE height > half AND height <= last"),
    "time_range": sql(f"""SELECT seq, height FROM v WHERE height > {height_at(f'{NOW} - 7 * 86400')}
        AND height <= {height_at(f'{NOW} - 86400')}"""),
    "aligned_time_bounds": sql(" UNION ALL ".join(
        f"""SELECT '{r}' AS resolution,
          {bucket(f'(SELECT arg_min(time_unix, height) FROM block WHERE height > {HALF})', r)} AS low,
          (SELECT arg_max(time_unix, height) FROM block WHERE height <= {LAST}) AS high"""
        for r in ("second", "minute", "hour", "day", "month"))),
    "live_ticks": sql(*STATE, f"SELECT {STATE_COLUMNS} FROM latest WHERE reserves <> 0"),
    "priced_only": sql(*BEST, "SELECT seq, token0, token1, last FROM price WHERE last IS NOT NULL"),
    "orient_pair": sql(*BEST, f"""SELECT token0, token1, time_unix, -open AS open, -low AS high, -high AS low, -close AS close
        FROM ({ohlc_of('day')})"""),
    "orient_pair_amounts": sql(DIFFS, f"""SELECT token0, token1, time_unix,
        CASE WHEN token0 < 'T05' THEN amount1 ELSE amount0 END AS amount0,
        CASE WHEN token0 < 'T05' THEN amount0 ELSE amount1 END AS amount1,
        CASE WHEN token0 < 'T05' THEN fee1 ELSE fee0 END AS fee0,
        CASE WHEN token0 < 'T05' THEN fee0 ELSE fee1 END AS fee1 FROM ({volume_of('day')})"""),
    "orient_pair_liquidity": sql(*STATE, f"""SELECT token0, token1, CASE WHEN token = token0 THEN 1 ELSE 0 END AS side, tick, reserves
        FROM ({liquidity_of('latest WHERE reserves <> 0')})"""),
    "remap_tokens": sql(MAPPING, """SELECT seq, coalesce(real_denom, token_in) AS token FROM v
        LEFT JOIN mapping ON denom = token_in"""),
    "resolve_keys": sql(RAW, DICTIONARY, """SELECT rseq AS seq, pairs.id AS pair_id, tokens.id AS token_id FROM r
        JOIN pairs ON pairs.token0 = r.token0 AND pairs.token1 = r.token1 JOIN tokens ON token = token_in WHERE sub = 2"""),
    "resolve_pair_unsorted": sql(RAW, DICTIONARY, """SELECT v.seq, pairs.id AS pair_id, pairs.token0, pairs.token1 FROM v
        JOIN pairs ON (pairs.token0 = v.token1 AND pairs.token1 = v.token0)
          OR (pairs.token0 = v.token0 AND pairs.token1 = v.token1)"""),
    "pair_orientation": sql(RAW, DICTIONARY, """, asked AS (SELECT seq, CASE WHEN seq % 2 = 1 THEN token1 ELSE token0 END AS token_a,
        CASE WHEN seq % 5 = 0 THEN 'T99' WHEN seq % 2 = 1 THEN token0 ELSE token1 END AS token_b FROM v)
        SELECT seq, token_a, token_b, CASE WHEN token0 = token_a THEN 0 WHEN token0 = token_b THEN 1 END AS inverted
        FROM asked LEFT JOIN pairs ON (token0 = token_a AND token1 = token_b) OR (token0 = token_b AND token1 = token_a)"""),
    "join_event_time": sql(*TOTALS, "SELECT seq, time_unix, reserves0, reserves1 FROM reserves JOIN block USING (height)"),
    "join_event_msg_time": sql(DIFFS, "SELECT seq, time_unix, reserves_diff, msg_type FROM swaps"),
    "join_pair_tokens": sql(RAW, DICTIONARY, *TOTALS, f"""SELECT id, token0, token1, reserves0, reserves1
        FROM ({pair_reserves(LAST)}) JOIN pairs USING (token0, token1)"""),
    "ticks_changed": sql(*STATE, CHANGED, f"SELECT {STATE_COLUMNS} FROM latest SEMI JOIN touched USING (token0, token1, token, tick)"),
    "rows_not_in": sql(*STATE, f"""SELECT token0, token1, token, tick, fee, reserves FROM latest EXCEPT
        SELECT token0, token1, token, tick, fee, arg_max(reserves, height) FROM versions WHERE height <= {HALF}
        GROUP BY token0, token1, token, tick, fee"""),
    "time_at_or_before_height": sql("""SELECT o_orderkey, height, coalesce((SELECT arg_max(time_unix, b.height) FROM block b
        WHERE b.height <= a.height), 0) AS time_unix
        FROM (SELECT o_orderkey, o_orderkey % (2 * newest) - 5 AS height FROM orders, p) a"""),
    "time_after_height": sql("""SELECT height, coalesce((SELECT arg_min(time_unix, b.height) FROM block b WHERE b.height > a.height),
        CASE WHEN height > 0 THEN (SELECT arg_max(time_unix, height) FROM block) + 1 ELSE 0 END) AS time_unix
        FROM (SELECT unnest([0, 1, half, last, newest, newest + 5]) AS height FROM p) a"""),
    "time_after_height_bulk": sql("""SELECT l_orderkey, l_linenumber, a.height, coalesce(b.time_unix,
        CASE WHEN a.height > 0 THEN (SELECT arg_max(time_unix, height) FROM block) + 1 ELSE 0 END) AS time_unix
        FROM (SELECT l_orderkey, l_linenumber, l_orderkey * 31 % (2 * newest) + l_linenumber - 5 AS height FROM lineitem, p) a
        ASOF LEFT JOIN block b ON a.height < b.height"""),
    "last_block_time": sql("SELECT max(height) AS height, arg_max(time_unix, height) AS time_unix FROM block"),
    "height_at_time": sql("""SELECT o_orderkey, time_unix, coalesce((SELECT max(height) FROM block b
        WHERE b.time_unix <= a.time_unix), 0) AS height
        FROM (SELECT o_orderkey, 1704060000 + o_orderkey * 977 % 2700000 AS time_unix FROM orders) a"""),
    "completed_height_at_time": sql(f"""SELECT time_unix, least({LAST}, coalesce((SELECT max(height) FROM block b
        WHERE b.time_unix <= a.time_unix), 0)) AS height FROM (SELECT unnest([0, now - 20 * 86400, now - 86400, now, now + 86400])
        AS time_unix FROM p) a"""),
    "completed_height_at_time_bulk": sql(f"""SELECT o_orderkey, a.time_unix, least({LAST}, coalesce(b.height, 0)) AS height
        FROM (SELECT o_orderkey, 1704060000 + o_orderkey * 977 % 2700000 AS time_unix FROM orders) a
        ASOF LEFT JOIN (SELECT time_unix, max(height) AS height FROM block GROUP BY time_unix) b ON a.time_unix >= b.time_unix"""),
    "daily_close_asof": sql(*BEST, CLOSES, "SELECT token0, token1, day, time_unix, close FROM closes"),
    "asset_match": sql(MAPPING, """SELECT token, base, 'D' || base AS display,
        'coin-' || p_partkey || CASE WHEN p_partkey % 3 = 0 THEN '-new' ELSE '' END AS price_id
        FROM (SELECT DISTINCT token_in AS token, coalesce(real_denom, token_in) AS base FROM v
          LEFT JOIN mapping ON denom = token_in) JOIN parts ON name = base"""),
    "price_enrich": sql(*TOTALS, UNIT_PRICES, valued("valued", LAST), """SELECT token0, token1, round(price0, 12) AS price0,
        round(price1, 12) AS price1, round(value, 6) AS value FROM valued"""),
    "latest_tick_state": sql(*STATE, f"SELECT {STATE_COLUMNS} FROM latest"),
    "latest_tick_state_since": sql(CHANGES, VERSIONS, """SELECT token0, token1, token, tick, fee,
        arg_max(reserves, height) AS reserves, max(height) AS height FROM versions, p WHERE height > half AND height <= last
        GROUP BY token0, token1, token, tick, fee"""),
    "latest_reserves_per_pair": sql(*TOTALS, pair_reserves(LAST)),
    "first_seen_ids": sql(RAW, DICTIONARY, "SELECT id, token, first_seq FROM tokens"),
    "tick_liquidity": sql(*STATE, liquidity_of("latest WHERE reserves <> 0")),
    "tick_liquidity_delta": sql(*STATE, CHANGED, liquidity_of("latest SEMI JOIN touched USING (token0, token1, token, tick)")),
    "pair_liquidity": sql(*STATE, f"""SELECT token0, token1, CASE WHEN token = token0 THEN 0 ELSE 1 END AS side, tick, reserves
        FROM ({liquidity_of('latest WHERE reserves <> 0')})"""),
    "token_liquidity": sql(*STATE, f"""SELECT token0, token1, tick, reserves
        FROM ({liquidity_of('latest WHERE reserves <> 0')}) WHERE token = token0"""),
    "live_reserves_total": sql(*STATE, """SELECT token0, token1, token, CAST(sum(reserves) AS DOUBLE) AS reserves FROM latest
        WHERE reserves <> 0 GROUP BY token0, token1, token"""),
    "best_tick": sql(*STATE, "SELECT token0, token1, token, min(tick) AS tick FROM latest WHERE reserves <> 0 GROUP BY 1, 2, 3"),
    "ohlc": sql(*BEST, ohlc_of("hour")),
    "ohlc_stored": sql(*BEST, ohlc_of("hour")),
    "tick_liquidity_stored": sql(*STATE, liquidity_of("latest WHERE reserves <> 0")),
    "pairs_liquidity_stored": sql(*TOTALS, UNIT_PRICES, valued("valued", LAST), ranking("ranked", "valued"), "SELECT * FROM ranked"),
    "append_tick_state": sql(CHANGES, VERSIONS, "SELECT token0, token1, token, tick, fee, height, reserves FROM versions"),
    "append_after_failure": sql(CHANGES, VERSIONS, AFTER, RESERVES, PRICE, """SELECT 'tick_state' AS kind, height, token0, token1,
        CAST(reserves AS DOUBLE) AS side0, CAST(tick AS DOUBLE) AS side1 FROM versions
        UNION ALL SELECT 'price', height, token0, token1, CAST(best0 AS DOUBLE), CAST(best1 AS DOUBLE) FROM price
        UNION ALL SELECT 'reserves', height, token0, token1, reserves0, reserves1 FROM reserves"""),
    "wide_amounts": sql(DIFFS, CHANGES, VERSIONS, AFTER, RESERVES, PRICE, f"""SELECT 'tick_update' AS kind, height, token0, token1,
        ({larger('reserves')}) || ' ' || ({larger('reserves_diff')}) AS amounts, CAST(tick AS DOUBLE) AS number0, CAST(NULL AS DOUBLE) AS number1
        FROM diffs
        UNION ALL SELECT 'tick_state', height, token0, token1, {larger('reserves')}, CAST(tick AS DOUBLE), CAST(fee AS DOUBLE) FROM versions
        UNION ALL SELECT 'price', height, token0, token1, NULL, CAST(best0 AS DOUBLE), CAST(best1 AS DOUBLE) FROM price
        UNION ALL SELECT 'reserves', height, token0, token1, NULL, CAST({larger('CAST(reserves0 AS BIGINT)')} AS DOUBLE),
          CAST({larger('CAST(reserves1 AS BIGINT)')} AS DOUBLE) FROM reserves"""),
    "append_tokens": sql(RAW, DICTIONARY, "SELECT id, token, first_seq FROM tokens"),
    "append_ohlc": sql(*BEST, ohlc_of("day", HALF)),
    "ohlc_since": sql(*BEST, ohlc_of("day", HALF)),
    "tvl_timeseries": sql(*TOTALS, tvl_of("hour")),
    "swap_volume_timeseries": sql(DIFFS, volume_of("hour")),
    "swap_volume_month": sql(DIFFS, volume_of("month")),
    "sample_stddev": sql("""SELECT token0, token1, round(stddev_samp(CAST(reserves AS DOUBLE)), 4) AS stddev FROM v
        GROUP BY token0, token1"""),
    "page_totals": sql(*STATE, """, ticks AS (SELECT DISTINCT token0, token1, token, tick FROM latest WHERE reserves <> 0)
        SELECT count(*) FILTER (WHERE token = token0) AS total0, count(*) FILTER (WHERE token <> token0) AS total1,
        greatest(count(*) FILTER (WHERE token = token0), count(*) FILTER (WHERE token <> token0)) AS total FROM ticks"""),
    "distinct_tokens": sql(RAW, DICTIONARY, "SELECT token FROM tokens"),
    "first_last_in_bucket": sql(*BEST, f"""SELECT seq, bucket, first_value(last) OVER w AS first_price, last_value(last) OVER w AS last_price
        FROM (SELECT *, {bucket('time_unix', 'day')} AS bucket FROM price JOIN block USING (height) WHERE last IS NOT NULL)
        WINDOW w AS (PARTITION BY token0, token1, bucket ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""),
    "tx_index_in_block": sql("SELECT DISTINCT height, tx_index, md5(height || '-' || tx_index) AS txhash FROM v"),
    "assign_message": sql(RAW, "SELECT rseq AS seq, msg_seq FROM m"),
    "message_type": sql(RAW, "SELECT rseq AS seq, raw_msg_type AS msg_type FROM m"),
    "reserves_diff": sql(DIFFS, "SELECT seq, reserves, reserves_diff FROM diffs"),
    "reserves_diff_by_fee": sql("""SELECT * FROM (SELECT seq, reserves, reserves - coalesce(lag(reserves) OVER (
        PARTITION BY token0, token1, token_in, tick, fee ORDER BY seq), 0) AS reserves_diff FROM v) WHERE reserves_diff <> 0"""),
    "tick_state_versions": sql(CHANGES, VERSIONS, f"SELECT {STATE_COLUMNS} FROM versions"),
    "best_price_series": sql(*BEST, "SELECT seq, height, token0, token1, best0, best1, last FROM price"),
    "reserves_series": sql(*TOTALS, "SELECT seq, height, token0, token1, reserves0, reserves1 FROM reserves"),
    "rank_pairs": sql(*TOTALS, UNIT_PRICES, valued("valued", LAST), """SELECT row_number() OVER (
        ORDER BY value DESC, token0, token1) AS rank, token0, token1 FROM valued"""),
    "daily_returns": sql(*BEST, CLOSES, "SELECT token0, token1, position, round(change, 9) AS change FROM returns"),
    "stats_price_24h": sql(*BEST, ohlc_of("day", *LAST_48H, DAY_OFFSET)),
    "stats_volume_24h": sql(DIFFS, volume_of("day", *LAST_48H, DAY_OFFSET)),
    "stats_tvl_24h": sql(*TOTALS, tvl_of("day", *LAST_48H, DAY_OFFSET)),
    "stats_volatility": sql(*BEST, CLOSES, VOLATILITY + " WHERE n >= days"),
    "stats_volatility_loose": sql(*BEST, CLOSES, VOLATILITY),
    "pairs_liquidity": sql(*TOTALS, UNIT_PRICES, valued("valued", LAST), ranking("ranked", "valued"), "SELECT * FROM ranked"),
    "pairs_liquidity_delta": sql(*TOTALS, UNIT_PRICES, valued("valued", LAST), valued("earlier", HALF),
        ranking("ranked", "valued"), ranking("before", "earlier"), "SELECT * FROM ranked EXCEPT SELECT * FROM before"),
    "time_bucket": sql(TIMES, "SELECT seq, " + ", ".join(
        f"{bucket('t', r)} AS {r}, {bucket('t', r, 18007)} AS {r}_moved"
        for r in ("second", "minute", "hour", "day", "month")) + " FROM times"),
    "day_offset": sql(TIMES, "SELECT seq, t % 86400 AS day_offset FROM times"),
    "round_significant": f"""SELECT l_orderkey, l_linenumber,
        {digits('CAST(round(l_extendedprice * 100) AS BIGINT)', 3)} / 100.0 AS digits3,
        {digits('CAST(round(l_extendedprice * 100) AS BIGINT)', 4)} / 100.0 AS digits4 FROM lineitem""",
    "tick_to_price": sql("""SELECT seq, round(pow(1.0001, tick * 100), 12) AS price,
        round(pow(1.0001, -tick * 100), 12) AS inverted_price FROM v"""),
    "paginate": sql("SELECT seq, tick FROM v ORDER BY seq DESC LIMIT 25 OFFSET 10"),
    "paginate_deep": "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY 1, 2 LIMIT 25 OFFSET 5500",
    "iso_to_unix": sql("SELECT height, time_unix FROM block"),
    "floor_to_minute": sql(TIMES, "SELECT seq, t // 60 * 60 AS minute, t // 86400 * 86400 AS day FROM times"),
    "big_int_math": sql("""SELECT seq, CAST(d AS VARCHAR) AS difference, CAST(CAST(d AS VARCHAR) AS DOUBLE) AS as_double FROM (
        SELECT seq, CAST(amount || '1234567890123456789012345' AS HUGEINT) - seq AS d FROM ev)"""),
    "denom_exponent": sql(PARTS, """SELECT name AS base, 0 AS base_exponent, p_size % 7 AS display_exponent,
        CAST(NULL AS INT) AS unknown_exponent FROM parts"""),
    "parse_denom": """SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN upper(md5('transfer/channel-' || p_size || '/' || name)) END AS hash,
        'transfer' AS port, 'channel-' || p_size AS channel FROM (SELECT *, 'T' || CASE WHEN p_partkey < 10
        THEN '0' || CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey AS VARCHAR) END AS name FROM part)""",
    "action_path": sql(RAW, """SELECT rseq AS seq, CASE WHEN sub = 0 THEN 1 ELSE 0 END AS is_message,
        CASE WHEN sub = 0 THEN action[2:] END AS name FROM r"""),
    "attributes_json": sql(RAW, f"""SELECT rseq AS seq, {ATTRIBUTES} AS attributes,
        CASE WHEN sub > 0 THEN token0 END AS token0 FROM r"""),
    "order_by_time_desc": sql(*TOTALS, tvl_of("day")),
    "top_n": sql("SELECT seq, tick FROM v ORDER BY seq DESC LIMIT 100"),
    "pages": sql("""SELECT seq, tick, token_in, n AS row, (n - 1) // 1000 AS page,
        CASE WHEN total > 1000 THEN last || ':' || ((n - 1) // 1000 * 1000 + 1) || '-'
          || least((n - 1) // 1000 * 1000 + 1000, total) || '/' || total ELSE CAST(last AS VARCHAR) END AS label
        FROM (SELECT *, row_number() OVER (ORDER BY tick, seq DESC) AS n, count(*) OVER () AS total FROM v), p"""),
    "pages_first": sql("""SELECT seq, tick, token_in, n AS row, (n - 1) // 100 AS page,
        CASE WHEN total > 100 THEN last || ':' || ((n - 1) // 100 * 100 + 1) || '-'
          || least((n - 1) // 100 * 100 + 100, total) || '/' || total ELSE CAST(last AS VARCHAR) END AS label
        FROM (SELECT *, row_number() OVER (ORDER BY tick, seq DESC) AS n, count(*) OVER () AS total FROM v), p"""),
    "pages_two_sided": sql("""SELECT seq, tick, side, n AS row, (n - 1) // 100 AS page,
        CASE WHEN total > 100 THEN last || ':' || ((n - 1) // 100 * 100 + 1) || '-'
          || least((n - 1) // 100 * 100 + 100, total) || '/' || total ELSE CAST(last AS VARCHAR) END AS label
        FROM (SELECT *, max(n) OVER () AS total FROM (SELECT seq, tick, CASE WHEN token_in = token0 THEN 0 ELSE 1 END AS side,
          row_number() OVER (PARTITION BY token_in = token0 ORDER BY tick, seq DESC) AS n FROM v)), p"""),
    "completed_blocks": sql("SELECT seq, height FROM v, p WHERE height < newest"),
    "changes_since": sql(CHANGES, FRAMES, "SELECT frames.* FROM frames, p WHERE height > half AND height <= last"),
    "accumulate_changes": sql(CHANGES, VERSIONS, LATEST, """SELECT token0, token1, token, tick, CAST(sum(reserves) AS BIGINT) AS reserves
        FROM latest GROUP BY token0, token1, token, tick HAVING sum(reserves) <> 0"""),
    "suppress_repeats": sql(CHANGES, """, rows AS (SELECT DISTINCT token_in AS feed, height, token0, token1, abs(tick) AS distance FROM chg),
        frame AS (SELECT feed, height, count(*) AS n, list(token0 || token1 || distance ORDER BY token0, token1, distance) AS content
          FROM rows GROUP BY feed, height),
        told AS (SELECT *, lag(content) OVER (PARTITION BY feed ORDER BY height) AS before FROM frame)
        SELECT f.feed, b.height, CASE WHEN content IS NULL OR content IS NOT DISTINCT FROM before THEN 'heartbeat' ELSE 'update' END AS kind,
          coalesce(n, 0) AS rows
        FROM (SELECT DISTINCT feed FROM rows) f CROSS JOIN block b LEFT JOIN told t ON t.feed = f.feed AND t.height = b.height"""),
}
ORACLES |= {
    "to_response_rows": sql(*BEST, f"""SELECT time_unix, '[' || time_unix || ',[' || open || ',' || high || ',' || low || ',' || close || ']]'
        AS row FROM (SELECT token0, token1, {bucket('time_unix', 'day')} AS time_unix, arg_min(last, seq) AS open,
          max(last) AS high, min(last) AS low, arg_max(last, seq) AS close FROM price JOIN block USING (height)
          WHERE last IS NOT NULL GROUP BY 1, 2, 3)"""),
    "ibc_asset_match": sql(PARTS, """SELECT 'ibc/' || upper(md5('transfer/' || channel || '/' || name)) AS token, name AS base,
        channel AS dst_channel, 'coin-' || p_partkey AS price_id FROM parts WHERE p_partkey % 5 <> 4"""),
    "stream_tx_log": sql(RAW, """SELECT height, md5(height || '-' || tx_index) AS txhash, count(*) AS n_events FROM r
        GROUP BY height, tx_index"""),
    "stream_reserves_diff": ORACLES["reserves_diff"],
    "stream_tick_book": sql(CHANGES, AFTER, RESERVES, PRICE, """SELECT 'reserves' AS kind, seq, token0, token1,
        CAST(reserves0 AS BIGINT) AS side0, CAST(reserves1 AS BIGINT) AS side1 FROM reserves
        UNION ALL SELECT 'price', seq, token0, token1, best0, best1 FROM price"""),
    "stream_log_to_book": sql(CHANGES, AFTER, RESERVES, PRICE, """SELECT 'reserves' AS kind, height, token0, token1,
        CAST(reserves0 AS BIGINT) AS side0, CAST(reserves1 AS BIGINT) AS side1 FROM reserves
        UNION ALL SELECT 'price', height, token0, token1, best0, best1 FROM price"""),
    "stream_log_to_windows": sql(*TOTALS, f"""SELECT token0, token1, {bucket('time_unix', 'hour')} AS time_unix,
        arg_max(reserves0, seq) AS amount0, arg_max(reserves1, seq) AS amount1
        FROM reserves JOIN block USING (height) GROUP BY 1, 2, 3"""),
    "stream_windows": sql(*TOTALS, f"""SELECT token0, token1, {bucket('time_unix', 'hour')} AS time_unix,
        arg_max(reserves0, seq) AS amount0, arg_max(reserves1, seq) AS amount1
        FROM reserves JOIN block USING (height) GROUP BY 1, 2, 3"""),
    "stream_price_windows": sql(*BEST, ohlc_of("day", "0", "(SELECT newest FROM p)")),
    "stream_volume_windows": sql(DIFFS, volume_of("day", "-1", "(SELECT newest FROM p)", "18000")),
}
# extra CTEs written inside a query start with a comma
ORACLES = {name: text.replace("\n, ", ",\n") if "\n, " in text else text for name, text in ORACLES.items()}
