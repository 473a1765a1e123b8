"""SQL of the queries, for any engine with window functions and list aggregates (checked with DuckDB)."""

from __future__ import annotations

TRADES = "SELECT l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS q, l_orderkey AS a, l_linenumber AS b, l_suppkey AS c, l_partkey AS part FROM lineitem"
_OHLC = "first(price ORDER BY a, b, c, price) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY a, b, c, price) AS close, sum(q) AS volume"
MARKET = f"trades AS ({TRADES}), bars0 AS (SELECT 'MARKET' AS symbol, ts, {_OHLC} FROM trades GROUP BY ts), bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars0)"
BRAND = f"trades AS ({TRADES}), bars0 AS (SELECT p_brand AS symbol, ts, {_OHLC} FROM trades JOIN part ON p_partkey = part GROUP BY p_brand, ts), bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bars0)"
HOURS = "t AS (SELECT event_type AS symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, event_id, value + 1 AS price FROM events), bars AS (SELECT symbol, ts, first(price ORDER BY event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY event_id) AS close, CAST(count(*) AS DOUBLE) AS volume FROM t GROUP BY symbol, ts)"
PANEL = (
    BRAND + ", cal AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS bar_idx FROM (SELECT DISTINCT ts FROM bars)), "
    "dense AS (SELECT s.symbol, cal.ts, cal.bar_idx, b.open, b.high, b.low, b.close, b.volume FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN cal LEFT JOIN bars b ON b.symbol = s.symbol AND b.ts = cal.ts), "
    "state AS (SELECT *, close IS NOT NULL AS listed, close IS NOT NULL AND coalesce(lag(close IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_idx), FALSE) AS tradable FROM dense), "
    "panel AS (SELECT *, CASE WHEN tradable THEN close / lag(close) OVER (PARTITION BY symbol ORDER BY bar_idx) - 1 END AS ret FROM state)"
)


def r(x: str, name: str, n: int = 6) -> str:
    return f"round({x}, {n}) + 0.0 AS {name}"


def query(ctes: str, cols: str, source: str, more: str = "") -> str:
    return f"WITH {ctes} SELECT {cols} FROM {source} {more}"


def over(by: str = "symbol", order: str = "ts", frame: str = "") -> str:
    return f"OVER (PARTITION BY {by} ORDER BY {order} {frame})"


def last(k: int, by: str = "symbol", order: str = "ts") -> str:
    return over(by, order, f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW")


def far(by: str = "symbol", order: str = "ts") -> str:
    return over(by, order, "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")


def roll(agg: str, x: str, k: int, by: str = "symbol", order: str = "ts") -> str:
    return f"CASE WHEN count({x}) {last(k, by, order)} = {k} THEN {agg}({x}) {last(k, by, order)} END"


def lag(x: str, k: int = 1, by: str = "symbol", order: str = "ts") -> str:
    return f"lag({x}, {k}) {over(by, order)}"


def ema(x: str, alpha: float, least: int) -> str:
    return f"CASE WHEN count({x}) {far()} >= {least} THEN list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {far()}, lambda p, q: p * {1 - alpha!r} + q * {alpha!r}) END"


def ema_adjusted(x: str, alpha: float) -> str:
    top = f"list_reduce(list({x}) FILTER (WHERE {x} IS NOT NULL) {far()}, lambda p, q: p * {1 - alpha!r} + q)"
    return f"{top} / ((1 - pow({1 - alpha!r}, count({x}) {far()})) / {alpha!r})"


def draw(key: str) -> str:
    """key: comma-separated text expressions."""
    return f"(CAST(concat('0x', substr(md5(concat_ws(':', {key})), 1, 8)) AS BIGINT) / 4294967296.0)"


def hold(raw: str, by: str = "symbol", order: str = "ts") -> str:
    return f"coalesce(last_value({raw} IGNORE NULLS) {far(by, order)}, 0.0)"


def sign(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN 1.0 WHEN {x} < 0 THEN -1.0 WHEN {x} = 0 THEN 0.0 END"


def change(k: int = 1, by: str = "symbol") -> str:
    return f"close / {lag('close', k, by)} - 1"


RSI_STEPS = f"moves AS (SELECT *, greatest(close - {lag('close')}, 0) AS gain0, greatest({lag('close')} - close, 0) AS loss0, close - {lag('close')} AS move FROM bars), moves1 AS (SELECT *, CASE WHEN move IS NOT NULL THEN gain0 END AS gain, CASE WHEN move IS NOT NULL THEN loss0 END AS loss FROM moves)"
RANGE_STEP = f"ranges AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)"


def rsi_steps(k: int) -> str:
    return f"{RSI_STEPS}, rs AS (SELECT *, {ema('gain', 1 / k, k)} AS g, {ema('loss', 1 / k, k)} AS l FROM moves1), ind AS (SELECT *, CASE WHEN l > 0 THEN 100 - 100 / (1 + g / l) WHEN g > 0 THEN 100.0 WHEN g IS NOT NULL AND l IS NOT NULL THEN 50.0 END AS r FROM rs)"


def targets() -> dict[str, str]:
    """CTEs ending in `tg` (bars columns and target) for each rule's defaults."""
    out = {"buy_and_hold": "tg AS (SELECT *, 1.0 AS target FROM bars)"}
    plain = lambda steps, t: f"{steps}, tg AS (SELECT *, CASE WHEN ({t}) IS NULL THEN 0.0 ELSE greatest(-1, least(1, {t})) END AS target FROM ind)"
    held = lambda steps, raw, warm: f"{steps}, raw AS (SELECT *, {raw} AS raw FROM ind), tg AS (SELECT *, CASE WHEN {warm} IS NOT NULL THEN {hold('raw')} ELSE 0.0 END AS target FROM raw)"
    out["sma_cross"] = plain(f"ind AS (SELECT *, {roll('avg', 'close', 20)} AS f, {roll('avg', 'close', 100)} AS s FROM bars)", "CASE WHEN s IS NOT NULL THEN CASE WHEN f > s THEN 1.0 ELSE -1.0 END END")
    out["ema_cross"] = plain(f"ind AS (SELECT *, {ema('close', 2 / 13, 12)} AS f, {ema('close', 2 / 51, 50)} AS s FROM bars)", "CASE WHEN s IS NOT NULL THEN CASE WHEN f > s THEN 1.0 ELSE -1.0 END END")
    macd = f"m0 AS (SELECT *, {ema('close', 2 / 13, 12)} - {ema('close', 2 / 27, 26)} AS line FROM bars), ind AS (SELECT *, {ema('line', 0.2, 9)} AS sig, line - {ema('line', 0.2, 9)} AS hist FROM m0)"
    out["macd_trend"] = plain(macd, sign("hist"))
    out["rsi_reversion"] = held(rsi_steps(14), "CASE WHEN r > 45 AND r < 55 THEN 0.0 WHEN r > 70 THEN -1.0 WHEN r < 30 THEN 1.0 END", "r")
    boll = f"b0 AS (SELECT *, {roll('avg', 'close', 20)} AS mid, 2 * {roll('stddev_pop', 'close', 20)} AS band FROM bars), ind AS (SELECT *, mid - band AS lo, mid + band AS up FROM b0)"
    out["bollinger_reversion"] = held(boll, "CASE WHEN abs(close - mid) < 0.1 * (up - mid) THEN 0.0 WHEN close > up THEN -1.0 WHEN close < lo THEN 1.0 END", "mid")
    fr = over(frame="ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING")
    don = f"ind AS (SELECT *, CASE WHEN count(low) {fr} = 20 THEN min(low) {fr} END AS lo, CASE WHEN count(high) {fr} = 20 THEN max(high) {fr} END AS up FROM bars)"
    out["donchian_breakout"] = held(don, "CASE WHEN close < lo THEN -1.0 WHEN close > up THEN 1.0 END", "up")
    out["momentum"] = plain(f"ind AS (SELECT *, {change(60)} AS m FROM bars)", sign("m"))
    out["vol_target_momentum"] = plain(
        f"c0 AS (SELECT *, {change()} AS ch, {change(60)} AS m FROM bars), ind AS (SELECT *, {roll('stddev_pop', 'ch', 20)} * sqrt(252.0) AS rv FROM c0)", f"CASE WHEN rv > 0 THEN ({sign('m')}) * least(1.0, 0.15 / rv) END"
    )
    chan = f"{RANGE_STEP}, ind AS (SELECT *, {roll('avg', 'close', 50)} AS mid, {ema('tr', 1 / 14, 14)} AS band FROM ranges)"
    out["channel_trend"] = held(chan, "CASE WHEN abs(close - mid) < 0.25 * band THEN 0.0 WHEN close < mid - band THEN -1.0 WHEN close > mid + band THEN 1.0 END", "mid + band")
    coin = draw("'coin', '7', CAST(CAST(floor(bar_idx / 5.0) AS BIGINT) AS VARCHAR)")
    out["coin_flip"] = f"tg AS (SELECT *, CASE WHEN {coin} < 0.5 THEN -1.0 ELSE 1.0 END AS target FROM bars)"
    return out


def engine(by: str = "symbol", times: str = "1.0", order: str = "ts") -> str:
    """CTEs from tg to bt: default costs, lag and leverage."""
    steps = [
        f"e1 AS (SELECT *, coalesce(close / {lag('close', 1, by, order)} - 1, 0.0) AS ret, coalesce({lag('target', 1, by, order)}, 0.0) AS position FROM tg)",
        "e2 AS (SELECT *, position * ret AS gross, position * (1 + ret) / (1 + position * ret) AS drifted FROM e1)",
        f"e3 AS (SELECT *, position - coalesce({lag('drifted', 1, by, order)}, 0.0) AS traded FROM e2)",
        f"e4 AS (SELECT *, (abs(traded) * 0.0003 + abs(least(position, 0.0)) * 0.005 / 252) * {times} AS cost FROM e3)",
        "e5 AS (SELECT *, gross - cost AS net FROM e4)",
        f"bt AS (SELECT *, 100000 * product(1 + net) {far(by, order)} AS equity, 100000 * product(1 + ret) {far(by, order)} AS benchmark FROM e5)",
    ]
    return ", ".join(steps)


def sharpe(by: str, c: str = "net", source: str = "bt") -> str:
    return f"SELECT {by}, CASE WHEN count({c}) < 2 OR stddev_samp({c}) < 1e-12 THEN 0.0 ELSE avg({c}) / stddev_samp({c}) * sqrt(252.0) END AS sharpe FROM {source} GROUP BY {by}"


def rank_pct(c: str, by: str = "ts") -> str:
    return f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {c} NULLS LAST) + (count({c}) OVER (PARTITION BY {by}, {c}) - 1) / 2.0) / count({c}) OVER (PARTITION BY {by}) END"


def book_weights(score: str, every: int, steps: str = "") -> str:
    leg = lambda c: f"CAST({c} AS DOUBLE) / nullif(sum(CAST({c} AS DOUBLE)) OVER (PARTITION BY ts), 0)"
    source = "sc0" if steps else "panel"
    return (
        f"{steps}sc AS (SELECT *, {score} AS score FROM {source}), rk AS (SELECT *, {rank_pct('score')} AS rk FROM sc), lg AS (SELECT *, coalesce(rk > 1 - 0.3, FALSE) AS lo, coalesce(rk <= 0.3, FALSE) AS sh FROM rk), "
        f"w0 AS (SELECT *, coalesce(CASE WHEN count(score) OVER (PARTITION BY ts) >= 4 THEN ({leg('lo')}) * 0.5 - ({leg('sh')}) * 0.5 ELSE 0.0 END, 0.0) AS w FROM lg), "
        f"wt AS (SELECT *, coalesce(last_value(CASE WHEN bar_idx % {every} = 0 THEN w END IGNORE NULLS) {far('symbol', 'bar_idx')}, 0.0) AS weight FROM w0)"
    )


def xs_weights() -> dict[str, str]:
    """CTEs from panel to wt for each cross-sectional rule's defaults."""
    lg = lambda k: lag("close", k, "symbol", "bar_idx")
    return {
        "equal_weight": f"w0 AS (SELECT *, coalesce(CAST(listed AS DOUBLE) / nullif(sum(CAST(listed AS DOUBLE)) OVER (PARTITION BY ts), 0), 0.0) AS w FROM panel), wt AS (SELECT *, coalesce(last_value(CASE WHEN bar_idx % 21 = 0 THEN w END IGNORE NULLS) {far('symbol', 'bar_idx')}, 0.0) AS weight FROM w0)",
        "xs_momentum": book_weights(f"{lg(20)} / {lg(250)} - 1", 21),
        "xs_reversal": book_weights(f"-(close / {lg(5)} - 1)", 5),
        "low_volatility": book_weights(f"-({roll('stddev_samp', 'ret', 60, 'symbol', 'bar_idx')})", 21),
        "xs_value_proxy": book_weights(f"-(close / ({roll('avg', 'close', 250, 'symbol', 'bar_idx')}) - 1)", 21),
        "xs_random": book_weights(f"CASE WHEN listed THEN {draw(chr(39) + 'xs' + chr(39) + ', ' + chr(39) + '7' + chr(39) + ', CAST(bar_idx AS VARCHAR), symbol')} END", 21),
    }


def portfolio(carry: str | None = None, by: str = "", source: str = "wt", free: bool = False, cap: float | None = None) -> str:
    """CTEs from wt to pd (dates). carry: the condition of a row to rebalance on; by: a key of separate books; free: without costs; cap: the largest weight of a name."""
    lead, name = (f"{by}, ", f"{by}, symbol") if by else ("", "symbol")
    fee, borrow = ("0.0", "0.0") if free else ("0.0003", "0.005 / 252")
    weight = "coalesce(weight, 0.0)" if cap is None else f"greatest({-cap}, least({cap}, coalesce(weight, 0.0)))"
    steps = [
        f"n1 AS (SELECT *, CASE WHEN listed THEN {weight} ELSE 0.0 END AS w1, coalesce(ret, 0.0) AS ar FROM {source})",
        f"n2 AS (SELECT *, w1 * coalesce(least(1.0, 1.0 / nullif(sum(abs(w1)) OVER (PARTITION BY {lead}ts), 0)), 1.0) AS target FROM n1)",
        f"h1 AS (SELECT *, CASE WHEN tradable THEN coalesce({lag('target', 1, name, 'bar_idx')}, 0.0) ELSE 0.0 END AS held FROM n2)",
    ]
    last_step = "h1"
    if carry:
        seg = f"PARTITION BY {name}, seg ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND"
        steps += [
            f"k0 AS (SELECT *, {carry} AS reb FROM h1)",
            f"k1 AS (SELECT *, sum(CAST(reb AS INT)) {far(name, 'bar_idx')} AS seg FROM k0)",
            f"k2 AS (SELECT *, first_value(held) OVER ({seg} CURRENT ROW) AS ws, min(CAST(tradable AS INT)) OVER ({seg} CURRENT ROW) AS alive FROM k1)",
            "k3 AS (SELECT *, CASE WHEN alive = 1 THEN 1 + ar ELSE 1.0 END AS gg FROM k2)",
            f"k4 AS (SELECT *, coalesce(product(gg) OVER ({seg} 1 PRECEDING), 1.0) AS gr FROM k3)",
            f"k5 AS (SELECT * EXCLUDE (held), CASE WHEN seg > 0 AND alive = 1 THEN ws * gr / (1 + sum(ws * (gr - 1)) OVER (PARTITION BY {lead}ts)) ELSE 0.0 END AS held FROM k4)",
        ]
        last_step = "k5"
    steps += [
        f"p1 AS (SELECT *, coalesce(held * (1 + ar) / nullif(1 + sum(held * ar) OVER (PARTITION BY {lead}ts), 0), 0.0) AS drifted, coalesce(CAST(tradable AS DOUBLE) / nullif(sum(CAST(tradable AS DOUBLE)) OVER (PARTITION BY {lead}ts), 0), 0.0) AS eq FROM {last_step})",
        f"p2 AS (SELECT *, abs(held - coalesce({lag('drifted', 1, name, 'bar_idx')}, 0.0)) AS traded, coalesce({lag('eq', 1, name, 'bar_idx')}, 0.0) * ar AS bench FROM p1)",
        f"p3 AS (SELECT {lead}ts, bar_idx, sum(held * ar) AS gross, sum(traded) AS traded, sum(traded) * {fee} + sum(abs(least(held, 0.0))) * {borrow} AS cost, sum(bench) AS bench, sum(abs(held)) AS exposure, sum(held) AS net_exposure, count(CASE WHEN abs(held) > 1e-9 THEN 1 END) AS positions, sum(held * held) / nullif(sum(abs(held)) * sum(abs(held)), 0) AS hhi FROM p2 GROUP BY {lead}ts, bar_idx)",
        "p4 AS (SELECT *, gross - cost AS net FROM p3)",
        f"pd AS (SELECT *, 100000 * product(1 + net) OVER ({f'PARTITION BY {by} ' if by else ''}ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS equity FROM p4)",
    ]
    return ", ".join(steps)
