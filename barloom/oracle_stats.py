"""SQL of the statistical tests: normal distribution, deflated Sharpe, overfitting, walk-forward, permutations, attribution."""

from __future__ import annotations

import itertools
import re
import statistics

from . import oracle as o
from .functions.columns import CDF_BOTTOM, CDF_TOP, PPF_BOTTOM, PPF_TAIL, PPF_TAIL_BOTTOM, PPF_TAIL_TOP, PPF_TOP

NORMAL = statistics.NormalDist()
EULER = 0.5772156649015329


def slog(x: str) -> str:
    """Keeps the sign, tames the size."""
    return f"sign({x}) * ln(1 + abs({x}))"


def cents(x: str) -> str:
    """Half to even on the decimal digits of a double."""
    d = f"(CAST(CAST({x} AS VARCHAR) AS DECIMAL(30, 14)) * 100)"
    return f"CAST((floor({d}) + CASE WHEN {d} - floor({d}) > 0.5 OR ({d} - floor({d}) = 0.5 AND CAST(floor({d}) AS BIGINT) % 2 = 1) THEN 1 ELSE 0 END) AS DOUBLE) / 100"


def number(x: float) -> str:
    """A double: plain decimals would be decimals in SQL."""
    return f"CAST('{x!r}' AS DOUBLE)"


def poly(x: str, powers: tuple[float, ...]) -> str:
    out = number(powers[0])
    for c in powers[1:]:
        out = f"({out} * {x} + {number(c)})"
    return out


def norm_cdf(x: str) -> str:
    z = f"least(abs({x}), 38.0::DOUBLE)"
    far = "0.65::DOUBLE"
    for k in (4, 3, 2, 1):
        far = f"({k} / ({z} + {far}))"
    near = f"exp(-{z} * {z} / 2) * {poly(z, CDF_TOP)} / {poly(z, CDF_BOTTOM)}"
    tail = f"exp(-{z} * {z} / 2) / ({z} + {far}) / {number(2.506628274631)}"
    below = f"CASE WHEN {z} < {number(7.07106781186547)} THEN {near} ELSE {tail} END"
    return f"CASE WHEN {x} > 0 THEN 1 - ({below}) ELSE {below} END"


def norm_ppf_steps(source: str, p: str, to: str) -> str:
    """CTEs n1, n2 and `to`, which adds ppf to the rows of source."""
    q, t = f"({p} - 0.5)", f"sqrt(-2 * ln(least({p}, 1 - {p})))"
    middle = f"{poly(f'({q} * {q})', PPF_TOP)} * {q} / {poly(f'({q} * {q})', PPF_BOTTOM)}"
    tail = f"{poly(t, PPF_TAIL_TOP)} / {poly(t, PPF_TAIL_BOTTOM)}"
    return (
        f"n1 AS (SELECT *, CASE WHEN {p} < {PPF_TAIL} THEN {tail} WHEN {p} > 1 - {PPF_TAIL} THEN -({tail}) ELSE {middle} END AS x0 FROM {source}), "
        f"n2 AS (SELECT *, ({norm_cdf('x0')} - {p}) * {number(2.5066282746310002)} * exp(x0 * x0 / 2) AS u0 FROM n1), "
        f"{to} AS (SELECT *, CASE WHEN {p} > 0 AND {p} < 1 THEN x0 - u0 / (1 + x0 * u0 / 2) END AS ppf FROM n2)"
    )


def deflated(source: str, n_trials: int | str, by: str = "") -> str:
    """CTEs mo, ms, dz and ds (n_trials, sharpe, hurdle, psr, dsr, min_track_record) from rows with net.

    n_trials: a number, or CASE text over `by`'s columns for hurdles by key (constants of each number of trials).
    """
    unit = lambda n: 0.0 if n <= 1 else (1 - EULER) * NORMAL.inv_cdf(1 - 1 / n) + EULER * NORMAL.inv_cdf(1 - 1 / (n * 2.718281828459045))
    hurdle = number(unit(n_trials)) if isinstance(n_trials, int) else "CASE n_trials " + " ".join(f"WHEN {n} THEN {number(unit(n))}" for n in range(1, 82)) + " END"
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    same = " AND ".join(f"mo.{c.strip()} = s.{c.strip()}" for c in by.split(",")) if by else "TRUE"
    picked = "".join(f"mo.{c.strip()}, " for c in by.split(",")) if by else ""
    z = "((sharpe - {b}) * sqrt(n - 1.0) / sqrt(below))"
    return (
        f"mo AS (SELECT {lead}count(net) AS n, avg(net) AS m, stddev_samp(net) AS sd, var_pop(net) AS v FROM {source} {group}), "
        f"ms AS (SELECT {picked}any_value(n) AS n, any_value(m / sd) AS sharpe, avg(pow(net - m, 3)) / any_value(pow(v, 1.5)) AS sk, avg(pow(net - m, 4)) / any_value(v * v) AS ku FROM mo JOIN {source} s ON {same} {'GROUP BY ' + ', '.join('mo.' + c.strip() for c in by.split(',')) if by else ''}), "
        f"dz AS (SELECT *, {n_trials} AS n_trials, 1 - sk * sharpe + (ku - 1) / 4 * sharpe * sharpe AS below FROM ms), "
        f"dh AS (SELECT *, sqrt(1.0 / (n - 1)) * {hurdle} AS hurdle FROM dz), "
        f"ds AS (SELECT *, {norm_cdf(z.format(b='0'))} AS psr, {norm_cdf(z.format(b='hurdle'))} AS dsr, CASE WHEN sharpe <= 0 THEN 'inf'::DOUBLE ELSE 1 + below * pow({number(NORMAL.inv_cdf(0.95))} / sharpe, 2) END AS min_track_record FROM dh)"
    )


def combinations(trials: str, n_splits: int = 8) -> str:
    """CTEs from rows of trial_id, bar_idx, net to cb: a row per way to choose half of the chunks."""
    ways = itertools.combinations(range(1, n_splits + 1), n_splits // 2)
    rows = ", ".join(f"({i}, {c}, {str(c in way).upper()})" for i, way in enumerate(ways) for c in range(1, n_splits + 1))
    return (
        f"ck AS (SELECT trial_id, CASE WHEN isfinite(net) THEN net ELSE 0.0 END AS r, ntile({n_splits}) OVER (PARTITION BY trial_id ORDER BY bar_idx) AS chunk FROM {trials}), "
        f"sd AS (SELECT * FROM (VALUES {rows}) t(combo, chunk, inside)), "
        "pf AS (SELECT combo, trial_id, inside, CASE WHEN stddev_pop(r) > 1e-12 THEN avg(r) / stddev_pop(r) ELSE 0.0 END AS perf FROM ck JOIN sd USING (chunk) GROUP BY ALL), "
        "io AS (SELECT combo, trial_id, max(CASE WHEN inside THEN perf END) AS i, max(CASE WHEN NOT inside THEN perf END) AS o FROM pf GROUP BY ALL), "
        "bs AS (SELECT *, row_number() OVER (PARTITION BY combo ORDER BY i DESC, trial_id) AS k, count(*) OVER (PARTITION BY combo) AS trials FROM io), "
        "rk AS (SELECT b.combo, b.trial_id AS best, b.i AS is_sharpe, b.o AS oos_sharpe, greatest(1e-6, least(1 - 1e-6, (SELECT count(*) FROM io WHERE io.combo = b.combo AND io.o <= b.o) / (b.trials + 1.0))) AS omega FROM bs b WHERE k = 1), "
        "cb AS (SELECT *, ln(omega / (1 - omega)) AS logit FROM rk)"
    )


def folds(n: str, n_folds: int, ratio: float = 0.7) -> str:
    """CTEs fb and folds (fold, start, test, stop) for a history of n rows (a scalar query)."""
    return (
        f"fb AS (SELECT n, least(n, CAST(floor(n / (1 + ({n_folds} - 1) * (1 - {number(ratio)}))) AS BIGINT)) AS block FROM ({n}) t(n)), "
        f"fc AS (SELECT *, CAST(floor(block * {number(ratio)}) AS BIGINT) AS train FROM fb), "
        f"folds AS (SELECT CAST(k + 1 AS INT) AS fold, CAST(k * (block - train) AS INT) AS start, CAST(k * (block - train) + train AS INT) AS test, CAST(least(n, k * (block - train) + block) AS INT) AS stop FROM fc, range({n_folds}) x(k))"
    )


def drawdown(by: str, source: str) -> str:
    return f"SELECT {by}, min(equity / top - 1) AS mdd FROM (SELECT *, max(equity) OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM {source}) GROUP BY {by}"


def walk_forward(lags: tuple[int, ...] = (5, 10, 20, 60, 120, 250), n_folds: int = 5) -> str:
    """CTEs to wf for the momentum rule on the market's bars."""
    pick = "CASE k " + " ".join(f"WHEN {k} THEN lag(close, {k}) OVER (PARTITION BY fold, trial_id ORDER BY ts)" for k in lags) + " END"
    grid = ", ".join(f"({i}, {k})" for i, k in enumerate(lags))
    rule = f"coalesce({o.sign('m')}, 0.0)"
    rename = lambda text, tag: re.sub(r"\b(tg|e1|e2|e3|e4|e5|bt)\b", lambda m: m[0] + tag, text)
    return (
        f"{o.MARKET}, {folds('SELECT count(*) FROM bars', n_folds)}, gr AS (SELECT * FROM (VALUES {grid}) t(trial_id, k)), "
        f"sl AS (SELECT bars.* EXCLUDE (symbol), fold, trial_id, test, k, {pick} AS before FROM bars JOIN folds ON bar_idx >= start AND bar_idx < stop, gr), "
        f"ms0 AS (SELECT *, close / before - 1 AS m FROM sl), al AS (SELECT *, {rule} AS target FROM ms0), "
        f"tgx AS (SELECT * FROM al WHERE bar_idx < test), {rename(o.engine('fold, trial_id'), 'x')}, "
        f"trn AS ({o.sharpe('fold, trial_id', 'net', 'btx')}), "
        "win AS (SELECT fold, trial_id, sharpe AS is_sharpe FROM trn QUALIFY row_number() OVER (PARTITION BY fold ORDER BY sharpe DESC, trial_id) = 1), "
        f"tgy AS (SELECT al.* FROM al JOIN win USING (fold, trial_id) WHERE bar_idx >= test), {rename(o.engine('fold'), 'y')}, "
        f"oos AS ({o.sharpe('fold', 'net', 'bty')}), gro AS (SELECT fold, last(equity ORDER BY ts) / first(equity ORDER BY ts) - 1 AS oos_return FROM bty GROUP BY fold), ddn AS ({drawdown('fold', 'bty')}), "
        "wf AS (SELECT fold, trial_id, is_sharpe, oos.sharpe AS oos_sharpe, oos_return, mdd AS oos_max_dd, start, test, stop FROM win JOIN oos USING (fold) JOIN gro USING (fold) JOIN ddn USING (fold) JOIN folds USING (fold))"
    )


def dealt_weights(n: int) -> str:
    """CTEs from wt to px: wt once per perm_id, each date's weights dealt anew among listed names."""
    u = o.draw("'1', CAST(perm_id AS VARCHAR), CAST(bar_idx AS VARCHAR), symbol")
    return (
        f"ls AS (SELECT wt.*, CAST(perm_id AS INT) AS perm_id, {u} AS u FROM wt, range({n}) x(perm_id) WHERE listed), "
        "nm AS (SELECT * EXCLUDE (weight, u), row_number() OVER (PARTITION BY perm_id, ts ORDER BY u, symbol) AS k FROM ls), "
        "wk AS (SELECT perm_id, ts, weight, row_number() OVER (PARTITION BY perm_id, ts ORDER BY symbol) AS k FROM ls), "
        f"px AS (SELECT nm.* EXCLUDE (k), wk.weight FROM nm JOIN wk USING (perm_id, ts, k) UNION ALL BY NAME SELECT wt.* EXCLUDE (weight), CAST(perm_id AS INT) AS perm_id, 0.0 AS weight FROM wt, range({n}) x(perm_id) WHERE NOT listed)"
    )


def style_books() -> str:
    """CTE fx (factor, ts, bar_idx, net): the five cost-free books, over a panel CTE."""
    lg = lambda k: o.lag("close", k, "symbol", "bar_idx")
    equal = "wt AS (SELECT *, coalesce(CAST(listed AS DOUBLE) / nullif(sum(CAST(listed AS DOUBLE)) OVER (PARTITION BY ts), 0), 0.0) AS weight FROM panel)"
    books = {
        "market": equal, "momentum": o.book_weights(f"{lg(20)} / {lg(250)} - 1", 21), "low_vol": o.book_weights(f"-({o.roll('stddev_samp', 'ret', 60, 'symbol', 'bar_idx')})", 21),
        "reversal": o.book_weights(f"-(close / {lg(5)} - 1)", 21), "liquidity": o.book_weights("-ln(CASE WHEN close * volume > 0 THEN close * volume END)", 21),
    }
    return "fx AS (" + " UNION ALL ".join(f"SELECT '{k}' AS factor, ts, bar_idx, net FROM (WITH {w}, {o.portfolio(free=True)} SELECT * FROM pd)" for k, w in books.items()) + ")"


def attribution(returns: str) -> str:
    """CTE fitted (name, value): least squares of `returns` (bar_idx, net) on fx, by orthogonalising every regressor against all others."""
    names = ["market", "momentum", "low_vol", "reversal", "liquidity"]
    wide = ", ".join(f"max(CASE WHEN factor = '{f}' THEN net END) AS {f}" for f in names)
    steps = [
        f"wd AS (SELECT bar_idx, {wide} FROM fx GROUP BY bar_idx)",
        f"dt AS (SELECT r.net AS y, 1.0::DOUBLE AS one, {', '.join(names)} FROM {returns} r JOIN wd USING (bar_idx) WHERE r.net IS NOT NULL AND {' AND '.join(f'{f} IS NOT NULL' for f in names)})",
    ]

    def clear(source: str, tag: str, order: list[str], last: list[str]) -> str:
        """Takes out of each later column what the earlier ones explain; the name of the last CTE."""
        for k, x in enumerate(order):
            rest = order[k + 1 :] + last
            out = ", ".join(f"{c} - {x} * coalesce(sum({c} * {x}) OVER () / nullif(sum({x} * {x}) OVER (), 0), 0) AS {c}" for c in rest)
            keep = ", ".join(c for c in ["y0", "one0", *[f"{n}0" for n in names]])
            steps.append(f"{tag}{k} AS (SELECT {keep}, {out} FROM {source})")
            source = f"{tag}{k}"
        return source

    every = ["one", *names]
    steps.append(f"d0 AS (SELECT *, y AS y0, {', '.join(f'{c} AS {c}0' for c in every)} FROM dt)")
    end = clear("d0", "ze", every, ["y"])
    steps.append(f"er AS (SELECT row_number() OVER (ORDER BY y0, one0, {', '.join(f'{n}0' for n in names)}) AS k, y AS e, y0, {', '.join(f'{c}0' for c in every)} FROM {end})")
    found = []
    for x in every:
        others = [c for c in every if c != x]
        end = clear("d0", f"z{x}", others, [x])
        steps.append(f"k{x} AS (SELECT row_number() OVER (ORDER BY y0, one0, {', '.join(f'{n}0' for n in names)}) AS k, {x} AS r, y0 FROM {end})")
        steps.append(f"b{x} AS (SELECT sum(r * er.y0) / nullif(sum(r * r), 0) AS beta, sqrt(sum(r * r * e * e)) / nullif(sum(r * r), 0) AS err FROM k{x} JOIN er USING (k))")
        found += [f"SELECT '{'alpha_annual' if x == 'one' else 'beta_' + x}' AS name, beta{' * 252' if x == 'one' else ''} AS value FROM b{x}", f"SELECT '{'alpha_t_stat' if x == 'one' else 't_' + x}', CASE WHEN err > 0 THEN beta / err WHEN beta IS NOT NULL THEN 0 END FROM b{x}"]
    found += ["SELECT 'r_squared', CASE WHEN var_pop(y0) > 0 THEN 1 - sum(e * e) / (var_pop(y0) * count(*)) ELSE 0 END FROM er", "SELECT 'n_obs', CAST(count(*) AS DOUBLE) FROM er"]
    # a factor that never moves has no row
    steps.append(f"fitted AS (SELECT * FROM ({' UNION ALL '.join(found)}) WHERE value IS NOT NULL)")
    return ", ".join(steps)


def environment() -> str:
    """CTEs to en: the trading environment folded over the market's bars, with an action from the day of the year."""
    return (
        f"{o.MARKET}, st AS MATERIALIZED (SELECT bar_idx, ts, close, lead(close) OVER (ORDER BY ts) AS nxt, CAST(dayofyear(ts) % 3 AS INT) AS action FROM bars), "
        "rec AS (SELECT -1::BIGINT AS bar_idx, NULL::TIMESTAMP AS ts, 0 AS action, 100000.0::DOUBLE AS cash, 0::BIGINT AS held, 100000.0::DOUBLE AS value, 0.0::DOUBLE AS reward "
        "UNION ALL SELECT s.bar_idx, s.ts, s.action, s.cash - s.buy * s.close * 1.001::DOUBLE + s.sell * s.close * 0.999::DOUBLE, s.held + s.buy - s.sell, s.cash - s.buy * s.close * 1.001::DOUBLE + s.sell * s.close * 0.999::DOUBLE + (s.held + s.buy - s.sell) * s.close, "
        "CASE WHEN s.value > 0 THEN (s.cash - s.buy * s.close * 1.001::DOUBLE + s.sell * s.close * 0.999::DOUBLE + (s.held + s.buy - s.sell) * s.nxt - s.value) / s.value ELSE 0.0 END "
        "FROM (SELECT st.*, rec.cash, rec.held, rec.value, CASE WHEN st.action = 0 AND rec.held > 0 THEN least(rec.held, 100) ELSE 0 END AS sell, "
        "CASE WHEN st.action = 2 AND rec.cash > 0 THEN greatest(0, least(CAST(floor(rec.cash / st.close) AS BIGINT), 100 - rec.held)) ELSE 0 END AS buy FROM rec JOIN st ON st.bar_idx = rec.bar_idx + 1 WHERE st.nxt IS NOT NULL) s), "
        "en AS (SELECT 'MARKET' AS symbol, ts, action, cash AS balance, held AS position, value AS portfolio_value, reward FROM rec WHERE bar_idx >= 0)"
    )


def normal(*key: str) -> str:
    return f"(sqrt(-2 * ln({o.draw(', '.join([*key, chr(39) + 'u' + chr(39)]))} + 1e-12)) * cos({o.draw(', '.join([*key, chr(39) + 'v' + chr(39)]))} * 2 * pi()))"


def walk_bars(symbol: str, start: str, n: int, vol: float = 0.02, trend: float = 0.0, noise: float = 0.005) -> str:
    """A query of generated bars."""
    z = lambda k: normal("'0'", f"'{symbol}'", "CAST(id AS VARCHAR)", f"'{k}'")
    u = lambda k: o.draw(f"'0', CAST(id AS VARCHAR), '{k}'")
    return (
        f"WITH s AS (SELECT id, 1 + {noise} * {z('gap')} AS gap, 1 + {trend} + {vol} * {z('body')} AS body, 1.5 + 1.5 * {u('wide')} AS wide, CAST(floor(1000 + 9000 * {u('volume')}) AS INT) AS volume FROM range({n}) x(id)), "
        "c AS (SELECT *, 100 * exp(sum(ln(greatest(gap * body, 1e-6))) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS close FROM s), p AS (SELECT *, close / greatest(body, 1e-6) AS open FROM c), "
        f"h AS (SELECT *, abs(close - open) * wide * {u('reach')} / 2 AS reach FROM p) "
        f"SELECT '{symbol}' AS symbol, TIMESTAMP '{start}' + to_minutes(id) AS ts, round(open, 2) AS open, round(greatest(open, close) + reach, 2) AS high, round(greatest(0.0, least(open, close) - reach), 2) AS low, round(close, 2) AS close, CAST(volume AS DOUBLE) AS volume FROM h"
    )
