"""Pieces of the SQL that the queries are checked against; written for DuckDB, without any code of the operators."""

from __future__ import annotations

_ORDER = "ROW(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
_BAR = f"arg_min(price, {_ORDER}) AS open, max(price) AS high, min(price) AS low, arg_max(price, {_ORDER}) AS close, sum(l_quantity) AS volume"
_LINES = "l AS (SELECT *, l_extendedprice / l_quantity AS price FROM lineitem)"

WEEK = f"""WITH {_LINES},
b0 AS (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, {_BAR} FROM l GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS sess FROM (SELECT DISTINCT date FROM b0)),
w AS (SELECT b0.*, r_name AS grp, sess FROM b0 JOIN cal USING (date) JOIN supplier ON s_suppkey = symbol JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"""

MONTH = f"""WITH {_LINES},
b0 AS (SELECT p_brand AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, {_BAR} FROM l JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) AS sess FROM (SELECT DISTINCT date FROM b0)),
w AS (SELECT b0.*, 'ALL' AS grp, sess FROM b0 JOIN cal USING (date))"""

DAY = f"""WITH {_LINES},
w AS (SELECT p_brand AS symbol, 'ALL' AS grp, CAST(l_shipdate AS DATE) AS date, {_BAR} FROM l JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3)"""

EVENTS = """WITH w AS (SELECT user_id AS symbol, 'ALL' AS grp, CAST(ts AS DATE) AS date, arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
arg_max(value, ROW(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM events GROUP BY 1, 2, 3)"""


def over(n: int) -> str:
    return f"OVER (PARTITION BY symbol ORDER BY sess RANGE BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def at(x: str, k: int) -> str:
    side = "PRECEDING" if k < 0 else "FOLLOWING"
    return f"max({x}) OVER (PARTITION BY symbol ORDER BY sess RANGE BETWEEN {abs(k)} {side} AND {abs(k)} {side})"


def guarded(agg: str, x: str, n: int, least: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} >= {least} THEN {agg} {over(n)} END"


def sma(x: str, n: int) -> str:
    return f"({guarded(f'avg({x})', x, n, max(2, n // 2))})"


def change(x: str, n: int) -> str:
    return f"({x} / nullif({at(x, -n)}, 0) - 1)"


def drawdown(x: str, n: int) -> str:
    return f"({x} / nullif(max({x}) {over(n)}, 0) - 1)"


def rounded(columns: dict[str, int]) -> str:
    return ", ".join(f"round({c}, {d}) + 0.0 AS {c}" for c, d in columns.items())


def features(base: str) -> str:
    """CTEs up to f: all features that need no recurrence."""
    bench = "PARTITION BY 1 ORDER BY sess RANGE BETWEEN 125 PRECEDING AND CURRENT ROW"
    return f"""{base},
bm AS (SELECT sess, avg(close) AS bench FROM w GROUP BY sess),
br AS (SELECT sess, bench, ln(bench / max(bench) OVER (ORDER BY sess RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING)) AS bench_r FROM bm),
bw AS (SELECT *, CASE WHEN count(bench_r) OVER ({bench}) >= 63 THEN var_samp(bench_r) OVER ({bench}) END AS bench_var, CASE WHEN count(bench_r) OVER ({bench}) >= 63 THEN avg(bench_r) OVER ({bench}) END AS bench_mean FROM br),
f1 AS (SELECT w.*, bench, bench_r, bench_var, bench_mean, {at('close', -1)} AS before, ln(close) AS logp, close / bench AS rel, {drawdown('close', 126)} AS drop126, close * volume AS dv FROM w JOIN bw USING (sess)),
f2 AS (SELECT *, ln(close / before) AS ret FROM f1),
f3 AS (SELECT *, {guarded('stddev_samp(ret)', 'ret', 252, 126)} * sqrt(252) AS vol_252, {guarded('stddev_samp(ret)', 'ret', 21, 10)} * sqrt(252) AS vol_21, {change('close', 252)} AS ret_12m,
  CASE WHEN count(ret + bench_r) {over(126)} >= 63 THEN covar_samp(ret, bench_r) {over(126)} END / nullif(bench_var, 0) AS beta_6m, abs(open / before - 1) AS gap, abs(close / before - 1) AS whole,
  CASE WHEN ret < 0 THEN ret * ret ELSE 0.0 END AS loss2 FROM f2),
f AS (SELECT symbol, grp, date, sess, close, volume, vol_21, vol_252, ret_12m, beta_6m,
  close / {sma('close', 20)} - 1 AS ma20_dist, close / {sma('close', 50)} - 1 AS ma50_dist, close / {sma('close', 200)} - 1 AS ma200_dist, {sma('close', 50)} / {sma('close', 200)} - 1 AS ma50_over_200,
  {guarded('regr_slope(logp, sess)', 'logp', 63, 63)} * 252 AS slope_3m, {guarded('regr_slope(logp, sess)', 'logp', 252, 252)} * 252 AS slope_12m,
  CASE WHEN var_pop(logp) {over(63)} > 0 THEN {guarded('regr_r2(logp, sess)', 'logp', 63, 63)} END AS trendfit_3m, CASE WHEN var_pop(logp) {over(252)} > 0 THEN {guarded('regr_r2(logp, sess)', 'logp', 252, 252)} END AS trendfit_12m,
  {change('close', 5)} AS ret_1w, {change('close', 21)} AS ret_1m, {change('close', 63)} AS ret_3m, {change('close', 126)} AS ret_6m, {at('close', -21)} / nullif({at('close', -252)}, 0) - 1 AS mom_12_1,
  vol_21 / nullif(vol_252, 0) AS vol_ratio, {drawdown('close', 252)} AS dd_from_high, sqrt({guarded('avg(drop126 * drop126)', 'drop126', 126, 63)}) AS ulcer_6m, ret_12m / nullif(vol_252, 0) AS sharpe_12m,
  ({guarded('avg(ret)', 'ret', 126, 63)}) * sqrt(252) / nullif(CASE WHEN least(sess, 126) >= 63 THEN sqrt(sum(loss2) {over(126)} / least(sess, 126)) END, 0) AS sortino_6m,
  CASE WHEN count(close) {over(20)} >= 6 THEN (close - min(close) {over(20)}) / nullif(max(close) {over(20)} - min(close) {over(20)}, 0) END AS donch_20,
  CASE WHEN count(close) {over(252)} >= 84 THEN (close - min(close) {over(252)}) / nullif(max(close) {over(252)} - min(close) {over(252)}, 0) END AS donch_252,
  (close - {guarded('avg(close)', 'close', 20, 10)}) / nullif({guarded('stddev_samp(close)', 'close', 20, 10)}, 0) AS boll_z,
  ({guarded('sum(gap)', 'gap', 63, 21)}) / nullif({guarded('sum(whole)', 'whole', 63, 21)}, 0) AS gap_ratio,
  volume / nullif({guarded('quantile_cont(volume, 0.5)', 'volume', 20, 10)}, 0) AS vol_surge, {guarded('quantile_cont(dv, 0.5)', 'dv', 63, 21)} AS dollar_vol,
  (({guarded('avg(ret)', 'ret', 126, 63)}) - beta_6m * bench_mean) * 252 AS alpha_6m, {change('rel', 63)} AS rs_3m, {change('rel', 252)} AS rs_12m FROM f3)"""


def _ewm(name: str, source: str, columns: dict[str, tuple[str, float]]) -> str:
    """A recursive CTE over the sessions of each symbol: of each column (input, alpha) the average y_, its weight w_, and n_ inputs so far."""
    first = ", ".join(f"{x}, 1.0::DOUBLE, CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x, _ in columns.values())
    heads = ", ".join(f"y_{c}, w_{c}, n_{c}" for c in columns)
    step = ", ".join(
        f"CASE WHEN g.{x} IS NULL THEN e.y_{c} WHEN e.y_{c} IS NULL THEN g.{x} ELSE (e.w_{c} * {1 - a} * e.y_{c} + {a} * g.{x}) / (e.w_{c} * {1 - a} + {a}) END, CASE WHEN e.y_{c} IS NULL OR g.{x} IS NOT NULL THEN 1.0 ELSE e.w_{c} * {1 - a} END, e.n_{c} + CASE WHEN g.{x} IS NULL THEN 0 ELSE 1 END"
        for c, (x, a) in columns.items()
    )
    return f"{name}(symbol, sess, {heads}) AS (SELECT symbol, sess, {first} FROM {source} WHERE sess = 1 UNION ALL SELECT g.symbol, g.sess, {step} FROM {name} e JOIN {source} g ON g.symbol = e.symbol AND g.sess = e.sess + 1)"


def recurrences(base: str) -> str:
    """CTEs up to ew (symbol, sess, rsi14, rsi2, macd_hist, atr14, adx14): every session is a row, with nulls where there is no bar."""

    def rsi(n: int) -> str:
        return f"coalesce(CASE WHEN n_gain{n} >= {n} THEN 100 - 100 / (1 + y_gain{n} / nullif(y_loss{n}, 0)) END, 50)"

    one = {"gain14": ("gain", 1 / 14), "loss14": ("loss", 1 / 14), "gain2": ("gain", 1 / 2), "loss2": ("loss", 1 / 2), "tr": ("tr", 1 / 14), "plus": ("plus", 1 / 14), "minus": ("minus", 1 / 14), "e12": ("close", 2 / 13), "e26": ("close", 2 / 27)}
    order = "OVER (PARTITION BY symbol ORDER BY sess)"
    return f"""{base.replace('WITH', 'WITH RECURSIVE', 1)},
g0 AS MATERIALIZED (SELECT s.symbol, c.sess, high, low, close FROM (SELECT symbol, max(sess) AS newest FROM w GROUP BY symbol) s JOIN cal c ON c.sess <= newest LEFT JOIN w ON w.symbol = s.symbol AND w.sess = c.sess),
g1 AS (SELECT *, close - lag(close) {order} AS move, high - lag(high) {order} AS up, lag(low) {order} - low AS down, lag(close) {order} AS before FROM g0),
g2 AS MATERIALIZED (SELECT symbol, sess, close, greatest(move, 0) + 0 * move AS gain, greatest(-move, 0) + 0 * move AS loss, greatest(high - low, abs(high - before), abs(low - before)) AS tr,
CASE WHEN up > down AND up > 0 THEN up ELSE 0.0::DOUBLE END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0::DOUBLE END AS minus FROM g1),
{_ewm('e1', 'g2', one)},
g3 AS (SELECT e1.*, close, CASE WHEN n_tr >= 14 THEN y_tr END AS atr14, CASE WHEN n_e26 >= 13 THEN y_e12 - y_e26 END AS line, 100 * y_plus / nullif(CASE WHEN n_tr >= 14 AND n_plus >= 14 THEN y_tr END, 0) AS p, 100 * y_minus / nullif(CASE WHEN n_tr >= 14 AND n_minus >= 14 THEN y_tr END, 0) AS m FROM e1 JOIN g2 USING (symbol, sess)),
g4 AS MATERIALIZED (SELECT *, 100 * abs(p - m) / nullif(p + m, 0) AS dx FROM g3),
{_ewm('e2', 'g4', {'signal': ('line', 2 / 10), 'adx': ('dx', 1 / 14)})},
ew AS MATERIALIZED (SELECT symbol, sess, {rsi(14)} AS rsi14, {rsi(2)} AS rsi2, (line - y_signal) / close AS macd_hist, atr14, CASE WHEN n_adx >= 14 THEN y_adx END AS adx14 FROM g4 JOIN e2 USING (symbol, sess) WHERE close IS NOT NULL)"""


def scores(source: str, weights: dict[str, dict[str, float]]) -> str:
    """CTEs up to s: scores of the rows of ``source`` (date, symbol, grp, close, features as floats)."""
    used = sorted({f for ws in weights.values() for f in ws})
    peer = "OVER (PARTITION BY date, grp)"
    clip = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN least(greatest(CAST({f} AS DOUBLE), quantile_cont(CAST({f} AS DOUBLE), 0.025) {peer}), quantile_cont(CAST({f} AS DOUBLE), 0.975) {peer}) END AS c_{f}, count({f}) {peer} AS n_{f}" for f in used)
    z = ", ".join(f"CASE WHEN n_{f} < 5 THEN NULL WHEN coalesce(stddev_pop(c_{f}) {peer}, 0) = 0 THEN 0.0 ELSE (c_{f} - avg(c_{f}) {peer}) / stddev_pop(c_{f}) {peer} END AS z_{f}, n_{f}" for f in used)
    raw = []
    for h, ws in weights.items():
        have = [f"CASE WHEN z_{f} IS NULL THEN 0.0 ELSE 1.0 END" for f in ws]
        zs = [f"coalesce(z_{f}, 0) * {1 if w > 0 else -1}" for f, w in ws.items()]
        present = " + ".join(f"{x} * {abs(w)}" for x, w in zip(have, ws.values(), strict=True))
        usable = " + ".join(f"CASE WHEN n_{f} >= 5 THEN {abs(w)} ELSE 0 END" for f, w in ws.items())
        k, s, q = " + ".join(have), " + ".join(zs), " + ".join(f"power({x}, 2)" for x in zs)
        raw.append(f"CASE WHEN peers >= 20 THEN ({present}) / nullif({usable}, 0) END AS cov_{h}")
        raw.append(f"CASE WHEN peers >= 20 THEN ({' + '.join(f'{x} * {abs(w)}' for x, w in zip(zs, ws.values(), strict=True))}) / nullif({present}, 0) END AS raw_{h}")
        raw.append(f"CASE WHEN peers >= 20 AND ({k}) > 1 THEN sqrt(greatest(({q}) - ({s}) * ({s}) / ({k}), 0) / (({k}) - 1)) END AS spread_{h}")
    kept = ", ".join(f"CASE WHEN cov_{h} >= 0.7 THEN raw_{h} END AS score_{h}, cov_{h}, spread_{h}" for h in weights)
    share = ", ".join(
        f"round_even(CASE WHEN score_{h} IS NOT NULL THEN (rank() OVER (PARTITION BY date, grp ORDER BY score_{h} NULLS LAST) + (count(score_{h}) OVER (PARTITION BY date, grp, score_{h}) - 1) / 2.0) / count(score_{h}) {peer} * 100 END, 1) AS pct_{h}" for h in weights
    )
    total = " + ".join(f"coalesce(score_{h}, 0)" for h in weights)
    count = " + ".join(f"CASE WHEN score_{h} IS NULL THEN 0.0 ELSE 1.0 END" for h in weights)
    return f"""s0 AS (SELECT date, symbol, grp, close, count(*) {peer} AS peers, {clip} FROM {source}),
s1 AS (SELECT date, symbol, grp, close, peers, {z} FROM s0),
s2 AS (SELECT date, symbol, grp, close, {', '.join(raw)} FROM s1),
s3 AS (SELECT date, symbol, grp, close, {kept} FROM s2),
s AS (SELECT *, {share}, ({total}) / nullif({count}, 0) AS score_global FROM s3)"""
