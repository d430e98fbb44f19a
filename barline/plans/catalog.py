"""All registered queries, each beside the SQL that it is checked against.

Doubles are rounded to so many places that the order of additions does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.functions import rolling as r
from barline.operators import anomalies, calendar, evidence, ewm, features, ingest, portfolio, report, scoring, simulation
from barline.plans import sql
from barline.sources import bars, feeds, html_tables, shared, store, universe
from barline.streaming import bars as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def scores_query(oracle: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """The query with the operator's own weights, and plain_ of it without the features that are recurrences; each beside its SQL."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        QUERIES[f"plain_{f.__name__}"] = lambda spark, d: f(spark, d, plain=True)
        ORACLES[f"plain_{f.__name__}"] = oracle
        ORACLES[f.__name__] = oracle.replace(_SCORED, _ALL_SCORED).replace(_PLAIN_CONTRIB, _ALL_CONTRIB)
        return f

    return register


def rounded(df: DataFrame, columns: dict[str, int], *keys: str) -> DataFrame:
    return df.select(*keys, *[(F.round(c, d) + 0.0).alias(c) for c, d in columns.items()])


def week(spark: SparkSession, d: str) -> DataFrame:
    return shared.saved(calendar.with_sessions(bars.supplier_week(spark, d)), "bars", by="symbol")


def month(spark: SparkSession, d: str) -> DataFrame:
    return shared.saved(calendar.with_sessions(bars.brand_month(spark, d)), "bars", by="symbol")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


# ---- bars and calendar ----------------------------------------------------------------------------

# Prices are single quotients and volumes whole numbers: equal in every engine without rounding.
_PRICES = ("open", "high", "low", "close", "volume")
_PRICE_SQL = ", ".join(_PRICES)


@query(f"{sql.WEEK} SELECT symbol, grp, date, CAST(sess AS INTEGER) AS sess, {_PRICE_SQL} FROM w")
def bars_supplier_week(spark: SparkSession, d: str) -> DataFrame:
    return week(spark, d).select("symbol", "grp", "date", "sess", *_PRICES)


@query(f"{sql.MONTH} SELECT symbol, grp, date, CAST(sess AS INTEGER) AS sess, {_PRICE_SQL} FROM w")
def bars_brand_month(spark: SparkSession, d: str) -> DataFrame:
    return month(spark, d).select("symbol", "grp", "date", "sess", *_PRICES)


@query(f"{sql.DAY} SELECT symbol, date, {_PRICE_SQL} FROM w WHERE isodow(date) < 6")
def business_day_bars(spark: SparkSession, d: str) -> DataFrame:
    return calendar.business_days(bars.brand_day(spark, d)).select("symbol", "date", *_PRICES)


@query(f"{sql.EVENTS} SELECT symbol, date, {_PRICE_SQL} FROM w")
def bars_events_day(spark: SparkSession, d: str) -> DataFrame:
    return bars.events_day(spark, d).select("symbol", "date", *_PRICES)


@query(f"{sql.WEEK} SELECT symbol, max(date) AS last_date FROM w GROUP BY symbol")
def last_dates(spark: SparkSession, d: str) -> DataFrame:
    return ingest.last_dates(bars.supplier_week(spark, d))


@query(f"{sql.WEEK} SELECT symbol, count(*) AS n FROM w GROUP BY symbol HAVING count(close) >= 285")
def enough_history(spark: SparkSession, d: str) -> DataFrame:
    return ingest.enough_history(bars.supplier_week(spark, d), 285).groupBy("symbol").agg(F.count("*").alias("n"))


_LAST = """n AS (SELECT date, count(close) AS bars FROM w GROUP BY date),
m AS (SELECT *, quantile_cont(bars, 0.5) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM n),
e AS (SELECT coalesce(max(date) FILTER (usual IS NULL OR usual <= 0 OR bars >= 0.6 * usual), max(date)) AS last FROM m)"""


@query(f"{sql.EVENTS}, {_LAST} SELECT symbol, date, round(close, 4) + 0.0 AS close FROM w, e WHERE date <= last")
def complete_sessions(spark: SparkSession, d: str) -> DataFrame:
    return rounded(calendar.trim_incomplete(bars.events_day(spark, d)), {"close": 4}, "symbol", "date")


@query(f"{sql.WEEK} SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date)")
def rebalance_dates(spark: SparkSession, d: str) -> DataFrame:
    return calendar.rebalance_dates(bars.supplier_week(spark, d))


@query(f"{sql.WEEK} SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM cal")
def next_session(spark: SparkSession, d: str) -> DataFrame:
    return calendar.next_session(bars.supplier_week(spark, d))


@query(
    f"""{sql.WEEK}, t AS (SELECT symbol, max(date) AS last FROM w GROUP BY symbol) SELECT symbol,
CAST(greatest((SELECT count(*) FROM (SELECT unnest(generate_series(last, DATE '2001-11-14', INTERVAL 1 DAY)) AS x) WHERE isodow(x) < 6) - 1, 0) AS INTEGER) AS late FROM t"""
)
def sessions_late(spark: SparkSession, d: str) -> DataFrame:
    rows = ingest.last_dates(bars.supplier_week(spark, d)).withColumn("today", F.lit("2001-11-14").cast("date"))
    return rows.select("symbol", calendar.sessions_late("last_date", "today").cast("int").alias("late"))


# ---- rolling windows and features -----------------------------------------------------------------


@query(f"{sql.WEEK} SELECT symbol, sess, round({sql.sma('close', 20)}, 3) + 0.0 AS sma20, round({sql.change('close', 5)}, 6) + 0.0 AS roc5, round({sql.at('close', -21)} / {sql.at('close', -52)} - 1, 6) + 0.0 AS mom FROM w")
def moving_averages(spark: SparkSession, d: str) -> DataFrame:
    c, w = F.col("close"), r.Windows()
    rows = w.add(r.in_units(week(spark, d).withColumns({"roc5": r.change(c, 5), "mom": r.momentum(c, 52, 21)}), "close", "unit"), {"sma20": w.sma("unit", 20) * F.try_divide(c, F.col("unit"))})
    return rounded(rows, {"sma20": 3, "roc5": 6, "mom": 6}, "symbol", F.col("sess").cast("long").alias("sess"))


_PRE = f"x AS (SELECT *, ln(close) AS y, {sql.at('close', -1)} AS before FROM w)"


@query(
    f"""{sql.MONTH}, {_PRE} SELECT symbol, date, round({sql.guarded('regr_slope(y, sess)', 'y', 12, 12)} * 252, 6) + 0.0 AS slope,
round(CASE WHEN var_pop(y) {sql.over(12)} > 0 THEN {sql.guarded('regr_r2(y, sess)', 'y', 12, 12)} END, 6) + 0.0 AS fit FROM x"""
)
def trend(spark: SparkSession, d: str) -> DataFrame:
    rows = r.centred(month(spark, d).withColumn("log", F.ln("close")), "log", "y")
    w = r.Windows()
    return rounded(w.add(rows, {"slope": w.slope("y", 12), "fit": w.fit("y", 12)}), {"slope": 6, "fit": 6}, "symbol", "date")


@query(f"{sql.WEEK}, {_PRE} SELECT symbol, date, greatest(high - low, abs(high - before), abs(low - before)) AS true_range, round(close / max(close) OVER (PARTITION BY symbol ORDER BY sess) - 1, 6) + 0.0 AS drop FROM x")
def true_range(spark: SparkSession, d: str) -> DataFrame:
    rows = week(spark, d).withColumn("before", r.at(F.col("close"), -1))
    rows = rows.withColumns({"true_range": r.true_range(F.col("high"), F.col("low"), F.col("before")), "drop": r.drawdown(F.col("close"))})
    return rounded(rows, {"drop": 6}, "symbol", "date", "true_range")


_PLAIN = {f: 6 for f in features.FEATURES if f not in ("adx14", "rsi14", "rsi2", "macd_hist", "atr_pct")}


# Medians of whole cents would be rounded at exact halves; their logarithms are not.
@query(f"{sql.features(sql.WEEK)} SELECT symbol, date, {sql.rounded(_PLAIN)} FROM (SELECT * REPLACE (ln(dollar_vol) AS dollar_vol) FROM f)")
def feature_history(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.build_features(week(spark, d), ewm=False).withColumn("dollar_vol", F.ln("dollar_vol")), _PLAIN, "symbol", "date")


_ALL = {f: 6 for f in features.FEATURES}
_ALL_FEATURES = f"{sql.features(sql.recurrences(sql.WEEK))}, fa AS (SELECT f.*, rsi14, rsi2, macd_hist, atr14 / nullif(close, 0) AS atr_pct, adx14 FROM f JOIN ew USING (symbol, sess))"


@query(f"{_ALL_FEATURES} SELECT symbol, date, {sql.rounded(_ALL)} FROM (SELECT * REPLACE (ln(dollar_vol) AS dollar_vol) FROM fa)")
def all_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.build_features(week(spark, d)).withColumn("dollar_vol", F.ln("dollar_vol")), _ALL, "symbol", "date")


def _recursive_ema(n: int, least: int) -> str:
    """Exponential average with gaps: the weight of the old value decays over sessions without a bar."""
    a = 2 / (n + 1)
    return f"""{sql.MONTH.replace('WITH', 'WITH RECURSIVE', 1)},
g AS (SELECT symbol, c.sess, w.close FROM (SELECT DISTINCT symbol FROM w) CROSS JOIN (SELECT sess FROM cal) c LEFT JOIN w USING (symbol, sess)),
e(symbol, sess, y, old, n) AS (SELECT symbol, sess, close, CAST(1 AS DOUBLE), CASE WHEN close IS NULL THEN 0 ELSE 1 END FROM g WHERE sess = 1
UNION ALL SELECT g.symbol, g.sess, CASE WHEN g.close IS NULL THEN e.y WHEN e.y IS NULL THEN g.close ELSE (e.old * {1 - a} * e.y + {a} * g.close) / (e.old * {1 - a} + {a}) END,
CASE WHEN e.y IS NULL OR g.close IS NOT NULL THEN 1.0 ELSE e.old * {1 - a} END, e.n + CASE WHEN g.close IS NULL THEN 0 ELSE 1 END FROM e JOIN g ON g.symbol = e.symbol AND g.sess = e.sess + 1)
SELECT w.symbol, w.date, round(CASE WHEN e.n >= {least} THEN e.y END, 3) + 0.0 AS ema FROM w JOIN e USING (symbol, sess)"""


@query(_recursive_ema(12, 6))
def ema(spark: SparkSession, d: str) -> DataFrame:
    return ewm.with_ewm(month(spark, d)).select("symbol", "date", (F.round("ema12", 3) + 0.0).alias("ema"))


_EWM = {"rsi14": 6, "rsi2": 6, "macd_hist": 8, "atr14": 3, "adx14": 6}


@query(f"{sql.recurrences(sql.WEEK)} SELECT w.symbol, w.date, {sql.rounded(_EWM)} FROM ew JOIN w USING (symbol, sess)")
def ewm_indicators(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ewm.with_ewm(week(spark, d)), _EWM, "symbol", "date")


_FORWARD = f"SELECT date, symbol, {sql.at('close', 10)} / close - 1 AS fwd_short, {sql.at('close', 63)} / close - 1 AS fwd_medium, {sql.at('close', 252)} / close - 1 AS fwd_long FROM w"
_FWD = {"fwd_short": 6, "fwd_medium": 6, "fwd_long": 6}


@query(f"{sql.WEEK}, o AS ({_FORWARD}) SELECT date, symbol, {sql.rounded(_FWD)} FROM o")
def forward_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(features.forward_returns(week(spark, d)), _FWD, "date", "symbol")


# ---- panel and scores -----------------------------------------------------------------------------

#: Signed weights over the features that are no recurrences: those of the queries named plain_.
WEIGHTS = {h: {f: w for f, w in ws.items() if f in _PLAIN} for h, ws in scoring.WEIGHTS.items()}
_USED = sorted({f for ws in WEIGHTS.values() for f in ws})
_REB = "reb AS (SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date))"


def _panel(base: str, source: str, used: list[str]) -> str:
    return f"{base}, {_REB}, p AS (SELECT date, symbol, grp, CAST(close AS FLOAT) AS close, {', '.join(f'CAST({f} AS FLOAT) AS {f}' for f in used)} FROM {source} SEMI JOIN reb USING (date) WHERE coalesce(dollar_vol, 0) >= 1000 OR grp IN ('fx', 'index'))"


_PANEL = _panel(sql.features(sql.WEEK), "f", _USED)
_SCORED = f"{_PANEL}, {sql.scores('p', WEIGHTS)}"
_ALL_SCORED = f"{_panel(_ALL_FEATURES, 'fa', sorted({f for ws in scoring.WEIGHTS.values() for f in ws}))}, {sql.scores('p', scoring.WEIGHTS)}"
_SCORES = {f"{k}_{h}": 1 if k == "pct" else 4 for h in WEIGHTS for k in ("score", "cov", "spread", "pct")} | {"score_global": 4}


def weights_of(plain: bool) -> dict[str, dict[str, float]]:
    return WEIGHTS if plain else scoring.WEIGHTS


def panel(spark: SparkSession, d: str, plain: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """rows: the bars, where the query has saved them already."""
    rows = week(spark, d) if rows is None else rows
    return features.sample_panel(features.build_features(rows, ewm=not plain), calendar.rebalance_dates(rows), 1000.0)


def scored(spark: SparkSession, d: str, plain: bool = False, rows: DataFrame | None = None) -> DataFrame:
    return scoring.score_panel(panel(spark, d, plain, rows), weights_of(plain))


@query(f"{_PANEL} SELECT grp, date, count(*) AS n, round(avg(CAST(close AS DOUBLE)), 3) + 0.0 AS close FROM p GROUP BY ALL")
def sampled_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel(spark, d, plain=True).groupBy("grp", "date").agg(F.count("*").alias("n"), F.avg(F.col("close").cast("double")).alias("close")), {"close": 3}, "grp", "date", "n")


def _contributions(weights: dict[str, float]) -> str:
    return " UNION ALL ".join(f"SELECT symbol, '{f}' AS feature, z_{f} * {1 if w > 0 else -1} AS z, {abs(w)} AS weight FROM s1 WHERE peers >= 20 AND date = (SELECT max(date) FROM p)" for f, w in weights.items())


_PLAIN_CONTRIB, _ALL_CONTRIB = _contributions(WEIGHTS["medium"]), _contributions(scoring.WEIGHTS["medium"])


@scores_query(f"{_SCORED} SELECT date, symbol, grp, {sql.rounded(_SCORES)} FROM s")
def score_panel(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(scored(spark, d, plain), _SCORES, "date", "symbol", "grp")


@scores_query(f"{_SCORED} SELECT symbol, grp, round(score_medium, 4) + 0.0 AS score FROM s WHERE date = (SELECT max(date) FROM s) AND score_medium IS NOT NULL AND coalesce(spread_medium, 9) <= 1.6 ORDER BY score_medium DESC, symbol LIMIT 10")
def top_picks(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return scoring.top_picks(scored(spark, d, plain), "medium", 10).select("symbol", "grp", (F.round("score_medium", 4) + 0.0).alias("score"))


@scores_query(f"{_SCORED} SELECT symbol, pct_medium AS pct FROM s WHERE date = (SELECT max(date) FROM s) AND score_medium IS NOT NULL ORDER BY pct_medium DESC NULLS LAST, score_medium DESC, symbol LIMIT 30")
def report_ranking(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return scoring.report_ranking(scored(spark, d, plain), "medium").select("symbol", F.col("pct_medium").alias("pct"))


@scores_query(f"{_SCORED}, c AS ({_PLAIN_CONTRIB}) SELECT symbol, feature, round(z, 4) + 0.0 AS z, round(z * weight, 4) + 0.0 AS contribution FROM c")
def contributions(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(scoring.contributions(panel(spark, d, plain), weights_of(plain)["medium"]), {"z": 4, "contribution": 4}, "symbol", "feature")


@scores_query(
    f"""{_SCORED}, c AS ({_PLAIN_CONTRIB}), o AS (SELECT symbol, feature, z * weight AS x, row_number() OVER (PARTITION BY symbol ORDER BY z * weight DESC, feature) AS top, row_number() OVER (PARTITION BY symbol ORDER BY z * weight, feature) AS low FROM c WHERE z IS NOT NULL)
SELECT symbol, 'Mostly from ' || string_agg(feature || printf(' %+.2f', x), ', ' ORDER BY top) FILTER (top <= 3) || '; held back by ' || string_agg(feature || printf(' %+.2f', x), ', ' ORDER BY low) FILTER (low <= 2) || '.' AS comment FROM o GROUP BY symbol"""
)
def comments(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return report.comments(scoring.contributions(panel(spark, d, plain), weights_of(plain)["medium"]))


_RETURNS = f"lr AS (SELECT symbol, sess, ln(close / {sql.at('close', -1)}) AS x FROM w)"


@query(
    f"""{sql.MONTH}, recent AS (SELECT * FROM w WHERE sess >= (SELECT max(sess) FROM w) - 60), lr AS (SELECT symbol, sess, ln(close / {sql.at('close', -1)}) AS x FROM recent)
SELECT a.symbol AS a, b.symbol AS b, round(covar_pop(a.x, b.x) / nullif(stddev_pop(a.x) * stddev_pop(b.x), 0), 6) + 0.0 AS corr FROM lr a JOIN lr b ON a.sess = b.sess AND a.symbol < b.symbol WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY 1, 2"""
)
def correlations(spark: SparkSession, d: str) -> DataFrame:
    rows = month(spark, d)
    names = [x[0] for x in rows.select("symbol").distinct().orderBy("symbol").limit(100).collect()]
    return rounded(scoring.correlations(rows, names, 60), {"corr": 6}, "a", "b")


# ---- evidence -------------------------------------------------------------------------------------

_MERGED = f"{_SCORED}, fw AS ({_FORWARD}), j AS (SELECT s.date, s.symbol, 'ALL' AS grp, score_short AS x, fwd_short AS y FROM s JOIN fw USING (date, symbol) WHERE score_short IS NOT NULL AND fwd_short IS NOT NULL)"
_RANKED = f"{_MERGED}, k AS (SELECT *, rank() OVER (PARTITION BY date, grp ORDER BY x) + (count(*) OVER (PARTITION BY date, grp, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY date, grp ORDER BY y) + (count(*) OVER (PARTITION BY date, grp, y) - 1) / 2.0 AS ry FROM j)"
_IC = f"{_RANKED}, ic AS (SELECT date, grp, count(*) AS n, covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) AS ic FROM k GROUP BY 1, 2 HAVING count(*) >= 30)"


def pooled(spark: SparkSession, d: str, plain: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """Scores as one group, so that there are enough pairs."""
    return scored(spark, d, plain, rows).withColumn("grp", F.lit("ALL"))


def coefficient(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    rows = week(spark, d)
    return evidence.information_coefficient(pooled(spark, d, plain, rows), features.forward_returns(rows), "short")


@scores_query(f"{_IC} SELECT date, grp, n, round(ic, 6) + 0.0 AS ic FROM ic")
def information_coefficient(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(coefficient(spark, d, plain), {"ic": 6}, "date", "grp", "n")


_LAGS = 2
_NW = f"""{_IC}, dd AS (SELECT *, ic - avg(ic) OVER (PARTITION BY grp) AS d, count(*) OVER (PARTITION BY grp) AS size FROM ic WHERE ic IS NOT NULL),
pp AS (SELECT grp, size, d, {', '.join(f'd * lag(d, {k}) OVER (PARTITION BY grp ORDER BY date) AS p{k}' for k in range(1, _LAGS + 1))} FROM dd),
se AS (SELECT grp, count(*) AS n, sum(d * d) + {' + '.join(f'coalesce(sum(2 * (1 - {k} / {_LAGS + 1}.0) * p{k}), 0)' for k in range(1, _LAGS + 1))} AS v FROM pp GROUP BY grp),
sm AS (SELECT grp, count(*) AS periods, avg(ic) AS m, stddev_samp(ic) AS sd, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) * 100 AS p FROM ic GROUP BY grp),
su AS (SELECT sm.*, CASE WHEN n >= 5 THEN m / sqrt(greatest(v / n, 1e-12) / n) END AS t FROM sm LEFT JOIN se USING (grp))"""


@scores_query(f"{_NW} SELECT grp, periods, round_even(m, 3) AS ic_mean, round_even(sd, 3) AS ic_std, round_even(p, 3) AS ic_positive_pct, round_even(t, 3) AS t_stat, round_even(m * sqrt(periods) / nullif(sd, 0), 3) AS t_naive FROM su")
def ic_summary(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return evidence.ic_summary(coefficient(spark, d, plain), _LAGS + 1)


def judged(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return evidence.verdict(evidence.ic_summary(coefficient(spark, d, plain), _LAGS + 1).withColumn("horizon", F.lit("short")))


@scores_query(
    f"""{_NW}, v3 AS (SELECT grp, periods AS periods, round_even(m, 3) AS ic_mean, round_even(t, 3) AS t FROM su) SELECT 'short' AS horizon, grp, ic_mean, round_even(t, 2) AS t_stat, periods,
t IS NOT NULL AND periods >= 20 AND abs(ic_mean) <= 0.15 AS usable, CASE WHEN t IS NULL THEN 'no data' WHEN periods < 20 THEN 'too little evidence: only ' || periods || ' windows' WHEN abs(ic_mean) > 0.15 THEN 'suspicious: look for a data leak'
WHEN t > 2.5 THEN 'consistent signal' WHEN t > 1.5 THEN 'weak signal, not conclusive' ELSE 'no evidence of a signal' END AS verdict FROM v3"""
)
def verdict(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return judged(spark, d, plain)


@scores_query(
    f"""{_NW}, v3 AS (SELECT round_even(round_even(t, 3), 2) AS t FROM su WHERE t IS NOT NULL AND periods >= 20 AND abs(round_even(m, 3)) <= 0.15), q AS (SELECT coalesce(least(greatest(median(t) - 1, 0), 3), 0) AS power FROM v3)
SELECT h AS horizon, round(CASE WHEN power > 0 THEN CASE WHEN h = 'short' THEN 1.0 ELSE 0.0 END ELSE 1 / 3.0 END, 6) + 0.0 AS weight FROM q, (VALUES ('short'), ('medium'), ('long')) AS t(h)"""
)
def evidence_weights(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(evidence.evidence_weights(judged(spark, d, plain)), {"weight": 6}, "horizon")


_BINNED = f"{_MERGED}, r0 AS (SELECT *, row_number() OVER (PARTITION BY date, grp ORDER BY x, symbol) AS rk, count(*) OVER (PARTITION BY date, grp) AS size FROM j), dv AS (SELECT date, grp, count(DISTINCT x) AS vals FROM j GROUP BY 1, 2), bn AS (SELECT r0.*, greatest(1, CAST(ceil((rk - 1) * 10 / (size - 1.0)) AS INTEGER)) AS bin FROM r0 JOIN dv USING (date, grp) WHERE vals >= 10)"


def binned(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    rows = week(spark, d)
    return evidence.with_decile(pooled(spark, d, plain, rows), features.forward_returns(rows), "short")


@scores_query(f"{_BINNED} SELECT grp, bin, round_even(avg(y), 4) AS mean, round_even(median(y), 4) AS median, round_even(stddev_samp(y), 4) AS std, count(*) AS count FROM bn GROUP BY 1, 2")
def decile_stats(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return evidence.decile_stats(binned(spark, d, plain))


_SPREAD = f"{_BINNED}, sp AS (SELECT grp, date, avg(y) FILTER (bin = 10) - avg(y) FILTER (bin = 1) AS spread FROM bn GROUP BY 1, 2)"


@scores_query(f"{_SPREAD} SELECT grp, date, round(spread, 6) + 0.0 AS spread FROM sp")
def decile_spread(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(evidence.decile_spread(binned(spark, d, plain)), {"spread": 6}, "grp", "date")


_TURN = """top AS (SELECT grp, date, symbol FROM (SELECT 'ALL' AS grp, date, symbol, row_number() OVER (PARTITION BY date ORDER BY score_short DESC NULLS LAST, symbol) AS place FROM s) WHERE place <= 20),
days AS (SELECT grp, date, row_number() OVER (PARTITION BY grp ORDER BY date) AS turn FROM (SELECT DISTINCT grp, date FROM top)), nw AS (SELECT * FROM top JOIN days USING (grp, date)),
tu AS (SELECT a.grp, a.date, 1 - count(b.symbol) / CAST(count(*) AS DOUBLE) AS turnover FROM nw a LEFT JOIN nw b ON a.grp = b.grp AND a.symbol = b.symbol AND a.turn = b.turn + 1 WHERE a.turn > 1 GROUP BY 1, 2)"""


@scores_query(f"{_SCORED}, {_TURN} SELECT grp, date, round(turnover, 6) + 0.0 AS turnover FROM tu")
def turnover(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(evidence.turnover(pooled(spark, d, plain), "short", 20), {"turnover": 6}, "grp", "date")


@scores_query(f"{_SPREAD}, {_TURN}, co AS (SELECT sp.grp, spread, coalesce(turnover, 0) * 2 * 10 / 1e4 AS cost FROM sp LEFT JOIN tu USING (grp, date)) SELECT grp, round_even(avg(spread), 4) AS spread, round_even(avg(cost), 4) AS cost, round_even(avg(spread - cost), 4) AS net, count(*) AS periods FROM co GROUP BY grp")
def net_of_costs(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    rows = week(spark, d)
    scores = shared.saved(pooled(spark, d, plain, rows).select("date", "symbol", "grp", "score_short"), "scores")  # for deciles and turnover
    spread = evidence.decile_spread(evidence.with_decile(scores, features.forward_returns(rows), "short"))
    return evidence.net_of_costs(spread, evidence.turnover(scores, "short", 20))


@scores_query(f"{_SCORED}, {_TURN} SELECT grp, round_even(avg(turnover), 3) AS turnover FROM tu GROUP BY grp")
def mean_turnover(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return evidence.mean_turnover(evidence.turnover(pooled(spark, d, plain), "short", 20))


# ---- screening ------------------------------------------------------------------------------------

_SPLITS = ", ".join(str(float(x)) for k in anomalies.SPLIT_RATIOS for x in (k, 1 / k))
_SEVERITY = " + ".join(f"CASE WHEN {f} THEN {w} ELSE 0.0 END::DOUBLE" for f, w in anomalies.SEVERITY.items())
_FLAGS = f"""z AS (SELECT max(sess) AS newest, min(sess) AS oldest, max(date) AS newest_date FROM w), a0 AS (SELECT w.*, least(newest - oldest + 1, 504) AS sessions, newest_date FROM w, z WHERE sess > newest - 504),
a1 AS (SELECT *, {sql.at('close', -1)} AS before, {sql.at('close', 5)} AS after5 FROM a0), a2 AS (SELECT *, ln(close / before) AS lr, close / before AS jump, coalesce(abs(close - before) <= 1e-12, FALSE) AS still FROM a1),
a3 AS (SELECT *, {sql.guarded('stddev_samp(lr)', 'lr', 120, 40)} AS sigma, {sql.at('lr', 1)} AS lrn, least(greatest(2.5 * coalesce(stddev_samp(lr) OVER (PARTITION BY symbol), 0.02), 0.02), 0.1) AS tol FROM a2),
isl AS (SELECT symbol, sess - row_number() OVER (PARTITION BY symbol ORDER BY sess) AS i FROM a3 WHERE still), run AS (SELECT symbol, max(n) AS run FROM (SELECT symbol, i, count(*) AS n FROM isl GROUP BY 1, 2) GROUP BY 1),
ag AS (SELECT symbol, coalesce(bool_or(len(list_filter([{_SPLITS}], lambda x: abs(jump - x) / x < tol)) > 0 AND abs(jump - 1) > 0.25 AND abs(after5 / close - 1) < 0.25), FALSE) AS unadjusted_split,
coalesce(bool_or(abs(lr) > 6 * sigma AND lrn * lr < 0 AND abs(lrn) > 0.6 * abs(lr) AND abs(lr) > 0.2), FALSE) AS bad_tick, count(*) FILTER (open = high AND high = low AND low = close) / CAST(max(sessions) AS DOUBLE) > 0.2 AS flat_bars,
count(*) FILTER (volume <= 0) / CAST(max(sessions) AS DOUBLE) > 0.1 AS zero_volume, max(newest_date) - max(date) > 10 AS dead, coalesce(median(close * volume), 0) < 1000000 AS illiquid, round(median(close * volume), 3) + 0.0 AS dollar_volume, max(date) AS last_date FROM a3 GROUP BY symbol),
own AS (SELECT symbol, min(sess) AS oldest, max(sess) AS last FROM a0 GROUP BY 1), rt AS (SELECT symbol, sess, round(close / lag(close) OVER (PARTITION BY symbol ORDER BY sess) - 1, 6) + 0.0 AS ret FROM a0),
path AS (SELECT symbol, list(coalesce(ret, 0.0) ORDER BY c.sess) AS path FROM own JOIN z ON last > newest - 250 AND last > own.oldest JOIN cal c ON c.sess > newest - 250 AND c.sess > own.oldest LEFT JOIN rt USING (symbol, sess) GROUP BY symbol HAVING count(*) >= 100),
dup AS (SELECT symbol, row_number() OVER (PARTITION BY path ORDER BY symbol) > 1 AS again FROM path),
fl AS (SELECT ag.*, coalesce(run, 0) >= 8 AS stale, coalesce(again, FALSE) AS duplicate FROM ag LEFT JOIN run USING (symbol) LEFT JOIN dup USING (symbol)),
rp AS (SELECT *, {_SEVERITY} AS severity FROM fl)"""

_DETECT = f"{sql.WEEK}, {_FLAGS}"
#: Quiet bars on the sessions of the supplier bars, in exact binary fractions, and one kind of fault for each remainder of the symbol.
_FAULTY = f"""{sql.WEEK.replace(' w AS (', ' w0 AS (').replace(chr(10) + 'w AS (', chr(10) + 'w0 AS (')},
q0 AS (SELECT symbol, grp, date, sess, symbol % 16 AS kind, 100 + ((CASE WHEN symbol % 16 = 3 AND sess BETWEEN 150 AND 175 THEN 150 ELSE sess END * 37 + symbol * 11) % 17) / 8.0::DOUBLE AS c FROM w0),
q1 AS (SELECT symbol, grp, date, sess, kind, c / CASE WHEN kind = 1 AND sess >= 200 THEN 4.0 ELSE 1.0 END::DOUBLE * CASE WHEN kind = 2 AND sess = 250 THEN 2.0 WHEN kind = 10 AND sess % 60 = 0 THEN 32.0 ELSE 1.0 END::DOUBLE AS close FROM q0 WHERE NOT (kind = 6 AND sess > 340) AND NOT (kind = 11 AND sess % 7 <> 0)),
q2 AS (SELECT symbol, grp, date, sess, close, close AS open, CASE WHEN kind = 5 AND sess % 2 = 0 THEN close WHEN kind = 12 AND sess % 3 = 0 THEN close - 1 ELSE close + 0.25::DOUBLE END AS high, CASE WHEN kind = 5 AND sess % 2 = 0 THEN close ELSE close - 0.25::DOUBLE END AS low,
CASE WHEN kind = 4 AND sess % 3 = 0 THEN 0.0 WHEN kind = 7 THEN 16.0 ELSE 32768.0 END::DOUBLE AS volume FROM q1),
w AS (SELECT * FROM q2 UNION ALL SELECT symbol + 100000, * EXCLUDE (symbol) FROM q2 WHERE symbol % 16 = 8)"""


def faulty(spark: SparkSession, d: str) -> DataFrame:
    rows = week(spark, d)
    kind, sess = F.col("symbol") % 16, F.col("sess")
    still = F.when((kind == 3) & sess.between(150, 175), 150).otherwise(sess)
    c = 100 + F.pmod(still * 37 + F.col("symbol") * 11, F.lit(17)) / 8.0
    c = c / F.when((kind == 1) & (sess >= 200), 4.0).otherwise(1.0) * F.when((kind == 2) & (sess == 250), 2.0).when((kind == 10) & (sess % 60 == 0), 32.0).otherwise(1.0)
    rows = rows.where(~((kind == 6) & (sess > 340)) & ~((kind == 11) & (sess % 7 != 0))).withColumn("close", c)
    close, flat = F.col("close"), (kind == 5) & (sess % 2 == 0)
    rows = rows.withColumns(
        {
            "open": close,
            "high": F.when(flat, close).when((kind == 12) & (sess % 3 == 0), close - 1).otherwise(close + 0.25),
            "low": F.when(flat, close).otherwise(close - 0.25),
            "volume": F.when((kind == 4) & (sess % 3 == 0), 0.0).when(kind == 7, 16.0).otherwise(32768.0),
        }
    )
    return rows.unionByName(rows.where("symbol % 16 = 8").withColumn("symbol", F.col("symbol") + 100000))


@query(f"{_DETECT} SELECT *, severity >= {anomalies.QUARANTINE_AT} AS quarantine FROM rp")
def anomalies_report(spark: SparkSession, d: str) -> DataFrame:
    found = anomalies.detect(week(spark, d))
    return found.withColumn("dollar_volume", F.round("dollar_volume", 3) + 0.0)


@query(f"{_FAULTY}, {_FLAGS} SELECT *, severity >= {anomalies.QUARANTINE_AT} AS quarantine FROM rp")
def injected_faults(spark: SparkSession, d: str) -> DataFrame:
    """Every flag rises for some symbols and not for others."""
    found = anomalies.detect(faulty(spark, d))
    return found.withColumn("dollar_volume", F.round("dollar_volume", 3) + 0.0)


@query(f"{_FAULTY}, {_FLAGS} SELECT date, count(*) AS n, min(symbol) AS least FROM w WHERE symbol NOT IN (SELECT symbol FROM rp WHERE severity >= {anomalies.QUARANTINE_AT}) GROUP BY date")
def quarantined_bars(spark: SparkSession, d: str) -> DataFrame:
    rows = faulty(spark, d)
    return anomalies.apply_quarantine(rows, anomalies.detect(rows)).groupBy("date").agg(F.count("*").alias("n"), F.min("symbol").alias("least"))


@query(
    f"""{_FAULTY}, q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM w WHERE close > 0 AND high >= low), wild AS (SELECT symbol FROM q WHERE move > 9 OR move < -0.9 GROUP BY symbol HAVING count(*) >= 3),
sp AS (SELECT symbol, count(*) AS n, (max(date) - min(date)) * 252 / 365.0 AS expected FROM q ANTI JOIN wild USING (symbol) GROUP BY symbol HAVING n >= expected * (1 - 0.9) OR expected < 60) SELECT symbol, n FROM sp"""
)
def plausible_bars(spark: SparkSession, d: str) -> DataFrame:
    """Weekly bars are a fifth of the days of their span, so the gaps allowed are wider than for daily ones."""
    return ingest.quality_filter(faulty(spark, d), 0.9).groupBy("symbol").agg(F.count("*").alias("n"))



_COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS symbols, CAST({w} AS DOUBLE) AS severity FROM rp" for f, w in anomalies.SEVERITY.items())


@query(f"{_DETECT} {_COUNTS}")
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.summary(anomalies.detect(week(spark, d)))


@query(f"{_DETECT}, {sql.features(sql.WEEK).split('w AS (', 1)[1].split('),' + chr(10), 1)[1]}, {_REB} SELECT date, count(*) AS n FROM f SEMI JOIN reb USING (date) WHERE coalesce(dollar_vol, 0) >= 1000 AND symbol NOT IN (SELECT symbol FROM rp WHERE severity >= {anomalies.QUARANTINE_AT}) GROUP BY date")
def quarantined_panel(spark: SparkSession, d: str) -> DataFrame:
    return anomalies.apply_quarantine(panel(spark, d, plain=True), anomalies.detect(week(spark, d))).groupBy("date").agg(F.count("*").alias("n"))


@query(
    f"""{sql.DAY}, q AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM w WHERE close > 0 AND high >= low), wild AS (SELECT symbol FROM q WHERE move > 9 OR move < -0.9 GROUP BY symbol HAVING count(*) >= 3),
sp AS (SELECT symbol, count(*) AS n, (max(date) - min(date)) * 252 / 365.0 AS expected FROM q ANTI JOIN wild USING (symbol) GROUP BY symbol HAVING n >= expected * 0.65 OR expected < 60) SELECT symbol, n FROM sp"""
)
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    return ingest.quality_filter(bars.brand_day(spark, d)).groupBy("symbol").agg(F.count("*").alias("n"))


# ---- ingest ---------------------------------------------------------------------------------------


def _old(rows: DataFrame) -> DataFrame:
    return rows.where("date < '2000-01-01'")


def _new(rows: DataFrame) -> DataFrame:
    """Later bars, some days of overlap, at another price level."""
    rows = rows.where("date >= '1999-11-01'")
    return rows.withColumns({c: F.col(c) * 1.25 for c in ("open", "high", "low", "close")})


@query(f"{sql.WEEK} SELECT symbol, date, CASE WHEN date >= DATE '1999-11-01' THEN close * 1.25::DOUBLE ELSE close END AS close FROM w")
def upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.supplier_week(spark, d)
    return ingest.upsert(_old(rows), _new(rows), ["symbol", "date"]).select("symbol", "date", "close")


_SPLICE = f"""{sql.WEEK}, old AS (SELECT * FROM w WHERE date < DATE '2000-01-01'), nw AS (SELECT symbol, date, close * 1.25::DOUBLE AS close FROM w WHERE date >= DATE '1999-11-01'),
com AS (SELECT nw.symbol, arg_max(old.close / nw.close, date) AS f FROM nw JOIN old USING (symbol, date) GROUP BY 1), newest AS (SELECT symbol, max(date) AS m FROM old GROUP BY 1)
SELECT nw.symbol, date, nw.close * coalesce(CASE WHEN f > 0.2 AND f < 5 THEN f END, 1) AS close FROM nw LEFT JOIN com USING (symbol) LEFT JOIN newest USING (symbol) WHERE m IS NULL OR date > m"""


@query(_SPLICE)
def splice(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.supplier_week(spark, d)
    return ingest.splice(_new(rows), _old(rows)).select("symbol", "date", "close")


@query(
    f"""{sql.WEEK}, k AS (SELECT symbol, max(date) AS last, count(*) AS n FROM w WHERE symbol % 4 <> 0 GROUP BY symbol), u AS (SELECT s_suppkey AS symbol FROM supplier)
SELECT symbol, CASE WHEN last IS NULL OR DATE '2001-11-05' - last > 30 OR (n < 290 AND symbol % 2 = 0) THEN 'full' ELSE 'recent' END AS plan FROM u LEFT JOIN k USING (symbol)"""
)
def plan_downloads(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.supplier_week(spark, d)
    asked = rows.where("symbol % 2 = 1").select("symbol", F.lit("2001-11-01").cast("date").alias("asked_on")).distinct()
    listed = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return ingest.plan_downloads(listed, rows.where("symbol % 4 <> 0"), asked, "2001-11-05", short_rows=290)


@query(
    """SELECT coalesce(f.symbol, a.symbol) AS symbol, coalesce(since, DATE '2024-02-01') AS since, CAST(coalesce(failures, 0) + CASE WHEN a.symbol IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS failures
FROM (SELECT s_suppkey AS symbol, DATE '2024-01-15' AS since, 2 AS failures FROM supplier WHERE s_suppkey % 3 = 0) f FULL JOIN (SELECT s_suppkey AS symbol FROM supplier WHERE s_suppkey % 2 = 0) a ON f.symbol = a.symbol
WHERE a.symbol IS NULL OR a.symbol % 5 <> 0"""
)
def count_failures(spark: SparkSession, d: str) -> DataFrame:
    s = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    failed = s.where("symbol % 3 = 0").select("symbol", F.lit("2024-01-15").cast("date").alias("since"), F.lit(2).alias("failures"))
    asked = s.where("symbol % 2 = 0")
    return ingest.count_failures(failed, asked, asked.where("symbol % 5 = 0"), "2024-02-01")


@query(f"{sql.WEEK}, gone AS (SELECT count(*) FILTER (symbol % 7 = 0) / CAST(count(*) AS DOUBLE) AS g FROM (SELECT DISTINCT symbol FROM w)) SELECT symbol, count(*) AS n FROM w, gone WHERE symbol % 7 <> 0 OR g > 0.2 GROUP BY symbol")
def prune(spark: SparkSession, d: str) -> DataFrame:
    listed = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")).where("symbol % 7 <> 0")
    return ingest.prune(bars.supplier_week(spark, d), listed).groupBy("symbol").agg(F.count("*").alias("n"))


@query(f"{sql.WEEK} SELECT symbol, count(*) AS n FROM w WHERE symbol % 2 = 1 OR date >= DATE '1999-11-01' GROUP BY symbol")
def replace_refreshed(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.supplier_week(spark, d)
    return ingest.replace_refreshed(rows, _new(rows).where("symbol % 2 = 0")).groupBy("symbol").agg(F.count("*").alias("n"))


@query(
    f"""{sql.DAY}, n AS (SELECT date, count(DISTINCT symbol) AS symbols FROM w WHERE isodow(date) < 6 GROUP BY 1), m AS (SELECT *, quantile_cont(symbols, 0.5) OVER (ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS usual FROM n)
SELECT date, symbols, usual, round(symbols * 100 / CAST((SELECT count(DISTINCT p_brand) FROM part) AS DOUBLE), 4) + 0.0 AS pct FROM m WHERE date = (SELECT max(date) FROM m)"""
)
def session_coverage(spark: SparkSession, d: str) -> DataFrame:
    listed = bars.table(spark, d, "part").select(F.col("p_brand").alias("symbol")).distinct()
    return rounded(ingest.coverage_of_last_session(bars.brand_day(spark, d), listed), {"pct": 4}, "date", "symbols", "usual")


@query("SELECT c_custkey AS id, CASE WHEN length(code) > 6 OR code LIKE '%/%' THEN NULL ELSE lower(replace(code, '-', '.')) || '.us' END AS reserve FROM (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'A/B' WHEN c_custkey % 3 = 0 THEN 'BRK-B' ELSE 'X' || c_custkey * 100 END AS code FROM customer)")
def reserve_symbols(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    code = F.when(k % 5 == 0, "A/B").when(k % 3 == 0, "BRK-B").otherwise(F.concat(F.lit("X"), (k * 100).cast("string")))
    return bars.table(spark, d, "customer").select(k.alias("id"), universe.reserve_symbol(code).alias("reserve"))


@query("SELECT p_partkey AS id, upper(split_part(p_name, ' ', 1)) IN ('SH', 'DOG') OR regexp_matches(p_name || ' 2x long', '(?i)inverse|leveraged|vix') OR p_partkey % 2 = 0 AS wrapper FROM part")
def wrappers(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(" 2x long")).otherwise(F.lit(" 10x Genomics")))
    return bars.table(spark, d, "part").select(F.col("p_partkey").alias("id"), universe.is_wrapper(name, F.split("p_name", " ")[0]).alias("wrapper"))


@query("SELECT symbol, arg_min(name, pr) AS name, arg_min(grp, pr) AS grp FROM (SELECT s_suppkey AS symbol, s_name AS name, 'equity_us' AS grp, 1 AS pr FROM supplier UNION ALL SELECT c_custkey, c_name, 'crypto', 3 FROM customer) GROUP BY symbol")
def build_universe(spark: SparkSession, d: str) -> DataFrame:
    us = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.lit("equity_us").alias("grp"))
    coins = bars.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.lit("crypto").alias("grp"))
    return universe.build({"us": us, "crypto": coins})[0].select("symbol", "name", "grp")


@query("SELECT s_nationkey::BIGINT AS page_id, 'S' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.L' ELSE '.PA' END AS symbol, CASE WHEN s_suppkey % 3 = 0 THEN 'GBP' ELSE 'EUR' END AS currency FROM supplier WHERE length('S' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.L' ELSE '' END) <= 8")
def html_tickers(spark: SparkSession, d: str) -> DataFrame:
    """A page for each nation, with a table of too few columns before that of its suppliers."""
    cell = F.concat(F.lit("<tr><td>"), F.col("s_name"), F.lit("</td><td> s "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, ".l").otherwise(""), F.lit("</td></tr>"))
    rows = bars.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("page_id")).agg(F.concat_ws("", F.collect_list(cell)).alias("rows"))  # suppliers of a nation
    html = F.concat(F.lit("<p>x</p><table><tr><th>Name</th></tr><tr><td>n</td></tr></table><table><tr><th>Name</th><th>Ticker</th></tr>"), F.col("rows"), F.lit("</table>"))
    return html_tables.ticker_rows(rows.withColumn("html", html), suffix=".PA", least_rows=1)


@query(
    "SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS date, round(arg_max(o_totalprice, o_orderkey), 2) + 0.0 AS close FROM orders GROUP BY 1, 2"
)
def clean_store(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.table(spark, d, "orders").select(F.col("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return rounded(store.clean(rows, "o_orderkey"), {"close": 2}, "symbol", "date")


# ---- portfolio and report -------------------------------------------------------------------------


@query(f"{sql.WEEK} SELECT symbol, round(median(close * volume), 3) + 0.0 AS liquidity FROM w WHERE sess > (SELECT max(sess) FROM w) - 63 GROUP BY symbol")
def median_liquidity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.median_liquidity(week(spark, d)), {"liquidity": 3}, "symbol")


@query(f"{sql.WEEK}, {_RETURNS} SELECT symbol, round(stddev_samp(x) FILTER (sess > (SELECT max(sess) FROM w) - 252) * sqrt(252), 6) + 0.0 AS vol FROM lr GROUP BY symbol")
def annual_volatility(spark: SparkSession, d: str) -> DataFrame:
    return rounded(portfolio.annual_volatility(week(spark, d)), {"vol": 6}, "symbol")


@query("SELECT grp, round(CASE WHEN grp = 'etf' THEN 0.0 ELSE 1.8 END::DOUBLE, 4) + 0.0 AS fee, round(coalesce(bps, 15) / 2e4, 8) + 0.0 AS half, round(CASE WHEN grp = 'etf' THEN 0.0 ELSE 1.8 END / 500 + coalesce(bps, 15) / 2e4, 8) + 0.0 AS cost FROM (VALUES ('equity_us', 10), ('etf', 10), ('crypto', 190), ('other', NULL)) AS t(grp, bps)")
def broker_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.createDataFrame([("equity_us",), ("etf",), ("crypto",), ("other",)], "grp string")
    g = F.col("grp")
    rows = rows.withColumns({"fee": portfolio.fee("etoro", g), "half": portfolio.half_spread("etoro", g), "cost": portfolio.cost_per_euro("etoro", g, F.lit(500.0))})
    return rounded(rows, {"fee": 4, "half": 8, "cost": 8}, "grp")


_FX = "fx AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, CASE WHEN c_nationkey % 2 = 0 THEN 'USD' ELSE 'GBP' END AS currency, avg(o_totalprice) / 1e5 AS rate FROM orders JOIN customer ON c_custkey = o_custkey WHERE month(o_orderdate) % 3 = 0 GROUP BY 1, 2)"


@query(f"{sql.WEEK}, {_FX} SELECT d.date, c.currency, round(fx.rate, 6) + 0.0 AS rate FROM (SELECT DISTINCT date FROM w) d CROSS JOIN (SELECT DISTINCT currency FROM fx) c ASOF LEFT JOIN fx ON c.currency = fx.currency AND d.date >= fx.date")
def rates_as_of(spark: SparkSession, d: str) -> DataFrame:
    orders = bars.table(spark, d, "orders").where(F.month("o_orderdate") % 3 == 0).join(bars.table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rates = orders.groupBy(F.to_date(F.date_trunc("week", "o_orderdate")).alias("date"), F.when(F.col("c_nationkey") % 2 == 0, "USD").otherwise("GBP").alias("currency")).agg((F.avg("o_totalprice") / 1e5).alias("rate"))
    return rounded(portfolio.rates_as_of(bars.supplier_week(spark, d), rates), {"rate": 6}, "date", "currency")


@query(f"{sql.WEEK} SELECT date, coalesce(lag(date) OVER (ORDER BY date) IS NULL OR date_trunc('month', lag(date) OVER (ORDER BY date)) <> date_trunc('month', date), TRUE) AS due FROM cal")
def rebalance_due(spark: SparkSession, d: str) -> DataFrame:
    days = calendar.next_session(bars.supplier_week(spark, d)).select(F.col("date").alias("last"), F.col("next_date").alias("date")).where("date is not null")
    first = calendar.calendar(bars.supplier_week(spark, d)).where("sess = 1").select(F.lit(None).cast("date").alias("last"), "date")
    return days.unionByName(first).select("date", portfolio.due(F.col("last"), F.col("date"), "month").alias("due"))


def _alphas(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    ics = spark.createDataFrame([(h, g, 0.05) for h in ("short", "medium") for g in ("ASIA", "AMERICA", "MIDDLE EAST")], "horizon string, grp string, ic_mean double")
    rows = week(spark, d)
    scores = shared.saved(scored(spark, d, plain, rows).select("date", "symbol", "grp", "score_short", "score_medium"), "scores")  # read for the last date and for its rows
    return portfolio.expected_alpha(scores, ics, rows, {"short": 0.5, "medium": 0.5})


def _alpha_part(h: str, days: int) -> str:
    return f"coalesce(CASE WHEN count(score_{h}) OVER (PARTITION BY grp) >= 5 THEN CASE WHEN grp IN ('ASIA', 'AMERICA', 'MIDDLE EAST') THEN 0.05 ELSE 0 END * (score_{h} - avg(score_{h}) OVER (PARTITION BY grp)) / CASE WHEN coalesce(stddev_pop(score_{h}) OVER (PARTITION BY grp), 0) = 0 THEN 1 ELSE stddev_pop(score_{h}) OVER (PARTITION BY grp) END * coalesce(vol, 0.25) * sqrt({days} / 252.0) * 0.5 END, 0)"


_ALPHA = f"{_SCORED}, {_RETURNS}, vo AS (SELECT symbol, stddev_samp(x) * sqrt(252) AS vol FROM lr WHERE sess > (SELECT max(sess) FROM w) - 252 GROUP BY symbol), al AS (SELECT symbol, {_alpha_part('short', 10)} + {_alpha_part('medium', 63)} AS alpha FROM s LEFT JOIN vo USING (symbol) WHERE date = (SELECT max(date) FROM s))"


@scores_query(f"{_ALPHA} SELECT symbol, round(alpha, 5) + 0.0 AS alpha FROM al")
def expected_alpha(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return rounded(_alphas(spark, d, plain), {"alpha": 5}, "symbol")


_CHEAP = "the candidate does not beat the cost of the change"


def _cost(group: str, amount: str) -> str:
    """Costs of an order of the first broker for each euro; the regions are no groups that it knows."""
    return f"CASE WHEN {amount} <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE / {amount} + 15 / 2e4::DOUBLE END"


_PLANNED = f"""{_ALPHA}, ta AS (SELECT symbol, greatest(coalesce(alpha, 0), 0) AS a FROM (SELECT * FROM al ORDER BY alpha DESC, symbol LIMIT 15)),
tr AS (SELECT *, CASE WHEN sum(a) OVER () > 0 THEN least(greatest(a / sum(a) OVER (), 0.5 / count(*) OVER ()), 2.0 / count(*) OVER ()) ELSE 1.0 / count(*) OVER () END AS raw FROM ta), tw AS (SELECT symbol, a, raw / sum(raw) OVER () AS weight FROM tr),
he AS (SELECT s_suppkey AS symbol, abs(s_acctbal) + 100 AS cost FROM supplier WHERE s_suppkey % 9 = 0),
bo AS (SELECT symbol, coalesce(al.alpha, 0) AS alpha, weight, cost, coalesce(cost, 0) AS now, weight * 40000 AS aim, (SELECT max(a) FROM tw) AS best, (SELECT count(*) FROM he) AS held FROM he FULL JOIN tw USING (symbol) LEFT JOIN al USING (symbol)),
pd AS (SELECT *, 2 * ({_cost('g', 'now')}) AS leave, {_cost('g', 'aim')} AS enter, coalesce(cost > 0, FALSE) AS owned FROM bo),
pl AS (SELECT *, CASE WHEN weight IS NULL AND coalesce(best, 0) - alpha < 1.5 * leave THEN '{_CHEAP}' WHEN weight IS NULL THEN 'order' WHEN owned AND abs(aim - now) < 0.25 * greatest(now, 1) THEN 'inside the band'
WHEN owned AND abs(aim - now) < 1000 THEN 'adjustment below the least amount' WHEN owned AND aim < now THEN 'reductions run on' WHEN owned THEN 'order' WHEN aim < 1000 THEN 'too small for its commission' WHEN held > 0 AND alpha < 1.5 * enter THEN 'alpha below the cost of entry' ELSE 'order' END AS decision FROM pd)"""


@query(
    f"""{_PLANNED} SELECT symbol, CASE WHEN weight IS NULL THEN 'sale' ELSE 'purchase' END AS side, round(CASE WHEN weight IS NULL THEN now WHEN owned THEN abs(aim - now) ELSE aim END, 2) AS amount, decision,
round(CASE WHEN decision = '{_CHEAP}' THEN leave * now WHEN decision IN ('adjustment below the least amount', 'too small for its commission') THEN 1.0::DOUBLE WHEN decision = 'alpha below the cost of entry' THEN enter * aim END, 2) AS avoided FROM pl""".replace(_SCORED, _ALL_SCORED)
)
def plan_orders(spark: SparkSession, d: str) -> DataFrame:
    alphas = shared.saved(_alphas(spark, d), "alphas")  # of every symbol: what is held may stand anywhere in the ranking
    held = bars.table(spark, d, "supplier").where("s_suppkey % 9 = 0").select(F.col("s_suppkey").alias("symbol"), (F.abs("s_acctbal") + 100).alias("cost"))
    groups = bars.supplier_region(spark, d)
    return portfolio.plan_orders(held, alphas.orderBy(F.desc("alpha"), "symbol").limit(15).select("symbol"), alphas, groups, 40000.0, "trade_republic")


@query()
def execute_orders(spark: SparkSession, d: str) -> DataFrame:
    plan = plan_orders(spark, d).where("decision = 'order'")
    last = calendar.with_sessions(bars.supplier_week(spark, d)).groupBy("symbol").agg(F.max_by("open", "sess").alias("price"))
    orders = plan.join(last, "symbol", "left").crossJoin(F.broadcast(portfolio.books(spark))).withColumns(  # a row for each book
        {"units_held": F.when(F.col("side") == "sale", F.try_divide("amount", "price")).otherwise(0.0), "fee": F.lit(1.0), "half_spread": F.lit(0.00075), "turn": F.col("symbol")}
    )
    return portfolio.execute(orders, portfolio.books(spark).withColumn("cash", F.lit(5000.0)))


@scores_query(
    f"""{_SCORED} SELECT grp, count(DISTINCT s_suppkey) AS universe, count(DISTINCT b.symbol) AS priced, count(DISTINCT x.symbol) AS in_panel, count(DISTINCT y.symbol) AS scored FROM (SELECT s_suppkey, r_name AS grp FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)
LEFT JOIN (SELECT DISTINCT symbol FROM w) b ON b.symbol = s_suppkey LEFT JOIN (SELECT DISTINCT symbol FROM p) x ON x.symbol = s_suppkey LEFT JOIN (SELECT DISTINCT symbol FROM s WHERE score_medium IS NOT NULL) y ON y.symbol = s_suppkey GROUP BY grp"""
)
def funnel(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    rows = panel(spark, d, plain)
    return report.funnel(bars.supplier_region(spark, d), bars.supplier_week(spark, d), rows, scoring.score_panel(rows, weights_of(plain)).where("score_medium is not null"))


@query("SELECT CAST(i AS INTEGER) AS bin, (SELECT count(*) FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) WHERE least(CAST(floor((c_acctbal - lo) / ((hi - lo) / 24)) AS INTEGER), 23) = i) AS n FROM range(24) AS t(i)")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return report.histogram(bars.table(spark, d, "customer"), "c_acctbal").select("bin", "n")


@query(f"{sql.WEEK}, t AS (SELECT max(date) AS top FROM w) SELECT symbol AS key, round(arg_max(close, date) / arg_min(close, date) * 100 - 100, 5) + 0.0 AS pct FROM w, t WHERE date >= top - 90 GROUP BY symbol HAVING count(*) >= 2")
def period_returns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(report.period_returns(bars.supplier_week(spark, d).select(F.col("symbol").alias("key"), "date", F.col("close").alias("value")), 90), {"pct": 5}, "key")


@query(
    f"""{sql.WEEK}, k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY sess) AS place, close, min(close) OVER (PARTITION BY symbol) AS low, max(close) OVER (PARTITION BY symbol) AS high FROM w WHERE sess > (SELECT max(sess) FROM w) - 252)
SELECT symbol, CAST(place AS INTEGER) AS place, round(coalesce((close - low) / nullif(high - low, 0), 0.5), 6) + 0.0 AS point FROM k"""
)
def sparklines(spark: SparkSession, d: str) -> DataFrame:
    """The points of each line, a row for each."""
    rows = report.sparkline(week(spark, d)).select("symbol", F.posexplode("points").alias("place", "point"))
    return rows.select("symbol", (F.col("place") + 1).alias("place"), (F.round("point", 6) + 0.0).alias("point"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{x}{chr(39)}, {chr(39)}{g}{chr(39)})' for g, names in feeds.MACRO.items() for x in names.split())}) AS t(symbol, grp)")
def macro_universe(spark: SparkSession, d: str) -> DataFrame:
    return feeds.macro(spark).select("symbol", "grp")


@query("SELECT grp FROM (VALUES ('equity_us'), ('equity_eu'), ('etf'), ('crypto'), ('commodity'), ('fx'), ('index'), ('bond')) AS t(grp) WHERE grp NOT IN (SELECT 'equity_us' FROM supplier UNION SELECT 'crypto' FROM customer)")
def missing_groups(spark: SparkSession, d: str) -> DataFrame:
    us = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.lit("equity_us").alias("grp"))
    coins = bars.table(spark, d, "customer").select(F.col("c_custkey").alias("symbol"), F.col("c_name").alias("name"), F.lit("crypto").alias("grp"))
    return universe.build({"us": us, "crypto": coins})[1]


@query(
    f"""{sql.WEEK}, n AS (SELECT * FROM w WHERE symbol % 3 <> 0 AND date >= DATE '2001-06-01') SELECT (SELECT count(DISTINCT s_suppkey) FROM supplier) AS asked, (SELECT count(DISTINCT symbol) FROM n) AS answered, (SELECT count(*) FROM n) AS rows,
(SELECT max(date) FROM n) AS newest, (SELECT max(date) FROM w WHERE date < DATE '2001-08-01') AS newest_before, CASE WHEN (SELECT count(*) FROM n) = 0 THEN 'nothing' WHEN (SELECT count(DISTINCT symbol) FROM n) < 0.5 * (SELECT count(DISTINCT s_suppkey) FROM supplier) THEN 'few answers' ELSE 'ok' END AS verdict"""
)
def download_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.supplier_week(spark, d)
    asked = bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"))
    return ingest.download_summary(rows.where("symbol % 3 <> 0 and date >= '2001-06-01'"), asked, rows.where("date < '2001-08-01'"))


@query("SELECT o_orderkey, try_cast(split_part(o_orderpriority, '-', 1) AS FLOAT) AS close, try_cast(o_orderpriority AS FLOAT) AS volume, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS date FROM orders")
def coerced(spark: SparkSession, d: str) -> DataFrame:
    rows = bars.table(spark, d, "orders").select("o_orderkey", F.split("o_orderpriority", "-")[0].alias("close"), F.col("o_orderpriority").alias("volume"), F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("no date").alias("date"))
    return store.coerce(rows)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, event_type = 'error' AND CAST(json_extract(props, '$.k') AS INTEGER) > 3 AS loud FROM events")
def event_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return bars.table(spark, d, "events").select("event_id", k.alias("k"), ((F.col("event_type") == "error") & (k > 3)).alias("loud"))


@scores_query(f"{_SCORED}, {_FLAGS} SELECT max(date) AS date, count(*) AS analysed, count(DISTINCT grp) AS groups, (SELECT count(*) FROM supplier) AS universe, (SELECT count(*) FROM rp WHERE severity >= {anomalies.QUARANTINE_AT}) AS quarantined FROM s WHERE date = (SELECT max(date) FROM s)")
def kpi_tiles(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    return report.tiles(scored(spark, d, plain), bars.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol")), anomalies.detect(week(spark, d)))


_SHOWN = ("ret_1m", "ret_3m", "ret_12m", "vol_252")


@scores_query(
    f"""{_SCORED} SELECT s.symbol, round(score_medium, 4) + 0.0 AS score_medium, {', '.join(f'round(CAST(CAST(x.{c} AS FLOAT) AS DOUBLE), 4) + 0.0 AS {c}' for c in _SHOWN)} FROM s LEFT JOIN (SELECT * FROM f WHERE date = (SELECT max(date) FROM p) AND coalesce(dollar_vol, 0) >= 1000) x USING (symbol) WHERE s.date = (SELECT max(date) FROM s)"""
)
def report_rows(spark: SparkSession, d: str, plain: bool = False) -> DataFrame:
    rows = panel(spark, d, plain)
    shown = report.report_rows(scoring.score_panel(rows, weights_of(plain)), rows).withColumns({c: F.col(c).cast("double") for c in _SHOWN})
    return rounded(shown, {"score_medium": 4} | {c: 4 for c in _SHOWN}, "symbol")


@query(
    f"""{sql.WEEK}, b AS (SELECT date AS bought, open FROM w WHERE symbol = 3 AND date = (SELECT min(date) FROM w WHERE date > DATE '1998-01-05')), v AS (SELECT c.date, coalesce((40000.0::DOUBLE - 1) / (open * (1 + 8 / 2e4::DOUBLE)) * close, 40000.0) AS value FROM cal c JOIN b ON c.date >= bought LEFT JOIN (SELECT date, close FROM w WHERE symbol = 3) USING (date))
SELECT date, round(round(value, 2), 0) + 0.0 AS value FROM v"""
)
def benchmark_book(spark: SparkSession, d: str) -> DataFrame:
    return rounded(simulation.benchmark(bars.supplier_week(spark, d), "1998-01-05", 3), {"value": 0}, "date")


@query()
def chosen_portfolio(spark: SparkSession, d: str) -> DataFrame:
    """place, symbol: by quotas of two horizons from the brands that are scored; the long one has no scores yet, and is filled up."""
    rows = month(spark, d)
    scores = scoring.score_panel(features.sample_panel(features.build_features(rows), calendar.rebalance_dates(rows), 0.0)).where("score_short is not null")
    names = simulation.select(scores, spark.createDataFrame([], "symbol string"), rows, 8, {"short": 0.75, "long": 0.25})
    return spark.createDataFrame(list(enumerate(names)), "place int, symbol string")


@query()
def simulated_days(spark: SparkSession, d: str) -> DataFrame:
    """The curve of two weeks of every book, bought from a fixed list."""
    rows = bars.supplier_week(spark, d).withColumn("symbol", F.col("symbol").cast("string"))
    groups = bars.supplier_region(spark, d).select(F.col("symbol").cast("string").alias("symbol"), "grp")
    folder, names = stream.work_dir(spark), [str(k) for k in range(1, 9)]
    alphas = spark.createDataFrame([(s, 0.05 + 0.01 * k) for k, s in enumerate(names)], "symbol string, alpha double")
    for day in ("1998-01-05", "1998-01-12", "1998-01-19"):
        past = rows.where(F.col("date") <= day)
        simulation.step(spark, folder, day, past, groups, {s: names for s in portfolio.SCENARIOS}, {s: alphas for s in portfolio.SCENARIOS})
    return simulation.ledger(spark, folder, "curve")


# ---- streams --------------------------------------------------------------------------------------


@query(
    """SELECT user_id AS symbol, date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS "end", round(arg_min(value, ROW(ts, event_id)), 4) + 0.0 AS open, round(max(value), 4) + 0.0 AS high, round(min(value), 4) + 0.0 AS low,
round(arg_max(value, ROW(ts, event_id)), 4) + 0.0 AS close, count(*) AS volume FROM events GROUP BY 1, 2, 3 HAVING "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_tick_bars(spark: SparkSession, d: str) -> DataFrame:
    out = stream.run_to_table(stream.tick_bars(stream.ticks(spark, d)))
    return rounded(out, {"open": 4, "high": 4, "low": 4, "close": 4}, "symbol", "start", "end", "volume")


# Of equal times at a pause no session is parted: the next event opens one only after six whole hours.
@query(
    """WITH e AS (SELECT user_id AS symbol, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR, TRUE) AS opens FROM events),
n AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM e)
SELECT symbol, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS events FROM n GROUP BY symbol, run HAVING "end" <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)"""
)
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_to_table(stream.session_activity(stream.ticks(spark, d)))


@query(
    """SELECT user_id AS symbol, CAST(count(*) FILTER (rn > coalesce(ok, 0)) AS INTEGER) AS failures FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) JOIN
(SELECT user_id AS u, max(rn) FILTER (event_type <> 'error') AS ok FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) GROUP BY 1) ON u = user_id GROUP BY 1"""
)
def stream_failures(spark: SparkSession, d: str) -> DataFrame:
    return stream.run_counters(stream.ticks(spark, d)).select("symbol", "failures")


# ---- flagship -------------------------------------------------------------------------------------


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Monthly bars of brands to a ranking: windows, cross-sectional scores, percentiles, the best of the last month with scores."""
    rows = month(spark, d)
    panel_ = features.sample_panel(features.build_features(rows), calendar.rebalance_dates(rows), 0.0)
    return scoring.top_picks(scoring.score_panel(panel_).where("score_short is not null"), "short", 10).select("date", "symbol", "score_short", "pct_short")


from barline.plans import desk  # noqa: E402, F401  registers its queries here
