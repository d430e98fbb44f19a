"""Aggregates behind the report, and its page."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def funnel(universe: DataFrame, bars: DataFrame, panel: DataFrame, scored: DataFrame) -> DataFrame:
    """grp and the number of symbols in the universe, with prices, in the panel, and scored; 0 where none."""
    steps = {"universe": universe, "priced": bars, "in_panel": panel, "scored": scored}
    out = None
    for name, rows in steps.items():
        n = rows.where("grp is not null").groupBy("grp").agg(F.countDistinct("symbol").alias(name))
        out = n if out is None else out.join(n, "grp", "full_outer")
    return out.na.fill(0)


def histogram(rows: DataFrame, value: str, bins: int = 24, least: int = 20) -> DataFrame:
    """bin (from 0), low, high, n: bins of equal width from the least to the largest value; empty if there are few values."""
    x = rows.select(F.col(value).cast("double").alias("x")).where("x is not null and not isnan(x)")
    span = x.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("size")).where(F.col("size") >= least)
    width = (F.col("high") - F.col("low")) / bins
    rows = x.join(F.broadcast(span)).withColumn("bin", F.coalesce(F.least(F.floor(F.try_divide(F.col("x") - F.col("low"), width)), F.lit(bins - 1)), F.lit(0)).cast("int"))  # one row
    counted = rows.groupBy("bin").agg(F.count("*").alias("n"))
    every = span.select("low", width.alias("width"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("low"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def sparkline(bars: DataFrame, sessions: int = 252) -> DataFrame:
    """symbol, points: closes of the last sessions in order, scaled to 0 to 1."""
    top = bars.agg(F.max("sess").alias("top"))
    rows = bars.join(F.broadcast(top), F.col("sess") > F.col("top") - sessions).groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("sess", "close"))).alias("p"), F.min("close").alias("low"), F.max("close").alias("high"))
    return rows.select("symbol", F.transform("p", lambda x: F.coalesce(F.try_divide(x["close"] - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))).alias("points"))


def period_returns(curve: DataFrame, days: int) -> DataFrame:
    """key, first, last, pct: return over the last natural days of each curve (key, date, value); two points at least."""
    top = curve.agg(F.max("date").alias("top"))
    rows = curve.join(F.broadcast(top), F.col("date") >= F.date_sub("top", days))
    both = rows.groupBy("key").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.count("*").alias("n")).where("n >= 2")
    return both.select("key", "first", "last", (F.try_divide("last", "first") * 100 - 100).alias("pct"))


def composition(positions: DataFrame, closes: DataFrame, cash: DataFrame) -> DataFrame:
    """scenario, symbol, value, weight_pct, gain, gain_pct of each position, and a row for cash over 1."""
    held = positions.join(closes.select("symbol", "close"), "symbol", "left").withColumn("value", F.coalesce(F.col("units") * F.col("close"), F.col("cost")))
    rows = held.select("scenario", "symbol", "value", "cost").unionByName(cash.where("cash > 1").select("scenario", F.lit("CASH").alias("symbol"), F.col("cash").alias("value"), F.lit(None).cast("double").alias("cost")))
    whole = F.sum("value").over(Window.partitionBy("scenario"))
    gain = F.col("value") - F.col("cost")
    return rows.select("scenario", "symbol", F.round("value", 2).alias("value"), F.round(F.try_divide("value", whole) * 100, 2).alias("weight_pct"), F.round(gain, 2).alias("gain"), F.round(F.try_divide(gain, F.col("cost")) * 100, 2).alias("gain_pct"))


def comments(parts: DataFrame, up: int = 3, down: int = 2) -> DataFrame:
    """symbol, comment: the largest and smallest contributions (symbol, feature, contribution) in a fixed sentence."""
    each = Window.partitionBy("symbol")
    rows = parts.where("contribution is not null").withColumns({"top": F.row_number().over(each.orderBy(F.desc("contribution"), "feature")), "low": F.row_number().over(each.orderBy("contribution", "feature"))})
    said = F.format_string("%s %+.2f", "feature", "contribution")

    def some(place: str, n: int) -> Column:
        return F.concat_ws(", ", F.transform(F.sort_array(F.collect_list(F.when(F.col(place) <= n, F.struct(place, said.alias("said"))))), lambda x: x["said"]))

    return rows.groupBy("symbol").agg(some("top", up).alias("best"), some("low", down).alias("worst")).select("symbol", F.format_string("Mostly from %s; held back by %s.", "best", "worst").alias("comment"))


def tiles(scored: DataFrame, universe: DataFrame, report: DataFrame) -> DataFrame:
    """One row: date, analysed, universe, quarantined, groups on the last date."""
    last = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    now = last.agg(F.max("date").alias("date"), F.count("*").alias("analysed"), F.countDistinct("grp").alias("groups"))
    return now.crossJoin(universe.agg(F.countDistinct("symbol").alias("universe"))).crossJoin(report.agg(F.count_if("quarantine").alias("quarantined")))  # one row each


def report_rows(scored: DataFrame, panel: DataFrame, columns: tuple[str, ...] = ("ret_1m", "ret_3m", "ret_12m", "vol_252")) -> DataFrame:
    """Scores of the last date with features of the panel's last date; null where a symbol has none."""
    last = scored.join(F.broadcast(scored.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    now = panel.join(F.broadcast(panel.agg(F.max("date").alias("date"))), "date", "left_semi")  # one row
    return last.join(now.select("symbol", *columns), "symbol", "left")


def savings(dropped: DataFrame, books: DataFrame) -> DataFrame:
    """scenario, broker, dropped, avoided (of the last decision), saved (of all of them)."""
    now = dropped.groupBy("scenario", "broker").agg(F.count("*").alias("dropped"), F.round(F.sum(F.coalesce("avoided", F.lit(0.0))), 2).alias("avoided"))
    return books.select("scenario", "broker", "saved").join(now, ["scenario", "broker"], "left").select("scenario", "broker", F.coalesce("dropped", F.lit(0)).alias("dropped"), F.coalesce("avoided", F.lit(0.0)).alias("avoided"), "saved")


def period_of_books(curve: DataFrame, bench: DataFrame, day_count: int) -> DataFrame:
    """scenario, broker, pct, cost (paid within the period), excess (over the benchmark; null without it) over the last natural days."""
    top = curve.agg(F.max("date").alias("top"))
    rows = curve.join(F.broadcast(top), F.col("date") >= F.date_sub("top", day_count))  # one row
    own = rows.groupBy("scenario", "broker").agg(F.min_by("value", "date").alias("first"), F.max_by("value", "date").alias("last"), F.min_by("costs", "date").alias("before"), F.max_by("costs", "date").alias("after"), F.count("*").alias("n")).where("n >= 2")
    side = bench.join(F.broadcast(top), (F.col("date") >= F.date_sub("top", day_count)) & (F.col("date") <= F.col("top"))).agg(F.min_by("value", "date").alias("b0"), F.max_by("value", "date").alias("b1"))
    pct = F.try_divide("last", "first") * 100 - 100
    return own.crossJoin(side).select("scenario", "broker", pct.alias("pct"), (F.col("after") - F.col("before")).alias("cost"), (pct - (F.try_divide("b1", "b0") * 100 - 100)).alias("excess"))  # one row


def drawn(points: Column, every: int = 4) -> Column:
    """A line of points from 0 to 1 as blocks of eight heights; every fourth point is shown."""
    return F.concat_ws("", F.transform(F.filter(points, lambda x, i: i % every == 0), lambda x: F.substring(F.lit("▁▂▃▄▅▆▇█"), (F.floor(x * 7) + 1).cast("int"), F.lit(1))))


def section(name: str, table: DataFrame, rows: int = 200) -> str:
    """The first rows of a short table as HTML."""
    out = [f"<h2>{html.escape(name)}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}" for c in table.columns)]
    for row in table.limit(rows).collect():
        out.append("<tr>" + "".join(f"<td>{'' if v is None else html.escape(str(v))}" for v in row))
    return "\n".join([*out, "</table>"])


def page(title: str, sections: list[str]) -> str:
    return "\n".join([f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>", *sections])
