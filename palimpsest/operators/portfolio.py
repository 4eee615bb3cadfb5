"""Point-in-time quantile portfolios on long (signal, pos, ticker) tables.

Nothing is built wide: a missing cell is an absent row, and all signals go through one
plan, partitioned by signal.  Positions count months of the returns calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.dates import formation_month_end
from palimpsest.operators.market import calendar

QUANTILES, HOLD_MONTHS, MIN_NAMES, COST_BPS = 5, 12, 50, 10.0


def _placed(signals: DataFrame, months: DataFrame, hold: int | None) -> DataFrame:
    """Filings with the positions start to end, both inclusive, where they are the newest of
    their ticker.  A row a filing; positions are made of it only when they are needed.

    months: one row, the sorted months of the calendar.
    """
    rows = signals.filter("value is not null").withColumn("formed", formation_month_end(F.col("filing_date"))).join(F.broadcast(months))
    rows = rows.withColumn("start", F.size(F.filter("months", lambda m: m < F.col("formed")))).withColumn("n", F.size("months"))
    # A later filing never goes live before an earlier one, so the next one's start ends this one.
    newer = F.lead("start").over(Window.partitionBy("signal", "ticker").orderBy("filing_date", "accession"))
    last = F.least(F.col("start") + (F.col("hold") if hold is None else F.lit(hold)), F.coalesce("newer", "n"), "n") - 1
    rows = rows.filter(F.col("start") < F.col("n")).repartition("ticker").withColumn("newer", newer).withColumn("end", last)
    return rows.filter("start <= end").select("signal", "ticker", "value", "start", "end")


def _calendar(returns: DataFrame) -> DataFrame:
    """calendar(), kept for the branches of a plan: a row a month of history."""
    return calendar(returns).persist()


def _months(returns: DataFrame) -> DataFrame:
    return _calendar(returns).agg(F.sort_array(F.collect_list("date")).alias("months"))  # a value a month of history


def live_signal(signals: DataFrame, returns: DataFrame, hold: int | None = HOLD_MONTHS) -> DataFrame:
    """(signal, pos, ticker, value): the newest filing's value, live for `hold` positions, or
    for those of the column hold where hold is None.

    A filing goes live at the first month of the calendar on or after its formation month
    (filings older than the calendar at its first), and an older one ends where a newer
    one with a value begins.  Equal filing dates: the greater accession wins.
    """
    rows = _placed(signals, _months(returns), hold).join(returns.select("ticker").distinct(), "ticker", "left_semi")
    return rows.select("signal", F.explode(F.sequence(F.col("start").cast("long"), F.col("end").cast("long"))).alias("pos"), "ticker", "value")


def live_with_returns(signals: DataFrame, returns: DataFrame, hold: int | None = HOLD_MONTHS) -> DataFrame:
    """live_signal() with ret, the return that a member formed at pos earns, null if there is none.

    A ticker's returns meet its filings as one map of a value a month of history, before
    positions are made: no row a name and month is joined.
    """
    months = _months(returns)
    known = F.when(F.col("date").isNotNull() & F.col("ret").isNotNull(), F.struct("date", "ret"))
    of_ticker = returns.groupBy("ticker").agg(F.map_from_entries(F.collect_list(known)).alias("earned"))
    rows = _placed(signals, months, hold).join(of_ticker, "ticker").join(F.broadcast(months))
    at = lambda p: F.struct(p.cast("long").alias("pos"), F.try_element_at("earned", F.get("months", p + 1)).alias("ret"))
    return rows.select("signal", "ticker", "value", F.inline(F.transform(F.sequence("start", "end"), at))).select("signal", "pos", "ticker", "value", "ret")


def quantiles(live: DataFrame, n: int = QUANTILES, min_names: int = MIN_NAMES) -> DataFrame:
    """(signal, pos, ticker, q, n_names): ceil(rank / names * n), rank ties by ticker; months
    with fewer than min_names names are left out.  Not ntile, whose groups differ.  A column
    ret is kept."""
    month = Window.partitionBy("signal", "pos")
    rn = F.row_number().over(month.orderBy("value", "ticker")).cast("long")
    ranked = live.withColumn("rn", rn).withColumn("n_names", F.count("*").over(month)).filter(F.col("n_names") >= min_names)
    q = F.expr(f"(rn * {n} + n_names - 1) div n_names")
    kept = [c for c in live.columns if c == "ret"]
    return ranked.select("signal", "pos", "ticker", F.greatest(F.lit(1), F.least(F.lit(n), q)).cast("long").alias("q"), "n_names", *kept)


def _members(quantiled: DataFrame, returns: DataFrame) -> DataFrame:
    """Quantile members with the return they earn, null without one: (signal, pos, ticker, q,
    n_names, ret).  Made by live_with_returns(), they have it already."""
    if "ret" in quantiled.columns:
        return quantiled
    dated = returns.join(F.broadcast(_calendar(returns)), "date")
    earned = dated.filter("ret is not null").select(F.col("ticker"), (F.col("pos") - 1).alias("pos"), "ret")
    return quantiled.join(earned, ["ticker", "pos"], "left")


def _cells(members: DataFrame) -> DataFrame:
    """(signal, pos, q, n_names, ret, names): mean return of the members that have one, and
    their number.  A row a signal, month and quantile."""
    return members.groupBy("signal", "pos", "q").agg(F.max("n_names").alias("n_names"), F.avg("ret").alias("ret"), F.count("ret").alias("names"))


def quantile_returns(quantiled: DataFrame, returns: DataFrame) -> DataFrame:
    """Long: (signal, pos, date, q, ret, names) - mean return earned in `date` by the portfolio
    formed the month before."""
    months = _calendar(returns).select("date", (F.col("pos") - 1).alias("pos"))
    cells = _cells(_members(quantiled, returns)).filter("names > 0")
    return cells.join(F.broadcast(months), "pos").select("signal", "pos", "date", "q", "ret", "names")


def turnover(quantiled: DataFrame, returns: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """(signal, pos, leg, turnover): weight traded by the lowest (short) and highest (long)
    quantile when the portfolio of pos is formed.

    Last month's weights drift with the formation month's returns; after a month without
    portfolio, and at first, the whole weight is bought.  Weights come from the count and
    mean return of a leg (_cells); only names of the two legs are sent, once, to meet their
    neighbouring months.
    """
    members = _members(quantiled, returns)
    cells = cells or _cells(members)
    top = cells.groupBy("signal").agg(F.max("q").alias("top"))
    legs = F.explode(F.filter(F.array(F.when(F.col("q") == 1, F.lit("short")), F.when(F.col("q") == F.col("top"), F.lit("long"))), lambda x: x.isNotNull()))
    sizes = cells.select("signal", "pos", "q", "names", F.col("ret").alias("mean")).join(F.broadcast(top), "signal").withColumn("leg", legs)
    held = members.filter("ret is not null").select("signal", "pos", "q", "ticker", "ret").join(F.broadcast(sizes), ["signal", "pos", "q"])  # two rows a signal and month
    w = 1 / F.col("names")
    held = held.select("signal", "leg", "ticker", "pos", w.alias("w"), (w * (1 + F.col("ret")) / (1 + F.col("mean"))).alias("grown"))  # the return earned is that of the next formation month
    name = Window.partitionBy("signal", "leg", "ticker").orderBy("pos")
    near = held.withColumn("old", F.lag(F.struct("pos", "grown")).over(name)).withColumn("next", F.lead("pos").over(name))
    bought = F.struct("pos", F.abs(F.col("w") - F.when(F.col("old.pos") == F.col("pos") - 1, F.col("old.grown")).otherwise(0.0)).alias("moved"))
    sold = F.when(F.coalesce(F.col("next") != F.col("pos") + 1, F.lit(True)), F.struct((F.col("pos") + 1).alias("pos"), F.col("grown").alias("moved")))
    moved = near.select("signal", "leg", F.inline(F.array_compact(F.array(bought, sold)))).groupBy("signal", "pos", "leg").agg(F.sum("moved").alias("turnover"))
    last = _calendar(returns).agg(F.max("pos").alias("last"))
    formed = cells.select("signal", "pos").distinct().join(F.broadcast(last)).filter("pos < last").drop("last")
    slots = formed.withColumn("leg", F.explode(F.array(F.lit("short"), F.lit("long"))))
    return slots.join(moved, ["signal", "pos", "leg"], "left").select("signal", "pos", "leg", F.coalesce("turnover", F.lit(0.0)).alias("turnover"))


def portfolio_returns(quantiled: DataFrame, returns: DataFrame, cost_bps: float = COST_BPS, n: int = QUANTILES) -> DataFrame:
    """Wide by quantile: signal, date, n_names, Q1..Qn, turnover_short, turnover_long, LS, LS_net.

    One row a month formed and followed by another; LS is the highest quantile that the
    signal ever has less the lowest.  An empty input gives no rows.
    """
    months = _calendar(returns).select("date", (F.col("pos") - 1).alias("pos"))
    members = _members(quantiled, returns)
    cells = _cells(members).persist()  # a row a signal, month and quantile
    mean = lambda q: F.max(F.when(F.col("q") == q, F.col("ret"))).alias(f"Q{q}")
    wide = cells.groupBy("signal", "pos").agg(F.max("n_names").alias("n_names"), *[mean(q) for q in range(1, n + 1)]).join(F.broadcast(months), "pos")
    legs = turnover(members, returns, cells).groupBy("signal", "pos").pivot("leg", ["short", "long"]).agg(F.max("turnover"))
    top = cells.groupBy("signal").agg(F.max("q").cast("int").alias("top"))
    out = wide.join(legs, ["signal", "pos"]).join(F.broadcast(top), "signal")  # a row a signal
    high = F.element_at(F.array(*[f"Q{q}" for q in range(1, n + 1)]), F.col("top"))
    out = out.withColumn("LS", high - F.col("Q1")).withColumn("LS_net", F.col("LS") - (F.col("long") + F.col("short")) * cost_bps / 1e4)
    return out.select("signal", "date", "n_names", *[f"Q{q}" for q in range(1, n + 1)], F.col("short").alias("turnover_short"), F.col("long").alias("turnover_long"), "LS", "LS_net")


def run_sort(signals: DataFrame, returns: DataFrame, hold: int | None = HOLD_MONTHS, cost_bps: float = COST_BPS, min_names: int = MIN_NAMES) -> DataFrame:
    """Signals to portfolio returns."""
    quantiled = quantiles(live_with_returns(signals, returns, hold), min_names=min_names).persist()  # read by the two branches below; a row a name and month
    return portfolio_returns(quantiled, returns, cost_bps)
