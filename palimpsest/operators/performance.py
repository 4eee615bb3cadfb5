"""Return statistics and factor attribution of long series (signal, sample, series, date, ret)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.hac import hac_fit
from palimpsest.schemas import ATTRIBUTION, ATTRIBUTION_FACTORS

LAGS, MIN_MONTHS = 6, 12
#: Samples by the month earned, both ends inclusive.
SAMPLES = (
    ("Full sample", None, None),
    ("Through 2014 (inside the paper's sample)", None, "2014-12-31"),
    ("2015 onward (out of sample)", "2015-01-01", None),
)
MODELS = {
    "CAPM": ("MKT_RF",),
    "FF3": ("MKT_RF", "SMB", "HML"),
    "FF5": ("MKT_RF", "SMB", "HML", "RMW", "CMA"),
    "FF5+MOM": ATTRIBUTION_FACTORS,
}
KEY = ["signal", "sample", "series"]


def in_samples(df: DataFrame, samples: Sequence[tuple] = SAMPLES) -> DataFrame:
    """df, with date, once for each sample that holds its row."""
    hit = [F.when(F.lit(True) if a is None else F.col("date") >= F.lit(a).cast("date"), True) & (F.lit(True) if b is None else F.col("date") <= F.lit(b).cast("date")) for _, a, b in samples]
    names = F.array(*[F.when(h, F.lit(name)) for h, (name, _, _) in zip(hit, samples, strict=True)])
    return df.withColumn("sample", F.explode(F.filter(names, lambda x: x.isNotNull())))


def long_series(portfolios: DataFrame, series: Sequence[str] = ("LS", "LS_net")) -> DataFrame:
    """(signal, date, series, ret) of wide portfolio returns, nulls dropped."""
    return portfolios.unpivot(["signal", "date"], list(series), "series", "ret").dropna(subset=["ret"])


def wealth(df: DataFrame) -> DataFrame:
    """df with wealth, the growth of 1, and its peak so far (first month included)."""
    order = Window.partitionBy(*KEY).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = df.withColumn("wealth", F.product(1 + F.col("ret")).over(order))
    return grown.withColumn("peak", F.max("wealth").over(order))


def newey_west(df: DataFrame, lags: int = LAGS) -> DataFrame:
    """signal, sample, series, months, t_stat of the mean; null below lags + 2 months."""
    whole = Window.partitionBy(*KEY)
    order = whole.orderBy("date")
    u = df.withColumn("u", F.col("ret") - F.avg("ret").over(whole))
    terms = [F.sum(F.col("u") * F.col("u")).alias("g0")]
    for lag in range(1, lags + 1):
        u = u.withColumn(f"u{lag}", F.col("u") * F.lag("u", lag).over(order))
        terms.append(F.sum(f"u{lag}").alias(f"g{lag}"))
    sums = u.groupBy(*KEY).agg(F.count("*").alias("months"), F.avg("ret").alias("mean"), *terms)
    total = F.col("g0")
    for lag in range(1, lags + 1):
        total = total + 2 * (1 - lag / (lags + 1)) * F.coalesce(f"g{lag}", F.lit(0.0))
    t = F.when((F.col("months") >= lags + 2) & (total > 0), F.col("mean") * F.col("months") / F.sqrt(total))
    return sums.select(*KEY, "months", t.alias("t_stat"))


def performance(df: DataFrame, lags: int = LAGS) -> DataFrame:
    """One row a series: months, and below MIN_MONTHS nothing else."""
    grown = wealth(df)
    sums = grown.groupBy(*KEY).agg(
        F.count("*").alias("months"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.min(F.col("wealth") / F.col("peak") - 1).alias("drawdown"), F.avg((F.col("ret") > 0).cast("int")).alias("hit"),
    )
    out = sums.join(newey_west(df, lags).drop("months"), KEY)
    enough = F.col("months") >= MIN_MONTHS
    keep = lambda c, name: F.when(enough, c).alias(name)
    return out.select(
        *KEY, "months", keep(F.col("mean") * 1e4, "mean_monthly_bps"), keep(F.col("mean") * 12, "ann_return"), keep(F.col("sd") * F.sqrt(F.lit(12.0)), "ann_vol"),
        keep(F.try_divide("mean", "sd") * F.sqrt(F.lit(12.0)), "sharpe"), keep(F.col("t_stat"), "t_stat"), keep(F.col("drawdown"), "max_drawdown"), keep(F.col("hit"), "hit_rate"),
    )


def quantile_means(portfolios: DataFrame, samples: Sequence[tuple] = SAMPLES) -> DataFrame:
    names = [c for c in portfolios.columns if c[0] == "Q" and c[1:].isdigit()]
    return in_samples(portfolios, samples).groupBy("signal", "sample").agg(
        *[(F.avg(q) * 1e4).alias(q) for q in names], F.avg("n_names").alias("avg_names"), (F.avg(F.col("turnover_long") + F.col("turnover_short")) / 2).alias("avg_monthly_turnover"),
    )


def capm(df: DataFrame, factors: DataFrame, lags: int = LAGS) -> DataFrame:
    """Market model in built-in aggregates alone: months, alpha_monthly_bps, alpha_t, beta_MKT_RF, r2."""
    rows = df.join(factors.select("date", F.col("MKT_RF").alias("x"), "RF"), "date").dropna(subset=["ret", "x", "RF"])
    whole = Window.partitionBy(*KEY)
    order = whole.orderBy("date")
    fit = rows.withColumn("b", F.regr_slope("ret", "x").over(whole)).withColumn("mx", F.avg("x").over(whole)).withColumn("my", F.avg("ret").over(whole))
    e = fit.withColumn("s0", F.col("ret") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx"))).withColumn("s1", F.col("s0") * (F.col("x") - F.col("mx")))
    sums = [F.count("*").alias("n"), F.first("b").alias("b"), F.first("mx").alias("mx"), F.first("my").alias("my"), F.sum((F.col("x") - F.col("mx")) ** 2).alias("sxx"), F.regr_r2("ret", "x").alias("r2")]
    for i, j in ((0, 0), (0, 1), (1, 1)):
        m = F.col(f"s{i}") * F.col(f"s{j}")
        total = F.sum(m)
        for lag in range(1, lags + 1):
            c = f"m{i}{j}{lag}"
            e = e.withColumn(c, F.col(f"s{i}") * F.lag(f"s{j}", lag).over(order) + F.col(f"s{j}") * F.lag(f"s{i}", lag).over(order))
            total = total + (1 - lag / (lags + 1)) * F.coalesce(F.sum(c), F.lit(0.0))
        sums.append(total.alias(f"v{i}{j}"))
    out = e.groupBy(*KEY).agg(*sums).filter(F.col("n") >= 1 + lags + 2)
    alpha = F.col("my") - F.col("b") * F.col("mx")
    r = F.col("mx") / F.col("sxx")  # regressors are centred, so alpha = mean - b * mx
    variance = F.col("v00") / F.col("n") ** 2 - 2 * r * F.col("v01") / F.col("n") + r * r * F.col("v11")
    return out.select(*KEY, F.col("n").alias("months"), (alpha * 1e4).alias("alpha_monthly_bps"), (alpha / F.sqrt(variance)).alias("alpha_t"), F.col("b").alias("beta_MKT_RF"), "r2")


def _regress(models: dict, lags: int):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for model, names in models.items():
            rows = pdf.dropna(subset=["ret", *names, "RF"]).sort_values("date")
            row = {**{k: pdf[k].iloc[0] for k in KEY}, "model": model, "months": len(rows)}
            if len(rows) >= len(names) + lags + 2:
                y = rows["ret"].to_numpy() - (rows["RF"].to_numpy() if row["series"].startswith("Q") else 0)
                got = hac_fit(y, np.column_stack([np.ones(len(rows)), rows[list(names)].to_numpy()]), lags)
                row |= {"alpha_monthly_bps": got["beta"][0] * 1e4, "alpha_ann": got["beta"][0] * 12, "alpha_t": got["t"][0], "alpha_p": got["p"][0], "r2": got["r2"]}
                for i, f in enumerate(names, 1):
                    row |= {f"beta_{f}": got["beta"][i], f"t_{f}": got["t"][i]}
            out.append(row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in ATTRIBUTION.split(", ")])

    return fit


def factor_regression(df: DataFrame, factors: DataFrame, models: dict = MODELS, lags: int = LAGS) -> DataFrame:
    """ATTRIBUTION rows: each series on each model's factors.

    Series named Q1, Q2, ... are long only and regressed in excess of RF; spreads are not.
    A group is one series, a row a month of history, and so small.
    """
    rows = df.join(factors, "date")
    return rows.groupBy(*KEY).applyInPandas(_regress(models, lags), ATTRIBUTION)


def describe(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row a column: measure, count, mean, std, min, p25, p50, p75, max; nulls don't count,
    quartiles are exact and interpolated."""
    long = panel.unpivot([], list(columns), "measure", "value").dropna(subset=["value"])
    quartiles = [F.percentile("value", q / 100).alias(f"p{q}") for q in (25, 50, 75)]
    return long.groupBy("measure").agg(F.count("*").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), *quartiles, F.max("value").alias("max"))


def label(name: Column) -> Column:
    """'item1a_cosine' -> 'item1a (cosine)'."""
    parts = F.split(name, "_", 2)
    return F.concat(F.get(parts, F.lit(0)), F.lit(" ("), F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit(")"))


def growth_curve(df: DataFrame) -> DataFrame:
    """(signal, sample, series, date, growth) of 1; starts with the first month observed."""
    return wealth(df).select(*KEY, "date", F.col("wealth").alias("growth"))
