"""Cash-flow mathematics over aggregated flows, as column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of the rate, how the upper bound grows, and how long the bracket is halved.
LOW, HIGH, GROWTH, MOST, HIGH_STEPS, HALVINGS = -0.99, 10.0, 4.0, 1e6, 20, 80
#: A present value under this ends the search, with and without higher upper bounds.
STOP, STOP_PLAIN = 1e-9, 1e-6
YEAR = 365.25


def flow(d: Column, amount: Column) -> Column:
    return F.struct(d.alias("d"), amount.cast("double").alias("a"))


def rates(days: list[np.ndarray], amounts: list[np.ndarray], highs: list[float], stop: float = STOP) -> np.ndarray:
    """The rate of each group of flows; all groups of a batch are halved at once."""
    sizes = np.fromiter(map(len, days), dtype=np.int64, count=len(days))
    out = np.full(len(days), np.nan)
    flat, group = np.concatenate([*days, [0]])[:-1].astype(np.float64), np.repeat(np.arange(len(days)), sizes)
    money = np.concatenate([*amounts, [0.0]])[:-1].astype(np.float64)
    keep = ~np.isnan(flat) & ~np.isnan(money) & (money != 0)
    flat, money, group = flat[keep], money[keep], group[keep]
    up, down = np.bincount(group[money > 0], minlength=len(days)), np.bincount(group[money < 0], minlength=len(days))
    whole = (up > 0) & (down > 0)
    first = np.full(len(days), np.inf)
    np.minimum.at(first, group, flat)
    years = (flat - first[group]) / YEAR
    npv = lambda rate: np.bincount(group, weights=money / np.power(1.0 + rate[group], years), minlength=len(days))
    at_low = npv(np.full(len(days), LOW))
    high = np.full(len(days), np.nan)
    for h in reversed(highs):
        high[npv(np.full(len(days), h)) * at_low <= 0] = h
    solved = whole & ~np.isnan(high)
    lo, hi = np.full(len(days), LOW), np.where(solved, high, HIGH)
    for _ in range(HALVINGS):
        mid = (lo + hi) / 2
        value = npv(mid)
        done, left = np.abs(value) < stop, value * at_low <= 0
        lo, hi = np.where(left & ~done, lo, mid), np.where(left | done, mid, hi)
    out[solved] = np.round((lo + hi)[solved] / 2 * 100, 4) + 0.0
    return out


def xirr(flows: Column, expand: bool = True) -> Column:
    """Yearly rate in percent, 4 digits, of array<struct<d, a>>; null without both signs or without a bracket. expand: try higher upper bounds.

    Eighty halvings in nested lambdas of an expression take a hundred times as long, so batches of groups go through numpy, by Arrow.
    """
    highs = [HIGH]
    while expand and len(highs) <= HIGH_STEPS and highs[-1] < MOST:
        highs.append(highs[-1] * GROWTH)

    @F.pandas_udf("double")
    def solve(days: pd.Series, amounts: pd.Series) -> pd.Series:
        out = rates(list(days), list(amounts), highs, STOP if expand else STOP_PLAIN)
        return pd.Series([None if np.isnan(x) else x for x in out], dtype=object)

    return solve(F.transform(flows, lambda x: F.unix_date(x["d"])), F.transform(flows, lambda x: x["a"]))


def dcf(cashflows: Column, wacc: Column, growth: Column) -> Column:
    """Present value of yearly cash flows plus a Gordon terminal value, which is 0 where wacc <= growth."""
    n = F.size(cashflows)
    pv = F.aggregate(F.arrays_zip(cashflows.alias("c"), F.sequence(F.lit(1), n).alias("t")), F.lit(0.0), lambda s, x: s + x["c"] / F.pow(1.0 + wacc, x["t"].cast("double")))
    last = F.element_at(cashflows, -1)
    return pv + F.when(wacc > growth, last * (1 + growth) / (wacc - growth) / F.pow(1.0 + wacc, n.cast("double"))).otherwise(0.0)


def preferred(amount: Column, rate: Column, days: Column) -> Column:
    return amount * (F.pow(1.0 + rate, days / F.lit(YEAR)) - 1.0)
