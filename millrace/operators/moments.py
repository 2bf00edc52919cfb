"""Central moments of any order from one scan, by partial states that merge in pairs.

A state of some values is their number, their mean, and the sums of (v - mean) ** p for p from 2 on. Two
states merge without the values: with d the distance of the means,

    M_p = A_p + B_p + sum over k of C(p, k) d**k ((-nb/n)**k A_(p-k) + (na/n)**k B_(p-k)) + rest(d)

so sums are always about a mean of their own values and nothing cancels, however far from zero these lie.
A task merges its batches and gives one row for each column; such rows are merged in Spark, also those of
other days.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.columns import as_double, quoted
from millrace.operators.quantiles import local_rows

STATE = "column string, n double, mean double, m array<double>"


def merged(a: tuple, b: tuple) -> tuple:
    """The state of both: (n, mean, [M_2, M_3, ...]). For numbers, and alike for columns of not empty states."""
    (na, mean_a, ma), (nb, mean_b, mb) = a, b
    n, d = na + nb, mean_b - mean_a
    left, right = na / n * d, nb / n * d
    out = []
    for p in range(2, len(ma) + 2):
        whole = ma[p - 2] + mb[p - 2] + na * (-1 * right) ** p + nb * left**p
        for k in range(1, p - 1):
            whole = whole + math.comb(p, k) * ((-1 * right) ** k * ma[p - k - 2] + left**k * mb[p - k - 2])
        out.append(whole)
    return n, mean_a + right, out


def state_of(values: np.ndarray, highest: int) -> tuple:
    mean = float(values.mean())
    apart = values - mean
    mean += float(apart.mean())  # what rounding has left in the first mean
    return float(len(values)), mean, [float(((values - mean) ** p).sum()) for p in range(2, highest + 1)]


def moment_state(df: DataFrame, columns: Sequence[str], highest: int) -> DataFrame:
    """Rows (column, n, mean, m): one for each task and column with a number."""
    names = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, tuple] = {}
        with np.errstate(all="ignore"):
            for batch in batches:
                for name, column in zip(names, batch.columns):
                    values = column.drop_null().to_numpy()
                    values = values[~np.isnan(values)]
                    if len(values):
                        own = state_of(values, highest)
                        states[name] = merged(states[name], own) if name in states else own
        if states:
            n, mean, m = zip(*states.values())
            lists = pa.array(m, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(states)), pa.array(n), pa.array(mean), lists], ["column", "n", "mean", "m"])

    return df.select([as_double(quoted(c)).alias(f"c{i}") for i, c in enumerate(names)]).mapInArrow(run, STATE)


def fold_moments(*states: DataFrame, highest: int) -> DataFrame:
    """One row for each column from the states of any parts of the rows."""
    whole = states[0]
    for part in states[1:]:
        whole = whole.unionByName(part)

    def both(a: Column, b: Column) -> Column:
        n, mean, m = merged(*[(x["n"], x["mean"], [x["m"][i] for i in range(highest - 1)]) for x in (a, b)])
        return F.struct(n.alias("n"), mean.alias("mean"), F.array(*m).alias("m"))

    # a row for each task: few, and small
    listed = whole.groupBy("column").agg(F.collect_list(F.struct("n", "mean", "m")).alias("s"))
    folded = F.aggregate(F.slice("s", 2, F.size("s")), F.get("s", F.lit(0)), both)
    return listed.select("column", folded.alias("s")).select("column", "s.n", "s.mean", "s.m")


def moments_of(state: DataFrame, columns: Sequence[str], highest: int) -> DataFrame:
    """Rows (column, order, moment): the biased central moments 3 .. highest, null without a number."""
    found = fold_moments(state, highest=highest)
    orders = [F.struct(F.lit(k).alias("order"), (F.get("m", F.lit(k - 2)) / F.col("n")).alias("moment")) for k in range(3, highest + 1)]
    asked = local_rows(state.sparkSession, [(c,) for c in columns], "column string")
    asked = asked.select("column", F.explode(F.sequence(F.lit(3), F.lit(highest))).alias("order"))
    return asked.join(found.select("column", F.inline(F.array(*orders))), ["column", "order"], "left").select("column", "order", "moment")
