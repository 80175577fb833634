"""Statistics of experiments: equivalence tests, regressions, trajectories and predictions.

Sums go through Spark; what comes to the driver are moments, as many as there are coefficients squared.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (Lentz)."""
    tiny, c = 1e-300, 1.0
    d = 1 / max(abs(1 - (a + b) * x / (a + 1)), tiny) * math.copysign(1, 1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            c = 1 + top / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_cdf(t: float, df: float) -> float:
    """The distribution function of Student's t."""
    tail = 0.5 * beta_share(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_quantile(p: float, df: float) -> float:
    low, high = -1e6, 1e6
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def equivalence(mean: float, sd: float, n: int, bound: float, alpha: float = 0.05) -> dict:
    """Two one-sided tests of a mean against -bound and bound: their p-values, the interval at 1 - 2 alpha and the verdict."""
    if n < 2:
        raise ValueError("at least two values")
    se, df = sd / math.sqrt(n), n - 1
    if se == 0:
        low, high = (0.0 if mean > -bound else 1.0), (0.0 if mean < bound else 1.0)
        reach = 0.0
    else:
        low, high = 1 - t_cdf((mean + bound) / se, df), t_cdf((mean - bound) / se, df)
        reach = t_quantile(1 - alpha, df) * se
    return {"p_low": low, "p_high": high, "p": max(low, high), "from": mean - reach, "to": mean + reach, "equivalent": max(low, high) < alpha}


def tost(df: DataFrame, group: str, value: str, bound: float) -> list[dict]:
    """equivalence by group, from one aggregation; a group of one value has no verdict."""
    rows = df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n")).orderBy(group).collect()
    return [{group: r[group], "n": r["n"], "mean": r["mean"], "sd": r["sd"], **equivalence(r["mean"], r["sd"], r["n"], bound)} for r in rows if r["n"] > 1]


def regression(df: DataFrame, terms: dict[str, Column], y: Column) -> list[dict]:
    """Ordinary least squares of y on the terms and a constant: name, beta, se, t, and r2 of the whole; one aggregation."""
    names = ["constant", *terms]
    cols = [F.lit(1.0), *[c.cast("double") for c in terms.values()]]
    y = y.cast("double")
    k = len(cols)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    aggs = [F.sum(cols[i] * cols[j]).alias(f"x{i}_{j}") for i, j in pairs] + [F.sum(c * y).alias(f"y{i}") for i, c in enumerate(cols)] + [F.sum(y * y).alias("yy")]
    m = df.agg(*aggs).first()
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = m[f"x{i}_{j}"] or 0.0
    xy = np.array([m[f"y{i}"] or 0.0 for i in range(k)])
    n = xx[0, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rest = max(0.0, (m["yy"] or 0.0) - beta @ xy)
    total = (m["yy"] or 0.0) - xy[0] ** 2 / n if n else 0.0
    spread = rest / (n - k) if n > k else float("nan")
    out = []
    for i, name in enumerate(names):
        se = math.sqrt(spread * inverse[i, i]) if spread == spread and inverse[i, i] >= 0 else float("nan")
        out.append({"name": name, "beta": float(beta[i]), "se": se, "t": float(beta[i]) / se if se else float("nan"), "r2": 1 - rest / total if total else float("nan"), "n": int(n)})
    return out


def partial_correlation(df: DataFrame, x: str, y: str, given: str) -> Column:
    """Correlation of x and y with the linear part of a third taken from both."""
    a, b, c = F.corr(x, y), F.corr(x, given), F.corr(y, given)
    return (a - b * c) / F.sqrt((1 - b * b) * (1 - c * c))


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """run, steps, sets (share of steps whose sets differ), items (share whose numbers differ) of two tables (run, step, items array)."""
    x, y = a.select("run", "step", F.array_sort(F.array_distinct("items")).alias("x")), b.select("run", "step", F.array_sort(F.array_distinct("items")).alias("y"))
    both = x.join(y, ["run", "step"])
    share = lambda c: F.avg(c.cast("double"))
    return both.groupBy("run").agg(F.count("*").alias("steps"), share(F.col("x") != F.col("y")).alias("sets"), share(F.size("x") != F.size("y")).alias("sizes"))


def predicted(told: DataFrame) -> DataFrame:
    """precision and recall of predicted flips (predicted, flipped) in one row."""
    hit, said, were = F.count_if(F.col("predicted") & F.col("flipped")), F.count_if("predicted"), F.count_if("flipped")
    return told.agg(F.when(said > 0, hit / said).alias("precision"), F.when(were > 0, hit / were).alias("recall"), F.count("*").alias("n"))
