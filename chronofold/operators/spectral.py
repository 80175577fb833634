"""Principal modes of vectors: one aggregation of moments, then projection, resonance and coherence as columns."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of the variance, most modes, growth that makes a basis stale.
VARIANCE, MOST_MODES, STALE = 0.99, 128, 0.1


@dataclass(frozen=True)
class Basis:
    mean: np.ndarray
    modes: np.ndarray  # (modes, dimensions)
    share: float
    n: int


def _moments(vectors: DataFrame, column: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products: a row of dimension squared a task, added up in Spark."""

    def run(batches):
        n, s, ss = 0, None, None
        for b in batches:
            flat = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            if not len(x):
                continue
            n += len(x)
            s, ss = (x.sum(0), x.T @ x) if s is None else (s + x.sum(0), ss + x.T @ x)
        if n:
            d = len(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, d)), pa.array([float(n)] * (d + 1)), pa.array([s.tolist(), *ss.tolist()], pa.list_(pa.float64()))], names=["i", "n", "row"])

    parts = vectors.select(F.col(column).cast("array<double>")).where(F.col(column).isNotNull()).mapInArrow(run, "i long, n double, row array<double>")
    cells = parts.select("i", "n", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    got = cells.toArrow().to_pydict()  # dimension squared cells
    if not got["i"]:
        return 0, np.zeros(0), np.zeros((0, 0))
    d = max(got["j"]) + 1
    grid = np.zeros((d + 1, d))
    grid[np.array(got["i"]) + 1, got["j"]] = got["x"]
    return int(got["n"][0]), grid[0], grid[1:]


def basis(vectors: DataFrame, column: str = "v", variance: float = VARIANCE, most: int = MOST_MODES) -> Basis:
    """The modes that hold the share of the variance; each has its largest component positive."""
    n, s, ss = _moments(vectors, column)
    if n < 2:
        raise ValueError("at least two vectors")
    mean = s / n
    values, modes = np.linalg.eigh(ss - n * np.outer(mean, mean))
    values, modes = np.maximum(values[::-1], 0), modes[:, ::-1].T
    shares = np.cumsum(values) / max(values.sum(), 1e-300)
    k = min(int(np.searchsorted(shares, variance) + 1), most, len(values))
    modes = modes[:k]
    signs = np.sign(modes[np.arange(k), np.abs(modes).argmax(1)])
    return Basis(mean, modes * np.where(signs == 0, 1, signs)[:, None], float(shares[k - 1]), n)


def projected(v: Column, b: Basis) -> Column:
    """The unit vector of the modes' shares, zero where there is none."""
    mean = F.lit([float(x) for x in b.mean])
    centred = F.zip_with(v, mean, lambda x, m: x - m)
    parts = F.array(*[F.aggregate(F.zip_with(centred, F.lit([float(x) for x in m]), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for m in b.modes])
    return F.element_at(F.transform(F.array(parts), lambda p: _unit(p)), 1)


def _unit(p: Column) -> Column:
    norm = F.sqrt(F.aggregate(p, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(p, lambda x: F.when(norm > 1e-12, x / norm).otherwise(0.0))


def resonance(a: Column, b: Column) -> Column:
    """The cosine of two projections."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def coherence(links: DataFrame, by: str) -> DataFrame:
    """by and the share of RESONANT links among RESONANT and INHIBITORY ones."""
    r = F.count_if(F.col("link_type") == "RESONANT")
    return links.groupBy(by).agg((r / F.greatest(r + F.count_if(F.col("link_type") == "INHIBITORY"), F.lit(1))).alias("coherence"))


def stale(n: int, b: Basis) -> bool:
    """Whether the number of vectors has changed too much since the basis was made."""
    return abs(n - b.n) / b.n > STALE
