"""Binomial regressions by Newton steps: Spark gathers the sums, the driver solves systems of the size of the coefficients.

Several fits share their predictors and run together: each step is one job that reads the rows once, whatever the number of
replicate weights or of held values. Categorical terms are kept as the index of their level, so a row costs as much
as it has terms, and the second derivatives are gathered for the pairs of levels that occur.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class NotConverged(ValueError):
    """No maximum was found within the steps allowed."""


@dataclass
class Fits:
    """``names``: of the coefficients, the intercept first. ``beta`` and ``se``: a row per fit. ``deviance``: up to a constant."""

    names: list[str]
    beta: np.ndarray
    se: np.ndarray
    deviance: np.ndarray
    steps: int
    design: DataFrame


def _design(rows: DataFrame, predictors: Sequence[str], keep: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with ``__ix`` and ``__vx``, indices and values of their active coefficients, and the names of all.

    The rarest level of a categorical predictor is the reference. Levels come to the driver, as many as coefficients.
    """
    names, cells = ["(Intercept)"], [(F.lit(0), F.lit(1.0))]
    for p in predictors:
        if isinstance(rows.schema[p].dataType, (T.StringType, T.BooleanType)):
            level = F.col(p).cast("string")
            levels = [r[0] for r in rows.groupBy(level.alias("level")).count().orderBy(F.desc("count"), "level").select("level").collect()]
            table = rows.sparkSession.createDataFrame([(x, len(names) + i) for i, x in enumerate(levels[:-1])], f"`__of_{p}` string, `__at_{p}` int")
            rows = rows.join(F.broadcast(table), level == F.col(f"__of_{p}"), "left").drop(f"__of_{p}")
            cells.append((F.coalesce(f"__at_{p}", F.lit(0)), F.col(f"__at_{p}").isNotNull().cast("double")))
            names += [f"{p}_{x}" for x in levels[:-1]]
        else:
            cells.append((F.lit(len(names)), F.col(p).cast("double")))
            names.append(p)
    return rows.select(*keep, F.array(*[i for i, _ in cells]).alias("__ix"), F.array(*[v for _, v in cells]).alias("__vx")), names


def _eta(ix: np.ndarray, vx: np.ndarray, beta: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return (beta[:, ix] * vx).sum(axis=2) + offset


def _lists(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def logistic_fits(rows: DataFrame, predictors: Sequence[str], sizes: Sequence[Column], hits: Sequence[Column], held: Column | None = None,
                  values: Sequence[float] = (), tolerance: float = 1e-10, most_steps: int = 60) -> Fits:
    """One fit for each pair of ``sizes`` (weight of a row) and ``hits`` (weight of ones in it).

    With ``held`` there is one fit for each of ``values``, the fixed effect of that column, on the first pair. A fit has
    converged when a further step would change its deviance by less than ``tolerance``; a step that makes a fit worse is
    halved. Coefficients that the rows don't determine get the smallest values that fit.
    """
    design, names = _design(rows.withColumns({"__n": F.array(*[s.cast("double") for s in sizes]), "__h": F.array(*[h.cast("double") for h in hits]),
                                              "__held": F.lit(0.0) if held is None else held.cast("double")}), predictors, ["__n", "__h", "__held"])
    design = design.persist()
    fixed = np.array(values, float)[:, None] if held is not None else np.zeros((len(sizes), 1))
    fits, p = len(fixed), len(names)
    sc = rows.sparkSession.sparkContext

    def gathered(beta: np.ndarray):
        shared = sc.broadcast(beta)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            beta = shared.value
            for whole in batches:
                for start in range(0, whole.num_rows, 2048):
                    batch = whole.slice(start, 2048)
                    ix, vx = _lists(batch, "__ix").astype(np.int64), _lists(batch, "__vx")
                    n, h = (np.broadcast_to(_lists(batch, c).T, (fits, batch.num_rows)) for c in ("__n", "__h"))
                    eta = _eta(ix, vx, beta, fixed * batch.column("__held").to_numpy())
                    mu = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    first, second = h - n * mu, n * mu * (1 - mu)
                    loss = -2 * (h * eta - n * np.logaddexp(0, eta)).sum(axis=1)
                    terms = ix.shape[1]
                    a, b = np.triu_indices(terms)
                    low, high = np.minimum(ix[:, a], ix[:, b]), np.maximum(ix[:, a], ix[:, b])
                    twice = np.where((ix[:, a] == ix[:, b]) & (a != b), 2.0, 1.0)
                    # keys: -1 the deviance, below p the first derivatives, then pairs of the second ones
                    keys = np.concatenate([[-1], ix.ravel(), p + (low * p + high).ravel()])
                    key, at = np.unique(keys, return_inverse=True)
                    sums = np.stack([np.bincount(at, np.concatenate([[loss[f]], (first[f][:, None] * vx).ravel(), (second[f][:, None] * vx[:, a] * vx[:, b] * twice).ravel()]), len(key))
                                     for f in range(fits)], axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.ListArray.from_arrays(pa.array(np.arange(0, sums.size + 1, fits, dtype=np.int32)), pa.array(sums.ravel()))], ["key", "sums"])

        found = (design.mapInArrow(run, "key long, sums array<double>").groupBy("key")
                 .agg(F.array(*[F.sum(F.col("sums")[f]) for f in range(fits)]).alias("sums")).toArrow())
        key = found.column("key").to_numpy()
        sums = found.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, fits)
        gradient, second = np.zeros((fits, p)), np.zeros((fits, p, p))
        gradient[:, key[(key >= 0) & (key < p)]] = sums[(key >= 0) & (key < p)].T
        pairs = key >= p
        i, j = np.divmod(key[pairs] - p, p)
        second[:, i, j] = sums[pairs].T
        second[:, j, i] = sums[pairs].T
        return sums[key == -1][0] if (key == -1).any() else np.zeros(fits), gradient, second

    try:
        beta, last = np.zeros((fits, p)), np.full(fits, np.inf)
        before = beta
        for step in range(most_steps):
            loss, gradient, second = gathered(beta)
            worse = loss > last + 1e-9 * np.abs(last)
            if worse.any():
                beta = np.where(worse[:, None], (before + beta) / 2, beta)
                if worse.all():
                    continue
                loss, gradient, second = gathered(beta)
            move = np.stack([np.linalg.lstsq(s, g, rcond=1e-13)[0] for s, g in zip(second, gradient)])
            gain = (move * gradient).sum(axis=1)
            if (gain < tolerance).all():
                inverse = np.stack([np.linalg.pinv(s, rcond=1e-13, hermitian=True) for s in second])
                return Fits(names, beta + move, np.sqrt(np.maximum(np.diagonal(inverse, axis1=1, axis2=2), 0)), loss, step, design)
            before, last, beta = beta, loss, beta + move
    finally:
        design.unpersist()
    raise NotConverged(f"no maximum within {most_steps} steps for {', '.join(predictors)}")


def fitted(fits: Fits, which: int = 0) -> DataFrame:
    """``size``, ``hits`` and the fitted probability ``p`` of the rows that were fitted."""
    beta = fits.beta[which:which + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            eta = _eta(_lists(batch, "__ix").astype(np.int64), _lists(batch, "__vx"), beta, np.zeros((1, 1)))[0] if batch.num_rows else np.zeros(0)
            n, h = (_lists(batch, c)[:, which] if batch.num_rows else np.zeros(0) for c in ("__n", "__h"))
            yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(h), pa.array(1 / (1 + np.exp(-np.clip(eta, -700, 700))))], ["size", "hits", "p"])

    return fits.design.mapInArrow(run, "size double, hits double, p double")
