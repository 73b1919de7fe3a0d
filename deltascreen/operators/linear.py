"""Closed-form linear algebra over distributed profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLD = ["scenario", "fold"]
# residual at which the iterative solve stops, relative to its right-hand side
RESIDUAL = 1e-13
# residual above which a solve that has stopped is an error
UNSOLVED = 1e-6
# singular values below this share of the greatest are rounding errors: their vectors are any of the null space
NULL_SPACE = 1e-7


def schur_solve(b: np.ndarray, k: np.ndarray, d_b: np.ndarray, d_k: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bin effects of the two-way system after its labels are eliminated, by conjugate gradients.

    The system is only applied, pair by pair, so memory grows with the pairs and not with the square
    of the bins. ``d_b`` and ``d_k`` are the pairs of each bin and label plus the penalty.
    """
    def apply(v: np.ndarray) -> np.ndarray:
        inner = np.bincount(k, v[b], len(d_k)) / d_k
        return d_b * v - np.bincount(b, inner[k], len(d_b))

    x, r = np.zeros(len(d_b)), right.copy()
    z = r / d_b
    p, rz = z.copy(), r @ z
    stop = RESIDUAL * np.linalg.norm(right)
    for _ in range(10 * len(d_b) + 100):
        if np.linalg.norm(r) <= stop:
            break
        q = apply(p)
        step = rz / (p @ q)
        x += step * p
        r -= step * q
        z = r / d_b
        rz, last = r @ z, rz
        p = z + rz / last * p
    left = np.linalg.norm(apply(x) - right)
    if left > UNSOLVED * max(np.linalg.norm(right), 1e-300):
        raise ArithmeticError(f"bin effects did not converge: residual {left:.3g} of {np.linalg.norm(right):.3g}")
    return x


def ridge_coefficients(train_rows: DataFrame, lam: float) -> DataFrame:
    """Ridge on one-hot(label) + one-hot(bin) with centred targets, one solve per feature.

    ``train_rows(scenario, fold, bin, ko, gene, y)``. Eliminating the labels leaves a system as
    wide as the number of bins, which is solved without forming it; a task sees the training pairs of
    one feature.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        bins, b = np.unique(pdf["bin"].to_numpy(str), return_inverse=True)
        kos, k = np.unique(pdf["ko"].to_numpy(str), return_inverse=True)
        y = pdf["y"].to_numpy(float)
        mean = y.mean()
        yc = y - mean
        d_b, d_k = np.bincount(b) + lam, np.bincount(k) + lam
        s_b, s_k = np.bincount(b, yc), np.bincount(k, yc)
        w_b = schur_solve(b, k, d_b, d_k, s_b - np.bincount(b, (s_k / d_k)[k], len(bins)))
        w_k = (s_k - np.bincount(k, w_b[b], len(kos))) / d_k
        return pd.DataFrame({
            "scenario": pdf["scenario"].iloc[0], "fold": pdf["fold"].iloc[0],
            "gene": pdf["gene"].iloc[0],
            "kind": ["mean"] + ["bin"] * len(bins) + ["ko"] * len(kos),
            "term": [""] + list(bins) + list(kos),
            "weight": np.concatenate([[mean], w_b, w_k]),
        })

    schema = "scenario string, fold int, gene string, kind string, term string, weight double"
    return train_rows.groupBy(*FOLD, "gene").applyInPandas(solve, schema)


def right_singular(
    rows: DataFrame, k: int, column: str = "v", shape: tuple[int, int] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Top right singular vectors (features x k) and singular values of row profiles.

    MLlib only multiplies the distributed rows with driver vectors of feature length, so the
    driver holds k vectors over the bounded panel.
    """
    vectors = MLUtils.convertVectorColumnsFromML(
        rows.select(array_to_vector(column).alias("v")), "v"
    ).persist()
    matrix = RowMatrix(vectors, *(shape or (0, 0)))
    rank = int(min(k, matrix.numCols(), matrix.numRows()))
    svd = matrix.computeSVD(rank, computeU=False, rCond=NULL_SPACE)
    vectors.unpersist()
    return np.asarray(svd.V.toArray()), np.asarray(svd.s.toArray())


def column_means(rows: DataFrame, column: str = "v") -> DataFrame:
    return rows.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def bilinear_moments(
    rows: DataFrame, bases: dict[tuple[str, int], np.ndarray], right: str = "b", column: str = "v"
) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray, int]]:
    """Per fold: sum of (basis' row)(right)' and of (right)(right)', from per-partition sums.

    Only k x k matrices leave the partitions.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for (scenario, fold), part in pdf.groupby(FOLD):
                basis = bases[(scenario, int(fold))]
                v = np.stack([np.asarray(x, float) for x in part[column]])
                b = np.stack([np.asarray(x, float) for x in part[right]])
                old = sums.get((scenario, int(fold)), (0.0, 0.0, 0))
                sums[(scenario, int(fold))] = (
                    old[0] + (v @ basis).T @ b, old[1] + b.T @ b, old[2] + len(part)
                )
        for (scenario, fold), (moment, gram, n) in sums.items():
            k = moment.shape[0]
            yield pd.DataFrame({
                "scenario": scenario, "fold": fold, "i": np.repeat(np.arange(k), k),
                "j": np.tile(np.arange(k), k), "moment": moment.ravel(), "gram": gram.ravel(), "n": n,
            })

    schema = "scenario string, fold int, i int, j int, moment double, gram double, n bigint"
    total = (
        rows.select(*FOLD, column, right).mapInPandas(partial, schema)
        .groupBy(*FOLD, "i", "j")
        .agg(F.sum("moment").alias("moment"), F.sum("gram").alias("gram"), F.sum("n").alias("n"))
        .toPandas()  # k * k rows per fold
    )
    out = {}
    for job, basis in bases.items():
        k = basis.shape[1]
        mine = total[(total["scenario"] == job[0]) & (total["fold"] == job[1])]
        moment, gram = np.zeros((k, k)), np.zeros((k, k))
        moment[mine["i"], mine["j"]] = mine["moment"]
        gram[mine["i"], mine["j"]] = mine["gram"]
        out[job] = (moment, gram, int(mine["n"].max()) if len(mine) else 0)
    return out
