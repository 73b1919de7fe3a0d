"""Principal-component projection of paired profiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.operators import linear


def project(profiles: DataFrame, k: int = 50, fit_on: str = "both") -> DataFrame:
    """Project ``p`` and ``t`` of every profile on the top components.

    The basis is fitted on both sides together, or on the truth only (``fit_on="truth"``).
    """
    t = profiles.select(F.col("t").alias("v"))
    pool = t if fit_on == "truth" else t.unionByName(profiles.select(F.col("p").alias("v")))
    means = linear.column_means(pool).agg(
        F.array_sort(F.collect_list(F.struct("pos", "mean"))).alias("m")
    ).select(F.col("m.mean").alias("m")).scalar()
    shift = lambda c: F.zip_with(F.col(c), F.col("__m"), lambda a, b: a - b)
    basis, _ = linear.right_singular(
        pool.withColumn("__m", means).select(shift("v").alias("v")), k
    )

    def apply(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            for c in ("p", "t"):
                pdf[c] = list(np.stack([np.asarray(v, float) for v in pdf[c]]) @ basis)
            yield pd.DataFrame(pdf)

    rest = [c for c in profiles.columns if c not in ("p", "t")]
    ready = profiles.withColumn("__m", means).select(*rest, shift("p").alias("p"), shift("t").alias("t"))
    types = dict(ready.dtypes)
    return ready.mapInPandas(apply, ", ".join(f"{c} {types[c]}" for c in ready.columns))
