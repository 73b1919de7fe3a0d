"""All-against-all comparisons by blocks.

Profiles are hashed into tiles of bounded memory; every pair of tiles meets in one task, which
multiplies small matrices block by block and returns one partial row per profile. Pairs themselves
are never emitted, and no task holds more than two tiles. A profile is sent once per tile of the
other side, so tiles are as large as a task can hold, whatever the size of the blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are multiplied at a time.
BLOCK = 512
#: Values (8 bytes each) that a tile holds on each side.
TILE = 1 << 20
#: Similarities that a kernel holds at a time.
PAIRS = 1 << 20
TOL = 1e-9
#: Folds that one word of a bit set holds.
FOLD_BITS = 62


def pack(table: DataFrame, keys: list[str], values: dict[str, str], axis: str = "gene") -> DataFrame:
    """One row per profile with value arrays ordered by the feature axis.

    Profiles are compared place by place, so the job fails unless all of them hold the same features.
    """
    entries = F.array_sort(F.collect_list(F.struct(axis, *values)))
    packed = table.groupBy(*keys).agg(entries.alias("__e"))
    # every profile's features against those of the whole table, by an order-free digest
    place = F.pmod(F.xxhash64(axis), F.lit(1 << 40))
    whole = table.select(axis).distinct().agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum(place).alias("mark"))).scalar()
    mark = F.aggregate(f"__e.{axis}", F.lit(0).cast("bigint"), lambda a, g: a + F.pmod(F.xxhash64(g), F.lit(1 << 40)))
    own = F.struct(F.size("__e").cast("bigint").alias("n"), mark.alias("mark"))
    bad = F.raise_error(F.lit("profiles hold different features"))
    arrays = {
        out: F.when(own == whole, F.col(f"__e.{col}")).otherwise(bad.cast(f"array<{dict(table.dtypes)[col]}>"))
        for col, out in values.items()
    }
    return packed.withColumns(arrays).drop("__e")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def _once(value: Column, fn) -> Column:
    """``fn(value)`` with the value worked out once: inside a lambda function it would be for every element."""
    return F.transform(F.array(value), fn)[0]


def unit(a: Column) -> Column:
    return _once(F.sqrt(dot(a, a)) + F.lit(1e-8), lambda norm: F.transform(a, lambda x: x / norm))


def centred(a: Column) -> Column:
    mean = F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v) / F.size(a)
    return _once(mean, lambda m: F.transform(a, lambda x: x - m))


def fold_bits(n_folds: int, number: Column, marked: Column | bool = True) -> Column:
    """Aggregate: the set of the fold numbers of the marked rows, as words of ``FOLD_BITS`` bits."""
    word, bit = F.floor(number / FOLD_BITS), F.lit(1).cast("bigint")
    marked = F.lit(marked) if isinstance(marked, bool) else marked
    one = F.call_function("shiftleft", bit, (number % FOLD_BITS).cast("int"))
    words = range(max(1, -(-n_folds // FOLD_BITS)))
    return F.array(*[F.coalesce(F.bit_or(F.when(marked & (word == w), one)), F.lit(0).cast("bigint")) for w in words])


def _blocked(df: DataFrame, group: list[str], size: int, tile: int) -> tuple[DataFrame, DataFrame]:
    arrays = [c for c, t in df.dtypes if t.startswith("array<")]
    width = F.greatest(F.lit(1), F.max(sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(0))))
    n, rows = F.count(F.lit(1)), F.greatest(F.lit(size), F.floor(F.lit(tile) / width))
    # a few tiles even where one would do, so that a small group is not one task
    n_tiles = F.greatest(F.ceil(n / rows), F.least(F.ceil(n / size), F.lit(4)))
    n_blocks = df.groupBy(*group).agg(n_tiles.cast("int").alias("__nb"))
    marked = df.join(n_blocks, group).withColumn("__b", F.pmod(F.xxhash64("id"), F.col("__nb")).cast("int"))
    return marked.drop("__nb"), n_blocks


def block_join(
    left: DataFrame, right: DataFrame, group: list[str], fn, schema: str, size: int = BLOCK, tile: int = TILE,
) -> DataFrame:
    """Run ``fn(left_tile, right_tile) -> rows`` for every pair of tiles of a group.

    A tile has ``size`` rows at least, and more while its arrays hold no more than ``tile`` values.
    """
    l, n_left = _blocked(left, group, size, tile)
    r, n_right = _blocked(right, group, size, tile)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    l = l.withColumnRenamed("__b", "__lb").join(n_right, group).withColumn("__rb", every(F.col("__nb")))
    r = r.withColumnRenamed("__b", "__rb").join(n_left, group).withColumn("__lb", every(F.col("__nb")))
    # fresh column identities: both sides may come from one table
    r = r.select(*[F.col(c).alias(c) for c in r.columns])
    keys = [*group, "__lb", "__rb"]
    columns = [c.strip().split()[0] for c in schema.split(",")]

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=columns)
        out = fn(a, b)
        for g in group:
            out[g] = a[g].iloc[0]
        return out[columns]

    return l.drop("__nb").groupBy(*keys).cogroup(r.drop("__nb").groupBy(*keys)).applyInPandas(run, schema)


def by_blocks(fn, size: int = BLOCK):
    """``fn`` on every pair of blocks of ``size`` rows of two tiles, for kernels whose rows are merged behind the join."""
    parts = lambda df: [df.iloc[i:i + size] for i in range(0, len(df), size)]

    def kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([fn(x, y) for x in parts(a) for y in parts(b)], ignore_index=True)

    return kernel


def _slices(n: int, other: int, most: int = PAIRS) -> list[slice]:
    """Slices of ``n`` rows that hold ``most`` pairs with ``other`` rows at most."""
    step = max(1, most // max(1, other))
    return [slice(i, i + step) for i in range(0, n, step)]


def _matrix(series: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in series])


def rank_kernel(preds: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Per target: other predictions more similar than its own, and as similar."""
    p, t = _matrix(preds["v"]), _matrix(targets["v"])
    names, ids = _codes(preds["id"], targets["id"])
    shared = np.isin(ids, names)
    own = targets["own"].to_numpy(float)
    better, equal = np.zeros(len(t), dtype=np.int64), np.zeros(len(t), dtype=np.int64)
    for rows in _slices(len(t), len(p)):
        gap = t[rows] @ p.T
        gap -= own[rows, None]
        if shared[rows].any():
            gap[ids[rows, None] == names[None, :]] = -np.inf
        better[rows] = np.count_nonzero(gap > TOL, axis=1)
        equal[rows] = np.count_nonzero(gap >= -TOL, axis=1) - better[rows]
    return pd.DataFrame({"id": targets["id"].to_numpy(), "better": better, "equal": equal})


def _codes(a: pd.Series, b: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Names of both sides as whole numbers in the order of the names."""
    codes = np.unique(np.concatenate([a.to_numpy(object), b.to_numpy(object)]), return_inverse=True)[1]
    return codes[:len(a)], codes[len(a):]


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str = "l2") -> np.ndarray:
    """Distances of the listed pairs from their differences, a bounded number at a time."""
    step = max(1, PAIRS // max(1, x.shape[1]))
    length = (lambda e: np.sqrt((e * e).sum(1))) if metric == "l2" else (lambda e: np.abs(e).sum(1))
    parts = [length(x[i[k:k + step]] - y[j[k:k + step]]) for k in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


def _squares(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by one product, and the largest sum of two squared lengths: what rounding is relative to."""
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    left = np.column_stack([-2.0 * x, xx, np.ones(len(x))])
    return left @ np.column_stack([y, np.ones(len(y)), yy]).T, float(xx.max() + yy.max())


def _l2(x: np.ndarray, y: np.ndarray, near: float = 1e-4) -> np.ndarray:
    """Euclidean distances; pairs that lie close for their lengths are taken from their differences."""
    d, size = _squares(x, y)
    if d.min() > near * size:
        return np.sqrt(d, out=d)
    i, j = np.nonzero(~(d > near * size))
    np.sqrt(np.maximum(d, 0.0, out=d), out=d)
    d[i, j] = _exact(x, y, i, j)
    return d


def _scaled(x: np.ndarray, metric: str) -> np.ndarray:
    x = np.sign(x) if metric == "sign_cosine" else x
    return x / (np.sqrt((x * x).sum(1)) + 1e-8)[:, None]


def _near(x: np.ndarray, y: np.ndarray, own: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs that are not farther than the row's own distance (and some more), with their exact distances.

    One product bounds every distance from below; only pairs within the bound are looked at feature by feature.
    """
    if "cosine" in metric:
        d = 1.0 - x @ y.T
        i, j = np.nonzero(d <= (own + TOL)[:, None])
        return i, j, d[i, j]
    if metric == "l2":
        low, size = _squares(x, y)
        limit = (own + TOL) ** 2 + 1e-15 * (x.shape[1] + 8) * size
    else:
        # |x - y| >= |y| - sign(y) x, summed over the features
        length = np.abs(y).sum(1)
        low = length[None, :] - x @ np.sign(y).T
        limit = own + TOL + 1e-15 * (x.shape[1] + 8) * (length.max() + np.abs(x).sum(1))
    i, j = np.nonzero(low <= limit[:, None])
    return i, j, _exact(x, y, i, j, metric)


def nearest_kernel(metrics: list[str]):
    """Kernel for several metrics at once; ``own`` holds a prediction's distance from its own target for each of them."""

    def kernel(preds: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
        """Per prediction and metric: whether some target would be preferred to its own.

        A prediction that is beaten in one block meets no further one.
        """
        mine, theirs = _codes(preds["id"], targets["id"])
        p, t, owns = _matrix(preds["v"]), _matrix(targets["v"]), _matrix(preds["own"])
        out = {"id": preds["id"].to_numpy()}
        for m, metric in enumerate(metrics):
            x, y = (_scaled(p, metric), _scaled(t, metric)) if "cosine" in metric else (p, t)
            beaten = np.zeros(len(x), dtype=bool)
            for columns in _slices(len(y), 1, BLOCK):
                left = np.flatnonzero(~beaten)
                for part in _slices(len(left), 1, BLOCK):
                    rows = left[part]
                    i, j, d = _near(x[rows], y[columns], owns[rows, m], metric)
                    gap, a, b = d - owns[rows[i], m], mine[rows[i]], theirs[columns][j]
                    beaten[rows[i[(gap < -TOL) & (a != b) | (gap <= TOL) & (b < a)]]] = True
            out[f"beats_{metric}"] = beaten.astype(np.int64)
        return pd.DataFrame(out)

    return kernel


def energy_kernel(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Sums of 2|p-t| - |p-p'| - |t-t'| over all pairs of the two tiles."""
    p, q, t, u = _matrix(a["p"]), _matrix(b["p"]), _matrix(a["t"]), _matrix(b["t"])
    total = 0.0
    for rows in _slices(len(p), 1, BLOCK):
        for other in _slices(len(q), 1, BLOCK):
            total += 2.0 * _l2(p[rows], u[other]).sum() - _l2(p[rows], q[other]).sum() - _l2(t[rows], u[other]).sum()
    return pd.DataFrame({"total": [float(total)]})


def correlation_kernel(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Per query: its most correlated reference in this tile (smallest name on ties)."""
    order = np.argsort(refs["id"].to_numpy(), kind="stable")
    names, r, q = refs["id"].to_numpy()[order], _matrix(refs["v"])[order], _matrix(queries["v"])
    qq, rr = (q * q).sum(1), (r * r).sum(1)
    best, top = np.empty(len(q), dtype=np.int64), np.empty(len(q))
    for rows in _slices(len(q), len(r), PAIRS // 4):
        sim = q[rows] @ r.T
        sim /= np.sqrt(qq[rows, None] * rr[None, :] + 1e-8)
        # rounding keeps the order, so only what lies near the best can share its rounded value
        highest = sim.max(1)
        close = sim >= highest[:, None] - 2e-9
        several = close.sum(1) > 1
        at = sim.argmax(1)
        for i in np.flatnonzero(several):
            j = np.flatnonzero(close[i])
            at[i] = j[np.round(sim[i, j], 9).argmax()]
        best[rows], top[rows] = at, sim[np.arange(len(at)), at]
    return pd.DataFrame({"id": queries["id"].to_numpy(), "ref": names[best], "sim": top})


def masked_correlation_kernel(queries: pd.DataFrame, refs: pd.DataFrame) -> pd.DataFrame:
    """Best references of this block for every set of folds: the similarities are computed once, whatever the number of folds.

    Queries hold ``own`` and ``wide``, bit sets of the folds in which references of the same place (``place``)
    or of any place may be chosen; references hold ``fits``, the folds that they are known in. Returns one row
    per query and chosen reference, with the numbers of the folds (smallest name on ties).
    """
    order = np.argsort(refs["id"].to_numpy(), kind="stable")
    names = refs["id"].to_numpy()[order]
    r, q = _matrix(refs["v"])[order], _matrix(queries["v"])
    den = np.sqrt((q * q).sum(1)[:, None] * (r * r).sum(1)[None, :] + 1e-8)
    sim = np.round(q @ r.T / den, 9)
    same = queries["place"].to_numpy()[:, None] == refs["place"].to_numpy()[order][None, :]
    bits = lambda df, c: np.stack([np.asarray(v, dtype=np.int64) for v in df[c]])
    own, wide, fits = bits(queries, "own"), bits(queries, "wide"), bits(refs, "fits")[order]
    chosen: dict[tuple[int, int], list[int]] = {}
    for fold in range(FOLD_BITS * fits.shape[1]):
        word, bit = fold // FOLD_BITS, np.int64(1) << np.int64(fold % FOLD_BITS)
        columns = np.flatnonzero(fits[:, word] & bit)
        rows = np.flatnonzero((own[:, word] | wide[:, word]) & bit)
        if not len(columns) or not len(rows):
            continue
        part = sim[np.ix_(rows, columns)]
        narrow = (own[rows, word] & bit) != 0
        allowed = same[np.ix_(rows, columns)] | ~narrow[:, None]
        part = np.where(allowed, part, -np.inf)
        at = part.argmax(1)
        for i in np.flatnonzero(allowed.any(1)):
            chosen.setdefault((int(rows[i]), int(columns[at[i]])), []).append(fold)
    ids = queries["id"].to_numpy()
    return pd.DataFrame(
        [(ids[i], names[j], float(sim[i, j]), folds) for (i, j), folds in chosen.items()], columns=["id", "ref", "sim", "folds"]
    )
