"""Hard negatives by inner product: R-trees packed by sort-tile-recursive, searched best first.

Vectors become whole numbers, so scores are exact. Distinct (label, vector) rows are dealt by ranges of
the label and the coordinates of greatest spread (the first level of tiles) into shards of bounded size;
a task packs a shard's rows, label by label, into leaves and boxes above them. A box bounds the inner
product with a query coordinate by coordinate. The search keeps a queue of boxes by upper bound and drops
those that lie outside all score windows or strictly below the k-th score found. Shards are searched in
the same way: first the one with the greatest bound, then those that can still hold something.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from deltascreen.llm.common import join_heavy, stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: Rows of a shard, and its number of shards at most (beyond that, shards grow); queries of a block.
SHARD_ROWS, MAX_SHARDS, BLOCK_QUERIES = 8192, 4096, 512
LEAF, FANOUT, TILED = 64, 16, 3
#: Largest magnitude that double precision holds exactly.
EXACT = 1 << 53


def whole_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(id, label, vec)`` with ``floor(256 * x)``; rows with a null id, label, vector or component, or a non-finite one, go.

    Of rows that share an id, the one with the least label and vector stays.
    """
    x = F.transform(vector_col, lambda v: v.cast("double"))
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    usable = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(True))
    rows = vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), x.alias("x"))
    rows = rows.select("id", F.struct("label", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("vec")).alias("row"))
    return rows.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.label", "row.vec")


@dataclass
class Tree:
    """Boxes of one label's rows: ``low``/``high`` of node i, its children ``first`` to ``end`` (rows below ``leaves``)."""

    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    end: np.ndarray
    leaves: int


def _tiles(x: np.ndarray, dims: list[int], leaf: int) -> np.ndarray:
    """Order of the rows by sort-tile-recursive: slabs by the first coordinate, each cut by the next, ..."""
    order = np.argsort(x[:, dims[0]], kind="stable")
    pages = -(-len(x) // leaf)
    if len(dims) == 1 or pages == 1:
        return order
    slabs = int(np.ceil(pages ** (1 / len(dims))))
    size = -(-pages // slabs) * leaf
    return np.concatenate([o[_tiles(x[o], dims[1:], leaf)] for o in (order[a : a + size] for a in range(0, len(x), size))])


def pack(x: np.ndarray) -> tuple[np.ndarray, Tree]:
    """Order of the rows, and the tree over rows in that order; the root is the last node."""
    dims = np.argsort(-x.std(axis=0), kind="stable")[:TILED].tolist() if x.shape[1] else []
    order = _tiles(x, dims, LEAF) if dims else np.arange(len(x))
    first = np.arange(0, len(x), LEAF)
    end = np.minimum(first + LEAF, len(x))
    low, high = np.minimum.reduceat(x[order], first, axis=0), np.maximum.reduceat(x[order], first, axis=0)
    lows, highs, firsts, ends, base = [low], [high], [first], [end], 0
    while len(lows[-1]) > 1:
        n = len(lows[-1])
        first = np.arange(0, n, FANOUT)
        lows.append(np.minimum.reduceat(lows[-1], first, axis=0))
        highs.append(np.maximum.reduceat(highs[-1], first, axis=0))
        firsts.append(base + first)
        ends.append(base + np.minimum(first + FANOUT, n))
        base += n
    return order, Tree(np.concatenate(lows), np.concatenate(highs), np.concatenate(firsts), np.concatenate(ends), len(lows[0]))


def bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of ``a`` with the points of boxes: each coordinate's interval, added up."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


class Best:
    """The first k hits of every window (least score, greatest score) by (score descending, id)."""

    def __init__(self, windows: np.ndarray, k: int):
        self.k, self.low, self.high = k, windows[:, 0].copy(), windows[:, 1]
        self.floor = self.low.copy()
        self.hits: list[list[tuple[int, int]]] = [[] for _ in windows]

    def alive(self, least, greatest) -> bool:
        return bool(((greatest >= self.floor) & (least <= self.high)).any())

    def offer(self, score: int, ids) -> None:
        for w in range(len(self.hits)):
            if self.floor[w] <= score <= self.high[w]:
                hits = sorted(self.hits[w] + [(-score, i) for i in ids])[: self.k]
                self.hits[w] = hits
                if len(hits) == self.k:
                    self.floor[w] = max(self.floor[w], -hits[-1][0])


def search(a: np.ndarray, trees: list[tuple[Tree, np.ndarray, list]], best: Best) -> None:
    """Best-first over the boxes of all ``trees`` (each with its rows in tree order and their ids)."""
    queue = []
    for t, (tree, _, _) in enumerate(trees):
        root = len(tree.low) - 1
        least, greatest = bounds(a, tree.low[root:], tree.high[root:])
        queue.append((-greatest[0], t, root, least[0]))
    heapq.heapify(queue)
    while queue:
        minus, t, node, least = heapq.heappop(queue)
        if -minus < best.floor.min():
            return
        if not best.alive(least, -minus):
            continue
        tree, x, ids = trees[t]
        low, high = tree.first[node], tree.end[node]
        if node < tree.leaves:
            scores = x[low:high] @ a
            some = np.flatnonzero((scores >= best.floor.min()) & (scores <= best.high.max()))
            for i in some[np.argsort(-scores[some], kind="stable")]:
                best.offer(int(scores[i]), ids[low + i])
            continue
        leasts, greatests = bounds(a, tree.low[low:high], tree.high[low:high])
        for i in np.flatnonzero(greatests >= best.floor.min()):
            heapq.heappush(queue, (-greatests[i], t, int(low + i), leasts[i]))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _numbers(*arrays: np.ndarray) -> list[np.ndarray]:
    """The arrays in double precision where every inner product of two of them is exact there, else as they are."""
    most = max((int(np.abs(x).max()) for x in arrays if x.size), default=0)
    exact = most * most * max(x.shape[1] for x in arrays) < EXACT
    return [x.astype(np.float64) if exact else x for x in arrays]


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """One row for each (label, vec) with its ``k`` smallest ids: no other id of it can be among the first k hits.

    The limit by row number is applied on every partition before the shuffle, so a vector that fills a
    third of the table sends k rows from each.
    """
    order = W.partitionBy("label", "vec").orderBy("id")
    first = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return first.groupBy("label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _in_shards(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct rows with their shard, and every shard's box, labels and length of vectors (one row for each shard)."""
    rows = stage(rows.withColumn("width", F.size("vec")), "distinct-vectors")
    width, n = rows.agg(F.max("width"), F.count("*")).first()
    shards = int(min(MAX_SHARDS, max(1, -(-(n or 0) // SHARD_ROWS))))
    wide = [F.try_element_at("vec", F.lit(i + 1)) for i in range(min(width or 0, 1024))]
    spread = rows.agg(*[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(wide)]).first() if wide else []
    dims = sorted(range(len(wide)), key=lambda i: -(spread[i] or 0))[:2]
    keys: list[Column | str] = ["width", "label", *[wide[i] for i in dims], F.xxhash64("vec")]
    placed = stage(rows.repartitionByRange(shards, *keys).withColumn("shard", F.spark_partition_id()), "shards")

    def box(table: pa.Table) -> pa.Table:
        out = []
        for width in np.unique(table.column("width").to_numpy()):
            own = table.filter(pa.compute.equal(table.column("width"), int(width)))
            x, label = _matrix(own.column("vec"), int(width)), own.column("label").to_numpy()
            out.append((table.column("shard")[0].as_py(), int(width), int(label.min()), int(label.max()), x.min(axis=0).tolist(), x.max(axis=0).tolist()))
        names = ["shard", "width", "least_label", "greatest_label", "low", "high"]
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    schema = "shard int, width int, least_label long, greatest_label long, low array<long>, high array<long>"
    return placed, stage(placed.groupBy("shard").applyInArrow(box, schema), "boxes")


class Shards:
    """The boxes of all shards: at most MAX_SHARDS (and one more for each other length of vectors)."""

    def __init__(self, rows):
        by_width: dict[int, list] = {}
        for r in rows:
            by_width.setdefault(r.width, []).append(r)
        self.boxes = {}
        for w, own in by_width.items():
            names = [np.array([r[c] for r in own], dtype=np.int64) for c in ("shard", "least_label", "greatest_label")]
            corners = [np.array([r[c] for r in own], dtype=np.int64).reshape(len(own), w) for c in ("low", "high")]
            most = max((int(np.abs(c).max()) for c in corners if c.size), default=0)
            self.boxes[w] = (*names, most, *corners, *(c.astype(np.float64) for c in corners))

    def visits(self, vec: np.ndarray, label: int, windows: np.ndarray, same_label: bool, first_only: bool, seen: int) -> list[int]:
        """The shard with the greatest bound, or all others that can hold a hit."""
        if len(vec) not in self.boxes or not len(windows):
            return []
        shard, least_label, greatest_label, most, *corners = self.boxes[len(vec)]
        exact = int(np.abs(vec).max(initial=0)) * most * len(vec) < EXACT
        least, greatest = bounds(vec.astype(np.float64), *corners[2:]) if exact else bounds(vec, *corners[:2])
        fits = (least_label <= label) & (label <= greatest_label) if same_label else (least_label != label) | (greatest_label != label)
        fits &= ((greatest[:, None] >= windows[:, 0]) & (least[:, None] <= windows[:, 1])).any(axis=1)
        if first_only:
            return [int(shard[np.where(fits, greatest, -np.inf).argmax()])] if fits.any() else []
        return shard[fits & (shard != seen)].tolist()


_VISIT = "query long, block int, qlabel long, qvec array<long>, windows array<array<long>>, shard int"
_HIT = "query long, low long, high long, score long, id long"


def _visits(queries: DataFrame, boxes, same_label: bool, first_only: bool) -> DataFrame:
    """The shards that queries have to visit; ``queries``: query, block, qlabel, qvec, windows, and the shard seen before (-1: none)."""

    def run(batches):
        for batch in batches:
            out = []
            for q, block, label, vec, windows, seen in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                w = np.array(windows, dtype=np.int64).reshape(-1, 3)
                for s in boxes.value.visits(np.array(vec, dtype=np.int64), label, w, same_label, first_only, seen):
                    out.append((q, block, label, vec, windows, s))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int64())), pa.int32()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query", "block", "qlabel", "qvec", "windows", "shard"])

    return queries.select("query", "block", "qlabel", "qvec", "windows", "seen").mapInArrow(run, _VISIT)


def _hits(visits: DataFrame, placed: DataFrame, same_label: bool, k: int) -> DataFrame:
    """Search every visited shard: a task takes one shard and the queries of one block that visit it."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            forests, widths = {}, right.column("width").to_numpy()
            for q, label, vec, windows in zip(*(left.column(c).to_pylist() for c in ("query", "qlabel", "qvec", "windows")), strict=True):
                if len(vec) not in forests:
                    forests[len(vec)] = _forest(right.filter(pa.array(widths == len(vec))), len(vec), left)
                forest, double = forests[len(vec)]
                trees = [forest[label]] if same_label and label in forest else [] if same_label else [t for lab, t in forest.items() if lab != label]
                best = Best(np.array(windows, dtype=np.int64).reshape(-1, 3), k)
                if trees and windows:
                    search(np.array(vec, dtype=np.float64 if double else np.int64), trees, best)
                for (_, high, low), hits in zip(windows, best.hits, strict=True):
                    out += [(q, low, high, -minus, i) for minus, i in hits]
        columns = list(zip(*out, strict=True)) if out else [[]] * 5
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query", "low", "high", "score", "id"])

    needed = stage(visits, "visits")
    pairs = needed.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
    rows = placed.join(pairs, F.col("shard") == F.col("to_shard")).select("to_shard", "to_block", "label", "vec", "ids", "width")
    return needed.groupBy("shard", "block").cogroup(rows.groupBy("to_shard", "to_block")).applyInArrow(run, _HIT)


def _forest(rows: pa.Table, width: int, queries: pa.Table):
    """For every label of a shard its tree, its rows in tree order and their ids; and whether doubles are exact."""
    x, label, ids = _matrix(rows.column("vec"), width), rows.column("label").to_numpy(), rows.column("ids").to_pylist()
    own = [np.array(v, dtype=np.int64) for v in queries.column("qvec").to_pylist() if len(v) == width]
    x = _numbers(x, np.stack(own))[0]
    forest = {}
    for lab in np.unique(label):
        mine = np.flatnonzero(label == lab)
        order, tree = pack(x[mine])
        forest[int(lab)] = tree, x[mine][order], [ids[i] for i in mine[order]]
    return forest, x.dtype == np.float64


def _top(hits: DataFrame, k: int) -> DataFrame:
    """The first k hits of every (query, window), over all shards."""
    order = W.partitionBy("query", "low", "high").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, placed: DataFrame, boxes, same_label: bool, k: int) -> DataFrame:
    """The first k hits of every query and window: ``(query, low, high, score, id, rank)``.

    ``queries``: query, block, qlabel, qvec, windows (least score, greatest score, and the least score again: it
    names the window where the first is raised). The first round visits the shard with the greatest bound
    alone; a window that it fills needs only the k-th score or better from the others.
    """
    began = stage(queries, "queries")
    first = stage(_visits(began.withColumn("seen", F.lit(-1)), boxes, same_label, True), "first-visits")
    hits = stage(_hits(first, placed, same_label, k), "first-hits")
    kth = hits.groupBy("query", "low", "high").agg(F.count("*").alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    floors = kth.groupBy("query").agg(F.map_from_entries(F.collect_list(F.struct(F.array("high", "low"), "kth"))).alias("floors"))
    rest = began.join(first.select("query", F.col("shard").alias("seen")), "query").join(floors, "query", "left")
    raised = F.transform("windows", lambda w: F.array(F.coalesce(F.try_element_at("floors", F.slice(w, 2, 2)), w[0]), w[1], w[2]))
    others = _hits(_visits(rest.withColumn("windows", raised), boxes, same_label, False), placed, same_label, k)
    return _top(hits.unionByName(others), k)


def hard_negatives(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = POSITIVES, negatives: int = NEGATIVES,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` chooses the query rows by ``id``; their positives are the first rows of their label, and a
    negative of a positive scores between 50 and 95 per cent of it. All rows are searched; only vectors as
    long as the anchor's are compared. Scores are 64-bit whole numbers. Rows without a usable
    id, label or vector take no part, and rows that share an id are one (see ``whole_vectors``). Other columns
    are ignored; no anchors give no rows.
    """
    rows = stage(whole_vectors(vectors, id_col, vector_col, label_col), "whole-vectors")
    return mine(rows, anchors, positives, negatives)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """``hard_negatives`` of ``(id, label, vec)`` rows that are stored."""
    spark = rows.sparkSession
    placed, box_rows = _in_shards(_first_ids(rows, positives + 1))
    boxes = spark.sparkContext.broadcast(Shards(box_rows.collect()))
    asking = stage(rows.where(anchors), "anchors")
    # Anchors of one label and vector ask once, for one positive more: each then leaves itself out.
    distinct = stage(asking.select("label", "vec").distinct(), "distinct-anchors")
    blocks = max(1, -(-distinct.count() // BLOCK_QUERIES))
    lead = [F.try_element_at("vec", F.lit(1)), F.xxhash64("vec")]
    numbered = distinct.repartitionByRange(blocks, "label", *lead).withColumns({"block": F.spark_partition_id(), "query": F.monotonically_increasing_id()})
    queries = stage(numbered.withColumnsRenamed({"label": "qlabel", "vec": "qvec"}), "numbered-anchors")
    whole = F.array(F.array(F.lit(-(1 << 62)), F.lit(1 << 62), F.lit(-(1 << 62))))
    found = stage(nearest(queries.withColumn("windows", whole), placed, boxes, True, positives + 1).select("query", "score", "id"), "positives")
    low, high = F.expr("score div 2 + score % 2"), F.expr("score div 100 * 95 + score % 100 * 95 div 100")  # a score below 0 has no window
    windows = found.where("score >= 0").select("query", F.array(low, high, low).alias("w")).where(F.col("w")[0] <= F.col("w")[1]).distinct()
    windows = windows.groupBy("query").agg(F.collect_list("w").alias("windows"))
    hard = nearest(queries.join(windows, "query"), placed, boxes, False, negatives)
    hard = hard.groupBy("query", "low", "high").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("negatives"))
    near = found.withColumns({"low": low, "high": high}).join(hard, ["query", "low", "high"], "left")
    near = near.groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id", "negatives"))).alias("near"))
    answers = queries.join(near, "query").select(F.xxhash64("qlabel", "qvec").alias("asked"), "qlabel", "qvec", "near")
    answers = answers.groupBy("asked").agg(F.collect_list(F.struct("qlabel", "qvec", "near")).alias("answers"))
    own = join_heavy(asking.withColumn("asked", F.xxhash64("label", "vec")), stage(answers, "answers"), "asked")
    mine_ = F.filter("answers", lambda a: (a["qlabel"] == F.col("label")) & (a["qvec"] == F.col("vec")))[0]["near"]
    others = F.slice(F.filter(mine_, lambda p: ~p["id"].eqNullSafe(F.col("id"))), 1, positives)
    flat = own.select(F.col("id").alias("anchor_id"), F.explode(others).alias("p"))
    flat = flat.select("anchor_id", F.col("p.id").alias("positive_id"), (-F.col("p.minus")).alias("positive_score"), F.explode("p.negatives").alias("n"))
    return flat.select("anchor_id", "positive_id", F.col("n.rank").alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", F.col("n.score").alias("negative_score"))


#: DuckDB statement for the same rows, with every anchor scored against all rows.
ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM usable a JOIN usable b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor_id, id, score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, (row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id))::INTEGER AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id) <= 3
"""
