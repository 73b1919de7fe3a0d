"""Embedding near-duplicates over robust-pruned flat graphs of overlapping cluster shards.

Equal vectors of a label are one class and are compared once. Classes go to the ``OVERLAP`` nearest
of the cluster centres of their label; a cluster is a shard, cut into chunks of bounded size by hash.
Each chunk gets a flat graph whose edges are robust-pruned: a near neighbour is dropped when a kept
one is much nearer to it. The adjacency lists of a class from all its shards are united. Chunks of a
shard meet in pairs: every class of one searches the graph of the other greedily from its medoid,
then expands everything within range. Links are the visited pairs whose cosine in double precision
reaches the threshold; nothing else is compared. A link whose ends share one shard is counted where
it is found. One whose ends share several may be found in each of them: it is written as a row, rows
of a pair are made one, and count after that, so any of the shards may find it. An audit compares one
class in ``AUDITED`` with all others; the search widens while it misses too much or the audit saw no
link, and fails when the widest one still misses too much.
"""

from __future__ import annotations

import math
import warnings
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import join_heavy, stage
from deltascreen.llm.components import connected_components, forest

THRESHOLD = 0.93
#: Classes that a cluster has on average, and that a chunk has; clusters and sampled classes at most.
CLUSTER, CHUNK, MAX_CLUSTERS, SAMPLE = 768, 2048, 4096, 40_000
#: Numbers that the sampled classes have together at most.
SAMPLE_CELLS = 1 << 23
#: Neighbours of a node, near and far candidates for them, and the slack with which a near one replaces a far one.
DEGREE, CANDIDATES, FAR, ALPHA = 16, 64, 32, 1.2
#: Nodes that a greedy search keeps, the part of them that it expands at once, and how far below the threshold the range search goes on.
BEAM, STEP, SLACK = 32, 8, 0.05
#: Queries that search at once, and what single precision may err by on the way (links are taken in double).
QUERIES, ERROR = 512, 1e-4
#: Shards of a class in the first attempt and in the next ones, mean share of a class's links wanted.
OVERLAP, RECALL = (2, 4, 8), 0.97
#: One class in so many is in the audit, more where that makes too few; classes that are compared at once.
AUDITED, AUDITED_LEAST, AUDIT_BLOCK = 50, 1024, 4096
SEED = 5
#: Numbers that a step of the search gathers at once.
CELLS = 1 << 20


def _unit(rows) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column) -> np.ndarray:
    """Unit vectors of an Arrow list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1))


def classes(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """One row for each different comparable vector of a label: class, space, vector, least id, n.

    ``space`` is the label and the number of components: only classes of one space are compared.
    """
    sound = ~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("vector", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & sound)
    found = rows.groupBy("label", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    space = F.concat_ws(":", F.size("vector").cast("string"), "label")
    return found.select(F.monotonically_increasing_id().alias("class"), space.alias("space"), "label", "vector", "least", "n")


def _centres(every: DataFrame) -> dict[str, np.ndarray]:
    """Cluster centres of each space, from a sample of at most ``SAMPLE`` classes (lowest hashes)."""
    sizes = {r.space: r["count"] for r in every.groupBy("space").count().orderBy(F.desc("count"), "space").limit(MAX_CLUSTERS).collect()}
    longest = every.agg(F.max(F.size("vector"))).first()[0] or 1
    limit = max(1, min(SAMPLE, SAMPLE_CELLS // longest))
    sample = every.orderBy(F.xxhash64("class")).limit(limit).select("space", "vector").toArrow()
    space_of = np.array(sample.column("space").to_pylist(), dtype=object)
    total, rng, centres = sum(sizes.values()), np.random.default_rng(SEED), {}
    for space, size in sizes.items():
        own = np.flatnonzero(space_of == space)
        k = min(len(own) // 4, max(1, math.ceil(size / CLUSTER)), max(1, MAX_CLUSTERS * size // total))
        if k < 2:
            continue
        x = _matrix(sample.column("vector").take(pa.array(own)))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(10):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
        centres[space] = c
    return centres


def _members(every: DataFrame, centres: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """``every`` with ``shards``: the numbers of the nearest clusters of its space, in ascending order."""
    shared = every.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            spaces = batch.column(1).to_pylist()
            shards: list[list[int]] = [[0]] * len(spaces)
            for space in set(spaces) & shared.value.keys():
                at = [i for i, s in enumerate(spaces) if s == space]
                c = shared.value[space]
                near = np.argsort(-(_matrix(batch.column(2).take(pa.array(at))) @ c.T), axis=1, kind="stable")[:, : min(overlap, len(c))]
                for i, own in zip(at, np.sort(near, axis=1), strict=True):
                    shards[i] = own.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int32()))], names=["class", "space", "vector", "n", "shards"])

    rows = every.select("class", "space", "vector", "n")
    return rows.mapInArrow(run, "class long, space string, vector array<double>, n long, shards array<int>")


def robust_prune(x: np.ndarray) -> list[np.ndarray]:
    """Neighbours of every row of ``x``: near first, but not those much nearer to a kept one."""
    n = len(x)
    width = min(CANDIDATES, n - 1)
    if width <= 0:
        return [np.zeros(0, dtype=np.int64) for _ in range(n)]
    x = x.astype(np.float32)
    likeness = x @ x.T
    np.fill_diagonal(likeness, -2)
    some = [likeness[at : at + QUERIES] for at in range(0, n, QUERIES)]
    near = np.concatenate([np.argpartition(-part, width - 1, axis=1)[:, :width] for part in some])
    # far candidates keep dense groups joined to each other and to the rest
    other = np.random.default_rng(SEED).integers(1, n, (n, FAR))
    near = np.concatenate([near, (np.arange(n)[:, None] + other) % n], axis=1)
    near = np.take_along_axis(near, np.argsort(-np.take_along_axis(likeness, near, axis=1), axis=1, kind="stable"), axis=1)
    far = 1 - np.take_along_axis(likeness, near, axis=1)
    open_ = np.ones_like(near, dtype=bool)
    kept: list[list[int]] = [[] for _ in range(n)]
    rows = np.arange(n)
    for _ in range(DEGREE):
        pick = open_.argmax(axis=1)
        live = open_[rows, pick]
        if not live.any():
            break
        chosen = near[rows, pick]
        for i in np.flatnonzero(live):
            kept[i].append(int(chosen[i]))
        open_[rows, pick] = False
        between = 1 - likeness[chosen[:, None], near]
        open_ &= ~(live[:, None] & (ALPHA * between <= far))
    linked: list[set[int]] = [{*k, *near[i, : max(0, DEGREE // 2 - len(k))].tolist()} for i, k in enumerate(kept)]
    for i, own in enumerate([sorted(s) for s in linked]):  # both ways, so that every node can be reached
        for j in own:
            linked[j].add(i)
    return [np.array(sorted(s), dtype=np.int64) for s in linked]


def _graphs(chunks: DataFrame) -> DataFrame:
    """``(class, neighbours)`` of every chunk's own graph."""

    def run(table):
        ids = table.column("class").to_numpy()
        order = np.argsort(ids)
        lists = robust_prune(_matrix(table.column("vector"))[order])
        return pa.table({"class": ids[order], "neighbours": pa.array([ids[order][j] for j in lists], pa.list_(pa.int64()))})

    return chunks.groupBy("space", "shard", "chunk").applyInArrow(run, "class long, neighbours array<long>")


class Graph:
    """Nodes with unit vectors ``x`` and, one after the other, the neighbours of each."""

    def __init__(self, x: np.ndarray, owner: np.ndarray, heads: np.ndarray):
        self.x, self.heads = x.astype(np.float32), heads
        self.width = np.bincount(owner, minlength=len(x))
        self.begin = np.cumsum(self.width) - self.width
        self.medoid = int((self.x @ self.x.mean(axis=0)).argmax()) if len(x) else 0

    @classmethod
    def of(cls, x: np.ndarray, ids: np.ndarray, lists) -> Graph:
        """From an Arrow column of neighbours of the sorted ``ids``; neighbours that are not there are left out."""
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        heads, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
        place = np.minimum(np.searchsorted(ids, heads), len(ids) - 1)
        known = ids[place] == heads
        return cls(x, np.repeat(np.arange(len(ids)), sizes)[known], place[known])

    def search(self, queries: np.ndarray, threshold: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, node)`` of all visited pairs whose cosine is about ``threshold`` or more."""
        parts = [self._search(queries[at : at + QUERIES].astype(np.float32), threshold, beam) for at in range(0, len(queries), QUERIES)]
        q = [at + p // len(self.x) for at, p in zip(range(0, len(queries), QUERIES), parts, strict=True)]
        return np.concatenate(q), np.concatenate(parts) % len(self.x)

    def _search(self, queries: np.ndarray, threshold: float, beam: int) -> np.ndarray:
        """Greedy from the medoid, then everything in range; a pair is the number ``query * nodes + node``."""
        n, count, low = len(self.x), len(queries), threshold - SLACK
        seen, done = np.zeros(count * n, dtype=bool), np.zeros(count * n, dtype=bool)

        def cosines(code: np.ndarray) -> np.ndarray:
            out, step = np.empty(len(code), dtype=np.float32), max(1, CELLS // self.x.shape[1])
            for at in range(0, len(code), step):
                q, node = np.divmod(code[at : at + step], n)
                out[at : at + step] = np.einsum("ij,ij->i", queries[q], self.x[node])
            return out

        def unseen(code: np.ndarray) -> np.ndarray:
            """Neighbours of these pairs' nodes that their queries have not seen, each once, in order."""
            done[code] = True
            q, node = np.divmod(code, n)
            size, out = self.width[node], [np.zeros(0, dtype=np.int64)]
            part = (np.cumsum(size) - size) // CELLS
            cut = np.r_[np.flatnonzero(np.diff(part, prepend=-1)), len(code)]
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                own = size[a:b]
                at = np.arange(own.sum()) + np.repeat(self.begin[node[a:b]] - np.cumsum(own) + own, own)
                new = np.repeat(q[a:b] * n, own) + self.heads[at]
                new = np.sort(new[~seen[new]])
                new = new[np.diff(new, prepend=-1) != 0]
                seen[new] = True
                out.append(new)
            return np.sort(np.concatenate(out))

        step, code = max(1, beam // STEP), np.arange(count) * n + self.medoid
        seen[code] = True
        score = cosines(code)
        pool, value = code[:, None], score[:, None]
        near, reached = [code[score >= low]], [score[score >= low]]
        while True:
            wait = np.where(done[pool] | (value == -np.inf), -np.inf, value)
            if wait.shape[1] > step:
                pick = np.argpartition(-wait, step - 1, axis=1)[:, :step]
                wait, chosen = np.take_along_axis(wait, pick, axis=1), np.take_along_axis(pool, pick, axis=1)
            else:
                chosen = pool
            front = chosen[wait > -np.inf]
            if not len(front):
                break
            code = unseen(front)
            score = cosines(code)
            near.append(code[score >= low])
            reached.append(score[score >= low])
            q = code // n
            place = np.arange(len(q)) - np.searchsorted(q, q)
            more = np.zeros((count, place.max(initial=-1) + 1), dtype=np.int64)
            worth = np.full(more.shape, -np.inf, dtype=np.float32)
            more[q, place], worth[q, place] = code, score
            pool, value = np.concatenate([pool, more], axis=1), np.concatenate([value, worth], axis=1)
            if pool.shape[1] > beam:
                best = np.argpartition(-value, beam - 1, axis=1)[:, :beam]
                pool, value = np.take_along_axis(pool, best, axis=1), np.take_along_axis(value, best, axis=1)
        front = np.concatenate(near)
        front = front[~done[front]]
        while len(front):
            code = unseen(front)
            score = cosines(code)
            front = code[score >= low]
            near.append(front)
            reached.append(score[score >= low])
        return np.concatenate(near)[np.concatenate(reached) >= threshold - ERROR]


def _table(shards: list) -> np.ndarray:
    """Lists of shards as rows of one width, filled with -1."""
    out = np.full((len(shards), max(map(len, shards), default=1)), -1)
    for i, own in enumerate(shards):
        out[i, : len(own)] = own
    return out


def shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of shards that each row of ``left`` shares with the same row of ``right`` (see ``_table``)."""
    return sum((left == np.where(right[:, [k]] < 0, -2, right[:, [k]])).any(axis=1).astype(int) for k in range(right.shape[1]))


def _found(key, table, threshold: float, beam: int):
    """Links between the chunks of a group: a star for each linked group, and a row for each pair to be made one."""
    sides = []
    for c in sorted(set(table.column("chunk").to_pylist())):
        own = table.filter(pa.array(table.column("chunk").to_numpy() == c)).sort_by("class")
        ids, x = own.column("class").to_numpy(), _matrix(own.column("vector"))
        sides.append((ids, x, Graph.of(x, ids, own.column("neighbours")), own.column("n").to_numpy(), _table(own.column("shards").to_pylist())))
    if key[2].as_py() != key[3].as_py() and len(sides) < 2:
        return None
    (ids, x, graph, n, shards), (ids2, x2, graph2, n2, shards2) = sides[0], sides[-1]
    a, b = graph2.search(x, threshold, beam)
    if len(sides) == 1:
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
    else:
        back = graph.search(x2, threshold, beam)
        a, b = np.r_[a, back[1]], np.r_[b, back[0]]
    a, b = np.divmod(np.unique(a * len(ids2) + b), len(ids2))
    step = max(1, CELLS // x.shape[1])
    true = [np.einsum("ij,ij->i", x[a[k : k + step]], x2[b[k : k + step]]) >= threshold for k in range(0, len(a), step)]
    true = np.concatenate([np.zeros(0, dtype=bool), *true])
    a, b = a[true], b[true]
    every = np.unique(np.concatenate([ids, ids2]))
    left, right = np.searchsorted(every, ids[a]), np.searchsorted(every, ids2[b])
    root = every[forest(len(every), left, right)]
    several = shared(shards[a], shards2[b]) > 1
    alone = ~several
    links = np.bincount(left[alone], weights=n2[b[alone]], minlength=len(every)) + np.bincount(right[alone], weights=n[a[alone]], minlength=len(every))
    some = np.union1d(left, right)
    # the smaller class comes first: chunks lie the other way round in other shards
    pair = np.array([ids[a[several]], n2[b[several]], ids2[b[several]], n[a[several]]]).reshape(4, -1)
    turned = pair[0] > pair[2]
    pair[:, turned] = pair[[2, 3, 0, 1]][:, turned]
    return (
        np.r_[every[some], pair[0]], np.r_[links[some].astype(np.int64), pair[1]], np.r_[root[some], root[left[several]]],
        np.r_[np.full(len(some), -1), pair[2]], np.r_[np.zeros(len(some), dtype=np.int64), pair[3]],
    )


FOUND = "class long, links long, root long, other long, back long"


def _meet(pairs: DataFrame, threshold: float, beam: int) -> DataFrame:
    """``(class, root, links)`` of the links between the chunks; a class may have several roots."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(key, table):
        columns = _found(key, table, threshold, beam)
        return pa.table([pa.array([] if columns is None else columns[i], pa.int64()) for i in range(5)], names=names)

    found = stage(pairs.groupBy("space", "shard", "first", "second").applyInArrow(run, FOUND), "embedding-found")
    once = found.where("other >= 0").groupBy("class", "other").agg(*(F.min(c).alias(c) for c in ("links", "root", "back")))
    stars = found.where("other < 0").select("class", "links", "root")
    both = F.explode(F.array(F.struct("class", "links"), F.struct(F.col("other").alias("class"), F.col("back").alias("links")))).alias("end")
    ends = once.select("root", both).select("end.class", "end.links", "root")
    return stars.unionByName(ends).groupBy("class", "root").agg(F.sum("links").alias("links"))


def _links(every: DataFrame, centres: dict, overlap: int, threshold: float) -> DataFrame:
    members = stage(_members(every, centres, overlap), "embedding-members")
    rows = members.withColumn("shard", F.explode("shards"))
    count = rows.groupBy("space", "shard").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    rows = rows.join(count, ["space", "shard"]).withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("chunks").cast("long")).cast("int"))
    rows = stage(rows, "embedding-chunks")
    graph = _graphs(rows.select("space", "shard", "chunk", "class", "vector"))
    graph = stage(graph.groupBy("class").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "embedding-graph")
    ends = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.struct(F.least("chunk", c).alias("first"), F.greatest("chunk", c).alias("second")))
    pairs = rows.join(graph, "class").withColumn("ends", F.explode(ends))
    pairs = pairs.select("space", "shard", "ends.first", "ends.second", "chunk", "class", "vector", "n", "shards", "neighbours")
    return stage(_meet(pairs, threshold, BEAM * overlap // OVERLAP[0]), "embedding-links")


def true_links(every: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
    """``(class, all)``: links of the audited classes (a sample by hash) with all others; whether all are audited."""
    total = every.count()
    one_in = max(1, min(AUDITED, total // AUDITED_LEAST))
    parts = max(1, math.ceil(total / one_in / AUDIT_BLOCK))
    part = F.pmod(F.xxhash64("class", F.lit(1)), F.lit(one_in * parts).cast("long"))
    blocks = [_block_links(every, every.where(part == k), threshold) for k in range(parts)]
    return reduce(DataFrame.unionByName, blocks), one_in == 1


def _block_links(every: DataFrame, block: DataFrame, threshold: float) -> DataFrame:
    sample = block.select("class", "space", "vector").collect()
    of_space: dict[str, list] = {}
    for r in sample:
        of_space.setdefault(r.space, []).append(r)
    spaces = {s: (np.array([r["class"] for r in own]), _unit([r.vector for r in own])) for s, own in of_space.items()}
    shared = every.sparkSession.sparkContext.broadcast(spaces)

    def run(batches):
        links = {s: np.zeros(len(asked), dtype=np.int64) for s, (asked, _) in shared.value.items()}
        for batch in batches:
            space, n = np.array(batch.column(1).to_pylist(), dtype=object), batch.column(3).to_numpy()
            ids, vectors = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for s in set(space) & shared.value.keys():
                asked, x = shared.value[s]
                at = np.flatnonzero(space == s)
                step = max(1, CELLS // len(asked))
                for some in (at[k : k + step] for k in range(0, len(at), step)):
                    near = (x @ _unit([vectors[i] for i in some]).T >= threshold) & (asked[:, None] != ids[some][None, :])
                    links[s] += near @ n[some]
        for s, (asked, _) in shared.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(links[s])], names=["class", "links"])

    partial = every.select("class", "space", "vector", "n").mapInArrow(run, "class long, links long")
    return stage(partial.groupBy("class").agg(F.sum("links").alias("all")), "embedding-audit")


def audit(true: DataFrame, links: DataFrame) -> float | None:
    """Mean share of its links that an audited class has found, over those with links; None without any.

    Each class counts alike, so a large group of near copies can't hide what sparse pairs miss.
    """
    own = links.groupBy("class").agg(F.sum("links").alias("found"))
    share = F.least(F.coalesce("found", F.lit(0)), F.col("all")) / F.col("all")
    return true.where(F.col("all") > 0).join(own, "class", "left").agg(F.avg(share)).first()[0]


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD,
) -> DataFrame:
    """One row for each row of ``vectors``: id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine is ``threshold`` or more. A null label,
    a vector that is null, empty or zero, or one with null or non-finite components links with
    nothing; vectors of different lengths do not link. Equal vectors are links of each other. A null
    id is never the smallest of a component. Rows that repeat an id come back each. Other columns are
    ignored; an empty table gives an empty result. Raises when the widest search misses the recall;
    warns when it could not be measured because no audited class has a link.
    """
    every = stage(classes(vectors, id_col, vector_col, label_col), "embedding-classes")
    centres = _centres(every)
    true, whole = true_links(every, threshold)
    for overlap in OVERLAP:
        links = _links(every, centres, overlap, threshold)
        recall = audit(true, links)
        if recall is None and whole:  # there are no links to miss
            recall = 1.0
        if recall is not None and recall >= RECALL:
            break
    else:
        if recall is not None:
            raise RuntimeError(f"recall {recall:.4f} of the links is below {RECALL} with {OVERLAP[-1]} shards a class")
        warnings.warn("no audited class has a link: the recall is not measured", stacklevel=2)
    part = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")))
    total = links.groupBy("class").agg(F.sum("links").alias("links"))
    known = every.join(total, "class", "left").join(part.select(F.col("node").alias("class"), "component"), "class", "left")
    known = stage(known.select("label", "vector", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("root")), "embedding-known")
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = join_heavy(known, smallest, "root").select(
        F.col("label").alias("_label"), F.col("vector").alias("_vector"), (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id"
    )
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).cast("string").alias("_own"), F.col(vector_col).cast("array<double>").alias("_at"))
    joined = rows.join(known, (F.col("_own") == F.col("_label")) & (F.col("_at") == F.col("_vector")), "left")
    component = F.when(F.col("_label").isNull(), F.col(id_col)).otherwise(F.col("component_id"))
    return joined.select(id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.col(id_col).eqNullSafe(F.col("component_id"))
    )
