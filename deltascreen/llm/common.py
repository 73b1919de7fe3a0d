"""Shared helpers: written stages, per-worker caches, and words of many texts as numpy arrays."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that the array helpers take at once; a longer text is taken whole, on its own.
BLOCK_BYTES = 2 << 20
#: A key is heavy with more than one in this many of all rows, so fewer keys than this can be heavy.
HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; in local mode a private one where that is unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    return root.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: short lineage, true sizes."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_heavy(rows: DataFrame, keyed: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to ``keyed``, which has at most one row for each ``key``.

    Rows of heavy keys, whatever their number, stay where they are: what ``keyed`` has for those keys
    (fewer than ``HEAVY`` rows) is broadcast. All others are shuffled, none of which can fill a task.
    Keys are counted with partial sums over all rows. No key may be null.
    """
    counts = stage(rows.groupBy(key).agg(F.count("*").alias("_n")), "key-counts")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    heavy = counts.where(F.col("_n") * HEAVY > total).select(key)
    own = rows.join(F.broadcast(stage(heavy.join(keyed, key, how), "heavy-keys")), key)
    others = rows.join(F.broadcast(heavy), key, "left_anti").join(keyed, key, how)
    return own.unionByName(others)


def unused(name: str, *tables: DataFrame) -> str:
    """``name``, with underscores before it as long as a column of ``tables`` is called like that."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def worker_cache(name: str, build):
    """An object kept by the Python worker from task to task (tokenizers, vocabularies)."""
    home = sys.modules.setdefault("_llm_worker_cache", types.ModuleType("_llm_worker_cache"))
    if not hasattr(home, name):
        setattr(home, name, build())
    return getattr(home, name)


def blocks(sizes, limit: int = BLOCK_BYTES):
    """Slices of consecutive items whose sizes add up to ``limit`` at most, or hold one item."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield start, len(sizes)


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word (two multiply-xorshift rounds)."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class WordHasher:
    """Words of a block of byte strings, found and hashed with whole-array operations.

    ``kind[b]`` is 0 for bytes between words and otherwise the class of byte ``b``: a word is a
    longest run of bytes of one class. ``fold`` maps bytes before hashing (for example to lower
    case). A word's hash is a polynomial over random byte values, so equal words have equal hashes
    and different ones collide with a chance of about 2**-60.
    """

    STEP = 0x9E3779B97F4A7C15

    def __init__(self, kind: np.ndarray, fold: np.ndarray | None = None):
        self.kind = kind.astype(np.uint8)
        values = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.values = values if fold is None else values[fold]
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        def powers(step: int) -> np.ndarray:
            out = np.full(n + 1, step % (1 << 64), dtype=np.uint64)
            out[0] = 1
            return np.cumprod(out, dtype=np.uint64)

        self.up, self.down = powers(self.STEP), powers(pow(self.STEP, -1, 1 << 64))

    def words(self, texts: list[bytes]):
        """``(text index, start byte in its text, end byte, hash)`` of every word, in order."""
        joined = np.frombuffer(b"\x00".join(texts) + b"\x00", dtype=np.uint8)
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        if len(joined) >= len(self.up):
            self._grow(2 * len(joined))
        kind = self.kind[joined]
        kind[offsets[1:] - 1] = 0
        edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0), append=np.uint8(0)))
        inside = kind[np.minimum(edge, len(kind) - 1)] != 0
        inside[edge >= len(kind)] = False
        where = np.flatnonzero(inside)
        starts, ends = edge[where], edge[where + 1] if len(where) else edge[:0]
        total = np.zeros(len(joined) + 1, dtype=np.uint64)
        np.cumsum(self.values[joined] * self.up[: len(joined)], out=total[1:])
        hashes = mix64((total[ends] - total[starts]) * self.down[starts])
        owner = np.searchsorted(offsets, starts, side="right") - 1
        return owner, starts - offsets[owner], ends - offsets[owner], hashes


def ascii_fold() -> np.ndarray:
    """A-Z to a-z, every other byte itself."""
    fold = np.arange(256)
    fold[65:91] += 32
    return fold


def alnum_kind() -> np.ndarray:
    """Class 1: ASCII letters, digits and all bytes of characters beyond ASCII."""
    kind = np.zeros(256, dtype=np.uint8)
    kind[48:58] = kind[65:91] = kind[97:123] = kind[128:] = 1
    return kind
