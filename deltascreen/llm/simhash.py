"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared at the anchors of a covering code. Two fingerprints of 64 bits that differ
in ``distance`` bits or fewer differ in ``distance // blocks`` or fewer in at least one of ``blocks``
disjoint bit blocks. Each block has its own code: the perfect Hamming code of ``2**m - 1`` bits,
whose words cover everything within radius 1, times all values of the bits left over (radius 0). A
fingerprint is replicated to every anchor within that radius plus the threshold of the block; the
anchor that covers it is its home. If two fingerprints are near in a block, the home of one is among
the anchors of the other, so comparing homes with visitors per anchor finds every near pair.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import join_heavy, stage, unused, whole_text
from deltascreen.llm.components import connected_components, forest

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Rows of one anchor that meet in one task; more homes or visitors are split into pairs of chunks.
MAX_HOMES, MAX_VISITORS = 4096, 32768
#: Anchors with more rows than this many are joined to the visitors without a broadcast.
MAX_BROADCAST_ROWS = 50_000
#: Comparisons held in memory at once.
PAIRS = 1 << 20


class CoveringCode:
    """Anchors of one bit block: ``2**m - 1`` Hamming bits below ``width - 2**m + 1`` free bits."""

    def __init__(self, shift: int, width: int, m: int, near: int):
        if not 0 < (1 << m) - 1 <= width:
            raise ValueError("the Hamming part does not fit the block")
        self.shift, self.width, self.bits = shift, width, (1 << m) - 1
        self.syndromes = []
        for first in range(0, self.bits, 8):  # the syndrome is the xor of the positions of the set bits
            columns = np.zeros(256, dtype=np.uint8)
            for bit in range(min(8, self.bits - first)):
                columns[(np.arange(256) >> bit) & 1 == 1] ^= first + bit + 1
            self.syndromes.append(columns)
        masks: list[list[tuple[bool, int]]] = [[] for _ in range(1 << m)]
        free = range(self.bits, width)
        for spent in range(min(near, len(free)) + 1):
            flips = [sum(1 << i for i in c) for c in combinations(free, spent)]
            for weight in range(near - spent + 2):
                for c in combinations(range(self.bits), weight):
                    syndrome = 0
                    for i in c:
                        syndrome ^= i + 1
                    own = sum(1 << i for i in c)
                    masks[syndrome] += [(not (spent == 0 and weight <= 1), own | f) for f in flips]
        self.masks = [np.array([x for _, x in sorted(found)], dtype=np.uint64) for found in masks]

    def anchors(self, prints: np.ndarray):
        """``(row, anchor, is home)`` of every anchor within reach; one anchor of each row is its home."""
        block = (prints >> np.uint64(self.shift)) & np.uint64((1 << self.width) - 1)
        part = np.zeros(len(block), dtype=np.uint8)
        for i, columns in enumerate(self.syndromes):
            part ^= columns[((block >> np.uint64(8 * i)) & np.uint64(255)).astype(np.uint8)]
        rows, keys, homes = [], [], []
        for syndrome, masks in enumerate(self.masks):
            own = np.flatnonzero(part == syndrome)
            if len(own):
                rows.append(np.repeat(own, len(masks)))
                keys.append((block[own][:, None] ^ masks[None, :]).ravel())
                homes.append(np.tile(np.arange(len(masks)) == 0, len(own)))
        if not rows:
            return np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(0, bool)
        return np.concatenate(rows), np.concatenate(keys), np.concatenate(homes)


def covering_codes(distance: int = DISTANCE, blocks: int = 3, m: int = 4) -> list[CoveringCode]:
    """One code for each block. More blocks need fewer anchors for a row, fewer blocks and a larger
    ``m`` tell more anchors apart: 3 blocks with m=4 give 2**17 to 2**18 anchors a block and 41 rows
    for a fingerprint, 2 blocks with m=5 give 2**27 anchors and about 340 rows."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    return [CoveringCode(a, b - a, m, distance // blocks) for a, b in zip(cuts, cuts[1:], strict=False)]


def fingerprint(text: bytes) -> int:
    """Fingerprint of one text; words split at ASCII white space, shingles keep repeats."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return _majority(np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64))
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)]
    return _majority(np.array(hashes, dtype=np.uint64))


def _majority(hashes: np.ndarray) -> int:
    if len(hashes) <= 256:
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts = bits.sum(axis=0, dtype=np.int64)
    else:  # count whole bytes first, then the bits of each byte value
        octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
        of_byte = (np.arange(256)[:, None] >> np.arange(8)) & 1
        counts = np.concatenate([np.bincount(octets[:, i], minlength=256) @ of_byte for i in range(8)])
    chosen = np.flatnonzero(2 * counts > len(hashes))
    return int(sum(1 << int(i) for i in chosen))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, print)`` with the fingerprint as a signed long, one row for each row of ``docs``."""

    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[id_col, "print"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, print long")


def near_links(prints: DataFrame, distance: int = DISTANCE, blocks: int = 3, m: int = 4) -> DataFrame:
    """Links ``(a, b)`` that join all different prints within ``distance`` bits, directly or in chains.

    Every pair is compared, but a group of near prints comes back as a star around its smallest
    member at each anchor, not as all its pairs.
    """
    prints = stage(prints.select("print").where("print is not null").distinct(), "prints")
    anchors = _visits(prints, distance, blocks, m)
    load = anchors.groupBy("anchor").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("visits"))
    hot = load.where((F.col("homes") > MAX_HOMES) | ((F.col("homes") > 0) & (F.col("visits") > MAX_VISITORS)))
    hot = stage(
        hot.select(
            "anchor",
            F.ceil(F.col("homes") / MAX_HOMES).cast("int").alias("rows"),
            F.ceil(F.col("visits") / MAX_VISITORS).cast("int").alias("cols"),
        ),
        "hot-anchors",
    )
    if hot.count() <= MAX_BROADCAST_ROWS:
        hot = F.broadcast(hot)
    wide = anchors.join(hot, "anchor", "left").withColumns(
        {"rows": F.coalesce("rows", F.lit(1)), "cols": F.coalesce("cols", F.lit(1)), "at": F.xxhash64("print")}
    )
    # a home meets every chunk of visitors, a visitor every chunk of homes; split homes visit each other
    row, col = F.expr("cast(pmod(at, rows) as int)"), F.expr("cast(pmod(at, cols) as int)")
    as_home = F.transform(F.sequence(F.lit(0), F.col("cols") - 1), lambda j: F.struct((row * F.col("cols") + j).alias("chunk"), F.lit(True).alias("home")))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct((i * F.col("cols") + col).alias("chunk"), F.lit(False).alias("home")))
    places = F.when(~F.col("home"), as_guest).when(F.col("rows") > 1, F.concat(as_home, as_guest)).otherwise(as_home)
    dealt = wide.select("anchor", F.explode(places).alias("place"), "print").select("anchor", "place.chunk", "place.home", "print")
    dealt = dealt.repartition("anchor", "chunk").sortWithinPartitions("anchor", "chunk")

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            key = now[0] * 1_000_003 + now[1]
            other = np.flatnonzero(key != key[-1]) if len(key) else key
            last = int(other[-1]) + 1 if len(other) else 0  # the last key may go on in the next batch
            held = [x[last:] for x in now]
            if last:
                yield from _compare(key[:last], now[2][:last], now[3][:last], distance)
        if held is not None and len(held[0]):
            yield from _compare(held[0] * 0, held[2], held[3], distance)

    return dealt.mapInArrow(run, "a long, b long")


def _visits(prints: DataFrame, distance: int, blocks: int, m: int) -> DataFrame:
    def run(batches):
        codes = covering_codes(distance, blocks, m)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for first in range(0, len(every), 2048):
                some = every[first : first + 2048]
                for i, code in enumerate(codes):
                    row, key, home = code.anchors(some)
                    anchor = (key.astype(np.int64) * blocks + i).astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(anchor), pa.array(home), pa.array(some[row].view(np.int64))], names=["anchor", "home", "print"]
                    )

    return prints.mapInArrow(run, "anchor long, home boolean, print long")


def _compare(key: np.ndarray, home: np.ndarray, prints: np.ndarray, distance: int):
    """Star links of the near pairs between the homes and all rows of each run of equal keys."""
    order = np.lexsort((~home, key)) if len(key) else np.zeros(0, int)
    key, home, prints = key[order], home[order], prints[order]
    starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
    sizes = np.diff(starts, append=len(key))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    first, many = np.repeat(starts, sizes), np.repeat(homes, sizes)
    bits = prints.view(np.uint64)
    ends = np.cumsum(many)
    at = 0
    while at < len(key):  # rows whose comparisons fill one block of memory, or one row
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        n = many[at:to]
        left = np.repeat(np.arange(at, to), n)
        right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at:to], n)
        near = np.bitwise_count(bits[left] ^ bits[right]) <= distance
        left, right = left[near], right[near]
        apart = prints[left] != prints[right]
        left, right = left[apart], right[apart]
        if len(left):
            nodes, place = np.unique(np.concatenate([prints[left], prints[right]]), return_inverse=True)
            root = forest(len(nodes), place[: len(left)], place[len(left) :])
            below = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[below]), pa.array(nodes[root[below]])], names=["a", "b"])
        at = to


def _with_roots(classes: DataFrame, distance: int) -> DataFrame:
    """``classes`` (one row for each print) with ``root``, a print that stands for the component."""
    joined = connected_components(near_links(classes, distance))
    return classes.join(joined, classes.print == joined.node, "left").select(*classes.columns, F.coalesce("component", "print").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row for each row of ``docs``: id, ``print`` (signed long) and ``component``.

    The component is the smallest id among all documents that links reach, the document itself
    included; fingerprints link at ``distance`` differing bits or fewer. A null text counts as
    empty, all empty texts have fingerprint 0 and link. Repeated ids keep one row each. A null id
    never is the smallest; a component of null ids only has a null id. Other columns are ignored.
    An empty table gives an empty result.
    """
    prints = stage(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = stage(prints.groupBy("print").agg(F.min(id_col).alias("least")), "print-classes")
    labelled = stage(_with_roots(classes, distance), "print-roots")
    smallest = labelled.groupBy("root").agg(F.min("least").alias("component"))
    of_print = join_heavy(labelled, smallest, "root").select("print", "component")
    return prints.join(of_print, "print").select(id_col, "print", "component")


def hexadecimal(column: str = "print"):
    """A signed long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``docs`` with one row of each component of near duplicates, one with its smallest id.

    Rows without an id come last, so they are kept where no row of their component has an id. Rows
    that share an id are told apart: each stands for its own text.
    """

    @F.pandas_udf("long")
    def print_of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(x) for x in texts], dtype=np.uint64).view(np.int64))

    own, row = unused("_print", docs), unused("_row", docs)
    marked = docs.withColumns({own: print_of(whole_text(text_col).cast("binary")), row: F.monotonically_increasing_id()})
    marked = stage(marked, "marked")  # row numbers are those that were written
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row")))
    classes = stage(marked.groupBy(F.col(own).alias("print")).agg(first.alias("first")), "print-classes")
    kept = _with_roots(classes, distance).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*docs.columns)
