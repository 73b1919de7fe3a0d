"""Best-fit packing of documents into fixed-length sequences by a grouping genetic algorithm.

Documents are tokenized once and cut only where they are longer than a sequence. The rest is dealt
into shards of bounded size; several islands evolve packings of each shard: a crossover injects whole
well-filled bins of one parent into the other, removes the bins that hold the same documents, and
best-fits the documents displaced. Between epochs each island's elite migrates to the next island.
The least filled bins of all shards are then dealt anew and packed together in a last round.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import stage, whole_text, worker_cache

CAPACITY = 2048
END = 0
#: Pieces of a shard, islands of a shard, epochs of an island, offspring and parents in an epoch.
SHARD, ISLANDS, EPOCHS, OFFSPRING, POPULATION = 2048, 2, 2, 24, 6
#: Words that a worker's token cache holds before it starts anew.
CACHE_WORDS = 1_000_000

# Characters of the first 256 code points by the classes of the tokenizer's pattern.
LETTERS = "a-zA-ZªµºÀ-ÖØ-öø-ÿ"
NUMBERS = "0-9²³¹¼-¾"
SPACES = "\t-\r \u0085 "
PRETOKEN = f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+"


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ..."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words.

    White space never is in a token of this kind of vocabulary, so a text's ids are its words' ids in
    a row. Words are looked up in a cache of bounded size. A word of the first 256 code points is
    split by the pre-token pattern here, any other word by the tokenizer itself. Markers of the
    vocabulary (such as ``<|endoftext|>``) have one id, as in the tokenizer as loaded: the text is
    parted at them first, leftmost and longest, and the stretches between are coded on their own.
    """

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in added.values()):
            raise ValueError("only markers that stand for themselves are supported")
        self.markers = {t.content: self._pack([i]) for i, t in added.items()}
        longest_first = sorted(self.markers, key=len, reverse=True)
        self.parted = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else lambda text: [text]
        self.split = re.compile(PRETOKEN).findall
        self.letters = byte_letters()
        self.limit = limit
        self.known: dict[bytes, bytes] = {}

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        parts = self.parted(text)
        if len(parts) == 1:
            return self._plain(text)
        # odd places hold the markers
        return b"".join(self.markers[part] if i % 2 else self._plain(part) for i, part in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        """Ids of a stretch without markers."""
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
        words = text.encode().split()
        if len(self.known) > self.limit:
            self.known.clear()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            for word in set(words).difference(self.known):
                self.known[word] = self._word(word)
            return b"".join(map(self.known.__getitem__, words))

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self._pretoken, self.split(text.lower())))

    def _pretoken(self, part: str) -> bytes:
        key = part.encode()
        if key not in self.known:
            letters = key.decode("latin-1").translate(self.letters)
            self.known[key] = self._pack([t.id for t in self.tokenizer.model.tokenize(letters)])
        return self.known[key]

    @staticmethod
    def _pack(ids) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Token pieces of every row: ``uid, id, piece, start, length, ids_crc32`` and, if asked, ``ids``."""
    names = ["uid", id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches):
        words = worker_cache("packing_words", lambda: WordTokenizer(vocabulary))
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            owner, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                coded = words.encode(text) + np.array([END], dtype="<u4").tobytes()
                for k, at in enumerate(range(0, len(coded), 4 * capacity)):
                    part = coded[at : at + 4 * capacity]
                    owner.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, dtype="<u4").astype(np.int32))
            columns = [
                pa.array(np.arange(uid, uid + len(owner))), batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()),
            ]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            uid += len(owner)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), whole_text(text_col).alias("text"))
    schema = f"uid long, `{id_col}` long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


class Packing:
    """Items of given lengths in bins; ``bin_of`` is each item's bin."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.lengths, self.capacity = lengths, capacity

    def best_fit(self, order, bin_of: np.ndarray, fill: np.ndarray) -> np.ndarray:
        """Put the items of ``order``, one after the other, where the least room is left over."""
        rooms = sorted((self.capacity - int(f), b) for b, f in enumerate(fill) if f)
        bins = len(fill)
        for item in order:
            size = int(self.lengths[item])
            at = bisect_left(rooms, (size, -1))
            room, b = rooms.pop(at) if at < len(rooms) else (self.capacity, bins)
            bins += b == bins
            bin_of[item] = b
            if room > size:
                insort(rooms, (room - size, b))
        return np.unique(bin_of, return_inverse=True)[1]

    def fill(self, bin_of: np.ndarray) -> np.ndarray:
        return np.bincount(bin_of, weights=self.lengths).astype(np.int64)

    def cost(self, bin_of: np.ndarray) -> tuple[int, int]:
        """Fewer bins first, then fuller full bins (largest sum of squares)."""
        fill = self.fill(bin_of)
        return len(fill), -int((fill * fill).sum())

    def fresh(self, rng: np.random.Generator, noise: float) -> np.ndarray:
        order = np.argsort(-self.lengths * (1 + noise * rng.random(len(self.lengths))), kind="stable")
        return self.best_fit(order, np.zeros(len(order), dtype=np.int64), np.zeros(0, dtype=np.int64))

    def crossover(self, rng: np.random.Generator, into: np.ndarray, source: np.ndarray) -> np.ndarray:
        """Inject well-filled bins of ``source`` into ``into``; best-fit what that displaces."""
        full = self.fill(source)
        chosen = (full >= min(np.quantile(full, 0.75), 0.99 * self.capacity)) & (rng.random(len(full)) < 0.5)
        injected = chosen[source]
        hit = np.zeros(into.max() + 1, dtype=bool)
        hit[into[injected]] = True
        displaced = np.flatnonzero(hit[into] & ~injected)
        child = np.where(injected, source + len(hit), into)
        fill = np.zeros(len(hit) + len(full), dtype=np.int64)
        placed = np.ones(len(child), dtype=bool)
        placed[displaced] = False
        np.add.at(fill, child[placed], self.lengths[placed])
        order = displaced[np.argsort(-self.lengths[displaced] * (1 + 0.1 * rng.random(len(displaced))), kind="stable")]
        return self.best_fit(order, child, fill)

    def evolve(self, seed: int, elites: list[np.ndarray], offspring: int, population: int) -> np.ndarray:
        """Best packing of an epoch that starts from ``elites`` and fresh packings."""
        rng = np.random.default_rng(seed)
        least = -(-int(self.lengths.sum()) // self.capacity)
        living = sorted(((self.cost(x), i, x) for i, x in enumerate(elites)), key=lambda x: x[:2])
        while len(living) < population and (not living or living[0][0][0] > least):
            x = self.fresh(rng, 0.0 if not living else 0.2)
            living.append((self.cost(x), len(living), x))
            living.sort(key=lambda x: x[:2])
        for k in range(offspring):
            if living[0][0][0] <= least:  # no packing has fewer bins
                break
            a, b = rng.choice(len(living), 2, replace=False)
            x = self.crossover(rng, living[max(a, b)][2], living[min(a, b)][2])
            living.append((self.cost(x), population + k, x))
            living.sort(key=lambda x: x[:2])
            living.pop()
        return living[0][2]


def _epoch(items: DataFrame, number: int, capacity: int, offspring: int, population: int) -> DataFrame:
    """``items(shard, island, origin, uid, length, bin)``: one group for each island of a shard."""

    def run(key, group):
        shard, island = key[0].as_py(), key[1].as_py()
        origin = group.column("origin").to_numpy()
        uid, length, bins = (group.column(c).to_numpy() for c in ("uid", "length", "bin"))
        own = {o: np.argsort(uid[origin == o]) for o in np.unique(origin)}
        first = origin == min(own)
        problem = Packing(length[first][own[min(own)]], capacity)
        elites = [bins[origin == o][order] for o, order in own.items() if o >= 0]
        best = problem.evolve(hash((shard, island, number)) & 0x7FFFFFFF, elites, offspring, population)
        ids, n = uid[first][own[min(own)]], len(best)
        count, spread = problem.cost(best)
        order = np.lexsort((ids, best))
        ends = np.cumsum(problem.lengths[order])
        starts = ends - problem.lengths[order]
        head = np.flatnonzero(np.diff(best[order], prepend=-1))
        offset = np.empty(n, dtype=np.int64)
        offset[order] = starts - np.repeat(starts[head], np.diff(head, append=n))
        return pa.table({
            "shard": np.full(n, shard), "island": np.full(n, island), "uid": ids, "length": problem.lengths, "bin": best.astype(np.int64),
            "offset": offset, "fill": problem.fill(best)[best], "bins": np.full(n, count), "spread": np.full(n, spread),
        })

    schema = "shard long, island long, uid long, length long, bin long, offset long, fill long, bins long, spread long"
    return items.groupBy("shard", "island").applyInArrow(run, schema)


def _round(items: DataFrame, number: int, capacity: int, shard: int, islands: int, epochs: int, offspring: int, population: int) -> DataFrame:
    """Best packing found for each shard of ``items(uid, length)``."""
    shards = max(1, -(-items.count() // shard))
    dealt = items.select(F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(shards)).alias("shard"), "uid", "length")
    now = dealt.select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(islands - 1).cast("long"))).alias("island"), "uid", "length")
    now = now.withColumns({"origin": F.lit(-1).cast("long"), "bin": F.lit(0).cast("long")})
    for epoch in range(epochs):
        solved = stage(_epoch(now, epoch, capacity, offspring, population), "packing-epoch")
        kept = solved.select("shard", "island", F.col("island").alias("origin"), "uid", "length", "bin")
        moved = kept.withColumn("island", (F.col("island") + 1) % islands)
        now = kept.unionByName(moved) if islands > 1 else kept
    best = solved.groupBy("shard").agg(F.min(F.struct("bins", "spread", "island")).alias("best"))
    return solved.join(best.select("shard", F.col("best.island").alias("island")), ["shard", "island"]).drop("island", "bins", "spread")


def pack(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, shard: int = SHARD,
    islands: int = ISLANDS, epochs: int = EPOCHS, offspring: int = OFFSPRING, population: int = POPULATION, with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and an end id; only documents longer than ``capacity`` are cut. A null or
    empty text is the end id alone. Rows that repeat, or share an id, are packed one by one; a null
    id stays null. Other columns are ignored. An empty table gives an empty result. Sequence ids of
    full pieces are not negative, the others are.
    """
    found = stage(pieces(docs, vocabulary, id_col, text_col, capacity, with_ids), "pieces")
    settings = (capacity, shard, islands, epochs, offspring, population)
    first = _round(found.where(F.col("length") < capacity).select("uid", "length"), 0, *settings)
    first = stage(first, "packed")
    # of each shard, the bins with the most room are packed again, together with those of the others
    worst = first.groupBy("shard").agg(F.min(F.struct("fill", "bin")).alias("worst"))
    marked = first.join(worst.select("shard", F.col("worst.bin").alias("bin"), F.lit(True).alias("open")), ["shard", "bin"], "left")
    kept = marked.where("open is null").select("uid", F.lit(0).alias("round"), "shard", "bin", "offset")
    again = _round(marked.where("open").select("uid", "length"), 1, *settings).select("uid", F.lit(1).alias("round"), "shard", "bin", "offset")
    number = F.shiftleft(F.col("round").cast("long"), 61) + F.shiftleft("shard", 20) + F.col("bin")
    placed = kept.unionByName(again).select("uid", (-1 - number).alias("sequence_id"), "offset")
    whole = found.where(F.col("length") == capacity).select("uid", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return found.join(placed.unionByName(whole), "uid").drop("uid")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def sequences(packed: DataFrame) -> DataFrame:
    """Token ids of every sequence, from ``pack(..., with_ids=True)``: at most one capacity of ids each."""
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
