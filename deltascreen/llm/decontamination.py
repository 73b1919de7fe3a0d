"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of the passages.

Benchmark items are small and bounded (checked); the documents are read twice and never shuffled.
The first pass counts every item n-gram over all documents. An alignment that reaches the score leaves
at least ``intact`` n-grams of its item unbroken, wherever the edits are; so all n-grams that occur are
seeds, but for the ``intact - 1`` most common. Items too short for that have shorter n-grams. The second
pass cuts the passages around the seeds out of the documents; they are joined to the items on the seed
and aligned word by word.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import WordHasher, alnum_kind, blocks, stage, unused, whole_text

#: Words of a seed; fewer where that is what an alignment is sure to hold.
GRAM = 3
#: Share of an item's words that an alignment has to keep, edits taken off.
MIN_SCORE = 0.6
#: Words of the benchmark that are sent to every task; a larger benchmark has to be given in parts.
MAX_ITEM_WORDS = 5_000_000
#: Cells of alignments held in memory at once.
CELLS = 1 << 19
GAP, MISMATCH = 1, 1
MATCH = "id long, text_key long, item_id long, score double, first_word long, last_word long"


def _hasher() -> WordHasher:
    return WordHasher(alnum_kind())


def _grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words from each word on; the last ``n - 1`` wrap and are masked by callers."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9DDFEA08EB382D69) + np.roll(hashes, -k)
    return out ^ (out >> np.uint64(29))


def least_score(words: int, min_score: float) -> int:
    """Equal words less edits that an alignment with an item of so many words needs."""
    return max(1, math.ceil(min_score * words - 1e-9))


def intact(words: int, n: int, min_score: float) -> int:
    """Unbroken n-grams that every alignment of ``min_score`` or more with an item of ``words`` words has.

    With m equal words it has at most m - need edits, so at most m - need + 1 unbroken stretches, each
    of which has n - 1 n-grams less than words. That is linear in m: the least is at one of the ends.
    """
    need = least_score(words, min_score)
    return min(m - (n - 1) * (m - need + 1) for m in (need, max(need, words)))


class Items:
    """Hashed words of the benchmark items, with the distinct n-grams of all of them in order."""

    def __init__(self, rows: list[tuple[int, str]], min_score: float = MIN_SCORE):
        hasher = _hasher()
        self.ids, self.words = [], []
        for item, text in rows:
            owner, _, _, hashes = hasher.words([(text or "").lower().encode()])
            if len(hashes):
                self.ids.append(item)
                self.words.append(hashes)
        if sum(map(len, self.words)) > MAX_ITEM_WORDS:
            raise ValueError("the benchmark is larger than MAX_ITEM_WORDS: decontaminate against its parts in turn")
        # the longest n-grams of which no alignment can break all
        own = [next((n for n in range(GRAM, 1, -1) if intact(len(w), n, min_score) > 0), 1) for w in self.words]
        self.spare = [intact(len(w), n, min_score) - 1 for w, n in zip(self.words, own, strict=True)]
        self.sizes = sorted(set(own))
        self.grams = [_grams(w, n)[: len(w) - n + 1] for w, n in zip(self.words, own, strict=True)]
        self.distinct = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, dtype=np.uint64)
        self.vocabulary = np.unique(np.concatenate(self.words)) if self.words else np.zeros(0, dtype=np.uint64)
        #: Document words that an alignment can span.
        self.reach = max((2 * len(w) - least_score(len(w), min_score) for w in self.words), default=0)

    def seeds(self, counts: dict[int, int]) -> list[tuple[int, int]]:
        """``(n-gram number, item number)``: the n-grams of each item that occur, without the most common.

        Those left out stand at no more than ``spare`` places of the item, so each alignment holds a seed.
        """
        found = []
        for i, (grams, spare) in enumerate(zip(self.grams, self.spare, strict=True)):
            number, places = np.unique(np.searchsorted(self.distinct, grams), return_counts=True)
            often = np.array([counts.get(int(n), 0) for n in number])
            for at in np.argsort(-often, kind="stable"):
                if places[at] <= spare:
                    spare -= places[at]
                elif often[at]:
                    found.append((int(number[at]), i))
        return sorted(found)


class _Lookup:
    """Membership of 64-bit hashes in a sorted set: a bitmap first, then a binary search."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.shift = np.uint64(64 - 22)
        self.bitmap = np.zeros(1 << 22, dtype=bool)
        self.bitmap[values >> self.shift] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of members, and their places in the set."""
        at = np.flatnonzero(self.bitmap[hashes >> self.shift])
        place = np.searchsorted(self.values, hashes[at])
        place = np.minimum(place, max(0, len(self.values) - 1))
        same = self.values[place] == hashes[at] if len(self.values) else np.zeros(len(at), dtype=bool)
        return at[same], place[same]


def _read_items(benchmark: DataFrame, id_col: str, text_col: str, min_score: float) -> Items:
    words = benchmark.agg(F.coalesce(F.sum(F.length(text_col)), F.lit(0))).first()[0]
    if words > 8 * MAX_ITEM_WORDS:
        raise ValueError("the benchmark is larger than MAX_ITEM_WORDS: decontaminate against its parts in turn")
    return Items(sorted((r[0], r[1] or "") for r in benchmark.where(F.col(id_col).isNotNull()).select(id_col, text_col).distinct().collect()), min_score)


def _hits(texts: list[bytes], hasher: WordHasher, lookup: _Lookup, sizes: list[int]):
    """For each block of texts: word owners and hashes, and the place and number of every n-gram hit."""
    for a, b in blocks([len(t) for t in texts]):
        owner, _, _, hashes = hasher.words(texts[a:b])
        at, number = [np.zeros(0, int)], [np.zeros(0, int)]
        for n in sizes if len(hashes) else []:
            end = np.arange(len(hashes)) + n - 1
            whole = end < len(hashes)
            whole[whole] = owner[end[whole]] == owner[whole]
            place, gram = lookup.find(_grams(hashes, n))
            inside = whole[place]
            at.append(place[inside])
            number.append(gram[inside])
        yield a, owner, hashes, np.concatenate(at), np.concatenate(number)


def _gram_counts(docs: DataFrame, items: Items) -> DataFrame:
    sizes, distinct = items.sizes, items.distinct

    def run(batches):
        hasher, lookup = _hasher(), _Lookup(distinct)
        for batch in batches:
            texts = [t.lower().encode() for t in batch.column(0).to_pylist()]
            total = np.zeros(len(distinct), dtype=np.int64)
            for *_, number in _hits(texts, hasher, lookup, sizes):
                total += np.bincount(number, minlength=len(total))
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["gram", "n"])

    return docs.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _passages(docs: DataFrame, items: Items, seeds: list[int], reach: int) -> DataFrame:
    """Words around the seeds of each document, as numbers in the benchmark's vocabulary (-1: none)."""
    sizes, vocabulary, chosen = items.sizes, items.vocabulary, items.distinct[np.array(seeds, dtype=int)]
    numbers = np.array(seeds)

    def run(batches):
        hasher, lookup = _hasher(), _Lookup(chosen)
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = [t.lower().encode() for t in batch.column(1).to_pylist()]
            for start, owner, hashes, at, number in _hits(texts, hasher, lookup, sizes):
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, number = at[order], numbers[number[order]]
                heads = np.searchsorted(owner, np.arange(owner[-1] + 2))
                low = np.maximum(at - reach, heads[owner[at]])
                high = np.minimum(at + reach + GRAM, heads[owner[at] + 1])
                # windows of a document that touch are one passage
                cut = np.flatnonzero(np.r_[True, (low[1:] > high[:-1]) | (owner[at[1:]] != owner[at[:-1]])])
                ends = np.r_[cut[1:], len(at)]
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                coded = np.where(vocabulary[place] == hashes, place, -1).astype(np.int32)
                n = len(cut)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(uid, uid + n)), *(batch.column(c).take(pa.array(owner[at[cut]] + start)) for c in (0, 2)),
                        pa.array(low[cut] - heads[owner[at[cut]]]),
                        pa.array([coded[low[i] : high[j - 1]] for i, j in zip(cut, ends, strict=True)], pa.list_(pa.int32())),
                        pa.array([np.unique(number[i:j]) for i, j in zip(cut, ends, strict=True)], pa.list_(pa.int64())),
                    ],
                    names=["uid", "id", "text_key", "first", "words", "grams"],
                )
                uid += n

    return docs.mapInArrow(run, "uid long, id long, text_key long, first long, words array<int>, grams array<long>")


def align(items: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score and its last passage word (exclusive), for rows of padded words.

    A pair of equal words scores 1, a changed, missing or added word costs 1. Padding is -2 in
    ``items`` and -1 in ``passages``, which equals nothing. A passage of merged windows can have any length.
    """
    pairs, width = passages.shape
    steps = np.arange(width + 1, dtype=np.int32) * GAP
    above = np.zeros((pairs, width + 1), dtype=np.int32)
    best, end = np.zeros(pairs, dtype=np.int32), np.zeros(pairs, dtype=np.int64)
    for k in range(items.shape[1]):
        row = np.zeros_like(above)
        step = np.where(passages == items[:, k : k + 1], 1, -MISMATCH).astype(np.int32)
        np.maximum(above[:, :-1] + step, above[:, 1:] - GAP, out=row[:, 1:])
        np.maximum(row, 0, out=row)
        row = np.maximum(np.maximum.accumulate(row + steps, axis=1) - steps, 0)  # words left out of the item
        at = row.argmax(axis=1)
        top = row[np.arange(pairs), at]
        end, best = np.where(top > best, at, end), np.maximum(best, top)
        above = row
    return best, end


def _padded(rows: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(rows), max(map(len, rows))), fill, dtype=np.int32)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _scores(pairs: DataFrame, min_score: float) -> DataFrame:
    """``(id, text_key, item_id, score, first_word, last_word)`` of the pairs that reach ``min_score``."""
    names = ["id", "text_key", "item_id", "score", "first_word", "last_word"]

    def run(batches):
        for batch in batches:
            words = [np.array(x, dtype=np.int32) for x in batch.column("words").to_pylist()]
            item = [np.array(x, dtype=np.int32) for x in batch.column("item_words").to_pylist()]
            first = batch.column("first").to_numpy()
            # an alignment has no more equal words than both sides share: too few, and it can't reach the score
            able = [i for i, (w, t) in enumerate(zip(words, item, strict=True)) if np.isin(t, w).sum() >= least_score(len(t), min_score)]
            able.sort(key=lambda i: (len(words[i]), len(item[i])))
            for a, b in blocks([len(words[i]) for i in able], CELLS // 8):
                some = able[a:b]
                left, right = _padded([item[i] for i in some], -2), _padded([words[i] for i in some], -1)
                best, end = align(left, right)
                size = np.array([len(item[i]) for i in some])
                hit = np.flatnonzero(best >= min_score * size - 1e-9)
                if not len(hit):
                    continue
                some = [some[h] for h in hit]
                back = _padded([words[i][: end[h]][::-1] for i, h in zip(some, hit, strict=True)], -1)
                _, length = align(_padded([item[i][::-1] for i in some], -2), back)
                start = first[some] + end[hit] - length
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).take(pa.array(some)) for c in ("id", "text_key", "item_id")),
                        pa.array(best[hit] / size[hit]), pa.array(start), pa.array(first[some] + end[hit] - 1),
                    ],
                    names=names,
                )

    return pairs.mapInArrow(run, MATCH)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_score: float = MIN_SCORE,
) -> DataFrame:
    """Best alignment of every document with every item it repeats: id, item, score, first and last word.

    The score is the alignment's equal words less its edits, over the item's words; pairs below
    ``min_score`` are left out. Words are runs of letters and digits in lower case, counted from 0. A
    null text counts as empty; items and documents without words match nothing. Rows that share an id
    give one row for each item, with the best score. A null id is a document of its own id; an item
    without an id is ignored. Other columns are ignored; an empty table gives an empty result.
    """
    best = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, min_score)
    top = F.max_by(F.struct("score", "first_word", "last_word"), F.struct("score", -F.col("first_word"), -F.col("last_word")))
    return best.groupBy("id", "item_id").agg(top.alias("top")).select(F.col("id").alias(id_col), F.col("item_id").alias(item_col), "top.*")


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, min_score: float) -> DataFrame:
    """Alignments of passages; ``text_key`` tells rows of one id, or without an id, apart by their texts."""
    items = _read_items(benchmark, item_col, item_text_col, min_score)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    spark = docs.sparkSession
    if not len(items.distinct):
        return spark.createDataFrame([], MATCH)
    seeds = items.seeds({r.gram: r.n for r in _gram_counts(rows.select("text"), items).collect()})
    found = stage(_passages(rows, items, sorted({g for g, _ in seeds}), items.reach), "passages")
    of_gram = spark.createDataFrame(seeds, "gram long, item int")
    coded = [np.searchsorted(items.vocabulary, w).tolist() for w in items.words]
    of_item = spark.createDataFrame(list(zip(range(len(coded)), items.ids, coded, strict=True)), "item int, item_id long, item_words array<int>")
    pairs = found.select("uid", F.explode("grams").alias("gram")).join(of_gram, "gram").select("uid", "item").distinct()
    full = found.select("uid", "id", "text_key", "first", "words").join(pairs, "uid").join(of_item, "item")
    return _scores(full.select("id", "text_key", "first", "words", "item_id", "item_words"), min_score)


def clean(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", min_score: float = MIN_SCORE,
) -> DataFrame:
    """``docs`` without the rows whose text repeats a benchmark item."""
    found = _matches(docs, benchmark, id_col, text_col, item_col, item_text_col, min_score)
    own, key = unused("_id", docs), unused("_key", docs)
    found = found.select(F.col("id").alias(own), F.col("text_key").alias(key)).distinct()
    same = docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(whole_text(text_col)) == F.col(key))
    return docs.join(found, same, "left_anti")
