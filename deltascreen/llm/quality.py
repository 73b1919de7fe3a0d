"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network.

Every word owns a sparse random index vector. A word's vector is the sum of the index vectors of its
neighbours over all documents, so words in like contexts get like vectors without any training. Words
are hashed to a fixed number of rows, which bounds the table whatever the corpus. A document is the
mean and the root mean square of its words' vectors; a numpy network with one hidden layer scores it,
and a temperature fitted on rows that the network has not seen makes the score a probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import WordHasher, blocks, stage, unused, whole_text

ROW_BITS, DIMS, SPARSE, REACH = 16, 32, 2, 2
#: Labelled rows that the network is fitted on at most (lowest hashes of their ids).
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 256, 3e-3, 1e-4
FOLDS, CALIBRATION_FOLD = 5, 1
THRESHOLD = 0.3
SEED = 11


def _hasher() -> WordHasher:
    """Words: runs of letters, of digits, or of other visible characters; case counts."""
    kind = np.full(256, 3, dtype=np.uint8)
    kind[:33] = kind[127] = 0
    kind[48:58] = 2
    kind[65:91] = kind[97:123] = kind[128:] = 1
    return WordHasher(kind)


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """For every row the ``SPARSE`` places and signs of its index vector."""
    rng = np.random.default_rng(SEED)
    size = (SPARSE, 1 << ROW_BITS)
    return rng.integers(0, DIMS, size), rng.integers(0, 2, size).astype(bool)


def _rows(texts: list[bytes], hasher: WordHasher, limit: int):
    """For each block of texts: index of its first text, its number of texts, word owners and rows."""
    for a, b in blocks([len(t) for t in texts], limit):
        owner, _, _, hashes = hasher.words(texts[a:b])
        yield a, b - a, owner, (hashes >> np.uint64(64 - ROW_BITS)).astype(np.int64)


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of all word rows (zero where a row has no word), from every text of ``docs``.

    Each task adds up its own texts and sends one line for each row that it met; the lines of a row
    are summed as a stream. The table that comes back has a fixed size (8 MB).
    """
    texts = docs.select(whole_text(text_col).cast("binary").alias("text"))

    def count(batches):
        hasher, (places, signs) = _hasher(), _index_vectors()
        total = np.zeros((1 << ROW_BITS) * DIMS, dtype=np.int64)
        for batch in batches:
            for _, _, owner, row in _rows(batch.column(0).to_pylist(), hasher, 1 << 20):
                at = row * DIMS
                for step in range(1, REACH + 1):
                    same = owner[step:] == owner[:-step]
                    for word, other in ((at[step:][same], row[:-step][same]), (at[:-step][same], row[step:][same])):
                        for k in range(SPARSE):
                            cell, plus = word + places[k][other], signs[k][other]
                            total += np.bincount(cell[plus], minlength=len(total))
                            total -= np.bincount(cell[~plus], minlength=len(total))
        lines = total.reshape(-1, DIMS)
        met = np.flatnonzero(lines.any(axis=1))
        yield _lines(met, lines[met])

    def add(batches):
        last, held = -1, np.zeros(DIMS, dtype=np.int64)
        for batch in batches:
            row = batch.column(0).to_numpy()
            if not len(row):
                continue
            lines = batch.column(1).flatten().to_numpy().reshape(-1, DIMS)
            heads = np.flatnonzero(np.diff(row, prepend=row[0] - 1))
            sums = np.add.reduceat(lines, heads, axis=0)
            if row[0] == last:
                sums[0] += held
            elif last >= 0:
                yield _lines(np.array([last]), held[None, :])
            yield _lines(row[heads[:-1]], sums[:-1])
            last, held = int(row[-1]), sums[-1]
        if last >= 0:
            yield _lines(np.array([last]), held[None, :])

    schema = "row long, line array<long>"
    summed = texts.mapInArrow(count, schema).repartition("row").sortWithinPartitions("row").mapInArrow(add, schema)
    vectors = np.zeros((1 << ROW_BITS, DIMS), dtype=np.float64)
    found = summed.toArrow()
    if found.num_rows:
        lines = found.column("line").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
        vectors[found.column("row").to_numpy()] = lines
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.maximum(norm, 1e-12)).astype(np.float32)


def _lines(row: np.ndarray, lines: np.ndarray) -> pa.RecordBatch:
    flat = pa.FixedSizeListArray.from_arrays(pa.array(lines.ravel()), DIMS).cast(pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(row), flat], names=["row", "line"])


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_key, features)``: mean and root mean square of the word vectors; zeros without words.

    ``text_key`` tells the rows of one id, or without an id, apart by their texts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        hasher, table = _hasher(), shared.value
        for batch in batches:
            out = np.zeros((batch.num_rows, 2 * DIMS), dtype=np.float32)
            for first, n, owner, row in _rows(batch.column(1).to_pylist(), hasher, 1 << 18):
                if not len(row):
                    continue
                mine, heads, counts = np.unique(owner, return_index=True, return_counts=True)
                words = table[row]
                out[first + mine, :DIMS] = np.add.reduceat(words, heads, axis=0) / counts[:, None]
                out[first + mine, DIMS:] = np.sqrt(np.add.reduceat(words * words, heads, axis=0) / counts[:, None])
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), 2 * DIMS).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), flat], names=["id", "text_key", "features"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.cast("binary").alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "id long, text_key long, features array<float>")


@dataclass
class Network:
    """Two layers on standardized features, with a temperature; ``prior`` alone if nothing could be learned."""

    prior: float = 0.5
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w, b, v, c = self.layers
        return np.maximum((x - self.mean) / self.scale @ w + b, 0) @ v + c

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, calibration: np.ndarray) -> Network:
    """Fit on the rows outside ``calibration`` with Adam, then the temperature on those inside it."""
    own = ~calibration
    if not own.any() or len(np.unique(y[own])) < 2:
        return Network(prior=float(y[own].mean()) if own.any() else 0.5)
    rng = np.random.default_rng(SEED)
    mean, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-6
    z, t = (x[own] - mean) / scale, y[own].astype(np.float64)
    layers = [rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(z))
        for at in range(0, len(order), BATCH):
            some, step = order[at : at + BATCH], step + 1
            hidden = np.maximum(z[some] @ layers[0] + layers[1], 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -50, 50))) - t[some]) / len(some)
            back = np.outer(error, layers[2]) * (hidden > 0)
            grads = [z[some].T @ back + DECAY * layers[0], back.sum(axis=0), hidden.T @ error + DECAY * layers[2], np.array([error.sum()])]
            for p, g, m, v in zip(layers, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net = Network(float(t.mean()), mean, scale, tuple(layers))
    if calibration.any() and len(np.unique(y[calibration])) == 2:
        z, t = net.logits(x[calibration]), y[calibration]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 80))
        losses = [np.logaddexp(0, np.where(t == 1, -z, z) / g).mean() for g in grid]
        net.temperature = float(grid[int(np.argmin(losses))])
    return net


def fold(column: str):
    """crc32 of the id as text, modulo ``FOLDS``; null for a null id."""
    return F.crc32(F.col(column).cast("string")) % FOLDS


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(id, held_out, score)`` for every row of ``docs``: the probability that its label is 1.

    Word vectors come from all texts. The network learns from labelled rows outside fold 0 alone, at
    most ``max_labelled`` of them (a sample by hashed id), and only from their texts. Rows in fold 0
    are held out. A null text counts as empty and gets the score of a text without words. A null id
    is never learned from or held out. Null labels are ignored, repeated label rows count each. With
    no labels the score is 0.5, with one label only it is that label. Other columns are ignored; an
    empty table gives an empty result.
    """
    scored = _scored(docs, labels, id_col, text_col, label_col, max_labelled)
    return scored.select(F.col("id").alias(id_col), F.coalesce(fold("id") == 0, F.lit(False)).alias("held_out"), "score")


def _scored(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> DataFrame:
    features = stage(pooled(docs, word_vectors(docs, text_col), id_col, text_col), "document-vectors")
    marked = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = features.where(fold("id") != 0).join(marked, "id").select("features", "label", fold("id").alias("fold"), F.xxhash64("id").alias("at"))
    sample = known.orderBy("at", "label").limit(max_labelled).toArrow()
    x = np.array(sample.column("features").to_pylist(), dtype=np.float64).reshape(-1, 2 * DIMS)
    net = fit(x, sample.column("label").to_numpy(), sample.column("fold").to_numpy() == CALIBRATION_FOLD)

    def run(batches):
        for batch in batches:
            x = batch.column(2).flatten().to_numpy().reshape(-1, 2 * DIMS).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(net.scores(x))], names=["id", "text_key", "score"])

    return features.mapInArrow(run, "id long, text_key long, score double")


def keep_good(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``docs`` without the rows whose score is below ``threshold``; each row is judged by its own text."""
    scores = _scored(docs, labels, id_col, text_col, label_col, max_labelled)
    own, key = unused("_id", docs), unused("_key", docs)
    rejected = scores.where(F.col("score") < threshold).select(F.col("id").alias(own), F.col("text_key").alias(key)).distinct()
    same = docs[id_col].eqNullSafe(F.col(own)) & (F.xxhash64(whole_text(text_col)) == F.col(key))
    return docs.join(rejected, same, "left_anti")
