"""Toxicity: a linear-chain conditional random field over a text's words, with scores from its marginals.

Words are the tokens, clean and toxic the two tags. Labels mark documents, so token labels come from
them: a word form (a whole word or its first letters) that occurs in many toxic texts and hardly in clean
ones marks the words of toxic texts that show it; every word of a clean text is clean. The field learns
from windows of such labelled tokens. Forward and backward sums over a whole text give every word's
marginal; a logistic function of the sum of their squares and of the greatest, fitted on a fold that the field has
not seen, gives the score, and words above one half give the offending offsets.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import alnum_kind, ascii_fold, blocks, mix64, stage, whole_text

#: Labelled documents that are learned from at most (lowest hashes of their texts).
MAX_LABELLED = 10_000
FOLDS, CALIBRATION_FOLD = 5, 1
#: Feature rows (a power of two); leading and trailing bytes of a word that are features of their own.
ROW_BITS = 18
HEADS, TAIL = (3, 4, 5, 6, 7), 4
#: A form marks toxic words with so many toxic texts and so many times their share of clean texts.
LEAST_TEXTS, LEAST_RATIO = 3, 20
#: Tokens of a training window, and windows of a document.
WINDOW, WINDOWS = 48, 2
EPOCHS, STEPS, BATCH, RATE, DECAY, SEED = 12, 400, 256, 0.1, 1e-5, 3
#: (Above: epochs, and gradient steps at least, which small samples reach by more epochs.)
#: Bytes that are tokenized at once; a longer text is taken in pieces of this size, cut between words.
PIECE = 1 << 20
KIND, FOLD = alnum_kind(), ascii_fold().astype(np.uint8)
CLEAN, TOXIC = 0, 1


def tokens(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words of ``raw``."""
    inside = KIND[np.frombuffer(raw, dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(inside, prepend=np.uint8(0), append=np.uint8(0)))
    return edge[::2], edge[1::2]


def features(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``(words, features)`` rows of every word: itself, its heads, its tail, all with A-Z in lower case."""
    data = np.concatenate([np.zeros(8, dtype=np.uint8), FOLD[np.frombuffer(raw, dtype=np.uint8)], np.zeros(8, dtype=np.uint8)])
    eight = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        eight |= data[k : len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    size = ends - starts
    low = lambda n: np.uint64((1 << (8 * n)) - 1)
    short = np.minimum(size, 8).astype(np.uint64)
    head = eight[starts + 8] & np.where(short == 8, ~np.uint64(0), (np.uint64(1) << (np.uint64(8) * (short % np.uint64(8)))) - np.uint64(1))
    tail = eight[ends] >> (np.uint64(8) * (np.uint64(8) - short))
    out = np.empty((len(starts), len(HEADS) + 2), dtype=np.int32)
    keys = [head ^ mix64(tail ^ (size.astype(np.uint64) << np.uint64(56))), *(head & low(n) for n in HEADS), tail >> (np.uint64(8) * (short - np.minimum(short, np.uint64(TAIL))))]
    for k, key in enumerate(keys):
        out[:, k] = mix64(key + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))) >> np.uint64(64 - ROW_BITS)
    return out


def pieces(raw: bytes):
    """``(offset, bytes)`` of consecutive pieces, cut between words; a word of over a piece's size is cut inside."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        if end < len(raw):
            outside = np.flatnonzero(KIND[np.frombuffer(raw[at:end], dtype=np.uint8)] == 0)
            end = at + int(outside[-1]) + 1 if len(outside) else end
        yield at, raw[at:end]
        at = end


@dataclass
class Field:
    """Tag weights of features (toxic against clean), a bias, transition weights; logistic weights of a text."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << ROW_BITS, dtype=np.float32))
    bias: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    text: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emissions(self, rows: np.ndarray) -> np.ndarray:
        """Log potential of the toxic tag of every word (the clean tag's is zero)."""
        return self.weights[rows].sum(axis=1, dtype=np.float64) + self.bias


def _unit(m: np.ndarray, axis) -> np.ndarray:
    return m / np.maximum(m.sum(axis=axis, keepdims=True), 1e-300)


def steps(emission: np.ndarray, heads: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """``(lanes, words of a lane, 2, 2)``: what every word does to a message, words of many texts in a row.

    ``heads`` marks the first word of every text; there the chain starts anew. The last lane is filled up
    with words that change nothing.
    """
    n = len(emission)
    long = -(-n // max(1, int(np.sqrt(n))))
    lanes = -(-n // long)
    step = np.zeros((lanes * long, 2, 2))
    step[:, [0, 1], [0, 1]] = 1
    peak = np.maximum(emission, 0)
    potential = np.stack([np.exp(-peak), np.exp(emission - peak)], axis=1)
    step[:n] = np.where(heads[:, None, None], 1.0, np.exp(moves - moves.max())) * potential[:, None, :]
    return step.reshape(lanes, long, 2, 2)


def products(step: np.ndarray) -> np.ndarray:
    """The product of every lane's matrices, lanes side by side."""
    out = np.broadcast_to(np.eye(2), (len(step), 2, 2))
    for t in range(step.shape[1]):
        out = _unit(out @ step[:, t], (1, 2))
    return out


def messages(step: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward messages of all words: first from lane to lane, then in all lanes side by side."""
    lanes, long = step.shape[:2]
    product, before, behind = products(step), np.empty((lanes, 2)), np.empty((lanes, 2))
    for k in range(lanes):
        before[k], start = start, _unit(start @ product[k], 0)
    for k in range(lanes - 1, -1, -1):
        behind[k], stop = stop, _unit(product[k] @ stop, 0)
    forward, backward = np.empty((lanes, long, 2)), np.empty((lanes, long, 2))
    for t in range(long):
        before = _unit(before[:, 0, None] * step[:, t, 0] + before[:, 1, None] * step[:, t, 1], 1)
        forward[:, t] = before
    for t in range(long - 1, -1, -1):
        backward[:, t] = behind
        behind = _unit(step[:, t, :, 0] * behind[:, 0, None] + step[:, t, :, 1] * behind[:, 1, None], 1)
    return forward.reshape(-1, 2), backward.reshape(-1, 2)


EVEN = np.array([0.5, 0.5])


def marginals(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag of every word."""
    both = forward * backward
    return both[:, TOXIC] / np.maximum(both.sum(axis=1), 1e-300)


def learn(rows: np.ndarray, tags: np.ndarray) -> Field:
    """Fit on windows of equal length (``rows``: window, word, feature; ``tags`` -1 where a window has ended).

    Gradients of the log likelihood are expected counts from forward and backward sums less the counts
    seen; steps are scaled by each weight's past gradients.
    """
    model, rng = Field(), np.random.default_rng(SEED)
    scale, other = np.full(len(model.weights), 1e-6), np.full(5, 1e-6)
    weights, bias, moves = model.weights.astype(np.float64), 0.0, np.zeros((2, 2))
    for _ in range(max(EPOCHS, STEPS // max(1, -(-len(rows) // BATCH)))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            some = order[at : at + BATCH]
            r, t = rows[some], tags[some]
            real = t >= 0
            e = np.where(real, weights[r].sum(axis=2) + bias, 0)
            forward, backward = _windows(e, real, moves)
            both = forward * backward
            p = both[:, :, TOXIC] / both.sum(axis=2)
            error = np.where(real, p - (t == TOXIC), 0)
            grad = np.bincount(r.reshape(-1), np.repeat(error.reshape(-1), r.shape[2]), minlength=len(weights))
            pair = real[:, 1:] & real[:, :-1]
            potential = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
            joint = forward[:, :-1, :, None] * np.exp(moves) * (potential * backward)[:, 1:, None, :]
            joint = joint / joint.sum(axis=(2, 3), keepdims=True)
            seen = np.zeros_like(joint)
            i, j = np.nonzero(pair)
            seen[i, j, t[:, :-1][i, j], t[:, 1:][i, j]] = 1
            step = np.concatenate([[error.sum()], ((joint - seen) * pair[:, :, None, None]).sum(axis=(0, 1)).reshape(-1)]) / len(some)
            grad = grad / len(some) + DECAY * weights
            scale += grad * grad
            other += step * step
            weights -= RATE * grad / np.sqrt(scale)
            step = RATE * step / np.sqrt(other)
            bias -= step[0]
            moves -= step[1:].reshape(2, 2)
    return Field(weights.astype(np.float32), float(bias), moves)


def _windows(e: np.ndarray, real: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Messages of many windows of one length, side by side; places behind a window's end leave them alone."""
    w, long = e.shape
    potential = np.stack([np.ones_like(e), np.exp(np.clip(e, -30, 30))], axis=2)
    move = np.exp(moves)
    forward, backward = np.full((w, long, 2), 0.5), np.full((w, long, 2), 0.5)
    now = potential[:, 0] / potential[:, 0].sum(axis=1, keepdims=True)
    forward[:, 0] = now
    for t in range(1, long):
        new = (now @ move) * potential[:, t]
        now = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), now)
        forward[:, t] = now
    now = np.full((w, 2), 0.5)
    for t in range(long - 1, 0, -1):
        backward[:, t] = now
        new = (potential[:, t] * now) @ move.T
        now = np.where(real[:, t, None], new / new.sum(axis=1, keepdims=True), now)
    backward[:, 0] = now
    return forward, backward


def _flat(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and features of all words of a text, piece by piece."""
    starts, ends, rows = [], [], []
    for at, piece in pieces(raw):
        a, b = tokens(piece)
        starts.append(a + at), ends.append(b + at), rows.append(features(piece, a, b))
    if not starts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros((0, len(HEADS) + 2), dtype=np.int32)
    return np.concatenate(starts), np.concatenate(ends), np.concatenate(rows)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, limit: int) -> DataFrame:
    """``(text, label, fold)`` of at most ``limit`` labelled ids outside fold 0, each text once."""
    id_ = F.col(id_col).cast("long")
    known = labels.select(id_.alias("id"), F.col(label_col).cast("int").alias("label")).where("label in (0, 1)")
    known = known.withColumn("fold", F.crc32(F.col("id").cast("string")) % FOLDS).where("fold <> 0").distinct()
    known = known.orderBy(F.xxhash64("id"), "id", "label").limit(limit)
    texts = docs.select(id_.alias("id"), whole_text(text_col).cast("binary").alias("text")).join(F.broadcast(known), "id")
    return stage(texts.groupBy("text").agg(F.max("label").alias("label"), F.min("fold").alias("fold")), "labelled-texts")


def _marks(sample: DataFrame) -> np.ndarray:
    """Which feature rows mark toxic words: by the toxic and the clean texts that hold them."""

    def count(batches):
        seen = np.zeros((2, 1 << ROW_BITS), dtype=np.int64)
        for batch in batches:
            for raw, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[label, np.unique(_flat(raw)[2])] += 1
        met = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(seen[0, met]), pa.array(seen[1, met])], names=["row", "clean", "toxic"])

    texts = sample.groupBy("label").count().toArrow()
    n = dict(zip(texts.column("label").to_pylist(), texts.column("count").to_pylist(), strict=True))
    found = sample.select("text", "label").mapInArrow(count, "row long, clean long, toxic long")
    found = found.groupBy("row").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    marks = np.zeros(1 << ROW_BITS, dtype=bool)
    if found.num_rows and len(n) == 2:
        clean, toxic = found.column("clean").to_numpy(), found.column("toxic").to_numpy()
        marks[found.column("row").to_numpy()] = (toxic >= LEAST_TEXTS) & (toxic / n[1] >= LEAST_RATIO * (clean + 0.5) / n[0])
    return marks


def _training_windows(sample: DataFrame, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows of labelled tokens: round marked words where a text has some, else anywhere in clean texts."""
    shared = sample.sparkSession.sparkContext.broadcast(marks)
    width = len(HEADS) + 2

    def cut(batches):
        for batch in batches:
            out = []
            for raw, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _flat(raw)[2]
                marked = shared.value[rows].any(axis=1)
                places = np.flatnonzero(marked) if marked.any() else np.arange(len(rows)) if label == CLEAN else np.zeros(0, dtype=np.int64)
                chosen = places[np.linspace(0, len(places) - 1, WINDOWS).astype(int)] if len(places) else places
                for begin in np.unique(np.maximum(chosen - WINDOW // 2, 0)):
                    own, tags = rows[begin : begin + WINDOW], marked[begin : begin + WINDOW] & (label == TOXIC)
                    padded, tag = np.zeros((WINDOW, width), dtype=np.int32), np.full(WINDOW, -1, dtype=np.int8)
                    padded[: len(own)], tag[: len(own)] = own, tags
                    out.append((padded.tobytes(), tag.tobytes()))
            columns = list(zip(*out, strict=True)) if out else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], names=["rows", "tags"])

    found = sample.select("text", "label").mapInArrow(cut, "rows binary, tags binary").orderBy(F.xxhash64("rows"), "rows").toArrow()
    rows = np.frombuffer(b"".join(found.column("rows").to_pylist()), dtype=np.int32).reshape(-1, WINDOW, width)
    return rows, np.frombuffer(b"".join(found.column("tags").to_pylist()), dtype=np.int8).reshape(-1, WINDOW)


def _spans(raw: bytes, starts: np.ndarray, ends: np.ndarray, p: np.ndarray, base: int) -> list[tuple[int, int]]:
    """Code point ranges of runs of words above one half; ``base`` code points stand before ``raw``."""
    toxic = p > 0.5
    if not toxic.any():
        return []
    edge = np.flatnonzero(np.diff(toxic, prepend=False, append=False))
    first, last = edge[::2], edge[1::2] - 1
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)]) + base
    return list(zip(points[starts[first]].tolist(), points[ends[last]].tolist(), strict=True))


def _long_text(raw: bytes, model: Field) -> tuple[float, float, list]:
    """Sum of squares and peak of the marginals and the spans of a text of several pieces: their products first, then each again."""
    total, peak, spans, base = 0.0, 0.0, [], 0
    cut = []
    for at, piece in pieces(raw):
        starts, ends = tokens(piece)
        heads = np.zeros(len(starts), dtype=bool)
        heads[: 1 if not any(n for *_, n in cut) else 0] = True
        product = np.eye(2)
        if len(starts):
            for m in products(steps(model.emissions(features(piece, starts, ends)), heads, model.moves)):
                product = _unit(product @ m, (0, 1))
        cut.append((at, len(piece), product, len(starts)))
    behind, stop = [], EVEN
    for *_, product, _ in reversed(cut):
        behind.append(stop)
        stop = _unit(product @ stop, 0)
    start, met, open_span = EVEN, False, False
    for (at, size, product, n), stop in zip(cut, reversed(behind), strict=True):
        piece = raw[at : at + size]
        starts, ends = tokens(piece)
        if n:
            heads = np.zeros(n, dtype=bool)
            heads[0] = not met
            forward, backward = messages(steps(model.emissions(features(piece, starts, ends)), heads, model.moves), start, stop)
            p = marginals(forward[:n], backward[:n])
            total, peak, met = total + (p * p).sum(), max(peak, p.max()), True
            own = _spans(piece, starts, ends, p, base)
            if open_span and p[0] > 0.5:
                own[0] = (spans.pop()[0], own[0][1])
            spans, open_span = spans + own, p[-1] > 0.5
        base += int(((np.frombuffer(piece, dtype=np.uint8) & 0xC0) != 0x80).sum())
        start = _unit(start @ product, 0)
    return float(total), float(peak), spans


def text_marginals(texts: list[bytes], model: Field) -> list[tuple[float, float, list]]:
    """For every text the sum of squares and the greatest of its words' marginals, and its toxic spans."""
    out = []
    for a, b in blocks([len(t) for t in texts], PIECE):
        if b == a + 1 and len(texts[a]) > PIECE:
            out.append(_long_text(texts[a], model))
            continue
        raw = b"\x00".join(texts[a:b]) + b"\x00"
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[a:b]])
        starts, ends = tokens(raw)
        if not len(starts):
            out += [(0.0, 0.0, [])] * (b - a)
            continue
        owner = np.searchsorted(offsets, starts, side="right") - 1
        heads = np.diff(owner, prepend=-1) != 0
        forward, backward = messages(steps(model.emissions(features(raw, starts, ends)), heads, model.moves), EVEN, EVEN)
        p = marginals(forward[: len(starts)], backward[: len(starts)])
        low = np.searchsorted(owner, np.arange(b - a + 1))
        for k in range(b - a):
            own = slice(low[k], low[k + 1])
            some = p[own]
            spans = _spans(texts[a + k], starts[own] - offsets[k], ends[own] - offsets[k], some, 0) if len(some) else []
            out.append((float((some * some).sum()), float(some.max(initial=0)), spans))
    return out


def _shape(total: np.ndarray, peak: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(total), np.log(total + 0.05), peak], axis=1)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights by Newton steps with a small ridge, which keeps separable cases finite."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.eye(len(w)) * 0.05
        w = w - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int) -> Field:
    """The field from the folds other than 0 and CALIBRATION_FOLD; the logistic weights from the latter (all, if it has one label)."""
    sample = _labelled(docs, labels, id_col, text_col, label_col, max_labelled)
    own = sample.where(F.col("fold") != CALIBRATION_FOLD)
    rows, tags = _training_windows(own, _marks(own))
    model = learn(rows, tags) if (tags == TOXIC).any() else Field()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = text_marginals(batch.column(0).to_pylist(), shared.value)
            columns = [pa.array([f[k] for f in found], pa.float64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1), batch.column(2)], names=["total", "peak", "label", "fold"])

    seen = sample.select("text", "label", "fold").mapInArrow(run, "total double, peak double, label int, fold long").toArrow()
    x, y = _shape(seen.column("total").to_numpy(), seen.column("peak").to_numpy()), seen.column("label").to_numpy()
    calibration = seen.column("fold").to_numpy() == CALIBRATION_FOLD
    if len(np.unique(y[calibration])) < 2:
        calibration[:] = True
    if calibration.any():
        model.text = _logistic(x[calibration], y[calibration])
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """``(id, held_out, score, toxic_words, spans)`` for every row of ``docs``.

    ``score`` is the probability that the text's label is 1, ``toxic_words`` the sum of its words' squared
    marginals (many words that are hardly toxic add little) and ``spans`` the code point ranges of runs of words that are likelier toxic than not. Learned from
    at most ``max_labelled`` labelled ids outside fold 0 (crc32 of the id as text, modulo FOLDS) and from
    their texts alone; rows in fold 0 are held out. Null texts count as empty; texts without words get the
    score of a sum of zero; a null id is never held out; null labels are ignored; an id with both labels, and
    copies with different ones, count as toxic. Without labels the score is 0.5. Texts are read whole: those
    of over PIECE bytes in pieces whose messages are passed on. Other columns are ignored; an empty table
    gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, id_col, text_col, label_col, max_labelled))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = text_marginals(batch.column(1).to_pylist(), shared.value)
            total, peak = (np.array([f[k] for f in found], dtype=np.float64) for k in range(2))
            score = 1 / (1 + np.exp(-np.clip(_shape(total, peak) @ shared.value.text, -30, 30)))
            spans = pa.array([[{"start": a, "end": b} for a, b in f[2]] for f in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(total), spans], names=["id", "score", "toxic_words", "spans"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).cast("binary").alias("text"))
    scored = rows.mapInArrow(run, "id long, score double, toxic_words double, spans array<struct<start:long,end:long>>")
    held_out = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select(F.col("id").alias(id_col), held_out.alias("held_out"), "score", "toxic_words", "spans")
