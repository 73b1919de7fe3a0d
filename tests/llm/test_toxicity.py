"""The field's marginals against a plain recursion, whole texts in pieces, odd rows, held-out accuracy."""

import random
import re

import numpy as np
import pytest
from conftest import odd_rows

from deltascreen.llm import queries, toxicity

WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


def model(seed=1):
    rng = np.random.default_rng(seed)
    moves = np.array([[0.3, -1.0], [-0.7, 0.9]])
    return toxicity.Field(rng.normal(0, 1.5, 1 << toxicity.ROW_BITS).astype(np.float32), -0.5, moves, np.array([-1.0, 1.0, 2.0]))


def plain(text, field):
    """Marginals of the toxic tag by the textbook recursion, word by word."""
    raw = text.encode()
    starts, ends = toxicity.tokens(raw)
    e = field.emissions(toxicity.features(raw, starts, ends)) if len(starts) else []
    potential, move, forward = [np.array([1.0, np.exp(x)]) for x in e], np.exp(field.moves), []
    for k, own in enumerate(potential):
        a = own if k == 0 else (forward[-1] @ move) * own
        forward.append(a / a.sum())
    backward = [np.ones(2)] * len(forward)
    for k in range(len(forward) - 2, -1, -1):
        b = move @ (potential[k + 1] * backward[k + 1])
        backward[k] = b / b.sum()
    return [(f * b)[1] / (f * b).sum() for f, b in zip(forward, backward, strict=True)]


def expected(text, field):
    p = plain(text, field)
    words = [m.span() for m in WORD.finditer(text)]
    assert len(words) == len(p)
    spans = []
    for k, (a, b) in enumerate(words):
        if p[k] > 0.5 and k and p[k - 1] > 0.5:
            spans[-1] = (spans[-1][0], b)
        elif p[k] > 0.5:
            spans.append((a, b))
    return sum(x * x for x in p), max(p, default=0), spans


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["a", "B", "th", "é", "漢", "xyz", "9"]) for _ in range(rng.randint(1, 6)))
    return ["", " ", "one", "x" * 40, *(rng.choice(["", " "]) + " .,".join(word() for _ in range(n)) for n in (1, 2, 3, 17, 400))]


@pytest.mark.parametrize("piece", [1 << 20, 300, 20])
def test_marginals_equal_the_plain_recursion(monkeypatch, piece):
    monkeypatch.setattr(toxicity, "PIECE", piece)
    field = model()
    some = [t for t in texts() if piece >= 300 or all(len(w.encode()) < 20 for w in WORD.findall(t))]
    for text, (total, peak, spans) in zip(some, toxicity.text_marginals([t.encode() for t in some], field), strict=True):
        want = expected(text, field)
        assert total == pytest.approx(want[0], rel=1e-9) and peak == pytest.approx(want[1], rel=1e-9) and spans == want[2]


def test_features_tell_words_apart():
    raw = "Idiot idiot IDIOT idiots id abcdefghijk abcdefgZhijk é".encode()
    rows = toxicity.features(raw, *toxicity.tokens(raw))
    assert (rows[0] == rows[1]).all() and (rows[0] == rows[2]).all()
    whole = rows[:, 0].tolist()
    assert len(set(whole[2:])) == 6
    assert rows[3][2] == rows[0][2] and rows[5][1] == rows[6][1] and rows[5][0] != rows[6][0]


def test_gradient_steps_learn_a_planted_tag():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 50, (400, 12, 2)).astype(np.int32)
    rows[:, :, 1] += 50
    tags = (rows[:, :, 0] < 5).astype(np.int8)
    tags[::7, 9:] = -1
    field = toxicity.learn(rows, tags)
    p = field.emissions(rows.reshape(-1, 2)).reshape(400, 12)
    assert ((p > 0) == (tags == 1))[tags >= 0].mean() > 0.99


def test_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    scored = queries.QUERIES["op11_toxicity"](spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(scored) == 10_000 and scored.score.between(0, 1).all()
    held = scored[scored.held_out].merge(labels, on="doc_id")
    toxic, clean = held[held.toxic == 1], held[held.toxic == 0]
    assert toxic.predicted.mean() > 0.85 and clean.predicted.mean() < 0.01


def test_odd_rows_and_empty_tables(spark, odd, none):
    ids = [r[0] for r in odd_rows()]
    label = spark.createDataFrame([(i, 1 if i == 5 else 0, 3) for i in {i for i in ids if i is not None}] + [(None, 1, 3), (3, None, 3)], "doc_id long, toxic int, score int")
    got = toxicity.toxicity(odd, label).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(map(str, ids))
    assert all(0 <= r.score <= 1 for r in got) and not any(r.held_out for r in got if r.doc_id is None)
    assert toxicity.toxicity(none, label).collect() == []
    assert {r.score for r in toxicity.toxicity(odd, label.where("false")).collect()} == {0.5}
