"""Chat formatting, token counts, embeddings, the pipeline."""

import hashlib
import importlib.util
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle_check import compare, duck

from deltascreen.llm import chat, embeddings, queries, simhash, token_counts

PARTS = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "\\", "<", "|", "<\\|im_end|>", "im_", "\n", "a", "é", "assistant", "<|im_end", "\\n", "\\l"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(PARTS), max_size=4), st.lists(st.sampled_from(PARTS), max_size=7)), min_size=1, max_size=4))
def test_turns_round_trip(turns):
    turns = [("".join(r), "".join(t)) for r, t in turns]
    written = [chat.write_turn(r, t) for r, t in turns]
    text, at, got = "".join(w[0] for w in written), 0, []
    while at < len(text):
        role, said, at = chat.parse_turn(text, at)
        got.append((role, said))
    assert got == turns
    for (_, said), (turn, low, high) in zip(turns, written, strict=True):
        assert chat.unescape_text(turn[low:high]) == said
        assert not chat._CONTROL.search(turn[low:high])


def test_plain_turns_are_not_escaped():
    assert chat.write_turn("user", "a < b | c \\ d")[0] == "<|im_start|>user\na < b | c \\ d<|im_end|>\n"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    status, note = compare(spark, duck(SMALL), SMALL, queries.QUERIES[name], queries.ORACLES[name])
    assert status == "ok", note


def test_odd_conversations(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 1, "assistant", None), (1, 0, None, "x"), (1, None, "user", "first"), (2, 0, "assistant", said), (2, 0, "assistant", said),
        (None, 0, "as\nsis<|im_end|>tant", "y\\"), (3, 0, "assistant", "z" * 200_000), (2, 0, "assistant", "a tie"),
    ]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, start int")
    formatted = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    assert got.keys() == groups.keys()
    whole = {r.conv_id: r.text for r in chat.training_texts(formatted).collect()}
    for conv, turns in groups.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        assert got[conv].n_turns == len(turns) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].formatted_chars == len(whole[conv])
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNT = token_counts.encoder(RANKS, public_tokenizers.PATTERN)
TOKENS = ["word", "a", " ", "  ", "\n", "\n\n", "\t", "'s", "12", "é", "...", "\x85", "\xa0", "\x1c", "漢", " the", "!"]


@pytest.mark.parametrize("seed", range(4))
def test_updated_trees_count_like_a_new_encoding(seed):
    rng = random.Random(seed)
    for _ in range(40):
        text = "".join(rng.choice(TOKENS) for _ in range(rng.choice([0, 1, 5, 300, 2500])))
        tree = token_counts.CountTree.of(text, COUNT)
        for _ in range(3):
            edits = []
            for _ in range(rng.choice([1, 2, 8])):
                start = rng.randint(0, len(text) + 2)
                new = "".join(rng.choice(TOKENS) for _ in range(rng.choice([0, 1, 4, 900 if rng.random() < 0.2 else 2])))
                edits.append((start, start + rng.choice([0, 0, 1, 3, 40, 700]), new))
            want, last = "", 0
            for start, end, new in sorted(edits):
                start = min(max(start, last), len(text))
                end = min(max(end, start), len(text))
                want, last = want + text[last:start] + new, end
            want += text[last:]
            text, done, _ = token_counts.apply_edits(text, tree, edits, COUNT)
            assert text == want and done == len(edits)
            assert tree.total == COUNT(text) == tree.tokens[tree.base :].sum() and tree.chars[1] == len(text)


def test_an_edit_encodes_only_its_surroundings():
    text = " ".join(["token"] * 20_000)
    tree = token_counts.CountTree.of(text, COUNT)
    new, _, encoded = token_counts.apply_edits(text, tree, [(60_000, 60_005, "other words")], COUNT)
    assert tree.total == COUNT(new) and encoded < 4 * token_counts.LEAF


def test_token_count_query(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_token_counts"](spark, SMALL).collect()}
    import re

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        new, n = re.subn(queries.PERSONAL, "[PERSONAL]", d.text or "")
        own = rows[d.doc_id]
        assert (own.n_tokens_before, own.n_edits, own.n_tokens, own.n_chars) == (COUNT(d.text or ""), n, COUNT(new), len(new))


def test_token_counts_of_odd_rows(spark, odd, none):
    trees = token_counts.with_trees(odd, RANKS, public_tokenizers.PATTERN)
    edits = spark.createDataFrame([(5, 3, 9, "x"), (5, 0, 0, None), (0, 0, 0, "new"), (77, 0, 1, "y"), (8, 100, 5000, None)], "doc_id long, start long, end long, replacement string")
    after = token_counts.update_counts(token_counts.with_edits(trees, edits), RANKS, public_tokenizers.PATTERN)
    rows = after.collect()
    assert len(rows) == odd.count() and all(r.n_tokens == COUNT(r.text or "") for r in rows)
    assert Counter(r.n_edits for r in rows if r.doc_id == 5) == {2: 2}
    assert {r.text for r in rows if r.doc_id == 0} == {"new"} and {r.text for r in rows if r.doc_id == 1} == {None}
    assert token_counts.with_trees(none, RANKS, public_tokenizers.PATTERN).count() == 0


def brute_links(rows, threshold=0.93):
    """Number of links and smallest reachable id of every row."""
    parent, links, spaces = list(range(len(rows))), [0] * len(rows), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            spaces[(label, len(v))].append((i, np.array(v) / np.linalg.norm(v)))
    for own in spaces.values():
        x = np.array([v for _, v in own])
        for a, b in zip(*np.nonzero(x @ x.T >= threshold), strict=True):
            if a != b:
                links[own[a][0]] += 1
                parent[find(own[a][0])] = find(own[b][0])
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    return links, [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(rows))]


@pytest.mark.parametrize("size", [60, 400])
def test_embeddings_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(embeddings, "CLUSTER", 100)
    monkeypatch.setattr(embeddings, "CHUNK", 64)
    rng = np.random.default_rng(size)
    base = rng.normal(size=(size, 16))
    near = base[rng.integers(0, 6, size)] + 0.12 * rng.normal(size=(size, 16))
    vectors = [*base.tolist(), *near.tolist(), *near[:9].tolist(), (3 * near[0]).tolist()]
    rows = [(i, v, int(i % 3)) for i, v in enumerate(vectors)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [nan] * 16, [inf] * 16, [1.0, 2.0], [2.0, 4.0]]
    rows += [(10_000 + i, v, 0) for i, v in enumerate(odd)] + [(20_000, vectors[0], None), (0, vectors[1], 1), (None, vectors[0], 0)]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, label int, n int, class long")
    got = embeddings.near_duplicates(df).collect()
    links, least = brute_links(rows)
    assert sum(r.n_links for r in got) >= 0.9 * sum(links)
    want = Counter(zip((r[0] for r in rows), links, least, strict=True))
    same = Counter((r.vec_id, r.n_links, r.component_id) for r in got)
    assert sum((want & same).values()) >= 0.95 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_a_link_that_only_a_later_shard_finds_is_kept(spark):
    vectors = (np.ones(8) + 0.05 * np.random.default_rng(6).normal(size=(12, 8))).tolist()
    ids = list(range(12))
    # in shard 3 no class has neighbours, so the search sees one node only; shard 5 has the whole graph
    rows = [("8:0", shard, 0, 0, 0, i, vectors[i], 1, [3, 5], ids if shard == 5 else []) for shard in (3, 5) for i in ids]
    names = "space string, shard int, first int, second int, chunk int, class long, vector array<double>, n long, shards array<int>, neighbours array<long>"
    got = embeddings._meet(spark.createDataFrame(rows, names), 0.93, 4).collect()
    assert sorted((r["class"], r.links, r.root) for r in got) == [(i, 11, 0) for i in ids]


def test_a_group_of_copies_does_not_hide_missed_pairs(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CLUSTER", 40)
    rng = np.random.default_rng(3)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base, other = unit(rng.normal(size=(700, 32))), unit(rng.normal(size=(700, 32)))
    other = unit(other - (other * base).sum(axis=1, keepdims=True) * base)
    pairs = 0.94 * base + np.sqrt(1 - 0.94**2) * other
    group = unit(base[0] + 0.02 * rng.normal(size=(400, 32)))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate([base, pairs, group]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "OVERLAP", (1,))
    with pytest.raises(RuntimeError, match="recall"):
        embeddings.near_duplicates(df)
    monkeypatch.setattr(embeddings, "OVERLAP", (1, 64))
    got = {r.vec_id: r for r in embeddings.near_duplicates(df).collect()}
    assert sum(got[i].component_id == got[700 + i].component_id for i in range(700)) >= 0.97 * 700


def test_an_audit_grows_and_without_links_measures_nothing(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "AUDITED_LEAST", 10)
    monkeypatch.setattr(embeddings, "AUDIT_BLOCK", 30)
    rng = np.random.default_rng(4)
    rows = [(i, v, 0) for i, v in enumerate(rng.normal(size=(4000, 24)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    every = embeddings.stage(embeddings.classes(df, "vec_id", "embedding", "label"), "audit-test")
    true, whole = embeddings.true_links(every, 0.999)
    assert not whole and 50 <= true.count() <= 120 and true.count() == true.select("class").distinct().count()
    none = spark.createDataFrame([], "class long, links long, root long")
    assert embeddings.audit(true, none) is None
    monkeypatch.setattr(embeddings, "OVERLAP", (1, 2))
    with pytest.warns(UserWarning, match="not measured"):
        embeddings.near_duplicates(df, threshold=0.999)


def test_pipeline_stages(spark):
    """Every stage against its own rule, on the rows that the stage before it kept."""
    if importlib.util.find_spec("corpus_pipeline") is None:
        pytest.skip("no pipeline")
    import corpus_pipeline
    from test_filters import brute_secrets
    from test_simhash import brute_print

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, step in corpus_pipeline.STAGES:
        before, columns = {r.doc_id: r for r in docs.collect()}, docs.columns
        docs = corpus_pipeline.stage(step(spark, docs, SMALL), "pipeline-test")
        rows = {r.doc_id: r for r in docs.collect()}
        if name != "best-fit packing":
            assert docs.columns == columns
        if name == "SimHash near-dedup":
            prints = [brute_print(r.text) for r in rows.values()]
            assert all((a ^ b).bit_count() > simhash.DISTANCE for i, a in enumerate(prints) for b in prints[:i])
            gone = [brute_print(r.text) for i, r in before.items() if i not in rows]
            everyone = [brute_print(r.text) for r in before.values()]
            assert all(sum((g ^ p).bit_count() <= simhash.DISTANCE for p in everyone) > 1 for g in gone)
        if name == "secret scans":
            assert rows.keys() == before.keys()
            assert not any(brute_secrets(r.text) for r in rows.values())
            assert all(r.text == before[i].text for i, r in rows.items() if not brute_secrets(before[i].text) and "[SECRET]" not in (r.text or ""))
            assert all(r.n_chars == len(r.text) for r in rows.values() if r.text is not None)
        if name == "best-fit packing":
            assert rows.keys() == before.keys()
    assert corpus_pipeline.ORACLE_SQL is None
