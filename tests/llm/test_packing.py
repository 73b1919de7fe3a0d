import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SMALL
from hypothesis import given, settings
from hypothesis import strategies as st

from deltascreen.llm import packing, queries

PATH = packing.vocabulary_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def words():
    return packing.WordTokenizer(PATH)


def check(rows, docs, words, capacity=2048):
    """Pieces are the documents' ids, sequences are gapless and hold ``capacity`` at most."""
    want = Counter()
    for doc, text in docs:
        ids = words.tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at : at + capacity], dtype="<u4")
            want[(doc, piece, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places), -(-sum(r.length for r in rows) // capacity)


def test_query(spark, words):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    sequences, least = check(queries.QUERIES["op5_best_fit_packing"](spark, SMALL).collect(), [(r.doc_id, r.text) for r in docs], words)
    assert sequences <= least + 1


def test_odd_rows_in_small_shards(odd, words):
    rows = packing.pack(odd, PATH, capacity=64, shard=40, with_ids=True)
    found = rows.collect()
    sequences, least = check(found, [(r.doc_id, r.text) for r in odd.collect()], words, 64)
    assert sequences <= 1.05 * least + 2
    whole = {r.sequence_id: r.ids for r in packing.sequences(rows).collect()}
    for r in found:
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == list(r.ids)


def test_empty(none):
    assert packing.pack(none, PATH).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "Zz", "'s", "'LL", "É", "½", "²", "12", "...", "\x85", "\xa0", "\x1c", " ", "\n", "ß", "ª", "×", "œ", "İ", "ΑΣ", "’", "漢", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext", "|>", "_", "\x00", "ſ", "ﬁ"]), max_size=14))
def test_words_have_the_ids_of_the_whole_text(parts):
    text = "".join(parts)
    words = test_words_have_the_ids_of_the_whole_text.__dict__.setdefault("words", packing.WordTokenizer(PATH))
    assert np.frombuffer(words.encode(text), "<u4").tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_markers_have_one_id_as_in_the_tokenizer_as_loaded(spark):
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(PATH)
    texts = ["a <|endoftext|> b", "<|startoftext|>Œuvre<|endoftext|>", "<|endoftext|>" * 3000, "<|<|endoftext|>|> <|EndOfText|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = packing.pack(docs, PATH, with_ids=True).orderBy("doc_id", "piece").collect()
    for i, text in enumerate(texts):
        ids = [x for r in found if r.doc_id == i for x in r.ids]
        assert ids == [*loaded.encode(text, add_special_tokens=False).ids, 0]
    assert [x for r in found if r.doc_id == 0 for x in r.ids] == [320, 49407, 321, 0]


def test_crossover_keeps_every_document_once():
    rng = np.random.default_rng(1)
    problem = packing.Packing(rng.integers(1, 2048, 500), 2048)
    a, b = problem.fresh(rng, 0.5), problem.fresh(rng, 0.5)
    child = problem.crossover(rng, a, b)
    assert len(child) == 500 and problem.fill(child).max() <= 2048 and (problem.fill(child) > 0).all()


def test_evolving_is_no_worse_than_best_fit():
    rng = np.random.default_rng(2)
    problem = packing.Packing(rng.integers(200, 1100, 400), 2048)
    start = problem.cost(problem.fresh(rng, 0.0))
    assert problem.cost(problem.evolve(3, [], 60, 6)) <= start
