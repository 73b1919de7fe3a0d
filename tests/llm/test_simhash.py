from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SMALL

from deltascreen.llm import common, queries, simhash
from deltascreen.llm.components import connected_components


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, near):
    """Smallest id of each row's component; ``near(a, b)`` links two prints."""
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if near(pairs[i][1], pairs[j][1]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(pairs):
        least.setdefault(find(i), []).append(doc)
    return [min((d for d in least[find(i)] if d is not None), default=None) for i in range(len(pairs))]


def brute(rows):
    pairs = [(d, brute_print(t)) for d, t in rows]
    return Counter(zip((d for d, _ in pairs), (f"{p:016x}" for _, p in pairs), brute_components(pairs, lambda a, b: (a ^ b).bit_count() <= 4), strict=True))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = Counter(tuple(r) for r in queries.QUERIES["op10_simhash_near_dedup"](spark, SMALL).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows(odd):
    found = simhash.near_duplicates(odd).select("doc_id", simhash.hexadecimal(), "component")
    assert Counter(tuple(r) for r in found.collect()) == brute([(r.doc_id, r.text) for r in odd.collect()])


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.keep_one(none).columns == none.columns and simhash.keep_one(none).count() == 0


@pytest.mark.parametrize(("blocks", "m"), [(3, 4), (2, 4), (4, 3)])
def test_every_near_pair_shares_an_anchor(spark, monkeypatch, blocks, m):
    monkeypatch.setattr(simhash, "MAX_HOMES", 3)  # hot anchors are split
    monkeypatch.setattr(simhash, "MAX_VISITORS", 5)
    rng = np.random.default_rng(blocks)
    prints = set()
    for start in rng.integers(0, 1 << 63, 12, dtype=np.uint64):
        for _ in range(12):
            flips = rng.choice(64, rng.integers(0, 6), replace=False)
            prints.add(int(start) ^ sum(1 << int(b) for b in flips))
    values = np.array(sorted(prints), dtype=np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "print long")
    links = simhash.near_links(df, blocks=blocks, m=m)
    part = {r.node: r.component for r in connected_components(links).collect()}
    signed = values.view(np.int64).tolist()
    want = brute_components([(s, int(v)) for s, v in zip(signed, values, strict=True)], lambda a, b: (a ^ b).bit_count() <= 4)
    assert [part.get(s, s) for s in signed] == want


def test_covering_radius():
    """Every value of a block has one home, within radius 1 of it."""
    code = simhash.CoveringCode(0, 9, 3, 1)
    values = np.arange(512, dtype=np.uint64)
    row, anchor, home = code.anchors(values)
    assert sorted(row[home].tolist()) == list(range(512))
    assert (np.bitwise_count(anchor[home] ^ values[row[home]]) <= 1).all()
    assert len(set(anchor[home].tolist())) == 16 * 4


def test_keep_one(odd):
    kept = simhash.keep_one(odd)
    rows = kept.collect()
    groups = brute([(r.doc_id, r.text) for r in odd.collect()])
    parts = brute_components([(None, brute_print(r.text)) for r in rows], lambda a, b: (a ^ b).bit_count() <= 4)
    assert len(parts) == len(rows)
    prints = [brute_print(r.text) for r in rows]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(prints) for b in prints[:i])
    assert {c for (_, _, c), _ in groups.items() if c is not None} <= {r.doc_id for r in rows}
    assert kept.columns == odd.columns


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 140)]
    edges = spark.createDataFrame(path + [(7, i) for i in range(8, 60)] + [(3, 3), (None, 4), (7, 8)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 100 for i in range(100, 141)} | {i: 7 for i in range(7, 60)}


def test_heavy_keys_join_like_any_other(spark, monkeypatch):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(300, "gone")] * 40, "n int, key string")
    keyed = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 250)], "key string, value int")
    for heavy in (1, 10, 1000):
        monkeypatch.setattr(common, "HEAVY", heavy)
        for how in ("inner", "left"):
            got, want = common.join_heavy(rows, keyed, "key", how), rows.join(keyed, "key", how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert common.join_heavy(rows.limit(0), keyed, "key", "left").count() == 0
