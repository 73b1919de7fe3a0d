"""Conversation repair against a plain dynamic program, on odd rows and on one conversation over many ranges."""

import hashlib
import random
import re
import zlib

import pytest

from deltascreen.llm import structure

SCHEMA = "conv_id long, turn int, role string, text string, seg int, fault string"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def plain_repair(rows):
    """Summary of one conversation's damaged rows: costs and audits forward, state by state."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults, best = set(), [], {0: (0, "", ())}

    def closed(best):
        for q in (0, 1, 2, 3, 2, 3):
            if q in best:
                cost, audit, out = best[q]
                to = 3 if q == 2 else 2
                option = (cost + 2, audit + "I", (*out, ("user" if to == 2 else "assistant") + ":"))
                best[to] = min(best.get(to, option), option)
        return best

    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
        new = {}

        def offer(q, option, new=new):
            new[q] = min(new.get(q, option), option)

        for q, (cost, audit, out) in closed(best).items():
            offer(q, (cost + 3, audit + "D", out))
            if faults[-1] in (1, 2):
                continue
            more = faults[-1] == 3
            to = 3 if q == 2 else 2
            offer(to, (cost + 2 + more, audit + "R", (*out, ("user" if to == 2 else "assistant") + ":" + text)))
            if role[:1] == "s" and q == 0:
                offer(1, (cost + more, audit + "K", (*out, f"{role}:{text}")))
            if role[:1] == {2: "u", 3: "a"}[to]:
                offer(to, (cost + more, audit + "K", (*out, f"{role}:{text}")))
        best = new
    cost, audit, out = min(v for q, v in closed(best).items() if q in (0, 3))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [(a[2][:1] or "-") + (b[2][:1] or "-") for a, b in zip(rows, rows[1:], strict=False)]
    counts = [faults.count(k) for k in (1, 2, 3)]
    return [gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def expected(rows):
    by_conv = {r[0]: [] for r in rows}
    for r in damaged(rows):
        by_conv[r[0]].append(r)
    return {conv: plain_repair(own) for conv, own in by_conv.items()}


def found(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA)
    got = structure.summaries(structure.repair(structure.damage(df))).collect()
    assert len(got) == len({r.conv_id for r in got})
    return {r.conv_id: list(r)[1:] for r in got}


def made(rng, conv, n, texts):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    return [(conv, rng.choice([t, t, t, t - 1, None]), rng.choice(roles), rng.choice(texts)) for t in range(n)]


def test_random_conversations(spark):
    rng = random.Random(1)
    texts = [f"w{i}{end}" for i in range(30) for end in (".", "!", "", " ? \t", "…")] + ["", None, " \n\x0b", "\xa0", "long " * 20_000 + "."]
    rows = [r for conv in range(120) for r in made(rng, conv, rng.randint(1, 12), texts)] + made(rng, None, 9, texts)
    rows += [(500, 3, "user", "same.")] * 5 + [(501, None, None, None)] * 3
    assert found(spark, rows) == expected(rows)


def test_one_conversation_over_many_ranges(spark):
    rng = random.Random(2)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = made(rng, 7, 900, [f"t{i}." for i in range(700)]) + made(rng, 3, 40, ["a.", "b?", "c"]) + made(rng, 9, 5, ["z."])
        ordered = structure.repair(structure.damage(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")))
        assert ordered.where("conv_id = 7").select("seg").distinct().count() > 3
        assert found(spark, rows) == expected(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def test_empty_and_wholly_dropped(spark):
    assert found(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert found(spark, [(gone, 0, "user", "x.")]) == {gone: [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]}


@pytest.mark.parametrize("n", [1, 2, 3, 7])
def test_ranks_order_least_audits(n):
    import numpy as np

    rng = np.random.default_rng(n)
    codes = rng.integers(0, 12, n)
    found = structure.Segments(codes, np.ones(n, dtype=np.int64), np.array([n]), np.zeros((1, 4), dtype=np.int64), np.array([True]))
    found.follow()
    piece, step, letter, row, _ = found.paths(np.array([0]))
    assert list(step) == list(range(len(piece))) and sorted(row[letter != structure.I]) == list(range(n))
