"""Edit-aware token counts: a segment tree of counts for each document, updated where edits touch it.

A text is cut into leaves of some hundred characters, each at a space or newline after another
character. No pre-token of this vocabulary's pattern runs over such a place, so a text has the tokens
of its leaves in a row. The inner nodes hold the characters and tokens below them. An edit is located
by descending the tree; the leaves that it touches, with those it borders on, are encoded anew, and
the sums above them are replaced. Everything else is left alone.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import unused, worker_cache

LEAF = 512
#: A leaf that edits have made longer than so many usual ones is cut anew, with the whole tree.
OVERLONG = 8
_CUT = re.compile(r"(?<=\S)[ \n]")


def encoder(path: str, pattern: str):
    """Function from a text to its number of tokens, from a file of ranks."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    made = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(made.encode_ordinary(text))


def leaves(text: str) -> list[str]:
    """Parts of about ``LEAF`` characters that begin at a space or newline after another character."""
    parts, at = [], 0
    while at < len(text):
        cut = _CUT.search(text, at + LEAF)
        end = cut.start() if cut else len(text)
        parts.append(text[at:end])
        at = end
    return parts or [""]


class CountTree:
    """Segment tree over leaves; node 1 is the root, node ``i`` has the children ``2i`` and ``2i + 1``."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.base = len(chars) // 2

    @classmethod
    def of(cls, text: str, count) -> CountTree:
        parts = leaves(text)
        base = 1 << (len(parts) - 1).bit_length()
        sums = np.zeros((2, 2 * base), dtype=np.int64)
        sums[0, base : base + len(parts)] = [len(p) for p in parts]
        sums[1, base : base + len(parts)] = [count(p) for p in parts]
        low = base
        while low > 1:
            sums[:, low // 2 : low] = sums[:, low : 2 * low : 2] + sums[:, low + 1 : 2 * low : 2]
            low //= 2
        return cls(sums[0].copy(), sums[1].copy())

    @property
    def total(self) -> int:
        return int(self.tokens[1])

    def leaves_at(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves that hold the characters at ``places`` (the last one beyond the end), and their starts."""
        places = np.minimum(places, self.chars[1] - 1)
        node, start = np.ones(len(places), dtype=np.int64), np.zeros(len(places), dtype=np.int64)
        for _ in range(self.base.bit_length() - 1):
            node = 2 * node
            right = places >= start + self.chars[node]
            start += np.where(right, self.chars[node], 0)
            node += right
        return node, start

    def put(self, first: int, last: int, region: str, count) -> bool:
        """Set the leaves ``first`` to ``last`` to ``region``; whether one of them is far too long then."""
        parts = leaves(region)
        room, many = last - first + 1, len(parts)
        if many > room:
            parts[room - 1 :] = ["".join(parts[room - 1 :])]
        for i in range(room):
            part = parts[i] if i < len(parts) else ""
            self.chars[first + i], self.tokens[first + i] = len(part), count(part) if part else 0
        return many > room and max(map(len, parts)) > OVERLONG * LEAF

    def add_up(self, touched: np.ndarray) -> None:
        """Replace the sums above the leaves ``touched``, each once."""
        node = np.unique(touched // 2)
        while node[0]:
            for sums in (self.chars, self.tokens):
                sums[node] = sums[2 * node] + sums[2 * node + 1]
            node = np.unique(node // 2)


def apply_edits(text: str, tree: CountTree, edits, count) -> tuple[str, int, int]:
    """``(text, edits done, characters encoded)`` after edits ``(start, end, replacement)`` of ``text``.

    Edits are taken in order of their places in the given text. Places beyond the text count as its
    end; an edit that begins inside the one before it begins at that one's end instead. Edits that
    touch a common leaf are done together, and the text is put together once, so that the work is
    linear in the text and its edits.
    """
    done, last = [], 0
    for start, end, new in sorted((e[0] or 0, e[1] or 0, e[2] or "") for e in edits):
        start = min(max(start, last), len(text))
        end = min(max(end, start), len(text))
        done.append((start, end, new))
        last = end
    if not done:
        return text, 0, 0
    first, low = tree.leaves_at(np.maximum(np.array([d[0] for d in done]) - 1, 0))
    final, high = tree.leaves_at(np.array([d[1] for d in done]))
    high = high + tree.chars[final]
    heads = np.flatnonzero(np.r_[True, first[1:] > final[:-1]])
    out, touched, at, encoded, overlong = [], [], 0, 0, False
    for a, b in zip(heads, np.r_[heads[1:], len(done)], strict=True):
        out.append(text[at : low[a]])
        region, at = [], int(low[a])
        for start, end, new in done[a:b]:
            region += (text[at:start], new)
            at = end
        region = "".join([*region, text[at : high[b - 1]]])
        at = int(high[b - 1])
        out.append(region)
        encoded += len(region)
        overlong |= tree.put(int(first[a]), int(final[b - 1]), region, count)
        touched.append(np.arange(first[a], final[b - 1] + 1))
    text = "".join([*out, text[at:]])
    if overlong:
        whole = CountTree.of(text, count)
        tree.chars, tree.tokens, tree.base = whole.chars, whole.tokens, whole.base
        return text, len(done), len(text)
    tree.add_up(np.concatenate(touched))
    return text, len(done), encoded


TREE = "n_tokens long, tree_chars array<long>, tree_tokens array<long>"


def with_trees(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and the tree of each text (a null text counts as empty)."""

    def run(batches):
        count = worker_cache("token_count", lambda: encoder(ranks, pattern))
        for batch in batches:
            trees = [CountTree.of(t or "", count) for t in batch.column(text_col).to_pylist()]
            made = [pa.array([t.total for t in trees], pa.int64())]
            made += [pa.array([getattr(t, c) for t in trees], pa.list_(pa.int64())) for c in ("chars", "tokens")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "n_tokens", "tree_chars", "tree_tokens"])

    kept = docs.drop("n_tokens", "tree_chars", "tree_tokens")
    return kept.mapInArrow(run, _ddl(kept) + ", " + TREE)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with an array column ``edits`` from ``edits(id, start, end, replacement)``."""
    own_id = unused("_id", docs)
    own = edits.groupBy(F.col(id_col).alias("_id")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("edits"))
    return docs.drop("edits").join(own, F.col(id_col) == F.col(own_id), "left").drop(own_id)


def update_counts(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``docs`` (with trees and ``edits``) after the edits: new text and tree, and what that took.

    Adds n_edits, n_tokens_before and reencoded_chars; n_tokens and the trees are the new ones. Rows
    without edits (null or none) keep their text, a null one, too.
    """
    names = ["n_edits", "n_tokens_before", "reencoded_chars"]

    def run(batches):
        count = worker_cache("token_count", lambda: encoder(ranks, pattern))
        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            rows = zip(*(columns[c].to_pylist() for c in (text_col, "tree_chars", "tree_tokens", "edits")), strict=True)
            texts, trees, done = [], [], []
            for text, chars, tokens, edits in rows:
                tree, before = CountTree(np.array(chars), np.array(tokens)), int(tokens[1])
                new, n, encoded = (text, 0, 0)
                if edits:
                    new, n, encoded = apply_edits(text or "", tree, [(e["start"], e["end"], e["replacement"]) for e in edits], count)
                texts.append(new)
                trees.append(tree)
                done.append((n, before, encoded))
            columns[text_col] = pa.array(texts, pa.string())
            columns["n_tokens"] = pa.array([t.total for t in trees], pa.int64())
            columns["tree_chars"] = pa.array([t.chars for t in trees], pa.list_(pa.int64()))
            columns["tree_tokens"] = pa.array([t.tokens for t in trees], pa.list_(pa.int64()))
            columns |= {n: pa.array([d[i] for d in done], pa.int64()) for i, n in enumerate(names)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kept = docs.drop(*names)
    return kept.mapInArrow(run, _ddl(kept) + ", " + ", ".join(f"{n} long" for n in names))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def redactions(docs: DataFrame, pattern: str, replacement: str, text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``edits`` that replaces every match of ``pattern``."""

    def run(batches):
        find = re.compile(pattern).finditer
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("replacement", pa.string())]))
        for batch in batches:
            found = [[{"start": m.start(), "end": m.end(), "replacement": replacement} for m in find(t or "")] for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, "edits"])

    kept = docs.drop("edits")
    return kept.mapInArrow(run, _ddl(kept) + ", edits array<struct<start:long,end:long,replacement:string>>")
