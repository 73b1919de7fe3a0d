"""Conversation structure repair: the cheapest edits that give every conversation a legal order of roles.

A conversation's rows, in order, are layers of a graph with four states: nothing yet, after the system
row, after a user row, after an assistant row. Arcs keep, rerole or delete a row, or insert one. A
min-plus suffix product over the layers gives every node its cost to the end; the arcs that lie on a
cheapest path stay. Nodes are then ranked by the first 1, 2, 4, 8, ... letters of their least audit: the
rank of twice as many letters is the rank of the pair (own rank, rank of the node that many letters on).
The ranks choose each node's arc, and paths are read through the doubled pointers of the chosen arcs.
All of it is whole-array work over many conversations at once, in a number of rounds that is the
logarithm of the longest one.

Rows are dealt by ranges of (conversation, order), so a conversation of any size is several segments.
Only conversations that cross a range boundary (fewer than there are partitions) need more: their
segments send a 4 x 4 matrix of costs, then a map of four states, and get the costs behind them and the
state before them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascreen.llm.common import join_heavy, stage

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits; a truncated row that stays adds ``TRUNCATED``.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Letters of the audit in their order as characters.
LETTERS = "DIKR"
D, I, K, R = range(4)
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "sua"
FREE, FORCED, CUT = range(3)
FAULTS = ["", "blank", "duplicate", "truncated"]
NEVER = 1 << 40
#: The state that an inserted or reroled row leads to: a user's, or after a user an assistant's.
TURN_OF = np.array([USER, USER, ASSISTANT, USER])
#: Costs of completing a conversation behind its last row.
CLOSING = np.array([0, 2 * INSERT, INSERT, 0])


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """``(cost, target state)`` by row code (3 x initial + kind; the last code: behind the last row), state, letter."""
    cost = np.full((13, 4, 4), NEVER, dtype=np.int64)
    to = np.zeros((13, 4, 4), dtype=np.int64)
    cost[:, :, I], to[:, :, I] = INSERT, TURN_OF
    cost[:12, :, D], to[:12, :, D] = DELETE, np.arange(4)
    for initial in range(4):
        for kind in (FREE, CUT):
            code, more = 3 * initial + kind, TRUNCATED * (kind == CUT)
            cost[code, :, R], to[code, :, R] = REROLE + more, TURN_OF
            for state in range(4):
                if (initial, state) == (0, START) or initial in (1, 2) and TURN_OF[state] == initial + 1:
                    cost[code, state, K], to[code, state, K] = more, initial + 1
    return cost, to


COST, TO = _arcs()


def _minplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = a[:, :, 0, None] + b[:, 0, None, :]
    for k in range(1, 4):
        np.minimum(out, a[:, :, k, None] + b[:, k, None, :], out=out)
    return np.minimum(out, NEVER)


def _steps() -> np.ndarray:
    """Cost from state to state over a row of each code, inserts before it included."""
    insert = np.full((1, 4, 4), NEVER, dtype=np.int64)
    insert[0, np.arange(4), np.arange(4)] = 0
    insert[0, np.arange(4), TURN_OF] = INSERT
    insert = _minplus(insert, insert)
    row = np.full((12, 4, 4), NEVER, dtype=np.int64)
    for letter in (D, K, R):
        for state in range(4):
            at = np.arange(12), state, TO[:12, state, letter]
            row[at] = np.minimum(row[at], COST[:12, state, letter])
    return _minplus(np.repeat(insert, 12, axis=0), row)


STEP = _steps()


class Segments:
    """Consecutive segments of conversations: ``lengths`` rows each, with row codes and copies.

    ``exits[p]`` is the cost to the end behind segment p, by state, and ``last[p]`` says that nothing
    comes behind it. A row with ``copies`` stands for itself and copies that have to be deleted.
    """

    def __init__(self, codes, copies, lengths, exits, last):
        n, self.p, self.lengths = len(codes), len(lengths), lengths
        piece = np.repeat(np.arange(self.p), lengths)
        rows = np.arange(n) + piece  # layer of each row; every segment has one layer more, for its end
        self.ends = np.cumsum(lengths + 1) - 1
        self.starts = self.ends - lengths
        self.layers = n + self.p
        self.codes = np.full(self.layers, 12)
        self.codes[rows] = codes
        self.extra = np.zeros(self.layers, dtype=np.int64)
        self.extra[rows] = DELETE * (copies - 1)
        self.piece = np.zeros(self.layers, dtype=np.int64)
        self.piece[rows], self.piece[self.ends] = piece, np.arange(self.p)
        self.last = last
        self.exits = np.where(last[:, None], CLOSING, exits)
        self.matrices = self._products()

    def _products(self) -> np.ndarray:
        """For every layer the costs from its states to the states at the end of its segment."""
        product = np.full((self.layers, 4, 4), NEVER, dtype=np.int64)
        product[:, np.arange(4), np.arange(4)] = 0
        inner = self.codes < 12
        product[inner] = STEP[self.codes[inner]] + self.extra[inner, None, None]
        jump = np.minimum(np.arange(self.layers) + 1, self.ends[self.piece])
        while (jump != self.ends[self.piece]).any():
            product, jump = _minplus(product, product[jump]), jump[jump]
        return product

    def follow(self) -> None:
        """Cheapest arcs, ranks of all nodes by their least audits, and the pointers that the ranks choose."""
        value = (self.matrices + self.exits[self.piece][:, None, :]).min(axis=2)
        onward = np.minimum(np.arange(self.layers) + 1, self.layers - 1)
        total, target = np.empty((self.layers, 4, 4), dtype=np.int64), np.empty((self.layers, 4, 4), dtype=np.int64)
        for letter in range(4):
            layer = np.arange(self.layers) if letter == I else onward
            to = TO[self.codes, :, letter]
            target[:, :, letter] = layer[:, None] * 4 + to
            total[:, :, letter] = COST[self.codes, :, letter] + value[layer[:, None], to]
            if letter != I:
                total[:, :, letter] += self.extra[:, None]
        cheapest = (total == value[:, :, None]) & (total < NEVER)
        cheapest[self.ends[~self.last]] = False
        cheapest, target = cheapest.reshape(-1, 4), target.reshape(-1, 4)
        here, some = np.arange(len(target)), cheapest.any(axis=1)
        # The arcs of a node carry different letters, so its first letter fixes where its audit goes on.
        first = cheapest.argmax(axis=1)
        jump, rank = np.where(some, target[here, first], here), np.where(some, first + 1, 0)
        while some[jump].any():
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1].reshape(-1)
            jump = jump[jump]
        keys = (np.arange(4) + 1) * (rank.max() + 1) + rank[target]
        self.letter = np.where(cheapest, keys, np.iinfo(np.int64).max).argmin(axis=1)
        self.jumps, self.steps = [np.where(some, target[here, self.letter], here)], some.astype(np.int64)
        while some[self.jumps[-1]].any():
            jump = self.jumps[-1]
            self.steps = self.steps + self.steps[jump]
            self.jumps.append(jump[jump])

    def exit_states(self) -> np.ndarray:
        """For every segment and state before it the state behind it."""
        return self.jumps[-1][self.starts[:, None] * 4 + np.arange(4)] % 4

    def paths(self, entries: np.ndarray):
        """``(segment, step, letter, row, state reached)`` of all edits of the least paths; ``row`` counts all rows."""
        begin = self.starts * 4 + entries
        count = self.steps[begin]
        piece = np.repeat(np.arange(self.p), count)
        step = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        node = begin[piece]
        for k, jump in enumerate(self.jumps):
            node = np.where(step >> k & 1, jump[node], node)
        return piece, step, self.letter[node], node // 4 - piece, self.jumps[0][node] % 4


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's damage by ``crc32(conv_id:turn) % 20``; a dropped row stays as ``dropped``, without content.

    Null roles and texts become one space, as null parts of the hashed key do.
    """
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.withColumns({
        "text": text, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")),
        "copies": F.when(F.col("kind") == 3, 2).otherwise(1).cast("long"), "dropped": F.col("kind") == 0,
    })
    return rows.drop("kind")


def _last_visible(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(BLANKS)), -1, 1)


def with_faults(rows: DataFrame) -> DataFrame:
    """Equal rows of a turn as one with its ``copies``, each with ``fault`` (a place in FAULTS) of the first of them."""
    dropped = F.coalesce(F.col("dropped"), F.lit(False))
    said = lambda c: F.when(~dropped, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c)
    rows = rows.select("conv_id", F.when(~dropped, F.col("turn")).alias("turn"), said("role"), said("text"), "copies", dropped.alias("dropped"))
    rows = rows.groupBy("conv_id", "turn", "role", "text", "dropped").agg(F.sum("copies").alias("copies"))
    content = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.col("dropped").cast("string"), F.length("role").cast("string"), "role", "text")
    rows = stage(rows.withColumn("said", F.sha2(content, 256)), "turns")
    # Equal rows of a turn are one row here, so more than one row means more than one turn.
    repeated = rows.where(~F.col("dropped")).groupBy("said").agg(F.count("*").alias("times"), F.min(F.struct("turn")).alias("first"))
    rows = join_heavy(rows, repeated.where("times > 1"), "said", "left")
    earlier = F.coalesce(~F.col("turn").eqNullSafe(F.col("first.turn")) & F.col("first").isNotNull(), F.lit(False))
    last = _last_visible(F.col("text"))
    fault = F.when(F.col("dropped"), 0).when(last == "", 1).when(earlier, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    return rows.select("conv_id", "turn", "role", "text", "dropped", "copies", fault.cast("int").alias("fault"))


_ROWS = ["conv_id", "seg", "at", "turn", "role", "text", "dropped", "copies", "fault"]


def _initials(role: pa.ChunkedArray) -> np.ndarray:
    """0 to 2 for roles that begin with s, u, a; else 3."""
    return np.array([INITIALS.find(r[:1]) if r else -1 for r in role.to_pylist()], dtype=np.int64) % 4


def _segments(table: pa.Table, bounds: dict) -> tuple[Segments, np.ndarray, pa.Table, list, np.ndarray]:
    """Segments of sorted rows (dropped rows aside), their entry states, the rows, (conv, seg) of each, initials."""
    conv, seg = table.column("conv_id").to_pylist(), table.column("seg").to_pylist()
    names = list(zip(conv, seg, strict=True))
    change = np.array([i == 0 or names[i] != names[i - 1] for i in range(len(names))], dtype=bool)
    piece = np.cumsum(change) - 1
    kept = ~table.column("dropped").to_numpy()
    heads = [names[i] for i in np.flatnonzero(change)]
    lengths = np.bincount(piece[kept], minlength=len(heads))
    rows = table.filter(pa.array(kept))
    initials, fault = _initials(rows.column("role")), rows.column("fault").to_numpy()
    kind = np.where(np.isin(fault, (1, 2)), FORCED, np.where(fault == 3, CUT, FREE))
    known = [bounds.get(h, (0, None)) for h in heads]
    exits = np.array([CLOSING if e is None else e for _, e in known], dtype=np.int64).reshape(-1, 4)
    last = np.array([e is None for _, e in known], dtype=bool)
    found = Segments(3 * initials + kind, rows.column("copies").to_numpy(), lengths, exits, last)
    return found, np.array([q for q, _ in known], dtype=np.int64), rows, heads, initials


def _bounds(ordered: DataFrame) -> dict:
    """``(conv_id, seg) -> (entry state, exit costs or None)`` of the segments of conversations with several."""
    ends = ordered.where(~F.col("dropped")).groupBy("conv_id").agg(F.min("seg").alias("low"), F.max("seg").alias("high")).where("low < high")
    crossing = stage(ends.select(F.col("conv_id").alias("crossing")), "crossing")
    light = ordered.drop("text", "turn").where(~F.col("dropped"))
    rows = light.join(F.broadcast(crossing), light["conv_id"].eqNullSafe(crossing["crossing"]), "left_semi")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def pass_over(values, exits: dict):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            found, _, _, heads, _ = _segments(table, {k: (0, e) for k, e in exits.items()})
            out = values(found)
            return pa.table({"conv_id": table.column("conv_id").slice(0, 1), "seg": table.column("seg").slice(0, 1), "values": pa.array([out], pa.list_(pa.int64()))})

        got = rows.groupBy("conv_id", "seg").applyInArrow(run, f"conv_id {kind}, seg int, values array<long>").collect()
        return sorted(((r.conv_id, r.seg, r["values"]) for r in got), key=lambda r: r[1])

    costs, exits, behind = pass_over(lambda s: s.matrices[0].ravel().tolist(), {}), {}, {}
    if not costs:
        return {}
    for conv, seg, matrix in reversed(costs):
        exits[conv, seg] = behind.get(conv)
        after = CLOSING if conv not in behind else np.array(behind[conv])
        behind[conv] = (np.array(matrix).reshape(4, 4) + after).min(axis=1).tolist()

    def states(found: Segments) -> list[int]:
        found.follow()
        return found.exit_states()[0].tolist()

    bounds, state = {}, {}
    for conv, seg, to in pass_over(states, exits):
        bounds[conv, seg] = state.get(conv, START), exits[conv, seg]
        state[conv] = to[state.get(conv, START)]
    return bounds


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: ``(conv_id, seg, step, edit, copies, fault, turn, initial, cost, role, text)``.

    ``rows``: conv_id, turn, role, text, copies and dropped, as ``damage`` returns them; other columns are
    ignored. ``edit`` is a letter of LETTERS, or empty for a dropped row (which has no place in the order).
    (seg, step) orders a conversation. ``role`` and ``text`` are those of the repaired row, null where it is
    deleted; ``fault``, ``turn``, ``initial`` describe the row as it came, null for inserted ones. With
    ``copies`` above 1 a row stands for itself and copies that are deleted behind it. Turns that are null
    come first; rows of one turn follow by role and text. A role that is empty or begins with another letter
    than s, u, a can't be kept. A null conv_id is a conversation of its own. Empty tables give no rows.
    """
    faulty = stage(with_faults(rows), "faults")
    order = ["conv_id", "turn", "role", "text"]
    sorted_rows = faulty.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = sorted_rows.withColumns({"seg": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    ordered = stage(placed, "ordered-turns")
    bounds = ordered.sparkSession.sparkContext.broadcast(_bounds(ordered))
    names = ["conv_id", "seg", "step", "edit", "copies", "fault", "turn", "initial", "cost", "role", "text"]
    kinds = {f.name: f.dataType.simpleString() for f in ordered.schema.fields}
    types = [kinds["conv_id"], "int", "long", "string", "long", "int", kinds["turn"], "int", "long", "string", "string"]

    def edits(table: pa.Table):
        gone = table.filter(table.column("dropped"))
        found, entries, rows, heads, initials = _segments(table, bounds.value)
        found.follow()
        piece, step, letter, row, state = found.paths(entries)
        own = pa.array(np.where(letter == I, 0, row), mask=letter == I)
        took = rows.take(own)
        codes = found.codes[row + piece]
        copies = np.where(letter == I, 1, rows.column("copies").to_numpy()[np.where(letter == I, 0, row)] if rows.num_rows else 1)
        stays_cut = np.isin(letter, (K, R)) & (codes % 3 == CUT)
        cost = np.select([letter == I, letter == D, letter == R], [INSERT, DELETE, REROLE], 0) + TRUNCATED * stays_cut + DELETE * (copies - 1)
        roles = np.array(["", "system", "user", "assistant"], dtype=object)[state]
        keep = letter == K
        role = [r if k else (None if gone_ else s) for r, k, gone_, s in zip(took.column("role").to_pylist(), keep, letter == D, roles, strict=True)]
        text = pa.compute.if_else(pa.array(letter == D), pa.scalar(None, pa.string()), pa.compute.fill_null(took.column("text").cast(pa.string()), ""))
        made = [
            pa.array([heads[i][0] for i in piece], table.schema.field("conv_id").type), pa.array([heads[i][1] for i in piece], pa.int32()),
            pa.array(step, pa.int64()), pa.array([LETTERS[i] for i in letter], pa.string()), pa.array(copies, pa.int64()), took.column("fault"),
            took.column("turn"), pa.array(np.where(letter == I, 0, initials[np.where(letter == I, 0, row)] if rows.num_rows else 0), pa.int32(), mask=letter == I),
            pa.array(cost, pa.int64()), pa.array(role, pa.string()), text,
        ]
        yield from pa.table(made, names=names).combine_chunks().to_batches(max_chunksize=10_000)
        n = gone.num_rows
        none = lambda kind: pa.nulls(n, kind)
        marks = [
            gone.column("conv_id"), gone.column("seg"), none(pa.int64()), pa.array([""] * n, pa.string()), gone.column("copies"), none(pa.int32()),
            gone.column("turn"), none(pa.int32()), pa.array([0] * n, pa.int64()), none(pa.string()), none(pa.string()),
        ]
        yield from pa.table(marks, names=names).combine_chunks().to_batches()

    def run(batches):
        held = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            conv, seg = table.column("conv_id").to_pylist(), table.column("seg").to_pylist()
            cut = len(conv)
            while cut and (conv[cut - 1], seg[cut - 1]) == (conv[-1], seg[-1]):
                cut -= 1
            if cut or held and (held[-1].column("conv_id")[-1].as_py(), held[-1].column("seg")[-1].as_py()) != (conv[0], seg[0]):
                yield from edits(pa.concat_tables([*held, table.slice(0, cut)]).combine_chunks())
                held = []
            held.append(table.slice(cut))
        if held:
            yield from edits(pa.concat_tables(held).combine_chunks())

    by_segment = ordered.select(*_ROWS).repartition("seg").sortWithinPartitions("seg", "at")
    return by_segment.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def summaries(edits: DataFrame) -> DataFrame:
    """One row for each conversation of ``repair``: faults, gaps, cost, audit and the digest of the repaired rows.

    Conversations are read as streams: a task holds one row, a running digest and the audit so far.
    """
    kind = edits.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string"

    class Reader:
        def __init__(self):
            self.faults, self.illegal, self.cost, self.audit = [0] * 4, 0, 0, []
            self.turns, self.low, self.turn, self.before = 0, None, None, None
            self.digest, self.begun = hashlib.sha256(), False

        def take(self, edit, copies, fault, turn, initial, cost, role, text):
            if not edit:
                return
            self.cost += cost
            self.audit.append(edit + "D" * (copies - 1))
            if role is not None:
                self.digest.update((("\n" if self.begun else "") + f"{role}:{text}").encode())
                self.begun = True
            if edit == "I":
                return
            self.faults[fault] += 1
            self.faults[1 if fault == 1 else 2] += copies - 1
            self.illegal += copies - 1
            if self.before is not None and (self.before, initial) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
            self.before = initial
            if turn is not None and turn != self.turn:
                self.low = turn if self.low is None else self.low
                self.turns, self.turn = self.turns + 1, turn

        def row(self):
            gaps = 0 if self.low is None else self.turn - self.low + 1 - self.turns
            return [gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()]

    def run(batches):
        now, reader = None, None
        for batch in batches:
            field, done = batch.schema.field("conv_id").type, []
            for conv, *edit in zip(*(batch.column(i).to_pylist() for i in range(9)), strict=True):
                if now != (conv,):
                    if reader:
                        done.append([now[0], *reader.row()])
                    now, reader = (conv,), Reader()
                reader.take(*edit)
            yield _out(done, field)
        if reader:
            yield _out([[now[0], *reader.row()]], field)

    def _out(done, field):
        columns = list(zip(*done, strict=True)) if done else [[]] * 9
        types = [field, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["conv_id", *counts, "audit", "repaired_sha256"])

    rows = edits.select("conv_id", "edit", "copies", "fault", "turn", "initial", "cost", "role", "text", "seg", "step")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "step").mapInArrow(run, schema)


#: DuckDB statement for the same rows: faults by windows, edits by a dynamic program over rows with the four
#: states' least costs and audits. Paths of one cost to one node never are prefixes of each other (the longer
#: one would hold one insert more), so the least audit so far stays the least.
ORACLE = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hashed AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)),
    lambda h, b: list_reduce([xor(h, b), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)) AS h FROM keyed),
drawn AS (SELECT * EXCLUDE (h, k), xor(h, 4294967295::BIGINT) % 20 AS kind FROM hashed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM drawn, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) AS c WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS again FROM placed),
judged AS (
  SELECT *, CASE WHEN final = '' THEN 1 WHEN again > 1 THEN 2 WHEN final NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS c,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM seen),
stats AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, list({'c': c, 'f': fault, 'role': role, 'text': text} ORDER BY i) AS r
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, n, r, 0 AS i, {'c': 0, 'a': ''} AS p0, {'c': 1000000, 'a': ''} AS p1, {'c': 2, 'a': 'I'} AS p2, {'c': 4, 'a': 'II'} AS p3 FROM stats
  UNION ALL
  SELECT conv_id, n, r, i, n0, n1, n2, least(n3, {'c': n2.c + 2, 'a': n2.a || 'I'}) FROM (
    SELECT *, least(m2, {'c': n0.c + 2, 'a': n0.a || 'I'}, {'c': n1.c + 2, 'a': n1.a || 'I'}, {'c': m3.c + 2, 'a': m3.a || 'I'}) AS n2, m3 AS n3 FROM (
      SELECT conv_id, n, r, i + 1 AS i, {'c': p0.c + 3, 'a': p0.a || 'D'} AS n0,
        least({'c': p1.c + 3, 'a': p1.a || 'D'}, {'c': p0.c + t + CASE c WHEN 's' THEN 0 ELSE 1000000 END, 'a': p0.a || 'K'}) AS n1,
        least({'c': p2.c + 3, 'a': p2.a || 'D'}, {'c': p0.c + t + k2, 'a': p0.a || l2}, {'c': p1.c + t + k2, 'a': p1.a || l2}, {'c': p3.c + t + k2, 'a': p3.a || l2}) AS m2,
        least({'c': p3.c + 3, 'a': p3.a || 'D'}, {'c': p2.c + t + k3, 'a': p2.a || l3}) AS m3
      FROM (SELECT *, r[i + 1].c AS c, CASE r[i + 1].f WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 1000000 END AS t,
          CASE r[i + 1].c WHEN 'u' THEN 0 ELSE 2 END AS k2, CASE r[i + 1].c WHEN 'u' THEN 'K' ELSE 'R' END AS l2,
          CASE r[i + 1].c WHEN 'a' THEN 0 ELSE 2 END AS k3, CASE r[i + 1].c WHEN 'a' THEN 'K' ELSE 'R' END AS l3
        FROM walk WHERE i < n)))),
ended AS (SELECT conv_id, r, least(p0, p3) AS best FROM walk WHERE i = n),
letters AS (
  SELECT conv_id, r, j, best.a[j] AS e, len(replace(best.a[1:j], 'I', '')) AS own_row FROM ended, LATERAL (SELECT unnest(range(1, len(best.a) + 1)) AS j)),
kept AS (
  SELECT conv_id, j, CASE WHEN e = 'K' THEN r[own_row].role END AS own, CASE WHEN e = 'I' THEN '' ELSE r[own_row].text END AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY j) + CASE WHEN bool_or(e = 'K' AND r[own_row].c = 's') OVER (PARTITION BY conv_id) THEN 0 ELSE 1 END AS place
  FROM letters WHERE e <> 'D'),
repaired AS (
  SELECT conv_id, string_agg(coalesce(own, CASE WHEN place % 2 = 0 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY j) AS t
  FROM kept GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
  LEFT JOIN stats s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
  LEFT JOIN repaired p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
"""
