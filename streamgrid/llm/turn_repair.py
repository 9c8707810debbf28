"""Repair of conversation structure: the cheapest edits that make the roles of a conversation alternate.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Rows may be kept (0), given the role user or
assistant (2), deleted (3, and required for blank rows and repetitions); empty user or assistant rows may be inserted
(2). A truncated row that stays costs 1 more. Among the cheapest sequences of edits the one whose initials (K, R, D, I)
come first in ASCII order is the audit.

The state after some rows is one of four: nothing, a system row, a user row, an assistant row. For each the cheapest
audit is kept as a node of a tree: a node has its last edit, its parent, one farther ancestor (binary lifting in linear
space: the distances follow the skew-binary numbers, so nodes of equal depth jump equally far) and a rolling hash of
all edits up to it. Audits share their beginnings, so a row costs a few nodes. Two audits of equal cost are compared by
searching their longest common prefix along the jumps; equal hashes are verified, by the node both share or edit by
edit. At equal cost none is a prefix of the other, as further insertions would cost more, so the smaller audit stays
smaller whatever follows.

Spark sorts the rows by conversation and turn, and a task reads them as a stream: it holds no rows, but the undecided
part of the audits (a few dozen bytes a row) and a running digest per state. What all four audits share is written out.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: White space of the blank test, and the ends of a whole text.
SPACES, ENDS = " \t\n\x0b\x0c\r", [".", "!", "?"]
#: Pairs of role initials that may follow each other.
LEGAL_PAIRS = {"su", "ua", "au"}

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79
#: Nodes after which what all audits share is written out.
_COMPACT_AT = 65_536
_LARGEST = (1 << 63) - 1


class AuditTree:
    """Audits that share their beginnings, as linked nodes. Node 0 is the empty audit, or what was decided so far."""

    def __init__(self) -> None:
        self.decided: list[str] = []
        self._start(0, 0)

    def _start(self, depth: int, value: int) -> None:
        self.parent, self.jump = array("q", [0]), array("q", [0])
        self.depth, self.value, self.edit = array("q", [depth]), array("Q", [value]), bytearray(b" ")

    def __len__(self) -> int:
        return len(self.parent)

    def push(self, parent: int, edit: int) -> int:
        near = self.jump[parent]
        even = self.depth[parent] - self.depth[near] == self.depth[near] - self.depth[self.jump[near]]
        self.parent.append(parent)
        self.jump.append(self.jump[near] if even else parent)
        self.depth.append(self.depth[parent] + 1)
        self.value.append((self.value[parent] * _BASE + edit) % _PRIME)
        self.edit.append(edit)
        return len(self.parent) - 1

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            far = self.jump[node]
            node = far if self.depth[far] >= depth else self.parent[node]
        return node

    def less(self, a: int, b: int) -> bool:
        """Whether the audit of ``a`` comes before that of ``b`` in ASCII order."""
        same = min(self.depth[a], self.depth[b])
        x, y = self.ancestor(a, same), self.ancestor(b, same)
        if self.value[x] == self.value[y]:
            return self.depth[a] < self.depth[b] if self._equal(x, y) else self.text(a) < self.text(b)
        while self.value[self.parent[x]] != self.value[self.parent[y]]:
            far_x, far_y = self.jump[x], self.jump[y]
            if self.value[far_x] != self.value[far_y]:
                x, y = far_x, far_y
            else:
                x, y = self.parent[x], self.parent[y]
        if not self._equal(self.parent[x], self.parent[y]):
            return self.text(a) < self.text(b)
        return self.edit[x] < self.edit[y]

    def _equal(self, x: int, y: int) -> bool:
        """Whether two audits of equal length and hash are equal indeed."""
        while x != y:
            if self.edit[x] != self.edit[y]:
                return False
            x, y = self.parent[x], self.parent[y]
        return True

    def _tail(self, node: int) -> str:
        out = bytearray()
        while node:
            out.append(self.edit[node])
            node = self.parent[node]
        return out[::-1].decode()

    def text(self, node: int) -> str:
        return "".join(self.decided) + self._tail(node)

    def compact(self, live: list[int]) -> list[int]:
        """Write out what all ``live`` nodes share, keep only what they need; their new numbers."""
        ends, kept = set(live), set(live)
        while len(ends) > 1:
            deepest = max(ends, key=self.depth.__getitem__)
            ends.remove(deepest)
            ends.add(self.parent[deepest])
            kept.add(self.parent[deepest])
        (root,) = ends
        self.decided.append(self._tail(root))
        old = (self.parent, self.jump, self.depth, self.value, self.edit)
        self._start(self.depth[root], self.value[root])
        number = {root: 0}
        for node in sorted(kept - {root}):
            number[node] = len(self.parent)
            self.parent.append(number[old[0][node]])
            self.jump.append(number.get(old[1][node], 0))
            self.depth.append(old[2][node])
            self.value.append(old[3][node])
            self.edit.append(old[4][node])
        return [number[node] for node in live]


class Repair:
    """One conversation, row by row: counts of faults, and per state the cheapest audit and the digest of its rows."""

    def __init__(self, compact_at: int = _COMPACT_AT) -> None:
        self.tree, self.compact_at = AuditTree(), compact_at
        self.best: list[tuple | None] = [(0, 0, hashlib.sha256()), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.before: str | None = None
        self.low = self.high = None

    def _offer(self, found: list, to: int, cost: int, origin: tuple, edit: int, row: tuple | None) -> None:
        held = found[to]
        if held is not None and cost > held[0]:
            return
        node = self.tree.push(origin[1], edit)
        if held is None or cost < held[0] or self.tree.less(node, held[1]):
            found[to] = (cost, node, origin[2], row)

    def _settle(self, found: list) -> list:
        """The digest of each state: that of the state it comes from, with the row that the edit writes."""
        out = []
        for state in found:
            if state is None or len(state) == 3:
                out.append(state)
                continue
            cost, node, digest, row = state
            if row is not None:
                first, role, text = row
                digest = digest.copy()
                digest.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            out.append((cost, node, digest))
        return out

    def _insert(self) -> None:
        best = list(self.best)
        for state in (NOTHING, SYSTEM, ASSISTANT):
            if (origin := self.best[state]) is not None:
                self._offer(best, USER, origin[0] + INSERT, origin, ord("I"), (state == NOTHING, "user", ""))
        best = self._settle(best)
        if (origin := best[USER]) is not None:
            self._offer(best, ASSISTANT, origin[0] + INSERT, origin, ord("I"), (False, "assistant", ""))
        best = self._settle(best)
        # From an assistant row all goes on as from a system row, and as from nothing but for a system row kept later.
        last = best[ASSISTANT][0]
        if best[SYSTEM] is not None and best[SYSTEM][0] > last:
            best[SYSTEM] = None
        if best[NOTHING] is not None and best[NOTHING][0] > last + DELETE:
            best[NOTHING] = None
        self.best = best

    def add(self, turn: int | None, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in LEGAL_PAIRS:
            self.illegal += 1
        self.before = initial
        gone = blank or duplicate
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut = TRUNCATED if truncated and not gone else 0
        self.truncated += bool(cut)
        self._insert()
        found: list[tuple | None] = [None] * 4
        for state, origin in enumerate(self.best):
            if origin is None:
                continue
            first, cost = state == NOTHING, origin[0]
            self._offer(found, state, cost + DELETE, origin, ord("D"), None)
            if gone:
                continue
            to = ASSISTANT if state == USER else USER
            self._offer(found, to, cost + REROLE + cut, origin, ord("R"), (first, "assistant" if state == USER else "user", text))
            if initial == ("a" if state == USER else "u"):
                self._offer(found, to, cost + cut, origin, ord("K"), (first, role, text))
            elif initial == "s" and first:
                self._offer(found, SYSTEM, cost + cut, origin, ord("K"), (first, role, text))
        self.best = self._settle(found)
        if len(self.tree) > self.compact_at:
            live = [s for s in self.best if s is not None]
            numbers = iter(self.tree.compact([s[1] for s in live]))
            self.best = [s and (s[0], next(numbers), s[2]) for s in self.best]
            self.compact_at = 2 * len(self.tree) + _COMPACT_AT

    def result(self) -> tuple:
        self._insert()
        ends = [s for s in (self.best[NOTHING], self.best[ASSISTANT]) if s is not None]
        chosen = ends[0]
        if len(ends) == 2 and (ends[1][0] < chosen[0] or (ends[1][0] == chosen[0] and self.tree.less(ends[1][1], chosen[1]))):
            chosen = ends[1]
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.turns, _LARGEST)
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal, chosen[0])
        return (*counts, self.tree.text(chosen[1]), chosen[2].hexdigest())


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _marked(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) with its faults; ``n`` numbers a conversation's rows from 1.

    Only ids move rows between tasks: one exchange serves the search for repetitions and the order of turns.
    """
    body = F.rtrim(F.col("text"), F.lit(SPACES))
    rows = df.select(
        F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    ).withColumns({"blank": body == "", "_sha": F.sha2("text", 256)})
    whole = F.substring(body, F.length(body), F.lit(1)).isin(ENDS)
    seen = Window.partitionBy("conv_id", "role", "_sha").orderBy("turn")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.repartition("conv_id").withColumns({"duplicate": F.row_number().over(seen) > 1, "truncated": ~whole})
    return rows.withColumn("n", F.row_number().over(order)).drop("_sha")


def audit(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df`` (conv_id, turn, role, text): faults, the cheapest edits and their digest.

    Columns: conv_id, gaps (turn numbers missing between the smallest and the largest), blank, duplicate, truncated
    (rows by their first fault), illegal (neighbours whose initials are none of su, ua, au), cost, audit, and
    repaired_sha256 of the repaired rows (``role:text``, joined by newlines).

    Rows go by turn, null turns first, equal turns by role and text. A null role or text is one space; a role that
    is empty or begins with another letter can not be kept. Rows without a conv_id are one conversation. Other columns
    are not read. An empty table has no conversations.
    """
    id_type = df.schema["conv_id"].dataType
    rows = _marked(df).drop("n").sortWithinPartitions("conv_id", "turn", "role", "text", "duplicate")
    schema = f"conv_id {id_type.simpleString()}, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"
    names = ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    columns = ["conv_id", "turn", "role", "text", "blank", "duplicate", "truncated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, out, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            ids = batch.column("conv_id").to_pylist()
            for conv_id, *row in zip(ids, *[batch.column(c).to_pylist() for c in columns[1:]], strict=True):
                if state is None or conv_id != current:
                    if state is not None:
                        out.append((current, *state.result()))
                    current, state = conv_id, Repair()
                state.add(*row)
            if len(out) >= 1000:
                yield _batch(out, names, kind)
                out = []
        if state is not None:
            out.append((current, *state.result()))
        if out:
            yield _batch(out, names, kind)

    return rows.select(*columns).mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, *[pa.int64()] * len(COUNTS), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def repaired_turns(df: DataFrame, audits: DataFrame | None = None) -> DataFrame:
    """The repaired conversations: conv_id, step (from 0), edit, turn, role, text; deleted rows are left out.

    Built from the audits (those of ``audit(df)`` if none are given): an edit other than an insertion belongs to the
    next row of its conversation. Null and tied values as in ``audit``.
    """
    audits = audit(df) if audits is None else audits
    rows = _marked(df).select("conv_id", "n", "turn", "role", "text")
    edits = audits.select(F.col("conv_id").alias("_id"), F.posexplode(F.split("audit", "")).alias("step", "edit"))
    so_far = Window.partitionBy("_id").orderBy("step")
    number = F.count_if(F.col("edit") != "I").over(so_far)
    edits = edits.filter("edit <> ''").withColumn("_n", F.when(F.col("edit") != "I", number))
    met = edits.join(rows, F.col("_id").eqNullSafe(F.col("conv_id")) & (F.col("_n") == F.col("n")), "left")
    stays = met.filter("edit <> 'D'").withColumn("_system", (F.col("edit") == "K") & F.col("role").startswith("s"))
    spoken = F.count_if(~F.col("_system")).over(so_far)
    given = F.when(spoken % 2 == 1, "user").otherwise("assistant")
    return stays.select(
        F.col("_id").alias("conv_id"), "step", "edit", "turn",
        F.when(F.col("edit") == "K", F.col("role")).otherwise(given).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
