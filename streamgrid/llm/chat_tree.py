r"""Chat formatting over a prefix tree: conversations that begin with the same turns share them.

A turn is written as ``<|im_start|>role\ntext<|im_end|>\n``. Inside roles and texts every ``<``, then any number of
backslashes, then ``|`` gets one backslash more, so no control string can arise from a text, and one backslash less
restores it; in roles backslashes and line ends are escaped first.

``pack`` sorts conversations by the digests of their turns, which is a depth-first walk of their prefix tree, and writes
each turn that the conversation before does not share. Spark deals ranges of that order to tasks; such a range is a
block, a training sequence that stands by itself: shared turns are written once in it, again only where the next block
begins. Every turn has its place in the block, its position ids (as if the turns above it stood directly before it), the
intervals of the block that it may attend to (the turns above it) and the loss interval of an assistant's text.
``unpack`` reads conversations back from these rows alone.

A task holds the digests and places of one conversation's turns, not their texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
ASSISTANT = "assistant"
#: Turns whose digests a row carries as its sort key. Conversations that share more than these are sorted on by a digest
#: of all their turns, so that equal ones still meet; they share as many turns as their neighbours allow.
KEY_TURNS = 64

_CONTROL, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_ROLE_MARKS = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def format_turn(role: str, text: str) -> str:
    name = role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"{START}{escape(name)}\n{escape(text)}{END}"


def parse_turn(turn: str) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    if not turn.startswith(START) or not turn.endswith(END):
        raise ValueError("not a formatted turn")
    name, _, text = turn[len(START) : -len(END)].partition("\n")
    role = _ROLE_MARKS.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(name))
    return role, unescape(text)


PACKED = (
    "block bigint, n bigint, conv_id {id}, depth bigint, turn string, `start` bigint, `end` bigint, position bigint, "
    "attends array<struct<`start`:bigint,`end`:bigint>>, loss_start bigint, loss_end bigint, is_end boolean"
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _walk_order(df: DataFrame) -> DataFrame:
    """Turns in the order of the tree: sorted by the digests of their conversation's turns, dealt out by ranges."""
    rows = df.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    whole = Window.partitionBy("conv_id")
    order = whole.orderBy("turn", "role", "text")
    digest = F.unhex(F.lpad(F.hex(F.xxhash64("role", "text")), 16, "0"))
    rows = rows.withColumns({"depth": F.row_number().over(order).cast("bigint"), "_digest": digest})
    first = F.when(F.col("depth") <= KEY_TURNS, F.struct("depth", "_digest"))
    rows = rows.withColumns({
        "_firsts": F.array_sort(F.collect_list(first).over(whole)),
        "_all": F.sum(F.xxhash64("depth", "_digest").cast("decimal(38,0)")).over(whole),
    })
    key = F.aggregate("_firsts", F.lit(b""), lambda so_far, x: F.concat(so_far, x["_digest"]))
    rows = rows.withColumn("_key", key).drop("_firsts", "_digest", "turn")
    dealt = rows.repartitionByRange("_key", "_all", "conv_id")
    return dealt.sortWithinPartitions("_key", "_all", "conv_id", "depth")


class Block:
    """The tree's path to the turn written last: digests, places in the block, and intervals to attend to."""

    def __init__(self, number: int):
        self.number, self.n, self.end = number, 0, 0
        self.path: list[tuple[bytes, int, int, int]] = []  # digest, start, end, length from the root
        self.shares = True
        self.depth = 0

    def begin(self) -> None:
        self.shares, self.depth = True, 0

    def attends(self) -> list[dict]:
        """The places of the turns above, neighbours joined."""
        spans: list[list[int]] = []
        for _, start, end, _ in self.path:
            if spans and spans[-1][1] == start:
                spans[-1][1] = end
            else:
                spans.append([start, end])
        return [{"start": s, "end": e} for s, e in spans]

    def add(self, conv_id: object, role: str, text: str) -> tuple | None:
        """The row of a turn, or None if the path has it already."""
        digest = hashlib.sha256(f"{len(role)} {role}{text}".encode("utf-8", "surrogatepass")).digest()
        if self.shares and self.depth < len(self.path) and self.path[self.depth][0] == digest:
            self.depth += 1
            return None
        if self.shares:
            del self.path[self.depth :]
            self.shares = False
            self.above = self.attends()
        turn = format_turn(role, text)
        position = self.path[-1][3] if self.path else 0
        start, end = self.end, self.end + len(turn)
        loss = (end - len(END) - len(escape(text)), end - len(END)) if role == ASSISTANT else (None, None)
        attends = self.above
        self.path.append((digest, start, end, position + len(turn)))
        self.above = [*attends[:-1], {"start": attends[-1]["start"], "end": end}] if attends and attends[-1]["end"] == start else [
            *attends, {"start": start, "end": end},
        ]
        self.depth += 1
        self.end = end
        self.n += 1
        return (self.number, self.n, conv_id, self.depth, turn, start, end, position, attends, *loss, False)

    def close(self, conv_id: object) -> tuple:
        """The row that says that a conversation ends at the present depth."""
        if self.shares:
            del self.path[self.depth :]
        self.n += 1
        length = self.path[-1][3]
        return (self.number, self.n, conv_id, self.depth, None, self.end, self.end, length, self.attends(), None, None, True)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema
    )


#: Characters of formatted turns in an Arrow batch, about.
_BATCH_CHARS = 4 << 20


def pack(df: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as blocks of turns in depth-first order, shared turns written once.

    Rows with a ``turn`` hold one formatted turn: its place ``start`` to ``end`` in the block (code points), ``position``
    (the position id of its first code point), ``attends`` (intervals of the block above it), and the loss interval of
    an assistant's text. Rows without one (``is_end``) say that ``conv_id`` ends at this ``depth`` of the path, with
    all it may attend to, and its length as ``position``. (block, n) is the order of the rows.

    Turns go by number, nulls first, equal ones by role and text. A null text or role is empty. Rows without a conv_id
    are one conversation. Repeated rows are turns of their own. An empty table has no blocks; other columns are not read.
    """
    id_type = df.schema["conv_id"].dataType.simpleString()
    rows = _walk_order(df).select("conv_id", "depth", "role", "text", F.spark_partition_id().cast("bigint").alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = schema = current = None
        out, chars = [], 0
        for batch in batches:
            if block is None and batch.num_rows:
                block = Block(batch.column("block")[0].as_py())
                big = pa.int64()
                schema = pa.schema([
                    ("block", big), ("n", big), ("conv_id", batch.schema.field("conv_id").type), ("depth", big),
                    ("turn", pa.string()), ("start", big), ("end", big), ("position", big), ("attends", pa.list_(_SPAN)),
                    ("loss_start", big), ("loss_end", big), ("is_end", pa.bool_()),
                ])
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "depth", "role", "text")]
            for conv_id, depth, role, text in zip(*columns, strict=True):
                if depth == 1:
                    if current is not None:
                        out.append(block.close(current[0]))
                    current = (conv_id,)
                    block.begin()
                row = block.add(conv_id, role, text)
                if row is not None:
                    out.append(row)
                    chars += len(row[4])
                if chars > _BATCH_CHARS or len(out) > 10_000:
                    yield _batch(out, schema)
                    out, chars = [], 0
        if current is not None:
            out.append(block.close(current[0]))
            yield _batch(out, schema)

    return rows.mapInArrow(run, PACKED.format(id=id_type))


class Path:
    """What the turns above say about a conversation, per depth: digests that can be continued, and lengths."""

    def __init__(self) -> None:
        self.levels: list[tuple] = [(hashlib.sha256(), hashlib.sha256(), 0, 0)]

    def add(self, depth: int, turn: str, start: int, loss_start: int | None, loss_end: int | None) -> None:
        del self.levels[depth:]
        turns, loss, loss_chars, chars = self.levels[-1]
        role, text = parse_turn(turn)
        turns = turns.copy()
        turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        if loss_start is not None:
            said = unescape(turn[loss_start - start : loss_end - start])
            loss = loss.copy()
            loss.update(said.encode("utf-8", "surrogatepass"))
            loss_chars += len(said)
        self.levels.append((turns, loss, loss_chars, chars + len(turn)))

    def read(self, depth: int) -> tuple:
        turns, loss, loss_chars, chars = self.levels[depth]
        return depth, turns.hexdigest(), loss_chars, loss.hexdigest(), chars


def in_order(packed: DataFrame) -> DataFrame:
    """The rows of ``pack``, each block in one task and in its order, from wherever they were written."""
    return packed.repartition("block").sortWithinPartitions("block", "n")


def unpack(packed: DataFrame) -> DataFrame:
    """The turns of every conversation, read back: conv_id, depth (from 1), role, text, and whether the loss covers it.

    A block is read once, in its order. A task holds the turns on the path to the present one; where a conversation ends
    it has just these.
    """
    id_type = packed.schema["conv_id"].dataType.simpleString()
    columns = ["block", "conv_id", "depth", "turn", "loss_start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, path, out, chars = None, [], [], 0
        for batch in batches:
            schema = pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("depth", pa.int64()), ("role", pa.string()),
                ("text", pa.string()), ("loss", pa.bool_()),
            ])
            for block, conv_id, depth, turn, loss in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if block != current:
                    current, path = block, []
                del path[depth - (turn is not None) :]
                if turn is not None:
                    path.append((*parse_turn(turn), loss is not None))
                    continue
                for i, said in enumerate(path):
                    out.append((conv_id, i + 1, *said))
                    chars += len(said[1])
                    if chars > _BATCH_CHARS or len(out) > 10_000:
                        yield _batch(out, schema)
                        out, chars = [], 0
        if out:
            yield _batch(out, schema)

    schema = f"conv_id {id_type}, depth bigint, role string, text string, loss boolean"
    return in_order(packed).select(*columns).mapInArrow(run, schema)


DIGEST = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digest(packed: DataFrame) -> DataFrame:
    """Per conversation, read back from the blocks: its turns, loss texts and length."""
    id_type = packed.schema["conv_id"].dataType.simpleString()
    schema = (
        f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
        "formatted_chars bigint"
    )
    columns = ["block", "conv_id", "depth", "turn", "start", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, path = None, None
        for batch in batches:
            out = []
            for block, conv_id, depth, *turn in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
                if path is None or block != current:
                    current, path = block, Path()
                if turn[0] is not None:
                    path.add(depth, *turn)
                else:
                    out.append((conv_id, *path.read(depth)))
            big = pa.int64()
            types = [batch.schema.field("conv_id").type, big, pa.string(), big, pa.string(), big]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["conv_id", *DIGEST])

    return in_order(packed).select(*columns).mapInArrow(run, schema)

