"""Scanning texts for secrets with one deterministic automaton of all rules.

The rules are compiled together by subset construction and minimised into one transition array. Each text is read
once, byte by byte; that tells which rules match anywhere in it. Only for those the places are worked out: the rule's
reversed automaton marks every start of a match from right to left, and from the leftmost start on the rule's own
automaton runs to its longest end. All passes are linear in the text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.automata import Automaton, parse, reverse, shortest
from streamgrid.llm.common import struct_column, with_struct


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Matches with fewer characters are dropped, and not tried otherwise.
    least: int = 0
    #: If given, only the characters after this part of a match count.
    head: str = ""


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


# Words before an assigned secret, and the shapes of known keys.
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "api_?key"]
_WORDS = "|".join(map(either_case, ASSIGN_WORDS))
_BEFORE_VALUE = f"({_WORDS})[\"']?\\x20*[:=]\\x20*[\"']?"
BASE_RULES = (
    Rule("assign", _BEFORE_VALUE + "([A-Za-z0-9+/_.=-]+)", 8, _BEFORE_VALUE),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    # A shorter run holds no longer match, so this bound may stand in the pattern.
    Rule("hex", "[0-9a-f]{32,}"),
)
# Lengths are left to ``least``: counting them in several rules at once multiplies the states.
RULES = (
    *BASE_RULES,
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", "xox[abeoprs]-[A-Za-z0-9-]+", 15),
    Rule("google", "AIza[A-Za-z0-9_-]+", 39),
    Rule("live_key", "[rs]k_live_[A-Za-z0-9]+", 24),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 40),
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)
        self.heads = [re.compile(r.head.encode()) if r.head else None for r in rules]
        trees = [parse(r.pattern) for r in rules]
        self.all = Automaton([shortest(t) for t in trees], anywhere=True)
        self.backward = [Automaton([reverse(t)], anywhere=True) for t in trees]
        self.forward = [Automaton([t], anywhere=False) for t in trees]

    def matching(self, data: bytes) -> int:
        """The rules, as bits, that match somewhere: the one pass over every byte."""
        moves, limit, accepts = self.all.moves, self.all.first_accept, self.all.accepts
        state = found = 0
        for byte in data:
            state = moves[state + byte]
            if state >= limit:
                found |= accepts[state >> 8]
        return found

    def places(self, data: bytes, rule: int) -> list[tuple[int, int]]:
        """Leftmost-longest matches of one rule that do not overlap, as byte ranges."""
        moves, limit = self.backward[rule].moves, self.backward[rule].first_accept
        state, starts, at = 0, [], len(data)
        for byte in reversed(data):
            state = moves[state + byte]
            at -= 1
            if state >= limit:
                starts.append(at)
        forward = self.forward[rule]
        moves, limit, dead = forward.moves, forward.first_accept, forward.dead
        least, head = self.rules[rule].least, self.heads[rule]
        found, after = [], 0
        for start in reversed(starts):
            if start < after:
                continue
            state = 0
            for i in range(start, len(data)):
                state = moves[state + data[i]]
                if state >= limit:
                    after = i + 1
                elif state == dead:
                    break
            skipped = head.match(data, start).end() if head else start
            if after - skipped >= least:
                found.append((start, after))
        return found

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rule, end) in code points, by start, then rule."""
        data = text.encode()
        hits = self.matching(data)
        spans = []
        for rule in range(len(self.rules)):
            if hits >> rule & 1:
                spans += [(s, rule, e) for s, e in self.places(data, rule)]
        if spans and len(data) != len(text):
            begins = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
            point = lambda i: int(begins[i - 1]) if i else 0  # noqa: E731  code points before byte i
            spans = [(point(s), rule, point(e)) for s, rule, e in spans]
        return sorted(spans)


@functools.lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


FOUND = pa.struct(
    [
        ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()),
        ("base_sha256", pa.string()), ("spans", pa.string()),
    ]
)


def find_secrets(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, out: str = "secrets") -> DataFrame:
    """Add the secrets of ``text`` as ``out``: an array of (kind, start, end), code points, end exclusive.

    Ordered by start, then by the order of the rules. Null and empty texts have none. Matches of different kinds may
    overlap. Repeated rows are scanned alike; a column named ``out`` is replaced.
    """
    rules = tuple(rules)

    @F.arrow_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def run(texts: pa.Array) -> pa.Array:
        kinds = [r.kind for r in rules]
        rows = [
            [{"kind": kinds[r], "start": s, "end": e} for s, r, e in scanner(rules).scan(t.as_py() or "")]
            for t in texts
        ]
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        return pa.array(rows, pa.list_(span))

    return df.withColumn(out, run(F.col(text)))


def secret_digest(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of the base kinds, ``base_sha256`` over their spans, and ``spans`` over those of all rules.

    A null or empty text has no spans and the digest of nothing. Rows, repeated ones too, and other columns stay;
    columns of these names are replaced. An empty table stays empty.
    """
    kinds = [r.kind for r in RULES]
    base = len(BASE_RULES)

    def one(t: str) -> tuple:
        spans = scanner(RULES).scan(t)
        shown = [(r, f"{kinds[r]}:{s}:{e}") for s, r, e in spans]
        joined = ",".join(x for r, x in shown if r < base)
        counts = [sum(r == k for r, _ in shown) for k in range(base)]
        return *counts, hashlib.sha256(joined.encode()).hexdigest(), ",".join(x for _, x in shown)

    return with_struct(df, struct_column(one, FOUND, F.col(text)), [f.name for f in FOUND])
