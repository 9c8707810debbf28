"""Finding licences in texts: phrases of notices, identifier tags, and the expressions behind the tags.

One Aho-Corasick automaton reads the words of a text and finds notice phrases and tags. What follows a tag is an
expression with ``and``, ``or``, ``with`` and parentheses; a shunting-yard parser turns it into postfix order, from
which its identifiers and its obligations are evaluated.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import struct_column, with_struct

# Phrases and their labels. The first four are the base.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
PHRASES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "eclipse public license": "epl",
    "isc license": "isc",
    "all rights reserved": "reserved",
}
TAG = "spdx license identifier"
# How much an identifier that begins so asks of its users (0 nothing to 3 sharing over networks).
OBLIGATIONS = {
    "cc0": 0, "unlicense": 0, "0bsd": 0, "mit": 1, "bsd": 1, "apache": 1, "isc": 1, "zlib": 1, "cc-by": 1,
    "mpl": 2, "lgpl": 2, "epl": 2, "gpl": 3, "agpl": 3,
}

#: Bytes of the words: digits, letters and everything beyond ASCII; capital letters are lowered.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
#: A tag's expression is read to the end of its line.
TAG_BEFORE = re.compile(r"spdx[^A-Za-z0-9\n]{1,3}license[^A-Za-z0-9\n]{1,3}identifier[ \t]*:[ \t]*([^\r\n]*)", re.I | re.A)


def postfix(expression: str) -> list[str] | None:
    """The expression in postfix order, operators in lower case; None if it is not well formed."""
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    for token in TOKEN.findall(expression):
        word = token.lower()
        if token == "(":
            if not operand_next:
                break
            waiting.append(token)
        elif token == ")":
            if operand_next or "(" not in waiting:
                break
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif word in PRECEDENCE:
            if operand_next:
                return None
            while waiting and waiting[-1] != "(" and PRECEDENCE[waiting[-1]] >= PRECEDENCE[word]:
                out.append(waiting.pop())
            waiting.append(word)
            operand_next = True
        elif operand_next:
            out.append(word)
            operand_next = False
        else:
            break  # prose after the expression
    if operand_next or "(" in waiting:
        return None
    return out + waiting[::-1]


def obligation(identifier: str) -> int:
    """What an identifier asks of its users, by the longest known beginning; unknown ones ask most."""
    known = [k for k in OBLIGATIONS if identifier == k or identifier.startswith((k + "-", k + "."))]
    return OBLIGATIONS[max(known, key=len)] if known else 3


def evaluate(expression: str) -> tuple[list[str], int] | None:
    """Identifiers and obligation of an expression: ``and`` asks the most, ``or`` the least, an exception one less."""
    order = postfix(expression)
    if order is None:
        return None
    stack: list[tuple[list[str], int]] = []
    for item in order:
        if item not in PRECEDENCE:
            stack.append(([item], obligation(item)))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if item == "with":
            stack.append((left, max(0, a - 1)))
        else:
            stack.append((left + right, max(a, b) if item == "and" else min(a, b)))
    return stack[0]


class Finder:
    def __init__(self, base: Mapping[str, str], more: Mapping[str, str]):
        self.automaton = ahocorasick.Automaton()
        for words, label in {**more, **base}.items():
            self.automaton.add_word(f" {words} ", (len(words) + 2, label, words in base))
        self.automaton.add_word(f" {TAG} ", (len(TAG) + 2, None, False))
        self.automaton.make_automaton()

    def find(self, text: str) -> tuple:
        """The fields of ``FOUND``."""
        words = text.encode().translate(WORD_BYTES).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        base, more, identifiers = set(), set(), set()
        tagged, asks = False, -1
        place = counted = 0
        for end, (size, label, is_base) in self.automaton.iter(line):
            if label is None:
                tagged = True
            elif is_base:
                begin = end - size + 1  # the blank before the phrase: as many blanks lie before it as words
                place += line.count(" ", counted, begin) if begin >= counted else -line.count(" ", begin, counted)
                counted = begin
                starts.append(place)
                base.add(label)
            else:
                more.add(label)
        if tagged:
            for m in TAG_BEFORE.finditer(text):
                if found := evaluate(m[1]):
                    identifiers.update(found[0])
                    asks = max(asks, found[1])
        labels = base | more | identifiers
        score = 1.0 if identifiers else 0.9 if base else 0.8 if more else 0.3 if tagged else 0.0
        first, last = (min(starts), max(starts)) if starts else (None, None)
        listed = lambda s: ",".join(sorted(s))
        return (
            len(words), len(starts), first, last, listed(base), listed(labels), score,
            asks if identifiers else None, listed(identifiers),
        )


FOUND = pa.struct(
    [
        ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
        ("obligation", pa.int64()), ("identifiers", pa.string()),
    ]
)


@functools.lru_cache(maxsize=4)
def _finder(base: tuple, more: tuple) -> Finder:
    return Finder(dict(base), dict(more))


def find_licenses(
    df: DataFrame,
    text: str = "text",
    base: Mapping[str, str] = BASE_PHRASES,
    more: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """Add what licences ``text`` names; every row and all other columns stay, columns of these names are replaced.

    ``n_words`` words; ``n_base`` places where a base phrase stands, ``first_word`` and ``last_word`` the smallest
    and largest of them (null without any); ``base_labels`` and ``labels`` distinct, sorted, joined by commas;
    ``identifiers`` from well-formed expressions behind tags; ``obligation`` the most that any of these expressions
    asks (null without any); ``score`` 1 for an identifier, 0.9 for a base phrase, 0.8 for another, 0.3 for a tag
    whose expression cannot be read, else 0. Null and empty texts: no words, no labels, score 0.
    """
    base, more = tuple(base.items()), tuple(more.items())
    struct = struct_column(lambda t: _finder(base, more).find(t), FOUND, F.col(text))
    return with_struct(df, struct, [f.name for f in FOUND])
