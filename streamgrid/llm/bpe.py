"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table.

An Aho-Corasick automaton over the token bytes gives the longest token that starts at each byte. The encoder takes
longest tokens from left to right. A neighbouring pair stands only if no merge would have crossed its border, which a
pair table tells; otherwise the last token is shortened to its next longest prefix token, or the one before it is
taken back. A byte position from which no valid continuation was found is marked, so each is tried once and the work
is linear in the text. The result is the one that merging pairs by rank gives.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import struct_column, with_struct

#: Fixed value: how byte-level tokenizers split a text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same split for texts made of these characters alone, where the faster standard module knows the classes.
PLAIN_SPLIT = r""" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?[^\w\s]+|\s+(?!\S)|\s+"""
NOT_PLAIN = r"[^\t-\r\x20-^`-~\u00c0-\u024f\u0400-\u045f]"

#: Entries a worker keeps of pieces already encoded and of pairs already judged; beyond it they are computed again.
MEMO_ENTRIES = 200_000
#: Longer pieces are not remembered.
MEMO_CHARS = 64

NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens as bytes, how each was merged, and which neighbours can stand side by side."""

    def __init__(self, blob: bytes):
        spec = json.loads(blob)
        letters = byte_letters()
        to_bytes = lambda s: bytes(letters[c] for c in s)
        ids = spec["model"]["vocab"]
        special = sorted((a for a in spec["added_tokens"]), key=lambda a: (-len(a["content"]), a["id"]))
        self.special = {a["content"]: a["id"] for a in special}
        #: Special strings are cut out of a text first, the longest one winning.
        self.special_pattern = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        size = max([*ids.values(), *self.special.values()]) + 1
        token_bytes: list[bytes] = [b""] * size
        for text, i in ids.items():
            token_bytes[i] = text.encode() if text in self.special else to_bytes(text)
        for text, i in self.special.items():
            token_bytes[i] = text.encode()
        #: pair of ids -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        #: merged id -> (rank, left id, right id), by its first merge
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]):
            pair, merged = (ids[a], ids[b]), ids[a + b]
            self.merges.setdefault(pair, (rank, merged))
            self.parts.setdefault(merged, (rank, *pair))
        self._left = functools.lru_cache(None)(lambda t: self._edge(t, 1))
        self._right = functools.lru_cache(None)(lambda t: self._edge(t, 2))
        self.pair_ok: dict[int, bool] = {}
        self.size = size
        plain = [i for i in ids.values() if i not in set(self.special.values())]
        usable = [i for i in plain if token_bytes[i] and self._forms(i)]
        by_bytes = {token_bytes[i]: i for i in usable}
        self.automaton = ahocorasick.Automaton()
        for key, i in by_bytes.items():
            self.automaton.add_word(key.decode("latin-1"), (len(key), i))
        self.automaton.make_automaton()
        self.whole = by_bytes
        #: The next longest token that begins a token, or -1.
        self.shorter = {i: self._prefix_token(key, by_bytes) for key, i in by_bytes.items()}
        self.length = [len(b) for b in token_bytes]
        #: Decoding: all token bytes in one array, and where each token begins.
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.bytes = np.frombuffer(b"".join(token_bytes), np.uint8)
        self.names = [str(i) for i in range(size)]
        self.memo: dict[str, tuple[int, ...]] = {}
        self._full_split = regex.compile(SPLIT).findall
        self._plain_split = re.compile(PLAIN_SPLIT).findall
        self._not_plain = re.compile(NOT_PLAIN).search

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that lie at one edge of ``token`` while it is merged: (id, rank it came by, rank it went by)."""
        found, gone = [], NEVER
        while token in self.parts:
            rank = self.parts[token][0]
            found.append((token, rank, gone))
            token, gone = self.parts[token][side], rank
        return [*found, (token, -1, gone)]

    def _crossed(self, left: int, right: int, until: int = NEVER) -> bool:
        """Whether merging by rank joins something across the border of two tokens, before rank ``until``.

        A pair across the border is merged if both sides exist at its rank. At equal ranks the leftmost pair goes
        first: before the border that is the one inside ``left``, behind it the one across.
        """
        for a, came_a, gone_a in self._right(left):
            for b, came_b, gone_b in self._left(right):
                rank = self.merges.get((a, b), (NEVER,))[0]
                if rank < until and came_a < rank < gone_a and came_b < rank <= gone_b:
                    return True
        return False

    def _forms(self, token: int) -> bool:
        """Whether merging by rank turns the bytes of ``token`` into it."""
        if token not in self.parts:
            return True
        rank, a, b = self.parts[token]
        return self._forms(a) and self._forms(b) and not self._crossed(a, b, rank)

    @staticmethod
    def _prefix_token(key: bytes, ids: dict[bytes, int]) -> int:
        return next((ids[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in ids), -1)

    def fits(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.pair_ok.get(key)
        if known is None:
            if len(self.pair_ok) >= MEMO_ENTRIES:
                self.pair_ok.clear()
            known = self.pair_ok[key] = not self._crossed(left, right)
        return known

    def longest_starts(self, data: bytes) -> list[int]:
        """The longest token that starts at each byte."""
        best = [-1] * len(data)
        for end, (n, token) in self.automaton.iter(data.decode("latin-1")):
            best[end - n + 1] = token  # ends grow, so the last one seen is the longest
        return best

    def encode_piece(self, data: bytes) -> list[int]:
        """The tokens of one piece."""
        if (token := self.whole.get(data)) is not None:
            return [token]
        best, length, n = self.longest_starts(data), self.length, len(data)
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, token = 0, best[0]
        while True:
            while token >= 0:
                end = at + length[token]
                if open_at[end] and (not out or self.fits(out[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                at, token = end, best[end]
            else:
                open_at[at] = 0
                if not out:
                    raise ValueError("a byte of the text has no token")
                last = out.pop()
                at -= length[last]
                token = self.shorter[last]

    def split(self, text: str) -> list[str]:
        return self._full_split(text) if self._not_plain(text) else self._plain_split(text)

    def encode(self, text: str) -> list[int]:
        memo = self.memo

        def pieces(part: str) -> list[int]:
            found = self.split(part)
            try:
                return list(chain.from_iterable(map(memo.__getitem__, found)))
            except KeyError:
                ids: list[int] = []
                for piece in found:
                    known = memo.get(piece)
                    if known is None:
                        known = tuple(self.encode_piece(piece.encode()))
                        if len(piece) <= MEMO_CHARS:
                            if len(memo) >= MEMO_ENTRIES:
                                memo.clear()
                            memo[piece] = known
                    ids.extend(known)
                return ids

        if self.special_pattern is None or not self.special_pattern.search(text):
            return pieces(text)
        out: list[int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += [*pieces(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + pieces(text[at:])

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, gathered from the offset table."""
        if not len(ids):
            return b""
        tokens = np.asarray(ids, np.int64)
        begins = self.offsets[tokens]
        sizes = self.offsets[tokens + 1] - begins
        ends = np.cumsum(sizes)
        places = np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)
        return self.bytes[places].tobytes()


@functools.lru_cache(maxsize=2)
def _vocabulary(digest: str, path: str, blob_holder: object) -> Vocabulary:
    return Vocabulary(blob_holder.value)


class _Shipped:
    """The vocabulary file (a few MB, of fixed size) as a broadcast; each Python worker builds its tables once."""

    def __init__(self, df: DataFrame, path: str):
        blob = Path(path).read_bytes()
        self.path, self.digest = path, hashlib.sha256(blob).hexdigest()
        self.value = df.sparkSession.sparkContext.broadcast(blob)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Shipped) and self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)

    def tables(self) -> Vocabulary:
        return _vocabulary(self.digest, self.path, self.value)


def encode(df: DataFrame, vocab_path: str, text: str = "text", out: str = "tokens") -> DataFrame:
    """Add the token ids of ``text`` as ``out`` (array of int). A null text has the tokens of the empty one, none.

    A column named ``out`` is replaced; all others, and every row, stay as they are.
    """
    shipped = _Shipped(df, vocab_path)

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        vocab = shipped.tables()
        return pa.array([vocab.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))

    return df.withColumn(out, run(F.col(text)))


def decode(df: DataFrame, vocab_path: str, tokens: str = "tokens", out: str = "text") -> DataFrame:
    """Add the text of ``tokens`` as ``out``; bytes that are no UTF-8 become U+FFFD. Null or empty: the empty text.

    An id that is null, negative or outside the vocabulary stands for no bytes.
    """
    shipped = _Shipped(df, vocab_path)

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        vocab = shipped.tables()
        known = lambda row: [i for i in row or [] if i is not None and 0 <= i < vocab.size]
        return pa.array([vocab.decode_bytes(known(r.as_py())).decode("utf-8", "replace") for r in ids], pa.string())

    return df.withColumn(out, run(F.col(tokens)))


DIGEST = pa.struct(
    [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
)


def digest(df: DataFrame, vocab_path: str, text: str | Column = "text") -> DataFrame:
    """Add ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encoded, and decoded again from the ids, in one pass.

    A null or empty text has no tokens and the digests of nothing. Rows, repeated ones too, and other columns stay;
    columns of these names are replaced. An empty table stays empty.
    """
    shipped = _Shipped(df, vocab_path)

    def one(t: str) -> tuple:
        vocab = shipped.tables()
        ids = vocab.encode(t)
        joined = ",".join(map(vocab.names.__getitem__, ids))
        decoded = vocab.decode_bytes(ids).decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()

    struct = struct_column(one, DIGEST, F.col(text) if isinstance(text, str) else text)
    return with_struct(df, struct, [f.name for f in DIGEST])
