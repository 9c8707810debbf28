"""Shape features of a text: how it is written, not what it says. Bounded in number, computed in linear time."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

#: Word bytes stay, all others part words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KINDS = {
    "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "digit": bytes(range(48, 58)),
    "high": bytes(range(128, 256)), "blank": b" \t\r", "line": b"\n", "stop": b".,;:?", "bang": b"!",
    "bar": b"|", "hash": b"#", "star": b"*", "money": b"$", "percent": b"%", "and": b"&", "angle": b"<>",
    "quote": b"\"'`", "bracket": b"()[]{}", "other": b"+-=_/\\^~@",
}
_KIND_OF_BYTE = np.array([[float(b in signs) for b in range(256)] for signs in _KINDS.values()])
_SIGNS = re.compile(rb"[^0-9A-Za-z\x80-\xff\s]{2,}")

NAMES = [
    "log_words", "log_bytes", "word_length", "long_words", "short_words", "variety", "top_word", "top_three",
    "next_same", "double_lines", "line_words", "no_stop_lines", "bar_lines", "sign_runs", "sentence_words",
    *(f"part_{k}" for k in _KINDS),
]


def features(text: str) -> list[float]:
    """One number for each of ``NAMES``; the empty text has zeros."""
    data = text.encode()
    if not data:
        return [0.0] * len(NAMES)
    n = len(data)
    words = data.translate(_WORDS).split()
    w = max(1, len(words))
    counts = Counter(words)
    top = counts.most_common(3)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    parts = _KIND_OF_BYTE @ np.bincount(np.frombuffer(data, np.uint8), minlength=256) / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return [
        math.log1p(len(words)),
        math.log1p(n),
        min(40.0, float(lengths.sum()) / w),
        float((lengths > 12).sum()) / w,
        float((lengths < 3).sum()) / w,
        len(counts) / math.sqrt(w),
        top[0][1] / w if top else 0.0,
        sum(c for _, c in top) / w,
        sum(map(bytes.__eq__, words, words[1:])) / w,
        1 - len(set(lines)) / m,
        math.log1p(w / m),
        sum(x.rstrip()[-1:] not in b".!?:" for x in lines) / m,
        sum(b"|" in x for x in lines) / m,
        len(_SIGNS.findall(data)) / w,
        math.log1p(w / (1 + data.count(b"."))),
        *parts.tolist(),
    ]
