"""Toxic texts by weak supervision.

Voters are words and beginnings of words that stand out among labelled toxic documents, and patterns of writing. A
generative model estimates, by expectation-maximisation, how often each voter fires in toxic and in clean documents;
voters that fire together share one vote, so that correlated ones are not counted several times. A linear classifier
is then trained on the posterior labels, from how often each voter fires; a given label is one more voter there.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import cut
from streamgrid.llm.training import SAMPLE_ROWS, descend, in_order, sample, scored, sigmoid

#: Labelled toxic documents that a lexicon voter must occur in.
LEAST_DOCUMENTS = 4
#: Share of toxic documents among those labelled that a lexicon voter occurs in, at least.
LEAST_PRECISION = 0.6
#: Lengths, in bytes, of the beginnings of words that may vote.
BEGINNINGS = range(4, 11)
#: Voters whose firing correlates at least so share their vote.
SAME = 0.5
#: How often a given label is taken to be wrong where it votes.
GOLD_ERROR = 0.01
ROUNDS = 30
STEPS = 500
RATE = 0.05
DECAY = 1e-3
THRESHOLD = 0.5
MEMO_WORDS = 300_000

#: Bytes of words; capital letters of ASCII are lowered.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
PATTERNS = {
    "shouting": re.compile(rb"(?:\b[A-Z]{3,}\b[ ,!]*){3}"),
    "marks": re.compile(rb"[!?]{3,}"),
    "masked": re.compile(rb"\b[A-Za-z]+[*@#$]{2,}[A-Za-z]+\b"),
    "you_are": re.compile(rb"\byou(?: a|'|\xe2\x80\x99)re\b", re.I),
}


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def keys_of(word: bytes) -> list[bytes]:
    """Lexicon entries that a word could be: itself (behind ``=``), and its beginnings."""
    return [b"=" + word, *(word[:n] for n in BEGINNINGS if n <= len(word))]


class Voters:
    """Counts how often each voter fires in a text: lexicon entries, then patterns, then the number of words."""

    def __init__(self, lexicon: tuple[bytes, ...]):
        self.index = {key: i for i, key in enumerate(lexicon)}
        self.width = len(lexicon) + len(PATTERNS)
        self.memo: dict[bytes, tuple[int, ...]] = {}

    def fires(self, word: bytes) -> tuple[int, ...]:
        known = self.memo.get(word)
        if known is None:
            known = tuple(self.index[k] for k in keys_of(word) if k in self.index)
            if len(self.memo) >= MEMO_WORDS:
                self.memo.clear()
            self.memo[word] = known
        return known

    def counts(self, text: str) -> np.ndarray:
        found = np.zeros(self.width + 1)
        words = words_of(text)
        for fired in filter(None, map(self.fires, words)):
            for i in fired:
                found[i] += 1
        data = text.encode()
        for i, pattern in enumerate(PATTERNS.values()):
            found[self.width - len(PATTERNS) + i] = sum(1 for _ in pattern.finditer(data))
        found[-1] = len(words)
        return found


@functools.lru_cache(maxsize=4)
def voters(lexicon: tuple[bytes, ...]) -> Voters:
    return Voters(lexicon)


def mine_lexicon(texts: DataFrame) -> tuple[bytes, ...]:
    """All entries that stand out in labelled toxic documents, from (text, label), most telling first.

    An entry qualifies if it occurs in ``LEAST_DOCUMENTS`` toxic documents, if at least ``LEAST_PRECISION`` of its
    documents are toxic, and if so many are less likely than one entry in all by chance. For the last, occurrences
    between the same two words count once: copies of a text say nothing new, and would make all its words stand out.
    A beginning that occurs in the same documents as a longer entry says nothing of its own and is dropped.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def sums() -> Iterator[pa.RecordBatch]:
            keys = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(keys, pa.binary()), *(pa.array([s[k] for k in keys], pa.int64()) for s in seen)]
            yield from pa.table(columns, names=["key", "clean", "toxic"]).to_batches(max_chunksize=50_000)
            seen[0].clear()
            seen[1].clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"], strict=True):
                seen[label.as_py() > 0].update({k for w in set(words_of(text.as_py())) for k in keys_of(w)})
                if len(seen[0]) + len(seen[1]) > MEMO_WORDS:
                    yield from sums()
        yield from sums()

    known = texts.filter(F.col("label").isNotNull())
    share = known.agg(F.avg((F.col("label") > 0).cast("double"))).first()[0] or 0.0
    counted = known.mapInArrow(count, "key binary, clean bigint, toxic bigint").groupBy("key")
    counted = cut(counted.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxic-words")
    tested = counted.filter(F.col("clean") + F.col("toxic") >= LEAST_DOCUMENTS).count()
    precision = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    rows = counted.filter((F.col("toxic") >= LEAST_DOCUMENTS) & (precision >= LEAST_PRECISION) & (precision > share)).collect()
    seen = _surroundings(known, frozenset(bytes(r["key"]) for r in rows))
    found = []
    for r in rows:
        key = bytes(r["key"])
        weight = surprise(*seen.get(key, (0, 0)), share)
        if weight >= math.log(max(tested, 1)):
            found.append((key, r["clean"], r["toxic"], weight))
    return _distinct_entries(found)


def surprise(clean: int, toxic: int, rate: float) -> float:
    """By Chernoff's bound, so many toxic ones have a chance below exp(-surprise) where a share ``rate`` is toxic."""
    n, rate = clean + toxic, min(max(rate, 1e-9), 1 - 1e-9)
    if not n or toxic <= rate * n:
        return 0.0
    return toxic * math.log(toxic / n / rate) + (clean * math.log(clean / n / (1 - rate)) if clean else 0.0)


def _surroundings(known: DataFrame, keys: frozenset[bytes]) -> dict[bytes, tuple[int, int]]:
    """In how many surroundings (the word before and the one after) each key occurs in clean and in toxic documents."""
    shared = known.sparkSession.sparkContext.broadcast(keys)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, memo = shared.value, {}
        for batch in batches:
            found = set()
            for text, label in zip(batch["text"], batch["label"], strict=True):
                words = words_of(text.as_py())
                for i, word in enumerate(words):
                    own = memo.get(word)
                    if own is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        own = memo[word] = [k for k in keys_of(word) if k in wanted]
                    for key in own:
                        around = b" ".join((words[i - 1] if i else b"", words[i + 1] if i + 1 < len(words) else b""))
                        found.add((key, zlib.crc32(around), label.as_py() > 0))
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            kinds = [pa.binary(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["key", "around", "toxic"])

    each = known.select("text", "label").mapInArrow(look, "key binary, around bigint, toxic boolean").distinct()
    counted = each.groupBy("key").agg(F.count_if(~F.col("toxic")).alias("clean"), F.count_if("toxic").alias("toxic"))
    return {bytes(r["key"]): (r["clean"], r["toxic"]) for r in counted.collect()}


def _distinct_entries(entries: list[tuple[bytes, int, int, float]]) -> tuple[bytes, ...]:
    """The entries by weight, without beginnings that a longer entry with the same counts makes superfluous."""
    longer: set[tuple[bytes, int, int]] = set()
    for key, clean, toxic, _ in entries:
        word = key.removeprefix(b"=")
        longer.update((word[:n], clean, toxic) for n in BEGINNINGS if n < len(word) or (key[:1] == b"=" and n <= len(word)))
    kept = [e for e in entries if e[0][:1] == b"=" or (e[0], e[1], e[2]) not in longer]
    return tuple(e[0] for e in sorted(kept, key=lambda e: (-e[3], e[0])))


class LabelModel(NamedTuple):
    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    share: np.ndarray

    def posterior(self, fired: np.ndarray, gold: np.ndarray | None = None) -> np.ndarray:
        """Chance of each row to be toxic by its votes; ``gold`` (1, 0, or -1: none) is one more voter, seldom wrong."""
        hit = np.log(self.toxic) - np.log(self.clean)
        miss = np.log1p(-self.toxic) - np.log1p(-self.clean)
        votes = math.log(self.prior / (1 - self.prior)) + (fired * hit + (1 - fired) * miss) @ self.share
        if gold is not None:
            votes = votes + math.log((1 - GOLD_ERROR) / GOLD_ERROR) * np.where(gold >= 0, 2 * gold - 1, 0)
        return sigmoid(votes)


def correlations(fired: np.ndarray, gold: np.ndarray) -> np.ndarray:
    """How voters correlate beyond what the label explains: within labelled toxic and within labelled clean rows."""
    rest = np.concatenate([fired[gold == y] - fired[gold == y].mean(0) for y in (0, 1) if (gold == y).any()])
    length = np.sqrt((rest**2).sum(0))
    return (rest.T @ rest) / np.maximum(np.outer(length, length), 1e-9)


def fit_labels(fired: np.ndarray, gold: np.ndarray) -> LabelModel:
    """Expectation-maximisation from the labelled rows (``gold`` 0 or 1; -1: unknown), whose labels stay."""
    known = gold >= 0
    share = 1 / np.maximum(1, (correlations(fired, gold) >= SAME).sum(1))
    belief = np.where(known, gold, 0.0).astype(float)
    weight = known.astype(float)
    model = None
    for _ in range(ROUNDS):
        t, c = belief * weight, (1 - belief) * weight
        model = LabelModel(
            float((t.sum() + 1) / (weight.sum() + 2)),
            (t @ fired + 0.5) / (t.sum() + 1.5),
            (c @ fired + 0.5) / (c.sum() + 1.5),
            share,
        )
        belief = np.where(known, gold, model.posterior(fired))
        weight = np.ones(len(gold))
    return model


class Model(NamedTuple):
    lexicon: tuple[bytes, ...]
    #: None: nothing to learn from, every score is 0.
    weights: np.ndarray | None

    def score(self, counts: np.ndarray) -> np.ndarray:
        return np.zeros(len(counts)) if self.weights is None else sigmoid(expand(counts) @ self.weights)


def expand(counts: np.ndarray) -> np.ndarray:
    """Features of the classifier: each voter's count, how many lexicon voters fire at all, how often, and how dense."""
    lexicon = counts[:, : -1 - len(PATTERNS)]
    distinct, total = (lexicon > 0).sum(1), lexicon.sum(1)
    dense = 100 * total / np.maximum(1, counts[:, -1])
    more = [np.log1p(distinct), np.log1p(total), np.log1p(dense), distinct >= 2, total >= 2, np.ones(len(counts))]
    out = np.empty((len(counts), counts.shape[1] - 1 + len(more)), np.float32)
    np.log1p(counts[:, :-1], out=out[:, : -len(more)], casting="same_kind")
    out[:, -len(more) :] = np.column_stack(more)
    return out


def fit_arrays(lexicon: tuple[bytes, ...], counts: np.ndarray, gold: np.ndarray) -> Model:
    if not (gold == 1).any() or not (gold == 0).any():
        return Model(lexicon, None)
    fired = (counts[:, :-1] > 0).astype(np.float32)
    target = fit_labels(fired, gold).posterior(fired, gold)
    x = expand(counts)

    def gradient(w: np.ndarray) -> np.ndarray:
        return x.T @ (sigmoid(x @ w) - target) / len(x) + DECAY * np.append(w[:-1], 0)

    return Model(lexicon, descend(gradient, np.zeros(x.shape[1]), STEPS, RATE))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Model:
    """Fit on at most ``rows`` labelled and ``rows`` unlabelled documents; the driver sees their vote counts only."""
    texts = cut(sample(docs, labels, label, rows), "toxic-sample")
    lexicon = mine_lexicon(texts)
    count = _counts_udf(lexicon)
    table = in_order(texts.select("doc_id", count(F.col("text")).alias("x"), "label").toArrow())
    x = table["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(lexicon) + len(PATTERNS) + 1)
    gold = np.array([-1 if v is None else v for v in table["label"].to_pylist()], int)
    return fit_arrays(lexicon, x, gold)


def _counts_udf(lexicon: tuple[bytes, ...]):  # noqa: ANN202
    @F.arrow_udf("array<float>")
    def count(texts: pa.Array) -> pa.Array:
        own = voters(lexicon)
        counts = [own.counts(t.as_py() or "").astype(np.float32) for t in texts]
        return pa.array(counts, pa.list_(pa.float32()))

    return count


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` (0 to 1, null and empty texts too) and ``predicted`` (1 from ``threshold`` on).

    Rows, repeated ones too, and other columns stay; columns of these names are replaced.
    """

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        own = voters(model.lexicon)
        step = 1_000  # rows whose counts are held at once
        out = []
        for i in range(0, len(texts), step):
            counts = np.array([own.counts(t.as_py() or "") for t in texts[i : i + step]])
            out.append(model.score(counts))
        return pa.array(np.concatenate(out) if out else [], pa.float64())

    return scored(df, run(F.col(text)), threshold)
