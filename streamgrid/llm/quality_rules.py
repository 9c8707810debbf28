"""Quality rules as a short-circuit cascade. DataFrame functions only.

Each rule rejects documents by counts of the whole text. On a bounded sample every rule is run alone: how long it
takes and which share it rejects. The rules are then asked in the order of rejection per cost, and the first that
rejects ends the matter. The order changes the time only, never which documents are kept.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import cut, free_name
from streamgrid.llm.training import few_ids

BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
CAPITALS = r"(?<![\p{L}])\p{Lu}{2,}(?![\p{L}])"
#: Documents that costs and rejections are estimated on at most.
SAMPLE_ROWS = 2_000


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("bigint")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(BLANK))).cast("bigint")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOL)).cast("bigint")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("bigint")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return named(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint")


def n_repeat_words(text: Column) -> Column:
    """Words that lie in a window of three words which occurs twice or more.

    Windows are compared by a 64-bit hash. Equal ones become neighbours by sorting hashes with places, so the cost
    is that of a sort.
    """

    def windows(words: Column) -> Column:
        at = lambda i: F.get(words, i)
        hashes = F.transform(
            F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2))
        )
        return F.when(F.size(words) < 3, F.lit(0)).otherwise(named(hashes, repeats))

    def repeats(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(named(placed, covered))

    def covered(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(placed, k)["h"], F.lit(False))
        twice = F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1))
        begins = F.array_sort(F.transform(twice, lambda x: x["i"]))
        # Windows that overlap cover a word once.
        return F.aggregate(
            begins,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
            lambda s, i: F.struct((i + 3).alias("end"), (s["n"] + i + 3 - F.greatest(s["end"], i)).alias("n")),
            lambda s: s["n"],
        )

    words = F.array_remove(F.split(text, BLANK + "+"), "")
    return named(words, windows).cast("bigint")


def capitals(text: Column) -> Column:
    """Words of two capital letters or more."""
    return F.regexp_count(text, F.lit(CAPITALS)).cast("bigint")


COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines,
    "n_repeat_words": n_repeat_words, "n_lines": n_lines, "capitals": capitals,
}
#: The counts that ``counts`` adds.
SHOWN = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Counted:
    """The counts of a text by name: columns that are there, or else expressions over the text."""

    def __init__(self, text: Column, known: Iterable[str] = ()):
        self.text, self.known = text, frozenset(known)

    def __getitem__(self, name: str) -> Column:
        return F.col(name) if name in self.known else COUNTS[name](self.text)


class Rule(NamedTuple):
    name: str
    #: Whether a document is rejected, from its counts.
    rejects: Callable[[Counted], Column]


def base_failed(words: Column, repeated: Column) -> Column:
    return (words < 50) | (100 * repeated > 50 * words)


RULES = (
    Rule("few_words", lambda c: c["n_words"] < 50),
    Rule("repeated_words", lambda c: 100 * c["n_repeat_words"] > 50 * c["n_words"]),
    Rule("symbols", lambda c: 10 * c["n_symbols"] > 3 * c["n_words"]),
    Rule("capitals", lambda c: 2 * c["capitals"] > c["n_words"]),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"])),
    Rule("repeated_lines", lambda c: 2 * c["n_dup_lines"] > c["n_lines"]),
)


class Measured(NamedTuple):
    rule: Rule
    seconds: float
    rejected: float


def sampled(df: DataFrame, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """(text), one of each of at most ``rows`` documents, the first by a hash of the id; null texts are empty."""
    ids = few_ids(df.filter(F.col("doc_id").isNotNull()).select("doc_id"), rows)
    chosen = df.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return chosen.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")).select("text")


def measure(sample: DataFrame, rules: Sequence[Rule] = RULES, known: Iterable[str] = ()) -> list[Measured]:
    """Cost and rejection of each rule on ``sample`` (text and the ``known`` counts).

    A rule's cost is the time that a job takes with it beyond that of the same job without any rule; of three runs
    the shortest counts, so that neither scheduling nor compiling is taken for work.
    """
    sample = cut(sample, "rule-sample")
    counted = Counted(F.col("text"), known)

    def seconds(value: Column) -> tuple[float, float]:
        best, share = math.inf, None
        for _ in range(3):
            begin = time.perf_counter()
            share = sample.agg(F.avg(value.cast("double")), F.max(F.length("text"))).first()[0]
            best = min(best, time.perf_counter() - begin)
        return best, share or 0.0

    idle = seconds(F.lit(False))[0]
    found = []
    for rule in rules:
        taken, share = seconds(rule.rejects(counted))
        found.append(Measured(rule, max(taken - idle, 1e-4), share))
    return found


def ordered(measured: Sequence[Measured]) -> list[Rule]:
    """Most rejection per cost first; of rules that reject nothing in the sample, the cheapest."""
    return [m.rule for m in sorted(measured, key=lambda m: (-m.rejected / max(m.seconds, 1e-6), m.seconds, m.rule.name))]


def first_rejection(rules: Sequence[Rule], counted: Counted) -> Column:
    """The name of the first rule that rejects, null if none does; later rules are not evaluated."""
    found = None
    for rule in rules:
        found = (F.when if found is None else found.when)(rule.rejects(counted), F.lit(rule.name))
    return F.lit(None).cast("string") if found is None else found


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` of whole texts (null: none)."""
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in SHOWN]
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(*kept, *[COUNTS[c](whole).alias(c) for c in SHOWN])


def cascade(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Add ``kept``: whether no rule rejects the text (null: the empty one). Rows and other columns stay.

    Only the counts that the rules asked so far need are made.
    """
    order = ordered(measure(sampled(df, text, rows), rules)) if len(rules) > 1 else list(rules)
    rejected = first_rejection(order, Counted(F.coalesce(F.col(text), F.lit(""))))
    held = free_name(df.columns, "_kept")
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() != "kept"]
    return df.withColumn(held, rejected.isNull()).select(*rest, F.col(held).alias("kept"))


def judged(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Counts, ``base_failed`` and ``kept``: false where a rule of the cascade or the base rejects.

    The counts that are shown are made once, and all rules are asked over them, most rejection per cost first; what
    further counts a rule needs are made only for documents that no rule before it rejected. A null or empty text has
    no words and fails. Every row stays, repeated ones and rows without an id too; columns of these names are replaced.
    """
    counted = counts(df, text)
    sample = counts(sampled(df, text, rows))
    order = ordered(measure(sample, rules, SHOWN)) if len(rules) > 1 else list(rules)
    verdict = first_rejection(order, Counted(F.coalesce(F.col(text), F.lit("")), SHOWN)).isNull()
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    kept = [F.col(f"`{c}`") for c in counted.columns if c.lower() not in ("base_failed", "kept")]
    return counted.select(*kept, failed.alias("base_failed"), (~failed & verdict).alias("kept"))
