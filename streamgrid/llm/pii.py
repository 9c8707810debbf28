"""Personal data by weak supervision. DataFrame functions only.

Candidate spans come from patterns. Labelers vote on each: the pattern's own check, gazetteers of beginnings and
endings, cue words before it, its neighbours, and its digits. The votes of all documents are counted by pattern of
votes; from these counts expectation-maximisation estimates the reliability of every labeler, and a span classifier
is trained on the posterior labels. Spans of the base kinds that pass their check always stay; candidates of the
further kinds stay if the classifier takes them and no base span overlaps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import cut, free_name

#: Code points before a candidate in which cue words are looked for.
CONTEXT = 40
ROUNDS = 40
STEPS = 300
RATE = 0.5
DECAY = 1e-3

# Cue words, first names and titles, codes and prefixes.
CUES = {
    "email": "mail|contact|write|reach", "ip": "ip|host|server|address|client", "card": "card|visa|payment|credit|karte",
    "phone": "phone|tel|call|mobile|fax|contact", "national": "phone|tel|call|mobile|fax|contact",
    "ssn": "ssn|social|security", "iban": "iban|account|bank|konto", "person": "name|author|by|from|patient|contact",
}
COUNTER_CUES = "version|order|isbn|page|build|release|serial|part|sku|license"
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
FIRST_NAMES = (
    "James|Mary|John|Anna|Peter|Maria|Michael|Sarah|David|Laura|Thomas|Julia|Robert|Emma|Daniel|Sofia|Paul|Marie|"
    "Hans|Greta|Pierre|Claire|Carlos|Lucia|Jose|Carmen|Jean|Sophie|Klaus|Petra"
)
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at"
CARD_BEGINNINGS = r"4|5[1-5]|2[2-7]|3[47]|6011|65|35"
IBAN_COUNTRIES = "DE|FR|ES|IT|NL|GB|CH|AT|BE|PT|PL|SE|DK|NO|FI|IE|LU"


class Kind(NamedTuple):
    name: str
    pattern: str
    #: Whether a match stands, for its text.
    check: Callable[[Column], Column]
    #: What the gazetteer says of a match: 1, 0 or -1.
    gazetteer: Callable[[Column], Column]
    base: bool = False
    #: A sign that every match contains, looked for first.
    sign: str = ""


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _octets(match: Column) -> Column:
    small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3  # noqa: E731  long digit strings are never cast
    value = lambda p: F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")).otherwise(999)
    return F.forall(F.split(match, "[.]"), lambda p: value(p) <= 255)


def _luhn(match: Column) -> Column:
    """Every second digit from the right is doubled, and the digits of all sum to a multiple of ten."""
    turned = F.reverse(_digits(match))
    digit = lambda i: F.substring(turned, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(
        F.sequence(F.lit(1), F.length(turned)),
        F.lit(0),
        lambda s, i: s + F.when(i % 2 == 0, doubled(digit(i))).otherwise(digit(i)),
    )
    return total % 10 == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    yes = F.coalesce(yes, F.lit(False))
    return F.when(yes, F.lit(1)).when(F.lit(True) if no is None else no, F.lit(-1)).otherwise(F.lit(0))


_LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    # A match begins where a run does or the last match ended; possessive runs never back up. Both keep the scan
    # linear and leave the leftmost matches that do not overlap as they are.
    Kind(
        "email", rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda m: F.lit(True), lambda m: _vote(m.rlike(rf"(?i)\.(?:{ENDINGS})$")), True, "@",
    ),
    Kind(
        "ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        _octets, lambda m: _vote(~m.rlike(r"^(?:0|127|255)\."), m.rlike(r"^(?:0|127|255)\.")), True, ".",
    ),
    # Runs of digits with single separators are whole runs, so the bounds on their digits may stand in the pattern.
    Kind(
        "card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
        _luhn, lambda m: _vote(m.rlike(f"^(?:{CARD_BEGINNINGS})")), True,
    ),
    Kind(
        "phone", r"\+[0-9][\x20().0-9-]+[0-9]",
        lambda m: F.length(_digits(m)).between(9, 15), lambda m: _vote(m.rlike(r"^\+[1-9]")), True, "+",
    ),
    Kind(
        "national", r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
        lambda m: ~m.rlike(r"^\(?[01]"), lambda m: F.lit(0),
    ),
    Kind(
        "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        lambda m: ~m.rlike(r"^(?:000|666|9)"), lambda m: F.lit(0), False, "-",
    ),
    Kind(
        "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34),
        lambda m: _vote(m.rlike(f"^(?:{IBAN_COUNTRIES})")),
    ),
    Kind(
        "person", rf"(?<!\p{{L}})(?:{TITLES})\.?\x20\p{{Lu}}\p{{Ll}}+(?:\x20\p{{Lu}}\p{{Ll}}+)?",
        lambda m: F.lit(True), lambda m: _vote(m.rlike(rf"\x20(?:{FIRST_NAMES})(?:\x20|$)"), F.lit(False)),
    ),
)
LABELERS = ("check", "gazetteer", "cues", "neighbours", "digits")
BASE = [k.name for k in KINDS if k.base]


def _found(text: Column, kind: Kind) -> Column:
    """Matches of one kind as (start, end, match), from the parts between them, in code points."""

    def places(matches: Column) -> Column:
        between = F.split(text, kind.pattern, -1)
        begin = F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,match:string>>").alias("got")
        )

        def step(s: Column, m: Column) -> Column:
            start = s["at"] + F.length(m["gap"])
            end = start + F.length(m["match"])
            span = F.struct(start.alias("start"), end.alias("end"), m["match"].alias("match"))
            return F.struct(end.alias("at"), F.concat(s["got"], F.array(span)).alias("got"))

        pairs = F.zip_with(matches, F.slice(between, 1, F.size(matches)), lambda m, g: F.struct(m.alias("match"), g.alias("gap")))
        return F.when(F.size(matches) > 0, F.aggregate(pairs, begin, step, lambda s: s["got"]))

    matches = F.regexp_extract_all(text, F.lit(kind.pattern), 0)
    if kind.sign:
        matches = F.when(F.contains(text, F.lit(kind.sign)), matches)
    return F.element_at(F.transform(F.array(matches), places), 1)


def _votes(text: Column, kind: Kind, span: Column) -> list[Column]:
    match = span["match"]
    before = F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT)))
    sides = F.concat(
        F.when(span["start"] > 0, F.substring(text, span["start"], F.lit(1))).otherwise(F.lit(" ")),
        F.substring(text, span["end"] + 1, F.lit(1)),
    )
    counter = before.rlike(rf"(?i)(?<!\p{{L}})(?:{COUNTER_CUES})(?!\p{{L}})")
    return [
        _vote(kind.check(match)),
        kind.gazetteer(match),
        _vote(before.rlike(rf"(?i)(?<!\p{{L}})(?:{CUES[kind.name]})"), counter),
        _vote(~sides.rlike(r"[\p{L}\p{N}_]")),
        _vote(F.lit(False), _digits(match).rlike(r"^([0-9])\1{7,}$|^0{4}")),
    ]


def candidates(df: DataFrame, text: str = "text", out: str = "candidates") -> DataFrame:
    """Add ``out``: every candidate as (kind, start, end, votes), ordered by kind as listed, then start.

    A null or empty text has none. Rows, repeated ones too, and other columns stay; a column named ``out`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def of(kind: Kind) -> Column:
        def row(span: Column) -> Column:
            votes = F.array(*[v.cast("tinyint") for v in _votes(whole, kind, span)])
            return F.struct(F.lit(kind.name).alias("kind"), span["start"].alias("start"), span["end"].alias("end"), votes.alias("votes"))

        empty = F.array().cast("array<struct<kind:string,start:int,end:int,votes:array<tinyint>>>")
        return F.coalesce(F.transform(_found(whole, kind), row), empty)

    return df.withColumn(out, F.concat(*map(of, KINDS)))


class Model(NamedTuple):
    """Weights of the span classifier: of each kind, and of each labeler."""

    kinds: dict[str, float]
    votes: tuple[float, ...]
    reliability: tuple[float, ...]

    def score(self, kind: Column, votes: Column) -> Column:
        total = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in self.kinds.items() for x in p]), kind), F.lit(0.0))
        for i, w in enumerate(self.votes):
            total = total + F.lit(w) * F.get(votes, F.lit(i))
        return total


DEFAULT = Model({k.name: 0.0 for k in KINDS}, (1.5, 0.5, 0.8, 0.5, 0.5), (0.9, 0.7, 0.8, 0.7, 0.7))


def fit_counts(counted: Sequence[tuple[str, Sequence[int], int]]) -> Model:
    """The model from (kind, votes, number) of each pattern of votes; at most kinds times 3 to the labelers of them."""
    if not counted:
        return DEFAULT
    reliable = list(DEFAULT.reliability)
    prior = {k: 0.7 for k, _, _ in counted}

    def belief(kind: str, votes: Sequence[int]) -> float:
        z = math.log(prior[kind] / (1 - prior[kind]))
        z += sum(v * math.log(r / (1 - r)) for v, r in zip(votes, reliable, strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    beliefs: list[float] = []
    for _ in range(ROUNDS):
        beliefs = [belief(k, v) for k, v, _ in counted]
        for kind in prior:
            own = [(b, n) for b, (k, _, n) in zip(beliefs, counted, strict=True) if k == kind]
            prior[kind] = min(0.99, (sum(b * n for b, n in own) + 1.4) / (sum(n for _, n in own) + 2))
        for j in range(len(reliable)):
            right = sum(n * (b if v[j] > 0 else 1 - b) for b, (_, v, n) in zip(beliefs, counted, strict=True) if v[j])
            asked = sum(n for _, v, n in counted if v[j])
            # A labeler is taken to be better than chance, and never perfect.
            reliable[j] = min(0.98, max(0.55, (right + 8 * DEFAULT.reliability[j]) / (asked + 8)))
    kinds, weights = dict.fromkeys(prior, 0.0), [0.0] * len(LABELERS)
    total = sum(n for _, _, n in counted)
    for _ in range(STEPS):
        by_kind, by_vote = dict.fromkeys(prior, 0.0), [0.0] * len(weights)
        for b, (k, v, n) in zip(beliefs, counted, strict=True):
            z = kinds[k] + sum(w * x for w, x in zip(weights, v, strict=True))
            off = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - b) * n / total
            by_kind[k] += off
            by_vote = [g + off * x for g, x in zip(by_vote, v, strict=True)]
        kinds = {k: w - RATE * (by_kind[k] + DECAY * w) for k, w in kinds.items()}
        weights = [w - RATE * (g + DECAY * w) for w, g in zip(weights, by_vote, strict=True)]
    return Model({k.name: kinds.get(k.name, 0.0) for k in KINDS}, tuple(weights), tuple(reliable))


def fit(found: DataFrame, column: str = "candidates") -> Model:
    """Fit on the candidates of all documents; the driver sees the count of each pattern of votes."""
    each = found.select(F.explode(column).alias("c")).groupBy("c.kind", "c.votes").count()
    rows = [(r["kind"], list(r["votes"]), r["count"]) for r in each.collect()]
    return fit_counts(sorted(rows))


def kept_spans(model: Model, column: Column) -> Column:
    """(kind, start, end) of the candidates that stay, ordered by kind as listed, then start."""
    is_base = lambda c: c["kind"].isin(*BASE)
    passes = lambda c: F.get(c["votes"], F.lit(0)) > 0

    def chosen(base: Column) -> Column:
        more = F.filter(
            column,
            lambda c: ~is_base(c)
            & (model.score(c["kind"], c["votes"]) >= 0)
            & ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])),
        )
        return F.transform(F.concat(base, more), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))

    return F.element_at(F.transform(F.array(F.filter(column, lambda c: is_base(c) & passes(c))), chosen), 1)


def joined(spans: Column) -> Column:
    as_text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, as_text), ",")


def digest(found: DataFrame, model: Model, column: str = "candidates") -> DataFrame:
    """doc_id with the counts of the base kinds, ``base_sha256`` over their spans, and ``spans`` over all."""
    rows = found.select("doc_id", kept_spans(model, F.col(column)).alias("s"))

    def number(kind: str) -> Column:
        return F.size(F.filter("s", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = joined(F.filter("s", lambda s: s["kind"].isin(*BASE)))
    return rows.select("doc_id", *map(number, BASE), F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))


def find_personal(df: DataFrame, text: str = "text") -> DataFrame:
    """``digest`` of the texts of ``df``, null and empty ones without spans; repeated rows give repeated rows."""
    found = cut(candidates(df.select("doc_id", F.col(text).alias("text"))).select("doc_id", "candidates"), "pii")
    return digest(found, fit(found))


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span that stays replaced by its kind in angle brackets; spans that overlap become one.

    A null text stays null. All rows and columns stay.
    """
    held = free_name(df.columns, "_candidates")
    # Written once with the texts: the model is fitted on the candidates, and the texts are rebuilt from the same.
    found = cut(candidates(df, text, held), "pii-candidates")
    model = fit(found, held)
    spans = free_name(found.columns, "_spans")
    marked = found.withColumn(spans, kept_spans(model, F.col(held)))
    whole = F.col(text)

    def step(s: Column, span: Column) -> Column:
        new = F.concat(
            s["out"], F.substring(whole, s["at"] + 1, span["start"] - s["at"]), F.lit("<"), F.upper(span["kind"]), F.lit(">")
        )
        return F.struct(
            F.greatest(s["at"], span["end"]).alias("at"),
            F.when(span["start"] >= s["at"], new).otherwise(s["out"]).alias("out"),
        )

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate(
        by_place, begin, step, lambda s: F.concat(s["out"], F.substring(whole, s["at"] + 1, F.length(whole)))
    )
    return marked.withColumn(text, F.when(F.size(spans) > 0, rebuilt).otherwise(whole)).select(*[F.col(f"`{c}`") for c in df.columns])
