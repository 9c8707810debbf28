"""Secrets, licences and personal data against plain regular expressions."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from conftest import SMALL

from streamgrid.llm import automata, licenses, pii, secret_scan
from streamgrid.llm.queries import QUERIES

KEYWORDS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


def pieces(rng, parts, count, longest):
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(longest))) for _ in range(count)]


def test_one_automaton_finds_what_each_rule_finds():
    parts = ["token", "secret", "PassWord", "passwd", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "12345678", "AKIA",
             "ABCD1234", "0" * 8, "deadbeef", "é", ".", "-", "/", "😀", "ſ", "ghp_", "x" * 36]
    scanner = secret_scan.scanner(secret_scan.RULES)
    for text in pieces(random.Random(3), parts, 5000, 30):
        assert [x for x in scanner.scan(text) if x[1] < 3] == secrets(text)
    assert [x[1] for x in scanner.scan("ghp_" + "z" * 36 + " -----BEGIN RSA PRIVATE KEY-----")] == [3, 8]


@pytest.mark.parametrize("pattern", ["a(b|c)*d", "[a-c]{2,4}x?", "(ab|a)(c|bcd)", "a+b{3}", "[^a]b", "(a|b)?c"])
def test_automata_agree_with_regular_expressions(pattern):
    forward = automata.Automaton([automata.parse(pattern)], anywhere=False)
    wanted = re.compile(pattern.encode())
    for text in pieces(random.Random(1), list("abcdx"), 2000, 9):
        state, data = 0, text.encode()
        for byte in data:
            state = forward.moves[state + byte]
        assert (state >= forward.first_accept) == bool(wanted.fullmatch(data))


def base_words(text):
    lower = text.translate({i: i + 32 for i in range(65, 91)})
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    starts, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_phrases_at_all_places():
    finder = licenses.Finder(licenses.BASE_PHRASES, licenses.PHRASES)
    parts = ["gnu ", "general-", "public ", "license ", "apache\n", "mit.", "cc ", "by ", "É", "CC ", "MIT "]
    for text in pieces(random.Random(2), parts, 5000, 30):
        assert finder.find(text)[:5] == base_words(text)


@pytest.mark.parametrize(
    ("expression", "identifiers", "asks"),
    [
        ("MIT", ["mit"], 1),
        ("MIT OR GPL-2.0-only", ["mit", "gpl-2.0-only"], 1),
        ("(MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0", ["mit", "apache-2.0", "gpl-3.0-only"], 2),
        ("GPL-2.0-only OR MIT AND BSD-3-Clause */", ["gpl-2.0-only", "mit", "bsd-3-clause"], 1),
    ],
)
def test_expressions(expression, identifiers, asks):
    assert licenses.evaluate(expression) == (identifiers, asks)


@pytest.mark.parametrize("broken", ["", "MIT OR", "(MIT", "AND MIT", "()"])
def test_broken_expressions(broken):
    assert licenses.evaluate(broken) is None


def luhn(digits):
    doubled = [int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def personal(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ips = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
    out += [("ip", *m.span()) for m in ips if all(int(p) <= 255 for p in m[0].split("."))]
    cards = re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
    out += [("card", *m.span()) for m in cards if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    phones = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
    return out + [("phone", *m.span()) for m in phones if 9 <= len(digits(m[0])) <= 15]


def test_personal_data_as_the_patterns_say(spark):
    parts = ["a@b.com", "x_y", "@", ".", "com", "+1", "(017)", " ", " ", "555-7713", "4111111111111111", "4111 1111", "-", "10.0.0.1",
             "256", "1.2.3", "5", "é", "😀", "+49 30", "0000000000000000", "mail: "]
    texts = pieces(random.Random(4), parts, 1500, 14)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    for row in pii.find_personal(df).collect():
        want = personal(texts[row["doc_id"]])
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (texts[row["doc_id"]], want, row["spans"])
        assert row["n_email"] == sum(k == "email" for k, _, _ in want)
        assert not want or set(joined.split(",")) <= set(row["spans"].split(","))


def test_long_runs_stay_linear(spark):
    texts = ["a" * 100_000, "1" * 100_000, "a." * 50_000, "1." * 40_000, "+1" + " " * 100_000, "a@" * 20_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert pii.find_personal(df).count() == len(texts)


def test_votes_teach_the_classifier():
    counted = [("iban", (1, 1, 1, 1, 0), 500), ("iban", (-1, -1, -1, -1, 0), 400), ("iban", (1, -1, 0, -1, 0), 20)]
    model = pii.fit_counts(counted)
    score = lambda votes: model.kinds["iban"] + sum(w * v for w, v in zip(model.votes, votes, strict=True))
    assert score((1, 1, 1, 1, 0)) > 0 > score((-1, -1, -1, -1, 0))
    assert all(0.5 < r < 1 for r in model.reliability)
    assert pii.fit_counts([]) == pii.DEFAULT


def test_redaction(spark):
    text = "Write to a.b@c.de from 1.2.3.4 please, not 1.2.3.400."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id bigint, text string")
    assert [r["text"] for r in pii.redact(df).orderBy("doc_id").collect()] == [
        "Write to <EMAIL> from <IP> please, not 1.2.3.400.", None, "",
    ]


def test_odd_rows(odd, nothing):
    n = odd.count()
    for scan in (secret_scan.secret_digest, secret_scan.find_secrets, licenses.find_licenses, pii.find_personal, pii.redact):
        assert scan(odd).count() == n
        assert scan(nothing).count() == 0
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.secret_digest(odd).collect()}
    assert spans[11] == "assign:0:22,access:24:44" and spans[0] == ""
    assert pii.redact(odd).columns == odd.columns


def test_queries(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for row in QUERIES["op3_secrets"](spark, SMALL).collect():
        kinds = ["assign", "access", "hex"]
        want = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in secrets(texts[row["doc_id"]]))
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    for row in QUERIES["op5_licenses"](spark, SMALL).collect():
        assert tuple(row)[1:6] == base_words(texts[row["doc_id"]])
    for row in QUERIES["op9_pii"](spark, SMALL).collect():
        want = ",".join(f"{k}:{s}:{e}" for k, s, e in personal(texts[row["doc_id"]]))
        assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
