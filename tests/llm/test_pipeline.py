"""Every stage of the pipeline on its own input, against plain versions, and on odd tables."""

from __future__ import annotations

import collections
import re

import pytest
import tokenizers
from conftest import SMALL
from llm.conftest import ODD_TEXTS
from pyspark.sql import functions as F

import corpus_pipeline
from streamgrid.llm import mixing, neardup, pii, quality_model
from streamgrid.llm.common import DOCUMENTS
from streamgrid.llm.queries import VOCABULARY

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture
def odd_documents(spark):
    texts = [*ODD_TEXTS, "An ordinary text of some words that nobody else has written so far, one would think."]
    rows = [(i, t, "en", "src" if i % 2 else None, 0) for i, t in enumerate(texts)]
    rows += [(3, ODD_TEXTS[3], "en", "src", 0), (None, "some text without an id", None, None, None), (None, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    return spark.createDataFrame(rows, schema).selectExpr(*DOCUMENTS, "'x' AS size", "1 AS score", "2 AS spans", "3 AS n_tokens", "4 AS raw")


def rows_of(df):
    return collections.Counter(tuple(r[c] for c in DOCUMENTS) for r in df.collect())


def test_quality_keeps_what_its_model_takes_for_good(spark, docs):
    model = quality_model.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    wanted = rows_of(docs.filter(F.col("doc_id").isin([r["doc_id"] for r in quality_model.score(docs, model).collect() if r["score"] >= 0.3])))
    assert rows_of(STAGES["quality"](spark, docs, SMALL)) == wanted and sum(wanted.values()) > 100


def test_near_copies_keeps_the_smallest_of_each_class(spark, docs):
    held = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(neardup.shingles(t)[0].tolist()) for i, t in held.items()}
    root = {i: i for i in held}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(held)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if held[i] == held[j] or (a and b and len(a & b) >= 0.8 * len(a | b)):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    kept = {r["doc_id"] for r in STAGES["near_copies"](spark, docs, SMALL).collect()}
    assert kept == {find(i) for i in ids}


def test_personal_data_is_replaced_in_place(spark, docs):
    spans = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs).collect()}
    plain = {r["doc_id"]: r for r in docs.collect()}
    changed = 0
    for r in STAGES["personal_data"](spark, docs, SMALL).collect():
        text, out, at = plain[r["doc_id"]]["text"], "", 0
        found = [s.split(":") for s in spans[r["doc_id"]].split(",") if s]
        for kind, start, end in sorted(found, key=lambda s: (int(s[1]), int(s[2]), s[0])):
            if int(start) >= at:
                out += text[at : int(start)] + f"<{kind.upper()}>"
            at = max(at, int(end))
        assert r["text"] == out + text[at:] and r["n_chars"] == len(r["text"])
        changed += r["text"] != text
    assert changed


def test_mixture_takes_what_the_plan_says(spark, docs):
    times = {r["doc_id"]: len(r["shards"]) for r in mixing.plan(docs).collect()}
    wanted = collections.Counter({k: times[k[0]] for k in rows_of(docs)})
    assert rows_of(STAGES["mixture"](spark, docs, SMALL)) == +wanted


def test_tokens_are_those_of_the_library(spark, docs):
    library = tokenizers.Tokenizer.from_file(str(VOCABULARY))
    library.no_truncation()
    library.no_padding()
    for r in STAGES["tokens"](spark, docs, SMALL).collect():
        assert r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids)


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_take_odd_and_empty_tables(spark, odd_documents, name):
    found = STAGES[name](spark, odd_documents, SMALL)
    assert found.columns[: len(DOCUMENTS)] == DOCUMENTS
    rows = rows_of(found)
    given = rows_of(odd_documents)
    if name in ("tokens", "personal_data"):
        assert sum(rows.values()) == sum(given.values())
        assert collections.Counter(r[0] for r in rows.elements()) == collections.Counter(r[0] for r in given.elements())
    else:
        assert set(rows) <= set(given)
    if name == "near_copies":
        assert rows[next(r for r in given if r[0] == 3)] == 1
    if name == "mixture":
        assert all(re.search(r"[^\x20\x09-\x0D]", r[1] or "") for r in rows)
    assert STAGES[name](spark, odd_documents.limit(0), SMALL).count() == 0
