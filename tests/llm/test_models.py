"""Classifiers by held-out accuracy, and the label and risk models on planted data."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from conftest import SMALL

from streamgrid.llm import quality_model, style, toxicity
from streamgrid.llm.queries import QUERIES

TABLES = SMALL.replace("0.001", "0.01")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op7_quality_model", "quality", 0.95), ("op10_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, least):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{TABLES}/labels.parquet").collect()}
    rows = QUERIES[name](spark, TABLES).collect()
    assert len(rows) == spark.read.parquet(f"{TABLES}/documents.parquet").count()
    assert all(r["held_out"] == held_out(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    known = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in known]) >= least
    again = {r["doc_id"]: r["score"] for r in QUERIES[name](spark, TABLES).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)


def test_labels_of_held_out_documents_are_not_learned_from(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality")
    a, b = quality_model.fit(docs, labels), quality_model.fit(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.prior == b.prior


def test_risk_finds_the_negatives_among_the_unlabelled():
    rng = np.random.default_rng(0)
    width = len(style.NAMES)
    good, bad = rng.normal(0, 1, (900, width)), rng.normal(0, 1, (300, width)) + 3 * (np.arange(width) < 4)
    labelled = np.concatenate([good[:300], bad[:100]])
    model = quality_model.fit_arrays(labelled, np.repeat([1, 0], [300, 100]), np.concatenate([good[300:], bad[100:]]))
    assert model.score(good).mean() > 0.8 and model.score(bad).mean() < 0.2


@pytest.mark.parametrize("prior", [0.15, 0.4, 0.7, 0.9])
def test_prior_is_found_without_negatives(prior):
    rng = np.random.default_rng(int(100 * prior))
    width = 12
    shift = 2.5 * (np.arange(width) < 4)
    good = rng.normal(0, 1, (1500, width))
    many = rng.random(3000) < prior
    web = rng.normal(0, 1, (3000, width)) + np.where(many[:, None], 0, shift)
    ones = lambda x: np.column_stack([x, np.ones(len(x))])
    assert abs(quality_model.class_prior(ones(good), ones(web)) - prior) < 0.08


def test_entries_without_own_documents_are_dropped():
    entries = [(b"=awful", 0, 9, 5.0), (b"awfu", 0, 9, 5.0), (b"awful", 0, 12, 6.0), (b"grue", 1, 8, 4.0), (b"grueso", 1, 8, 4.0)]
    assert toxicity._distinct_entries(entries) == (b"awful", b"=awful", b"grueso")


def test_lexicon_has_all_that_stands_out(spark):
    rng = np.random.default_rng(4)
    bad = [f"badword{chr(97 + i // 26)}{chr(97 + i % 26)}x" for i in range(150)]
    rows = []
    for i in range(4000):
        label = int(i % 5 == 0)
        words = [f"w{chr(97 + j % 26)}{chr(97 + j // 26 % 26)}" for j in rng.integers(0, 600, 20)]
        rows.append((i, " ".join(words + ([bad[j] for j in rng.integers(0, 150, 4)] if label else [])), label))
    lexicon = set(toxicity.mine_lexicon(spark.createDataFrame(rows, "doc_id int, text string, label int")))
    assert sum(b"=" + b.encode() in lexicon for b in bad) > 145
    assert sum(not k.lstrip(b"=").startswith(b"badw") for k in lexicon) <= 3


def test_voters_that_fire_together_share_a_vote():
    rng = np.random.default_rng(1)
    gold = (rng.random(2000) < 0.3).astype(int)
    one = (rng.random(2000) < np.where(gold, 0.7, 0.05)).astype(float)
    other = (rng.random(2000) < np.where(gold, 0.7, 0.05)).astype(float)
    fired = np.column_stack([one, one, one, other])
    model = toxicity.fit_labels(fired, np.where(np.arange(2000) < 1000, gold, -1))
    assert np.allclose(model.share, [1 / 3, 1 / 3, 1 / 3, 1])
    assert abs(model.toxic[3] - 0.7) < 0.1 and abs(model.clean[3] - 0.05) < 0.05
    assert ((model.posterior(fired) > 0.5) == gold).mean() > 0.85


def test_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, 0, 1), (None, 1, 1), (6, None, None)], "doc_id bigint, quality int, toxic int")
    for module in (quality_model, toxicity):
        for table in (labels, labels.limit(0)):
            rows = module.score(odd, module.fit(odd, table)).collect()
            assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert module.score(nothing, module.fit(nothing, labels)).count() == 0
