"""Ranked lexical search against its SQL and plain scores."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import oracle
import pytest
from conftest import SMALL
from llm.conftest import ODD_TEXTS

from streamgrid.llm import ball_search
from streamgrid.llm.queries import QUERIES, SQL


def test_search_query(spark):
    found = QUERIES["op11_ball_search"](spark, SMALL)
    assert oracle.differences(found, oracle.connect(SMALL), SQL["op11_ball_search"]) is None


def plain(docs, items, k):
    counted = [(d, ball_search.terms(t)) for d, t in docs]
    held = [(d, c) for d, c in counted if c]
    n_docs, everything = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for doc, c in held:
            m = 75 + 25 * c.total() * n_docs // everything
            score = sum(
                r * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, r in ball_search.terms(text).items() if t in c
            )
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, i + 1, None if none else doc, -s) for i, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def random_texts(rng, count):
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(600)] + ["É", "éa", "A1", "a1", "x-y"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("at_once", [3, 100])
def test_search_of_odd_tables(spark, at_once):
    rng = random.Random(at_once)
    texts = random_texts(rng, 300)
    texts += texts[:40] * 3 + [None, ""] + ODD_TEXTS
    docs = [(rng.choice([i, i, i, None, 5]), t) for i, t in enumerate(texts)]
    items = [(i if i != 2 else None, " ".join([t, t[:9]])) for i, t in enumerate(texts[3:10])] + [(9, None), (3, "w1 W1 É é nowhere")]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, score int, item_id string")
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id bigint, text string, rank int")
    found = sorted((tuple(r) for r in ball_search.search(df, asked, 7, at_once=at_once).collect()), key=repr)
    assert found == plain(docs, items, 7)
    for d, i in ((df.limit(0), asked), (df, asked.limit(0)), (df.limit(0), asked.limit(0))):
        assert ball_search.search(d, i, 7).count() == 0


class _Fixed:
    """Statistics given by hand."""

    def __init__(self, weights):
        self.docs, self.all, self.weights = 10, 100, weights

    def damping(self, n):
        return 75 + n


def test_bounds_are_never_too_low_and_prune():
    rng = np.random.default_rng(3)
    for _ in range(30):
        width, count = 40, 200
        families = rng.random((5, width)) < 0.3
        dense = np.where(families[rng.integers(0, 5, count)], rng.integers(1, 4, (count, width)), 0) * (rng.random((count, width)) < 0.95)
        dense[:, 0] += 1
        items = ball_search.Items([(0, "a b"), (1, "c")])
        items.numbers = {str(i): i for i in range(width)}
        asked = np.flatnonzero(families[0])
        items.ids, items.terms, items.counts = [0], [asked], [np.ones(len(asked), np.int64)]
        searcher = ball_search.Searcher(items, _Fixed(rng.integers(0, 9000, width)), 5)
        doc, term = np.nonzero(dense)
        sizes = np.bincount(doc, minlength=count)
        searcher.block(list(range(count)), sizes.tolist(), sizes, term, dense[doc, term])
        damping = 75 + sizes
        value = 10**9 * dense // (1000 * dense + 12 * damping[:, None])
        scores = (value * searcher.stats.weights)[:, asked].sum(axis=1)
        best = sorted(range(count), key=lambda i: (-scores[i], i))[:5]
        assert [(-s, d) for s, _, d in searcher.best[0]] == [(scores[i], i) for i in best]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        held = value[doc, term]
        rows = ball_search.Rows(begins, term, held * searcher.stats.weights[term], held * searcher.roots[term])
        tree = ball_search.BallTree(rows, width, leaf=4)
        bounds = tree.bounds(asked, searcher.shares[0])
        for (low, high), bound in zip(tree.nodes, bounds, strict=True):
            assert bound >= scores[tree.order[low:high]].max()


def test_subtrees_are_pruned():
    rng = random.Random(1)
    texts = [f"{i % 9} alpha{i % 9} beta{i % 9} gamma{i % 9}" for i in range(2000)]
    items = ball_search.Items([(0, "alpha3 beta3 gamma3")])
    searcher = ball_search.Searcher(items, _Fixed(np.full(3, 5000)), 20)
    rows = [(i, ball_search.terms(t)) for i, t in enumerate(texts) if any(w in items.numbers for w in ball_search.terms(t))]
    extra = [(5000 + i, ball_search.terms(rng.choice(["alpha3", "beta3", "gamma3"]) + " filler" * 30)) for i in range(4000)]
    rows += extra
    known = [sorted((items.numbers[w], k) for w, k in c.items() if w in items.numbers) for _, c in rows]
    sizes = np.array([len(k) for k in known])
    flat = np.array([x for k in known for x in k])
    searcher.block([i for i, _ in rows], [c.total() for _, c in rows], sizes, flat[:, 0], flat[:, 1])
    assert [d for _, _, d in searcher.best[0]] == [i for i, _ in rows if i < 5000][:20]
    assert searcher.visited < 20
