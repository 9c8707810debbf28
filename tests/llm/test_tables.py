"""Near duplicates, neighbours, mixing and quality rules."""

from __future__ import annotations

import collections
import random

import numpy as np
import oracle
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from streamgrid.llm import mixing, neardup, neighbours, quality_rules
from streamgrid.llm.queries import QUERIES, SQL

TABLES = SMALL.replace("0.001", "0.01")


# --- near duplicates ---


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def shingle_set(text):
    return set(neardup.shingles(text)[0].tolist())


def classes_by_force(texts):
    """The smallest id of each component of the pairs with the same words or a similarity of 0.8."""
    sets = {i: shingle_set(t or "") for i, t in texts.items()}
    same = {i: neardup.text_id(t or "") for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if same[a] == same[b] or (sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in ids}


def test_shingles_are_five_words():
    words = "the quick brown fox jumps over the lazy dog again and again".split()
    a, b = " ".join(words), ", ".join(words).upper()
    assert neardup.text_id(a) == neardup.text_id(b) and shingle_set(a) == shingle_set(b)
    assert len(shingle_set(a)) == len(words) - 4
    assert len(shingle_set("one two")) == 1 and not shingle_set("!!") and not shingle_set("")
    assert neardup.text_id("!!") != neardup.text_id("??")


@pytest.mark.parametrize("size", [3, 40, 2000])
def test_signatures_agree_as_often_as_the_sets_are_alike(size):
    rng = np.random.default_rng(size)
    off = []
    for _ in range(40):
        h = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        w = rng.integers(1, 5, size).astype(float)
        v = np.where(rng.random(size) < 0.6, w, rng.integers(1, 5, size))
        kept = neardup.signatures([(h, w), (h, v)])
        off.append((kept[0] == kept[1]).mean() - np.minimum(w, v).sum() / np.maximum(w, v).sum())
    assert abs(np.mean(off)) < 0.03 and np.std(off) < 0.06


def test_classes_as_by_force(spark):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = classes_by_force({r["doc_id"]: r["text"] for r in rows})
    found = {r["doc_id"]: r["class_id"] for r in QUERIES["op6_neardup"](spark, SMALL).collect()}
    assert found == want


def test_planted_copies_and_chains(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    base = [rng.choice(words) for _ in range(300)]
    texts = {0: " ".join(base)}
    for i in range(1, 60):  # near copies of one text, each with one other word
        changed = list(base)
        changed[rng.randrange(300)] = f"x{i}"
        texts[i] = " ".join(changed)
    for i in range(60, 90):
        texts[i] = texts[i % 7]
    for i in range(90, 130):
        texts[i] = " ".join(rng.choice(words) for _ in range(200))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df).collect()}
    assert found == classes_by_force(texts)
    assert sorted(r["doc_id"] for r in neardup.keep_one(df).collect()) == [0, *range(90, 130)]


def template_family(members, seed=3):
    """Texts of one template, alike by 0.77, of which every second is alike by 0.82 to the one before."""
    rng = random.Random(seed)
    template = [f"t{rng.randrange(10**6)}" for _ in range(400)]
    texts, tail = {}, []
    for i in range(members):
        fresh = [f"u{i}x{j}" for j in range(60)]
        tail = fresh if i % 2 == 0 else tail[:16] + fresh[16:]
        texts[i] = " ".join(template + tail)
    return texts


@pytest.mark.parametrize("weighted", [False, True])
def test_pairs_inside_a_family_below_the_similarity(spark, weighted):
    texts = template_family(300)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    assert all(0.75 < jaccard(sets[0], sets[i]) < 0.79 for i in range(2, 300))
    assert all(0.8 < jaccard(sets[i], sets[i + 1]) < 0.84 for i in range(0, 300, 2))
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r["class_id"] for r in neardup.near_duplicates(df, weighted=weighted).collect()}
    assert found == {i: i - i % 2 for i in texts}


@pytest.mark.parametrize("least", [0.5, 0.8, 0.93])
def test_sets_that_are_alike_share_a_rare_element(least):
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = set(rng.choice(1000, n, replace=False).tolist())
        b = {x for x in a if rng.random() < rng.uniform(least, 1)} | set(range(2000, 2000 + int(rng.integers(0, n // 8 + 2))))
        if jaccard(a, b) < least:
            continue
        looked = [{(min(o, p), max(o, p), x) for o, p, m in neardup.prefixes(len(s), least) for x in sorted(s)[:m]} for s in (a, b)]
        assert looked[0] & looked[1]


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "leader bigint, member bigint")
    roots = {r["node"]: r["root"] for r in neardup.components(links).collect()}
    assert roots == {**{i: 0 for i in range(1, 201)}, 1001: 1000}


def test_odd_rows_near_duplicates(odd, nothing):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert by_id[0]["class_id"] == by_id[1]["class_id"] == 0  # null and empty texts
    assert by_id[3]["class_size"] == 2
    kept = neardup.keep_one(odd)
    # Of the rows without an id one is a copy of an empty text with an id, the other is like no other.
    assert kept.columns == odd.columns
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == ["some text without an id"]
    assert neardup.near_duplicates(nothing).count() == 0 and neardup.keep_one(nothing).count() == 0


def test_one_of_each_text_stays_of_rows_without_an_id(spark):
    texts = [f"{i} " + " ".join(f"w{(i * 31 + j) % 997}" for j in range(100)) for i in range(3)]
    rows = [(None, texts[0])] * 3 + [(None, texts[0] + " more"), (None, texts[1]), (7, texts[1]), (None, texts[2]), (None, None), (None, "")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted((r["doc_id"] is None, (r["text"] or "")[:1]) for r in kept) == [(False, "1"), (True, ""), (True, "0"), (True, "2")]


def test_an_id_of_several_texts_loses_none(spark):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(100)) for _ in range(4)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0]), (1, near), (1, texts[1]), (1, texts[1]), (2, texts[2]), (2, near), (3, texts[3].upper()), (3, texts[3])]
    kept = [
        sorted((r["doc_id"], r["text"]) for r in neardup.keep_one(spark.createDataFrame(part, "doc_id bigint, text string").repartition(n)).collect())
        for part, n in ((rows, 3), (rows[::-1], 1))
    ]
    assert kept[0] == kept[1]
    assert [i for i, _ in kept[0]] == [1, 1, 2, 3]
    assert {neardup.text_id(t) for _, t in kept[0]} - {neardup.text_id(t) for t in (texts[0], near)} == {neardup.text_id(t) for t in texts[1:]}


# --- neighbours ---


def test_recall_and_order(spark):
    rows = spark.read.parquet(f"{TABLES}/embeddings.parquet").collect()
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    found = collections.defaultdict(list)
    for r in QUERIES["op2_neighbours"](spark, TABLES).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in vectors if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 21))
        assert [(-s, i) for _, i, s in got] == sorted((-s, i) for _, i, s in got)
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-9 for _, i, s in got)
        best = sorted((-(v @ vectors[q]), i) for i, v in vectors.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in got})
    assert hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("deviation", [0.0, 0.2, 0.5, 1.0])
def test_recall_of_random_vectors(spark, deviation):
    """Directions at random, lengths lognormal."""
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(10_000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors *= np.exp(deviation * rng.normal(size=(10_000, 1)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = collections.defaultdict(set)
    for r in neighbours.nearest(df.repartition(4), df.filter("vec_id < 120")).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(120):
        products = vectors @ vectors[q]
        products[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-products)[:20].tolist()))
    assert hits >= 0.95 * 20 * 120


def test_few_equal_and_broken_vectors(spark):
    inf, nan = float("inf"), float("nan")
    data = [(i, [1.0, 2.0]) for i in range(50)] + [(50, [0.0, 0.0]), (51, None), (52, [nan, 1.0]), (53, [inf, 1.0]), (54, [None, 1.0])]
    data += [(60, [3.0, -1.0]), (60, [3.0, -1.0]), (None, [1.0, 1.0]), (61, [1.0]), (62, [])]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    got = neighbours.nearest(df, df.filter("vec_id in (0, 50, 52, 60)"), k=5).orderBy("query_id", "rank").collect()
    assert [r["vec_id"] for r in got if r["query_id"] == 0] == [1, 2, 3, 4, 5]
    assert [r["vec_id"] for r in got if r["query_id"] == 60] == [0, 1, 2, 3, 4]
    assert {r["query_id"] for r in got} == {0, 60}
    pair = df.filter("vec_id in (0, 60)")
    assert [(r["query_id"], r["vec_id"]) for r in neighbours.nearest(pair, pair).orderBy("query_id").collect()] == [(0, 60), (60, 0)]
    assert neighbours.nearest(df.limit(0), df).count() == 0


# --- mixing ---


def water_fill(sizes):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, target, left = 1.5 * sum(sizes.values()), {}, set(order)
    while left:
        level = (total - sum(target.values())) / sum(weight[s] for s in left)
        above = [s for s in left if level * weight[s] > 2 * sizes[s]]
        if not above:
            return target | {s: level * weight[s] for s in left}
        for s in above:
            target[s] = 2.0 * sizes[s]
            left.remove(s)
    return target


def check_mix(rows):
    sizes, target, taken, largest = collections.Counter(), {}, collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
        taken[r["source"]] += r["size"] * len(r["shards"])
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert len(r["shards"]) <= 2
    want = water_fill(dict(sizes))
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-9


def test_sources_meet_their_targets(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    check_mix(mixing.plan(docs).collect())
    uneven = docs.selectExpr("doc_id", "text", "CASE WHEN doc_id % 3 = 0 THEN 'hot' WHEN doc_id % 97 = 1 THEN NULL ELSE source END AS source")
    rows = mixing.plan(uneven).collect()
    check_mix(rows)
    again = {r["doc_id"]: r["shards"] for r in mixing.plan(uneven.repartition(7)).collect()}
    assert all(again[r["doc_id"]] == r["shards"] for r in rows)


def test_mixed_rows_are_the_planned_ones(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    planned = collections.Counter({r["doc_id"]: len(r["shards"]) for r in mixing.plan(docs).collect()})
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == +planned


def test_partitions_are_shards_and_their_number_follows_the_words(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert mixing.mix(docs).rdd.getNumPartitions() == mixing.SHARDS
    monkeypatch.setattr(mixing, "WORDS_PER_SHARD", 1_000)
    monkeypatch.setattr(mixing, "DOCUMENTS_PER_BLOCK", 1)
    monkeypatch.setattr(mixing, "BLOCKS", 4)
    planned = mixing.plan(docs).collect()
    check_mix(planned)
    number = -(-round(sum({r["source"]: r["target"] for r in planned}.values())) // 1_000)
    mixed = mixing.mix(docs)
    assert abs(mixed.rdd.getNumPartitions() - number) <= 1
    want = collections.Counter((r["doc_id"], s) for r in planned for s in r["shards"])
    placed = mixed.select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert collections.Counter((r["doc_id"], r["p"]) for r in placed) == want


def test_the_tree_splits_every_block(spark):
    quotas = {0: 100, 1: 37, 2: 1, 3: 250}
    df = spark.createDataFrame(list(quotas.items()), "stream int, blocks bigint")
    for shards in (1, 2, 7, 32):
        rows = mixing.split(df, shards).collect()
        per_stream, per_shard = collections.Counter(), collections.Counter()
        for r in rows:
            per_stream[r["stream"]] += r["blocks"]
            per_shard[r["shard"]] += r["blocks"]
        assert per_stream == quotas
        assert max(per_shard.values()) - min(per_shard[s] for s in range(shards)) <= 5


def test_draws_follow_the_distribution(spark):
    from pyspark.sql import functions as F

    draw = mixing._draw(F.lit(20).cast("bigint"), F.lit(8).cast("bigint"), F.lit(6).cast("bigint"), mixing._uniform(F.col("id")))
    got = {r["x"]: r["n"] for r in spark.range(6000).groupBy(draw.alias("x")).agg(F.count("*").alias("n")).collect()}
    from math import comb

    for x in range(7):
        assert abs(got.get(x, 0) / 6000 - comb(8, x) * comb(12, 6 - x) / comb(20, 6)) < 0.03


def test_odd_rows_mixing(odd, nothing):
    rows = mixing.plan(odd).collect()
    assert len(rows) == odd.count() and all(r["shards"] == [] for r in rows if not r["size"])
    assert mixing.plan(nothing).count() == 0 and mixing.mix(nothing).count() == 0
    assert mixing.mix(odd).columns == [c for c in odd.columns if c not in ("size", "source_size", "target", "shards")]


# --- quality rules ---


def test_rules_as_in_sql(spark):
    assert oracle.differences(QUERIES["op8_quality_rules"](spark, TABLES), oracle.connect(TABLES), SQL["op8_quality_rules"]) is None


def repeated_words(text):
    words = [w for w in __import__("re").split("[ \t-\r]+", text) if w]
    grams = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i, gram in enumerate(zip(words, words[1:], words[2:], strict=False)):
        if grams[gram] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def test_counts_of_odd_texts(spark, odd, nothing):
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", " ", "c ", "\n", "\t", "#", "é"]) for _ in range(rng.randrange(60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in quality_rules.counts(df).collect():
        text = r["text"]
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        assert r["n_repeat_words"] == repeated_words(text)
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert (r["word_chars"], r["n_symbols"]) == (len("".join(text.split())), text.count("#"))
    judged = quality_rules.judged(odd)
    assert judged.count() == odd.count() and quality_rules.judged(nothing).count() == 0
    assert {r["kept"] for r in judged.filter("n_words = 0").collect()} == {False}


def test_the_cascade_asks_cheap_rejecting_rules_first(spark):
    rules = quality_rules.RULES[:3]
    measured = [quality_rules.Measured(rules[0], 2.0, 0.5), quality_rules.Measured(rules[1], 0.1, 0.2), quality_rules.Measured(rules[2], 1.0, 0.0)]
    assert [r.name for r in quality_rules.ordered(measured)] == ["repeated_words", "few_words", "symbols"]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = [{r["doc_id"] for r in quality_rules.cascade(docs, rs).filter("kept").collect()} for rs in (quality_rules.RULES, quality_rules.RULES[::-1])]
    assert kept[0] == kept[1] and kept[0]


def test_rules_are_asked_over_counts_made_once(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1], quality_rules.RULES[2:]):
        judged = {r["doc_id"]: r["kept"] for r in quality_rules.judged(docs, rules).collect()}
        plain = quality_rules.counts(docs)
        for rule in rules:
            plain = plain.withColumn(f"_{rule.name}", rule.rejects(quality_rules.Counted(F.col("text"))))
        kept = ~F.coalesce(quality_rules.base_failed(F.col("n_words"), F.col("n_repeat_words")), F.lit(True))
        for rule in rules:
            kept = kept & ~F.col(f"_{rule.name}")
        assert judged == {r["doc_id"]: r["kept"] for r in plain.select("doc_id", kept.alias("kept")).collect()}


def test_costs_are_of_the_work_alone(spark):
    text = "Some Words are HERE, and here again. " * 400
    sample = spark.createDataFrame([(text + str(i),) for i in range(400)], "text string")
    found = {m.rule.name: m for m in quality_rules.measure(sample)}
    assert found["repeated_words"].seconds > 3 * found["symbols"].seconds
    assert found["repeated_words"].rejected == 1.0 and found["few_words"].rejected == 0.0


# --- the pipeline ---


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "personal_data", "mixture", "tokens"]
    rows = corpus_pipeline.run(spark, SMALL).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert rows and {r["doc_id"] for r in rows} <= set(docs)
    assert max(collections.Counter(r["doc_id"] for r in rows).values()) <= 2
    classes = classes_by_force({i: docs[i]["text"] for i in {r["doc_id"] for r in rows}})
    assert all(i == c for i, c in classes.items())
    assert all(r["n_chars"] == len(r["text"]) and r["n_tokens"] > 0 for r in rows)
