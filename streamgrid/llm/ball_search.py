"""Ranked lexical search: exact largest inner products of sparse vectors by ball trees.

A document's value for a term is a whole number that saturates with the term's occurrences, so a score is the inner
product of an item's term counts, the terms' weights and these values. Documents are read twice: once for their terms
and the statistics of all documents, and, from the narrow rows written by that, once for the search.

A task takes its documents in blocks and builds a ball tree over each: every node has the centroid of its documents and
the radius around it, and is halved along the line between two documents far apart. An item visits the nodes best bound
first. By the inequality of Cauchy and Schwarz no document of a ball scores above <item, centroid> + |item| x radius; the
weights are split evenly (by their roots) over the two sides, and all roundings are covered by slack that only raises a
bound. A subtree below the score that the item's last place has reached is pruned. Leaves are scored in whole numbers.
The places reached go on from block to block of a task, and the tasks' best rows are ranked by Spark.

Vectors are held on the terms of the items searched together, on which alone a score depends. Items are taken in
batches of bounded size.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from streamgrid.llm.common import cut

#: Fixed values of the score.
SCALE, FULL, SHARE, DAMP = 1_000_000_000, 100, 25, 12
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Items, and characters of them, that are searched together.
ITEMS, ITEM_CHARS = 4096, 4_000_000
LEAF = 32
LEAVES = 256
#: Centroid values of one tree.
CELLS = 4_000_000
#: Relative slack of the bounds, far above the rounding of sums over all terms of a batch.
SLACK = 1e-9


def terms(text: str | None) -> Counter[str]:
    return Counter(TERM.findall((text or "").translate(LOWER)))


class Items:
    """The items searched together: their terms, numbered, and each item's counts."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        counted = [terms(r[1]) for r in rows]
        self.numbers = {t: i for i, t in enumerate(sorted(set().union(*counted)))}
        self.terms = [np.array([self.numbers[t] for t in c], np.int64) for c in counted]
        self.counts = [np.array(list(c.values()), np.int64) for c in counted]


def vectors(docs: DataFrame, items: Items, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n (its terms with repeats), terms (numbers of those the items hold) and tfs."""
    shared = docs.sparkSession.sparkContext.broadcast(items.numbers)
    id_type = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for batch in batches:
            counted = []
            for t in batch.column(1):
                found = terms(t.as_py())
                known = sorted((numbers[w], k) for w, k in found.items() if w in numbers)
                counted.append((found.total(), [i for i, _ in known], [k for _, k in known]))
            n, ids, tfs = zip(*counted, strict=True) if counted else ((), (), ())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), text)
    return rows.mapInArrow(run, f"doc_id {id_type}, n bigint, terms array<int>, tfs array<bigint>")


class Statistics:
    """Documents and terms in all, and the weight of every term."""

    def __init__(self, rows: DataFrame, items: Items):
        whole = rows.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).first()
        self.docs, self.all = whole["docs"], whole["all"]
        # One row per term of the batch of items.
        held = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()
        df = {r["term"]: r["df"] for r in held}
        self.weights = np.array(
            [math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(items.numbers))], np.int64
        )

    def damping(self, n: int) -> int:
        return FULL - SHARE + SHARE * n * self.docs // self.all


class Rows:
    """Sparse vectors of a block: ``terms`` and ``values`` of document i are those from ``begins[i]`` to ``begins[i + 1]``."""

    def __init__(self, begins: np.ndarray, terms_: np.ndarray, values: np.ndarray, shares: np.ndarray):
        self.begins, self.terms, self.values, self.shares = begins, terms_, values, shares
        self.squares = self.sums(shares * shares)

    def sums(self, products: np.ndarray) -> np.ndarray:
        return np.add.reduceat(products, self.begins[:-1])

    def take(self, order: np.ndarray) -> Rows:
        sizes = np.diff(self.begins)[order]
        begins = np.concatenate([[0], np.cumsum(sizes)])
        places = np.arange(begins[-1]) + np.repeat(self.begins[order] - begins[:-1], sizes)
        return Rows(begins, self.terms[places], self.values[places], self.shares[places])

    def part(self, low: int, high: int) -> Rows:
        a, b = self.begins[low], self.begins[high]
        return Rows(self.begins[low : high + 1] - a, self.terms[a:b], self.values[a:b], self.shares[a:b])

    def dense(self, i: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        a, b = self.begins[i], self.begins[i + 1]
        out[self.terms[a:b]] = self.shares[a:b]
        return out

    def dots(self, point: np.ndarray) -> np.ndarray:
        return self.sums(self.shares * point[self.terms])


class BallTree:
    """Nodes over contiguous documents of a block; ``centroids`` has a column per node."""

    def __init__(self, rows: Rows, width: int, leaf: int = LEAF):
        order = np.arange(len(rows.begins) - 1)
        nodes: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        centroids, radii = [], []
        open_ = [(0, len(order), None, 0)]
        while open_:
            low, high, parent, side = open_.pop()
            here = rows.take(order[low:high])
            centre = np.bincount(here.terms, here.shares, width) / (high - low)
            apart = here.squares - 2 * here.dots(centre) + centre @ centre
            apart = np.maximum(apart, 0) + SLACK * (here.squares + centre @ centre)
            node = len(nodes)
            nodes.append((low, high))
            self.children.append(None)
            centroids.append(centre)
            radii.append(math.sqrt(apart.max()))
            if parent is not None:
                pair = self.children[parent] or (0, 0)
                self.children[parent] = (pair[0], node) if side else (node, pair[1])
            if high - low <= leaf:
                continue
            one = here.dense(int(np.argmax(apart)), width)
            other = here.dense(int(np.argmax(here.squares - 2 * here.dots(one))), width)
            half = np.argsort(here.dots(one - other), kind="stable")
            order[low:high] = order[low:high][half]
            middle = (low + high) // 2
            open_ += [(low, middle, node, 0), (middle, high, node, 1)]
        self.nodes, self.order = nodes, order
        self.centroids, self.radii = np.array(centroids).T.copy(), np.array(radii)
        self.rows = rows.take(order)
        self.leaves = {i: self.rows.part(*nodes[i]) for i, c in enumerate(self.children) if c is None}

    def bounds(self, terms_: np.ndarray, shares: np.ndarray) -> np.ndarray:
        """No document of a node scores more."""
        exact = shares @ self.centroids[terms_] + math.sqrt(shares @ shares) * self.radii
        return exact * (1 + SLACK) + 1


class Searcher:
    """The best documents of every item so far, as (-score, id is null, id)."""

    def __init__(self, items: Items, stats: Statistics, k: int):
        self.items, self.stats, self.k = items, stats, k
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        roots = np.sqrt(stats.weights.astype(np.float64))
        self.roots = roots
        self.shares = [c * roots[t] for t, c in zip(items.terms, items.counts, strict=True)]
        self.dense = np.zeros(len(items.numbers), np.int64)
        self.visited = self.pruned = 0

    def block_rows(self) -> int:
        width = max(1, len(self.items.numbers))
        return LEAF * max(1, min(LEAVES, CELLS // (2 * width)))

    def block(self, ids: list, n: list[int], sizes: np.ndarray, terms_: np.ndarray, tfs: np.ndarray) -> None:
        damping = np.repeat(np.array([self.stats.damping(x) for x in n], np.int64), sizes)
        value = (SCALE * tfs) // (1000 * tfs + DAMP * damping)
        rows = Rows(np.concatenate([[0], np.cumsum(sizes)]), terms_, value * self.stats.weights[terms_], value * self.roots[terms_])
        tree = BallTree(rows, len(self.items.numbers))
        for i, wanted in enumerate(self.items.terms):
            if len(wanted):
                self.search(tree, ids, i, wanted)

    def search(self, tree: BallTree, ids: list, item: int, wanted: np.ndarray) -> None:
        bounds = tree.bounds(wanted, self.shares[item])
        self.dense[wanted] = self.items.counts[item]
        best = self.best[item]
        least = -best[-1][0] if len(best) == self.k else 1
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heapq.heappop(open_)
            if -bound < least:
                self.pruned += 1 + len(open_)
                break
            if (pair := tree.children[node]) is not None:
                for child in pair:
                    heapq.heappush(open_, (-bounds[child], child))
                continue
            self.visited += 1
            leaf = tree.leaves[node]
            scores = leaf.sums(leaf.values * self.dense[leaf.terms])
            good = np.flatnonzero(scores >= least)
            if len(good):
                low = tree.nodes[node][0]
                for j in good:
                    doc = ids[tree.order[low + j]]
                    best.append((-int(scores[j]), doc is None, doc))
                best.sort(key=lambda r: (r[0], r[1], r[2] if r[2] is not None else 0))
                del best[self.k :]
                least = -best[-1][0] if len(best) == self.k else 1
        self.dense[wanted] = 0


def _batches(items: DataFrame, at_once: int, chars: int) -> Iterator[list[Row]]:
    held, size = [], 0
    for row in items.toLocalIterator():
        held.append(row)
        size += len(row[1] or "")
        if len(held) >= at_once or size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _search(vectors_: DataFrame, items: Items, k: int, id_type: str, item_type: str, first: int) -> DataFrame:
    """The k best rows of every task for each item."""
    shared = vectors_.sparkSession.sparkContext.broadcast((items, Statistics(vectors_, items)))
    rows = vectors_.filter(F.size("terms") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shared.value, k)
        kinds: list[pa.DataType] = []
        held: list[pa.RecordBatch] = []
        at = searcher.block_rows()

        def take(count: int) -> None:
            table = pa.Table.from_batches(held)
            held[:] = table.slice(count).to_batches()
            table = table.slice(0, count).combine_chunks()
            lists = table["terms"].combine_chunks()
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            searcher.block(
                table["doc_id"].to_pylist(), table["n"].to_pylist(), sizes,
                lists.flatten().to_numpy().astype(np.int64), table["tfs"].combine_chunks().flatten().to_numpy(),
            )

        for batch in batches:
            if batch.num_rows:
                kinds = [batch.schema.field("doc_id").type]
                held.append(batch)
            while sum(b.num_rows for b in held) >= at:
                take(at)
        if held:
            take(sum(b.num_rows for b in held))
        if kinds:
            found = [(first + i, r[2], -r[0]) for i, best in enumerate(searcher.best) for r in best]
            columns = list(zip(*found, strict=True)) if found else [[], [], []]
            arrays = [pa.array(c, t) for c, t in zip(columns, [pa.int64(), kinds[0], pa.int64()], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["_item", "doc_id", "score"])

    found = rows.mapInArrow(run, f"_item bigint, doc_id {id_type}, score bigint")
    spark = vectors_.sparkSession
    # One row per item of the batch.
    names = spark.createDataFrame([(first + i, x) for i, x in enumerate(items.ids)], f"_item bigint, item_id {item_type}")
    return found.join(F.broadcast(names), "_item")


def search(
    docs: DataFrame, items: DataFrame, k: int = 20, item_id: str = "item_id", text: str = "text",
    at_once: int = ITEMS, chars: int = ITEM_CHARS,
) -> DataFrame:
    """The k best documents (doc_id, text) of each item: item_id, rank (from 1), doc_id, score, best first.

    Only scores above 0 count; equal ones go by ascending doc_id, null last. A null or empty text has no terms; an item
    without terms has no rows. Every row of ``items`` is an item, also if its id is null or another row's; every row of
    ``docs`` is a document, copies included. Other columns are not read. Items are searched ``at_once``, or ``chars``
    of them if that is less; each such batch reads the documents' terms anew.
    """
    spark: SparkSession = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    item_type = items.schema[item_id].dataType.simpleString()
    found = spark.createDataFrame([], f"_item bigint, doc_id {id_type}, score bigint, item_id {item_type}")
    first = 0
    for batch in _batches(items.select(F.col(item_id), F.col(text)), at_once, chars):
        asked = Items([tuple(r) for r in batch])
        rows = cut(vectors(docs, asked, text="text"), "terms")
        one = _search(rows, asked, k, id_type, item_type, first)
        found = one if first == 0 else cut(found.unionByName(one), "found")
        first += len(batch)
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
