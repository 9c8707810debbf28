"""Approximate nearest neighbours by a permutation index with pivot inverted files.

Pivots are a bounded sample of the vectors. A vector is represented by its nearest pivots in order, and posted in the
inverted files of the first ``POSTED``. A query orders all pivots, visits the files of its first ``VISITED``, ranks
what is posted there by Spearman's footrule (how far each pivot of a vector lies from its place in the query's order),
and reranks the better part by the exact inner product.

Permutations see directions, inner products grow with lengths as well. So a vector is posted in more files the longer
it is, compared with the median, and the footrule is turned into the cosine that it stands for (a line through a few
visited vectors) and multiplied by the length. For vectors of one length this is the order of the footrule.

The files are dealt to groups of pivots, and groups to blocks of rows and of queries, so that a task holds a bounded
number of either. Equal vectors would fill one file; of each vector only the k + 1 smallest ids can be among the k
nearest of anything, so only these are indexed, and no answer is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamgrid.llm.common import cut

PIVOTS = 1024
POSTED = 6
#: Files of very short and of very long vectors.
POSTED_LEAST, POSTED_MOST = 3, 64
VISITED = 140
#: Share of the visited vectors that is reranked, and how many are in any case.
RERANKED = 0.6
RERANKED_LEAST = 100
#: Visited vectors whose cosines tell what a footrule stands for, and by how many deviations a guess is raised.
SEEN_FOR_LINE = 256
RAISED = 2.0
GROUPS = 32
ROWS_PER_BLOCK = 16_384
QUERIES_PER_BLOCK = 8_192
#: Queries whose products with all pivots are computed together.
QUERIES_AT_ONCE = 256


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither null nor zero, and all components finite."""
    # A null or infinite component, or NaN, minus itself is not zero.
    finite = F.forall(vector, lambda x: F.coalesce((x - x) == 0, F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays(flat.chunks).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _line(footrule: np.ndarray, cosine: np.ndarray) -> tuple[float, float]:
    """Height, raised, and slope of the line that tells cosines (times the query's length) from footrules."""
    spread = footrule - footrule.mean()
    square = float(spread @ spread)
    slope = min(0.0, float(spread @ cosine) / square) if square else 0.0
    rest = cosine - slope * footrule
    return float(rest.mean() + RAISED * rest.std()), slope


def _search(pivots: np.ndarray, k: int, posted: int, visited: int):  # noqa: ANN202
    """The search of one block: rows (vec_id, vector, first pivots) against queries (query_id, vector)."""
    width = pivots.shape[1]
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def search(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        if not rows.num_rows or not queries.num_rows:
            return schema.empty_table()
        group = key[0].as_py()
        vectors, ids = _matrix(rows["vector"], width).astype(np.float64), rows["vec_id"].to_numpy()
        first = _matrix(rows["pivots"], min(posted, len(pivots)))
        # The inverted files of this group: rows sorted by pivot, and where each pivot's rows begin.
        files_of = rows["files"].combine_chunks()
        row = np.repeat(np.arange(len(ids)), files_of.value_lengths().to_numpy())
        pivot = files_of.flatten().to_numpy()
        mine = pivot % GROUPS == group
        order = np.argsort(pivot[mine], kind="stable")
        row, pivot = row[mine][order], pivot[mine][order]
        begins = np.searchsorted(pivot, np.arange(len(pivots) + 1))
        columns_of_first = np.ascontiguousarray(first.T)
        lengths = np.linalg.norm(vectors, axis=1)
        found: list[tuple[int, np.ndarray, np.ndarray]] = []
        asked, names = _matrix(queries["vector"], width).astype(np.float64), queries["query_id"].to_numpy()
        # Scaled to components of at most 1, rounding to single precision moves an inner product by less than ``slack``.
        rough = (vectors / np.abs(vectors).max()).astype(np.float32)
        slack = 1e-5 * width
        seen = min(visited, len(pivots))
        for begin in range(0, len(names), QUERIES_AT_ONCE):
            products = asked[begin : begin + QUERIES_AT_ONCE] @ pivots.T
            orders = np.argsort(-products, axis=1, kind="stable")
            # The place of every pivot in a query's order, also of those that are not visited.
            places = np.empty(orders.shape, np.int32)
            np.put_along_axis(places, orders, np.arange(len(pivots), dtype=np.int32)[None, :], axis=1)
            for name, query, files, place_of in zip(names[begin:], asked[begin:], orders[:, :seen], places, strict=False):
                parts = [row[begins[p] : begins[p + 1]] for p in files[files % GROUPS == group]]
                near = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                if len(parts) > 1:
                    marked = np.zeros(len(ids), bool)
                    marked[near] = True
                    near = np.flatnonzero(marked)
                near = near[ids[near] != name]
                kept = max(RERANKED_LEAST, math.ceil(RERANKED * len(near)))
                if kept < len(near):
                    footrule = np.zeros(len(near), np.int32)
                    for rank, column in enumerate(columns_of_first):
                        footrule += np.abs(place_of[column[near]] - np.int32(rank))
                    some = slice(None, None, max(1, len(near) // SEEN_FOR_LINE))
                    line = _line(footrule[some], (vectors[near[some]] @ query) / lengths[near[some]])
                    guess = lengths[near] * (line[0] + line[1] * footrule)
                    near = near[np.argpartition(-guess, kept - 1)[:kept]]
                if len(near) > k:
                    guess = rough[near] @ (query / np.abs(query).max()).astype(np.float32)
                    least = np.partition(guess, len(guess) - k)[len(guess) - k]
                    near = near[guess >= least - 2 * slack]
                scores = (vectors[near] * query).sum(1)
                best = np.lexsort((ids[near], -scores))[:k]
                found.append((name, ids[near][best], scores[best]))
        sizes = [len(i) for _, i, _ in found]
        columns = [
            np.repeat(np.array([n for n, _, _ in found]), sizes),
            np.concatenate([i for _, i, _ in found]),
            np.concatenate([s for _, _, s in found]),
        ]
        return pa.table([pa.array(c) for c in columns], schema=schema)

    return search


def nearest(
    rows: DataFrame,
    queries: DataFrame,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    pivots: int = PIVOTS,
    posted: int = POSTED,
    visited: int = VISITED,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows found with the largest inner product to each query.

    Nearest first, ties to the smaller id; a query's own id is left out, and fewer rows come if there are fewer.
    Vectors that are not ``usable``, or whose length is not the most common one, and rows without an id take no part.
    Repeated rows with one id and vector count once.
    """
    plain = lambda df: df.filter(F.col(vec_id).isNotNull() & usable(F.col(vector))).select(
        F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector")
    )
    empty = rows.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    sizes = plain(rows).groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if sizes is None:
        return empty
    width = sizes["width"]
    fits = F.size("vector") == width
    copies = Window.partitionBy("vector").orderBy("vec_id")
    indexed = plain(rows).filter(fits).distinct().withColumn("_n", F.row_number().over(copies))
    indexed = cut(indexed.filter(F.col("_n") <= k + 1).drop("_n"), "ann-rows")
    asked = cut(plain(queries).filter(fits).distinct().withColumnRenamed("vec_id", "query_id"), "ann-queries")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    total, median = indexed.agg(F.count(F.lit(1)), F.percentile_approx(F.sqrt(square), 0.5)).first()
    questions = asked.count()
    if not total or not questions:
        return empty
    # The first by a hash of the id, of those whose hash can be among them.
    share = 1.25 * (pivots + 8 * math.sqrt(pivots) + 32) / total
    bound = F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))
    chosen = indexed.filter(F.xxhash64("vec_id") <= bound).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots)
    base = np.unique(_matrix(chosen.select("vector").toArrow()["vector"], width), axis=0)
    base = base / np.linalg.norm(base, axis=1, keepdims=True)
    count = min(posted, len(base))
    least, most = min(POSTED_LEAST, len(base)), min(max(POSTED_MOST, posted), len(base))

    @F.arrow_udf("struct<pivots:array<int>,files:array<int>>")
    def ordered_pivots(vectors: pa.Array) -> pa.Array:
        first, files = [], []
        for begin in range(0, len(vectors), 2_000):
            part = _matrix(pa.chunked_array([vectors[begin : begin + 2_000]]), width)
            near = np.argsort(-(part @ base.T), axis=1, kind="stable")[:, :most].astype(np.int32)
            sizes = np.clip(np.round(count * np.linalg.norm(part, axis=1) / median), least, most).astype(int)
            first += near[:, :count].tolist()
            files += [row[:n].tolist() for row, n in zip(near, sizes, strict=True)]
        kind = pa.list_(pa.int32())
        return pa.StructArray.from_arrays([pa.array(first, kind), pa.array(files, kind)], ["pivots", "files"])

    posted_all = cut(
        indexed.withColumn("_p", ordered_pivots("vector")).select("vec_id", "vector", "_p.pivots", "_p.files"), "ann-posted"
    )
    groups = F.array_distinct(F.transform("files", lambda p: p % GROUPS))
    copies_made = posted_all.agg(F.sum(F.size(groups))).first()[0]
    row_blocks = math.ceil(copies_made / GROUPS / ROWS_PER_BLOCK)
    query_blocks = math.ceil(questions / QUERIES_PER_BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    hashed = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    posted_rows = (
        posted_all.withColumn("g", F.explode(groups)).withColumn("r", hashed("vec_id", row_blocks))
        .withColumn("q", numbers(query_blocks))
    )
    dealt_queries = (
        asked.withColumn("g", numbers(GROUPS)).withColumn("r", numbers(row_blocks))
        .withColumn("q", hashed("query_id", query_blocks))
    )
    both = posted_rows.groupBy("g", "r", "q").cogroup(dealt_queries.groupBy("g", "r", "q"))
    found = both.applyInArrow(_search(base, k, posted, visited), "query_id bigint, vec_id bigint, score double")
    # A row found through several groups has the same score, and so the same rank.
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.dense_rank().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score").distinct()
