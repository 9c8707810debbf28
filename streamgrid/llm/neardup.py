"""Near duplicates by weighted MinHash signatures from hashed darts, banded joining and exact verification.

A document is the set of its shingles (five words), each with a weight. Every shingle owns a region, its weight wide
and endlessly high, onto which darts fall by the shingle's own hash alone: one to each unit of area on average. A dart
has a height and a coordinate. A document throws only as high as a few darts for each coordinate need, whatever its
length, and keeps the lowest dart of each coordinate. Two documents keep the same dart with the probability of their
weighted Jaccard similarity.

Documents with the same words are one text, known by a 64-bit hash (among 20 billion texts about ten pairs collide).
Texts that agree in a whole band of coordinates are candidates. Each bucket of a band has up to ``LEADERS`` leaders,
the smallest hash in each of as many parts; links run from leaders to members first, so that their number grows with
the members. Every link is verified on the exact shingle sets, and connected links make a class. Where a bucket then
still holds members of several classes that are not leaders, all of its members go on to an exact join: two sets that
are alike enough share one of their rarest shingles, so many of each that the rest is too few (a prefix filter). Sizes
are parted into narrow steps, since the closer the sizes, the fewer shingles are needed. What all members of a family
have from its template is then never looked up while the template alone does not make them alike.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamgrid.llm.common import cut, free_name

SHINGLE = 5
SIMILARITY = 0.8
#: Bands and coordinates in each: a pair with a similarity of 0.8 misses all bands 7 times in 10,000, closer ones less.
BANDS = 24
ROWS = 6
LEADERS = 2
#: Sizes of shingle sets that are looked up together differ by this factor at most.
STEP = 1.03
#: Counters by which the exact join tells rare shingles from common ones; shared ones only make more candidates.
COUNTERS = 1 << 20
#: Documents whose darts are thrown together.
TOGETHER = 64

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_U = np.uint64
_GOLD = _U(0x9E3779B97F4A7C15)
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def uniform(x: np.ndarray) -> np.ndarray:
    return (x >> _U(11)).astype(np.float64) * 2.0**-53


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of the rolling hash, and of its inverse, modulo 2^64."""
    inverse = _U(pow(_BASE, -1, 1 << 64))
    up, down = np.full(size, _U(_BASE)), np.full(size, inverse)
    up[0] = down[0] = _U(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each word in bytes where blanks part words: differences of one rolling hash over all bytes."""
    edges = np.diff((data != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(1 << max(16, int(len(data)).bit_length()))
    rolled = np.concatenate([[_U(0)], np.cumsum(data.astype(_U) * up[: len(data)], dtype=_U)])
    return mix((rolled[ends] - rolled[starts]) * down[starts] + (ends - starts).astype(_U) * _GOLD)


def shingles(text: str, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of a text, sorted, and how often each occurs.

    A text with fewer words than a shingle has one shingle of all its words; a text without words has none.
    """
    words = word_hashes(np.frombuffer(text.encode().translate(_WORDS), np.uint8))
    if not len(words):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    size = min(size, len(words))
    count = len(words) - size + 1
    joined = np.full(count, _U(size))
    for i in range(size):
        joined = (joined ^ words[i : i + count]) * _U(0xD6E8FEB86659FD93)
        joined ^= joined >> _U(32)
    return np.unique(mix(joined), return_counts=True)


def text_id(text: str) -> int:
    """64-bit hash of the words, in order; of the text itself where there are none."""
    words = text.encode().translate(_WORDS).split()
    kept = b"w" + b" ".join(words) if words else b"t" + text.encode()
    return int.from_bytes(hashlib.blake2b(kept, digest_size=8).digest(), "little", signed=True)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], size: int = BANDS * ROWS) -> np.ndarray:
    """The dart kept at each of ``size`` coordinates by each weighted set (hashes, weights); no set may be empty."""
    kept = np.zeros((len(sets), size), _U)
    todo = np.arange(len(sets))
    darts = size * (math.log(size) + 2)
    while len(todo):
        chosen = [sets[i] for i in todo]
        lengths = [len(h) for h, _ in chosen]
        owner = np.repeat(np.arange(len(todo)), lengths)
        hashes, weights = (np.concatenate(x) for x in zip(*chosen, strict=True))
        top = darts / np.bincount(owner, weights, len(todo))
        found = np.zeros(len(todo) * size, _U)
        filled = np.zeros(len(todo) * size, bool)
        heights, places, names = [], [], []
        # Widths 1, 2, 4 ... lie side by side; a set reaches into as many of them as its weight asks.
        left, width = 0, 1
        while (reach := weights > left).any():
            own, h, w, limit = owner[reach], hashes[reach], weights[reach], top[owner[reach]]
            height, throw = np.zeros(len(own)), 0
            while len(own):
                throw += 1
                dart = mix(h + _U((throw * 64 + width.bit_length()) * int(_GOLD) % 2**64))
                height = height - np.log1p(-uniform(dart)) / width
                low = height < limit
                own, h, w, limit, height, dart = (x[low] for x in (own, h, w, limit, height, dart))
                inside = left + width * uniform(mix(dart + _U(1))) < w
                name = mix(dart + _U(2))
                heights.append(height[inside])
                places.append((own * size + (name % _U(size)).astype(np.int64))[inside])
                names.append(name[inside])
            left, width = left + width, 2 * width
        order = np.argsort(-np.concatenate(heights), kind="stable")
        place = np.concatenate(places)[order]
        found[place] = np.concatenate(names)[order]  # the lowest dart is written last
        filled[place] = True
        full = filled.reshape(-1, size).all(1)
        kept[todo[full]] = found.reshape(-1, size)[full]
        todo, darts = todo[~full], 2 * darts
    return kept


def band_keys(kept: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One hash for each band of each signature."""
    parts = kept.reshape(len(kept), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=_U) * _GOLD, (len(kept), bands)).copy()
    for i in range(rows):
        keys = mix(keys ^ parts[:, :, i]) * _U(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


def _sketch(weighted: bool):  # noqa: ANN202
    @F.arrow_udf("struct<tid:bigint,bands:array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        ids, rows = [], []
        for begin in range(0, len(texts), TOGETHER):
            part = [t.as_py() or "" for t in texts[begin : begin + TOGETHER]]
            ids += map(text_id, part)
            sets = [shingles(t) for t in part]
            some = [i for i, s in enumerate(sets) if len(s[0])]
            keys = band_keys(signatures([_weighed(sets[i], weighted) for i in some])) if some else []
            of = dict(zip(some, keys, strict=True))
            rows += [of[i].tolist() if i in of else [] for i in range(len(part))]
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], ["tid", "bands"]
        )

    return sketch


def _weighed(found: tuple[np.ndarray, np.ndarray], weighted: bool) -> tuple[np.ndarray, np.ndarray]:
    return found[0], found[1].astype(float) if weighted else np.ones(len(found[0]))


def _shingle_sets(weighted: bool):  # noqa: ANN202
    @F.arrow_udf("struct<tid:bigint,hashes:binary,weights:binary>")
    def sets(texts: pa.Array) -> pa.Array:
        ids, hashes, weights = [], [], []
        for t in texts:
            text = t.as_py() or ""
            h, w = shingles(text)
            ids.append(text_id(text))
            hashes.append(h.tobytes())
            weights.append(w.astype(np.int32).tobytes() if weighted else b"")
        return pa.StructArray.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())],
            ["tid", "hashes", "weights"],
        )

    return sets


def _similarity():  # noqa: ANN202
    """Weighted Jaccard similarity of two sets; without weights every shingle has weight 1."""

    @F.arrow_udf("double")
    def similarity(a: pa.Array, aw: pa.Array, b: pa.Array, bw: pa.Array) -> pa.Array:
        out = []
        for h1, w1, h2, w2 in zip(a, aw, b, bw, strict=True):
            x, y = np.frombuffer(h1.as_py(), _U), np.frombuffer(h2.as_py(), _U)
            _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
            if w1.as_py():
                u, v = np.frombuffer(w1.as_py(), np.int32), np.frombuffer(w2.as_py(), np.int32)
                shared, total = np.minimum(u[i], v[j]).sum(), u.sum() + v.sum()
            else:
                shared, total = len(i), len(x) + len(y)
            out.append(float(shared / (total - shared)) if total else 1.0)
        return pa.array(out, pa.float64())

    return similarity


def bucket_rows(texts: DataFrame) -> DataFrame:
    """(tid, bucket) of all bands, written, from (tid, bands)."""
    return cut(texts.select("tid", F.explode("bands").alias("bucket")), "neardup-buckets")


def _leaders(leaders: int) -> list[Column]:
    part = F.pmod(F.xxhash64("tid"), F.lit(leaders))
    return [F.min(F.when(part == i, F.col("tid"))).alias(f"l{i}") for i in range(leaders)]


def candidate_links(rows: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """Distinct (leader, member) of the buckets of all bands, from (tid, bucket)."""
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *_leaders(leaders)).filter("n > 1").drop("n")
    # Written, so that the join below deals both sides out itself and can split a hot bucket.
    buckets = cut(buckets, "neardup-leaders")
    joined = rows.join(buckets, "bucket").select(
        "tid", F.explode(F.array(*[F.col(f"l{i}") for i in range(leaders)])).alias("leader")
    )
    # The same link comes from many bands and from either end: the smaller id is put first.
    pair = joined.filter("leader is not null and leader <> tid").select(
        F.least("leader", "tid").alias("leader"), F.greatest("leader", "tid").alias("member")
    )
    return pair.distinct()


def exact_sets(docs: DataFrame, texts: DataFrame, links: DataFrame, weighted: bool) -> DataFrame:
    """(tid, hashes, weights), written, of the texts in ``links``. ``texts``: (tid, first)."""
    wanted = links.select(F.col("leader").alias("tid")).union(links.select("member")).distinct()
    named = cut(wanted.join(texts.select("tid", "first"), "tid"), "neardup-wanted")
    named = named.withColumnsRenamed({"tid": "_tid", "first": "_first"})
    mine = docs.join(named.hint("shuffle_hash"), docs["doc_id"].eqNullSafe(named["_first"])).select("_tid", "text")
    made = free_name(mine.columns, "_set")
    sets = mine.withColumn(made, _shingle_sets(weighted)(F.col("text"))).select(
        F.col("_tid").alias("tid"), *[F.col(made)[c].alias(c) for c in ("hashes", "weights")],
        (F.col(made)["tid"] == F.col("_tid")).alias("own"),
    )
    # An id may stand for several rows; all with this text give the same set. The sets are written after that, so that
    # the joins below deal both sides out themselves and can split a leader of very many members.
    return cut(sets.filter("own").drop("own").dropDuplicates(["tid"]), "neardup-sets")


def verified_links(sets: DataFrame, links: DataFrame, least: float) -> DataFrame:
    """The links of at least the similarity ``least``, on the exact shingle sets."""
    left = sets.select(F.col("tid").alias("leader"), F.col("hashes").alias("h1"), F.col("weights").alias("w1"))
    right = sets.select(F.col("tid").alias("member"), F.col("hashes").alias("h2"), F.col("weights").alias("w2"))
    both = links.join(right, "member").join(left, "leader")
    return both.filter(_similarity()("h1", "w1", "h2", "w2") >= least).select("leader", "member")


def unsettled(rows: DataFrame, known: DataFrame, leaders: int = LEADERS) -> DataFrame:
    """(tid, root) of the members of buckets where two that are no leaders may be of different classes.

    ``rows``: (tid, bucket); ``known``: the ``components`` of the links that are verified.
    """
    rooted = rows.join(known.withColumnRenamed("node", "tid"), "tid", "left")
    rooted = cut(rooted.select("tid", "bucket", F.coalesce("root", "tid").alias("root")), "neardup-rooted")
    seen = rooted.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *_leaders(leaders)
    )
    led = sum(F.col(f"l{i}").isNotNull().cast("int") for i in range(leaders))
    hard = cut(seen.filter((F.col("low") < F.col("high")) & (F.col("n") - led > 1)).select("bucket"), "neardup-hard")
    return rooted.join(hard, "bucket", "left_semi").select("tid", "root").distinct()


def _elements(hashes: bytes, weights: bytes) -> np.ndarray:
    """The shingles of a set; one that counts several times is as many elements."""
    found = np.frombuffer(hashes, _U)
    if not weights:
        return found
    times = np.frombuffer(weights, np.int32)
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    return mix(np.repeat(found, times) + nth.astype(_U) * _GOLD)


def _counted(sets: DataFrame) -> np.ndarray:
    """How often the elements of each counter occur."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for h, w in zip(batch["hashes"], batch["weights"], strict=True):
                np.add.at(total, (_elements(h.as_py(), w.as_py()) % _U(COUNTERS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    found = sets.select("hashes", "weights").mapInArrow(count, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n"))
    table = found.toArrow()
    total = np.zeros(COUNTERS, np.int64)
    total[table["slot"].to_numpy()] = table["n"].to_numpy()
    return total


@functools.lru_cache(maxsize=1)
def _steps() -> np.ndarray:
    """The smallest size of each step."""
    bounds = [1]
    while bounds[-1] < 1 << 32:
        bounds.append(max(bounds[-1] + 1, math.floor(bounds[-1] * STEP)))
    return np.array(bounds)


def prefixes(size: int, least: float) -> Iterator[tuple[int, int, int]]:
    """(own step, other step, elements to look up) of a set against the sets of each step that can be alike enough."""
    step = lambda n: int(np.searchsorted(_steps(), n, "right")) - 1
    # Bounds give way by more than the rounding of doubles: a longer prefix loses nothing.
    smallest = max(1, math.ceil(least * size - 1e-6))
    for other in range(step(smallest), step(math.floor(size / least + 1e-6)) + 1):
        shared = math.ceil(least / (1 + least) * (size + max(smallest, int(_steps()[other]))) - 1e-6)
        if shared <= size:
            yield step(size), other, min(size, size - shared + 1)


def rare_keys(sets: DataFrame, least: float) -> DataFrame:
    """(key, side, tid, root): what each of ``sets`` (tid, root, hashes, weights) is looked up by.

    Sets of at least the similarity ``least`` have a key in common, on sides 0 and 1, or both on side 2.
    """
    held = sets.sparkSession.sparkContext.broadcast(_counted(sets))
    names = ["key", "side", "tid", "root"]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, root, h, w in zip(*(batch[c] for c in ("tid", "root", "hashes", "weights")), strict=True):
                found = _elements(h.as_py(), w.as_py())
                found = found[np.lexsort((found, held.value[(found % _U(COUNTERS)).astype(np.int64)]))]
                keys, sides = [], []
                for own, other, n in prefixes(len(found), least):
                    low, high = min(own, other), max(own, other)
                    keys.append(mix(found[:n] ^ mix(np.array([low * 4096 + high + 1], _U))))
                    sides.append(np.full(n, 2 if own == other else int(own > other), np.int32))
                key, side = np.concatenate(keys).view(np.int64), np.concatenate(sides)
                same = [np.full(len(key), x.as_py(), np.int64) for x in (tid, root)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, side, *same)], names)

    return sets.mapInArrow(look, "key bigint, side int, tid bigint, root bigint")


def remaining_links(sets: DataFrame, hard: DataFrame, least: float) -> DataFrame:
    """Distinct (leader, member) of different roots in ``hard`` (tid, root) that can have the similarity ``least``."""
    sizes = hard.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
    mine = cut(sets.join(hard, "tid"), "neardup-unsettled")
    rows = cut(rare_keys(mine, least), "neardup-keys")
    roots = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    rows = cut(rows.join(roots.select("key"), "key", "left_semi").join(sizes, "root"), "neardup-shared")
    # The largest class of a key is not joined with itself: its rows are only on one side.
    main = rows.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"))
    rows = cut(rows.join(main, "key").select("key", "side", "tid", "root", (F.col("root") == F.col("main")).alias("most")), "neardup-main")
    a, b = rows.filter("not most").alias("a"), rows.alias("b")
    facing = "(a.side = 2 or a.side <> b.side) and a.root <> b.root and (b.most or a.tid < b.tid)"
    both = a.join(b, (F.col("a.key") == F.col("b.key")) & F.expr(facing))
    return both.select(F.least("a.tid", "b.tid").alias("leader"), F.greatest("a.tid", "b.tid").alias("member")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, by alternating large and small stars.

    Every round is written to the shared folder. Rounds grow with the logarithm of the longest chain.
    """
    edges = cut(links.select(F.greatest("leader", "member").alias("u"), F.least("leader", "member").alias("v")), "edges")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct(), "stars")
        low = cut(large.groupBy("u").agg(F.min("v").alias("m")), "stars")
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = cut(small.filter("u <> v").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(df: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """(doc_id, class_id, class_size, text_copies) for each row of ``df`` (doc_id, text).

    ``class_id`` is the smallest doc_id of a class, ``class_size`` its rows, ``text_copies`` the rows with the same
    words. Classes join documents with the same words, and texts connected by links of at least ``least`` Jaccard
    similarity over distinct shingles (``weighted``: counting how often each occurs). Null and empty texts are copies
    of each other; texts without words are copies only if they are equal. Repeated rows are rows of one class. A null
    doc_id counts in sizes, and names a class only if no row has an id.
    """
    return _classed(df, least, weighted).select("doc_id", "class_id", "class_size", "text_copies")


def _classed(df: DataFrame, least: float, weighted: bool) -> DataFrame:
    """``near_duplicates`` with the text's id ``tid``, a hash of the text as it is (``raw``), and the class's ``root``."""
    docs = df.select("doc_id", "text")
    made = docs.withColumn("_s", _sketch(weighted)(F.col("text")))
    rows = cut(made.select("doc_id", F.xxhash64("text").alias("raw"), F.col("_s")["tid"].alias("tid"), F.col("_s")["bands"].alias("bands")), "neardup")
    texts = cut(
        rows.groupBy("tid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "neardup-texts"
    )
    # The bands of a text are taken from one of its rows.
    firsts = texts.select(F.col("tid").alias("_tid"), F.col("first").alias("_first"))
    own = (rows["tid"] == firsts["_tid"]) & rows["doc_id"].eqNullSafe(firsts["_first"])
    banded = rows.join(firsts, own).select("tid", "bands")
    buckets = bucket_rows(banded)
    links = cut(candidate_links(buckets), "neardup-links")
    sets = exact_sets(docs, texts, links, weighted)
    known = components(verified_links(sets, links, least))
    hard = cut(unsettled(buckets, known), "neardup-open")
    if not hard.isEmpty():
        more = verified_links(sets, cut(remaining_links(sets, hard, least), "neardup-more"), least)
        known = components(known.select(F.col("root").alias("leader"), F.col("node").alias("member")).union(more))
    rooted = texts.join(known.withColumnRenamed("node", "tid"), "tid", "left")
    rooted = cut(rooted.select("tid", "first", "n", F.coalesce("root", "tid").alias("root")), "neardup-rooted")
    sizes = cut(
        rooted.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n").alias("class_size")), "neardup-classes"
    )
    named = cut(rooted.join(sizes, "root").select("tid", "root", "class_id", "class_size", F.col("n").alias("text_copies")), "named")
    return rows.select("doc_id", "raw", "tid").join(named, "tid")


def keep_one(df: DataFrame, least: float = SIMILARITY, weighted: bool = False) -> DataFrame:
    """The rows of ``df`` without near copies: of each class the document with the smallest doc_id stays.

    Where that id stands for several texts of the class, the one with the smallest text id stays. Repeated rows with the
    same doc_id and text are one document. Of a class without any id one row stays, that with the smallest text id; in
    other classes rows without an id go.
    """
    found = _classed(df, least, weighted).filter(F.col("doc_id").eqNullSafe(F.col("class_id")))
    first = found.groupBy("root", "doc_id").agg(F.min(F.struct("tid", "raw"))["raw"].alias("_raw"))
    kept = cut(first.select(F.col("doc_id").alias("_kept"), "_raw").distinct(), "neardup-kept")
    held = free_name(df.columns, "_raw_text")
    named = df.withColumn(held, F.xxhash64("text"))
    same = named["doc_id"].eqNullSafe(kept["_kept"]) & (named[held] == kept["_raw"])
    return named.join(kept, same, "left_semi").dropDuplicates(["doc_id", held]).drop(held)
