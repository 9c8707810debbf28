"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree. DataFrame functions only.

Every source is dealt into blocks by a hash of the document, the more the more documents there are. One aggregate gives
the words of each block; all planning works on that table, whose size is bounded by sources times blocks. A source's
blocks are taken in a random order until its target is met, in a second pass once more where the target exceeds the
source; only the last block of a pass is cut, inside, between documents: these few blocks alone are put in order, all
others are taken or left whole where they lie. The blocks taken are exact quotas of (source, pass); a binary tree
splits them among the output shards, each node drawing what goes left from the multivariate hypergeometric
distribution. The shards then take disjoint runs of each source's permuted blocks, and are shuffled within.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamgrid.llm.common import cut, free_name

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: No source, and no document, gives more than so many times its own size.
PASSES = 2
#: Blocks of a source, and output shards, at least; more where a block would hold more documents, a shard more words.
BLOCKS, DOCUMENTS_PER_BLOCK = 1024, 4096
SHARDS, WORDS_PER_SHARD = 32, 16_000_000
SEED = 17


def word_count(text: str | Column) -> Column:
    return F.regexp_count(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(WORD)).cast(
        "bigint"
    )


def _key(source: Column) -> Column:
    """A source as a string that is never null, so that it can be joined and grouped on."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _block(doc_id: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(SEED)), F.lit(blocks)).cast("int")


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE) -> DataFrame:
    """(key, source, source_size, target) from (source, words), one row for each source.

    Sources in code-point order, null last, have the weights in turn. They share ``share`` times all words by
    weight; no target exceeds ``PASSES`` times its source, and what is above goes to the others by weight. The level
    at which it stops is found in closed form: sources are capped in the order of cap by weight.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rn") - 1) % len(weights) + 1)
    capped = (
        sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("int"))
        .withColumns({"w": weight, "cap": F.lit(float(PASSES)) * F.col("words")})
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    before = Window.orderBy("ratio", "rn").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    free = F.lit(share) * F.sum("words").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = free / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    levels = capped.withColumn("level", level)
    first = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rn"))).over(every)
    target = F.least("cap", F.coalesce(first, F.lit(math.inf)) * F.col("w"))
    return levels.select(
        _key(F.col("source")).alias("key"), "source", F.col("words").alias("source_size"), target.alias("target")
    )


def _draw(population: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Hypergeometric draw by inversion: how many of ``drawn`` out of ``population`` are among the ``marked``."""
    low = F.greatest(F.lit(0), drawn - (population - marked))
    high = F.least(marked, drawn)
    steps = F.sequence(low, high)

    def following(k: Column, log_p: Column) -> Column:
        """Logarithm of the unscaled probability of k + 1 from that of k."""
        up = F.log(F.greatest((marked - k) * (drawn - k), F.lit(0)) + F.lit(1e-300))
        down = F.log(((k + 1) * (population - marked - drawn + k + 1)).cast("double"))
        return log_p + up - down

    start = F.struct(F.lit(0.0).alias("p"), F.lit(-math.inf).alias("top"), F.lit(0.0).alias("sum"))
    # The sum is kept relative to the largest term so far.
    total = F.aggregate(
        steps,
        start,
        lambda s, k: F.struct(
            following(k, s["p"]).alias("p"),
            F.greatest(s["top"], s["p"]).alias("top"),
            (s["sum"] * F.exp(s["top"] - F.greatest(s["top"], s["p"])) + F.exp(s["p"] - F.greatest(s["top"], s["p"]))).alias("sum"),
        ),
    )
    empty = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("got"))

    def search(found: Column) -> Column:
        return F.aggregate(
            steps,
            empty,
            lambda s, k: F.struct(
                following(k, s["p"]).alias("p"),
                (s["sum"] + F.exp(s["p"] - found["top"])).alias("sum"),
                F.when((s["got"] < 0) & (s["sum"] + F.exp(s["p"] - found["top"]) >= u * found["sum"]), k).otherwise(s["got"]).alias("got"),
            ),
            lambda s: F.when(s["got"] < 0, high).otherwise(s["got"]),
        )

    # ``total`` is named once, by a transform over one element, and not computed at every step.
    return F.element_at(F.transform(F.array(total), search), 1)


def _uniform(*what: Column) -> Column:
    return F.pmod(F.xxhash64(*what), F.lit(1 << 52)) / F.lit(float(1 << 52))


def split(quotas: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(stream, shard, blocks) from (stream, blocks): how many blocks of each stream each shard takes.

    One row holds the quotas of a node; each level halves the shards of every node, ``log2(shards)`` levels in all.
    Streams must be numbered from 0 without gaps.
    """
    whole = F.transform(F.array_sort(F.collect_list(F.struct("stream", F.col("blocks").cast("bigint").alias("blocks")))), lambda x: x["blocks"])
    nodes = quotas.agg(whole.alias("quota")).select(F.lit(0).alias("low"), F.lit(shards).alias("width"), "quota")
    for _ in range(math.ceil(math.log2(max(1, shards)))):
        half = F.col("width") - F.expr("width div 2")
        population = F.aggregate("quota", F.lit(0).cast("bigint"), lambda a, x: a + x)
        drawn = F.round(population * half / F.col("width")).cast("bigint")
        begin = F.struct(population.alias("left"), drawn.alias("open"), F.array().cast("array<bigint>").alias("got"))

        def step(s: Column, k: Column) -> Column:
            u = _uniform(F.lit(seed), F.col("low"), F.col("width"), F.size(s["got"]))
            # ``_draw`` is named once, as its result is used three times.
            return F.element_at(
                F.transform(
                    F.array(_draw(s["left"], k, s["open"], u)),
                    lambda x: F.struct(
                        (s["left"] - k).alias("left"), (s["open"] - x).alias("open"), F.concat(s["got"], F.array(x)).alias("got")
                    ),
                ),
                1,
            )

        taken = nodes.withColumns({"half": half, "to_left": F.aggregate("quota", begin, step, lambda s: s["got"])})
        rest = F.zip_with("quota", "to_left", lambda a, b: a - b)
        parts = F.when(
            F.col("width") > 1,
            F.array(
                F.struct("low", F.col("half").alias("width"), F.col("to_left").alias("quota")),
                F.struct((F.col("low") + F.col("half")).alias("low"), (F.col("width") - F.col("half")).alias("width"), rest.alias("quota")),
            ),
        ).otherwise(F.array(F.struct("low", "width", "quota")))
        nodes = taken.select(F.inline(parts))
    leaf = nodes.select(F.col("low").alias("shard"), F.posexplode("quota").alias("stream", "blocks"))
    return leaf.filter("blocks > 0").select("stream", "shard", "blocks")


def _planned_blocks(stats: DataFrame, goals: DataFrame, shards: int, seed: int) -> DataFrame:
    """(key, block, source_size, target, cut, need1, shard1, need2, shard2): what each pass takes from each block.

    ``cut`` tells whether a pass takes a part of the block only.
    """
    joined = stats.join(goals.select("key", "source_size", "target"), "key")
    passes = F.explode(F.sequence(F.lit(1), F.lit(PASSES)))
    rows = joined.withColumn("pass", passes).withColumn(
        "quota", F.least(F.greatest(F.col("target") - (F.col("pass") - 1) * F.col("source_size"), F.lit(0.0)), F.col("source_size"))
    )
    order = [F.xxhash64("key", "block", "pass", F.lit(seed)), F.col("block")]
    running = Window.partitionBy("key", "pass").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("need", F.col("quota") - F.coalesce(F.sum("words").over(running), F.lit(0)))
    taken = rows.filter("need > 0 and words > 0").select("key", "pass", "block", "need")
    # The order in which shards draw is another one, so that the cut block does not always come last.
    drawn = Window.partitionBy("key", "pass").orderBy(F.xxhash64("key", "block", "pass", F.lit(seed + 1)), "block")
    taken = taken.withColumn("place", (F.row_number().over(drawn) - 1).cast("bigint"))
    counts = taken.groupBy("key", "pass").agg(F.count(F.lit(1)).alias("blocks"))
    numbered = cut(
        counts.withColumn("stream", (F.row_number().over(Window.orderBy("key", "pass")) - 1).cast("int")), "mix-streams"
    )
    runs = split(numbered, shards, seed)
    ends = F.sum("blocks").over(Window.partitionBy("stream").orderBy("shard"))
    runs = runs.withColumn("end", ends).select("stream", "shard", F.explode(F.expr("sequence(end - blocks, end - 1)")).alias("place"))
    placed = taken.join(numbered.select("key", "pass", "stream"), ["key", "pass"]).join(runs, ["stream", "place"])
    columns = []
    for p in range(1, PASSES + 1):
        for c in ("need", "shard"):
            columns.append(F.max(F.when(F.col("pass") == p, F.col(c))).alias(f"{c}{p}"))
    wide = placed.groupBy("key", "block").agg(*columns)
    whole = joined.select("key", "block", "source_size", "target", "words").join(wide, ["key", "block"], "left")
    parts = [F.coalesce(F.col(f"need{p}") < F.col("words"), F.lit(False)) for p in range(1, PASSES + 1)]
    return whole.withColumn("cut", functools.reduce(lambda a, b: a | b, parts)).drop("words")


#: Columns that ``plan`` adds.
PLANNED = ("size", "source_size", "target", "shards")


def plan(
    df: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    shards: int | None = None,
    seed: int = SEED,
) -> DataFrame:
    """Every row of ``df`` (doc_id, source, text and others) with ``size``, ``source_size``, ``target``, ``shards``.

    ``size`` words of the text (null and empty: 0), ``source_size`` those of its source (null is a source of its
    own), ``target`` its source's, ``shards`` the shard of each time the document is taken: none, one or two.
    Documents of a cut block are taken in random order while their middle lies before the cut, so a source misses its
    target by half a document at most in each pass. Reruns agree. Repeated rows are taken for themselves; columns of
    these names are replaced. The number of shards follows from the words unless it is given.
    """
    return _planned(df, weights, share, shards, seed)[0]


def _planned(df: DataFrame, weights: Sequence[float], share: float, shards: int | None, seed: int) -> tuple[DataFrame, int]:
    plain = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in PLANNED])
    number = max(BLOCKS, math.ceil(plain.count() / DOCUMENTS_PER_BLOCK))
    names = {n: free_name(plain.columns, f"_{n}") for n in ("key", "block", "size")}
    dealt = plain.withColumns({names["key"]: _key(F.col("source")), names["block"]: _block(F.col("doc_id"), number)})
    stats = cut(
        dealt.groupBy(F.col(names["key"]).alias("key"), "source", F.col(names["block"]).alias("block"))
        .agg(F.sum(word_count("text")).alias("words")),
        "mix-blocks",
    )
    goals = cut(targets(stats.groupBy("source").agg(F.sum("words").alias("words")), weights, share), "mix-targets")
    if shards is None:
        words = goals.agg(F.sum("target")).first()[0] or 0
        shards = max(SHARDS, math.ceil(words / WORDS_PER_SHARD))
    blocks = cut(_planned_blocks(stats.drop("source"), goals, shards, seed), "mix-plan")
    held = {c: free_name(dealt.columns, f"_plan_{c}") for c in blocks.columns}
    size = F.col(names["size"])

    def taken(rows: DataFrame, before: Sequence[Column] | None) -> DataFrame:
        """The rows with their shards; ``before`` gives the words before each in its block, if the block is cut."""
        found = []
        for p in range(1, PASSES + 1):
            need = F.col(held[f"need{p}"])
            fits = need.isNotNull() if before is None else before[p - 1] + size / 2 <= need
            found.append(F.when((size > 0) & fits, F.col(held[f"shard{p}"])))
        return rows.select(
            *[F.col(f"`{c}`") for c in plain.columns], size.alias("size"), F.col(held["source_size"]).alias("source_size"),
            F.col(held["target"]).alias("target"), F.array_compact(F.array(*found)).alias("shards"),
        )

    def met(of: DataFrame) -> DataFrame:
        of = of.withColumnsRenamed(held)
        same = (F.col(names["key"]) == F.col(held["key"])) & (F.col(names["block"]) == F.col(held["block"]))
        return dealt.join(of, same).withColumn(names["size"], word_count("text"))

    # Two blocks of a source are cut at most; only their documents are moved and sorted.
    parted = met(cut(blocks.filter("cut"), "mix-cut"))
    before = []
    for p in range(1, PASSES + 1):
        order = [F.xxhash64("doc_id", F.lit(seed + 10 + p)), F.col("doc_id"), size]
        window = Window.partitionBy(names["key"], names["block"]).orderBy(*order)
        before.append(F.coalesce(F.sum(size).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return taken(met(blocks.filter("not cut")), None).unionByName(taken(parted, before)), shards


def mix(
    df: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, shards: int | None = None, seed: int = SEED
) -> DataFrame:
    """The rows that the plan takes, repeats as rows of their own, dealt to their shards and shuffled within.

    Columns are those of ``df`` but for ones with names that ``plan`` adds, which are left out. Partition i is shard i.
    Documents without words, so null and empty texts, are never taken; an empty table gives an empty mixture.
    """
    planned, count = _planned(df, weights, share, shards, seed)
    shard, number, order = (free_name(planned.columns, n) for n in ("_shard", "_number", "_order"))
    kept = [F.col(f"`{c}`") for c in planned.columns if c.lower() not in PLANNED]
    rows = planned.select(*kept, F.posexplode("shards").alias(number, shard))
    rows = rows.withColumn(order, F.xxhash64("doc_id", number, F.lit(seed + 20))).drop(number)
    return rows.repartitionById(count, F.col(shard).cast("int")).sortWithinPartitions(order).drop(order, shard)
