"""Mixing sources to target weights by subset-sum budget fitting.

The corpus is counted into a histogram (source, size, documents). A source whose target is above
its size is taken whole as often as it fits; what remains is a budget. Most of a large budget takes the
same share of every size; the rest, or a budget up to ``RESERVE`` words or four documents, is filled
exactly where it can be, by a bounded-knapsack dynamic program over the counts that are left.
Documents are then picked per size in a seeded order.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize

#: Words that are left to the dynamic program at least, or four times the longest document where that is more.
RESERVE = 1 << 16
#: Documents that one group of the seeded ranking holds on average.
BUCKET = 1000
#: Documents of one source and size from which they are joined by broadcast, so that they are no hot key.
HOT = 1_000_000


def water_fill(sizes: list[int], weights: list[float], ceiling: float = 3.0) -> list[float]:
    """Targets that share out ``sum(sizes)`` by weight, none above ``ceiling`` times its size.

    What a capped source leaves is shared again by weight among the others, until none is above.
    """
    total, open_, target = float(sum(sizes)), set(range(len(sizes))), [0.0] * len(sizes)
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / weight > ceiling * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = ceiling * sizes[i]
            open_.remove(i)
        left = total - sum(target[i] for i in range(len(sizes)) if i not in open_)
    return target


def subset_sum(sizes: np.ndarray, counts: np.ndarray, room: int) -> np.ndarray:
    """How many of each size to take so that they sum to ``room``, or to the most below it that can be reached.

    A bounded knapsack over bit sets: bit b of ``reach`` is set if some choice so far sums to b. Only
    every root-th set is kept; those between are made again on the way back, so memory grows with
    the root of the number of steps.
    """
    take = np.zeros(len(sizes), dtype=np.int64)
    live = [i for i in np.argsort(-sizes, kind="stable") if 0 < sizes[i] <= room and counts[i] > 0]
    if not live or room <= 0:
        return take
    unit = math.gcd(*(int(sizes[i]) for i in live))
    room //= unit
    steps = []
    for i in live:
        s = int(sizes[i]) // unit
        spare, k = min(int(counts[i]), room // s), 1
        while spare > 0:
            k = min(k, spare)
            steps.append((i, k, k * s))
            spare, k = spare - k, k * 2
    limit, reach, every, marks = (1 << (room + 1)) - 1, 1, max(1, math.isqrt(len(steps))), []
    for n, (_, _, shift) in enumerate(steps):
        if n % every == 0:
            marks.append(reach)
        reach |= (reach << shift) & limit
        if reach >> room & 1:
            steps = steps[: n + 1]
            break
    at = reach.bit_length() - 1
    for m in range(len(marks) - 1, -1, -1):
        part = steps[m * every : (m + 1) * every]
        before = [marks[m]]
        for _, _, shift in part[:-1]:
            before.append(before[-1] | (before[-1] << shift) & limit)
        for (i, k, shift), had in zip(reversed(part), reversed(before)):
            if not had >> at & 1:
                take[i] += k
                at -= shift
    return take


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int = RESERVE) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to ``budget``, or just under.

    Beyond a reserve, an equal share of every size is taken, then one more of each from the longest
    down. The reserve, and a budget within it whole, is filled by :func:`subset_sum`: so a budget of up
    to ``reserve`` words, or four times the longest document, is met exactly if any choice meets it.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total:
        return counts
    reserve = max(reserve, 4 * int(sizes[counts > 0].max()))
    take = (counts.astype(object) * max(0, budget - reserve) // total).astype(np.int64)
    left = budget - int((sizes * take).sum())
    for i in np.argsort(-sizes, kind="stable"):
        if left <= 2 * reserve:
            break
        spare = min(int(counts[i] - take[i]), (left - reserve) // int(sizes[i])) if sizes[i] else 0
        take[i] += spare
        left -= spare * int(sizes[i])
    return take + subset_sum(sizes, counts - take, left)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words; a null text has none."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), ceiling: float = 3.0, seed: str = "mix") -> DataFrame:
    """Mix all sources to target shares of the corpus' words.

    Sources in code-point order, null last, weigh ``weights``, repeating. Targets are those of
    :func:`water_fill`. Returns one row per row of ``docs``: doc_id, size (words), source_size,
    target (both of its source), taken (words the mix takes of it, repeats counted; 0 for a text
    without words). Of a source with target t and size s every document is taken floor(t / s) times,
    and the rest of t is filled by :func:`fit_budget`. Ties and repeated rows are ordered by a seeded
    hash of doc_id, so equal rows can be taken in any order with the same result; reruns agree.
    An empty table gives no rows.
    """
    rows = materialize(sized(docs).withColumn("rank_hash", F.xxhash64("doc_id", F.lit(seed))))
    histogram = materialize(rows.groupBy("source", "size").agg(F.count("*").alias("docs")))
    plan = _plan(histogram, weights, ceiling)
    # documents of one source and size are spread over buckets, so a size that very many share is no hot key
    many = plan.withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET)).cast("long"))
    same = lambda p: rows["source"].eqNullSafe(p["p_source"]) & (rows["size"] == p["p_size"])
    if _small(many):
        dealt = rows.join(F.broadcast(many), same(many))
    else:  # the few sizes that very many documents of a source share go by broadcast, the others by shuffle
        hot = F.broadcast(many.filter(F.col("docs") >= HOT))
        dealt = rows.join(hot, same(hot)).unionByName(rows.join(hot, same(hot), "left_anti").join(many, same(many)))
    dealt = dealt.withColumn("bucket", F.pmod("rank_hash", "buckets"))
    chosen = dealt.filter("extra > 0 and extra < docs")
    group = ["source", "size"]
    fill = chosen.groupBy(*group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    fill = fill.select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), F.col("bucket").alias("f_bucket"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*group, "bucket").orderBy("rank_hash", "doc_id")
    picked = (
        chosen.withColumn("rank", F.row_number().over(inside))
        .join(fill, F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size")) & (F.col("bucket") == F.col("f_bucket")))
        .withColumn("more", (F.col("before") + F.col("rank") <= F.col("extra")).cast("long"))
    )
    columns = ["doc_id", "size", "source_size", "target", "times", "more"]
    whole = dealt.filter("extra <= 0 or extra >= docs").withColumn("more", (F.col("extra") > 0).cast("long"))
    return (
        picked.select(*columns)
        .union(whole.select(*columns))
        .select("doc_id", "size", "source_size", "target", ((F.col("times") + F.col("more")) * F.col("size")).alias("taken"))
    )


def _small(df: DataFrame, rows: int = 200_000) -> bool:
    """Whether the table has at most ``rows`` rows: it may then be broadcast (some 80 bytes a row)."""
    return df.limit(rows + 1).count() <= rows


def _ranks(sources: DataFrame) -> DataFrame:
    """Adds the place of each source by code point, null last, from 0. Sources are dealt by range, never gathered."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = materialize(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(F.broadcast(starts.select("part", "start")), "part").withColumn("place", F.col("start") + F.col("inside")).drop("part", "start", "inside")


def targets(histogram: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """(source, source_size, target): :func:`water_fill` as a few aggregates over the table of sources.

    A target is the level times the weight, or ``ceiling`` times the size where that is less. Each round
    caps the sources that the level overflows and raises the level for the others; one row a round
    reaches the driver.
    """
    sums = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    table = materialize(_ranks(sums).select("source", "source_size", weight.alias("weight")))
    total, level = None, -1.0
    while True:
        capped = F.lit(level) * F.col("weight") > F.lit(ceiling) * F.col("source_size")
        state = table.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, F.col("source_size")).otherwise(0)).alias("full"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).head()
        total = state["total"] or 0
        if not state["weight"]:
            break
        now = (total - ceiling * state["full"]) / state["weight"]
        if now <= level:
            break
        level = now
    target = F.least(F.lit(float(level)) * F.col("weight"), F.lit(float(ceiling)) * F.col("source_size"))
    return table.select("source", "source_size", target.alias("target"))


def _plan(histogram: DataFrame, weights: tuple[float, ...], ceiling: float) -> DataFrame:
    """(p_source, p_size, docs, source_size, target, times, extra) for each source and size.

    The fit runs per source over its distinct sizes, never over its documents.
    """
    kind = histogram.schema["source"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        size, target = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        pdf = pdf.sort_values("size", ignore_index=True)
        times = int(target // size) if size else 0
        extra = fit_budget(pdf["size"].to_numpy(), pdf["docs"].to_numpy(), round(target - times * size))
        return pd.DataFrame({"p_source": pdf["source"], "p_size": pdf["size"], "docs": pdf["docs"], "source_size": size, "target": target, "times": times, "extra": extra})

    t = targets(histogram, weights, ceiling).withColumnRenamed("source", "t_source")
    t = F.broadcast(t) if _small(t) else t
    known = histogram.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    return materialize(known.groupBy("source").applyInPandas(fit, f"p_source {kind}, p_size long, docs long, source_size long, target double, times long, extra long"))
