"""Exact top-k search by inner product over norm-bucketed vectors.

1. Equal vectors are one class; of a class only the ``k + 1`` least ids can ever be answers, so no
   more are kept, whatever number of copies there is (a group limit before the shuffle).
2. Classes are dealt by range of (components, length descending) and packed into buckets of
   ``BUCKET`` neighbours in length; the classes of query rows are packed the same way into blocks.
3. Each block meets the longest vectors first (``SEED`` components of them). The score of its
   (k + 1)-th class is a bound that an answer must reach.
4. Buckets form stripes. A block goes through a stripe from long to short and keeps the best
   classes of each query, so its bounds rise on the way. The bound divided by the lengths of the
   query and of the bucket is the local cosine threshold: over 1 the bucket is skipped for this
   query; from ``COSINE`` on, coordinates decide which vectors can reach it; below, only the
   prefix of long enough vectors is read. What is left is verified by exact integer products.
5. The parts of all stripes meet per query, native and with a limit before the shuffle.

Memory of a task: one block, one bucket and their products, whatever the size of the table. A block
is sent to each stripe, so what is shuffled is queries x stripes; vectors are shuffled once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, materialize
from .neardup import broadcast_if_small

#: Components of a bucket, of a block of queries and of the first buckets (1, 0.5 and 4 MB), and buckets of a stripe.
BUCKET, BLOCK, SEED, STRIPE = 1 << 17, 1 << 16, 1 << 19, 16
#: Local cosine threshold from which coordinates prune, and how many of them are looked at.
COSINE, FOCUS = 0.85, 3
_PACK = "dim int, longest double, n int, nodes binary, ids binary, vectors binary"
_HITS = "node long, other long, other_id long, score long"


def scaled(table: DataFrame, vector: str = "embedding", scale: int = 64) -> DataFrame:
    """vec_id and v, the components as floor(``scale`` * x); rows without an id, a vector, or with a null or non-finite component are left out."""
    x = F.col(vector)
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = table.filter(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """node (an id of this run), v, dim, length and ids: the ``keep`` least ids of the rows with that vector."""
    order = F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))
    least = rows.withColumn("r", order).filter(F.col("r") <= keep).groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    return materialize(least.select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.size("v").alias("dim"), F.sqrt(square).alias("length")))


def _packed(rows: DataFrame, cells: int) -> DataFrame:
    """Rows (node, v, ids, dim, length) as packs of about ``cells`` components, neighbours in length, longest first."""

    def pack(batches):
        held: list[pd.DataFrame] = []

        def flush(pdf):
            v = np.array(pdf["v"].tolist(), dtype=np.int64).reshape(len(pdf), int(pdf["dim"].iat[0]))
            first = np.array([x[0] for x in pdf["ids"]], dtype=np.int64)
            return pd.DataFrame(
                {"dim": pdf["dim"].iloc[:1].to_numpy(), "longest": [float(pdf["length"].iat[0])], "n": [len(pdf)], "nodes": [pdf["node"].to_numpy(dtype=np.int64).tobytes()], "ids": [first.tobytes()], "vectors": [v.tobytes()]}
            )

        for batch in batches:
            held.append(batch)
            rest = pd.concat(held, ignore_index=True)
            while len(rest):
                run = int((rest["dim"] != rest["dim"].iat[0]).to_numpy().argmax()) or len(rest)
                most = max(1, cells // max(1, int(rest["dim"].iat[0])))
                if run == len(rest) and run < most:
                    break
                yield flush(rest.iloc[: min(run, most)])
                rest = rest.iloc[min(run, most) :]
            held = [rest] if len(rest) else []
        for rest in held:
            yield flush(rest)

    dealt = rows.repartitionByRange("dim", F.desc("length"), "node").sortWithinPartitions("dim", F.desc("length"), "node")
    packs = dealt.select("node", "v", "ids", "dim", "length").mapInPandas(pack, _PACK)
    return materialize(packs.withColumn("pack", F.monotonically_increasing_id()))


class _Best:
    """The best classes of each query of a block so far: score descending, then least id."""

    def __init__(self, row, k: int):
        self.k, self.dim, n = k, row.q_dim, row.q_n
        self.nodes = np.frombuffer(row.q_nodes, dtype=np.int64)
        self.vectors = np.frombuffer(row.q_vectors, dtype=np.int64).reshape(n, self.dim)
        self.length = np.sqrt((self.vectors.astype(np.float64) ** 2).sum(axis=1))
        self.top = [np.empty((0, 3), dtype=np.int64)] * n
        self.bound = np.full(n, -np.inf)
        if row.q_bound is not None:
            self.bound = np.frombuffer(row.q_bound, dtype=np.float64).copy()

    def meet(self, row) -> None:
        nodes, ids = np.frombuffer(row.nodes, dtype=np.int64), np.frombuffer(row.ids, dtype=np.int64)
        vectors = np.frombuffer(row.vectors, dtype=np.int64).reshape(row.n, row.dim)
        reach = self.length * row.longest * (1 + 1e-9) + 1e-9
        live = np.flatnonzero(self.bound <= reach)
        if not len(live):
            return
        square = vectors.astype(np.float64)
        length = np.sqrt((square**2).sum(axis=1))
        local = np.divide(self.bound[live], reach[live], out=np.full(len(live), -np.inf), where=reach[live] > 1e-9)
        by_coordinate = local >= COSINE
        for q, t in zip(live[by_coordinate], local[by_coordinate]):
            some = self._by_coordinates(q, min(t, 1.0), square, length)
            self._add(q, _products(self.vectors[q : q + 1], vectors[some])[0], nodes[some], ids[some])
        plain = live[~by_coordinate]
        for at in range(0, len(plain), 256):
            part = plain[at : at + 256]
            need = np.min(np.divide(self.bound[part], self.length[part], out=np.full(len(part), -np.inf), where=self.length[part] > 0))
            prefix = int(np.searchsorted(-length, -(need * (1 - 1e-9) - 1e-9), side="right"))
            scores = _products(self.vectors[part], vectors[:prefix])
            for i, q in enumerate(part):
                self._add(q, scores[i], nodes[:prefix], ids[:prefix])

    def _by_coordinates(self, q: int, t: float, vectors: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Vectors whose largest query coordinates can belong to a cosine of ``t`` or more."""
        unit = self.vectors[q] / self.length[q]
        some = np.flatnonzero(length > 0)
        for f in np.argsort(-np.abs(unit))[:FOCUS]:
            u, c = unit[f], vectors[some, f] / length[some]
            # the highest cosine that a vector with this coordinate can have
            some = some[c * u + np.sqrt(np.maximum(0.0, 1 - c * c) * max(0.0, 1 - u * u)) >= t - 1e-9]
        return some

    def _add(self, q: int, scores: np.ndarray, nodes: np.ndarray, ids: np.ndarray) -> None:
        some = np.flatnonzero(scores >= self.bound[q])
        if not len(some):
            return
        both = np.concatenate([self.top[q], np.column_stack([scores[some], ids[some], nodes[some]])])
        both = both[np.lexsort((both[:, 1], -both[:, 0]))[: self.k + 1]]
        self.top[q] = both
        if len(both) > self.k:
            last = float(both[-1, 0])  # a double is exact up to 2^53; beyond, a lower one is as good a bound
            self.bound[q] = max(self.bound[q], last if abs(last) < 2.0**53 else np.nextafter(last, -np.inf))

    def hits(self) -> pd.DataFrame:
        sizes = [len(x) for x in self.top]
        rows = np.concatenate(self.top) if sizes else np.empty((0, 3), dtype=np.int64)
        return pd.DataFrame({"node": np.repeat(self.nodes, sizes), "other": rows[:, 2], "other_id": rows[:, 1], "score": rows[:, 0]})


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of both; such as don't fit 64 bits are clamped to its ends."""
    high = max(1, a.shape[1]) * float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0))
    if high < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if high < 2.0**62:
        return a @ b.T
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` rows of ``rows`` with the highest inner product for every row of ``queries``, exactly.

    Both hold vec_id and v (see :func:`scaled`); ``queries`` is a part of ``rows``. Returns query_id,
    rank (from 1), vec_id, score; ties go to the smaller vec_id. Rows equal in vec_id and v count
    once; rows that share a vec_id but not a vector are rows of their own. Vectors only meet vectors with as many
    components; a query with fewer than ``k`` such others returns all of them. Rows of zeros, empty
    vectors and empty tables are fine; scores beyond 64 bits are clamped.
    """
    known = classes(rows, k + 1)
    buckets = _packed(known, BUCKET)
    asked = materialize(queries.select("vec_id", "v").join(known.select("node", "v"), "v").select("vec_id", "node").distinct())
    blocks = _packed(known.join(asked.select("node").distinct(), "node", "left_semi"), BLOCK)
    blocks = blocks.select(F.col("pack").alias("block"), *[F.col(c).alias(f"q_{c}") for c in ("dim", "n", "nodes", "vectors")])
    ahead = F.coalesce(F.sum(F.col("n") * F.col("dim")).over(Window.partitionBy("dim").orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = buckets.select("dim", "pack", ahead.alias("ahead")).filter(F.col("ahead") < SEED).drop("ahead")
    longest = broadcast_if_small(materialize(buckets.join(first, ["dim", "pack"])), 1 << 17)

    def runs(batches):
        """Blocks with what they have met; pairs come block by block, another order only costs rows."""
        key, best = None, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if (row.stripe, row.block) != key:
                    if best is not None:
                        yield key[1], best
                    key, best = (row.stripe, row.block), _Best(row, k)
                best.meet(row)
        if best is not None:
            yield key[1], best

    def bounds(batches):
        for block, best in runs(batches):
            yield pd.DataFrame({"block": [block], "q_bound": [best.bound.tobytes()]})

    def search(batches):
        for _, best in runs(batches):
            yield best.hits()

    with batches_of(rows.sparkSession, 8 << 20):
        pairs = blocks.withColumn("q_bound", F.lit(None).cast("binary")).withColumn("stripe", F.lit(0)).join(longest, F.col("q_dim") == F.col("dim"))
        bound = materialize(pairs.mapInPandas(bounds, "block long, q_bound binary"))
        ready = blocks.join(bound.groupBy("block").agg(F.first("q_bound").alias("q_bound")), "block")
        # packs are numbered from a multiple of 2^33 on in each partition, so neighbours share a stripe
        stripes = buckets.withColumn("stripe", F.floor(F.col("pack") / STRIPE))
        touched = broadcast_if_small(materialize(stripes.select("stripe", F.col("dim").alias("of_dim")).distinct()))
        met = ready.join(touched, F.col("q_dim") == F.col("of_dim"))
        pairs = met.join(stripes.withColumnRenamed("stripe", "of_stripe"), (F.col("stripe") == F.col("of_stripe")) & (F.col("of_dim") == F.col("dim")))
        found = materialize(pairs.mapInPandas(search, _HITS))
    by_class = Window.partitionBy("node").orderBy(F.desc("score"), "other_id")
    best = found.withColumn("r", F.row_number().over(by_class)).filter(F.col("r") <= k + 1)
    ids = best.join(known.select(F.col("node").alias("other"), "ids"), "other").select("node", "other", "score", F.explode("ids").alias("vec_id"))
    by_row = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    answers = ids.withColumn("r", F.row_number().over(by_row)).filter(F.col("r") <= k + 1)
    answers = answers.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score", "other"))).alias("found"))
    # the row itself is dropped from the answers of its class, what follows moves up
    own = asked.join(materialize(answers), "node")
    others = F.filter("found", lambda x: (x["vec_id"] != F.col("vec_id")) | (x["other"] != F.col("node")))
    listed = own.select(F.col("vec_id").alias("query_id"), F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
    return listed.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
