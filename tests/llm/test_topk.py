import math
import random

import numpy as np

from scribelake.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, v string, node long, stripe int"


def brute(rows, every, k, scale=64):
    """Rows as a dictionary of all that take part; every pair is multiplied."""
    known = {(i, tuple(math.floor(scale * x) for x in e)) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = []
    for i, v in known:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in known if (j, w) != (i, v) and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


def answers(spark, rows, every, k):
    table = spark.createDataFrame([(i, e, 1, "clash", 7, 7) for i, e in rows], SCHEMA).repartition(3)
    vectors = topk.scaled(table)
    got = topk.top_k(vectors, vectors.filter(f"vec_id % {every} = 0"), k)
    assert [f.name for f in got.schema] == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def test_top_k_equals_brute_force(spark, monkeypatch):
    """Lengths over four orders of magnitude, near copies, equal vectors, ties and odd rows, in small buckets."""
    monkeypatch.setattr(topk, "BUCKET", 96)
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "STRIPE", 3)
    rng = random.Random(1)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = []
    for i in range(260):
        size = 10 ** rng.uniform(-2, 2)
        near = [x + rng.gauss(0, 0.05) for x in base[i % 6]]
        rows.append((i, [float(size * x) for x in (near if i % 3 else [rng.gauss(0, 1) for _ in range(8)])]))
    rows += [(1000 + i, base[0]) for i in range(90)]  # copies, more than k
    rows += [(2000, [0.0] * 8), (2010, [0.0] * 8), (2020, None), (2030, [None] * 8), (2040, [math.nan] + [0.0] * 7), (2050, [math.inf] + [0.0] * 7), (None, base[1])]
    rows += [(2060, []), (2061, []), (2070, [1.0, 2.0]), (2071, [2.0, 1.0]), (2080, base[2]), (2080, base[2]), (2080, base[3])]
    rows = [(i, None if e is None else [None if x is None else float(x) for x in e]) for i, e in rows]
    as_float = [(i, None if e is None else [None if x is None else float(np.float32(x)) for x in e]) for i, e in rows]
    assert answers(spark, rows, 10, 20) == brute(as_float, 10, 20)


def test_top_k_of_few_and_of_none(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.25, -1.0]), (20, [3.0, 3.0])]
    assert answers(spark, rows, 20, 20) == brute(rows, 20, 20)
    assert answers(spark, [], 20, 20) == []
    assert answers(spark, [(20, [1.0])], 20, 20) == []


def test_products_stay_exact():
    a = np.array([[2**30 + 1, -3], [2**31 + 1, 5]], dtype=np.int64)
    b = np.array([[2**30 - 1, 7], [2**20 + 3, 1]], dtype=np.int64)
    assert topk._products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    huge = np.array([[2**62, 2**62]], dtype=np.int64)
    assert topk._products(huge, huge).tolist() == [[2**63 - 1]]
