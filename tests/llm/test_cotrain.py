import random

import numpy as np

from scribelake.llm import cotrain

from .helpers import frame, sentence


def test_few_labels_in_a_large_pool_are_all_used(spark):
    rng, rows = random.Random(7), []
    for i in range(1200):
        good = i % 3 > 0
        text = sentence(rng, 40) if good else "###$$$ ".join(sentence(rng, 20).upper().split())
        rows.append((i, text, "en", "a", len(text), None, None))
    docs = frame(spark, rows)
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    # 40 labels of these documents; those of others must not take their place in the sample
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 1200, 30)] + [(i, int(i % 3 > 0)) for i in range(1, 1200, 60)] + [(i, 1) for i in range(5000, 9000)], "doc_id long, quality int")
    model = cotrain.train(docs, pages, marks, sample_rows=120, pool_rows=120)
    got = {r.doc_id: r.kept for r in cotrain.score_quality(docs, pages, model).collect()}
    assert np.mean([got[i] == (i % 3 > 0) for i in range(1200)]) >= 0.97


def test_samples_keep_their_own_bounds(spark, monkeypatch):
    rng = random.Random(8)
    docs = frame(spark, [(i, sentence(rng, 10), "en", "a", 60, None, None) for i in range(2000)])
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    seen = {}
    monkeypatch.setattr(cotrain, "co_train", lambda t, m, y, *rest: seen.update(y=y))
    cotrain.train(docs, pages, spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int"), sample_rows=60, pool_rows=200, fold=None)
    assert (~np.isnan(seen["y"])).sum() == 50 and 140 <= np.isnan(seen["y"]).sum() <= 260
    cotrain.train(docs, pages, spark.createDataFrame([(i, i % 2) for i in range(1000)], "doc_id long, quality int"), sample_rows=200, pool_rows=5000, fold=None)
    assert 140 <= (~np.isnan(seen["y"])).sum() <= 260 and np.isnan(seen["y"]).sum() == 1000
