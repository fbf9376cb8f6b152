"""Quality classifier by co-training of a text-content view and a page-metadata view.

The text view sees hashed character trigrams and shape features of the text. The metadata view
sees what is known about the page without reading it: source, declared language, recorded length,
host, path, query and markup size of the crawled page. In each round each view labels the pool
documents it is most sure of for the other. Both are then calibrated and combined on labelled rows
that neither was fitted on. The fits run on a bounded sample; every document is scored.
"""

from __future__ import annotations

import math
import re
import warnings
import zlib
from dataclasses import dataclass
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_RE, held_out, in_sample, materialize, objects, sample_share

TEXT_HASHED, SHAPE = 256, 12
META_HASHED, META_SHAPE = 128, 5

_PAGE_ID = r"/(\d+)(?:[./?#]|$)"


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


def text_view(text: str | None) -> np.ndarray:
    """Features of the content alone."""
    x = np.zeros(TEXT_HASHED + SHAPE, dtype=np.float32)
    text = text or ""
    words = WORD_RE.findall(text)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(raw) > 2:
        r = raw.astype(np.uint32)
        h = (r[:-2] * 65599 + r[1:-1] * 257 + r[2:]) * np.uint32(2654435761) >> np.uint32(24)
        counts = np.bincount(h, minlength=TEXT_HASHED)[:TEXT_HASHED]
        x[:TEXT_HASHED] = np.sqrt(counts / len(raw))
    n = max(1, len(words))
    classes = np.bincount(_CLASSES[raw], minlength=6) / max(1, len(raw))
    lines = [line for line in text.split("\n") if line.strip()]
    x[TEXT_HASHED:] = (
        *classes[:6],
        math.log1p(len(words)) / 10,
        len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        min(2.0, len(lines) / n * 5),
        sum(map(len, words)) / n / 10,
        1.0 if not words else 0.0,
    )
    return x


def _classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    for i in range(128):
        c = chr(i)
        table[i] = 1 if c.isupper() else 2 if c.isdigit() else 3 if c in "#*$%&|<>" else 4 if c in "!?" else 5 if c in " \t\n\r\x0b\x0c" else 0
    return table


_CLASSES = _classes()


def meta_view(source, lang, n_chars, url, html_chars) -> np.ndarray:
    """Features of the page record alone; a document without a page has only its own columns."""
    x = np.zeros(META_HASHED + META_SHAPE, dtype=np.float32)
    keys = [f"source={source}", f"lang={lang}", f"page={url is not None}"]
    if url:
        parts = urlsplit(url)
        host = (parts.hostname or "").split(".")
        keys += [f"host={'.'.join(host)}", f"scheme={parts.scheme}", f"query={bool(parts.query)}", *[f"label={x}" for x in host]]
        keys += [f"path={x}" for x in re.split(r"[/\d._-]+", parts.path) if x]
        keys += [f"param={x.split('=')[0]}" for x in parts.query.split("&") if x]
    for k in keys:
        x[_slot(k, META_HASHED)] = 1.0
    n = 0 if n_chars is None or n_chars != n_chars else max(0, int(n_chars))
    h = 0 if html_chars is None or html_chars != html_chars else int(html_chars)
    x[META_HASHED:] = (math.log1p(n) / 12, 1.0 if n < 300 else 0.0, 1.0 if n > 20_000 else 0.0, math.log1p(h) / 12, min(3.0, n / h) if h else 0.0)
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 3.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic weights, intercept last, by Newton steps."""
    xs = np.hstack([x, np.ones((len(x), 1), dtype=x.dtype)]).astype(np.float64)
    beta = np.zeros(xs.shape[1])
    pull = np.append(np.full(x.shape[1], ridge), 1e-3)
    for _ in range(rounds):
        p = _sigmoid(xs @ beta)
        step = np.linalg.solve((xs * (w * p * (1 - p) + 1e-9)[:, None]).T @ xs + np.diag(pull), xs.T @ (w * (y - p)) - pull * beta)
        beta += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def _logit(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return x @ beta[:-1] + beta[-1]


@dataclass
class QualityModel:
    text: np.ndarray
    meta: np.ndarray
    combine: np.ndarray

    @property
    def decides(self) -> bool:
        """Whether anything was learned."""
        return bool(self.text.any() or self.meta.any() or self.combine.any())

    @classmethod
    def empty(cls) -> QualityModel:
        """With too few labels every document gets 0.5 and no decision (kept is null); a warning says so."""
        warnings.warn("too few labels of both kinds to train on: every document gets 0.5 and is neither kept nor dropped", stacklevel=3)
        return cls(np.zeros(TEXT_HASHED + SHAPE + 1), np.zeros(META_HASHED + META_SHAPE + 1), np.zeros(3))


def page_records(pages: DataFrame) -> DataFrame:
    """__doc, url and html_chars: the page of each document, by the number that ends its path, as text.

    Of several pages of a document the one with the least page_id counts; urls without a number
    belong to none.
    """
    number = F.expr(f"cast(try_cast(nullif(regexp_extract(url, '{_PAGE_ID}', 1), '') as bigint) as string)")
    known = pages.select(number.alias("__doc"), "page_id", "url", F.length("html").alias("html_chars")).filter("__doc is not null")
    best = known.groupBy("__doc").agg(F.min(F.struct("page_id", "url", "html_chars")).alias("p"))
    return best.select("__doc", "p.url", F.col("p.html_chars").cast("long").alias("html_chars"))


def train(
    docs: DataFrame, pages: DataFrame, labels: DataFrame, sample_rows: int = 12_000, rounds: int = 4, grow: int = 400, pool_rows: int = 12_000, fold: tuple[int, int] | None = (5, 0)
) -> QualityModel:
    """Co-train on seeded samples of about ``sample_rows`` labelled documents and ``pool_rows`` others.

    The shares are taken apart, so few labels in a large corpus are all used. Labels in the held-out
    ``fold`` (parts, part), and of documents that are not in ``docs``, do not count; of several labels of an id the
    greater does. Three quarters of the labelled rows fit the views, the rest calibrates them. ``grow``
    pool documents a round and view pass to the other view, split between the labels as the fitted rows
    are; where every document has a label there is no pool and nothing to exchange. Under eight labels, or
    labels of one kind, give :meth:`QualityModel.empty`, with a warning; so does an empty table.
    """
    key = F.col("doc_id").cast("string")
    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy(key.alias("__label_doc")).agg(F.max("quality").cast("int").alias("y"))
    if fold:
        marks = marks.filter(~held_out(F.col("__label_doc"), *fold))
    marks = materialize(marks.join(docs.select(key.alias("__label_doc")), "__label_doc", "left_semi"))
    labelled = marks.count()
    in_pool = in_sample(F.col("doc_id"), sample_share(max(0, docs.count() - labelled), pool_rows), "quality")
    chosen = materialize(marks.filter(in_sample(F.col("__label_doc"), sample_share(labelled, sample_rows), "quality")))
    some = docs.select(key.alias("doc_id"), "text", "source", "lang", "n_chars")
    some = some.join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_doc"), "left").drop("__label_doc").filter(F.col("y").isNotNull() | in_pool)
    if fold:  # held-out documents aren't in the pool either
        some = some.filter(F.col("y").isNotNull() | ~F.coalesce(held_out(F.col("doc_id"), *fold), F.lit(False)))
    some = some.join(marks.select("__label_doc"), F.col("doc_id") == F.col("__label_doc"), "left").filter("y is not null or __label_doc is null")
    some = materialize(some.drop("__label_doc"))
    records = page_records(pages).join(F.broadcast(some.select(F.col("doc_id").alias("__doc"))), "__doc", "left_semi")
    joined = some.join(records, F.col("doc_id") == F.col("__doc"), "left")

    def views(batches):
        for pdf in batches:
            t = [text_view(x).tobytes() for x in pdf["text"]]
            m = [meta_view(*r).tobytes() for r in zip(pdf["source"], pdf["lang"], pdf["n_chars"], pdf["url"], pdf["html_chars"])]
            yield pd.DataFrame({"doc_id": objects(pdf["doc_id"]), "y": pdf["y"].astype("Int64"), "t": t, "m": m})

    # about sample_rows + pool_rows rows of 1.6 kB
    rows = joined.mapInPandas(views, "doc_id string, y int, t binary, m binary").toPandas().sort_values(["doc_id", "t"], ignore_index=True)
    if not len(rows):
        return QualityModel.empty()
    t = np.stack([np.frombuffer(b, dtype=np.float32) for b in rows["t"]])
    m = np.stack([np.frombuffer(b, dtype=np.float32) for b in rows["m"]])
    y = rows["y"].astype("float").to_numpy()
    return co_train(t, m, y, rounds, grow)


def co_train(t: np.ndarray, m: np.ndarray, y: np.ndarray, rounds: int = 4, grow: int = 400) -> QualityModel:
    """Fit from the feature rows of both views; ``y`` is 0, 1 or not a number (pool)."""
    known = np.flatnonzero(~np.isnan(y))
    if len(known) < 8 or len(np.unique(y[known])) < 2:
        return QualityModel.empty()
    held = known[3::4]
    fit = np.setdiff1d(known, held)
    pool = np.flatnonzero(np.isnan(y))
    good = y[fit].mean()
    given = {"t": (np.empty(0, dtype=int), np.empty(0)), "m": (np.empty(0, dtype=int), np.empty(0))}
    beta = {}
    for r in range(rounds + 1):
        for k, x in (("t", t), ("m", m)):
            rows, values = given[k]
            beta[k] = _logistic(x[np.concatenate([fit, rows])], np.concatenate([y[fit], values]), np.concatenate([np.ones(len(fit)), np.full(len(rows), 0.5)]))
        if r == rounds or not len(pool):
            break
        for k, x, other in (("t", t, "m"), ("m", m, "t")):
            p = _sigmoid(_logit(x[pool], beta[k]))
            n = (r + 1) * grow
            up = pool[np.argsort(-p, kind="stable")[: int(n * good)]]
            down = pool[np.argsort(p, kind="stable")[: int(n * (1 - good))]]
            up = up[_sigmoid(_logit(x[up], beta[k])) > 0.9]
            down = down[_sigmoid(_logit(x[down], beta[k])) < 0.1]
            given[other] = (np.concatenate([up, down]), np.concatenate([np.ones(len(up)), np.zeros(len(down))]))
    both = np.stack([_logit(t[held], beta["t"]), _logit(m[held], beta["m"])], axis=1)
    combine = _logistic(np.clip(both, -8, 8), y[held], np.ones(len(held)), ridge=0.5) if len(np.unique(y[held])) > 1 else np.array([1.0, 0.0, 0.0])
    combine[:2] = np.maximum(combine[:2], 0)
    return QualityModel(beta["t"], beta["m"], combine)


def score_quality(docs: DataFrame, pages: DataFrame, model: QualityModel) -> DataFrame:
    """Score of every document by the calibrated views together.

    Returns doc_id, text_score, meta_score, score (0 to 1, higher: better), kept (score >= 0.5; null where nothing was learned), one
    row per row of ``docs``. The text view is scored where the text is read; only its number is
    joined with the page records. Null and empty texts have a score too.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def by_text(texts: pd.Series) -> pd.Series:
        beta, out = shared.value.text, []
        for start in range(0, len(texts), 1024):
            x = np.stack([text_view(t) for t in texts.iloc[start : start + 1024]])
            out.append(_logit(x, beta))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    @F.pandas_udf("double")
    def by_record(source: pd.Series, lang: pd.Series, n_chars: pd.Series, url: pd.Series, html: pd.Series) -> pd.Series:
        x = [meta_view(*r) for r in zip(source, lang, n_chars, url, html)]
        return pd.Series(_logit(np.stack(x), shared.value.meta) if x else np.empty(0))

    narrow = docs.select("doc_id", "source", "lang", "n_chars", by_text("text").alias("tz"))
    records = page_records(pages)
    z = narrow.join(records, F.col("doc_id").cast("string") == F.col("__doc"), "left").select("doc_id", "tz", by_record("source", "lang", "n_chars", "url", "html_chars").alias("mz"))
    a, b, c = (float(v) for v in model.combine)
    clip = lambda name: F.greatest(F.lit(-8.0), F.least(F.lit(8.0), F.col(name)))
    one = lambda e: 1 / (1 + F.exp(-e))
    score = one(clip("tz") * a + clip("mz") * b + c)
    return z.select("doc_id", one(clip("tz")).alias("text_score"), one(clip("mz")).alias("meta_score"), score.alias("score")).withColumn("kept", F.when(F.lit(model.decides), F.col("score") >= 0.5))
