"""N-gram Jaccard join of a corpus with itself, by MinHash banding and exact verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .neardup import broadcast_if_small, near_duplicates


def _joined(docs: DataFrame, threshold: float, width: int, rows: int, recall: float) -> DataFrame:
    """One row per different row of ``docs``: doc_id, row_hash, class (with the least rows of set and component)."""
    members, classes = near_duplicates(docs, width, threshold, rows, recall)
    classes = materialize(classes)
    heads = classes.groupBy("root").agg(F.min("first").alias("head"))
    return members.join(classes.join(materialize(heads), "root"), ["hi", "lo"])


def jaccard_join(docs: DataFrame, threshold: float = 0.8, width: int = 5, rows: int = 5, recall: float = 0.9995) -> DataFrame:
    """Class of linked documents for every document.

    Two documents are linked when their sets of ``width``-word shingles (lower-cased words between
    ASCII white space) have a Jaccard similarity of ``threshold`` or more. Equal sets are collapsed
    before the join, so copies are never expanded into pairs. Texts under ``width`` words have one
    shingle, all their words; null and empty texts share the empty one and are copies of each other.

    Returns one row per doc_id and text: doc_id, class_id (least doc_id of its linked component),
    rep_id (least doc_id with the same set), n_copies (rows with that set), n_links (rows it is
    linked to), n_shingles, keep (it is the one that stays of its class: the least by doc_id, then by
    ``row_hash``), row_hash (xxhash64 of the text). Rows equal in doc_id and text count once; rows that
    share a doc_id but not a text are rows of their own. Rows with a null doc_id are left out; an
    empty table gives no rows; extra columns are ignored; doc_id may be of any type that has an order.
    """
    j = _joined(docs, threshold, width, rows, recall)
    return j.select(
        "doc_id",
        F.col("head.doc_id").alias("class_id"),
        F.col("first.doc_id").alias("rep_id"),
        F.col("copies").alias("n_copies"),
        F.col("links").alias("n_links"),
        F.col("size").cast("long").alias("n_shingles"),
        (F.struct("doc_id", "row_hash") == F.col("head")).alias("keep"),
        "row_hash",
    )


def keep_one(docs: DataFrame, threshold: float = 0.8, width: int = 5, rows: int = 5, recall: float = 0.9995) -> DataFrame:
    """The rows that stay when one of each linked class is kept, with all their columns.

    Each row is decided by itself, also where rows share a doc_id. Of rows equal in doc_id and
    text one stays. Rows with a null doc_id can't be named and stay.
    """
    j = _joined(docs, threshold, width, rows, recall)
    marks = j.select(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row"), (F.struct("doc_id", "row_hash") == F.col("head")).alias("__keep"))
    gone = broadcast_if_small(materialize(marks.filter("not __keep").drop("__keep")))
    on = lambda m: (F.col("doc_id") == m["__doc"]) & (F.xxhash64("text") == m["__row"])
    kept = docs.join(gone, on(gone), "left_anti")
    keys = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__doc"), F.xxhash64("text").alias("__row")).count().filter("count > 1")
    twice = materialize(keys.drop("count"))
    if not twice.limit(1).count():
        return kept
    twice = broadcast_if_small(twice)
    once = kept.join(twice, on(twice), "left_semi").withColumn("__row", F.xxhash64("text")).dropDuplicates(["doc_id", "__row"]).drop("__row")
    return kept.join(twice, on(twice), "left_anti").union(once)
