"""Line de-duplication: range-partitioned line hashes, first occurrences streamed, keep bitmaps.

Line hashes are dealt out by range of (hash, document, position) and sorted inside each partition,
so a hash that very many documents hold spans several partitions instead of filling one. Each
partition streams its runs and knows the first document of every run that begins inside it; only
its leading run may have begun earlier. Those runs, two a partition at most, are settled by a
minimum over the partitions.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, materialize, objects, unused
from .neardup import broadcast_if_small


def _strip(line: Column) -> Column:
    return F.btrim(line, F.lit(ASCII_SPACE))


def _fold(line: Column) -> Column:
    """A-Z lower-cased, other letters untouched. lower() does just that to an ASCII line, and faster."""
    other = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(line.rlike(r"[^\x00-\x7F]"), other).otherwise(F.lower(line))


def _row_id() -> Column:
    """Tells rows apart that share a doc_id but not a text."""
    return F.xxhash64("text")


def dropped_positions(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """(doc_id, row_hash, pos) of every line that goes."""
    lines = (
        docs.select("doc_id", _row_id().alias("row_hash"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
        .filter(F.col("doc_id").isNotNull())
        .select("doc_id", "row_hash", "pos", _fold(_strip(F.col("line"))).alias("line"))
        .filter(F.length("line") >= min_chars)
        .select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("2"), "line").alias("h2"), "doc_id", "row_hash", "pos")
    )
    # written first: dealing by range reads its input twice, once for the ranges
    sorted_lines = materialize(lines).repartitionByRange("h1", "h2", "doc_id", "pos").sortWithinPartitions("h1", "h2", "doc_id", "pos")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def stream(batches):
        """kind 0: the line goes. 1: line of the leading run, open. 2: first document of the last run."""
        key = first = lead = None
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2, doc = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), objects(pdf["doc_id"])
            new = np.ones(len(pdf), dtype=bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if key is None:
                lead = (h1[0], h2[0])
            elif key == (h1[0], h2[0]):
                new[0] = False
            start = np.maximum.accumulate(np.where(new, np.arange(len(pdf)), -1))
            run_first = np.where(start >= 0, doc[np.maximum(start, 0)], doc[0] if first is None else first)
            open_ = (h1 == lead[0]) & (h2 == lead[1])
            kind = np.where(open_, 1, np.where(doc > run_first, 0, -1))
            key, first = (h1[-1], h2[-1]), run_first[-1]
            goes = np.flatnonzero(kind >= 0)
            yield pd.DataFrame({c: objects(pdf[c])[goes] for c in pdf.columns} | {"kind": kind[goes]})
        if key is not None and key != lead:
            yield pd.DataFrame({"h1": [key[0]], "h2": [key[1]], "doc_id": [first], "row_hash": [0], "pos": [0], "kind": [2]})

    found = materialize(sorted_lines.mapInPandas(stream, f"h1 long, h2 long, doc_id {kind}, row_hash long, pos int, kind int"))
    # at most two keys a partition have rows here, so the minima are few
    firsts = found.filter("kind > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("first"))
    opened = found.filter("kind = 1").join(F.broadcast(firsts), ["h1", "h2"]).filter("doc_id > first")
    return found.filter("kind = 0").select("doc_id", "row_hash", "pos").union(opened.select("doc_id", "row_hash", "pos"))


def pack_bits(dropped) -> bytes:
    """Deflated keep bitmap: bit i is 1 if line i stays. Lines after the last dropped one have no bit or 1."""
    dropped = np.asarray(dropped, dtype=np.int64)
    keep = np.ones((int(dropped.max()) // 8 + 1) * 8, dtype=np.uint8)
    keep[dropped] = 0
    return zlib.compress(np.packbits(keep, bitorder="little").tobytes(), 6)


def unpack_bits(bitmap: bytes, n_lines: int) -> np.ndarray:
    """Whether each of ``n_lines`` lines stays."""
    raw = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8), bitorder="little")[:n_lines]
    return np.concatenate([raw, np.ones(n_lines - len(raw), dtype=np.uint8)]).astype(bool)


def keep_bitmaps(docs: DataFrame, min_chars: int = 10) -> DataFrame:
    """Compressed keep bitmap of every document that loses a line.

    Lines are split at ``\\n``. Their key is the line without ASCII white space at its ends and with
    A-Z lower-cased. A key of ``min_chars`` code points or more stays only in the least doc_id that
    holds it, there with all its lines. Returns doc_id, row_hash (xxhash64 of the text: rows that
    share a doc_id but not a text have a bitmap each), n_dropped, bitmap (see :func:`unpack_bits`). Documents that
    lose nothing, null and empty texts and rows with a null doc_id have none; an empty table gives none.
    Of equal lines of one document, all stay or all go; doc_id may be of any type that has an order.
    """
    lost = dropped_positions(docs, min_chars).groupBy("doc_id", "row_hash").agg(F.collect_set("pos").alias("gone"))

    @F.pandas_udf("binary")
    def packed(gone: pd.Series) -> pd.Series:
        return pd.Series([pack_bits(g) for g in gone], dtype="object")

    return lost.select("doc_id", "row_hash", F.size("gone").cast("long").alias("n_dropped"), packed("gone").alias("bitmap"))


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    """Joins bitmaps to their rows, under a name that is returned; where few documents lose lines no text is shuffled."""
    doc, mark, bitmap = unused(docs, "__doc", "__hash", "__bitmap")
    marks = bitmaps.select(F.col("doc_id").alias(doc), F.col("row_hash").alias(mark), F.col("bitmap").alias(bitmap))
    marks = broadcast_if_small(materialize(marks), 200_000)
    return docs.join(marks, (F.col("doc_id") == F.col(doc)) & (_row_id() == F.col(mark)), "left"), bitmap


def _kept_text(text: str | None, bitmap: bytes | None) -> tuple[str, int, int]:
    """Text that stays, lines before, lines dropped."""
    lines = (text or "").split("\n")
    if bitmap is None:
        return text or "", len(lines), 0
    stays = unpack_bits(bitmap, len(lines))
    return "\n".join(x for x, k in zip(lines, stays) if k), len(lines), int(len(lines) - stays.sum())


def digest(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text, one row per row of ``docs``."""

    @F.pandas_udf("n_lines long, n_dropped long, kept_sha256 string")
    def kept(texts: pd.Series, bitmaps: pd.Series) -> pd.DataFrame:
        out = []
        for t, b in zip(texts, bitmaps):
            text, n, gone = _kept_text(t, b)
            out.append((n, gone, hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
        return pd.DataFrame(out, columns=["n_lines", "n_dropped", "kept_sha256"])

    joined, bitmap = _with_bitmaps(docs.select("doc_id", "text"), bitmaps)
    return joined.select("doc_id", bitmap, kept("text", bitmap).alias("k")).select("doc_id", "k.n_lines", "k.n_dropped", "k.kept_sha256", F.col(bitmap).alias("keep_bitmap"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, drop_empty: bool = True) -> DataFrame:
    """The documents with their dropped lines gone; other columns stay.

    With ``drop_empty``, documents that lost lines and have no word left go too.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
        return pd.Series([t if b is None else _kept_text(t, b)[0] for t, b in zip(texts, bitmaps)], dtype="object")

    joined, bitmap = _with_bitmaps(docs, bitmaps)
    out = joined.withColumn("text", kept("text", bitmap))
    if drop_empty:
        out = out.filter(F.col(bitmap).isNull() | (F.btrim("text", F.lit(ASCII_SPACE)) != ""))
    return out.select(*docs.columns)
