"""Language identification with bit-sliced Bloom filters of character n-grams.

One Bloom filter per language, stored slice-wise: a slot holds one bit per language, eight
languages to a byte plane. A look-up ANDs the slots of an n-gram and so returns the mask of all
languages that contain it. Per-language popcounts of those masks, corrected for each filter's
false-positive rate, decide.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, mix64, pieces, sample_share

SIZES = (2, 3, 4, 5)
_P = np.uint64(0x100000001B3)
_FOLD: np.ndarray | None = None


def _fold() -> np.ndarray:
    """Code point -> lower-case code point of a letter, 0 for anything else."""
    global _FOLD
    if _FOLD is None:
        table = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _FOLD = table
    return _FOLD


def gram_hashes(texts: list[str]):
    """Yields (row, hash) arrays of the n-grams of each size.

    N-grams lie inside a word and may hold its boundary at either end. Every letter is in one.
    """
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    raw = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    cps = _fold()[raw]
    row = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    keep = cps != 0
    keep[1:] |= cps[:-1] != 0  # a run of non-letters is one boundary
    cps, row = cps[keep].astype(np.uint64), row[keep]
    cps = np.concatenate([np.zeros(1, dtype=np.uint64), cps])
    row = np.concatenate([np.zeros(1, dtype=np.int32), row])
    letter = cps != 0
    h, inside = cps.copy(), np.ones(len(cps), dtype=bool)
    for n in range(2, SIZES[-1] + 1):
        m = len(cps) - n + 1
        if m <= 0:
            return
        h = h[:m] * _P + cps[n - 1 :]
        if n > 2:
            inside = inside[:m] & letter[n - 2 : n - 2 + m]
        else:
            inside = inside[:m] & (letter[:m] | letter[1:])
        at = np.flatnonzero(inside)
        # the second character is in the row that owns the gram, also where the first is a boundary
        own = np.where(letter[at + 1], row[at + 1], row[at])
        yield own, mix64(h[at] + np.uint64(n))


@dataclass(frozen=True)
class LanguageModel:
    """Languages in order of their training rows, and the byte planes of the sliced filters."""

    languages: tuple[str, ...]
    planes: np.ndarray
    hashes: int

    def false_positive_rates(self) -> np.ndarray:
        rates = [np.count_nonzero(p & np.uint8(1 << b)) / len(p) for p in self.planes for b in range(8)]
        return np.array(rates[: len(self.languages)]) ** self.hashes

    def masks(self, h: np.ndarray) -> np.ndarray:
        """Byte planes x n-grams: the languages that contain each n-gram."""
        size = np.uint64(self.planes.shape[1] - 1)
        first, step = h & size, (h >> np.uint64(32)) | np.uint64(1)
        out = self.planes[:, first]
        for j in range(1, self.hashes):
            out = out & self.planes[:, (first + np.uint64(j) * step) & size]
        return out


def train(
    docs: DataFrame,
    sample_rows: int = 20_000,
    slots: int = 1 << 22,
    hashes: int = 3,
    relative: float = 0.2,
    fold: tuple[int, int] | None = (4, 2),
    floor: int = 1_000,
    least: int = 2,
    most_languages: int = 1_000,
) -> LanguageModel:
    """Fit on a seeded sample of labelled documents, taken from each language apart.

    ``sample_rows`` are shared out evenly, but each language gives ``floor`` documents or all it has, so a
    rare language is learned in a corpus of any size; one with fewer than ``least`` documents has no n-gram.
    An n-gram is put into a language's filter if at least ``least`` of its sampled documents hold it, in a
    sample of any size, and its document
    rate is at least ``relative`` of the highest among the languages. Rows with a null or empty lang, a
    null text, or in the held-out ``fold`` (parts, part) are not used; equal rows count each; an empty
    table gives a model without languages. ``slots`` must be a power of two; with the number of
    languages it bounds what is broadcast, so over ``most_languages`` different lang values are an error.
    """
    spark = docs.sparkSession
    known = docs.filter("coalesce(lang, '') <> '' and text is not null")
    if fold:
        known = known.filter(~F.coalesce(held_out(F.col("doc_id"), *fold), F.lit(False)))
    counted = known.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(counted) > most_languages:
        raise ValueError(f"over {most_languages} lang values: clean the column first")
    counts = {r["lang"]: r["n"] for r in counted}
    languages = tuple(sorted(counts, key=lambda x: (-counts[x], x)))
    planes = np.zeros(((len(languages) + 7) // 8, slots), dtype=np.uint8)
    if not languages:
        return LanguageModel((), planes, hashes)
    number = {x: i for i, x in enumerate(languages)}
    bound = max(floor, sample_rows // len(languages))

    def grams(batches):
        for pdf in batches:
            found: dict[int, list[np.ndarray]] = {}
            for start, run in pieces(pdf["text"]):
                langs = pdf["number"].to_numpy()[start : start + len(run)]
                for row, h in gram_hashes(run):
                    order = np.lexsort((h, row))
                    row, h = row[order], h[order]
                    new = np.ones(len(h), dtype=bool)
                    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                    row, h = row[new], h[new]
                    for k in np.unique(langs[row]):
                        found.setdefault(int(k), []).append(h[langs[row] == k])
            for k, parts in found.items():
                h, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "lang": np.full(len(h), k), "n": n})

    shares = spark.createDataFrame([(x, number[x], sample_share(counts[x], bound)) for x in languages], "__lang string, number int, share int")
    joined = known.join(F.broadcast(shares), F.col("lang") == F.col("__lang"))
    sampled = materialize(joined.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("lang")), F.lit(1_000_000)) < F.col("share")).select("text", "number"))
    per_lang = {r["number"]: r["n"] for r in sampled.groupBy("number").agg(F.count("*").alias("n")).collect()}
    rows = [max(1, per_lang.get(i, 0)) for i in range(len(languages))]
    of = F.array(*[F.lit(float(n)) for n in rows])
    counted = sampled.mapInPandas(grams, "h long, lang int, n long").groupBy("h", "lang").agg(F.sum("n").alias("n"))
    by_gram = counted.select("h", "lang", "n", (F.col("n") / F.get(of, F.col("lang"))).alias("rate")).groupBy("h").agg(F.max("rate").alias("top"), F.collect_list(F.struct("lang", "n", "rate")).alias("langs"))
    chosen = F.filter("langs", lambda x: (x["n"] >= least) & (x["rate"] >= relative * F.col("top")))
    bit = lambda p: lambda acc, x: acc.bitwiseOR(F.when(F.floor(x["lang"] / 8) == p, F.pow(F.lit(2), x["lang"] % 8).cast("int")).otherwise(0))
    bits = by_gram.select("h", chosen.alias("langs")).filter("size(langs) > 0")
    first, step = F.col("h").bitwiseAND(F.lit(slots - 1)), F.shiftrightunsigned("h", 32).bitwiseOR(F.lit(1))
    at = F.array(*[(first + F.lit(j) * step).bitwiseAND(F.lit(slots - 1)) for j in range(hashes)])
    names = [f"m{p}" for p in range(len(planes))]
    masks = [F.aggregate("langs", F.lit(0), bit(p)).alias(names[p]) for p in range(len(planes))]
    by_slot = bits.select(at.alias("at"), *masks).select(F.explode("at").alias("slot"), *names).groupBy("slot").agg(*[F.bit_or(m).alias(m) for m in names])
    chunk = max(1, slots // 64)

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        at = (pdf["slot"] % chunk).to_numpy()
        out = {"chunk": [int(pdf["slot"].iloc[0] // chunk)]}
        for m in names:
            plane = np.zeros(chunk, dtype=np.uint8)
            plane[at] = pdf[m].to_numpy()
            out[m] = [plane.tobytes()]
        return pd.DataFrame(out)

    packed = by_slot.groupBy(F.expr(f"slot div {chunk}").alias("c")).applyInPandas(pack, "chunk long, " + ", ".join(f"{m} binary" for m in names))
    for r in packed.toLocalIterator():  # 64 rows of slots / 64 bytes a plane
        for p, m in enumerate(names):
            planes[p, r["chunk"] * chunk : (r["chunk"] + 1) * chunk] = np.frombuffer(r[m], dtype=np.uint8)
    return LanguageModel(languages, planes, hashes)


def _bit_table() -> np.ndarray:
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def language_udf(spark: SparkSession, model: LanguageModel):
    """text -> struct(lang_pred, score, n_grams), with the model broadcast once (planes x slots bytes)."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, n_grams long")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m, bits = shared.value, _bit_table()
        rates = m.false_positive_rates()
        for texts in batches:
            n = len(texts)
            hits, grams = np.zeros((n, len(m.languages))), np.zeros(n)
            for start, run in pieces(texts.fillna("")):
                for row, h in gram_hashes(run):
                    grams[start : start + len(run)] += np.bincount(row, minlength=len(run))
                    for p, mask in enumerate(m.masks(h) if m.languages else ()):
                        by_mask = np.bincount(row.astype(np.int64) * 256 + mask, minlength=256 * len(run)).reshape(len(run), 256)
                        own = min(8, len(m.languages) - 8 * p)
                        hits[start : start + len(run), 8 * p : 8 * p + own] += (by_mask @ bits)[:, :own]
            known = (grams > 0) & bool(m.languages)
            if not m.languages:
                best, top = np.zeros(n, dtype=int), np.zeros(n)
            else:
                share = np.clip((hits / np.maximum(grams, 1)[:, None] - rates) / np.maximum(1 - rates, 1e-9), 0, 1)
                best, top = share.argmax(axis=1), share.max(axis=1)
            yield pd.DataFrame({
                "lang_pred": [m.languages[b] if k else "und" for b, k in zip(best, known)],
                "score": np.where(known, top, 0.0),
                "n_grams": grams.astype(np.int64),
            })

    return score


def predict(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with lang_pred, score and n_grams.

    lang_pred is ``und`` for a null text or one without a letter (and where nothing was learned).
    score is the corrected share of the text's n-grams that the chosen language's filter holds; ties
    go to the language with more training rows. The text is read in full, in runs of bounded size.
    """
    found = docs.select(*keep, language_udf(docs.sparkSession, model)("text").alias("__found"))
    return found.select(*keep, "__found.lang_pred", "__found.score", "__found.n_grams")


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.3) -> DataFrame:
    """The documents, columns unchanged, whose language is known with a score of ``least`` or more.

    Rejected are null texts, texts without letters, and texts most of whose n-grams no language
    holds. A row is decided by its own text, so rows that share an id don't affect each other.
    """
    found = language_udf(docs.sparkSession, model)("text")
    return docs.filter((found["lang_pred"] != "und") & (found["score"] >= least))
