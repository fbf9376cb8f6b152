"""Substring de-duplication: MinHash banding of paragraphs, verification, components of removals.

A passage may be pasted anywhere, so paragraphs are not lines but all windows of ``SPREAD + LENGTH - 1``
words. The MinHash of a paragraph is its least five-word shingle of ``SPREAD`` neighbouring ones; the
band key is the ``LENGTH`` words that begin there. Neighbouring paragraphs mostly share a MinHash, so
it is stored once, as an anchor. There are two bands. The first keys an anchor by ``LENGTH`` words and has
a recall of 1 for paragraphs that agree word for word: a passage of 50 words or more that agrees with
another in 0.8 of its five-word shingles holds one. The second keys by ``LONG`` words, and a passage of 51
words holds one of its anchors: what short pieces elsewhere can't answer for it is found by these.

1. anchors of all documents; those that several documents hold collide (:func:`places`);
2. collisions in a row with one document are aligned, and verified and extended word for word on
   both texts (:func:`aligned`);
3. aligned parts of a pair of places that are a few words apart are one run, which must agree in
   0.8 of its words (the edit distance that the alignment gives); overlapping runs are linked and
   the components of these links are the clusters.

An anchor that very many documents hold is only ever reduced to its least document, with map-side
combine, or joined, where adaptive execution splits a skewed key; it is never gathered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_RE, materialize, objects, unused
from .components import connected_components
from .neardup import broadcast_if_small
from .words import _MULT, chunks, folded, grams, hash_texts, inside

#: Words of a shingle, shingles whose least one is an anchor, and words of the band keys: LONG + SPREAD - 1 is 51.
SHINGLE, SPREAD, LENGTH, LONG = 5, 12, 12, 40
#: Words that an aligned part is extended by at most on either side.
CONTEXT = 60
#: Of anchors that repeat within ``LENGTH`` words (a b a b ...), one in so many words is followed.
STRIDE = 40
#: Words between parts of one run at most.
GAP = 16


def anchors(words: np.ndarray, owner: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Places and band keys of ``length`` words of the paragraphs' MinHashes."""
    key, ok = grams(words, length), inside(owner, length)
    least = grams(words, SHINGLE)[: len(key)].copy()
    whole = inside(owner, length + SPREAD - 1)
    if not len(whole):
        return np.empty(0, dtype=np.int64), key[:0]
    low = np.minimum.reduce([least[k : k + len(whole)] for k in range(SPREAD)])
    low[~whole] = 0
    high = np.zeros(len(least), dtype=np.uint64)
    for k in range(SPREAD):
        np.maximum(high[k : k + len(low)], low, out=high[k : k + len(low)])
    at = np.flatnonzero(ok & (high == least))
    return at, key[at]


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, row_hash (tells rows apart that share a doc_id) and text of the rows that can repeat something."""
    return docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text").filter("doc_id is not null and text is not null")


def places(docs: DataFrame) -> DataFrame:
    """Anchors that several doc_ids hold: doc_id, row_hash, pos, length (of its band key), and the least place: low, low_hash, at."""
    rows = _rows(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches):
        for pdf in batches:
            ids, marks = objects(pdf["doc_id"]), pdf["row_hash"].to_numpy()
            for run, words, counts in chunks(list(range(len(pdf))), list(pdf["text"])):
                owner = np.repeat(np.array(run), counts)
                first = np.repeat(np.cumsum(counts) - counts, counts)
                for length in (LENGTH, LONG):
                    at, key = anchors(words, owner, length)
                    yield pd.DataFrame({"h": key.view(np.int64), "doc_id": ids[owner[at]], "row_hash": marks[owner[at]], "pos": (at - first[at]).astype(np.int32), "length": np.full(len(at), length, dtype=np.int16)})

    held = materialize(rows.mapInPandas(scan, f"h long, doc_id {kind}, row_hash long, pos int, length short"))
    shared = held.groupBy("h").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("__last")).filter("low < __last").drop("__last")
    found = materialize(held.join(materialize(shared), "h"))  # written first, so that the join can split a key that very many documents hold
    least = found.filter("doc_id = low").groupBy("h").agg(F.min(F.struct("row_hash", "pos")).alias("l"))
    least = least.select("h", F.col("l.row_hash").alias("low_hash"), F.col("l.pos").alias("at"))
    return found.filter("doc_id <> low").join(broadcast_if_small(materialize(least)), "h").drop("h")


def aligned(docs: DataFrame) -> DataFrame:
    """Stretches that two documents hold word for word: doc_id, row_hash, start, n, low, low_hash, at.

    A chain of shared anchors of a band, at most its key's words apart, covers its stretch without a hole. It
    is compared as a whole and extended as far as both texts agree, ``CONTEXT`` words at most on either
    side.
    """
    row = Window.partitionBy("doc_id", "row_hash", "length").orderBy("pos")
    before = lambda c: F.lag(c).over(row)
    near = (F.col("pos") - before("pos") <= F.col("length")) & (F.col("low") == before("low")) & (F.col("low_hash") == before("low_hash"))
    # anchors that stand for one and the same place again and again: follow one in STRIDE words
    again = F.coalesce(near & (F.col("at") == before("at")), F.lit(False))
    p = places(docs).withColumn("again", again).withColumn("turn", F.sum((~F.col("again")).cast("long")).over(row))
    turn = Window.partitionBy("doc_id", "row_hash", "length", "turn").orderBy("pos")
    p = p.withColumn("step", F.floor((F.col("pos") - F.first("pos").over(turn)) / STRIDE))
    p = p.withColumn("moved", F.coalesce(F.col("step") != F.lag("step").over(turn), F.lit(True))).filter("moved")
    joined = F.coalesce(near & (F.col("pos") - F.col("at") == before(F.col("pos") - F.col("at"))), F.lit(False))
    chains = p.withColumn("joined", joined).withColumn("chain", F.sum((~F.col("joined")).cast("long")).over(row))
    chains = materialize(
        chains.groupBy("doc_id", "row_hash", "length", "chain", "low", "low_hash")
        .agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + F.col("length")).cast("int").alias("n"), F.min("at").alias("at"))
        .drop("length", "chain")
        .distinct()
    )
    asked = chains.select("doc_id", "row_hash", "start", "n").union(chains.select("low", "low_hash", "at", "n")).distinct()
    seen = _contexts(docs, asked)
    kind = docs.schema["doc_id"].dataType.simpleString()
    there = seen.select(
        F.col("doc_id").alias("low"), F.col("row_hash").alias("low_hash"), F.col("start").alias("at"), "n",
        F.col("whole").alias("whole2"), F.col("before").alias("before2"), F.col("after").alias("after2"),
    )
    both = chains.join(seen, ["doc_id", "row_hash", "start", "n"]).join(there, ["low", "low_hash", "at", "n"]).filter("whole = whole2")

    def agree(a: bytes, b: bytes, step: int) -> int:
        """Words that are equal from the start, or with a ``step`` of -1 from the end."""
        a, b = (np.frombuffer(x, dtype=np.uint32)[::step] for x in (a, b))
        m = min(len(a), len(b))
        other = np.flatnonzero(a[:m] != b[:m])
        return int(other[0]) if len(other) else m

    def extend(batches):
        for pdf in batches:
            left = np.array([agree(a, b, -1) for a, b in zip(pdf["before"], pdf["before2"])], dtype=np.int32)
            right = np.array([agree(a, b, 1) for a, b in zip(pdf["after"], pdf["after2"])], dtype=np.int32)
            out = pd.DataFrame({c: objects(pdf[c]) for c in ("doc_id", "row_hash", "start", "n", "low", "low_hash", "at")})
            out["start"] -= left
            out["at"] -= left
            out["n"] += left + right
            yield out

    grown = both.mapInPandas(extend, f"doc_id {kind}, row_hash long, start int, n int, low {kind}, low_hash long, at int")
    # the bands find the same stretches: what overlaps on one diagonal is one
    line = ["doc_id", "row_hash", "low", "low_hash", "shift"]
    grown = grown.withColumn("shift", F.col("at") - F.col("start"))
    order = Window.partitionBy(*line).orderBy("start", F.desc("n"))
    reach = F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    grown = grown.withColumn("apart", F.coalesce(F.col("start") > reach, F.lit(True))).withColumn("isle", F.sum(F.col("apart").cast("long")).over(order))
    grown = grown.groupBy(*line, "isle").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("int").alias("n"))
    return grown.select("doc_id", "row_hash", "start", "n", "low", "low_hash", (F.col("start") + F.col("shift")).cast("int").alias("at"))


def _contexts(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """For each stretch asked for: hash of all its words, and the words before and after it (32 bits each)."""
    wanted = asked.groupBy(F.col("doc_id").alias("__doc"), F.col("row_hash").alias("__row")).agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("asked"))
    rows = _rows(docs)
    rows = rows.join(broadcast_if_small(materialize(wanted)), (F.col("doc_id") == F.col("__doc")) & (F.col("row_hash") == F.col("__row")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    names = ["doc_id", "row_hash", "start", "n", "whole", "before", "after"]

    def scan(batches):
        for pdf in batches:
            out = []
            for doc, mark, text, stretches in zip(pdf["doc_id"], pdf["row_hash"], pdf["text"], pdf["asked"]):
                words, _ = hash_texts([folded(text)])
                short = (words >> np.uint64(32)).astype(np.uint32)
                power = np.cumprod(np.append(np.uint64(1), np.full(len(words), _MULT)))
                prefix = np.append(np.uint64(0), np.cumsum(words * power[:-1]))
                back = np.uint64(pow(int(_MULT), -len(words), 1 << 64))
                for s, n in ((x["start"], x["n"]) for x in stretches):
                    whole = (prefix[s + n : s + n + 1] - prefix[s]) * power[len(words) - s] * back  # as if the stretch began at power 0
                    out.append((doc, mark, s, n, int(whole.view(np.int64)[0]), short[max(0, s - CONTEXT) : s].tobytes(), short[s + n : s + n + CONTEXT].tobytes()))
                if len(out) >= 5000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    schema = f"doc_id {kind}, row_hash long, start int, n int, whole long, before binary, after binary"
    return materialize(rows.select("doc_id", "row_hash", "text", "asked").mapInPandas(scan, schema))


def repeated_runs(docs: DataFrame, least: int = 51, similar: float = 0.8) -> DataFrame:
    """Runs of aligned stretches: doc_id, row_hash, start, n_words, matched, low, low_hash, at, low_words.

    Stretches of one pair of documents that lie ``GAP`` words apart at most in both, in the same
    order, are one run. It counts when ``least`` of its words agree, and ``similar`` of the longer side.
    """
    a = materialize(aligned(docs))
    pair = Window.partitionBy("doc_id", "row_hash", "low", "low_hash").orderBy("start", "at")
    last = lambda c: F.lag(c).over(pair)
    here, there = F.col("start") - last(F.col("start") + F.col("n")), F.col("at") - last(F.col("at") + F.col("n"))
    on = F.coalesce(here.between(0, GAP) & there.between(0, GAP), F.lit(False))
    runs = a.withColumn("on", on).withColumn("run", F.sum((~F.col("on")).cast("long")).over(pair))
    found = runs.groupBy("doc_id", "row_hash", "low", "low_hash", "run").agg(
        F.min("start").alias("start"),
        (F.max(F.col("start") + F.col("n")) - F.min("start")).alias("n_words"),
        F.sum("n").alias("matched"),
        F.min("at").alias("at"),
        (F.max(F.col("at") + F.col("n")) - F.min("at")).alias("low_words"),
    )
    return found.filter((F.col("matched") >= least) & (F.col("matched") >= similar * F.greatest("n_words", "low_words"))).drop("run")


def substring_dedup(docs: DataFrame, min_words: int = 51, similar: float = 0.8) -> DataFrame:
    """Passages that repeat, exactly or nearly, in other documents, wherever they begin and across line ends.

    Words are runs of characters other than ASCII white space, lower-cased. A passage counts when
    another document (another doc_id) holds ``min_words`` of its words in the same order, and these are
    ``similar`` of the passage on both sides. A place is compared with the least document that holds its
    anchor, in each of two bands. So every passage that a document shares word for word with the least
    document holding one of its anchors is found in full length, but for passages that repeat themselves
    within a dozen words, which may end ``CONTEXT`` words early. Missed is only a passage each of whose
    anchors of ``LONG`` words some earlier document holds that shares no 51 words with it.

    Returns one row per passage: doc_id, row_hash (xxhash64 of the text; rows that share a doc_id but
    not a text are decided apart), start (number of its first word), n_words, matched, cluster_id (of
    all passages linked by overlap), kept_in and kept_at (document and word where the other place is;
    its own, where the text stays), removed (this place is not the least document). Rows equal in
    doc_id and text count once. Null doc_ids, null and empty texts and texts of fewer words have no row; an
    empty table gives none. Ties go to the least doc_id, then the least row_hash and place. Extra
    columns are ignored; doc_id may be of any type that has an order.
    """
    runs = materialize(repeated_runs(docs, min_words, similar))
    key = ["doc_id", "row_hash"]
    kept = runs.select(
        F.col("low").alias("doc_id"), F.col("low_hash").alias("row_hash"), F.col("at").alias("start"), F.col("low_words").alias("n_words"), F.col("matched"),
    ).groupBy(*key, "start", "n_words").agg(F.max("matched").alias("matched"))
    spans = runs.select(*key, "start", "n_words").union(kept.select(*key, "start", "n_words")).distinct()
    order = Window.partitionBy(*key).orderBy("start", F.desc("n_words"))
    reach = F.max(F.col("start") + F.col("n_words")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    # spans that overlap by more than half of the shorter are one island
    fresh = F.coalesce(reach - F.col("start") < F.lit(min_words // 2), F.lit(True))
    spans = spans.withColumn("fresh", fresh).withColumn("isle", F.sum(F.col("fresh").cast("long")).over(order))
    isles = spans.groupBy(*key, "isle").agg(F.min("start").alias("isle_start"))
    isles = materialize(isles.withColumn("node", F.monotonically_increasing_id()))
    spans = materialize(spans.join(isles, [*key, "isle"]).select(*key, "start", "n_words", "node", "isle_start"))
    side = spans.select(*key, "start", "n_words", F.col("node").alias("a"))
    low = spans.select(F.col("doc_id").alias("low"), F.col("row_hash").alias("low_hash"), F.col("start").alias("at"), F.col("n_words").alias("low_words"), F.col("node").alias("b"))
    edges = runs.join(side, [*key, "start", "n_words"]).join(low, ["low", "low_hash", "at", "low_words"]).select("a", "b")
    parts = connected_components(edges)
    names = spans.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = names.groupBy("root").agg(F.min(F.struct("doc_id", "row_hash", "isle_start")).alias("head"))
    names = names.join(materialize(heads), "root").select(*key, "start", "n_words", F.xxhash64("head").alias("cluster_id"))
    every = runs.select(*key, "start", "n_words", "matched", F.col("low").alias("kept_in"), F.col("at").alias("kept_at"), F.lit(True).alias("removed")).union(
        kept.select(*key, "start", "n_words", "matched", F.col("doc_id").alias("kept_in"), F.col("start").alias("kept_at"), F.lit(False).alias("removed"))
    )
    return every.join(names, [*key, "start", "n_words"]).select(
        "doc_id", "row_hash", F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.col("matched").cast("long").alias("matched"),
        "cluster_id", "kept_in", F.col("kept_at").cast("long").alias("kept_at"), "removed",
    )


def cut(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents with the removed passages cut out of ``text``; other columns stay."""
    doc, mark, ranges = unused(docs, "__doc", "__row", "__gone")
    gone = found.filter("removed").groupBy(F.col("doc_id").alias(doc), F.col("row_hash").alias(mark)).agg(F.collect_set(F.struct("start", "n_words")).alias(ranges))

    @F.pandas_udf("string")
    def without(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for text, stretches in zip(texts, gone):
            if text is not None and stretches is not None:
                at_word = [m.span() for m in WORD_RE.finditer(text)]
                ranges = sorted((at_word[x["start"]][0], at_word[x["start"] + x["n_words"] - 1][1]) for x in stretches)
                parts, at = [], 0
                for start, end in ranges:
                    parts.append(text[at:start])
                    at = max(at, end)
                text = "".join(parts) + text[at:]
            out.append(text)
        return pd.Series(out, dtype="object")

    joined = docs.join(gone, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(mark)), "left")
    return joined.withColumn("text", without("text", ranges)).select(*docs.columns)
