"""Source divergence audit: how the terms of each source differ from the other sources and from the language.

Strings are materialized late:

1. one pass over the texts writes partial counts (lang, source, digest, count, documents), with the
   term, once a flush, in a column of its own that the counting never reads;
2. only digests are shuffled and counted; a language keeps those in enough of its documents;
3. the least and the greatest term of each kept digest are taken, one row a digest and flush. Where they
   differ, digests collide: their rows, and no others, are counted again by term, and split;
4. shares, divergences and ranks are computed on digests; text is joined to what is returned.

Divergences of pairs of sources are sums over blocks of terms and of sources, so nothing is emitted
per term and pair, and no task holds more than ``TERMS`` terms of two blocks of ``SOURCES`` sources.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .neardup import broadcast_if_small

#: Terms and sources of a block of the pair sums.
TERMS, SOURCES = 2000, 256
#: Entries of partial counts (some 150 bytes each) that a task holds before it hands them on, and bytes of a text that are split at once.
HELD, SEGMENT = 1_000_000, 1 << 20
_DOCUMENT = 1 << 40  # an entry is so many times its documents, plus its occurrences

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
#: Bytes: A-Z lower-cased, all that is in no term a blank.
_TERM_BYTES = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if b in _LETTERS else 0x20 for b in range(256))
_PARTIAL = "lang string, source string, term string, head string, n long, docs long"
_ARROW = pa.schema([*[pa.field(c, pa.string()) for c in ("lang", "source", "term", "head")], pa.field("n", pa.int64()), pa.field("docs", pa.int64())])


def _terms(data: bytes):
    """Terms of a text as bytes, in lists of bounded length."""
    data = data.translate(_TERM_BYTES)
    at = 0
    while len(data) - at > SEGMENT:
        end = data.find(b" ", at + SEGMENT)
        if end < 0:
            break
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def partial_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """lang, source, digest, n, docs, and the texts: term, and head, which is the term in one row of it a flush and language.

    A task hands on its counts after 2^20 documents at the latest, which keeps them apart from occurrences.
    """

    def scan(batches):
        held: dict = {}
        documents = 0

        def rows():
            named: dict = {}
            for (lang, source), count in held.items():
                known = named.setdefault(lang, set())
                head = [None if t in known else t for t in count]
                known.update(count)
                text = [pa.repeat(pa.scalar(x, pa.binary()), len(count)) for x in (lang, source)]
                text = [x.cast(pa.string(), safe=False) for x in (*text, pa.array(list(count), pa.binary()), pa.array(head, pa.binary()))]
                both = np.fromiter(count.values(), dtype=np.int64, count=len(count))
                yield pa.record_batch([*text, pa.array(both % _DOCUMENT), pa.array(both // _DOCUMENT)], schema=_ARROW)

        for batch in batches:
            for i, (text, lang, source) in enumerate(zip(*(batch.column(c).cast(pa.binary()).to_pylist() for c in ("text", "lang", "source")))):
                count, own = held.setdefault((lang, source), Counter()), set()
                for terms in _terms(text):
                    count.update(terms)
                    own.update(terms)
                for t in own:
                    count[t] += _DOCUMENT
                documents += 1
                if documents >> 20 or i % 64 == 0 and sum(map(len, held.values())) > HELD:
                    yield from rows()
                    held, documents = {}, 0
        yield from rows()

    found = _named(docs).mapInArrow(scan, _PARTIAL)
    digest = F.xxhash64("term")
    return found.withColumn("digest", digest if bits == 64 else digest.bitwiseAND(F.lit((1 << bits) - 1)))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_counts(docs: DataFrame, at_least: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(counts, names) of the terms in at least so many documents of their language.

    counts: lang, source, digest, part, n; names: lang, digest, part, term. part is 0, or tells terms
    with one digest apart.
    """
    partials = materialize(partial_counts(docs, bits).drop("term"))
    enough = materialize(partials.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= at_least).select("lang", "digest"))
    some = broadcast_if_small(enough)
    ends = partials.filter("head is not null").join(some, ["lang", "digest"], "left_semi").groupBy("lang", "digest")
    ends = materialize(ends.agg(F.min("head").alias("term"), F.max("head").alias("last")))
    names = ends.filter("term = last").select("lang", "digest", F.lit(0).alias("part"), "term")
    counts = partials.join(broadcast_if_small(names.select("lang", "digest")), ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest")
    counts = counts.agg(F.sum("n").alias("n")).select("lang", "source", "digest", F.lit(0).alias("part"), "n")
    collided = ends.filter("term <> last").select("lang", "digest")
    if not collided.limit(1).count():
        return materialize(counts), names
    own = partial_counts(docs, bits).join(broadcast_if_small(collided), ["lang", "digest"], "left_semi").groupBy("lang", "source", "digest", "term")
    own = materialize(own.agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    apart = own.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= at_least)
    part = F.row_number().over(Window.partitionBy("lang", "digest").orderBy("term"))
    apart = materialize(apart.select("lang", "digest", part.alias("part"), "term"))
    split = own.join(apart, ["lang", "digest", "term"]).select("lang", "source", "digest", "part", "n")
    return materialize(counts.unionByName(split)), materialize(names.unionByName(apart))


def _share(n: str, total: str, terms: str):
    """1 + floor(10^9 (n + 5) / (total + 5 terms)), in exact decimals."""
    above = f"cast({n} + 5 as decimal(20,0)) * cast(1000000000 as decimal(10,0))"
    return F.expr(f"1 + ({above} div cast({total} + 5 * {terms} as decimal(20,0)))").cast("long")


def _differences(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, a, b (numbers of sources, a < b), extra: the sum of abs(p - q) - abs(p0 - q0) over the terms that one of them holds."""
    schema = "lang string, a int, b int, extra long"

    def add(key, pdf):
        lang, _, bi, bj = key
        base = pdf[pdf["digest"].isna()]
        rows = pdf[pdf["digest"].notna()]
        term = rows.groupby(["digest", "part"], sort=False).ngroup().to_numpy()
        number = base["number"].to_numpy()
        order = np.argsort(number)
        number, p0 = number[order], base["p"].to_numpy(dtype=np.int64)[order]
        dense = np.tile(p0, (int(term.max()) + 1 if len(term) else 0, 1))
        dense[term, np.searchsorted(number, rows["number"].to_numpy())] = rows["p"].to_numpy(dtype=np.int64)
        left, right = np.flatnonzero(number // SOURCES == bi), np.flatnonzero(number // SOURCES == bj)
        out = []
        for i in left:
            others = right[number[right] > number[i]] if bi == bj else right
            extra = np.abs(dense[:, others] - dense[:, i : i + 1]).sum(axis=0) - len(dense) * np.abs(p0[others] - p0[i])
            out.append(pd.DataFrame({"lang": lang, "a": np.minimum(number[i], number[others]), "b": np.maximum(number[i], number[others]), "extra": extra}))
        return pd.concat(out) if out else pd.DataFrame({"lang": [], "a": [], "b": [], "extra": []})

    chunk = F.pmod(F.xxhash64("digest", "part"), F.col("chunks"))
    of = groups.select("lang", "source", "number", "chunks", "blocks", "p0")
    rows = shares.join(of, ["lang", "source"]).select("lang", "number", "blocks", chunk.alias("chunk"), "digest", "part", "p")
    base = of.select("lang", "number", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(None).cast("long").alias("digest"), F.lit(0).alias("part"), F.col("p0").alias("p"))
    block = F.floor(F.col("number") / SOURCES).cast("int")
    dealt = rows.unionByName(base).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("bi", F.least(block, "other")).withColumn("bj", F.greatest(block, "other")).drop("other", "blocks")
    parts = dealt.groupBy("lang", "chunk", "bi", "bj").applyInPandas(add, schema)
    return parts.groupBy("lang", "a", "b").agg(F.sum("extra").alias("extra"))


def audit(docs: DataFrame, at_least: int = 30, top: int = 50, bits: int = 64) -> DataFrame:
    """Divergence of each (lang, source) group from the others of its language, and its most typical terms.

    Null lang, source and text count as ''. Terms are runs of letters A-Z, a-z and characters beyond
    ASCII, A-Z lower-cased; a language keeps the V terms in ``at_least`` of its documents (rows). With
    N the occurrences of kept terms in a group (or language), p = 1 + floor(10^9 (count + 5) / (N + 5 V)).

    Returns lang, source, part, item, value, rank. part ``pair``: item is each other source of the
    language, value the sum of abs(p - q) over all kept terms (0 if there are none). part ``term``:
    item is a kept term of the group with p over the language's q, value p - q, ranks up to ``top``. Ties
    go to the lesser item (UTF-8). A group without terms has its pairs; a lone source has none. An empty
    table gives no rows; extra columns are ignored. ``bits`` is the width of digests.
    """
    counts, names = kept_counts(docs, at_least, bits)
    sizes = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    vocabulary = names.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = _named(docs).select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.fillna(0, ["total", "terms"])
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("int")
    groups = groups.withColumn("number", number)
    groups = groups.withColumn("blocks", (F.floor(F.max("number").over(Window.partitionBy("lang")) / SOURCES) + 1).cast("int"))
    groups = groups.withColumn("chunks", F.greatest(F.lit(1), F.ceil(F.col("terms") / TERMS)).cast("long"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("terms") > 0, _share("0", "total", "terms")).otherwise(0).cast("long")))
    few = broadcast_if_small(groups.select("lang", "source", "total", "terms"))
    shares = materialize(counts.join(few, ["lang", "source"]).withColumn("p", _share("n", "total", "terms")).select("lang", "source", "digest", "part", "n", "p"))

    extra = materialize(_differences(shares.drop("n"), groups))
    a, b = (groups.select("lang", F.col("source").alias(f"source_{x}"), F.col("number").alias(x), F.col("p0").alias(f"p_{x}"), *(["terms"] if x == "a" else [])) for x in "ab")
    pairs = a.join(b, "lang").filter("a < b").join(extra, ["lang", "a", "b"], "left")
    value = F.col("terms") * F.abs(F.col("p_a") - F.col("p_b")) + F.coalesce("extra", F.lit(0))
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    pairs = pairs.select("lang", F.explode(both).alias("x"), value.alias("value")).select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    whole = shares.groupBy("lang", "digest", "part").agg(F.sum("n").alias("n_lang"))
    totals = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("terms").alias("terms"))
    whole = whole.join(broadcast_if_small(totals), "lang").select("lang", "digest", "part", _share("n_lang", "total", "terms").alias("q"))
    above = shares.filter("n > 0").join(whole, ["lang", "digest", "part"]).filter("p > q").select("lang", "source", "digest", "part", (F.col("p") - F.col("q")).alias("value"))
    tied = F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))
    typical = above.withColumn("r", tied).filter(F.col("r") <= top)
    typical = typical.join(names, ["lang", "digest", "part"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")

    order = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    listed = pairs.withColumn("rank", order).unionByName(typical.withColumn("rank", order).filter(F.col("rank") <= top))
    return listed.select("lang", "source", "part", "item", "value", "rank")
