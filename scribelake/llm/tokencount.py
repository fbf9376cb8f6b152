"""Exact token counts as a length histogram with suffix sums."""

from __future__ import annotations

import base64
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Public byte-level BPE vocabulary in rank form; any file of that form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-split pattern that belongs to the vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Lengths that one group of the suffix sums holds.
SPAN = 4096


def _encoder(vocabulary: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, n_docs), already summed inside each batch of rows.

    The vocabulary file is read on the driver and broadcast (about a megabyte).
    """
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches):
        encode = _encoder(shared.value, pattern).encode_ordinary
        for pdf in batches:
            n = Counter(len(encode(t)) if t else 0 for t in pdf["text"])
            yield pd.DataFrame({"n_tokens": list(n), "n_docs": list(n.values())})

    return docs.select("text").mapInPandas(count, "n_tokens long, n_docs long")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per encoded length n_tokens that occurs, with what every context limit needs.

    n_docs documents have just that length. Suffix sums: docs_from and tokens_from count documents
    of that length or longer and their tokens. docs_to, tokens_to: that length or shorter.
    truncated_tokens: all tokens when every document is cut at this length. total_docs and
    total_tokens: the corpus. quantile: share of documents of that length or shorter.

    Null and empty texts have 0 tokens. Every row counts, repeated ids too. An empty table has no rows.
    """
    sums = encoded_lengths(docs, vocabulary, pattern).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    sums = sums.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("span", F.expr(f"n_tokens div {SPAN}"))
    # spans: one row for SPAN lengths, so the only ordered pass over all of them is short
    above = Window.orderBy(F.desc("span"))
    spans = sums.groupBy("span").agg(F.sum("n_docs").alias("sd"), F.sum("tokens").alias("st"))
    spans = spans.select(
        "span",
        (F.sum("sd").over(above) - F.col("sd")).alias("docs_above"),
        (F.sum("st").over(above) - F.col("st")).alias("tokens_above"),
        F.sum("sd").over(Window.partitionBy(F.lit(1))).alias("total_docs"),
        F.sum("st").over(Window.partitionBy(F.lit(1))).alias("total_tokens"),
    )
    inside = Window.partitionBy("span").orderBy(F.desc("n_tokens"))
    out = sums.join(F.broadcast(spans), "span").select(
        "n_tokens",
        "n_docs",
        (F.sum("n_docs").over(inside) + F.col("docs_above")).alias("docs_from"),
        (F.sum("tokens").over(inside) + F.col("tokens_above")).alias("tokens_from"),
        "tokens",
        "total_docs",
        "total_tokens",
    )
    docs_to = F.col("total_docs") - F.col("docs_from") + F.col("n_docs")
    tokens_to = F.col("total_tokens") - F.col("tokens_from") + F.col("tokens")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        docs_to.alias("docs_to"),
        tokens_to.alias("tokens_to"),
        (tokens_to + F.col("n_tokens") * (F.col("docs_from") - F.col("n_docs"))).alias("truncated_tokens"),
        (docs_to / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for given context limits, whether or not a document has just that length."""
    fits = F.col("n_tokens") <= F.col("context_limit")
    return (
        histogram.select("n_tokens", "n_docs", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
        .groupBy("context_limit")
        .agg(
            F.sum(F.when(fits, F.col("n_docs")).otherwise(0)).alias("docs_whole"),
            F.sum(F.when(~fits, F.col("n_docs")).otherwise(0)).alias("docs_cut"),
            F.sum(F.least("n_tokens", "context_limit") * F.col("n_docs")).alias("tokens_kept"),
        )
    )
