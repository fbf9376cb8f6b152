"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once. The ledger holds the measurements and one bit per failed rule;
policies are masks over it, and ablations are bitwise aggregates of the stored bits.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE

#: Characters that count as symbols (fixed by the contract).
SYMBOLS = "#*$%&|<>"
#: Between words.
SPACES = r"[\x20\x09-\x0D]+"


#: Low bits of a packed window that hold its place; the others hold the top of its hash.
PLACE_BITS = 28


def _measurements(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Adds the measurements of the text to the ``keep`` columns.

    Repeated windows are found in two steps: hashes packed with their places into longs are sorted
    as primitives, neighbours with the same hash bits are suspects, and only suspects are compared
    by their full 64-bit hash.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(ASCII_SPACE)) != "")
    split = docs.select(
        *keep,
        text.alias("__text"),
        F.array_remove(F.split(text, SPACES), "").alias("__words"),
        lines.alias("__lines"),
    )
    words = F.col("__words")

    def window(i: Column) -> Column:
        return F.xxhash64(words[i], words[i + 1], words[i + 2])

    place = (1 << PLACE_BITS) - 1
    packed = F.when(
        F.size(words) >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: window(i).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("bigint")))),
    ).otherwise(F.array().cast("array<bigint>"))
    sorted_ = split.withColumn("__packed", packed).withColumn("__n", F.size("__packed"))
    p, n = F.col("__packed"), F.col("__n")

    def alike(x: Column, other: Column) -> Column:
        return F.shiftrightunsigned(x.bitwiseXOR(p[other]), PLACE_BITS) == 0

    suspects = F.filter(p, lambda x, k: ((k > 0) & alike(x, F.greatest(k - 1, F.lit(0)))) | ((k < n - 1) & alike(x, F.least(k + 1, n - 1))))
    compared = F.sort_array(
        F.transform(
            suspects,
            lambda x: F.struct(window(x.bitwiseAND(F.lit(place)).cast("int")).alias("h"), x.bitwiseAND(F.lit(place)).cast("int").alias("i")),
        )
    )
    checked = sorted_.withColumn("__windows", compared).withColumn("__k", F.size("__windows"))
    w, c = F.col("__windows"), F.col("__k")

    def repeats(x: Column, k: Column) -> Column:
        return ((k > 0) & (w[F.greatest(k - 1, F.lit(0))]["h"] == x["h"])) | ((k < c - 1) & (w[F.least(k + 1, c - 1)]["h"] == x["h"]))

    starts = F.sort_array(F.transform(F.filter(w, repeats), lambda x: x["i"]))
    found = checked.withColumn("__starts", starts).withColumn("__m", F.size("__starts"))
    s, m = F.col("__starts"), F.col("__m")
    # a window covers three words, less what the next repeated window covers
    covered = F.aggregate(
        F.transform(s, lambda x, k: F.when(k < m - 1, F.least(F.lit(3), s[F.least(k + 1, m - 1)] - x)).otherwise(3)),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )

    def count(pattern: str) -> Column:
        return F.regexp_count("__text", F.lit(pattern)).cast("long")

    return found.select(
        *keep,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.concat_ws("", "__words")).cast("long").alias("word_chars"),
        count(f"[{SYMBOLS}]").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.size("__lines").cast("long").alias("n_lines"),
        count("[A-Z]").alias("n_upper"),
        count("[!?]").alias("n_shouts"),
        count("[0-9]").alias("n_digits"),
    )


@dataclass(frozen=True)
class Rule:
    """A named failure condition over the measurements; its place in RULES is its bit."""

    name: str
    fails: str


#: The order fixes the bits: append, never reorder. Whole-number arithmetic, so results are exact.
RULES = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("symbols", "100 * n_symbols > 5 * word_chars"),
    Rule("duplicate_lines", "n_lines >= 4 and 100 * n_dup_lines > 40 * n_lines"),
    Rule("shouting", "100 * n_upper > 50 * word_chars"),
    Rule("exclamations", "100 * n_shouts > 10 * word_chars"),
    Rule("digits", "100 * n_digits > 30 * word_chars"),
)

#: Policy version -> names of the rules it applies.
POLICIES = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(r.name for r in RULES),
    "lenient": ("too_few_words", "repeated_windows", "symbols", "duplicate_lines"),
}


def policy_mask(policy: str, rules: tuple[Rule, ...] = RULES) -> int:
    chosen = set(POLICIES[policy])
    return sum(1 << i for i, r in enumerate(rules) if r.name in chosen)


def ledger(docs: DataFrame, keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns (doc_id by default), the measurements, and ``failed``: a bit per failed rule.

    Words are runs of other than ASCII white space; a null text has none. One row per row of
    ``docs``, decided by its own text alone.
    """
    measured = _measurements(docs, keep or ["doc_id"])
    bits = F.lit(0).cast("bigint")
    for i, r in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("failed", bits)


def apply_policy(entries: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed and kept: no rule of the policy failed, and no base rule."""
    base, own = policy_mask("base", rules), policy_mask(policy, rules)
    fails = lambda mask: F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")) != 0
    return entries.withColumn("base_failed", fails(base)).withColumn("kept", ~fails(base | own))


def ablations(entries: DataFrame, policy: str = "v1", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of the policy: documents that fail it, that fail it alone, and the policy's kept count.

    ``fails_alone`` is what the policy would gain without the rule. One row per distinct bit mask is
    left after the first aggregation, whatever the size of the ledger.
    """
    mask = policy_mask(policy, rules)
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask).cast("bigint")).alias("failed")).agg(F.count("*").alias("n"))
    named = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << i).cast("bigint").alias("bit")) for i, r in enumerate(rules) if mask >> i & 1]))
    return (
        masks.select("failed", "n", named.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(F.col("failed").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("fails"),
            F.sum(F.when(F.col("failed") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("fails_alone"),
            F.sum(F.when(F.col("failed") == 0, F.col("n")).otherwise(0)).alias("kept"),
            F.sum("n").alias("documents"),
        )
    )
