"""The registered queries of the operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocation, cotrain, decontam, divergence, langid, linededup, mixing, ngramjoin, rules, substring, tokencount, topk, toxicity
from .common import held_out, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(parts: int, part: int) -> Column:
    """Whether a document is in the held-out fold; one without an id is in none."""
    return F.coalesce(held_out(F.col("doc_id"), parts, part), F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    scored = cotrain.score_quality(docs, pages, cotrain.train(docs, pages, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", _held_out(5, 0), "text_score", "meta_score", "score", "kept")


def op4_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.length_histogram(_table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs), ["doc_id"])
    return found.select("doc_id", _held_out(4, 2), "lang_pred", "score")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For both policies: what each rule drops, alone and together, from one ledger."""
    entries = materialize(rules.ledger(_table(spark, sf_dir, "documents")).select("failed"))
    each = [rules.ablations(entries, p).select(F.lit(p).alias("policy"), "rule", "fails", "fails_alone", "kept", "documents") for p in ("v1", "lenient")]
    return each[0].unionByName(each[1])


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return linededup.digest(docs, linededup.keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(_table(spark, sf_dir, "documents"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_join(_table(spark, sf_dir, "documents"))


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.scaled(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(_table(spark, sf_dir, "documents")).drop("k")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_quality, op4_tokens, op5_langid, op6_rules, rule_ablations, op7_decontam, op8_linededup, op9_substring, op10_jaccard, op11_topk, op12_collocations, op13_divergence)}

# Rule bits and thresholds are those of rules.RULES.
_OP6 = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), r AS (
  SELECT doc_id, unnest(positions) AS i FROM (SELECT doc_id, gram, list(i) AS positions FROM g GROUP BY ALL HAVING count(*) >= 2)
), c AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_shouts,
         length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS n_digits
  FROM w LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
         + 4 * (word_chars < 2 * n_words)::BIGINT + 8 * (word_chars > 15 * n_words)::BIGINT
         + 16 * (100 * n_symbols > 5 * word_chars)::BIGINT + 32 * (n_lines >= 4 AND 100 * n_dup_lines > 40 * n_lines)::BIGINT
         + 64 * (100 * n_upper > 50 * word_chars)::BIGINT + 128 * (100 * n_shouts > 10 * word_chars)::BIGINT
         + 256 * (100 * n_digits > 30 * word_chars)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed FROM f
"""

_OP8 = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), first AS (
  SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key
), kept AS (
  SELECT doc_id, pos, line, first IS NOT NULL AND doc_id > first AS gone FROM k LEFT JOIN first USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""

_MASKS = ", ".join(f"({1 << i}, '{r.name}', {str(r.name in rules.POLICIES['lenient']).lower()})" for i, r in enumerate(rules.RULES))
_ABLATIONS = f"""
WITH f AS ({_OP6}), r(bit, rule, lenient) AS (VALUES {_MASKS}),
p AS (SELECT 'v1' AS policy, bit, rule FROM r UNION ALL SELECT 'lenient', bit, rule FROM r WHERE lenient),
m AS (SELECT policy, sum(bit)::BIGINT AS mask FROM p GROUP BY 1)
SELECT policy, rule, count_if(failed & bit <> 0)::BIGINT AS fails, count_if(failed & mask = bit)::BIGINT AS fails_alone,
       count_if(failed & mask = 0)::BIGINT AS kept, count(*)::BIGINT AS documents
FROM f CROSS JOIN p JOIN m USING (policy) GROUP BY policy, rule
"""

_OP11 = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id OR q.v <> c.v WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

_OP12 = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), g AS (
  SELECT lang, s, array_to_string(w[i:i + s - 1], ' ') AS g FROM (SELECT lang, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM p CROSS JOIN (VALUES (1), (2), (3)) t(s) WHERE len(w) >= s)
), f AS MATERIALIZED (
  SELECT lang, s, g, count(*) AS f FROM g GROUP BY ALL
), t AS (
  SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang
), c AS MATERIALIZED (
  SELECT lang, s, g, f AS a, string_split(g, ' ') AS w FROM f WHERE s > 1 AND f >= 10
), gone AS (
  SELECT DISTINCT c.lang, c.g FROM c JOIN (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM c WHERE s = 3) b ON c.lang = b.lang AND c.g = b.g WHERE 100 * b.a >= 50 * c.a
), sides AS MATERIALIZED (
  SELECT *, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, s)) AS k FROM c)
), cuts AS (
  SELECT i.lang, i.g, i.a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * i.a * i.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM sides i JOIN f x ON x.lang = i.lang AND x.g = i.x JOIN f y ON y.lang = i.lang AND y.g = i.y
), best AS (
  SELECT * FROM cuts ANTI JOIN gone USING (lang, g) QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score
FROM best JOIN t USING (lang) QUALIFY rank <= 2000
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), w AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term FROM w WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT doc) >= 30
), v AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL
), g AS (
  SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL
), l AS (
  SELECT lang, sum(total) AS total FROM g GROUP BY lang
), p AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)::HUGEINT) // (total + 5 * v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(n) + 5)::HUGEINT) // (any_value(total) + 5 * any_value(v))::HUGEINT AS q
  FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term
), r AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(pa.p - pb.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p pa ON pa.lang = a.lang AND pa.source = a.source LEFT JOIN p pb ON pb.lang = b.lang AND pb.source = b.source AND pb.term = pa.term
  GROUP BY ALL
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM r QUALIFY part = 'pair' OR rank <= 50
"""

ORACLE_SQL = {"op11_topk": _OP11, "op12_collocations": _OP12, "op13_divergence": _OP13, "op6_rules": _OP6, "op8_linededup": _OP8, "rule_ablations": _ABLATIONS}
