"""Registered queries: text functions and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import text as tx
from scribelake.operators import search
from scribelake.operators.shared import shared_path
from scribelake.operators.trigrams import TrigramIndex
from scribelake.streaming import feeds, stores

from .roles import DOCUMENTS_SQL, LEDGER_SQL, QUERIES_SQL, Book, benchmark_queries, documents, ledger, streamed, table

BOOK = Book()
_FIELDS = {"title": 50.0, "requester": 25.0, "full_markdown": 10.0}
_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _ns(column: str) -> str:
    return f"lower(regexp_replace({column}, '{_SPACES}', '', 'g'))"


def _score(field: str, terms: list[str]) -> str:
    w = _FIELDS[field]
    return " + ".join(f"CASE WHEN contains(n_{field}, '{t}') THEN {w} ELSE 0 END" for t in terms)


_NORMAL = "n AS (SELECT *, " + ", ".join(f"{_ns(f)} AS n_{f}" for f in _FIELDS) + " FROM docs)"
_either = lambda t: f"(contains(n_title, '{t}') OR contains(n_full_markdown, '{t}'))"
_HAS = lambda t: "(" + " OR ".join(f"contains(n_{f}, '{t}')" for f in _FIELDS) + ")"


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, {_NORMAL}, f AS (
  SELECT doc_id, full_markdown, ({_score('title', ['thering', 'than'])} + {_score('requester', ['thering', 'than'])} + {_score('full_markdown', ['thering', 'than'])})::DOUBLE AS score
  FROM n WHERE {_HAS('thering')} AND {_HAS('than')} AND NOT {_HAS('licensed')})
SELECT doc_id, score, CASE WHEN p > 0 THEN (CASE WHEN greatest(p - 60, 1) > 1 THEN '…' ELSE '' END) || substr(full_markdown, greatest(p - 60, 1)::BIGINT, (least(p + len - 1 + 60, length(full_markdown)) - greatest(p - 60, 1) + 1)::BIGINT)
       || (CASE WHEN least(p + len - 1 + 60, length(full_markdown)) < length(full_markdown) THEN '…' ELSE '' END) ELSE substr(full_markdown, 1, 120) END AS snippet
FROM (SELECT *, CASE WHEN instr(lower(full_markdown), 'thering') > 0 THEN instr(lower(full_markdown), 'thering') ELSE instr(lower(full_markdown), 'than') END AS p,
             CASE WHEN instr(lower(full_markdown), 'thering') > 0 THEN 7 ELSE 4 END AS len FROM f ORDER BY score DESC, doc_id LIMIT 20)""")
def search_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query: two terms, one exclusion, field weights, best 20 with snippets (a top-k report)."""
    docs = documents(spark, sf_dir)
    q = spark.range(1).select(F.col("id").alias("query_id"), F.lit("thering than -licensed").alias("query"))
    best = search.batch_search(docs, q, _FIELDS, k=20)
    return search.with_snippets(best.select("doc_id", "score"), docs, ["thering", "than"], "full_markdown")


_BATCH = f"""WITH {DOCUMENTS_SQL}, {_NORMAL}, {QUERIES_SQL},
t AS (SELECT doc_id, 'title' AS field, 50.0 AS weight, n_title AS x FROM n UNION ALL SELECT doc_id, 'requester', 25.0, n_requester FROM n UNION ALL SELECT doc_id, 'full_markdown', 10.0, n_full_markdown FROM n),
hits AS (SELECT query_id, group_no, term_no, doc_id, field, weight FROM t JOIN terms ON contains(x, v)),
got AS (SELECT query_id, doc_id, group_no, count(DISTINCT term_no) AS c, sum(weight) AS w FROM hits GROUP BY ALL)
"""


@BOOK.query(_BATCH + "SELECT query_id, doc_id, sum(w)::DOUBLE AS score FROM got GROUP BY ALL HAVING bool_or((group_no = 0 AND c = 2) OR (group_no = 1 AND c = 1))")
def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item as a query of OR groups over all documents, by one scan."""
    return search.batch_search(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), _FIELDS)


@BOOK.query(_BATCH + "SELECT query_id, doc_id, sum(w)::DOUBLE AS score FROM got GROUP BY ALL HAVING bool_or((group_no = 0 AND c = 2) OR (group_no = 1 AND c = 1))")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same queries by a trigram index that is built over all documents: the same rows."""
    docs = documents(spark, sf_dir)
    index = TrigramIndex.build(search.search_text(docs, _FIELDS), shared_path(spark))
    return search.batch_search(docs, benchmark_queries(spark, sf_dir), _FIELDS, index=index)


@BOOK.query(_BATCH + """, s AS (SELECT query_id, doc_id, sum(w)::DOUBLE AS score FROM got GROUP BY ALL HAVING bool_or((group_no = 0 AND c = 2) OR (group_no = 1 AND c = 1)))
SELECT query_id, count(DISTINCT doc_id)::BIGINT AS result_count FROM (SELECT query_id FROM asked) LEFT JOIN s USING (query_id) GROUP BY query_id""")
def search_result_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query-log rows of the batch."""
    q = benchmark_queries(spark, sf_dir)
    return search.query_log(search.batch_search(documents(spark, sf_dir), q, _FIELDS), q).select("query_id", "result_count")


_BM25 = f"""WITH {DOCUMENTS_SQL}, n AS (SELECT doc_id, {_ns('title')} AS n_title, {_ns('full_markdown')} AS n_full_markdown FROM docs), {QUERIES_SQL},
x AS (SELECT doc_id, 5.0 AS weight, n_title AS x FROM n WHERE n_title <> '' UNION ALL SELECT doc_id, 1.0, n_full_markdown FROM n WHERE n_full_markdown <> ''),
sizes AS (SELECT doc_id, sum(length(x)) AS size FROM x GROUP BY 1), totals AS (SELECT count(*) AS n, avg(size) AS mean FROM sizes),
tf AS (SELECT query_id, group_no, term_no, doc_id, sum(weight * ((length(x) - length(replace(x, v, ''))) // length(v))) AS tf FROM x JOIN terms ON contains(x, v) GROUP BY ALL),
df AS (SELECT query_id, group_no, term_no, count(*) AS df FROM tf GROUP BY ALL),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 2)::DOUBLE AS score
      FROM tf JOIN df USING (query_id, group_no, term_no) JOIN sizes USING (doc_id) CROSS JOIN totals GROUP BY ALL)
SELECT query_id, doc_id, score FROM s"""


@BOOK.query(_BM25)
def search_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with field weights in the term frequency."""
    found = search.bm25(documents(spark, sf_dir), benchmark_queries(spark, sf_dir), {"title": 5.0, "full_markdown": 1.0})
    return found.select("query_id", "doc_id", F.round("score", 2).alias("score"))


@BOOK.query(_BM25)
def bm25_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 from the trigram index: the texts are read for candidates, lengths come with the index."""
    docs, fields = documents(spark, sf_dir), {"title": 5.0, "full_markdown": 1.0}
    index = TrigramIndex.build(search.search_text(docs, fields), shared_path(spark))
    found = search.bm25(docs, benchmark_queries(spark, sf_dir), fields, index=index)
    return found.select("query_id", "doc_id", F.round("score", 2).alias("score"))


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, {_NORMAL} SELECT doc_id, requester FROM n WHERE (({_either('ering')} AND {_either('theth')}) OR {_either('ation')}) AND NOT {_either('licensed')}""")
def search_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OR of ANDs with an exclusion as one filter."""
    return search.plan_filter(documents(spark, sf_dir), [["ering", "theth"], ["ation"]], ["title", "full_markdown"], without=("licensed",)).select("doc_id", "requester")


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, {_NORMAL} SELECT doc_id FROM n WHERE contains(n_full_markdown, 'ofthe')""")
def search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, white space ignored."""
    return search.plan_filter(documents(spark, sf_dir), [], ["full_markdown"], phrases=("of the",)).select("doc_id")


@BOOK.query(f"""WITH {DOCUMENTS_SQL} SELECT doc_id, title FROM docs WHERE requester IN ('src1', 'src2') AND contains({_ns('full_markdown')}, 'ofthe')""")
def search_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field qualifiers: whole value for one, substring for the other."""
    rows = documents(spark, sf_dir).withColumn("status", F.col("requester")).withColumn("department", F.col("full_markdown"))
    return search.field_filter(rows, {"상태": ["src1", "src2"], "department": ["of the"]}).select("doc_id", "title")


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, {_NORMAL}, s AS (SELECT doc_id, CASE WHEN {_HAS('thering')} AND {_HAS('than')} THEN
  {' + '.join(f"CASE WHEN n_title = '{t}' THEN 60.0 WHEN contains(n_title, '{t}') THEN 35.0 ELSE 0 END + CASE WHEN contains(n_requester, '{t}') THEN 30.0 ELSE 0 END + CASE WHEN contains(n_full_markdown, '{t}') THEN 8.0 ELSE 0 END" for t in ('thering', 'than'))} END AS score FROM n)
SELECT doc_id, score::DOUBLE AS score FROM s WHERE score IS NOT NULL""")
def search_browser_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the best OR group under the browser's weights."""
    found = search.browser_score(documents(spark, sf_dir), [["thering", "than"]], columns=("title", "requester", "full_markdown"))
    return found.select("doc_id", "score")


@BOOK.query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'license') AND contains(lower(text), 'public')""")
def search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older listing: every word in some column."""
    return search.words_filter(documents(spark, sf_dir), "license public", ["title", "full_markdown"], None).select("doc_id")


_KINDS = f"""x AS (SELECT 'qa' AS kind, conv_id || '-' || turn AS key, role AS title, text AS body FROM conversations UNION ALL SELECT 'docs', doc_id::VARCHAR, source, text FROM documents UNION ALL SELECT 'ledger', item_id::VARCHAR, 'item', text FROM benchmark),
hit AS (SELECT kind, key, title, CASE WHEN contains({_ns('title')}, 'item') THEN 50.0 ELSE 0 END + CASE WHEN contains({_ns('body')}, 'thering') THEN 10.0 ELSE 0 END + CASE WHEN contains({_ns('body')}, 'item') THEN 10.0 ELSE 0 END AS score,
  contains({_ns('body')}, 'thering') OR contains({_ns('body')}, 'item') OR contains({_ns('title')}, 'item') AS found FROM x)"""


def _kinds(spark: SparkSession, sf_dir: str) -> dict:
    q = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("key"), F.col("role").alias("title"), F.col("text").alias("body"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.col("source").alias("title"), F.col("text").alias("body"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("key"), F.lit("item").alias("title"), F.col("text").alias("body"))
    return {k: (rows, "key", {"title": 50.0, "body": 10.0}, "title") for k, rows in (("qa", q), ("docs", d), ("ledger", b))}


@BOOK.query(f"WITH {_KINDS} SELECT kind, 0 AS query_id, key, title, score::DOUBLE AS score FROM hit WHERE found")
def search_federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three kinds of rows searched at once, in one shape."""
    asked = spark.createDataFrame([(0, "thering OR item")], "query_id int, query string")
    return search.federated(asked, _kinds(spark, sf_dir))


@BOOK.query(f"WITH {_KINDS} SELECT kind, count(*)::BIGINT AS n FROM hit WHERE found GROUP BY 1")
def search_federated_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the search of all kinds by kind."""
    return search_federated(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, n AS (SELECT doc_id, {_ns('title')} AS n_title, {_ns('full_markdown')} AS n_full_markdown FROM docs),
w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^0-9A-Za-z_가-힣]+')) AS word, generate_subscripts(regexp_split_to_array(lower(text), '[^0-9A-Za-z_가-힣]+'), 1) AS i FROM benchmark),
f AS (SELECT item_id, word, min(i) AS i FROM w WHERE length(word) >= 2 AND word NOT IN ('the', 'and', 'of', 'to', 'in') GROUP BY ALL),
k AS (SELECT item_id, word, row_number() OVER (PARTITION BY item_id ORDER BY i) AS place FROM f QUALIFY place <= 4),
h AS (SELECT item_id AS query_id, doc_id, count(DISTINCT word)::BIGINT AS hits, sum(CASE WHEN contains(n_title, word) THEN 35.0 ELSE 0 END + CASE WHEN contains(n_full_markdown, word) THEN 8.0 ELSE 0 END)::DOUBLE AS score
      FROM k JOIN n ON contains(n_title, word) OR contains(n_full_markdown, word) GROUP BY ALL)
SELECT query_id, doc_id, hits, score, row_number() OVER (PARTITION BY query_id ORDER BY hits DESC, score DESC, doc_id)::INT AS rank FROM h QUALIFY rank <= 5""")
def similar_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Past documents for each test item taken as a request (a top-k report)."""
    requests = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.col("text").alias("title"))
    return search.similar_answers(requests, documents(spark, sf_dir), ["the", "and", "of", "to", "in"], {"title": 35.0, "full_markdown": 8.0})


_ASKED = ["requester:src1 department:en thering", "department:fr -que", "-the", '"of the" licensed OR thering', "status:없음 the", ""]


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, n AS (SELECT doc_id, requester, topic_tags, {_ns('title')} AS t, {_ns('requester')} AS r, {_ns('full_markdown')} AS b FROM docs),
has AS (SELECT *, contains(b, 'thering') OR contains(r, 'thering') AS thering, contains(b, 'licensed') AS licensed, contains(b, 'ofthe') AS ofthe FROM n)
SELECT 0 AS query_id, doc_id, (CASE WHEN contains(t, 'thering') THEN 50 ELSE 0 END)::DOUBLE AS score FROM has WHERE thering AND contains(r, 'src1') AND topic_tags = 'en'
UNION ALL SELECT 1, doc_id, 0 FROM has WHERE topic_tags = 'fr' AND NOT contains(b, 'que')
UNION ALL SELECT 2, doc_id, 0 FROM has WHERE NOT contains(b, 'the')
UNION ALL SELECT 3, doc_id, CASE WHEN contains(t, 'ofthe') THEN 100 ELSE 0 END + CASE WHEN contains(t, 'licensed') THEN 50 ELSE 0 END + CASE WHEN contains(t, 'thering') THEN 50 ELSE 0 END FROM has WHERE ofthe AND (licensed OR thering)
UNION ALL SELECT 5, doc_id, 0 FROM has""")
def search_qualifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Qualifiers, exclusions alone, phrases with groups, a field that isn't there, and the empty query, over all documents."""
    docs = documents(spark, sf_dir).withColumn("department", F.col("topic_tags"))
    asked = spark.createDataFrame(list(enumerate(_ASKED)), "query_id int, query string")
    return search.batch_search(docs, asked, {"title": 50.0, "requester": 25.0, "full_markdown": 0.0})


@BOOK.query(f"""WITH {LEDGER_SQL}, n AS (SELECT *, {_ns('title')} AS t FROM ledger)
SELECT 0 AS query_id, ledger_id, 50.0::DOUBLE AS score FROM n WHERE contains(t, 'urgent') AND request_date BETWEEN '1995-03-01' AND '1995-05-31'
UNION ALL SELECT 1, ledger_id, 0 FROM n WHERE request_date >= '1998-01-01' AND party = 'BUILDING'
UNION ALL SELECT 2, ledger_id, 50 FROM n WHERE contains(t, 'high') AND request_date BETWEEN '1994-01-01' AND '1994-12-31' AND status = '완료'
UNION ALL SELECT 3, ledger_id, 0 FROM n WHERE seq_no IN ('7', '33')""")
def search_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date ranges, open at one end or none, with other qualifiers, over all requests."""
    asked = ["기간:1995-03..1995.5 urgent", "date:1998.. 정당:building", "일자:1994 상태:완료 high", "연번:7 seq:33"]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    return search.batch_search(ledger(spark, sf_dir), q, {"title": 50.0, "requester": 25.0}, "ledger_id")


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, p AS (SELECT doc_id, coalesce(full_markdown, '') AS x, CASE WHEN instr(lower(full_markdown), 'thering') > 0 THEN instr(lower(full_markdown), 'thering') - 1 WHEN instr(lower(full_markdown), 'than') > 0 THEN instr(lower(full_markdown), 'than') - 1 END AS pos,
  CASE WHEN instr(lower(full_markdown), 'thering') > 0 THEN 7 ELSE 4 END AS n FROM docs WHERE contains(lower(full_markdown), 'the')),
s AS (SELECT *, CASE WHEN pos IS NOT NULL THEN greatest(pos - 60, 0) END AS a, CASE WHEN pos IS NOT NULL THEN least(pos + n + 60, length(x)) END AS z, regexp_replace(left(x, 300), '^{_SPACES}+|{_SPACES}+$', '', 'g') AS head FROM p),
e AS (SELECT *, (CASE WHEN a > 0 THEN '…' ELSE '' END) || regexp_replace(substr(x, a + 1, z - a), '^{_SPACES}+|{_SPACES}+$', '', 'g') || (CASE WHEN z < length(x) THEN '…' ELSE '' END) AS part FROM s)
SELECT doc_id, CASE WHEN pos IS NULL THEN head || (CASE WHEN length(x) > length(head) THEN '…' ELSE '' END) ELSE part END AS snippet, coalesce(a, -1)::INT AS "start",
  coalesce(CASE WHEN pos IS NOT NULL THEN least(z, a + length(part)) END, -1)::INT AS "end", CASE WHEN pos IS NULL THEN length(x) > length(head) ELSE z < length(x) END AS truncated FROM e""")
def agent_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snippets of hits with their ranges."""
    docs = documents(spark, sf_dir)
    found = search.words_filter(docs, "the", ["full_markdown"], None).select("doc_id")
    hits = search.agent_snippets(found, docs, "a thering than", "full_markdown")
    return hits.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("start", "end")})


@BOOK.query("""SELECT doc_id, instr(lower(text), 'lic') > 0 AS hit, CASE WHEN instr(lower(text), 'thering') = 0 AND instr(lower(text), 'licensed') = 0 THEN substr(text, 1, 140) ELSE
  substr(text, greatest(p - 40, 1)::BIGINT, (p + 100 - greatest(p - 40, 1))::BIGINT) END AS snippet
FROM (SELECT *, list_min(list_filter([instr(lower(text), 'thering'), instr(lower(text), 'licensed')], lambda x: x > 0)) AS p FROM documents)
WHERE instr(lower(text), 'thering') > 0 OR instr(lower(text), 'licensed') > 0""")
def earliest_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text around the earliest of several tokens."""
    d = table(spark, sf_dir, "documents").filter(F.lower("text").contains("thering") | F.lower("text").contains("licensed"))
    return d.select("doc_id", (F.instr(F.lower("text"), "lic") > 0).alias("hit"), tx.earliest_snippet("text", ["thering", "licensed"]).alias("snippet"))


@BOOK.query("""SELECT doc_id, regexp_replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?i)(?:o\\s*f\\s*t\\s*h\\s*e|licensed|l\\s*i\\s*c\\s*e\\s*n\\s*s\\s*e\\s*d)', '<mark>\\0</mark>', 'g') AS marked FROM documents""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of a query marked in whole texts."""
    terms = tx.highlight_terms('"ofthe" licensed -that year:2020 | x')
    return table(spark, sf_dir, "documents").select("doc_id", tx.highlight("text", terms).alias("marked"))


@BOOK.query(f"SELECT doc_id, {_ns('text')} AS normal, length({_ns('text')})::BIGINT AS n FROM documents")
def text_nospace(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", tx.nospace_lower("text").alias("normal"))
    return d.select("doc_id", "normal", F.length("normal").cast("long").alias("n"))


@BOOK.query()
def text_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with phone numbers, resident numbers and e-mail addresses masked."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", tx.mask_pii("text").alias("masked"))
    return d.select("doc_id", "masked", (F.col("masked") != F.col("text")).alias("changed"))


@BOOK.query("SELECT doc_id, 'sha256:' || sha256(text) AS hash FROM documents")
def text_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash("text").alias("hash"))


@BOOK.query(r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' '))::BIGINT AS n FROM pages")
def text_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of pages without tags."""
    return table(spark, sf_dir, "pages").select("page_id", F.length(tx.cell_text("html", 10_000_000)).cast("long").alias("n"))


@BOOK.query("SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r]') THEN chr(39) || t ELSE t END AS cell FROM (SELECT doc_id, substr(text, 1, 1000) AS t FROM documents)")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.csv_cell("text").alias("cell"))


@BOOK.query("SELECT doc_id, ((length(text) - length(replace(lower(text), 'the', ''))) // 3)::BIGINT AS n FROM documents")
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a needle occurs, from its positions."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.match_positions("text", "the")).cast("long").alias("n"))


_LOG = "log AS (SELECT event_type AS query, floor(value / 4)::BIGINT AS result_count, value AS elapsed_ms, ts AS searched_at, user_id FROM events)"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a query log."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("query"), F.floor(F.col("value") / 4).alias("result_count"), F.col("value").alias("elapsed_ms"), F.col("ts").alias("searched_at"), "user_id")


@BOOK.query(f"""WITH {_LOG}, p AS (SELECT query || ' ' || user_id AS query, result_count, elapsed_ms, searched_at, user_id % 2 = 0 AS used_index FROM log WHERE searched_at >= TIMESTAMP '2024-01-05 00:00:00'),
g AS (SELECT query, count(*)::BIGINT AS n, count_if(coalesce(result_count, 0) = 0)::BIGINT AS zero, max(elapsed_ms) AS slowest, round(avg(elapsed_ms), 4) AS mean_ms, count_if(used_index)::BIGINT AS index_hits, max(searched_at) AS last_at, max(searched_at) FILTER (WHERE coalesce(result_count, 0) = 0) AS last_zero FROM p GROUP BY 1)
SELECT * FROM (SELECT 'popular' AS report, query, n, n::DOUBLE AS value, mean_ms, index_hits, strftime(last_at, '%Y-%m-%d %H:%M:%S') AS last_at FROM g ORDER BY n DESC, query LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'empty', query, zero, zero::DOUBLE, mean_ms, index_hits, strftime(last_zero, '%Y-%m-%d %H:%M:%S') FROM g WHERE zero > 0 ORDER BY zero DESC, last_zero DESC, query LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'slow', query, n, slowest, mean_ms, index_hits, strftime(last_at, '%Y-%m-%d %H:%M:%S') FROM g WHERE slowest IS NOT NULL ORDER BY slowest DESC, query LIMIT 10)""")
def query_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports on a query log since a day: most used, most often empty, slowest (top-k reports)."""
    log = _log(spark, sf_dir).withColumn("query", F.concat_ws(" ", "query", F.col("user_id").cast("string"))).withColumn("used_index", F.col("user_id") % 2 == 0)
    return search.query_insights(log, "2024-01-05 00:00:00").withColumns({"mean_ms": F.round("mean_ms", 4), "last_at": F.date_format("last_at", "yyyy-MM-dd HH:mm:ss")})


@BOOK.query(f"""WITH {_LOG} SELECT user_id, query, rank FROM (SELECT user_id, query, row_number() OVER (PARTITION BY user_id ORDER BY max(searched_at) DESC, query)::INT AS rank FROM log WHERE length(trim(query)) >= 5 GROUP BY user_id, query) WHERE rank <= 3""")
def recent_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest different queries of each user, of five characters or more, three at most."""
    return search.recent_queries(_log(spark, sf_dir), 3, least=5)


@BOOK.query(f"""WITH {_LOG} SELECT date_trunc('day', searched_at)::TIMESTAMP AS "start", query, count(*)::BIGINT AS n, count_if(result_count = 0)::BIGINT AS zero, max(elapsed_ms) AS slowest FROM log GROUP BY ALL""")
def log_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streaming report on the query log, run over all of it: a row a day and query."""
    return feeds.log_insights(_log(spark, sf_dir).withColumnRenamed("searched_at", "ts"))


@BOOK.query(f"""WITH {_LOG}, d AS (SELECT date_trunc('day', searched_at)::DATE AS "day", query, count(*) AS n, count_if(coalesce(result_count, 0) = 0) AS zero, count(elapsed_ms) AS timed, sum(elapsed_ms) AS total, max(elapsed_ms) AS slowest, max(searched_at) AS last FROM log WHERE searched_at IS NOT NULL GROUP BY 1, 2)
SELECT "day"::VARCHAR AS "day", query, (sum(n) OVER w)::BIGINT AS n, (sum(zero) OVER w)::BIGINT AS zero, round(sum(total) OVER w / sum(timed) OVER w, 4) AS mean_ms, max(slowest) OVER w AS slowest, max(last) OVER w AS last
FROM d WINDOW w AS (PARTITION BY query ORDER BY "day" RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW)""")
def rolling_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A week's report up to each day, from daily parts that a stream over the log keeps."""
    at = shared_path(spark)
    rows = streamed(spark, sf_dir, "events", f"{at}/events")
    log = rows.select(F.col("event_type").alias("query"), F.floor(F.col("value") / 4).alias("result_count"), F.col("value").alias("elapsed_ms"), F.col("ts").cast("timestamp").alias("ts"))
    parts = stores.BucketedTable(spark, f"{at}/parts", feeds.DAILY, "part", buckets=8)
    feeds.insights_feed(log, parts, f"{at}/checkpoint").awaitTermination()
    return feeds.rolling_insights(parts.read(), 7).withColumn("day", F.col("day").cast("string")).withColumn("mean_ms", F.round("mean_ms", 4)).withColumn("last", F.col("last").cast("timestamp_ntz"))


@BOOK.query(f"""WITH {_LOG} SELECT query, user_id, result_count FROM log WHERE searched_at >= TIMESTAMP '2024-01-06 00:00:00' OR result_count = 0""")
def pruned_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of the query log: newer rows, and those without a result."""
    return feeds.prune_log(_log(spark, sf_dir).withColumnRenamed("searched_at", "ts"), "2024-01-06 00:00:00").select("query", "user_id", "result_count")


_BROWSER = ["thering OR than", "the|of", "thering | licensed", '"of the" OR thering', '"of the" -licensed. OR zzz', "than -re,", "OR than"]


@BOOK.query(f"""WITH {DOCUMENTS_SQL}, n AS (SELECT doc_id, {_ns('title')} AS t, {_ns('full_markdown')} AS b FROM docs), q(query_id, one, two, phrase, without) AS (VALUES
  (0, 'thering', 'than', NULL, NULL), (1, 'the|of', NULL, NULL, NULL), (2, 'thering', 'licensed', NULL, NULL), (3, 'thering', NULL, 'ofthe', NULL), (4, NULL, NULL, 'ofthe', 'licensed.'), (5, 'than', NULL, NULL, 're,'), (6, 'than', NULL, NULL, NULL)),
h AS (SELECT query_id, doc_id, contains(t, one) AS t1, contains(t, two) AS t2, contains(t, phrase) AS tp, contains(b, one) OR contains(t, one) AS h1, contains(b, two) OR contains(t, two) AS h2, contains(b, phrase) OR contains(t, phrase) AS hp,
  contains(b, without) OR contains(t, without) AS hw, contains(b, 'or') OR contains(t, 'or') AS h_or, contains(t, 'or') AS t_or, one IS NULL AS none FROM q CROSS JOIN n)
SELECT query_id, doc_id, (CASE WHEN t1 THEN 50 ELSE 0 END + CASE WHEN t2 THEN 50 ELSE 0 END + CASE WHEN tp THEN 100 ELSE 0 END + CASE WHEN query_id = 6 AND t_or THEN 50 ELSE 0 END)::DOUBLE AS score
FROM h WHERE (none OR h1 OR coalesce(h2, FALSE)) AND coalesce(hp, TRUE) AND NOT coalesce(hw, FALSE) AND (query_id <> 6 OR h_or)""")
def search_browser_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries read by the browser's grammar, over all documents."""
    asked = spark.createDataFrame(list(enumerate(_BROWSER)), "query_id int, query string")
    return search.batch_search(documents(spark, sf_dir), asked, {"title": 50.0, "full_markdown": 0.0}, browser=True)
