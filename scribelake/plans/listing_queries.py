"""Registered queries: pages, look-ups, histories, views, set differences, sources and sinks."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions import dates as dt
from scribelake.functions import text as tx
from scribelake.operators import ledger as op
from scribelake.operators.shared import shared_path
from scribelake.operators import listing
from scribelake.sources import readers, sinks
from scribelake.streaming import feeds

from .roles import AS_OF, DUE_SQL, HISTORY_SQL, LEDGER_SQL, Book, history, ledger, table

BOOK = Book()


@BOOK.query(f"""WITH {LEDGER_SQL}, n AS (SELECT ledger_id, year, row_number() OVER (PARTITION BY year ORDER BY request_date DESC, ledger_id)::BIGINT AS place FROM ledger) SELECT ledger_id, year, place, ((place - 1) // 50)::BIGINT AS page FROM n""")
def ledger_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of each year at once."""
    rows = ledger(spark, sf_dir).select("ledger_id", "year", "request_date")
    return listing.numbered_pages(rows, ["year"], [F.desc("request_date"), "ledger_id"], 50).select("ledger_id", "year", "place", "page")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, request_date, TRUE AS has_next FROM ledger WHERE request_date < '1998-03-01' OR (request_date = '1998-03-01' AND ledger_id > 40) ORDER BY request_date DESC, ledger_id LIMIT 50""")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a cursor; the asked size is over the bound."""
    rows = ledger(spark, sf_dir).select("ledger_id", "request_date")
    return listing.keyset_page(rows, [("request_date", True), ("ledger_id", False)], {"request_date": "1998-03-01", "ledger_id": 40}, "400")


@BOOK.query("""WITH a AS (SELECT doc_id, (doc_id % 3000)::INT AS "offset", (doc_id % 2500 - 5)::INT AS n FROM documents)
SELECT doc_id, substr(text, "offset" + 1, greatest(least(n, 2000), 1)) AS excerpt, CASE WHEN "offset" + greatest(least(n, 2000), 1) < length(text) THEN ("offset" + greatest(least(n, 2000), 1))::INT ELSE -1 END AS next_offset,
  length(text)::INT AS total_chars, 'sha256:' || sha256(text) AS hash FROM documents JOIN a USING (doc_id)""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excerpts of documents by offset and size, with the offset that follows."""
    d = table(spark, sf_dir, "documents")
    asked = d.select("doc_id", (F.col("doc_id") % 3000).cast("int").alias("offset"), (F.col("doc_id") % 2500 - 5).cast("int").alias("max_chars"))
    return listing.excerpts(d, asked, "doc_id", "text").withColumn("next_offset", F.coalesce("next_offset", F.lit(-1)))


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, title FROM ledger WHERE ledger_id = 7 AND status <> '[삭제]'""")
def look_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request by its key."""
    return listing.look_up(ledger(spark, sf_dir), "ledger_id", 7).select("ledger_id", "title")


@BOOK.query(f"""WITH {HISTORY_SQL} SELECT history_id, ledger_id, action, changed_at FROM history ORDER BY history_id DESC LIMIT 1000""")
def history_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest changes of all items; the asked number is over the bound."""
    return listing.history_listing(history(spark, sf_dir), limit=5000).select("history_id", "ledger_id", "action", "changed_at")


@BOOK.query(f"""WITH {HISTORY_SQL} SELECT history_id, action FROM history WHERE ledger_id = 8 ORDER BY history_id DESC LIMIT 20""")
def item_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest changes of one item, as agents ask for them."""
    return listing.history_listing(history(spark, sf_dir), 8, None, (1, 100, 20)).select("history_id", "action")


@BOOK.query(f"""WITH {LEDGER_SQL}, {DUE_SQL}, f AS (SELECT ledger_id, year, seq_no, due FROM due WHERE year = '1997' AND due <> 'done') SELECT ledger_id, (SELECT count(*) FROM f)::BIGINT AS total FROM (SELECT * FROM due WHERE year = '1997' AND due <> 'done' ORDER BY request_date DESC, seq_no DESC, ledger_id LIMIT 30)""")
def ledger_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open requests of a year, with their number before paging."""
    return listing.ledger_listing(ledger(spark, sf_dir), AS_OF, "1997", "ALL", "open", 30).select("ledger_id", "total")


_VIEW = """v AS (SELECT doc_id, source AS institution, lang || ' topic' AS topic_tags, split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, '|') THEN 'Y' ELSE 'N' END AS has_tables,
  CASE WHEN doc_id % 3 = 0 THEN lang || ' 팀' ELSE '' END AS department, source || ' 담당' AS contact_person FROM documents)"""


def _view(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    d = table(spark, sf_dir, "documents")
    docs = d.select(
        "doc_id", F.col("source").alias("institution"), F.concat("lang", F.lit(" topic")).alias("topic_tags"), F.substring_index("text", "\n", 1).alias("title"), F.when(F.col("text").contains("|"), "Y").otherwise("N").alias("has_tables"),
        F.when(F.col("doc_id") % 3 == 0, F.concat("lang", F.lit(" 팀"))).otherwise("").alias("department"), F.concat("source", F.lit(" 담당")).alias("contact_person"),
    )
    return {"docs": docs, "qa": docs, "ledger": ledger(spark, sf_dir)}


@BOOK.query(f"""WITH {_VIEW} SELECT doc_id FROM v WHERE has_tables = 'Y' AND contains(institution, 'src1') AND (contains(topic_tags, 'en topic') OR contains(replace(lower(title), ' ', ''), 'entopic'))""")
def view_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of documents with tables, by institution and topic."""
    return listing.view(_view(spark, sf_dir), "tables", institution="SRC 1", topic="en topic").select("doc_id")


@BOOK.query(f"""WITH {_VIEW} SELECT doc_id FROM v WHERE (CASE WHEN department <> '' THEN department ELSE contact_person END) IN ('fr 팀', 'src2 담당') AND doc_id % 2 = 0 AND contains(replace(CASE WHEN department <> '' THEN department ELSE contact_person END, ' ', ''), 'src2담')""")
def view_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites by department; where it is empty the contact counts."""
    tables = _view(spark, sf_dir)
    favourites = tables["docs"].filter("doc_id % 2 = 0").select("doc_id")
    return listing.view(tables, "docs", department="src2 담", favourites=favourites).select("doc_id")


@BOOK.query(f"""WITH {LEDGER_SQL}, {DUE_SQL} SELECT ledger_id FROM due ORDER BY CASE due WHEN 'overdue' THEN 0 WHEN 'soon' THEN 1 WHEN 'later' THEN 2 ELSE 4 END, deadline, ledger_id LIMIT 40""")
def order_deadline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows in the browser's order of deadlines (a top-k report)."""
    rows = ledger(spark, sf_dir)
    return rows.orderBy(*listing.browser_order(rows, "deadline", AS_OF)).limit(40).select("ledger_id")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id FROM ledger ORDER BY request_date DESC, ledger_id LIMIT 40""")
def order_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest rows in the browser's order (a top-k report)."""
    rows = ledger(spark, sf_dir)
    return rows.orderBy(*listing.browser_order(rows, "newest")).limit(40).select("ledger_id")


@BOOK.query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 3 = 0), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 5 = 0)
SELECT coalesce(a.k, b.k) AS o_custkey, CASE WHEN b.k IS NULL THEN 'left only' WHEN a.k IS NULL THEN 'right only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""")
def set_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of two stores: in the left, the right, or both."""
    o = table(spark, sf_dir, "orders")
    return listing.set_report(o.filter("o_orderkey % 3 = 0"), o.filter("o_orderkey % 5 = 0"), "o_custkey")


@BOOK.query("""SELECT o_orderkey AS ledger_id, CASE WHEN o_orderkey % 4 = 3 THEN 'only in sheet' WHEN o_orderkey % 2 = 0 AND o_orderkey % 7 = 0 THEN 'deleted in table' ELSE 'only in table' END AS state FROM orders
WHERE o_orderkey % 4 = 3 OR (o_orderkey % 2 = 0 AND o_orderkey % 7 = 0) OR (o_orderkey % 4 = 1 AND o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0)""")
def sheet_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet against the table: only here, only there, or deleted there."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ledger_id"))
    k = F.col("ledger_id")
    stored = o.filter("ledger_id % 4 <> 3").select(k, F.when(k % 7 == 0, "[삭제]").otherwise("").alias("status"), F.when(k % 3 == 0, "시스템").otherwise("서면").alias("request_type"))
    return listing.sheet_report(o.filter("ledger_id % 4 in (0, 2, 3)"), stored)


@BOOK.query("""SELECT event_id::VARCHAR AS operation_id, event_id AS seq, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS origin FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0""")
def union_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of two queues, each once; the first queue goes before."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("operation_id"), F.col("event_id").alias("seq"))
    return listing.union_queues(e.filter("seq % 2 = 0").withColumn("origin", F.lit("a")), e.filter("seq % 3 = 0").withColumn("origin", F.lit("b")))


@BOOK.query("""SELECT c_custkey AS id, '20' || lpad((c_custkey % 40)::VARCHAR, 2, '0') || '-0' || (1 + c_custkey % 9) || '-15' AS day FROM customer""")
def ledger_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in the forms that people type, read."""
    k = F.col("c_custkey")
    y, m = F.lpad((k % 40).cast("string"), 2, "0"), (k % 9 + 1).cast("string")
    forms = [F.concat(F.lit("20"), y, F.lit(". "), m, F.lit(". 15.")), F.concat(F.lit("20"), y, F.lit("년 "), m, F.lit("월 15일 (월요일)")), F.concat(F.lit("20"), y, F.lit("0"), m, F.lit("15")), F.concat(F.lit("0"), m, F.lit("15")), F.concat(m, F.lit("/15(금)"))]
    typed = F.get(F.array(*forms), (k % 5).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), dt.normalize_ledger_date(typed, F.concat(F.lit("20"), y), AS_OF).alias("day"))


@BOOK.query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN '2024-02-01' WHEN 1 THEN '2024-01-01' WHEN 2 THEN '2024-02-07' ELSE '' END AS low,
  CASE c_custkey % 4 WHEN 0 THEN '2024-02-29' WHEN 1 THEN '2024-12-31' WHEN 2 THEN '2024-02-07' ELSE '' END AS high FROM customer""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of dates as the first and last day they cover."""
    typed = F.get(F.array(F.lit("2024.2"), F.lit("2024"), F.lit("2024-2-7"), F.lit("x")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), dt.normalize_date(typed).alias("low"), dt.normalize_date(typed, True).alias("high"))


@BOOK.query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'soon' WHEN 1 THEN 'overdue' WHEN 2 THEN 'none' ELSE 'later' END AS due FROM customer""")
def typed_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Due states of deadlines as people type them."""
    typed = F.get(F.array(F.lit("2001.8.5"), F.lit("2001/7/1 (일)"), F.lit("미정"), F.lit("2001-12-1")), (F.col("c_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), dt.due_state(typed, F.lit(""), AS_OF).alias("due"))


_SHEETS = """o AS (SELECT *, strftime(o_orderdate, '%Y') AS year FROM orders WHERE strftime(o_orderdate, '%Y') IN ('1995', '1996'))"""


@BOOK.query(f"""WITH {_SHEETS} SELECT year, o_orderkey::VARCHAR AS seq_no, o_orderpriority AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS requester, year || '-0' || (1 + o_orderkey % 9) || '-05' AS deadline FROM o""")
def ledger_extracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracts of two years with different headings, as one table."""
    o = table(spark, sf_dir, "orders").withColumn("year", F.date_format("o_orderdate", "yyyy"))
    name = F.when(F.col("o_orderkey") % 2 == 0, "a").otherwise("")
    other = F.when(F.col("o_orderkey") % 2 == 0, " ").otherwise("b")
    due = F.concat((F.col("o_orderkey") % 9 + 1).cast("string"), F.lit("/5"))
    first = o.filter("year = '1995'").select(F.col("o_orderkey").alias("순번"), F.col("o_orderpriority").alias(" 건명 "), name.alias("의원"), other.alias("요구기관"), due.alias("기한"))
    second = o.filter("year = '1996'").select(F.col("o_orderkey").alias("No."), F.col("o_orderpriority").alias("질의제목"), other.alias("의원/기관"), name.alias("의원명"), due.alias("마감일자"))
    blank = first.limit(1).select(*[F.lit("").alias(c) for c in first.columns])
    rows = readers.ledger_extracts({"1995": first.select(*[F.col(c).cast("string") for c in first.columns]).union(blank), "1996": second}, as_of=AS_OF)
    return rows.select("year", "seq_no", "title", "requester", "deadline")


@BOOK.query("""SELECT doc_id, text AS full_markdown, source, lang FROM documents WHERE doc_id % 20 < 5""")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported as JSON lines and read back."""
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 < 5").select("doc_id", F.col("text").alias("full_markdown"), "source", "lang")
    path = shared_path(spark)
    ledger_rows = ledger(spark, sf_dir).limit(1)
    sinks.export_json(d, d.withColumnRenamed("doc_id", "qa_id"), ledger_rows, path)
    return spark.read.schema(d.schema).json(f"{path}/documents")


@BOOK.query("""SELECT event_id AS history_id, event_type FROM events WHERE event_id % 3 <> 0""")
def archived_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a history after the planned rows were archived and read back."""
    h = table(spark, sf_dir, "events").select(F.col("event_id").alias("history_id"), "event_type")
    path = shared_path(spark)
    sinks.archive(h, h.filter("history_id % 3 = 0"), f"{path}/old", f"{path}/kept")
    return spark.read.parquet(f"{path}/kept")


@BOOK.query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 10 <> 0""")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live version after one more passed its gate and one failed it."""
    o, path = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), shared_path(spark)
    gate = lambda old, new: old is None or op.shrink_gate(old, new)
    sinks.publish(o, path, gate)
    sinks.publish(o.filter("o_orderkey % 10 <> 0"), path, gate)
    try:
        sinks.publish(o.filter("o_orderkey % 10 = 0"), path, gate)
    except op.GateError:
        pass
    return sinks.published(spark, path)


@BOOK.query("""SELECT event_id AS history_id, event_type AS action, CASE WHEN event_id % 2 = 0 THEN 'new' END AS actor FROM events""")
def carried_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An older log without a column, carried into the new one; rows of the new one go before."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("history_id"), F.col("event_type").alias("action"))
    new = e.filter("history_id % 2 = 0").withColumn("actor", F.lit("new"))
    return sinks.carry_delivery({"history": e}, {"history": new})["history"]


@BOOK.query("""SELECT user_id AS key, max(event_id) AS seq, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1""")
def last_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of each key."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type")
    return sinks.last_by_key(e, "key", "seq")


@BOOK.query("""SELECT lower(c_mktsegment) AS word, lower(c_mktsegment) AS variant FROM customer UNION SELECT lower(c_mktsegment), 'v' || c_nationkey FROM customer""")
def synonym_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of JSON lines as (word, variant) rows."""
    path = shared_path(spark)
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("word")).agg(F.collect_set(F.concat(F.lit("V"), F.col("c_nationkey").cast("string"))).alias("variants"))
    c.write.json(path)
    return readers.synonym_file(spark, path)


@BOOK.query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'missing' WHEN doc_id % 3 = 1 THEN 'changed' ELSE 'same' END AS state FROM documents""")
def manifest_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of hashes against the files that are there."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha256"))
    files = d.filter("doc_id % 3 <> 0").withColumn("sha256", F.when(F.col("doc_id") % 3 == 1, "other").otherwise(F.col("sha256")))
    found = readers.verify_manifest(d.select("path", "sha256"), files)
    return found.select(F.substring("path", 2, 20).cast("long").alias("doc_id"), "state")


@BOOK.query("""SELECT 'in/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.exe' END AS path, doc_id % 2 = 0 AS accepted FROM documents WHERE doc_id % 5 <> 0""")
def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at the intake: accepted, rejected; temporary ones in neither."""
    k = F.col("doc_id")
    path = F.concat(F.lit("in/"), F.when(k % 5 == 0, "~$").otherwise(""), k.cast("string"), F.when(k % 2 == 0, ".pdf").otherwise(".exe"))
    good, bad = feeds.intake(table(spark, sf_dir, "documents").select(path.alias("path")))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@BOOK.query("""SELECT files::BIGINT AS files, failed::BIGINT AS failed, failed / files AS rate, CASE WHEN failed = 0 THEN 'ok' WHEN failed / files > 0.5 THEN 'failed' ELSE 'partial' END AS state FROM (SELECT count(*) AS files, count_if(event_type = 'error') AS failed FROM events)""")
def stage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a stage failed, by the share of rows with an error."""
    return op.failed_stage(table(spark, sf_dir, "events").withColumn("error", F.when(F.col("event_type") == "error", "e").otherwise("")))


@BOOK.query("""WITH k AS (SELECT o_orderkey, o_orderkey % 100 AS n FROM orders)
SELECT o_orderkey AS id, chr((44032 + 588 * (n % 19) + n)::INT) || ' A' AS word, ['ㄱ','ㄲ','ㄴ','ㄷ','ㄸ','ㄹ','ㅁ','ㅂ','ㅃ','ㅅ','ㅆ','ㅇ','ㅈ','ㅉ','ㅊ','ㅋ','ㅌ','ㅍ','ㅎ'][1 + n % 19] || 'a' AS initials FROM k""")
def initials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Initials of syllables."""
    n = F.col("o_orderkey") % 100
    syllables = F.array(*[F.lit(chr(0xAC00 + 588 * (i % 19) + i)) for i in range(100)])
    word = F.concat(F.get(syllables, n.cast("int")), F.lit(" A"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), word.alias("word"), tx.choseong(word).alias("initials"))


@BOOK.query("""SELECT page_id, regexp_extract(html, '<!--\\s*source:\\s*(.*?)\\s*-->', 1) AS header, 'in/' || page_id || '.hwp' AS source, length(html)::BIGINT AS n FROM pages""")
def source_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source headers read and stripped."""
    p = table(spark, sf_dir, "pages")
    marked = F.concat(F.lit("<!-- source: in/"), F.col("page_id").cast("string"), F.lit(".hwp -->\n"), F.col("html"))
    none = F.coalesce(tx.source_header("html"), F.lit(""))
    return p.select("page_id", none.alias("header"), tx.source_header(marked).alias("source"), F.length(tx.strip_source_header(marked)).cast("long").alias("n"))
