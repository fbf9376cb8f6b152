"""The shared tables in the roles that the operators work on, and a book to register queries in."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime.date(2001, 8, 1)


class Book:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        def add(f: Callable[[SparkSession, str], DataFrame]):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def streamed(spark: SparkSession, sf_dir: str, name: str, folder: str) -> DataFrame:
    """A table as a stream of files; a stream reads a folder, so the table is laid down in ``folder`` first."""
    rows = table(spark, sf_dir, name)
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title (the first line), requester, topic_tags, full_markdown."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.substring_index("text", "\n", 1).alias("title"), F.col("source").alias("requester"), F.col("lang").alias("topic_tags"), F.col("text").alias("full_markdown"))


DOCUMENTS_SQL = "docs AS (SELECT doc_id, split_part(text, chr(10), 1) AS title, source AS requester, lang AS topic_tags, text AS full_markdown FROM documents)"


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests: the priority's digit gives the weeks to the deadline."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    day = F.to_date("o_orderdate")
    weeks = F.substring("o_orderpriority", 1, 1).cast("int")
    status = F.when(F.col("o_orderstatus") == "F", "완료").when(F.col("o_orderstatus") == "O", "작성중").otherwise("")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select(
        F.col("o_orderkey").alias("ledger_id"),
        F.date_format(day, "yyyy").alias("year"),
        F.col("o_orderkey").cast("string").alias("seq_no"),
        F.coalesce("c_mktsegment", F.lit("")).alias("party"),
        F.coalesce("c_name", F.lit("")).alias("requester"),
        F.col("o_orderpriority").alias("title"),
        F.date_format(day, "yyyy-MM-dd").alias("request_date"),
        F.date_format(F.date_add(day, weeks * 7), "yyyy-MM-dd").alias("deadline"),
        status.alias("status"),
    )


LEDGER_SQL = """ledger AS (
  SELECT o_orderkey AS ledger_id, strftime(o_orderdate, '%Y') AS year, o_orderkey::VARCHAR AS seq_no, coalesce(c_mktsegment, '') AS party,
         coalesce(c_name, '') AS requester, o_orderpriority AS title, strftime(o_orderdate, '%Y-%m-%d') AS request_date,
         strftime(o_orderdate::DATE + 7 * substr(o_orderpriority, 1, 1)::INT, '%Y-%m-%d') AS deadline,
         CASE o_orderstatus WHEN 'F' THEN '완료' WHEN 'O' THEN '작성중' ELSE '' END AS status
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""
DUE_SQL = """due AS (
  SELECT *, date_diff('day', DATE '2001-08-01', deadline::DATE)::INT AS days_left,
         CASE WHEN trim(status) IN ('제출', '완료', '[삭제]', '업무설명') THEN 'done'
              WHEN deadline::DATE < DATE '2001-08-01' THEN 'overdue'
              WHEN date_diff('day', DATE '2001-08-01', deadline::DATE) <= 7 THEN 'soon' ELSE 'later' END AS due
  FROM ledger)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change rows: the user is the item."""
    e = table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return e.select(F.col("event_id").alias("history_id"), F.col("user_id").alias("ledger_id"), action.alias("action"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("changed_at"), F.col("props").alias("snapshot"))


HISTORY_SQL = """history AS (
  SELECT event_id AS history_id, user_id AS ledger_id, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS action,
         strftime(ts, '%Y-%m-%d %H:%M:%S') AS changed_at, props AS snapshot FROM events)"""


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each test item asks for its longest two words together, or its third longest."""
    b = table(spark, sf_dir, "benchmark")
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("text", r"[^\p{L}\s]", "")), r"\s+"))
    ordered = F.sort_array(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    pick = lambda i: F.try_element_at(ordered, F.lit(i))["w"]
    return b.select(F.col("item_id").alias("query_id"), F.concat_ws(" ", pick(1), pick(2), F.lit("OR"), pick(3)).alias("query"))


QUERIES_SQL = r"""asked AS (
  SELECT item_id AS query_id, list_sort(list_transform(list_distinct(list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\p{L}\s]', '', 'g')), '\s+'), lambda w: w <> '')), lambda w: {'n': -length(w), 'w': w})) AS ws FROM benchmark
), terms AS (
  SELECT query_id, 0 AS group_no, 0 AS term_no, ws[1].w AS v FROM asked UNION ALL SELECT query_id, 0, 1, ws[2].w FROM asked UNION ALL SELECT query_id, 1, 0, ws[3].w FROM asked
)"""
