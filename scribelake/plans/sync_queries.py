"""Registered queries: sheet identifiers, snapshot sync, write-back, replay, purge and intake reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.operators import sync as op
from scribelake.operators.ledger import DELETED

from .roles import HISTORY_SQL, LEDGER_SQL, Book, history, ledger, table

BOOK = Book()


def _id_sql(year: str, n: str) -> str:
    return f"'REQ-' || {year} || '-' || CASE WHEN {n} < 1000 THEN lpad(({n})::VARCHAR, 3, '0') ELSE ({n})::VARCHAR END"


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as sheets: in even years a third of the rows carry an id."""
    rows = ledger(spark, sf_dir).withColumn("row_no", F.col("ledger_id"))
    given = (F.col("row_no") % 3 == 0) & (F.col("year").cast("int") % 2 == 0)
    return rows.select("year", "row_no", F.when(given, op.make_id("year", "row_no")).otherwise("").alias("ledger_id"), "title", "requester", "seq_no")


SHEET_SQL = f"""{LEDGER_SQL}, sheet AS (
  SELECT year, ledger_id AS row_no, CASE WHEN ledger_id % 3 = 0 AND year::INT % 2 = 0 THEN {_id_sql("year", "ledger_id")} ELSE '' END AS id, title, requester FROM ledger)"""


@BOOK.query(f"""WITH {SHEET_SQL}, stored AS (SELECT {_id_sql("year", "ledger_id")} AS id, ledger_id AS number, year, title, requester FROM ledger WHERE ledger_id % 5 < 3),
explicit AS (SELECT year, row_no, id FROM sheet WHERE id <> ''),
seq AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY row_no) AS n, year IN (SELECT year FROM explicit) AS stamped FROM sheet WHERE id = ''),
placed AS (SELECT year, row_no, title, requester, stamped, {_id_sql("year", "n")} AS id FROM seq),
position AS (SELECT p.year, p.row_no, p.id FROM placed p JOIN stored s ON p.id = s.id WHERE p.id NOT IN (SELECT id FROM explicit) AND (NOT stamped OR (p.title = s.title AND p.requester = s.requester))),
asking AS (SELECT *, row_number() OVER (PARTITION BY year, title, requester ORDER BY row_no) AS k FROM placed WHERE row_no NOT IN (SELECT row_no FROM position)),
offers AS (SELECT *, row_number() OVER (PARTITION BY year, title, requester ORDER BY number) AS k FROM stored WHERE id NOT IN (SELECT id FROM explicit UNION ALL SELECT id FROM position)),
content AS (SELECT a.year, a.row_no, o.id FROM asking a JOIN offers o ON a.year = o.year AND a.title = o.title AND a.requester = o.requester AND a.k = o.k),
remaining AS (SELECT * FROM asking WHERE row_no NOT IN (SELECT row_no FROM content)),
legacy AS (SELECT year, row_no, id FROM remaining WHERE NOT stamped AND id NOT IN (SELECT id FROM explicit UNION ALL SELECT id FROM position UNION ALL SELECT id FROM content)),
used AS (SELECT id FROM stored UNION ALL SELECT id FROM explicit UNION ALL SELECT id FROM position UNION ALL SELECT id FROM content UNION ALL SELECT id FROM legacy),
top AS (SELECT split_part(id, '-', 2) AS year, max(split_part(id, '-', 3)::BIGINT) AS top FROM used GROUP BY 1),
fresh AS (SELECT r.year, r.row_no, coalesce(top, 0) + row_number() OVER (PARTITION BY r.year ORDER BY r.row_no) AS n FROM remaining r LEFT JOIN top t ON r.year = t.year WHERE r.row_no NOT IN (SELECT row_no FROM legacy))
SELECT year, row_no, id AS ledger_id, 'explicit' AS origin FROM explicit UNION ALL SELECT year, row_no, id, 'position' FROM position UNION ALL SELECT year, row_no, id, 'content' FROM content
UNION ALL SELECT year, row_no, id, 'legacy' FROM legacy UNION ALL SELECT year, row_no, {_id_sql("year", "n")}, 'new' FROM fresh""")
def id_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for the rows of all sheets."""
    stored = ledger(spark, sf_dir).filter("ledger_id % 5 < 3").withColumn("ledger_id", op.make_id("year", "ledger_id"))
    return op.plan_ids(_sheet(spark, sf_dir), stored)


@BOOK.query(f"""WITH {SHEET_SQL}, e AS (SELECT year, row_no, id FROM sheet WHERE id <> ''),
n AS (SELECT year, row_no, row_number() OVER (PARTITION BY year ORDER BY row_no) AS n FROM sheet WHERE year NOT IN (SELECT year FROM e))
SELECT year, row_no, id AS ledger_id FROM e UNION ALL SELECT year, row_no, {_id_sql("year", "n")} FROM n""")
def sheet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given ids, or places in the sheets that have none."""
    return op.position_ids(_sheet(spark, sf_dir))


@BOOK.query(f"""WITH {LEDGER_SQL}, t AS (SELECT year, max(seq_no::BIGINT) AS top FROM ledger WHERE ledger_id % 4 <> 1 GROUP BY 1)
SELECT l.year, ledger_id AS row_no, (coalesce(top, 0) + row_number() OVER (PARTITION BY l.year ORDER BY ledger_id))::VARCHAR AS seq_no FROM ledger l LEFT JOIN t ON l.year = t.year WHERE ledger_id % 4 = 1""")
def sheet_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for rows without one."""
    rows = _sheet(spark, sf_dir).select("year", "row_no", "seq_no")
    return op.next_sequence(rows.filter("row_no % 4 <> 1"), rows.filter("row_no % 4 = 1").withColumn("seq_no", F.lit("")))


@BOOK.query("""WITH first AS (SELECT user_id, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1)
SELECT e.event_id AS request_id, CASE WHEN e.user_id % 2 = 1 AND e.event_id = f.event_id THEN 'insert'
  WHEN e.event_type = CASE WHEN e.user_id % 2 = 0 THEN 'click' ELSE f.event_type END AND e.user_id % 10 <> 0 THEN 'replay' ELSE 'conflict' END AS outcome,
  CASE WHEN e.user_id % 2 = 0 AND e.event_type = 'click' AND e.user_id % 10 <> 0 THEN e.user_id::VARCHAR END AS ledger_id FROM events e JOIN first f ON e.user_id = f.user_id""")
def request_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests: the user is the request key, half of the keys are stored."""
    e = table(spark, sf_dir, "events")
    requests = e.select(F.col("event_id").alias("request_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("request_key"), F.col("event_type").alias("title"))
    users = e.filter("user_id % 2 = 0").select("user_id").distinct().withColumn("title", F.lit("click"))
    stored = users.select(F.col("user_id").alias("request_key"), op.content_hash(["title"]).alias("content_hash"), F.col("user_id").cast("string").alias("ledger_id"), F.when(F.col("user_id") % 10 == 0, DELETED).otherwise("").alias("status"))
    return op.replay(requests, stored, ["title"])


@BOOK.query("""SELECT user_id AS ledger_id FROM events GROUP BY 1 HAVING count_if(event_type = 'signup') > 0 AND count_if(event_type = 'purchase' AND event_id % 20 = 0) = 0""")
def web_only_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items inserted and never applied to a sheet."""
    action = F.when(F.col("action") == "INSERT", "INSERT").when((F.col("event_type") == "purchase") & (F.col("history_id") % 20 == 0), "EXCEL_APPLIED").otherwise("UPDATE")
    types = table(spark, sf_dir, "events").select(F.col("event_id").alias("history_id"), "event_type")
    return op.web_only(history(spark, sf_dir).join(types, "history_id").withColumn("action", action))


FIELDS = ["title", "note", "status"]


def _sync_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    rows = ledger(spark, sf_dir)
    k = F.col("ledger_id")
    stored = rows.filter("ledger_id % 10 <> 3").withColumn("note", F.lit("")).withColumn("status", F.when(k % 8 == 1, DELETED).otherwise(F.col("status")))
    incoming = rows.filter("ledger_id % 10 <> 7").withColumn("note", F.when(k % 5 == 1, "x").otherwise("")).withColumn("status", F.when(k % 9 == 0, DELETED).otherwise(F.col("status")))
    protected = rows.filter("ledger_id % 4 = 0 or ledger_id % 13 = 0").select("ledger_id", F.when(k % 13 != 0, F.array(F.lit("note"))).alias("fields"))
    return stored, incoming, protected, rows.filter("ledger_id % 27 = 0").select("ledger_id"), rows.filter("ledger_id % 11 <> 0").select("ledger_id")


SYNC_SQL = f"""{LEDGER_SQL}, flags AS (SELECT ledger_id AS k, title, status AS st, ledger_id % 10 <> 3 AS s, ledger_id % 10 <> 7 AS i, ledger_id % 13 = 0 AS whole, ledger_id % 4 = 0 AND ledger_id % 13 <> 0 AS noted,
  ledger_id % 8 = 1 AS dead_s, ledger_id % 9 = 0 AS dead_i, ledger_id % 5 = 1 AS x FROM ledger),
planned AS (SELECT *, CASE WHEN NOT i THEN CASE WHEN dead_s THEN 'TOMBSTONE' WHEN k % 11 <> 0 AND k % 27 <> 0 AND NOT whole AND NOT noted THEN 'DELETE' ELSE 'KEEP' END
  WHEN whole OR (dead_i AND noted) THEN 'PROTECTED' WHEN dead_i THEN CASE WHEN s AND NOT dead_s THEN 'DELETE' ELSE 'TOMBSTONE' END
  WHEN s AND dead_s THEN 'TOMBSTONE' WHEN NOT s THEN 'INSERT' WHEN x AND NOT noted THEN 'UPDATE' ELSE 'UNCHANGED' END AS action FROM flags)"""


@BOOK.query(f"""WITH {SYNC_SQL} SELECT k AS ledger_id, action, CASE action WHEN 'UPDATE' THEN 'note' ELSE '' END AS fields FROM planned""")
def sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a sheet snapshot may change in the table."""
    stored, incoming, protected, unseen, known = _sync_inputs(spark, sf_dir)
    return op.plan_sync(stored, incoming, FIELDS, protected, unseen, known).select("ledger_id", "action", F.array_join("changed_fields", ",").alias("fields"))


@BOOK.query(f"""WITH {SYNC_SQL} SELECT k AS ledger_id, title, CASE WHEN action IN ('INSERT', 'UPDATE') AND x THEN 'x' ELSE '' END AS note,
  CASE WHEN action = 'DELETE' OR (s AND dead_s) THEN '{DELETED}' ELSE st END AS status FROM planned WHERE s OR action = 'INSERT'""")
def sync_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the snapshot."""
    stored, incoming, protected, unseen, known = _sync_inputs(spark, sf_dir)
    return op.apply_sync(stored, incoming, op.plan_sync(stored, incoming, FIELDS, protected, unseen, known), FIELDS)


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, CASE WHEN ledger_id % 6 = 1 OR ledger_id % 10 = 3 THEN 'new' ELSE title END AS title,
  CASE WHEN ledger_id % 10 = 3 THEN 'n' WHEN ledger_id % 6 = 0 THEN 'old {DELETED}' ELSE 'old' END AS note,
  CASE WHEN ledger_id % 10 <> 3 AND ledger_id % 6 = 0 THEN '{DELETED}' ELSE status END AS status FROM ledger WHERE ledger_id % 10 <> 3 OR ledger_id % 6 <> 0""")
def sheet_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets after updates, deletions and new rows."""
    rows, k = ledger(spark, sf_dir), F.col("ledger_id")
    sheet = rows.filter("ledger_id % 10 <> 3").withColumn("note", F.lit("old"))
    asked = rows.filter("ledger_id % 6 < 2 or ledger_id % 10 = 3").withColumns({"note": F.lit("n"), "title": F.lit("new"), "action": F.when(k % 6 == 0, "delete").when(k % 6 == 1, "update").otherwise("insert")})
    return op.write_back(sheet, asked.withColumn("changed_fields", F.when(k % 6 == 1, F.array(F.lit("title")))), FIELDS)


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, CASE WHEN ledger_id % 10 = 3 OR request_date >= '2000-01-01' THEN 'live' ELSE 'rebuilt' END AS note FROM ledger WHERE ledger_id % 10 <> 3 OR ledger_id % 10 <> 7""")
def concurrent_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rebuilt table and what was written while it was built."""
    rows = ledger(spark, sf_dir).withColumn("updated_at", F.col("request_date"))
    rebuilt = rows.filter("ledger_id % 10 <> 3").withColumn("note", F.lit("rebuilt"))
    return op.merge_concurrent(rebuilt, rows.withColumn("note", F.lit("live")), "2000-01-01").select("ledger_id", "note")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, CASE WHEN ledger_id % 5 = 0 THEN ledger_id % 2 = 0 OR ledger_id % 3 = 0 ELSE true END AS ok FROM ledger""")
def row_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an operation names the row it found."""
    k, none = F.col("ledger_id"), F.lit("").alias("aide")
    side = lambda title: F.struct(title.alias("title"), "requester", none, "seq_no")
    expected = side(F.when(k % 5 == 0, F.when(k % 2 == 0, F.col("title")).otherwise("?")).otherwise(F.concat(F.lit(" "), "title")))
    item = side(F.when(k % 5 == 0, F.when(k % 3 == 0, F.lit("")).otherwise("!")).otherwise(""))
    rows = ledger(spark, sf_dir).select("ledger_id", F.lit("update").alias("action"), side(F.col("title")).alias("row"), expected.alias("expected"), item.alias("item"))
    return rows.select("ledger_id", op.accepts().alias("ok"))


@BOOK.query(f"""WITH {LEDGER_SQL}, {HISTORY_SQL}, p AS (SELECT DISTINCT requester, title FROM ledger WHERE ledger_id % 50 = 0),
g AS (SELECT ledger_id FROM ledger l JOIN p ON l.requester = p.requester AND l.title = p.title)
SELECT history_id, ledger_id FROM history WHERE ledger_id NOT IN (SELECT ledger_id FROM g)""")
def purged_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History without that of the rows on a purge list."""
    rows = ledger(spark, sf_dir)
    kept = op.purge(rows, history(spark, sf_dir), rows.filter("ledger_id % 50 = 0").select("requester", "title"))[1]
    return kept.select("history_id", "ledger_id")


@BOOK.query("""WITH c AS (SELECT trim(p_type) AS value, count(*) AS n FROM part WHERE trim(p_type) <> '' GROUP BY 1), b AS (SELECT value FROM c ORDER BY n DESC, value LIMIT 8)
SELECT b.value, sum(c.n)::BIGINT AS n FROM b JOIN c ON contains(c.value, b.value) GROUP BY 1""")
def containing_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight most frequent values with the rows that contain them (a top-k report)."""
    return op.containing_counts(table(spark, sf_dir, "part"), "p_type")


@BOOK.query("""SELECT t.name, n_table, n_export, n_table <> n_export AS mismatch FROM
(SELECT 'documents' AS name, count(*)::BIGINT AS n_table FROM documents UNION ALL SELECT 'orders', count(*)::BIGINT FROM orders) t JOIN
(SELECT 'documents' AS name, count(*)::BIGINT AS n_export FROM labels UNION ALL SELECT 'orders', count(DISTINCT l_orderkey)::BIGINT FROM lineitem) e ON t.name = e.name""")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts of tables against what should mirror them."""
    t = {n: table(spark, sf_dir, n) for n in ("documents", "orders", "labels", "lineitem")}
    return op.reconcile({"documents": t["documents"], "orders": t["orders"]}, {"documents": t["labels"], "orders": t["lineitem"].select("l_orderkey").distinct()})


@BOOK.query()
def row_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose row as JSON is too large for one response."""
    return op.oversize(table(spark, sf_dir, "documents")).select("doc_id", "bytes", "too_large")


@BOOK.query("""SELECT count(*)::BIGINT AS files, count_if(event_type <> 'error')::BIGINT AS success, count_if(event_type = 'error')::BIGINT AS fail,
  round(100.0 * count_if(event_type <> 'error') / count(*), 1) AS rate, round(avg(value), 4) AS mean_seconds FROM events""")
def parse_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as parse results."""
    results = table(spark, sf_dir, "events").select((F.col("event_type") != "error").alias("ok"), F.col("value").alias("seconds"))
    return op.parse_report(results).withColumn("mean_seconds", F.round("mean_seconds", 4))


@BOOK.query("""SELECT strftime(l_shipdate, '%Y') AS year, count(*)::BIGINT AS n_files FROM lineitem GROUP BY 1""")
def intake_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked items as arriving files, by year."""
    return op.intake_plan(table(spark, sf_dir, "lineitem"), F.date_format("l_shipdate", "yyyy"))


@BOOK.query("""WITH f AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS path, coalesce(source, '') || '.' || coalesce(lang, '') || '.md' AS name, n_chars AS size, sha256(text) AS h FROM documents WHERE doc_id % 4 <> 0),
s AS (SELECT coalesce(source, '') || '.' || coalesce(lang, '') || '.md' AS name, n_chars AS size, sha256(text) AS h FROM documents WHERE doc_id % 4 = 0),
n AS (SELECT name, size, h, min(path) AS path FROM f GROUP BY ALL EXCEPT SELECT name, size, h, min(path) FROM f GROUP BY ALL HAVING (name, size, h) IN (SELECT (name, size, h) FROM s)),
o AS (SELECT name, min(path) AS owner FROM n GROUP BY 1), k AS (SELECT n.*, n.name IN (SELECT name FROM s) OR path <> owner AS renamed FROM n JOIN o ON n.name = o.name)
SELECT path, CASE WHEN renamed THEN 'renamed' ELSE 'new' END AS state, CASE WHEN renamed THEN left(name, length(name) - 3) || '_' || left(h, 8) || '.md' ELSE name END AS target FROM k
UNION ALL SELECT path, 'copy', name FROM f WHERE path NOT IN (SELECT path FROM k)""")
def intake_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as arriving files; a quarter is stored."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.coalesce("source", F.lit("")), F.lit("."), F.coalesce("lang", F.lit("")), F.lit(".md"))
    files = d.select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), name.alias("name"), F.col("n_chars").alias("size"), F.sha2("text", 256).alias("sha256"))
    return op.intake_names(files.filter("doc_id % 4 <> 0"), files.filter("doc_id % 4 = 0"))
