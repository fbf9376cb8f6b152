"""Registered queries: ledger filters, counts, linkage, changes, timelines, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.functions.dates import days_left, due_label, due_rank, due_state
from scribelake.functions.text import requester_stem
from scribelake.operators import ledger as op
from scribelake.operators import listing
from scribelake.operators.shared import ranked, shared_path
from scribelake.streaming import feeds, stores

from .roles import AS_OF, DUE_SQL, HISTORY_SQL, LEDGER_SQL, Book, history, ledger, streamed, table

BOOK = Book()


@BOOK.query(f"WITH {LEDGER_SQL}, {DUE_SQL} SELECT ledger_id, due, days_left, CASE due WHEN 'overdue' THEN 'D+' || (-days_left) WHEN 'soon' THEN CASE days_left WHEN 0 THEN 'D-DAY' ELSE 'D-' || days_left END WHEN 'later' THEN 'D-' || days_left ELSE '' END AS label FROM due")
def due_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(spark, sf_dir).select("ledger_id", due_state("deadline", "status", AS_OF).alias("due"), days_left("deadline", AS_OF).alias("days_left"))
    return rows.select("ledger_id", "due", "days_left", due_label("due", "days_left").alias("label"))


@BOOK.query(f"WITH {LEDGER_SQL}, {DUE_SQL} SELECT count_if(due = 'overdue')::BIGINT AS overdue, count_if(due = 'soon')::BIGINT AS soon, count_if(due <> 'done')::BIGINT AS open, count(*)::BIGINT AS total FROM due")
def due_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.due_counts(ledger(spark, sf_dir), AS_OF)


@BOOK.query(f"WITH {LEDGER_SQL} SELECT CASE WHEN trim(status) = '' THEN '(없음)' ELSE trim(status) END AS status, count(*)::BIGINT AS n FROM ledger GROUP BY 1")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.status_counts(op.active(ledger(spark, sf_dir)))


@BOOK.query(f"WITH {LEDGER_SQL}, {DUE_SQL} SELECT ledger_id, requester, deadline FROM due WHERE year = '2001' AND due <> 'done' AND request_date BETWEEN '2001-03-01' AND '2001-07-15'")
def ledger_open_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = op.by_due(op.by_year(op.active(ledger(spark, sf_dir)), "2001"), "open", AS_OF)
    return op.date_range(rows, "2001-03-01", "2001-07-15").select("ledger_id", "requester", "deadline")


@BOOK.query(f"WITH {LEDGER_SQL}, {DUE_SQL} SELECT ledger_id, row_number() OVER (PARTITION BY year ORDER BY CASE due WHEN 'overdue' THEN 0 WHEN 'soon' THEN 1 WHEN 'later' THEN 2 ELSE 4 END, deadline, request_date DESC, ledger_id)::BIGINT AS place FROM due")
def deadline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deadline order inside each year."""
    rows = ledger(spark, sf_dir).withColumn("r", due_rank(due_state("deadline", "status", AS_OF))).select("ledger_id", "year", "r", "deadline", "request_date")
    return ranked(rows, ["year"], ["r", "deadline", F.desc("request_date"), "ledger_id"], "place").select("ledger_id", "place")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, year, request_date, seq_no, (SELECT count(*) FROM ledger)::BIGINT AS total FROM ledger ORDER BY year DESC, request_date DESC, seq_no DESC, ledger_id LIMIT 50 OFFSET 100""")
def ledger_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Third page of the default order (text order of the number), with the total."""
    rows = ledger(spark, sf_dir).select("ledger_id", "year", "request_date", "seq_no")
    return listing.page(rows, [F.desc("year"), F.desc("request_date"), F.desc("seq_no"), "ledger_id"], "50", "100")


@BOOK.query("""WITH s AS (
  SELECT 'party' AS label, trim(c_mktsegment) AS value, count(*) AS n FROM customer WHERE contains(lower(c_mktsegment), 'a') GROUP BY 2
  UNION ALL SELECT 'region', trim(r_name), count(*) FROM region WHERE contains(lower(r_name), 'a') GROUP BY 2
  UNION ALL SELECT 'type', trim(p_type), count(*) FROM part WHERE contains(lower(p_type), 'a') GROUP BY 2)
SELECT label, value, n::BIGINT AS n, starts_with(lower(value), 'a') AS starts FROM s ORDER BY starts DESC, n DESC, value, label LIMIT 20""")
def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = [(table(spark, sf_dir, "customer"), "c_mktsegment", "party"), (table(spark, sf_dir, "region"), "r_name", "region"), (table(spark, sf_dir, "part"), "p_type", "type")]
    return op.suggest(sources, "a", 20)


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT requester, count(*)::BIGINT AS n, round(100.0 * count(*) / (SELECT count(*) FROM ledger WHERE trim(requester) <> ''), 1) AS share FROM ledger WHERE trim(requester) <> '' GROUP BY 1 ORDER BY n DESC, requester LIMIT 12""")
def top_requesters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve most frequent, with their share (a top-k report)."""
    return op.top_values(ledger(spark, sf_dir), "requester", 12)


@BOOK.query(f"""WITH {LEDGER_SQL}, p AS (SELECT requester, request_date, ledger_id, CASE WHEN ledger_id % 3 = 0 THEN '' ELSE party END AS party, CASE WHEN ledger_id % 4 = 1 THEN 'aide ' || ledger_id ELSE ' ' END AS aide FROM ledger)
SELECT requester, count(*)::BIGINT AS n, arg_max(party, (request_date, ledger_id)) FILTER (party <> '') AS party, arg_max(aide, (request_date, ledger_id)) FILTER (trim(aide) <> '') AS aide FROM p GROUP BY 1""")
def requester_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each requester, and the newest party and aide that are filled."""
    rows = ledger(spark, sf_dir).withColumn("party", F.when(F.col("ledger_id") % 3 == 0, "").otherwise(F.col("party")))
    rows = rows.withColumn("aide", F.when(F.col("ledger_id") % 4 == 1, F.concat(F.lit("aide "), F.col("ledger_id"))).otherwise(" "))
    return op.requester_profiles(rows, ["request_date", "ledger_id"])


@BOOK.query("""SELECT l_orderkey AS ledger_id, l_linenumber::INT AS line FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def dangling_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked items whose ledger row is not among the closed ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ledger_id"), F.col("l_linenumber").cast("int").alias("line"))
    return op.dangling(lines, "ledger_id", table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), "o_orderkey")


def _linkable(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Requests with short numbers, and documents that show some of them once, twice or inside a longer number."""
    rows = ledger(spark, sf_dir).withColumn("seq_no", F.concat(F.lit("0"), (F.col("ledger_id") % 997).cast("string")))
    done = rows.filter("status = '완료'")
    path = F.concat(F.lit("in/"), F.col("requester"), F.lit("_"), (F.col("ledger_id") % 1499).cast("string"), F.lit("a.md"))
    docs = done.select(F.col("ledger_id").alias("doc_id"), F.col("ledger_id").alias("doc_order"), "year", "request_date", "requester", F.concat(F.lit("("), "seq_no", F.lit(")")).alias("doc_number"), path.alias("original_path"))
    return rows, docs


_LINKABLE = f"""{LEDGER_SQL}, l AS (SELECT ledger_id, year, request_date, requester, '0' || (ledger_id % 997) AS seq_no, status FROM ledger),
d AS (SELECT ledger_id AS doc_id, year, request_date, requester, seq_no, '(' || seq_no || ')' AS doc_number, 'in/' || requester || '_' || (ledger_id % 1499) || 'a.md' AS original_path FROM l WHERE status = '완료')"""


@BOOK.query(f"""WITH {_LINKABLE},
n AS (SELECT year, ltrim(seq_no, '0') AS k, max(doc_id) AS doc_id FROM d WHERE ltrim(seq_no, '0') <> '' GROUP BY 1, 2),
r AS (SELECT year, trim(requester) AS k, request_date, max(doc_id) AS doc_id FROM d GROUP BY 1, 2, 3)
SELECT ledger_id, coalesce(n.doc_id::VARCHAR, r.doc_id::VARCHAR) AS linked_doc_id FROM l
LEFT JOIN n ON l.year = n.year AND ltrim(l.seq_no, '0') = n.k LEFT JOIN r ON l.year = r.year AND trim(l.requester) = r.k AND l.request_date = r.request_date""")
def ledger_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link by year and number, else by year, requester and date."""
    rows, docs = _linkable(spark, sf_dir)
    return op.link(rows, docs).select("ledger_id", "linked_doc_id")


_TOKENS = f"""{_LINKABLE}, tok AS (SELECT DISTINCT year, doc_id, unnest(regexp_extract_all(doc_number || ' ' || original_path, '\\d+')) AS token FROM d),
v AS (SELECT ledger_id, year, seq_no AS token FROM l UNION SELECT ledger_id, year, ltrim(seq_no, '0') FROM l WHERE ltrim(seq_no, '0') <> ''),
by_token AS (SELECT ledger_id, min(doc_id) AS doc_id FROM v JOIN tok USING (year, token) GROUP BY 1 HAVING count(DISTINCT doc_id) = 1),
by_day AS (SELECT l.ledger_id, min(d.doc_id) AS doc_id FROM l JOIN d ON l.request_date = d.request_date AND l.year = d.year AND contains(d.requester, trim(l.requester)) AND trim(l.requester) <> '' GROUP BY 1),
auto AS (SELECT * FROM by_token UNION ALL SELECT * FROM by_day WHERE ledger_id NOT IN (SELECT ledger_id FROM by_token))"""


@BOOK.query(f"WITH {_TOKENS} SELECT ledger_id, doc_id FROM by_token")
def ledger_links_by_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link by a whole digit run that one document of the year shows."""
    return op.link_by_token(*_linkable(spark, sf_dir))


@BOOK.query(f"WITH {_TOKENS} SELECT ledger_id, doc_id FROM auto")
def ledger_auto_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link by number token, else by a requester that holds the stem on the same day."""
    return op.auto_link(*_linkable(spark, sf_dir))


_REPAIR = f"""{_TOKENS}, held AS (SELECT *, CASE WHEN ledger_id % 5 = 0 THEN (ledger_id + 1)::VARCHAR WHEN ledger_id % 5 = 1 THEN '' ELSE 'gone' END AS old FROM l),
marked AS (SELECT *, old <> '' AND old NOT IN (SELECT doc_id::VARCHAR FROM d) AS bad FROM held)"""


def _broken(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows, docs = _linkable(spark, sf_dir)
    k = F.col("ledger_id")
    old = F.when(k % 5 == 0, (k + 1).cast("string")).when(k % 5 == 1, "").otherwise("gone")
    back = F.when(F.col("doc_id") % 3 == 0, "-1").otherwise((F.col("doc_id") + 1).cast("string"))
    return rows.withColumn("linked_doc_id", old), docs.withColumn("linked_ledger_id", back)


@BOOK.query(f"WITH {_REPAIR} SELECT m.ledger_id, CASE WHEN bad THEN coalesce(a.doc_id::VARCHAR, '') ELSE old END AS linked_doc_id FROM marked m LEFT JOIN auto a USING (ledger_id)")
def repaired_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dangling links found anew or cleared."""
    return op.repair_links(*_broken(spark, sf_dir))[0].select("ledger_id", "linked_doc_id")


@BOOK.query(f"WITH {_REPAIR} SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id + 1 NOT IN (SELECT ledger_id FROM l) THEN '' ELSE (doc_id + 1)::VARCHAR END AS linked_ledger_id FROM d")
def repaired_back_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-references to requests that are gone are cleared."""
    return op.repair_links(*_broken(spark, sf_dir))[1].select("doc_id", "linked_ledger_id")


@BOOK.query(f"WITH {_REPAIR} SELECT count_if(old <> '')::BIGINT AS checked, count_if(bad AND a.doc_id IS NOT NULL)::BIGINT AS relinked, count_if(bad AND a.doc_id IS NULL)::BIGINT AS cleared FROM marked m LEFT JOIN auto a USING (ledger_id)")
def repair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.repair_links(*_broken(spark, sf_dir))[2]


@BOOK.query(f"""WITH {_REPAIR}, c AS (SELECT ledger_id, doc_id::VARCHAR AS old, (doc_id + 2)::VARCHAR AS new FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN doc_id + 1 ELSE doc_id + 7 END AS ledger_id FROM d)),
good AS (SELECT * FROM c WHERE new IN (SELECT doc_id::VARCHAR FROM d) AND ledger_id NOT IN (SELECT ledger_id FROM c WHERE new NOT IN (SELECT doc_id::VARCHAR FROM d))),
p AS (SELECT new, max(ledger_id::VARCHAR) AS target FROM good GROUP BY 1), b AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '-1' ELSE (doc_id + 1)::VARCHAR END AS back FROM d)
SELECT b.doc_id, coalesce(target, CASE WHEN EXISTS (SELECT 1 FROM good g WHERE g.old = b.doc_id::VARCHAR AND g.ledger_id::VARCHAR = back) THEN '' ELSE back END) AS linked_ledger_id FROM b LEFT JOIN p ON p.new = b.doc_id::VARCHAR""")
def changed_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Back-references after requests moved from one document to another."""
    _, docs = _broken(spark, sf_dir)
    mine = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") + 1).otherwise(F.col("doc_id") + 7)
    changes = docs.select(mine.alias("ledger_id"), F.col("doc_id").cast("string").alias("old_doc_id"), (F.col("doc_id") + 2).cast("string").alias("new_doc_id"))
    return op.change_links(docs, changes)[0].select("doc_id", "linked_ledger_id")


@BOOK.query(f"WITH {_REPAIR}, b AS (SELECT old AS doc_id, max(ledger_id) AS last FROM held WHERE old <> '' GROUP BY 1) SELECT d.doc_id, coalesce(b.last::VARCHAR, '') AS linked_ledger_id FROM d LEFT JOIN b ON d.doc_id::VARCHAR = b.doc_id")
def back_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last request that points at each document."""
    rows, docs = _broken(spark, sf_dir)
    return op.back_references(docs.withColumn("doc_id", F.col("doc_id").cast("string")), rows.filter("linked_doc_id <> ''")).withColumn("doc_id", F.col("doc_id").cast("long"))


@BOOK.query("""SELECT o_orderkey AS ledger_id, n::BIGINT AS n_lines, round(total, 4) AS total FROM orders JOIN (SELECT l_orderkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each ledger row with its items nested in order; reported by their number and sum."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("items"))
    nested = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return nested.select(F.col("o_orderkey").alias("ledger_id"), F.size("items").cast("long").alias("n_lines"), F.round(F.aggregate("items", F.lit(0.0), lambda a, x: a + x["l_quantity"]), 4).alias("total"))


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ledger(spark, sf_dir)
    stored = rows.filter("ledger_id % 10 <> 3").withColumn("note", F.lit(""))
    incoming = rows.filter("ledger_id % 10 <> 7").withColumn("note", F.when(F.col("ledger_id") % 5 == 1, F.lit("x")).otherwise(""))
    return stored, incoming


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, CASE ledger_id % 10 WHEN 3 THEN 'INSERT' WHEN 7 THEN 'DELETE' ELSE CASE WHEN ledger_id % 5 = 1 THEN 'UPDATE' ELSE 'UNCHANGED' END END AS action,
  CASE WHEN ledger_id % 10 NOT IN (3, 7) AND ledger_id % 5 = 1 THEN 'note' ELSE '' END AS fields FROM ledger""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of the ledger compared field by field."""
    stored, incoming = _snapshots(spark, sf_dir)
    diff = op.snapshot_diff(stored, incoming, ["title", "requester", "deadline", "note", "status"])
    return diff.select("ledger_id", "action", F.array_join("changed_fields", ",").alias("fields"))


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, title, CASE WHEN ledger_id % 10 = 7 THEN '' WHEN ledger_id % 5 <> 1 THEN '' WHEN ledger_id % 10 <> 3 AND ledger_id % 4 = 0 THEN '' ELSE 'x' END AS note, status FROM ledger""")
def snapshot_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge of a snapshot with fields that undelivered operations protect."""
    stored, incoming = _snapshots(spark, sf_dir)
    operations = stored.filter("ledger_id % 4 = 0").select("ledger_id", F.array(F.lit("note")).alias("fields"), F.lit(False).alias("conflict"))
    return op.merge_snapshot(stored, incoming, ["title", "note", "status"], op.protected_fields(operations))


@BOOK.query(f"""WITH {HISTORY_SQL}, t AS (
  SELECT *, first_value(CASE WHEN action IN ('UPDATE', 'DELETE') THEN snapshot END IGNORE NULLS) OVER (PARTITION BY ledger_id ORDER BY history_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt,
         row_number() OVER (PARTITION BY ledger_id ORDER BY history_id DESC) AS n FROM history)
SELECT ledger_id, history_id, action, CASE WHEN action <> 'INSERT' THEN snapshot END AS before, CASE WHEN action <> 'INSERT' THEN nxt ELSE snapshot END AS after FROM t WHERE n <= 15""")
def change_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after of the newest fifteen changes of each item (a top-k report)."""
    return op.timeline(history(spark, sf_dir))


@BOOK.query(f"""WITH {HISTORY_SQL}, g AS (SELECT *, CASE WHEN action IN ('INSERT', 'DELETE') THEN action END AS grp FROM history),
m AS (SELECT *, max(history_id) OVER (PARTITION BY ledger_id, grp) AS latest FROM g)
SELECT history_id, ledger_id, NOT (grp IS NOT NULL AND history_id = latest) AND changed_at < '2024-01-10 00:00:00' AS archive FROM m""")
def history_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows to archive: old, and not the latest of their kind."""
    group = F.when(F.col("action").isin("INSERT", "DELETE"), F.col("action"))
    return op.retention(history(spark, sf_dir), "2024-01-10 00:00:00", group).select("history_id", "ledger_id", "archive")


@BOOK.query(f"""WITH {HISTORY_SQL}, s AS (SELECT ledger_id, arg_max(action, history_id) AS last_action, count(*) AS n FROM history GROUP BY 1)
SELECT ledger_id, last_action = 'DELETE' AS deleted, n::BIGINT AS n_changes FROM s""")
def change_feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current state of each item from its change feed."""
    h = history(spark, sf_dir)
    return h.groupBy("ledger_id").agg((F.max_by("action", "history_id") == "DELETE").alias("deleted"), F.count("*").alias("n_changes"))


@BOOK.query("""WITH p AS (SELECT user_id AS ledger_id, event_id, event_type FROM events WHERE event_type IN ('click', 'view', 'error'))
SELECT ledger_id, CASE WHEN bool_or(event_type = 'error') THEN NULL ELSE array_to_string(list_sort(list(DISTINCT event_type)), ',') END AS fields FROM p GROUP BY 1""")
def protected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of changed fields per item; an operation on the whole row absorbs it."""
    e = table(spark, sf_dir, "events").filter("event_type in ('click', 'view', 'error')")
    ops = e.select(F.col("user_id").alias("ledger_id"), F.when(F.col("event_type") != "error", F.array("event_type")).alias("fields"), F.lit(False).alias("conflict"))
    return op.protected_fields(ops).select("ledger_id", F.array_join("fields", ",").alias("fields"))


# updates of the title up to the first deletion of an item, the deletion, and what comes after it
_APPLIED = f"""{LEDGER_SQL}, o AS (SELECT event_id AS seq, user_id AS ledger_id, event_type, min(CASE WHEN event_type = 'error' THEN event_id END) OVER (PARTITION BY user_id) AS dead FROM events),
live AS (SELECT o.*, lag(event_type, 1, l.title) OVER (PARTITION BY ledger_id ORDER BY seq) AS before FROM o JOIN ledger l USING (ledger_id) WHERE event_type <> 'error' AND (dead IS NULL OR seq < dead)),
writes AS (SELECT seq, ledger_id, 'UPDATE' AS action, before AS title, 'title,updated_at' AS changed_fields FROM live WHERE event_type <> before
  UNION ALL SELECT o.seq, o.ledger_id, 'DELETE', coalesce((SELECT arg_max(event_type, seq) FROM live v WHERE v.ledger_id = o.ledger_id), l.title), '' FROM o JOIN ledger l USING (ledger_id) WHERE o.seq = o.dead)"""


def _operations(e: DataFrame) -> DataFrame:
    """Events as updates and deletions of the ledger."""
    action = F.when(F.col("event_type") == "error", "delete").otherwise("update")
    item = F.create_map(F.lit("title"), F.col("event_type"))
    return e.select(F.col("event_id").cast("string").alias("operation_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("ledger_id"), action.alias("action"), item.alias("item"), F.lit(None).cast("string").alias("expected_version"))


def _applied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of updates and deletions from the event feed, applied to the ledger."""
    stored = ledger(spark, sf_dir).withColumn("updated_at", F.lit("v0"))
    return op.apply_operations(stored, _operations(table(spark, sf_dir, "events")), ["title", "status", "requester"], as_of=AS_OF)


_APPLIED_STATE = f"""WITH {_APPLIED} SELECT l.ledger_id, coalesce((SELECT arg_max(event_type, seq) FROM live v WHERE v.ledger_id = l.ledger_id), l.title) AS title,
  CASE WHEN l.ledger_id IN (SELECT ledger_id FROM o WHERE dead IS NOT NULL) THEN '[삭제]' ELSE status END AS status, requester, coalesce((SELECT max(seq)::VARCHAR FROM writes w WHERE w.ledger_id = l.ledger_id), 'v0') AS updated_at FROM ledger l"""


@BOOK.query(_APPLIED_STATE)
def applied_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table after the batch; each key's operations apply in order."""
    return _applied(spark, sf_dir)[0].select("ledger_id", "title", "status", "requester", "updated_at")


@BOOK.query(_APPLIED_STATE)
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operations as a stream into a bucketed ledger, whose micro-batches rewrite the buckets they touch: the same table."""
    at, schema = shared_path(spark), "ledger_id long, title string, status string, requester string, updated_at string"
    store = stores.BucketedTable(spark, f"{at}/ledger", schema, "ledger_id", buckets=8)
    store.merge(ledger(spark, sf_dir).withColumn("updated_at", F.lit("v0")), list(range(8)), "load", 0)
    ops = _operations(streamed(spark, sf_dir, "events", f"{at}/events"))
    logs = {
        "receipts": stores.OnceTable(spark, f"{at}/receipts", "operation_id string, seq long", order="seq", buckets=8),
        "history": stores.OnceTable(spark, f"{at}/history", "ledger_id long, action string, seq long, snapshot string, changed_fields string, event string", id="event", buckets=8),
        "rejects": stores.OnceTable(spark, f"{at}/rejects", "ledger_id long, operation_id string, seq long, action string, reason string, event string", id="event", buckets=8),
    }
    feeds.ledger_feed(ops, store, fields=["title", "status", "requester"], as_of=AS_OF, checkpoint=f"{at}/checkpoint", **logs).awaitTermination()
    return store.read()


@BOOK.query(f"WITH {_APPLIED} SELECT ledger_id, action, seq, title AS before_title, changed_fields FROM writes")
def applied_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows of the batch: the state before each change, and no row where nothing changed."""
    before = F.get_json_object("snapshot", "$.title").alias("before_title")
    return _applied(spark, sf_dir)[1].select("ledger_id", "action", "seq", before, "changed_fields")


@BOOK.query(f"WITH {_APPLIED} SELECT ledger_id, seq, CASE WHEN ledger_id NOT IN (SELECT ledger_id FROM ledger) THEN 'missing' WHEN event_type = 'error' THEN 'missing' ELSE 'deleted' END AS reason FROM o WHERE ledger_id NOT IN (SELECT ledger_id FROM ledger) OR seq > dead")
def applied_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations of the batch that were refused, and why."""
    return _applied(spark, sf_dir)[2].select("ledger_id", "seq", "reason")


_ATTEMPTS = "a AS (SELECT event_id AS seq, user_id AS ledger_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'update' END AS action, (event_id % 6)::INT AS attempts, CASE WHEN event_id % 11 = 0 THEN 'conflict' WHEN event_type = 'error' THEN 'missing' WHEN event_id % 13 = 0 THEN 'io' END AS reason FROM events)"


@BOOK.query(f"""WITH {_ATTEMPTS}, f AS (SELECT ledger_id, min(seq) AS first FROM a WHERE reason = 'io' GROUP BY 1),
m AS (SELECT a.*, coalesce(seq > first, FALSE) AS waits, reason IS NULL OR (action = 'delete' AND reason = 'missing') AS done FROM a LEFT JOIN f USING (ledger_id))
SELECT seq, CASE WHEN waits THEN 'retry' WHEN done THEN 'ok' WHEN reason = 'conflict' OR attempts + 1 >= 5 THEN 'dead' ELSE 'retry' END AS route, attempts + CASE WHEN waits OR done THEN 0 ELSE 1 END AS attempts FROM m""")
def routed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations by what becomes of them: done, tried again (with all that follow of their key), or set aside."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    reason = F.when(k % 11 == 0, "conflict").when(F.col("event_type") == "error", "missing").when(k % 13 == 0, "io")
    rows = e.select(k.alias("seq"), F.col("user_id").alias("ledger_id"), F.when(F.col("event_type") == "error", "delete").otherwise("update").alias("action"), (k % 6).cast("int").alias("attempts"), reason.alias("reason"))
    parts = [v.select("seq", F.lit(name).alias("route"), "attempts") for name, v in feeds.route_attempts(rows).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@BOOK.query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y') ORDER BY o_orderkey) AS k FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 4)
SELECT o_orderkey AS seq, 'REQ-' || strftime(o_orderdate, '%Y') || '-' || CASE WHEN k + 2 < 1000 THEN lpad((k + 2)::VARCHAR, 3, '0') ELSE (k + 2)::VARCHAR END AS ledger_id,
  CASE WHEN o_orderstatus = 'F' THEN '완료' ELSE '작성중' END AS status, strftime(o_orderdate, '%Y-%m-%d') AS request_date, '시스템' AS request_type, '' AS linked_doc_id FROM s""")
def new_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that come in: validated, defaults filled, dates read, numbered after those in use."""
    o = table(spark, sf_dir, "orders")
    title = F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.col("o_orderpriority"))
    day = F.when(F.col("o_orderkey") % 5 == 4, "2026-02-31").otherwise(F.date_format("o_orderdate", "yyyy. M. d."))
    items = o.select(F.col("o_orderkey").alias("seq"), F.date_format("o_orderdate", "yyyy").alias("year"), title.alias("title"), F.lit("x").alias("requester"), day.alias("request_date"), F.when(F.col("o_orderstatus") == "F", "완료").alias("status"))
    used = items.select("year").distinct().select(F.concat(F.lit("REQ-"), "year", F.lit("-002")).alias("ledger_id"))
    docs = spark.createDataFrame([], "doc_id string, year string, doc_number string, original_path string, requester string, request_date string")
    accepted, _ = op.new_requests(used, docs, items, AS_OF)
    return accepted.select("seq", "ledger_id", "status", "request_date", "request_type", "linked_doc_id")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, '제출' AS status, CASE WHEN ledger_id % 2 = 0 THEN '2001-08-01' END AS submit_date FROM ledger""")
def submitted_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that mark requests as handed in."""
    rows = ledger(spark, sf_dir).withColumn("submit_date", F.when(F.col("ledger_id") % 2 == 0, "").otherwise("2001-01-01")).withColumn("updated_at", F.lit("v0"))
    ops = op.mark_submitted(rows, AS_OF)
    return ops.select("ledger_id", F.element_at("item", F.lit("status")).alias("status"), F.element_at("item", F.lit("submit_date")).alias("submit_date"))


@BOOK.query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'text ****' ELSE NULL END AS masked_text, CASE WHEN event_id % 4 <> 0 THEN user_id::VARCHAR END AS k FROM events""")
def masked_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with contact fields masked; what is no object is masked as text."""
    e = table(spark, sf_dir, "events")
    good = F.to_json(F.struct(F.concat(F.col("user_id").cast("string"), F.lit(" 010-1234-5678")).alias("contact_person"), F.col("event_type").alias("title")))
    shot = op.mask_snapshot(F.when(F.col("event_id") % 4 == 0, "text 010-1234-5678").otherwise(good))
    bad = F.col("event_id") % 4 == 0
    rows = e.select("event_id", shot.alias("s"))
    contact = F.get_json_object("s", "$.contact_person")
    return rows.select("event_id", F.when(bad, F.replace(F.col("s"), F.lit("010-****-5678"), F.lit("****"))).alias("masked_text"), F.when(~bad & contact.endswith("010-****-5678"), F.substring_index(contact, " ", 1)).alias("k"))


@BOOK.query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'title' WHEN event_id % 3 = 1 THEN 'title,note' ELSE '' END AS fields, event_id % 3 = 1 AS clipped FROM events""")
def field_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that differ between two JSON snapshots."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    before = F.to_json(F.struct(F.col("event_type").alias("title"), F.repeat(F.lit("n"), 400).alias("note")))
    after = F.to_json(F.struct(F.when(k == 2, F.concat(F.col("event_type"), F.lit(" "))).otherwise("other").alias("title"), F.when(k == 1, F.lit(None)).otherwise(F.repeat(F.lit("n"), 400)).alias("note")))
    diff = op.field_changes(op.parse_snapshot(before), op.parse_snapshot(after), ["title", "note", "status"])
    return e.select("event_id", F.array_join(F.transform(diff, lambda x: x["field"]), ",").alias("fields"), F.exists(diff, lambda x: x["clipped"]).alias("clipped"))


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, 'REQ-' || year || '-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id FROM (
  SELECT ledger_id, year, row_number() OVER (PARTITION BY year ORDER BY ledger_id) + 5 AS n FROM ledger)""")
def ledger_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New identifiers per year after the largest one in use."""
    rows = ledger(spark, sf_dir).select("ledger_id", "year")
    used = rows.select("year").distinct().select(F.concat(F.lit("REQ-"), "year", F.lit("-005")).alias("id"))
    return op.next_numbers(used, rows, ["ledger_id"], "REQ").select("ledger_id", "id")


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT year FROM (SELECT DISTINCT year FROM ledger UNION SELECT DISTINCT strftime(l_shipdate, '%Y') FROM lineitem)""")
def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different years of two tables; what is no year is left out."""
    shipped = table(spark, sf_dir, "lineitem").select(F.explode(F.array(F.date_format("l_shipdate", "yyyy"), F.lit("기타"))).alias("year"))
    return listing.years(ledger(spark, sf_dir), shipped)


@BOOK.query("""SELECT 'orders without customer' AS "check", 'problem' AS severity, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'items without order', 'problem', count(*)::BIGINT FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'labels without document', 'warning', count(*)::BIGINT FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'copies', 'note', (count(*) - count(DISTINCT text))::BIGINT FROM documents""")
def health_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphans and copies as rows of a report."""
    t = {n: table(spark, sf_dir, n) for n in ("orders", "customer", "lineitem", "labels", "documents")}
    row = lambda df, check, severity: df.agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n")
    per_text = t["documents"].groupBy(F.xxhash64("text"), F.sha2("text", 256)).agg((F.count("*") - 1).alias("extra"))
    copies = per_text.agg(F.sum("extra").alias("n")).select(F.lit("copies").alias("check"), F.lit("note").alias("severity"), "n")
    return (
        row(op.dangling(t["orders"], "o_custkey", t["customer"], "c_custkey"), "orders without customer", "problem")
        .unionByName(row(op.dangling(t["lineitem"], "l_orderkey", t["orders"], "o_orderkey"), "items without order", "problem"))
        .unionByName(row(op.dangling(t["labels"], "doc_id", t["documents"], "doc_id"), "labels without document", "warning"))
        .unionByName(copies)
    )


@BOOK.query(f"""WITH {LEDGER_SQL} SELECT ledger_id, concat_ws(',', CASE WHEN ledger_id % 3 = 0 THEN 'title' END, CASE WHEN ledger_id % 5 = 0 THEN 'requester' END, CASE WHEN ledger_id % 7 = 0 THEN 'year' END,
  CASE WHEN ledger_id % 11 = 0 THEN 'deadline' END, CASE WHEN ledger_id % 2 = 0 THEN 'ledger_id' END, CASE WHEN status = '' THEN 'status' END) AS errors FROM ledger""")
def validated_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps requests from being accepted."""
    k = F.col("ledger_id")
    spoiled = {"title": (3, " "), "requester": (5, ""), "year": (7, "26"), "deadline": (11, "2026-02-30")}
    rows = ledger(spark, sf_dir).withColumn("old_status", F.lit("작성중")).withColumns({c: F.when(k % n == 0, bad).otherwise(F.col(c)) for c, (n, bad) in spoiled.items()})
    ident = F.when(k % 2 == 0, F.concat(F.lit("RQ-"), k.cast("string"))).otherwise(F.concat(F.lit("REQ-2001-"), k.cast("string")))
    checked = op.validate(rows.withColumn("id", k).withColumn("ledger_id", ident), "old_status")
    return checked.select(F.col("id").alias("ledger_id"), F.array_join("errors", ",").alias("errors"))


@BOOK.query("""SELECT o_orderstatus AS status, count(*)::BIGINT AS n, round(100.0 * count(*) / (SELECT count(*) FROM orders), 1) AS share FROM orders GROUP BY 1 ORDER BY n DESC, status LIMIT 12""")
def status_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses with their share of all rows."""
    return op.top_values(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"), "status", 12)


@BOOK.query("""WITH c AS (SELECT c_name || ['의원', ' 처', '실', '팀', ' 관', ''][1 + c_custkey % 6] AS name FROM customer)
SELECT trim(regexp_replace(trim(name), '\\s*(의원|처|실|팀|관)$', '')) AS stem, count(*)::BIGINT AS n FROM c GROUP BY 1""")
def requester_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without their endings."""
    ends = F.array(*[F.lit(x) for x in ("의원", " 처", "실", "팀", " 관", "")])
    named = table(spark, sf_dir, "customer").select(F.concat("c_name", F.get(ends, (F.col("c_custkey") % 6).cast("int"))).alias("name"))
    return named.groupBy(requester_stem("name").alias("stem")).agg(F.count("*").alias("n"))


# Old keys: a document's first line was its own, the hash of its text that of the document before it, for two in five.
_KEYS = """k AS (SELECT doc_id, lpad(doc_id::VARCHAR, 12, '0') AS path, nullif(split_part(text, chr(10), 1), '') AS line, md5(text) AS hash FROM documents WHERE doc_id IS NOT NULL),
old AS (SELECT 'line' AS kind, line AS value, max('OLD-' || path) AS old_id FROM k WHERE doc_id % 7 <> 3 GROUP BY ALL UNION ALL
  SELECT 'hash', hash, max('OLD-' || lpad((doc_id + 1)::VARCHAR, 12, '0')) FROM k WHERE doc_id % 5 < 2 GROUP BY ALL),
held AS (SELECT path, 0 AS r, 'line' AS kind, line AS value FROM k WHERE line IS NOT NULL UNION ALL SELECT path, 1, 'hash', hash FROM k WHERE hash IS NOT NULL),
claims AS (SELECT path, list(old_id ORDER BY r) AS ids FROM (SELECT kind, value, min(path) AS path, any_value(r) AS r FROM held GROUP BY kind, value) JOIN old USING (kind, value) GROUP BY path),
turns AS (SELECT *, row_number() OVER (ORDER BY path) AS i FROM claims)"""


@BOOK.query(f"""WITH RECURSIVE {_KEYS}, s AS (
  SELECT 0::BIGINT AS i, ''::VARCHAR AS path, []::VARCHAR[] AS taken, NULL::VARCHAR AS got
  UNION ALL
  SELECT t.i, t.path, CASE WHEN x IS NULL THEN taken ELSE list_append(taken, x) END, x FROM (SELECT t.i, t.path, s.taken, list_filter(t.ids, lambda y: NOT list_contains(s.taken, y))[1] AS x FROM s JOIN turns t ON t.i = s.i + 1) t)
SELECT k.path, s.got AS old_id FROM k LEFT JOIN s USING (path)""")
def reused_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of documents whose keys had ids before, taken in path order."""
    k = table(spark, sf_dir, "documents").filter("doc_id is not null").select("doc_id", F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.nullif(F.substring_index("text", "\n", 1), F.lit("")).alias("line"), F.md5("text").alias("hash"))
    lines = k.filter("doc_id % 7 <> 3 and line is not null").select(F.lit("line").alias("kind"), F.col("line").alias("value"), F.concat(F.lit("OLD-"), "path").alias("old_id"))
    hashes = k.filter("doc_id % 5 < 2 and hash is not null").select(F.lit("hash").alias("kind"), F.col("hash").alias("value"), F.concat(F.lit("OLD-"), F.lpad((F.col("doc_id") + 1).cast("string"), 12, "0")).alias("old_id"))
    return op.reuse_ids(k.select("path", "line", "hash"), lines.unionByName(hashes), ["line", "hash"]).select("path", "old_id")
