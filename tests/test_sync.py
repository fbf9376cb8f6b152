from pyspark.sql import functions as F

from scribelake.operators import sync


def test_plan_ids(spark):
    sheet = spark.createDataFrame(
        [
            ("2026", 2, "REQ-2026-004", "a", "r"),
            ("2026", 3, "", "b", "r"),
            ("2026", 4, "REQ-2026-004", "c", "r"),
            ("2026", 5, None, "new", None),
            ("2025", 2, "", "p", "r"),
            ("2025", 3, "bad", "q", "r"),
        ],
        "year string, row_no int, ledger_id string, title string, requester string",
    )
    stored = spark.createDataFrame(
        [("REQ-2026-007", "2026", "b", "r", ""), ("REQ-2026-002", "2026", "c", "r", "[삭제]"), ("REQ-2025-001", "2025", "other", "r", "")],
        "ledger_id string, year string, title string, requester string, status string",
    )
    got = {(r.year, r.row_no): (r.ledger_id, r.origin) for r in sync.plan_ids(sheet, stored).collect()}
    assert got == {
        ("2026", 2): ("REQ-2026-004", "explicit"),
        ("2026", 3): ("REQ-2026-007", "content"),
        ("2026", 4): ("REQ-2026-008", "new"),
        ("2026", 5): ("REQ-2026-009", "new"),
        ("2025", 2): ("REQ-2025-001", "position"),
        ("2025", 3): ("REQ-2025-002", "legacy"),
    }
    assert sync.plan_ids(sheet.limit(0), stored).count() == 0
    ids = {(r.year, r.row_no): r.ledger_id for r in sync.position_ids(sheet).collect()}
    assert ids == {("2026", 2): "REQ-2026-004", ("2025", 2): "REQ-2025-001", ("2025", 3): "REQ-2025-002"}


def test_numbered_across_spans(spark):
    rows = spark.range(0, 1000, 7).withColumn("g", F.col("id") % 2)
    for g in (0, 1):
        got = [r.n for r in sync.numbered(rows, ["g"], "id", "n", span=50).filter(F.col("g") == g).orderBy("id").collect()]
        assert got == list(range(1, len(got) + 1))


def test_replay(spark):
    requests = spark.createDataFrame([(1, 1, "k", "a"), (2, 2, "k", "a"), (3, 3, "k", "b"), (4, 4, "", "a"), (5, 5, None, "a"), (6, 6, "s", "a"), (7, 7, "s", "b"), (8, 8, "d", "a")], "request_id int, seq int, request_key string, title string")
    old = spark.createDataFrame([("s", "a", "L1", ""), ("d", "a", "L2", "[삭제]")], "request_key string, title string, ledger_id string, status string").withColumn("content_hash", sync.content_hash(["title"]))
    got = {r.request_id: (r.outcome, r.ledger_id) for r in sync.replay(requests, old, ["title"]).collect()}
    assert got == {1: ("insert", None), 2: ("replay", None), 3: ("conflict", None), 4: ("insert", None), 5: ("insert", None), 6: ("replay", "L1"), 7: ("conflict", None), 8: ("conflict", None)}


def test_identity(spark):
    side = "struct<title: string, requester: string, aide: string, seq_no: string>"
    rows = spark.createDataFrame(
        [
            (1, "update", ("a b", "r", None, "1"), ("ab", "z", "", ""), ("c", "r", "", "1")),
            (2, "update", ("a", "r", None, "1"), ("c", "r", "", "1"), ("d", "r", "", "1")),
            (3, "delete", ("", None, None, "007"), None, ("x", "", "", "7")),
            (4, "update", ("", None, None, ""), None, ("x", "", "", "7")),
            (5, "insert", ("a", "", "", ""), ("a", "", "", ""), ("b", "", "", "")),
        ],
        f"id int, action string, row {side}, expected {side}, item {side}",
    )
    assert {r.id: r.ok for r in rows.select("id", sync.accepts().alias("ok")).collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_absence_needs_most_rows(spark):
    schema = "ledger_id string, title string, status string"
    stored = spark.createDataFrame([(k, "t", "") for k in "abcde"] + [(None, "t", "")], schema)
    none = stored.filter("false").select("ledger_id")
    protected = none.withColumn("fields", F.array().cast("array<string>"))
    for kept, action in (("abc", "DELETE"), ("ab", "KEEP")):
        plan = sync.plan_sync(stored, stored.filter(F.col("ledger_id").isin(*kept)), ["title", "status"], protected, none, stored.select("ledger_id"))
        got = {r.ledger_id: r.action for r in plan.collect()}
        assert got == {k: "UNCHANGED" if k in kept else action for k in "abcde"}


def test_write_back_and_ghosts(spark):
    sheet = spark.createDataFrame([("a", "t", "x [삭제]", ""), ("b", "t", "", ""), ("c", "t", None, "")], "ledger_id string, title string, note string, status string")
    ops = spark.createDataFrame([("a", "delete", None, "", "", ""), ("c", "delete", None, "", "", ""), ("b", "update", ["title"], "u", "n", "s"), ("d", "update", ["title"], "u", "n", "s"), ("e", "delete", None, "", "", "")], "ledger_id string, action string, changed_fields array<string>, title string, note string, status string")
    got = {r.ledger_id: tuple(r)[1:] for r in sync.write_back(sheet, ops, ["title", "note", "status"]).collect()}
    assert got == {"a": ("t", "x [삭제]", "[삭제]"), "b": ("u", "", ""), "c": ("t", "[삭제]", "[삭제]"), "d": ("u", "n", "s")}
    rows = spark.createDataFrame([("REQ-1", "", None, "", " "), ("REQ-2", "", "t", "", ""), ("", "", "", "", "")], "ledger_id string, seq_no string, title string, details string, requester string")
    assert [r.ledger_id for r in sync.ghosts(rows).collect()] == ["REQ-1"]


def test_purge_reads_applied_snapshots(spark):
    rows = spark.createDataFrame([("a", "r", "t"), ("b", "r", "u")], "ledger_id string, requester string, title string")
    history = spark.createDataFrame([(1, "a", "UPDATE", "{}"), (2, "z", "EXCEL_APPLIED", '{"requester": "r", "title": "t"}'), (3, "z", "UPDATE", '{"requester": "r", "title": "t"}'), (4, "b", "EXCEL_APPLIED", "bad")], "history_id int, ledger_id string, action string, snapshot string")
    kept, left, purged = sync.purge(rows, history, rows.filter("title = 't'").select("requester", "title"))
    assert [r.ledger_id for r in kept.collect()] == ["b"] and [r.ledger_id for r in purged.collect()] == ["a"]
    assert sorted(r.history_id for r in left.collect()) == [3, 4]


def test_budget_and_empty_report(spark):
    rows = spark.createDataFrame([("가" * 10,), (None,)], "t string")
    assert [(r.bytes, r.too_large) for r in sync.oversize(rows, 20).collect()] == [(38, True), (2, False)]
    empty = spark.createDataFrame([], "ok boolean, seconds double")
    assert tuple(sync.parse_report(empty).first()) == (0, 0, 0, 0.0, 0.0)
