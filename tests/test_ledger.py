import datetime
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scribelake.operators import corpus, ledger
from scribelake.sources import readers, sinks
from scribelake.streaming import feeds

DAY = datetime.date(2026, 1, 1)


def test_apply_operations(spark):
    stored = spark.createDataFrame([("A", "t", "작성중", "v1"), ("B", "t", "[삭제]", "v1"), ("C", "t", "작성중", "v1")], "ledger_id string, title string, status string, updated_at string")
    ops = spark.createDataFrame(
        [
            ("o1", 1, "A", "update", {"title": "x"}, "v1"),
            ("o2", 2, "A", "update", {"title": "y"}, "v1"),
            ("o1", 3, "A", "update", {"title": "z"}, None),
            ("o3", 4, "B", "update", {"title": "x"}, None),
            ("o4", 5, "C", "delete", {}, None),
            ("o5", 6, "D", "insert", {"title": "new", "status": "작성중"}, None),
            ("o6", 7, "E", "delete", {}, None),
        ],
        "operation_id string, seq long, ledger_id string, action string, item map<string,string>, expected_version string",
    )
    table, history, rejects = ledger.apply_operations(stored, ops, ["title", "status"], as_of=DAY)
    rows = {r.ledger_id: r for r in table.collect()}
    assert rows["A"].title == "x" and rows["C"].status == "[삭제]" and rows["D"].title == "new" and "E" not in rows
    assert {(r.operation_id, r.reason) for r in rejects.collect()} == {("o2", "conflict"), ("o3", "deleted"), ("o6", "missing")}
    assert {r.action for r in history.collect()} == {"UPDATE", "DELETE", "INSERT"}


OPS = "operation_id string, seq long, ledger_id string, action string, item map<string,string>, expected_version string"


def test_operations_apply_one_after_the_other(spark):
    stored = spark.createDataFrame([("A", "t", "작성중", "n", "2026-01-05", "2026", "v1"), ("B", "t", "[삭제]", "x", "", "2026", "v1"), ("C", "t", "작성중", "n", "", "2026", "v1")], "ledger_id string, title string, status string, note string, deadline string, year string, updated_at string")
    ops = [
        ("a1", 1, "A", "update", {"title": "t ", "note": " n"}, None), ("a2", 2, "A", "update", {"deadline": "1.5"}, None), ("a3", 3, "A", "update", {"title": "x"}, "v1"), ("a4", 4, "A", "update", {"title": "y"}, "3"), ("a5", 5, "A", "update", {"title": "z"}, "3"),
        ("a6", 6, "A", "delete", {}, None), ("a7", 7, "A", "update", {"title": "late"}, None), ("a8", 8, "A", "restore", {}, None), ("a9", 9, "A", "update", {"deadline": "2026.2.30"}, None), ("a10", 10, "A", "update", {"status": ""}, None),
        ("b1", 11, "B", "restore", {}, None), ("c1", 12, "C", "restore", {}, None), ("d1", 13, "D", "insert", {"title": "010-1234-5678", "deadline": "2026.3.4"}, None), ("d2", 14, "D", "insert", {"title": "again"}, None), ("e1", 15, "E", "insert", {"title": ""}, None),
    ]
    fields = ["title", "status", "note", "deadline", "year"]
    table, history, rejects = ledger.apply_operations(stored, spark.createDataFrame(ops, OPS), fields, as_of=DAY)
    rows = {r.ledger_id: r for r in table.collect()}
    assert (rows["A"].title, rows["A"].status, rows["A"].note, rows["A"].deadline, rows["A"].updated_at) == ("y", "작성중", "n", "2026-01-05", "8")
    assert rows["B"].status == "[삭제]" and rows["C"].updated_at == "v1" and rows["D"].title == "010-****-5678" and rows["D"].deadline == "2026-03-04" and rows["D"].status == "작성중" and "E" not in rows
    assert {r.operation_id: r.reason for r in rejects.collect()} == {"a5": "conflict", "a7": "deleted", "a9": "invalid", "a10": "invalid", "b1": "invalid", "c1": "not deleted", "d2": "exists", "e1": "invalid"}
    log = {(r.ledger_id, r.seq): (r.action, json.loads(r.snapshot), r.changed_fields) for r in history.collect()}
    assert set(log) == {("A", 3), ("A", 4), ("A", 6), ("A", 8), ("D", 13)}
    assert log["A", 4][1]["title"] == "x" and log["A", 6][1]["title"] == "y" and log["A", 8][1]["status"] == "작성중" and log["A", 3][2] == "title,updated_at" and log["A", 8][2] == "note,status,updated_at"
    known = spark.createDataFrame([("B", 1, '{"status": "제출", "note": "old"}'), ("B", 2, '{"status": "완료", "note": "last"}')], "ledger_id string, history_id long, snapshot string")
    back = {r.ledger_id: r for r in ledger.apply_operations(stored, spark.createDataFrame(ops, OPS), fields, deletions=known, as_of=DAY)[0].collect()}
    assert back["B"].status == "완료" and back["B"].note == "last"


def test_marked_as_submitted(spark):
    stored = spark.createDataFrame([("A", "t", "작성중", "", "2026", "v1"), ("B", "t", "작성중", "2026-01-01", "2026", "v1")], "ledger_id string, title string, status string, submit_date string, year string, updated_at string")
    ops = ledger.mark_submitted(stored, datetime.date(2026, 1, 10)).withColumn("seq", F.monotonically_increasing_id()).withColumn("operation_id", F.col("ledger_id"))
    rows = {r.ledger_id: r for r in ledger.apply_operations(stored, ops, ["title", "status", "submit_date", "year"], as_of=DAY)[0].collect()}
    assert (rows["A"].status, rows["A"].submit_date, rows["B"].submit_date) == ("제출", "2026-01-10", "2026-01-01")
    versions = ledger.with_versions(ops).select("updated_at")
    assert versions.distinct().count() == 2


def test_timeline(spark):
    h = spark.createDataFrame([(1, "A", "INSERT", "s0"), (2, "A", "UPDATE", "s0"), (3, "A", "RESTORE", "sr"), (4, "A", "UPDATE", "s1")], "history_id long, ledger_id string, action string, snapshot string")
    now = spark.createDataFrame([("A", "s2")], "ledger_id string, state string")
    got = {r.history_id: (r.before, r.after) for r in ledger.timeline(h, now).collect()}
    assert got == {1: (None, "s0"), 2: ("s0", "s1"), 3: (None, "sr"), 4: ("s1", "s2")}


def test_field_changes(spark):
    df = spark.createDataFrame([('{"title": "a", "note": "n"}', '{"title": "b"}'), ("bad", "[1]")], "x string, y string")
    changes = ledger.field_changes(ledger.parse_snapshot("x"), ledger.parse_snapshot("y"), ["title", "note", "status"])
    got = [[(c.field, c.before, c.after) for c in r[0]] for r in df.coalesce(1).select(changes).collect()]
    assert got == [[("title", "a", "b"), ("note", "n", "")], []]
    shots = spark.createDataFrame([('{"aide": "010-1234-5678", "title": "010-1234-5678"}',), ("no object 010-1234-5678",)], "s string")
    masked = [r[0] for r in shots.coalesce(1).select(ledger.mask_snapshot("s")).collect()]
    assert json.loads(masked[0]) == {"aide": "010-****-5678", "title": "010-1234-5678"} and masked[1] == "no object 010-****-5678"


def test_ids(spark):
    known = spark.createDataFrame([("path", "p1", "DOC-1"), ("hash", "h", "DOC-2"), ("hash", "h2", "DOC-1")], "kind string, value string, old_id string")
    fresh = spark.createDataFrame([("a", "p1", "h2"), ("b", None, "h"), ("c", None, "h"), ("d", None, "h2")], "path string, key string, hash string").withColumnRenamed("key", "path_key")
    fresh = fresh.select("path", F.col("path_key").alias("p"), "hash")
    known = known.replace("path", "p", "kind")
    got = {r.path: r.old_id for r in ledger.reuse_ids(fresh, known, ["p", "hash"]).collect()}
    assert got == {"a": "DOC-1", "b": "DOC-2", "c": None, "d": None}


@pytest.mark.parametrize("seed", [1, 2])
def test_ids_are_reused_as_a_plain_loop_does(spark, seed):
    """Random claims over few values, so that ids, keys and rows compete, and one long chain."""
    rng = random.Random(seed)
    kinds = ["md", "source", "hash"]
    old = {(k, f"{k}{v}"): f"DOC-{rng.randint(0, 25)}" for k in kinds for v in range(30)}
    rows = [(f"p{i:02d}", *[rng.choice([None, "", f"{k}{rng.randint(0, 39)}"]) for k in kinds]) for i in range(50)]
    chain = [(f"q{i}", f"c{i}", f"c{i + 1}", None) for i in range(6)]  # each takes what the one before left
    rows, old = rows + chain, old | {("md", f"c{i}"): f"C-{max(i - 1, 0)}" for i in range(6)} | {("source", f"c{i}"): f"C-{i}" for i in range(8)}
    now, taken, want = dict(old), set(), {}
    for path, *values in sorted(rows):
        keys = [(k, v) for k, v in zip(kinds, values) if v]
        got = next((now[k] for k in keys if k in now and now[k] not in taken), None)
        for k in keys:
            now[k] = got or path
        taken |= {got or path}
        want[path] = got
    fresh = spark.createDataFrame(rows, "path string, md string, source string, hash string").repartition(3)
    known = spark.createDataFrame([(*k, v) for k, v in old.items()], "kind string, value string, old_id string")
    assert {r.path: r.old_id for r in ledger.reuse_ids(fresh, known, kinds).collect()} == want
    assert ledger.reuse_ids(fresh, known.limit(0), kinds).filter("old_id is not null").count() == 0


def test_source_of_a_later_row_does_not_go_before_the_hash_of_an_earlier(spark):
    fresh = spark.createDataFrame([("a", None, "h"), ("b", "s", None)], "path string, source string, hash string")
    known = spark.createDataFrame([("hash", "h", "X"), ("source", "s", "X")], "kind string, value string, old_id string")
    assert {r.path: r.old_id for r in ledger.reuse_ids(fresh, known, ["source", "hash"]).collect()} == {"a": "X", "b": None}


@pytest.mark.parametrize("chunk", [1, 7, 100, 10_000])
def test_blocks_close_as_in_a_plain_loop(spark, chunk):
    rng = random.Random(chunk)
    rows = [(i, "x" * rng.choice([0, 0, 1, 5, 40, 150])) for i in range(300)] + [(300, None)]
    want, block, fill = {}, 0, 0
    for i, body in rows:
        want[i] = block
        fill += len(body or "")
        if fill >= chunk:
            block, fill = block + 1, 0
    docs = spark.createDataFrame(rows, "id long, body string").repartition(7)
    assert {r.id: r.block for r in corpus.greedy_blocks(docs, ["id"], "id", "body", chunk, 10).collect()} == want
    assert {r.block for r in corpus.greedy_blocks(docs, ["id"], "id", "body", chunk, 10**9).collect()} == {0}
    assert corpus.greedy_blocks(docs.limit(0), ["id"], "id", "body", chunk, 0).count() == 0


def test_fingerprints(spark):
    rows = lambda *x: spark.createDataFrame([(v,) for v in x], "v string")
    hash_of = lambda *x: corpus.multiset_hash(rows(*x)).head()
    assert hash_of("a", "bb", "bb") != hash_of("a", "cc", "cc")
    assert hash_of("a", "bb", None) == hash_of(None, "a", "bb") != hash_of("a", "bb", "")
    whole, more, less = (corpus.multiset_hash(rows(*x)) for x in (("a", "b", "b"), ("c",), ("b",)))
    assert corpus.merged_hash(whole, more, less).head() == hash_of("a", "b", "c")
    both = {r.table: r.hash for r in corpus.fingerprint({"x": rows("a"), "y": rows()}, {"x": "v"}).collect()}
    swapped = {r.table: r.hash for r in corpus.fingerprint({"x": rows(), "y": rows("a")}, {"y": "v"}).collect()}
    assert set(both) == {"x", "y", ""} and both[""] != swapped[""]


def test_links_and_gates(spark):
    led = spark.createDataFrame([("L1", "2026", "12", "김철수 의원", "2026-01-01"), ("L2", "2026", "", "이영희 의원", "2026-01-02"), ("L3", "2026", "1", "x", "")], "ledger_id string, year string, seq_no string, requester string, request_date string")
    docs = spark.createDataFrame([("D1", 1, "2026", "0012", "y", "", "a/112.md"), ("D2", 2, "2026", "7", "이영희", "2026-01-02", "a/12.md")], "doc_id string, doc_order int, year string, doc_number string, requester string, request_date string, original_path string")
    assert {r.ledger_id: r.linked_doc_id for r in ledger.link(led, docs).collect()} == {"L1": "D1", "L2": "D2", "L3": None}
    assert {r.ledger_id: r.doc_id for r in ledger.link_by_token(led, docs).collect()} == {"L1": "D2"}
    with pytest.raises(ledger.GateError):
        ledger.shrink_gate(spark.range(100), spark.range(80))
    ledger.shrink_gate(spark.range(100), spark.range(95))
    assert ledger.may_delete(50, 100) and not ledger.may_delete(49, 100)
    assert not ledger.may_prune(5, 0) and not ledger.may_prune(6, 10) and ledger.may_prune(4, 10)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "md").mkdir()
    (tmp_path / "md" / "a.md").write_text("<!-- source: in/a.hwp -->\n010-1234-5678 본문", encoding="utf-8")
    row = readers.markdown(spark, str(tmp_path / "md")).first()
    assert row.header == "in/a.hwp" and row.full_markdown == "010-****-5678 본문"
    a = spark.createDataFrame([("1", "자료", ""), ("", "", "")], "`연번` string, `제목` string, `요구자료` string")
    assert [r.title for r in readers.ledger_extracts({"2026": a}).collect()] == ["자료"]
    h = spark.range(10).withColumnRenamed("id", "history_id")
    sinks.archive(h, h.filter("history_id < 4"), str(tmp_path / "archive"), str(tmp_path / "kept"))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 6
    for day in ("2026-01-01", "2026-01-02", "2026-01-02"):
        sinks.snapshot(h, str(tmp_path / "snap"), day)
    assert [r.day for r in sinks.expired_snapshots(spark, str(tmp_path / "snap"), 1).collect()] == ["2026-01-01"]


def test_evidence_and_sources(spark):
    sources = spark.createDataFrame([("a", "body text")], "source_id string, body string")
    good = sources.select(F.concat(F.lit("sha256:"), F.sha2("body", 256))).first()[0]
    cited = spark.createDataFrame([(1, "a", good, "text"), (2, "a", good, "none"), (3, "a", "sha256:0", "text"), (4, "z", good, "text")], "pack_id int, source_id string, hash string, excerpt string")
    assert {r.pack_id: r.state for r in corpus.verify_evidence(cited, sources).collect()} == {1: "source_text_match", 2: "verification_failed", 3: "source_stale", 4: "source_missing"}
    rows = spark.createDataFrame([("y/a.md", "in/a.hwp"), ("in/b.md", None), ("z/c.md", None), ("q.md", None)], "path string, header string")
    listing = spark.createDataFrame([("in/a.hwp",), ("in/b.pdf",), ("c.pdf",)], "source_path string")
    assert {r.path: r.source_path for r in corpus.find_source(rows, listing).collect()} == {"y/a.md": "in/a.hwp", "in/b.md": "in/b.pdf", "z/c.md": "c.pdf", "q.md": None}


def test_feed_equals_batch(spark, tmp_path):
    schema = "operation_id string, seq long, ledger_id string, action string, item map<string,string>, expected_version string, ts timestamp"
    ops = spark.createDataFrame([("o1", 1, "A", "update", {"title": "x"}, None), ("o1", 1, "A", "update", {"title": "x"}, None), ("o2", 2, "A", "delete", {}, None)], schema.rsplit(",", 1)[0]).withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    ops.write.parquet(str(tmp_path / "ops"))
    stored = spark.createDataFrame([("A", "t", "작성중", "v1")], "ledger_id string, title string, status string, updated_at string")
    saved = {}

    def save(table, history, rejects, batch):
        saved[batch] = ([tuple(r) for r in table.collect()], history.count())

    q = feeds.change_feed(spark.readStream.schema(schema).parquet(str(tmp_path / "ops")), lambda: stored, save, ["title", "status"], str(tmp_path / "cp"), DAY)
    q.awaitTermination(60)
    want = [tuple(r) for r in ledger.apply_operations(stored, ops, ["title", "status"], as_of=DAY)[0].collect()]
    assert saved[0] == (want, 2)


def test_attempts_and_intake(spark):
    rows = spark.createDataFrame([("a", "update", 0, None), ("b", "delete", 0, "missing"), ("c", "update", 0, "conflict"), ("d", "update", 4, "io"), ("e", "update", 1, "io")], "operation_id string, action string, attempts int, reason string")
    routed = {k: {r.operation_id for r in v.collect()} for k, v in feeds.route_attempts(rows).items()}
    assert routed == {"ok": {"a", "b"}, "retry": {"e"}, "dead": {"c", "d"}}
    files = spark.createDataFrame([("in/a.pdf",), ("in/~$a.xlsx",), ("in/b.exe",)], "path string")
    ok, bad = feeds.intake(files)
    assert [r.path for r in ok.collect()] == ["in/a.pdf"] and [r.path for r in bad.collect()] == ["in/b.exe"]


def most_rows(df):
    """The largest number of rows that a step of the executed plan gave."""
    df.collect()
    todo, most = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        inner = node.executedPlan() if kind == "AdaptiveSparkPlanExec" else node.plan() if kind.endswith("QueryStageExec") else None
        children = node.children()
        todo += [inner] if inner is not None else [children.apply(i) for i in range(children.size())]
        rows = node.metrics().get("numOutputRows")
        most = max(most, rows.get().value() if rows.isDefined() else 0)
    return most


LINKED = "ledger_id int, year string, seq_no string, requester string, request_date string"
LINKABLE = "doc_id int, year string, doc_number string, original_path string, requester string, request_date string"


def test_busy_numbers_and_days_make_no_pairs(spark):
    n = 400
    led = spark.createDataFrame([(i, "2026", "7", f"Customer#{i:04d}", "2026-01-01") for i in range(n)], LINKED)
    docs = spark.createDataFrame([(i, "2026", "7", f"in/{i}a", f"Customer#{i:04d}", "2026-01-01") for i in range(n)], LINKABLE)
    token, contained = ledger.link_by_token(led, docs), ledger.link_by_contained(led, docs)
    assert most_rows(token) <= 10 * n and most_rows(contained) <= 10 * n
    assert token.count() == 0 and sorted(map(tuple, contained.collect())) == [(i, i) for i in range(n)]


def test_links_against_all_pairs(spark):
    rng = random.Random(3)
    text = lambda k: "".join(rng.choice("abc ") for _ in range(rng.randint(0, k)))
    year, day = lambda: rng.choice(["2025", "2026", "", None, " "]), lambda: rng.choice(["2026-01-01", "2026-01-02", "", None])
    led = [(rng.choice([i, i, i // 2, None]), year(), rng.choice(["1", "02", "", None]), rng.choice([text(3), None]), day()) for i in range(120)]
    docs = [(rng.choice([i, i, None]), year(), rng.choice(["1", "2", "x", None]), f"in/{rng.randint(1, 4)}", rng.choice([text(6), None]), day()) for i in range(60)]
    got = lambda f: sorted(map(tuple, f(spark.createDataFrame(led, LINKED), spark.createDataFrame(docs, LINKABLE)).collect()), key=str)
    blank = lambda x: not (x or "").strip()
    held, shown = {}, {}
    for key, y, seq, who, on in led:
        for d, dy, number, path, name, don in docs:
            stem = (who or "").strip()
            if stem and on and on == don and name and stem in name and (blank(y) or blank(dy) or y == dy):
                held.setdefault(key, set()).add(d)
            if y is not None and y == dy and {seq or "", (seq or "").lstrip("0")} & set(re.findall(r"\d+", f"{number or ''} {path}")) - {""}:
                shown.setdefault(key, set()).add(d)
    assert got(ledger.link_by_contained) == sorted(((k, min(v - {None}, default=None)) for k, v in held.items()), key=str)
    assert got(ledger.link_by_token) == sorted(((k, *(v - {None})) for k, v in shown.items() if len(v - {None}) == 1), key=str)


def test_operations_of_a_key_are_read_one_by_one(spark, monkeypatch):
    """Keys that repeat or are null, operations over many small batches: as if each stored row took its key's operations in turn."""
    rng = random.Random(5)
    keys = [*"ABCDE", None]
    stored = [(k, f"t{i}", "작성중", "v1") for i, k in enumerate([*"ABCD", "B", None])]
    ops = [(f"o{i}", i, rng.choice(keys), rng.choice(["update", "update", "delete", "restore", "insert"]), {"title": rng.choice("xyz"), "requester": "r"}, rng.choice([None, "v1"])) for i in range(300)]
    plans = []
    monkeypatch.setattr(ledger, "cut", lambda df, old=ledger.cut: plans.append(df._jdf.queryExecution().toString()) or old(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = ledger.apply_operations(spark.createDataFrame(stored, "ledger_id string, title string, status string, updated_at string"), spark.createDataFrame(ops, OPS), ["title", "status"], as_of=DAY)
        table, history, rejects = ([tuple(r) for r in df.collect()] for df in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert plans and not any("collect_list" in p for p in plans)  # no row holds the operations of a key
    rows, writes, refused = [], [], []
    for key in keys:
        mine = [{"title": t, "status": s, "updated_at": v} for k, t, s, v in stored if k == key is not None] or [None]
        rows += [r for r in stored if r[0] is None] if key is None else []
        for state in mine:
            dead = None
            for o, seq, k, action, item, expected in ops:
                if k != key:
                    continue
                alive, reason = state is not None and state["status"] != "[삭제]", None
                after = None
                if action == "insert":
                    reason = "exists" if state else None
                    after = None if state else {"title": item["title"], "status": "작성중"}
                elif state is None:
                    reason = "missing"
                elif action == "restore":
                    reason = "not deleted" if alive else None if dead else "invalid"
                    after = None if reason else state | {"status": dead}
                elif not alive:
                    reason = "missing" if action == "delete" else "deleted"
                elif action == "delete":
                    after, dead = state | {"status": "[삭제]"}, state["status"]
                elif expected not in (None, state["updated_at"]):
                    reason = "conflict"
                elif item["title"] != state["title"]:
                    after = state | {"title": item["title"]}
                if reason:
                    refused.append((key, o, seq, action, reason))
                elif after:
                    state = after | {"updated_at": str(seq)}
                    writes.append((key, action.upper(), seq))
            if state:
                rows.append((key, *state.values()))
    same = lambda a, b: sorted(a, key=str) == sorted(b, key=str)
    assert same(table, rows) and same([h[:3] for h in history], writes) and same(rejects, refused)
