import datetime
import os
import time

import pytest
from pyspark.sql import functions as F

from scribelake.operators import ledger
from scribelake.streaming import feeds, queue, stores

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "ledger_id string, operation_id string, seq long, kind string, action string, payload string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def attempt(key, operation, attempts):
    """The payload says how the work goes: "io 2" fails twice."""
    word, _, times = operation["payload"].partition(" ")
    return None if word == "ok" or times and attempts >= int(times) else word


OPERATIONS = [
    ("A", "a1", 1, "operation", "update", "ok"),
    ("A", "a2", 2, "operation", "update", "io 2"),
    ("A", "a3", 3, "operation", "delete", "missing"),
    ("B", "b1", 1, "operation", "update", "io 99"),
    ("B", "b2", 2, "operation", "update", "ok"),
    ("C", "c1", 1, "operation", "update", "conflict"),
    ("C", "c2", 2, "operation", "update", "ok"),
    ("A", "a1", 1, "operation", "update", "ok"),
]
LATER = [("A", "a4", 4, "operation", "update", "ok"), ("B", "b1", 1, "operation", "update", "io 99"), ("C", "c1", 1, "retry", None, None), ("C", "c3", 0, "operation", "update", "ok")]


def plain(key):
    """What a plain queue does with the operations of a key, in order: (id, state, attempts)."""
    out = []
    for _, name, _, _, action, payload in [r for r in dict.fromkeys(OPERATIONS) if r[0] == key]:
        n = 0
        while (reason := attempt(key, {"payload": payload}, n)) is not None and not (action == "delete" and reason == "missing"):
            n += 1
            if reason == "conflict" or n >= 5:
                out.append((name, "quarantined", n))
                break
            out.append((name, "retry", n))
        else:
            out.append((name, "applied", n))
    return out


def test_retry_queue_with_a_restart_in_the_middle(rocks, tmp_path):
    """Operations with failures; the query is stopped between attempts and goes on from its checkpoint."""
    spark = rocks
    events = stores.OnceTable(spark, str(tmp_path / "events"), queue.OUTPUT + ", event string", id="event", buckets=2)

    def save(rows, batch_id):
        events.append(rows.withColumn("event", F.concat_ws("|", "operation_id", "state", "attempts", "at")), batch_id)

    def start():
        rows = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        out = queue.retry_queue(rows, queue.RetryQueue(attempt, backoff=lambda n: 1))
        return out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").foreachBatch(save).start()

    def until(query, test):
        for _ in range(120):
            got = events.read().collect()
            if test(got):
                break
            if query.exception():
                raise query.exception()
            time.sleep(0.5)
        query.stop()
        return got

    def put(rows, name):
        os.makedirs(tmp_path / "in", exist_ok=True)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    put(OPERATIONS, "1")
    until(start(), lambda got: any(r.operation_id == "b1" and r.attempts >= 2 for r in got))
    got = until(start(), lambda got: any(r.operation_id == "b2" for r in got) and any(r.operation_id == "a3" for r in got))
    for key in "ABC":
        mine = sorted((r.at, r.seq, r.attempts, r.operation_id, r.state) for r in got if r.ledger_id == key)
        assert [(name, state, n) for _, _, n, name, state in mine] == plain(key), key
    assert {r.operation_id for r in queue.dead_letters(events.read()).collect()} == {"b1", "c1"}
    put(LATER, "2")
    got = until(start(), lambda got: sum(r.operation_id == "c1" for r in got) >= 3 and any(r.operation_id == "a4" for r in got))
    done = sorted((r.operation_id, r.state) for r in got if r.operation_id in ("a4", "b1", "c3") and r.state != "retry")
    assert done == [("a4", "applied"), ("b1", "quarantined"), ("c3", "applied")]  # b1 had come before: it counts once
    assert sorted(r.state for r in got if r.operation_id == "c1") == ["quarantined", "quarantined", "requeued"]


class Broken(stores.OnceTable):
    """Crashes after the data of a batch is written and before it is committed."""

    def _commit(self, batch_id):
        raise RuntimeError("crash")


def test_delivery_counts_once(spark, tmp_path):
    """A crash between write and commit, a replayed batch, and an id that comes again beyond any watermark."""
    schema = "operation_id string, seq long, v string"
    rows = lambda *x: spark.createDataFrame(x, schema)
    once = stores.OnceTable(spark, str(tmp_path / "t"), schema, order="seq", buckets=3)
    assert once.read().count() == 0
    once.append(rows(("a", 2, "late"), ("a", 1, "first"), ("b", 1, "b"), (None, 1, "no id")), 0)
    with pytest.raises(RuntimeError):
        Broken(spark, str(tmp_path / "t"), schema, order="seq", buckets=3).append(rows(("c", 3, "c"), ("b", 9, "again")), 1)
    assert {r.operation_id for r in once.read().collect()} == {"a", "b"}
    for _ in range(2):
        once.append(rows(("c", 3, "c"), ("b", 9, "again")), 1)
    once.append(rows(("a", 50, "much later"), ("d", 1, "d")), 2)
    assert sorted(map(tuple, once.read().collect())) == [("a", 1, "first"), ("b", 1, "b"), ("c", 3, "c"), ("d", 1, "d")]


def test_a_stream_delivers_once_across_a_crash(spark, tmp_path):
    schema = "operation_id string, seq long, v string"
    spark.createDataFrame([(f"o{i % 7}", i, "x") for i in range(20)], schema).write.parquet(str(tmp_path / "in"))

    def run(table):
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = rows.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(table.append).start()
        q.awaitTermination()

    with pytest.raises(Exception, match="crash"):
        run(Broken(spark, str(tmp_path / "t"), schema, buckets=2))
    once = stores.OnceTable(spark, str(tmp_path / "t"), schema, buckets=2)
    run(once)
    assert sorted(r.operation_id for r in once.read().collect()) == [f"o{i}" for i in range(7)]


def test_merges_rewrite_touched_buckets_only(spark, tmp_path):
    schema = "ledger_id string, v long"
    table = stores.BucketedTable(spark, str(tmp_path / "t"), schema, "ledger_id", buckets=8)
    rows = spark.createDataFrame([(f"k{i}", i) for i in range(100)], schema)
    table.merge(rows, list(range(8)), "load", 0)
    times = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(tmp_path / "t" / "data") for f in names}
    before, versions = times(), table.manifest()["versions"]
    change = spark.createDataFrame([("k3", -3), ("new", 1)], schema)
    touched = table.touched(change)
    part = table.read(touched)
    assert 0 < part.count() < 100
    merged = part.join(change.select("ledger_id"), "ledger_id", "left_anti").unionByName(change)
    table.merge(merged, touched, "feed", 7)
    table.merge(merged.limit(0), touched, "feed", 7)  # replayed: nothing
    after = times()
    assert all(after[f] == t for f, t in before.items())
    assert {b for b, v in table.manifest()["versions"].items() if versions.get(b) != v} == {str(b) for b in touched}
    want = {f"k{i}": i for i in range(100)} | {"k3": -3, "new": 1}
    assert {r.ledger_id: r.v for r in table.read().collect()} == want
    with pytest.raises(ValueError):
        table.merge(change, [b for b in range(8) if b not in touched], "feed", 8)
    assert {r.ledger_id: r.v for r in table.read().collect()} == want
    table.vacuum(keep=1)
    gone = [f for f in after if f not in times()]
    assert {r.ledger_id: r.v for r in table.read().collect()} == want and gone and all("v=1" in f for f in gone)


OPS = "operation_id string, seq long, ledger_id string, action string, item map<string,string>, expected_version string"
LEDGER = "ledger_id string, title string, status string, updated_at string"


class BrokenTable(stores.BucketedTable):
    def _commit(self, manifest):
        raise RuntimeError("crash")


def test_ledger_feed_equals_batch_across_a_crash(spark, tmp_path):
    """Three files, the first batch crashes before its mark; an operation comes again in the last one."""
    stored = [(f"k{i}", f"t{i}", "작성중", "v0") for i in range(40)]
    files = [
        [("o1", 1, "k1", "update", {"title": "x"}, None), ("o2", 2, "k2", "delete", {}, None), ("o1", 1, "k1", "update", {"title": "x"}, None)],
        [("o3", 3, "k1", "update", {"title": "y"}, "1"), ("o4", 4, "k3", "update", {"title": "z"}, "other")],
        [("o5", 5, "new", "insert", {"title": "n"}, None), ("o1", 9, "k1", "update", {"title": "x"}, None), ("o6", 6, "k2", "update", {"title": "dead"}, None)],
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(str(tmp_path / "in" / f"f={i}"))
        time.sleep(1.1)  # files are read in the order of their times
    logs = {
        "receipts": stores.OnceTable(spark, str(tmp_path / "receipts"), "operation_id string, seq long", order="seq", buckets=2),
        "history": stores.OnceTable(spark, str(tmp_path / "history"), "ledger_id string, action string, seq long, snapshot string, changed_fields string, event string", id="event", buckets=2),
        "rejects": stores.OnceTable(spark, str(tmp_path / "rejects"), "ledger_id string, operation_id string, seq long, action string, reason string, event string", id="event", buckets=2),
    }
    stores.BucketedTable(spark, str(tmp_path / "t"), LEDGER, "ledger_id", buckets=16).merge(spark.createDataFrame(stored, LEDGER), list(range(16)), "load", 0)

    def run(table):
        ops = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        feeds.ledger_feed(ops, table, fields=["title", "status"], as_of=datetime.date(2026, 1, 1), checkpoint=str(tmp_path / "cp"), **logs).awaitTermination()

    with pytest.raises(Exception, match="crash"):
        run(BrokenTable(spark, str(tmp_path / "t"), LEDGER, "ledger_id", buckets=16))
    table = stores.BucketedTable(spark, str(tmp_path / "t"), LEDGER, "ledger_id", buckets=16)
    run(table)
    every = spark.createDataFrame([r for rows in files for r in rows if r[:2] != ("o1", 9)], OPS)
    state, history, rejects = ledger.apply_operations(spark.createDataFrame(stored, LEDGER), every, ["title", "status"], as_of=datetime.date(2026, 1, 1))
    key = lambda df, *c: sorted(map(str, df.select(*c).collect()))
    assert key(table.read(), "ledger_id", "title", "status", "updated_at") == key(state, "ledger_id", "title", "status", "updated_at")
    for got, want, c in ((logs["history"], history, ("ledger_id", "action", "seq", "snapshot")), (logs["rejects"], rejects, ("operation_id", "reason"))):
        assert key(got.read(), *c) == key(want, *c)
    assert len(set(table.manifest()["versions"].values())) > 1  # some buckets were never written again


def test_extracts_of_two_writers(spark, tmp_path):
    """A changed sheet is applied, an overtaken one and an echo of one's own are not; what is undelivered goes first."""
    schema = "ledger_id string, title string, status string, sheet string, writer_id string"
    table = stores.BucketedTable(spark, str(tmp_path / "t"), "ledger_id string, year string, title string, status string", "ledger_id", buckets=4)
    rows = [("A", "2025", "a", ""), ("B", "2025", "b", ""), ("C", "2026", "c", "")]
    table.merge(spark.createDataFrame(rows, table.schema), list(range(4)), "load", 0)

    def put(name, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)

    put("1", [("A", "overtaken", "", "2025", "them"), ("B", "b", "", "2025", "them")])
    put("2", [("A", "a2", "", "2025", "them"), ("B", "b", "", "2025", "them"), ("D", "new", "", "2025", "them")])
    put("3", [("C", "echo", "", "2026", "me")])
    none = spark.createDataFrame([], "ledger_id string, fields array<string>")
    delivered = []
    known = lambda: (none, none.select("ledger_id"), table.read().select("ledger_id"))
    fields = ["year", "title", "status"]
    run = lambda: feeds.extract_feed(spark, str(tmp_path / "in"), schema, table, fields, known, lambda: delivered.append(table.read().filter("title = 'a'").count()), str(tmp_path / "cp"), "me").awaitTermination()
    run()
    got = {r.ledger_id: (r.year, r.title, r.status) for r in table.read().collect()}
    assert got == {"A": ("2025", "a2", ""), "B": ("2025", "b", ""), "C": ("2026", "c", ""), "D": ("2025", "new", "")}
    assert delivered[0] == 1  # before anything was read
    put("4", [("A", "a2", "", "2025", "them"), ("D", "new", "", "2025", "them")])
    run()
    assert {r.ledger_id: r.status for r in table.read().collect()} == {"A": "", "B": "[삭제]", "C": "", "D": ""}


def test_rolling_insights_of_a_stream_with_late_rows(spark, tmp_path):
    schema = "ts timestamp, query string, result_count long, elapsed_ms double"
    day = lambda d, h=12: datetime.datetime(2026, 1, d, h)
    files = [
        [(day(1), "a", 1, 10.0), (day(1), "b", 0, None), (day(3), "a", 0, 30.0)],
        [(day(3, 1), "a", 2, 50.0), (day(9), "a", 1, 20.0)],
        [(day(9, 1), "b", 0, 5.0), (day(1, 2), "a", 7, 99.0)],  # the second is too late
    ]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    parts = stores.BucketedTable(spark, str(tmp_path / "parts"), feeds.DAILY, "part", buckets=4)
    feeds.insights_feed(log, parts, str(tmp_path / "cp")).awaitTermination()
    kept = [r for rows in files for r in rows if r[3] != 99.0]
    got = {(r.day.day, r.query): (r.n, r.zero, r.mean_ms, r.slowest, r["last"]) for r in feeds.rolling_insights(parts.read(), 7).collect()}
    want = {}
    for d, q in {(r[0].day, r[1]) for r in kept}:
        rows = [r for r in kept if r[1] == q and d - 7 < r[0].day <= d]
        ms = [r[3] for r in rows if r[3] is not None]
        want[d, q] = (len(rows), sum(r[2] == 0 for r in rows), sum(ms) / len(ms) if ms else None, max(ms, default=None), max(r[0] for r in rows))
    assert got == want
