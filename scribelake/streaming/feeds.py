"""Streaming forms: change feed, snapshots, intake, query log. They call the batch functions."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scribelake.operators import ledger as op
from scribelake.operators.shared import cut
from scribelake.operators.sync import apply_sync, plan_sync

from .stores import BucketedTable, OnceTable

#: Failed tries after which an operation is set aside.
MAX_ATTEMPTS = 5


def change_feed(operations: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame, DataFrame, DataFrame, int], None], fields: list[str], checkpoint: str, as_of: datetime.date, watermark: str = "1 hour") -> StreamingQuery:
    """Apply operations (with an event time ``ts``) to a small table, read and saved as a whole each time (see :func:`ledger_feed`).

    An operation id counts once inside the watermark. ``load`` gives the stored table; ``save``
    gets (table, history, rejects, batch id) and must be idempotent for a batch id. A late operation
    carries an older version than is stored and is rejected as a conflict.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        save(*op.apply_operations(load(), rows, fields, as_of=as_of), batch_id)

    once = operations.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["operation_id"])
    return once.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def ledger_feed(operations: DataFrame, table: BucketedTable, receipts: OnceTable, history: OnceTable, rejects: OnceTable, fields: list[str], as_of: datetime.date, checkpoint: str, writer: str = "feed", every: str | None = None) -> StreamingQuery:
    """Apply a stream of operations to a bucketed ledger; a micro-batch reads and rewrites the buckets of its keys only.

    An operation id counts once for ever (``receipts``), also in a replayed batch or beyond any watermark.
    ``history`` and ``rejects`` get what :func:`op.apply_operations` returns, with an ``event`` to tell rows by.
    All of them are written before the table, whose mark ends the batch: a crash before it leaves the
    state that the replay starts from, and what was written is found committed.
    """
    key = table.key

    def batch(rows: DataFrame, batch_id: int) -> None:
        if table.merged(writer, batch_id) or rows.isEmpty():
            return
        fresh = cut(receipts.unseen(rows, batch_id))
        touched = table.touched(fresh)
        state, changes, refused = op.apply_operations(table.read(touched), fresh, fields, key, as_of=as_of)
        event = lambda *c: F.concat_ws("|", *[F.col(x).cast("string") for x in c]).alias("event")
        history.append(changes.select("*", event(key, "seq", "action")), batch_id)
        rejects.append(refused.select("*", event("operation_id")), batch_id)
        receipts.append(fresh, batch_id)
        table.merge(state, touched, writer, batch_id)

    w = operations.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def extract_feed(spark: SparkSession, path: str, schema: StructType, table: BucketedTable, fields: list[str], known: Callable[[], tuple[DataFrame, DataFrame, DataFrame]], deliver: Callable[[], None], checkpoint: str, writer_id: str, every: str | None = None) -> StreamingQuery:
    """Watch a folder of sheet extracts (with ``sheet`` and ``writer_id`` columns) and bring the ledger into line with each.

    A changed extract comes as a new file; of several of one sheet in a batch the newest counts, so what was
    overtaken is never applied. Files that this writer wrote are its echo and no change. Before a batch is read,
    ``deliver`` hands over operations that are still undelivered. ``known`` gives (protected, unseen, known) as
    :func:`sync.plan_sync` takes them. The plan compares one sheet with the rows of that sheet (column ``year``).
    """
    rows = spark.readStream.schema(schema).parquet(path).select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_modification_time").alias("__at"))

    def batch(extracts: DataFrame, batch_id: int) -> None:
        if table.merged(f"extracts:{writer_id}", batch_id):
            return
        deliver()
        newest = extracts.groupBy("sheet").agg(F.max(F.struct("__at", "__file")).alias("f")).select("sheet", F.col("f.__file").alias("__file"))
        own = F.coalesce("writer_id", F.lit("")) == writer_id
        incoming = cut(extracts.join(F.broadcast(newest), ["sheet", "__file"]).filter(~own).withColumn("year", F.col("sheet")))  # a row a sheet
        sheets = incoming.select("sheet").distinct()
        stored = cut(table.read())
        mine = stored.join(sheets.withColumnRenamed("sheet", "year"), "year", "left_semi")
        plan = cut(plan_sync(mine, incoming, fields, *known(), key=table.key))
        after = apply_sync(mine, incoming, plan, fields, table.key)
        changed = plan.filter(F.col("action").isin("INSERT", "UPDATE", "DELETE"))
        touched = table.touched(changed)
        rest = stored.join(changed.select(table.key), table.key, "left_anti").filter(table.bucket().isin(touched))
        new = after.join(changed.select(table.key), table.key, "left_semi")
        table.merge(rest.select(*table.schema.names).unionByName(new.select(*table.schema.names)), touched, f"extracts:{writer_id}", batch_id)

    w = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def snapshot_feed(spark: SparkSession, path: str, schema: StructType, apply: Callable[[DataFrame, int], None], checkpoint: str, writer_id: str, every: str | None = None) -> StreamingQuery:
    """Watch a folder of ledger extracts; rows that this writer wrote are not changes."""
    rows = spark.readStream.schema(schema).parquet(path).filter(F.coalesce("writer_id", F.lit("")) != writer_id)
    w = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def route_attempts(results: DataFrame, key: str = "ledger_id") -> dict[str, DataFrame]:
    """Split applied operations into ok, retry and dead letters; a conflict is dead at once.

    ``results``: operations with attempts and reason (null: applied). Deleting what isn't there is done.
    With ``key`` and seq among the columns, what follows the first ordinary failure of a key waits:
    it is tried again in order, and the wait counts as no attempt.
    """
    done = F.col("reason").isNull() | ((F.col("action") == "delete") & (F.col("reason") == "missing"))
    at_once = ~done & (F.col("reason") == "conflict")
    failed = ~done & ~at_once
    rows = results
    waits = F.lit(False)
    if {key, "seq"} <= set(results.columns):
        first = results.filter(failed).groupBy(F.col(key).alias("__key")).agg(F.min("seq").alias("__first"))
        rows = results.join(first, F.col(key) == F.col("__key"), "left").drop("__key")
        waits = F.coalesce(F.col("seq") > F.col("__first"), F.lit(False))
    dead = ~waits & (at_once | (failed & (F.col("attempts") + 1 >= MAX_ATTEMPTS)))
    ok = done & ~waits
    routed = rows.withColumn("__ok", ok).withColumn("__dead", dead).withColumn("attempts", F.col("attempts") + F.when(ok | waits, 0).otherwise(1))
    pick = lambda test: routed.filter(test).select(*results.columns)
    return {"ok": pick("__ok"), "retry": pick("not __ok and not __dead"), "dead": pick("__dead")}


def retry_quarantined(dead: DataFrame, ids: list[str]) -> DataFrame:
    """Chosen dead letters as new operations, their attempts reset."""
    return dead.filter(F.col("operation_id").isin(ids)).withColumn("attempts", F.lit(0)).withColumn("reason", F.lit(None).cast("string"))


def dismiss_quarantined(dead: DataFrame, ids: list[str], key: str = "ledger_id") -> tuple[DataFrame, DataFrame]:
    """(remaining dead letters, history rows of the dismissed)."""
    chosen = F.col("operation_id").isin(ids)
    return dead.filter(~chosen), dead.filter(chosen).select(key, F.lit("DISMISSED").alias("action"), "operation_id")


def intake(files: DataFrame, supported: str = r"(?i)\.(?:hwp|hwpx|xlsx|pdf|md|html?)$") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a file listing, streaming or not; temporary files are in neither."""
    real = files.filter(~F.col("path").rlike(r"/(?:~\$|\.)[^/]*$|\.tmp$"))
    return real.filter(F.col("path").rlike(supported)), real.filter(~F.col("path").rlike(supported))


def log_insights(log: DataFrame, window: str = "1 day", slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Per window and query: uses, empty results, slowest run. ``log``: ts, query, result_count, elapsed_ms."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = [F.count("*").alias("n"), F.count_if(F.col("result_count") == 0).alias("zero"), F.max("elapsed_ms").alias("slowest")]
    return log.withWatermark("ts", watermark).groupBy(w.alias("w"), "query").agg(*agg).select(F.col("w.start").alias("start"), "query", "n", "zero", "slowest")


#: Columns of the daily parts of the query log.
DAILY = "part string, day date, query string, n long, zero long, timed long, total_ms double, slowest double, last timestamp"


def daily_parts(log: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """A row a day and query, streaming or not: counts, sums and maxima that windows of days are put together from."""
    day = F.window("ts", "1 day")
    agg = [
        F.count("*").alias("n"), F.count_if(F.coalesce("result_count", F.lit(0)) == 0).alias("zero"), F.count("elapsed_ms").alias("timed"),
        F.sum(F.coalesce(F.col("elapsed_ms").cast("double"), F.lit(0.0))).alias("total_ms"), F.max(F.col("elapsed_ms").cast("double")).alias("slowest"), F.max("ts").alias("last"),
    ]
    rows = log.withWatermark("ts", watermark).groupBy(day.alias("w"), "query").agg(*agg).withColumn("day", F.col("w.start").cast("date"))
    return rows.select(F.concat_ws("|", F.col("day").cast("string"), "query").alias("part"), "day", "query", "n", "zero", "timed", "total_ms", "slowest", "last")


def insights_feed(log: DataFrame, parts: BucketedTable, checkpoint: str, watermark: str = "1 hour", writer: str = "insights") -> StreamingQuery:
    """Keep :func:`daily_parts` of a stream in a bucketed table; rows later than the watermark are dropped with their day's state.

    State holds the open days only; each micro-batch replaces the parts it changed.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        if parts.merged(writer, batch_id) or rows.isEmpty():
            return
        new = cut(rows)
        touched = parts.touched(new)
        kept = parts.read(touched).join(new.select("part"), "part", "left_anti")
        parts.merge(kept.unionByName(new), touched, writer, batch_id)

    return daily_parts(log, watermark).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()


def rolling_insights(parts: DataFrame, days: int = 90) -> DataFrame:
    """For each query and day it ran: what the log says of the ``days`` up to that day. No row is copied into windows.

    Returns day, query, n, zero, mean_ms, slowest, last.
    """
    back = Window.partitionBy("query").orderBy(F.datediff(F.col("day"), F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0)
    over = lambda f, c: f(c).over(back)
    return parts.select("day", "query", over(F.sum, "n").alias("n"), over(F.sum, "zero").alias("zero"), F.try_divide(over(F.sum, "total_ms"), over(F.sum, "timed")).alias("mean_ms"), over(F.max, "slowest").alias("slowest"), over(F.max, "last").alias("last"))


def prune_log(log: DataFrame, cutoff) -> DataFrame:
    """Rows from ``cutoff`` on, rows without a time, and rows without a result."""
    return log.filter(F.col("ts").isNull() | (F.col("ts") >= F.lit(cutoff)) | (F.coalesce("result_count", F.lit(0)) == 0))
