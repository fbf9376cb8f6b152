"""Sinks: replace on key, exports, snapshots, verified archives, staged publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scribelake.functions.text import csv_cell
from scribelake.operators.ledger import active


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """A later row of the same key replaces the earlier; combined before the shuffle."""
    best = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("__r"))
    return best.select(key, "__r.*").select(*rows.columns)


def write_tables(tables: dict[str, DataFrame], path: str, partition: dict[str, str] | None = None) -> None:
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        if partition and name in partition:
            w = w.partitionBy(partition[name])
        w.parquet(f"{path}/{name}")


def export_json(docs: DataFrame, qa: DataFrame, ledger: DataFrame, path: str) -> None:
    """One folder a table, a row a line, tombstones left out, newest year and date first."""
    newest = lambda df, *keys: [F.desc(c) for c in ("year", "request_date") if c in df.columns] + [F.asc(k) for k in keys]
    docs.orderBy(*newest(docs, "doc_id")).write.mode("overwrite").json(f"{path}/documents")
    qa.orderBy(*newest(qa, "qa_id")).write.mode("overwrite").json(f"{path}/qa_items")
    active(ledger).orderBy(F.desc("year"), F.desc("request_date"), F.desc("seq_no")).write.mode("overwrite").json(f"{path}/request_ledger")


def export_history(history: DataFrame, path: str, key: str = "history_id") -> None:
    """The change log as JSON lines in the order of its ids."""
    history.orderBy(key).write.mode("overwrite").json(path)


def export_csv(docs: DataFrame, chosen: DataFrame, columns: list[str], path: str) -> None:
    rows = docs.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi").select(*[csv_cell(F.col(c).cast("string")).alias(c) for c in columns])
    rows.write.mode("overwrite").csv(path, header=True, quoteAll=True, escape='"')


def snapshot(rows: DataFrame, path: str, day: str) -> None:
    """A dated copy; writing a day again replaces it alone."""
    rows.withColumn("snapshot_date", F.lit(day)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_date").parquet(path)


def expired_snapshots(spark: SparkSession, path: str, keep: int) -> DataFrame:
    """Days beyond the newest ``keep``."""
    days = spark.read.parquet(path).select(F.col("snapshot_date").cast("string").alias("day")).distinct()
    return days.withColumn("r", F.row_number().over(Window.orderBy(F.desc("day")))).filter(F.col("r") > keep).select("day")


class ArchiveError(RuntimeError):
    """What was read back is not what was planned."""


def archive(history: DataFrame, plan: DataFrame, path: str, kept_path: str, key: str = "history_id") -> None:
    """Write the planned rows aside, read them back, and write the rest only if both id sets are equal."""
    moved = history.join(plan.select(key), key, "left_semi")
    moved.write.mode("overwrite").json(path)
    back = history.sparkSession.read.schema(moved.schema).json(path).select(key)
    wanted = plan.select(key)
    if back.exceptAll(wanted).limit(1).count() or wanted.exceptAll(back).limit(1).count():
        raise ArchiveError(f"the archive in {path} differs from its plan; nothing was removed")
    history.join(wanted, key, "left_anti").write.mode("overwrite").parquet(kept_path)


#: File that marks a version as live.
READY = "_READY"


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str, ready: bool = True) -> list[int]:
    """Numbers of the versions of a published table, with ``ready`` those that were published to the end."""
    fs, p = _file_system(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
    found = sorted(int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit())
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return [n for n in found if not ready or fs.exists(make(f"{path}/v={n}/{READY}"))]


def published(spark: SparkSession, path: str) -> DataFrame | None:
    """The live version of a published table; null if there is none."""
    live = versions(spark, path)
    return spark.read.parquet(f"{path}/v={live[-1]}") if live else None


def publish(rows: DataFrame, path: str, gate: Callable[[DataFrame | None, DataFrame], None], keep: int = 2) -> int:
    """Write a new version, run the gate on the live and the new one, then mark the new one live.

    A version is live once its mark is there, so a crash at any point leaves the table as it was.
    Older versions beyond ``keep`` are deleted. Returns the number of the new version.
    """
    spark = rows.sparkSession
    number = max(versions(spark, path, ready=False), default=0) + 1
    target = f"{path}/v={number}"
    rows.write.parquet(target)
    gate(published(spark, path), spark.read.parquet(target))
    fs, mark = _file_system(spark, f"{target}/{READY}")
    fs.create(mark, True).close()
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for old in versions(spark, path, ready=False):
        if old not in versions(spark, path)[-keep:] and old < number:
            fs.delete(make(f"{path}/v={old}"), True)
    return number


def carry_delivery(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Change log, undelivered operations and receipts of the store before, in the rebuilt one.

    Rows of the new store go before old ones of the same key; columns that older logs lack are null.
    """
    keys = {"history": "history_id", "operations": "operation_id", "receipts": "request_key"}
    out = {}
    for name, key in keys.items():
        if name not in old and name not in new:
            continue
        if name not in old:
            out[name] = new[name]
        elif name not in new:
            out[name] = old[name]
        else:
            out[name] = carry_over(old[name].join(new[name].select(key), key, "left_anti"), new[name])
    return out


def carry_over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Older logs lack columns; they come over as nulls."""
    return new.unionByName(old, allowMissingColumns=True)
