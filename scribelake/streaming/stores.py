"""Tables that streams write to: each micro-batch counts once, and only what it touches is rewritten.

Both keep small mark files beside the data, on the file system that the path names. What a batch wrote
is live once its mark is there, so a crash at any point leaves the table as it was, and a replayed
batch writes the same again or, if its mark is there, nothing.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from scribelake.sources.sinks import _file_system


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file so that it is there as a whole or not at all."""
    fs, target = _file_system(spark, path)
    draft = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.draft")
    out = fs.create(draft, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(target, False)
    if not fs.rename(draft, target):
        raise OSError(f"{path} could not be put in place")


def _get(spark: SparkSession, path: str) -> str:
    fs, p = _file_system(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class OnceTable:
    """An append-only table in which each ``id`` counts once, whatever is delivered again and however late.

    Rows are their own receipts: data and receipts are one folder a batch, partitioned by a hash of the id, so
    that neither is live without the other. A batch compares its ids with those of the same buckets only.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, id: str = "operation_id", order: str | None = None, buckets: int = 32):
        self.spark, self.path, self.id, self.order, self.buckets = spark, path, id, order or id, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def batches(self) -> list[int]:
        return sorted(int(n) for n in _names(self.spark, f"{self.path}/_done") if n.isdigit())

    def _live(self) -> DataFrame | None:
        paths = [f"{self.path}/data/batch={b}" for b in self.batches()]
        if not paths:
            return None
        schema = StructType([*self.schema, StructField("bucket", IntegerType()), StructField("batch", LongType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths)

    def read(self) -> DataFrame:
        live = self._live()
        return self.spark.createDataFrame([], self.schema) if live is None else live.select(*self.schema.names)

    def unseen(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """The rows whose id no other batch has brought; the batch itself, if it was committed, doesn't count."""
        live = self._live()
        if live is None:
            return rows
        bucket = F.pmod(F.xxhash64(self.id), F.lit(self.buckets)).cast("int")
        touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # ``buckets`` at most
        return rows.join(live.filter(F.col("bucket").isin(touched) & (F.col("batch") != batch_id)).select(self.id), self.id, "left_anti")

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Add the rows whose id is new; of rows with one id the first by ``order``."""
        if batch_id in self.batches():
            return
        rest = F.struct(*self.schema.names)
        fresh = rows.filter(F.col(self.id).isNotNull()).groupBy(F.col(self.id).alias("__id")).agg(F.min_by(rest, F.struct(self.order, rest)).alias("r")).select("r.*")
        bucket = F.pmod(F.xxhash64(self.id), F.lit(self.buckets)).cast("int")
        fresh = fresh.withColumn("bucket", bucket)
        live = self._live()
        if live is not None:
            touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # ``buckets`` at most
            fresh = fresh.join(live.filter(F.col("bucket").isin(touched)).select(self.id), self.id, "left_anti")
        fresh.select(*self.schema.names, "bucket").repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/batch={batch_id}")
        self._commit(batch_id)

    def _commit(self, batch_id: int) -> None:
        _put(self.spark, f"{self.path}/_done/{batch_id}", "")


class BucketedTable:
    """A table with a key, stored in buckets by a hash of it; a merge rewrites the buckets it touches.

    ``_manifest/<number>`` says for each bucket in which version it stands, and which batch of which
    writer was last merged. The greatest number is live.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the keys of ``rows``."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())  # ``buckets`` at most

    def manifest(self) -> dict:
        numbers = [int(n) for n in _names(self.spark, f"{self.path}/_manifest") if n.isdigit()]
        if not numbers:
            return {"number": 0, "versions": {}, "writers": {}}
        return json.loads(_get(self.spark, f"{self.path}/_manifest/{max(numbers)}"))

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or those buckets of it: no other file is opened."""
        versions = self.manifest()["versions"]
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in versions.items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merged(self, writer: str, batch_id: int) -> bool:
        return self.manifest()["writers"].get(writer, -1) >= batch_id

    def merge(self, rows: DataFrame, buckets: list[int], writer: str, batch_id: int) -> None:
        """Put ``rows`` in place of all that the ``buckets`` hold. Batches of a writer count once, in order."""
        now = self.manifest()
        if now["writers"].get(writer, -1) >= batch_id:
            return
        number = now["number"] + 1
        target = f"{self.path}/data/v={number}"
        rows.select(*self.schema.names, self.bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        written = {n.removeprefix("bucket=") for n in _names(self.spark, target) if n.startswith("bucket=")}
        if not {int(b) for b in written} <= set(buckets):
            raise ValueError("rows of other buckets than those to be replaced")
        versions = {b: v for b, v in now["versions"].items() if int(b) not in buckets} | dict.fromkeys(written, number)
        self._commit({"number": number, "versions": versions, "writers": now["writers"] | {writer: batch_id}})

    def _commit(self, manifest: dict) -> None:
        _put(self.spark, f"{self.path}/_manifest/{manifest['number']}", json.dumps(manifest))

    def vacuum(self, keep: int = 2) -> None:
        """Delete versions of buckets that the last ``keep`` manifests don't name, and older manifests."""
        numbers = sorted(int(n) for n in _names(self.spark, f"{self.path}/_manifest") if n.isdigit())
        held = {(b, v) for n in numbers[-keep:] for b, v in json.loads(_get(self.spark, f"{self.path}/_manifest/{n}"))["versions"].items()}
        fs, _ = _file_system(self.spark, self.path)
        make = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        live = numbers[-1] if numbers else 0
        for folder in _names(self.spark, f"{self.path}/data"):
            version = int(folder.removeprefix("v="))
            for b in _names(self.spark, f"{self.path}/data/{folder}"):
                if version <= live and b.startswith("bucket=") and (b.removeprefix("bucket="), version) not in held:
                    fs.delete(make(f"{self.path}/data/{folder}/{b}"), True)
        for n in numbers[:-keep]:
            fs.delete(make(f"{self.path}/_manifest/{n}"), False)
