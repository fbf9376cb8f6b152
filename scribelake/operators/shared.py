"""Steps that several operators share: cutting plans, size-checked broadcasts, ranks without hot tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast, and a hundredth of its bytes.
BROADCAST_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which the session names in ``spark.checkpoint.dir``."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and spark.sparkContext.master.startswith("local"):
        path = tempfile.mkdtemp(prefix="scribelake-")  # one machine: its own folder is shared
        spark.conf.set("spark.checkpoint.dir", path)
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder."""
    return "/".join([shared_dir(spark), "scribelake", spark.sparkContext.applicationId, uuid.uuid4().hex])


def cut(rows: DataFrame) -> DataFrame:
    """Checkpoint in the shared folder, so that branches of a plan don't each compute what they share."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return rows.checkpoint()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table for broadcast when its first ``rows`` + 1 rows show that it has no more, nor 100 bytes for each of these."""
    wide = [F.coalesce(F.octet_length(f.name) if f.dataType.typeName() in ("string", "binary") else F.size(f.name) * 8, F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary", "array", "map")]
    size = F.sum(sum(wide, F.lit(16 * len(df.columns))).cast("long"))
    count, held = df.limit(rows + 1).agg(F.count("*"), size).head()
    return F.broadcast(df) if count <= rows and (held or 0) <= 100 * rows else df


def ranked(rows: DataFrame, group: list[str], order: list[Column | str], name: str) -> DataFrame:
    """Adds 1, 2, ... in each group by ``order``, without a task that holds a whole group.

    Rows are dealt by range of group and order, so a large group spans several partitions. Each
    partition ranks its own part; only the size of each part is summed over the group. Rows that
    are equal in ``order`` can lie in two partitions only if they are equal in all of it.
    """
    keys = [F.asc(c) if isinstance(c, str) else c for c in order]
    dealt = cut(rows.repartitionByRange(*group, *keys).withColumn("__part", F.spark_partition_id()))
    part = [*group, "__part"]
    sizes = dealt.groupBy(*part).agg(F.count("*").alias("__size"))
    ahead = F.sum("__size").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(*part, F.coalesce(ahead, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(*part).orderBy(*keys))
    ranks = dealt.withColumn("__inside", inside).alias("d").join(small(starts).alias("s"), [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part])
    return ranks.select(*[F.col(f"d.`{c}`") for c in rows.columns], (F.col("s.__start") + F.col("d.__inside")).alias(name))


def running_before(rows: DataFrame, group: list[str], order: list[Column | str], amount: str, name: str) -> DataFrame:
    """Adds the sum of ``amount`` over the rows before each in its group, dealt as in :func:`ranked`."""
    keys = [F.asc(c) if isinstance(c, str) else c for c in order]
    dealt = cut(rows.repartitionByRange(*group, *keys).withColumn("__part", F.spark_partition_id()))
    part = [*group, "__part"]
    ahead = Window.unboundedPreceding, -1
    sums = dealt.groupBy(*part).agg(F.sum(amount).alias("__sum"))
    starts = sums.select(*part, F.coalesce(F.sum("__sum").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(*ahead)), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(*part).orderBy(*keys).rowsBetween(*ahead)), F.lit(0))
    both = dealt.withColumn("__inside", inside).alias("d").join(small(starts).alias("s"), [F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}")) for c in part])
    return both.select(*[F.col(f"d.`{c}`") for c in rows.columns], (F.col("s.__start") + F.col("d.__inside")).alias(name))
