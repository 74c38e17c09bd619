"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Separates the parts of a composite key. A unit separator does not occur in ids or paths.
SEP = "\x1f"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; only where none is named (tests) a temporary one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    own = spark.conf.get("codeweft.shared.dir", None)
    if not own:
        own = "file://" + tempfile.mkdtemp(prefix="codeweft-")
        spark.conf.set("codeweft.shared.dir", own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: no lineage, known size, and nothing lost with an executor."""
    at = f"{shared_folder(df.sparkSession)}/codeweft/{uuid.uuid4().hex}"
    df.write.parquet(at)
    _written.append((df.sparkSession, at))
    return df.sparkSession.read.schema(df.schema).parquet(at)


_written: list[tuple[SparkSession, str]] = []


@atexit.register
def drop_written() -> None:
    """Delete what ``cut`` wrote; called at exit, or earlier by whoever is done with the results."""
    while _written:
        spark, at = _written.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; its folder goes with the cluster
            pass


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utc_day(ts: Column) -> Column:
    """Calendar day in UTC whatever the session's zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def utc_month(ts: Column) -> Column:
    return F.date_format(utc_day(ts), "yyyy-MM")


def month_no(ts_seconds: Column) -> Column:
    """Months since year 0 in UTC of unix seconds."""
    day = F.date_from_unix_date(F.floor(ts_seconds / F.lit(86_400)).cast("int"))
    return (F.year(day) * 12 + F.month(day) - 1).cast("int")


def spread(df: DataFrame) -> DataFrame:
    """For costly Python stages: rows over all cores where the scan has fewer splits than there are cores.

    Large inputs have more splits than cores and are left alone, so no text is moved there.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().toRdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def rank_within(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Row numbers from 1 within each group without gathering a group: numbers inside range partitions plus what lies before.

    ``order`` has to be total within a group.
    """
    parts = shuffle_partitions(df.sparkSession)
    ranged = cut(df.repartitionByRange(parts, *[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))  # one row for each group and partition
    before = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_part").alias("_p"), (F.sum("_n").over(Window.partitionBy(*group).orderBy("_part")) - F.col("_n")).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)))
    cond = F.col("_part") == F.col("_p")
    for c in group:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    return own.join(before, cond).withColumn(name, (F.col("_before") + F.col("_own")).cast("int")).drop("_part", "_own", "_p", "_before", *[f"_g_{c}" for c in group])
