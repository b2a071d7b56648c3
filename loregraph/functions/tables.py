"""Tables of a run: inputs by name, and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _folder(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; it goes when the application's JVM ends. A local session without
    that setting (tests) gets one under /tmp; a cluster must name one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = f"/tmp/loregraph-{uuid.uuid4().hex[:12]}"
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top}/loregraph/run-{spark.sparkContext.applicationId}"


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def shared_path(spark: SparkSession) -> str:
    """A new path in the application's folder."""
    fs, at = _at(spark, _folder(spark))
    fs.deleteOnExit(at)
    return f"{at}/{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Deletes all tables that this application has written here. No result that reads them may be used any more."""
    fs, at = _at(spark, _folder(spark))
    fs.delete(at, True)


def saved(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives the loss of executors."""
    path = shared_path(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """rows with pos, their place from 0 in their group by the order. A group is cut where the ranges of a sort are, so it may
    be of any size. No column of group may be null."""
    own = rows.columns
    at = saved(rows.orderBy(*group, *order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = at.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select(*group, "_part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"))
    return at.join(skips, [*group, "_part"]).select(*own, (F.col("_at") - F.col("first") + F.col("skip")).alias("pos"))
