"""Helpers that the operators share: tables, saved intermediate tables, bounded arrays summed over a job."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loregraph.functions.tables import shared_path

#: An array is summed in segments of so many cells, so that no task holds more than one segment of it at a time.
SEGMENT = 1 << 14


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """A setting of the session that holds inside the block."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Lists of tables that are being written, the innermost last.
_open: list[list[DataFrame]] = []


@contextmanager
def recorded():
    """Yields a list that gets each table that `saved` writes inside the block, so that the caller can drop them."""
    mine: list[DataFrame] = []
    _open.append(mine)
    try:
        yield mine
    finally:
        _open.pop()
        if _open:
            _open[-1].extend(mine)


def saved(df: DataFrame, few: bool = False, by: str | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, survives the loss of executors. few: rows of a step
    that is small against the input; they go to a few files for each core of the cluster, however many partitions they
    come from. by: the last column, of few values; where one of them is asked for, only its files are read. The shuffle files of the
    step go when it has ended."""
    spark = df.sparkSession
    path = shared_path(spark)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        rows = df.coalesce(max(8, 4 * spark.sparkContext.defaultParallelism)) if few else df
        rows.write.option("compression", "zstd").parquet(path, partitionBy=by)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    if _open:
        _open[-1].append(out)
    return out


def dropped(*tables: DataFrame | None) -> None:
    """Deletes tables that `saved` wrote, others are left alone. No frame that reads them may be used any more."""
    for t in tables:
        path = getattr(t, "saved_at", None)
        if path:
            at = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
            t.saved_at = None


def free_names(names: list[str], *wanted: str) -> list[str]:
    """The wanted names, longer where a column has them already."""
    have, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        out.append(w)
        have.add(w.lower())
    return out


def batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema)], schema=schema)


def segments_of(cells: np.ndarray):
    """An int64 array as rows (segment, binary) for `summed`."""
    for k in range(0, len(cells), SEGMENT):
        part = cells[k : k + SEGMENT]
        if part.any():
            yield k // SEGMENT, part.astype("<i8").tobytes()


def summed(rows: DataFrame, width: int) -> np.ndarray:
    """The cell-wise sum of the arrays in rows(segment, cells). width is a fixed parameter of the caller, so that the
    result has a bound that does not depend on the data."""

    def add(key: tuple[pa.Scalar, ...], tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SEGMENT, np.int64)
        for batch in tables:
            for cells in batch.column("cells"):
                part = np.frombuffer(cells.as_buffer(), "<i8")
                total[: len(part)] += part
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["segment", "cells"])

    out = np.zeros(-(-width // SEGMENT) * SEGMENT, np.int64)
    parts = rows.select(F.col("segment").cast("long").alias("segment"), "cells").groupBy("segment").applyInArrow(add, "segment long, cells binary")
    for row in parts.collect():
        part = np.frombuffer(row.cells, "<i8")
        out[row.segment * SEGMENT : row.segment * SEGMENT + len(part)] = part
    return out[:width]


def numbered(rows: DataFrame, group: list[str], order: list[str], keep: list | None = None) -> DataFrame:
    """rows, or what keep makes of them, with pos, their place from 0 in their group by the order, and total, the number of
    rows of the group. Groups are cut where the ranges of a sort are, so that they may be of any size. No column of group may be
    null."""
    put = rows.orderBy(*group, *order).select(*(group + keep if keep else rows.columns))
    own = put.columns
    at = saved(put.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = at.groupBy(*group, "_part").agg(F.count("*").alias("n"), F.min("_at").alias("first"))
    by = Window.partitionBy(*group)
    earlier = by.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    skips = sizes.select(*group, "_part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skip"), F.sum("n").over(by).alias("total"))
    return at.join(skips, [*group, "_part"]).select(*own, (F.col("_at") - F.col("first") + F.col("skip")).alias("pos"), "total")


def row_key():
    """A hash of a row's own doc_id and text: rows that share an id, or have none, are told apart by their texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def uniform(*columns, seed: int = 0):
    """A number in (0, 1) that depends on the columns and the seed alone: reruns and lost executors give the same."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
