"""Table writes: insert-if-absent, replace-on-key, slices, snapshots, documents.

Targets are parquet folders.  Versions are whole snapshots under ``snapshot=<n>``: a
reader takes the newest complete one, so a failed write never damages a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def one_per_key(batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key in the given order, as a partial aggregate."""
    rest = [c for c in batch.columns if c not in keys]
    if not rest:
        return batch.distinct()
    best = batch.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in batch.columns])


def new_rows(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of the batch whose key the target lacks, one per key."""
    unique = one_per_key(batch, keys, order)
    return unique if target is None else unique.join(target.select(*keys), list(keys), "left_anti")


def replace_on_key(target: DataFrame | None, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Target with the batch's keys replaced; within the batch the last row of a key wins."""
    rest = [c for c in batch.columns if c not in keys]
    last = batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    latest = last.select(*[F.col(c) if c in keys else F.col(f"_x.{c}").alias(c) for c in batch.columns])
    return latest if target is None else target.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest)


def fill_missing(target: DataFrame, found: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Update a column only where it is NULL."""
    side = found.select(*keys, F.col(column).alias("_new"))
    return target.join(side, list(keys), "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def coverage(df: DataFrame, column: str) -> Column:
    return F.try_divide(F.count(column), F.count("*"))


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def append_new(spark: SparkSession, path: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
    """Insert-if-absent into a parquet folder."""
    new_rows(read_or_none(spark, path), batch, keys, order).write.mode("append").parquet(path)


def complete_snapshots(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the snapshots under ``root`` whose write was committed, ascending."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/snapshot=*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or ())


def current(spark: SparkSession, root: str) -> tuple[DataFrame | None, int]:
    """Newest complete snapshot under ``root`` and its number (none and 0 without one).

    Folder names tell it; no stored row is read.
    """
    numbers = complete_snapshots(spark, root)
    return (spark.read.parquet(f"{root}/snapshot={numbers[-1]}"), numbers[-1]) if numbers else (None, 0)


def write_snapshot(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("overwrite").parquet(f"{root}/snapshot={version}")


def upsert_snapshot(spark: SparkSession, root: str, batch: DataFrame, keys: Sequence[str], order: Sequence[str]) -> None:
    """Replace-on-key into the next snapshot."""
    target, version = current(spark, root)
    write_snapshot(replace_on_key(target, batch, keys, order), root, version + 1)


def overwrite_slice(df: DataFrame, path: str, column: str) -> None:
    """Rewrite only the slices present in ``df``; the slice column is the partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def append_fetch(df: DataFrame, path: str, fetched_at: str) -> None:
    """Append one fetch of a source, partitioned by its time stamp."""
    df.withColumn("fetched_at", F.lit(fetched_at)).write.mode("append").partitionBy("fetched_at").parquet(path)


def bundle(parent: DataFrame, children: dict[str, DataFrame], keys: Sequence[str], order: dict[str, Sequence[str]]) -> DataFrame:
    """One nested document per key: the parent's columns and a sorted list per child."""
    out = parent
    for name, child in children.items():
        first = list(order[name])
        rest = [c for c in child.columns if c not in keys and c not in first]
        packed = child.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*first, *rest))).alias(name))
        out = out.join(packed, list(keys), "left")
    return out


def write_documents(df: DataFrame, path: str, by: str | None = None) -> None:
    """JSON documents, one folder per value of ``by`` when given."""
    w = df.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out
