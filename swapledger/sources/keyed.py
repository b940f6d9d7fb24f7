"""Keyed tables in hash buckets, for loads that touch few keys.

Rows lie in ``data/version=<v>/bucket=<b>``, where the bucket is a hash of the key; the
manifest of a version lists the folders that make up the table.  A load finds the buckets its
keys fall into (at most ``buckets`` numbers reach the driver), reads these only, writes their
new rows in a version of its own, and then writes the next manifest, so a failed load leaves
the table as it was.  Loads of a stream carry its name and batch number; a batch that the
table has already taken is skipped, so a replay changes nothing.  One writer at a time.

Inserted rows go beside a bucket's earlier folders; once a bucket has more than ``MOST`` of
them, the next insert that touches it writes it whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from swapledger.session import scratch_dir
from swapledger.sources.writers import one_per_key

#: Folders of a bucket beyond which an insert writes it anew.
MOST = 16
_MANIFEST = "bucket int, version long, source string, batch long"


def committed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match the pattern, as the file system lists them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(f.getPath().toString() for f in found or ())


class KeyedTable:
    """A table with one row per key (or whole groups of rows per key) under ``root``."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets = spark, root.rstrip("/"), list(keys), buckets

    # -- versions ---------------------------------------------------------

    def version(self) -> int:
        """Number of the newest complete manifest, 0 without one."""
        done = committed(self.spark, f"{self.root}/manifest=*/_SUCCESS")
        return max((int(p.split("manifest=")[1].split("/")[0]) for p in done), default=0)

    def _manifest(self) -> tuple[int, dict[int, list[int]], dict[str, int]]:
        """Version, versions of each bucket's folders, last batch of each stream."""
        version = self.version()
        places: dict[int, list[int]] = {}
        taken: dict[str, int] = {}
        if version:
            for r in self.spark.read.schema(_MANIFEST).json(f"{self.root}/manifest={version}").collect():
                if r.bucket is None:
                    taken[r.source] = r.batch
                else:
                    places.setdefault(r.bucket, []).append(r.version)
        return version, places, taken

    def paths(self, only: Sequence[int] | None = None) -> list[str]:
        """Folders that make up the table, or those of some buckets."""
        _, places, _ = self._manifest()
        return [f"{self.root}/data/version={v}/bucket={b}" for b, vs in sorted(places.items()) if only is None or b in only for v in sorted(vs)]

    def read(self, only: Sequence[int] | None = None) -> DataFrame | None:
        """The table, or some of its buckets; none without rows."""
        paths = self.paths(only)
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*paths).drop("version", "bucket") if paths else None

    # -- loads ------------------------------------------------------------

    def _load(
        self, batch: DataFrame, combine: Callable[[DataFrame | None, DataFrame], DataFrame], whole: bool,
        source: str | None, number: int | None,
    ) -> None:
        version, places, taken = self._manifest()
        if source is not None and taken.get(source, -1) >= number:
            return
        # Written once: the touched buckets and the rows are read from it.
        path = scratch_dir(self.spark, "keyed-load")
        at = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        batch.withColumn("bucket", at).write.partitionBy("bucket").parquet(path)
        touched = [int(p.split("bucket=")[1]) for p in committed(self.spark, f"{path}/bucket=*")]
        if not touched and source is None:
            return
        new = version + 1
        if touched:
            # The bucket of a row comes back from its folder.
            rows = self.spark.read.schema(batch.schema).parquet(path).select(*batch.columns)
            full = {b for b in touched if whole or len(places.get(b, ())) >= MOST}
            old = self.read(touched)
            out = combine(old, rows).withColumn("bucket", at)
            if full and not whole and old is not None:
                out = out.unionByName(old.withColumn("bucket", at).where(F.col("bucket").isin(sorted(full))))
            out.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={new}")
            written = {int(p.split("bucket=")[1]) for p in committed(self.spark, f"{self.root}/data/version={new}/bucket=*")}
            for b in touched:
                kept = [] if b in full else places.get(b, [])
                places[b] = [*kept, *([new] if b in written else [])]
        if source is not None:
            taken[source] = number
        rows = [(b, v, None, None) for b, vs in places.items() for v in vs] + [(None, None, s, n) for s, n in taken.items()]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest={new}")

    def insert(self, batch: DataFrame, order: Sequence[str], source: str | None = None, number: int | None = None) -> None:
        """Add the rows whose key the table lacks, the first of each key; stored rows are not written again."""

        def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
            first = one_per_key(rows, self.keys, order)
            return first if old is None else first.join(old.select(*self.keys), self.keys, "left_anti")

        self._load(batch, combine, False, source, number)

    def upsert(
        self, batch: DataFrame, order: Sequence[str], newest: bool = False, source: str | None = None, number: int | None = None,
    ) -> None:
        """Replace the rows of the batch's keys by its last row of each; with ``newest`` a stored later row stays."""

        def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
            if old is None:
                return self._last(rows, order)
            if newest:
                return self._last(old.unionByName(rows), order)
            last = self._last(rows, order)
            return old.join(last.select(*self.keys), self.keys, "left_anti").unionByName(last)

        self._load(batch, combine, True, source, number)

    def replace_groups(self, batch: DataFrame, source: str | None = None, number: int | None = None) -> None:
        """Replace all rows of each key of the batch by the batch's rows of it; a missing key is one, too."""

        def combine(old: DataFrame | None, rows: DataFrame) -> DataFrame:
            if old is None:
                return rows
            found = rows.select(*[F.col(k).alias(f"_new_{k}") for k in self.keys]).distinct()
            same = [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in self.keys]
            return old.join(found, same, "left_anti").unionByName(rows)

        self._load(batch, combine, True, source, number)

    def _last(self, rows: DataFrame, order: Sequence[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"_x.{c}").alias(c) for c in rows.columns])


def schema_with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    """A schema with one more field."""
    return T.StructType([*schema.fields, T.StructField(name, kind)])
