"""Size-tiered compaction of immutable shards under a versioned manifest, in DataFrame operations."""

from __future__ import annotations

import math
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, fresh, work_path

#: Runs of one tier have at most this ratio of bytes to one another.
LIKE = 4


class ShardStore:
    """Shards of a table in a folder: runs of like size are merged, `fan_in` or more at once.

    A run is a folder of Parquet files that never changes; its tier follows from its bytes: tier k holds runs of `small` *
    LIKE**(k-1) to `small` * LIKE**k bytes, tier 0 smaller ones. The manifest of version v is one file that lists the runs. It
    is written whole under a temporary name and then given its own, which fails if version v exists: a reader sees a version
    entirely or not at all, and of two writers one loses and must retry. Every committed version stays readable until vacuum()
    drops it; what no manifest names is garbage that vacuum() deletes, too.
    """

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, small: int | None = None):
        self.spark, self.root, self.target, self.fan_in = spark, root.rstrip("/"), target_bytes, fan_in
        self.small = small or max(1, target_bytes // 64)
        #: Bytes of a row group, and of a partition that a merge reads: small beside a file, so that whole ones add up to the target.
        self.piece = max(1024, target_bytes // 8)
        self.jvm = spark._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self.conf)
        self.fs.mkdirs(self.path(f"{self.root}/manifest"))

    def versions(self) -> list[int]:
        """The committed versions that can be read, oldest first."""
        names = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/manifest"))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def version(self) -> int:
        """The latest committed version, 0 before the first."""
        return max([0, *self.versions()])

    def tier(self, size: int) -> int:
        return 0 if size < self.small else 1 + int(math.log(size / self.small, LIKE) + 1e-9)

    def runs(self, version: int | None = None) -> list[tuple[int, str, int]]:
        """(tier, run, bytes) of a version: one entry per run, after compact() fewer than fan_in of a tier."""
        v = self.version() if version is None else version
        if not v:
            return []
        lines = self.spark.read.text(f"{self.root}/manifest/v{v:08d}").collect()
        return [(int(t), run, int(size)) for t, run, size in (r[0].split("\t") for r in lines if r[0])]

    def commit(self, runs: list[tuple[int, str, int]], based_on: int) -> int:
        """Make `runs` the version after `based_on`; raises if another writer has committed it meanwhile."""
        to, temp = f"{self.root}/manifest/v{based_on + 1:08d}", f"{self.root}/manifest/_{uuid.uuid4().hex}"
        out = self.fs.create(self.path(temp), False)
        try:
            out.write(bytearray("".join("\t".join(map(str, r)) + "\n" for r in runs).encode()))
        finally:
            out.close()
        try:
            self._name(temp, to)
        except FileExistsError:
            raise RuntimeError(f"version {based_on + 1} was committed by another writer") from None
        finally:
            self.fs.delete(self.path(temp), False)
        return based_on + 1

    def _name(self, temp: str, to: str) -> None:
        """Give a whole file its name; FileExistsError if that is taken. Local files are linked, others renamed without overwriting
        (atomic where the file system's rename is, as on HDFS)."""
        from py4j.protocol import Py4JJavaError

        target = self.fs.makeQualified(self.path(to))
        if target.toUri().getScheme() == "file":
            os.link(self.fs.makeQualified(self.path(temp)).toUri().getPath(), target.toUri().getPath())
            return
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.conf).rename(self.path(temp), self.path(to), none)
        except Py4JJavaError as e:
            if self.fs.exists(self.path(to)):
                raise FileExistsError(to) from e
            raise

    def _write(self, df: DataFrame, name: str) -> tuple[int, str, int]:
        """Write a run and describe it. Its name is unique, as a lost writer may have left one of that version."""
        run = f"runs/{name}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").option("parquet.block.size", self.piece).parquet(f"{self.root}/{run}")
        return self._described(run)

    def _described(self, run: str) -> tuple[int, str, int]:
        size = self.fs.getContentSummary(self.path(f"{self.root}/{run}")).getLength()
        return self.tier(size), run, size

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as a run: its rows go to small files as they come, without a shuffle."""
        at = self.version()
        return self.commit([*self.runs(at), self._write(rows, f"arrival-v{at + 1:08d}")], at)

    def stage(self, rows: DataFrame, arrival) -> list[str]:
        """Write rows of several arrivals in one pass, each to a folder of its own, by the column expression `arrival` of
        small numbers from 0 on; returns the runs in that order, to be added one by one by add(). Arrivals without rows are left out."""
        name, column = f"runs/staged-{uuid.uuid4().hex[:8]}", fresh(rows, "arrival")
        rows.withColumn(column, arrival).write.partitionBy(column).option("compression", "zstd").option("parquet.block.size", self.piece).parquet(f"{self.root}/{name}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self.path(f"{self.root}/{name}"))]
        return [f"{name}/{x}" for x in sorted((x for x in found if x.startswith(f"{column}=")), key=lambda x: int(x.split("=")[1]))]

    def add(self, run: str) -> int:
        """Commit a staged run as an arrival."""
        at = self.version()
        return self.commit([*self.runs(at), self._described(run)], at)

    def compact(self) -> int:
        """Merge tiers that hold fan_in runs or more, from the smallest, into files near the target; returns the version.

        A merge only concatenates: partitions of an eighth of the target are packed into ceil(bytes/target) outputs by
        coalesce(), and no row is shuffled. fan_in runs of a tier make one of its top or a higher tier, so a row is rewritten a
        logarithmic number of times. Merged runs of target size or more have files near it already and are left alone.
        """
        at = self.version()
        runs, merged = self.runs(at), False
        while own := self._alike(runs):
            runs = [r for r in runs if r not in own] + [self._merge(own, at + 1)]
            merged = True
        return self.commit(runs, at) if merged else at

    def _alike(self, runs: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        """The runs of the lowest tier that holds fan_in or more of them, none if there is no such tier."""
        for tier in sorted({r[0] for r in runs}):
            own = [r for r in runs if r[0] == tier and not (r[1].startswith("runs/merged-") and r[2] >= self.target)]
            if len(own) >= self.fan_in:
                return own
        return []

    def _merge(self, own: list[tuple[int, str, int]], version: int) -> tuple[int, str, int]:
        files = max(1, math.ceil(sum(r[2] for r in own) / self.target))
        bounds = {"spark.sql.files.maxPartitionBytes": self.piece, "spark.sql.files.openCostInBytes": max(1, self.piece // 16)}
        before = {k: self.spark.conf.get(k) for k in bounds}
        try:
            for k, v in bounds.items():
                self.spark.conf.set(k, str(v))
            return self._write(self._read(own).coalesce(files), f"merged-v{version:08d}")
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v)

    def vacuum(self, keep: int = 1) -> None:
        """Drop all versions but the `keep` latest, and every run that these don't name; readers and writers must have ended."""
        kept = self.versions()[-max(1, keep) :]
        named = {run for v in kept for _, run, _ in self.runs(v)}
        for s in self.fs.listStatus(self.path(f"{self.root}/manifest")):
            name = s.getPath().getName()
            if not (name[:1] == "v" and name[1:].isdigit() and int(name[1:]) in kept):
                delete_path(self.spark, f"{self.root}/manifest/{name}")
        if not self.fs.exists(self.path(f"{self.root}/runs")):
            return
        for s in self.fs.listStatus(self.path(f"{self.root}/runs")):
            run = f"runs/{s.getPath().getName()}"
            parts = [run] if not run.startswith("runs/staged-") else [f"{run}/{x.getPath().getName()}" for x in self.fs.listStatus(s.getPath()) if x.isDirectory()]
            gone = [p for p in parts if p not in named]
            for p in [run] if len(gone) == len(parts) else gone:
                delete_path(self.spark, f"{self.root}/{p}")

    def _read(self, runs: list[tuple[int, str, int]]) -> DataFrame:
        # files are listed by name, so that a folder's own name doesn't add a column
        paths = [f.getPath().toString() for _, run, _ in runs for f in self.fs.listStatus(self.path(f"{self.root}/{run}")) if f.getPath().getName().endswith(".parquet")]
        return self.spark.read.parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version (the latest, if none is named)."""
        return self._read(self.runs(version))


def shard_documents(docs: DataFrame, id_col: str = "doc_id", arrivals: int = 5, target_bytes: int = 32 << 20, fan_in: int = 4, root: str | None = None) -> tuple[ShardStore, DataFrame]:
    """Take docs in as `arrivals` appends, compacting after each, and return the store and where each row lies:
    doc_id, shard (file), tier, shard_bytes, version.

    All columns and all rows are kept, nulls, repeats and long texts included; an empty table gives no rows. Rows of one id
    arrive together. Which files a row lands in, and their names, may differ from run to run; arrivals and rows don't.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or work_path(spark, "shards"), target_bytes, fan_in)
    staged = store.stage(docs, F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals)).cast("int"))
    version = store.version()
    for run in staged:
        store.add(run)
        version = store.compact()
    if not staged:
        return store, docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("shard"), F.lit(0).alias("tier"), F.lit(0).cast("long").alias("shard_bytes"), F.lit(0).cast("long").alias("version")).limit(0)
    where, tier = F.regexp_extract("_metadata.file_path", r"(runs/.+)$", 1), F.lit(None).cast("int")
    for t, run, _ in store.runs(version):  # a run is a folder; there are few
        tier = F.when(F.startswith(F.url_decode(where), F.lit(f"{run}/")), t).otherwise(tier)
    out = store.read(version).select(
        F.col(id_col).alias("doc_id"), where.alias("shard"), tier.alias("tier"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).cast("long").alias("version"),
    )
    return store, out
