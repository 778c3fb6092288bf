"""Shared pieces: work tables in the shared folder, hot keys, bounded caches, connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Default folder of public tokenizer files; operators take it as a parameter.
TOKENIZERS = "/opt/tokenizers"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (a local session)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="spark-work-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    return f"{work_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256):
    """While inside, whole texts go to Python in Arrow batches of at most `rows` rows, which bounds what workers and executors
    hold of them; afterwards the session's setting is as before. What is computed inside must be saved inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


#: Folders that save() has written and nothing has deleted yet.
_written: dict[str, None] = {}


def save(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_path(df.sparkSession, label)
    _written[path] = None
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """`name`, made longer until df has no column of it (case aside)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def with_row_key(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """df, saved, with a long that differs from row to row and stays the same however often it is read; and that column's name."""
    name = fresh(df, "_row_key")
    return save(df.withColumn(name, F.monotonically_increasing_id()), label), name


class Work:
    """The tables that one run of an operator writes to the shared folder. done() saves its result and deletes the others."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def save(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(save(df, label))
        return self.held[-1]

    def remove(self, df: DataFrame) -> None:
        """Delete a table of this run that nothing reads any more."""
        self.held = [x for x in self.held if x is not df]
        remove(df)

    def done(self, df: DataFrame, label: str) -> DataFrame:
        out = save(df, label)
        for x in self.held:
            remove(x)
        self.held = []
        return out


def remove(df: DataFrame) -> None:
    """Delete the files of a table made by save(); the caller no longer reads it."""
    names = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in df.inputFiles()}
    for path in [p for p in _written if p.rsplit("/", 1)[-1] in names]:
        delete_path(df.sparkSession, path)


def written() -> list[str]:
    """The folders that save() has written so far and that still stand, oldest first."""
    return list(_written)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    _written.pop(path, None)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def hot_values(counts: DataFrame, key: str, total: int, share: int = 500, least: int = 1000) -> list:
    """Keys that hold over 1/share of all rows: at most `share` of them, whatever the input's size."""
    return [r[0] for r in counts.filter(F.col("count") > max(least, total // share)).select(key).collect()]


#: Rows of one or two longs that are broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def few(df: DataFrame) -> DataFrame:
    """df, a saved table of one or two longs a row, marked for broadcast where its size is proven small."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, share: int = 500, least: int = 1000) -> DataFrame:
    """left joined with right, which holds each key once with the number of its rows in left as `rows` (dropped).

    Keys of over 1/share of left's rows (`total`), so at most `share`, are met by broadcast: none of their rows moves.
    """
    cut = max(least, total // share)
    hot = F.broadcast(right.filter(F.col("rows") > cut).withColumn("rows", F.lit(True)))
    rest = right.filter(F.col("rows") <= cut).drop("rows")
    met = left.join(hot, key, "left")
    return met.filter("rows").drop("rows").unionByName(met.filter("rows IS NULL").select(left.columns).join(rest, key))


class TwoGenerations(dict):
    """A memo of strings, bounded by the characters of its keys: beyond `cap` it becomes the old generation, from which used
    entries return. Keys of over LONGEST characters are made each time, so an entry is as small as its word."""

    LONGEST = 64

    def __init__(self, make, cap: int = 3_000_000):
        super().__init__()
        self.make, self.cap, self.old, self.held = make, cap, {}, 0

    def _room(self, more: int) -> None:
        if self.held + more > self.cap:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self.held += more

    def __missing__(self, key):
        if len(key) > self.LONGEST:
            return self.make(key)
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self._room(len(key) + 8)
        self[key] = value
        return value

    def many(self, keys: list, make) -> list:
        """Values of distinct keys; those that aren't known are made together. Values are true ones."""
        get, old = self.get, self.old.get
        out = [get(k) or old(k) for k in keys]
        new = [i for i, v in enumerate(out) if v is None]
        for i, value in zip(new, make([keys[i] for i in new]), strict=True):
            out[i] = value
        kept = [(k, v) for k, v in zip(keys, out, strict=True) if len(k) <= self.LONGEST]
        self._room(sum(len(k) + 8 for k, _ in kept if k not in self))
        self.update(kept)
        return out


#: Edges of a file that a round of components writes, 16 bytes each before compression: no swarm of tiny files.
FILE_EDGES = 500_000


def connected_components(edges: DataFrame, work: Work | None = None) -> DataFrame:
    """Alternating large-star and small-star until nothing changes: (node, component), component the smallest id.

    edges: (src, dst) longs, any order, repeats and self-loops allowed; nodes without edges don't appear. Every round is
    one aggregate and one join on the node, written to the shared folder; the driver sees three numbers a round. A node of
    very many edges is met by broadcast, so its star stays spread. The rounds end when the edges repeat.
    """
    work = work or Work()

    def star(e: DataFrame, large: bool, total: int) -> DataFrame:
        if large:
            e = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = e.groupBy("src").agg(F.min("dst").alias("m"), F.count(F.lit(1)).alias("rows")).select("src", F.least("src", "m").alias("m"), "rows")
        joined = join_hot(e, least, "src", 2 * total)
        if large:
            return joined.filter(F.col("dst") > F.col("src")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        return joined.filter(F.col("dst") != F.col("m")).select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(least.select("src", F.col("m").alias("dst"))).distinct()

    e = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).filter("src > dst").distinct()
    e, seen = work.save(e, "cc"), None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")), F.sum(F.col("dst").cast("decimal(38,0)"))).first()
        if now[0] == 0 or tuple(now) == seen:
            break
        seen = tuple(now)
        for large in (True, False):  # each is written, so that plans stay small
            after = work.save(star(e, large, now[0]).filter("src > dst").coalesce(1 + now[0] // FILE_EDGES), "cc")
            work.remove(e)
            e = after
    return e.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(e.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
