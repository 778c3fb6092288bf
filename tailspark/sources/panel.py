"""Price panels: any table with (series, date, price) columns, and the quantile table."""

from __future__ import annotations

import logging
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import stored

PRICES = T.StructType([T.StructField("series", T.StringType()), T.StructField("date", T.DateType()), T.StructField("price", T.DoubleType())])
log = logging.getLogger(__name__)

FORECASTS = "series string, origin date, model string, horizon int, alpha double, sigma2 double, var double, es double, realized double"
KEY = ["model", "series", "context", "origin"]
QUANTILES = "model string, series string, context int, origin date, day int, level double, quantile double"


def safe_name(name: str, dots: bool = False) -> str:
    """A name with each character outside letters, digits, _ and - (and . if `dots`) replaced by _."""
    return re.sub(r"[^A-Za-z0-9_.-]" if dots else r"[^A-Za-z0-9_-]", "_", name)


def price_file(series: str, start: str, end: str) -> str:
    return f"{safe_name(series)}_{start}_{end}.parquet"


def quantile_file(model: str, series: str, horizon: int, context: int) -> str:
    return f"{safe_name(model, True)}/{safe_name(series, True)}__h{horizon}__c{context}.parquet"


def safe_name_column(name: Column, dots: bool = False) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9_.-]" if dots else r"[^A-Za-z0-9_-]", "_")


def quantile_file_column(model: Column, series: Column, horizon: int, context: int) -> Column:
    """quantile_file() of columns."""
    return F.concat(safe_name_column(model, True), F.lit("/"), safe_name_column(series, True), F.lit(f"__h{horizon}__c{context}.parquet"))


def prices_from(df: DataFrame, series: str, date: str, price: str, daily: str = "avg") -> DataFrame:
    """A panel from any table: one price per series and day, nulls dropped; the aggregate combines before it moves."""
    value = F.col(price).cast("double")
    agg = {"avg": F.avg, "max": F.max, "min": F.min, "last": lambda c: F.max_by(c, F.col(date))}[daily]
    day = F.col(date).cast("date")
    return df.filter(value.isNotNull() & ~F.isnan(value) & day.isNotNull()).groupBy(F.col(series).cast("string").alias("series"), day.alias("date")).agg(agg(value).alias("price"))


def load_prices(spark: SparkSession, paths: list[str], price_field: str = "adj_close") -> DataFrame:
    """Price files (series, date, <price_field>), read in one scan; missing files are logged and skipped, no prices at all raise.

    Paths may hold wildcards. Unlike files, which the scan itself skips where they vanish, paths are looked for by the driver.
    """
    there = []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path):
            there.append(p)
        else:
            log.warning("no prices at %s", p)
    if not there:
        raise ValueError("no prices found")
    found = spark.read.option("ignoreMissingFiles", "true").parquet(*there)
    df = found.select("series", F.col("date").cast("date").alias("date"), F.col(price_field).cast("double").alias("price")).dropna()
    if df.isEmpty():
        raise ValueError("no prices found")
    return df


def write_forecasts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Forecasts by model and horizon, so that slices of either prune files."""
    df.repartition("model", "horizon", "series").sortWithinPartitions("series", "origin", "alpha").write.mode(mode).partitionBy("model", "horizon").parquet(path)


class QuantileTable:
    """Resumable store of (model, series, context, origin, day, level, quantile): an origin once stored is never changed.

    Folders are models and BUCKETS hash buckets of their series, so their number doesn't grow with the panel.
    """

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.schema(QUANTILES + ", bucket int").parquet(self.path).select(*KEY, "day", "level", "quantile")

    def origins(self) -> DataFrame:
        old = self.read()
        empty = self.spark.createDataFrame([], "model string, series string, context int, origin date")
        return empty if old is None else old.select("model", "series", "context", "origin").distinct()

    def append(self, new: DataFrame) -> None:
        """Add the rows of origins not stored yet; all rows of a stored origin are left out, so that a repeat changes nothing.

        A batch is refused whole if an origin in it lacks a day or level that others of its model and context have, or has one
        twice: days must be 1 to the last, levels the same on each.
        """
        fresh = stored(new.join(self.origins(), KEY, "left_anti").select(*KEY, "day", "level", "quantile"), "quantiles")
        shape = fresh.groupBy(*KEY).agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("day", "level").alias("unlike"), F.max("day").alias("days"), F.min("day").alias("first"), F.array_sort(F.collect_set("level")).alias("grid"))
        uneven = (F.col("cells") != F.col("unlike")) | (F.col("cells") != F.col("days") * F.size("grid")) | (F.col("first") != 1)
        if not shape.filter(uneven).isEmpty():
            raise ValueError("an origin's days and levels must form a whole grid, each cell once")
        if not shape.groupBy("model", "context").agg(F.count_distinct("days", "grid").alias("n")).filter("n > 1").isEmpty():
            raise ValueError("origins of a batch disagree on days or levels")
        bucketed = fresh.withColumn("bucket", F.pmod(F.xxhash64("series"), F.lit(self.BUCKETS)).cast("int"))
        bucketed.repartition("model", "bucket").sortWithinPartitions("series", "origin", "day", "level").write.mode("append").partitionBy("model", "bucket").parquet(self.path)


def first_writer_wins(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """existing and, of `new`, the rows whose key it doesn't have."""
    return existing.unionByName(new.join(existing.select(*key).distinct(), key, "left_anti"))
