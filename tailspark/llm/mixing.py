"""Mixing sources to target weights by systematic sampling, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

WORD = r"[^\x20\x09-\x0D]+"
#: Weights dealt to the sources in their order, repeating.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of (source, size): shares by weight, capped at most*source_size, the excess reshared.

    The caps bind for the sources with the smallest cap/weight; the common level is found by one ordered pass over the
    sources (a table of one row per source). Sources order by code point, null last. Sizes of 0 get target 0.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int")))
    s = s.withColumns({"cap": F.col("source_size") * F.lit(float(most)), "total": F.sum("source_size").over(Window.partitionBy())})
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    s = s.withColumns({
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    s = s.withColumn("level", (F.col("total") * F.lit(float(share)) - F.col("capped")) / F.col("open"))
    s = s.withColumn("at", F.max(F.when(F.col("cap") / F.col("weight") > F.col("level"), F.col("level"))).over(Window.partitionBy()))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("at") * F.col("weight")), "cap").alias("target"))


def _dealt(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, stratum: int, carry: bool) -> DataFrame:
    """The measured rows, and in column `row` the whole row of docs if `carry`."""
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    # rows of one size and id are told apart by their contents, so that reruns take the same
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), tie.alias("tie"), *row)
    salts = max(1, -(-docs.count() // stratum))
    key = F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))
    slim = slim.withColumns({"key": key, "grade": -F.floor(F.log2(F.col("size") + 1.0) * 8), "salt": F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")), 1, 8), 16, 10).cast("long"), F.lit(salts))})
    if not carry:
        slim = save(slim, "mix-slim")
    counts = save(slim.groupBy("key", "grade", "salt").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")), "mix-strata")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "key")), 1, 8), 16, 10).cast("double") / 4294967296.0
    place = Window.partitionBy("key").orderBy("grade", "salt").rowsBetween(Window.unboundedPreceding, -1)
    strata = counts.withColumn("first", F.coalesce(F.sum("rows").over(place), F.lit(0))).withColumn("u", offset)
    targets = source_targets(counts).withColumn("key", key).drop("source")
    strata = strata.join(targets, "key").select("key", "grade", "salt", "first", "u", "source_size", "target")
    nth = F.row_number().over(Window.partitionBy("key", "grade", "salt").orderBy(F.col("size").desc(), F.col("doc_id"), F.col("tie"))) - 1
    j = slim.withColumn("nth", nth).join(strata, ["key", "grade", "salt"])
    j = j.withColumns({"rate": F.when(F.col("source_size") > 0, F.col("target") / F.nullif("source_size", F.lit(0))).otherwise(F.lit(0.0)), "i": F.col("first") + F.col("nth")})
    copies = F.floor(F.col("u") + (F.col("i") + 1) * F.col("rate")) - F.floor(F.col("u") + F.col("i") * F.col("rate"))
    return j.withColumn("copies", copies.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, stratum: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, taken, copies.

    Expected copies are target/source_size for each document of a source. Documents of a source line up by size (so that
    taken words follow the target), expected copies are summed along the line, one offset from the seed and the source is
    added, and a document is emitted once for each integer its interval passes; none is emitted over ceil(2) times. Null
    text has size 0; a null source is a source of its own; repeated rows are dealt separately; reruns agree. An empty table
    gives no rows; other columns are ignored (emit() keeps them), whatever their names.

    Plan: the prefix sum is two-level: rows are counted by stratum (source, an eighth of an octave of size, salt; salts in
    proportion to the table), strata are summed along their source, and rows are numbered within their stratum. So a source
    that holds a third of all rows is dealt over its strata.
    """
    j = _dealt(docs, id_col, text_col, source_col, seed, stratum, False)
    return j.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7, stratum: int = 20_000) -> DataFrame:
    """The mixed documents: the rows of docs with all their columns, each repeated as often as the mix takes it."""
    j = _dealt(docs, id_col, text_col, source_col, seed, stratum, True).filter("copies > 0")
    return j.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
e AS (SELECT *, -floor(log2(size + 1.0) * 8) AS grade, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || size), 1, 8) AS BIGINT) % (SELECT CAST(greatest(1, ceil(count(*) / 20000.0)) AS BIGINT) FROM d) AS salt FROM d),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
  CAST(source_size * 2 AS DOUBLE) AS cap, CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
l AS (SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, (max(CASE WHEN cap / weight > level THEN level END) OVER ()) * weight) AS target,
  CAST('0x' || substr(md5('7:' || coalesce('s' || source, 'n')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM l),
n AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY grade, salt, size DESC, doc_id) - 1 AS i FROM e),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(u + (i + 1) * (target / source_size)) - floor(u + i * (target / source_size)) AS BIGINT) ELSE 0 END AS copies
  FROM n JOIN t ON n.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, CAST(target AS DOUBLE) AS target, copies * size AS taken, copies FROM c
"""
