"""Exact deduplication by skew-safe combining, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, few, hot_values, with_row_key

#: Deleted before texts are compared.
WHITE = r"[\x20\x09-\x0D]+"
_BASE = "36893488147419103232"  # 2**65
_TOP = "9223372036854775808"  # 2**63


def _dec(x: str):
    return F.lit(x).cast("decimal(38,0)")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, row_col: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256; with row_col also row (its value) and n (code points).

    Texts are equal when identical without white space. Of a group the row with the most code points in its original text,
    then the smallest id, stays. Null text counts as empty; a null id loses every tie and is returned as null; repeated
    rows with the keeper's id are all marked kept. Other columns are ignored, an empty table gives no rows.

    Plan: a slim table (id, length, digests) is written first; digests that hold over 1/500 of the rows (so at most 500 of
    them) get salts. Whole texts then move once: equal texts combine within each task, then by (digest, salt, text); the
    few salt winners of hot digests combine by (digest, text). The winner is one decimal, so that hash aggregation holds.
    Members find their group by 256 + 64 bits of digest; should two texts ever share these, the join uses the texts.
    """
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, "")
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("n"), norm.alias("norm"), *([F.col(row_col).alias("row")] if row_col else []))
    own = ["n", "row"] if row_col else []
    base = base.withColumns({"sha": F.sha2("norm", 256), "xx": F.xxhash64("norm")})
    work = Work()
    slim = work.save(base.select("id", "n", "sha", "xx", *own[1:]), "exact-slim")
    hot = hot_values(slim.groupBy("sha").count(), "sha", slim.count())
    is_hot = F.col("sha").isin(hot) if hot else F.lit(False)
    win = F.col("n").cast("decimal(12,0)") * F.lit(_BASE).cast("decimal(20,0)") + F.coalesce(F.lit(_TOP).cast("decimal(20,0)") - F.col("id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    salted = (
        base.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("id", "n"), F.lit(salts))).otherwise(F.lit(0)))
        .groupBy("sha", "xx", "salt", "norm")
        .agg(F.max(win.cast("decimal(38,0)")).alias("win"), F.count(F.lit(1)).alias("size"))
    )

    def combined(by_text: bool) -> DataFrame:
        text = F.col("norm") if by_text else F.when(is_hot, F.col("norm")).otherwise(F.lit(""))
        return (
            salted.select("sha", "xx", text.alias("norm"), "win", "size")
            .groupBy("sha", "xx", "norm")
            .agg(F.max("win").alias("win"), F.sum("size").alias("size"), F.count(F.lit(1)).alias("pieces"))
        )

    groups = work.save(combined(False).select("sha", "xx", "win", "size", "pieces"), "exact-groups")
    same = groups.groupBy("sha", "xx").agg(F.count(F.lit(1)).alias("texts"), F.max("pieces").alias("pieces"))
    on, member = ["sha", "xx"], slim
    if not same.filter((F.col("texts") > 1) | ((F.col("pieces") > 1) & ~is_hot)).isEmpty():
        on, member, groups, hot, is_hot = ["sha", "xx", "norm"], base, combined(True), [], F.lit(False)
    groups = groups.select(*on, F.when(F.col("win") % _dec(_BASE) > 0, (_dec(_TOP) - F.col("win") % _dec(_BASE)).cast("long")).alias("keep_id"), F.col("size").alias("group_size"))
    out = member.filter(~is_hot).join(groups.filter(~is_hot), on)
    if hot:  # at most 500 rows
        out = out.unionByName(member.filter(is_hot).join(F.broadcast(groups.filter(is_hot)), on))
    out = out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.coalesce(F.col("id").eqNullSafe(F.col("keep_id")), F.lit(False)).alias("kept"), F.col("sha").alias("text_sha256"), *own)
    return work.done(out, "exact")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all columns: the longest text, then the smallest id (null last), then any one.

    Rows are dropped by a key of their own, so null and repeated ids are rows like others.
    """
    work = Work()
    keyed, row = with_row_key(docs, "exact-keyed")
    out = exact_dedup(keyed, id_col, text_col, row_col=row).select("row", "n", "kept", "text_sha256")
    kept = out.filter("kept")
    first = kept.groupBy("text_sha256").agg(F.min(F.struct((-F.col("n")).alias("n"), "row")).alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    again = kept.join(first, "text_sha256").filter(F.col("row") != F.col("first.row")).select("row")
    gone = work.done(out.filter("NOT kept").select("row").unionByName(again).withColumnRenamed("row", row), "exact-gone")
    return keyed.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH b AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
g AS (SELECT doc_id, norm,
  first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
  count(*) OVER (PARTITION BY norm) AS group_size FROM b)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
