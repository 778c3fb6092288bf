"""Secret scan with multipart credential linking, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

# Kind, pattern, group whose length counts, least length, role, base kind or weak one.
KINDS = [
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, "secret", True),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, "id", True),
    ("hex", r"[0-9a-f]+", 0, 24, "secret", True),
    ("login", r"""(?i)(client_?id|user_?name|login|account)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@_.-]+)""", 2, 3, "id", False),
    ("opaque", r"[A-Za-z0-9+/]{32,}", 0, 32, "secret", False),
    ("endpoint", r"""(?i)(https?|ssh|ftp|jdbc|postgres|mysql|redis|amqp)://[A-Za-z0-9._:/@%?&=-]+""", 0, 10, "endpoint", False),
]
#: A text without any of these has no span: base and weak patterns at their least lengths (weaker than, never stricter).
MAYBE = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|(?i:client_?id|user_?name|login|account)["']?\x20*[:=]|[A-Za-z0-9+/]{32}|(?i:https?|ssh|ftp|jdbc|postgres|mysql|redis|amqp)://"""


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 200) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked.

    Base kinds are matched leftmost and without overlap per kind. Weak kinds (login names, opaque runs, endpoints) are
    reported only when complementary parts lie within `scope` code points in the same text: a login beside a secret (a base
    one, or an opaque run that is reported), an opaque run beside an identifier, an endpoint beside both; weak spans that overlap a base span go. Null text is empty
    and gives no spans; null or repeated ids keep a row each; other columns are ignored.

    Plan: one scan writes (row, id, text where it may match); matching texts explode into pieces between matches, whose
    running lengths give offsets; the interval join is two running windows per text (latest end before, earliest start behind),
    so that its work is linear in the parts but for their sort, and no pairs are built. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(
        docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.when(text.rlike(MAYBE), text).alias("t")), "secret-rows"
    )
    t = F.col("t")
    parts = None
    for k, (kind, pattern, group, least, role, base) in enumerate(KINDS):
        p = F.lit(pattern)
        zipped = F.arrays_zip(
            F.transform(F.split(t, pattern, -1), lambda x: F.length(x)).alias("gap"),
            F.transform(F.regexp_extract_all(t, p, F.lit(0)), lambda x: F.length(x)).alias("len"),
            F.transform(F.regexp_extract_all(t, p, F.lit(group)), lambda x: F.length(x)).alias("sized"),
        )
        found = rows.filter(t.rlike(pattern)).select("rid", F.posexplode(zipped).alias("pos", "m")).select("rid", "pos", "m.*")
        ends = F.sum(F.col("gap") + F.coalesce("len", F.lit(0))).over(Window.partitionBy("rid").orderBy("pos"))
        found = found.withColumn("end", ends).filter(F.col("sized") >= least)
        found = found.select("rid", F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(role).alias("role"), F.lit(base).alias("base"), (F.col("end") - F.col("len")).alias("start"), "end")
        parts = found if parts is None else parts.unionByName(found)

    # both frames grow by one part a row: one runs forward, the other backward
    before = Window.partitionBy("rid").orderBy("start", "end", "k").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("end"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)

    def near(cond, reach: int):
        """Whether a part that meets cond ends at most `reach` before this one, or starts at most so far behind it."""
        last, first = F.max(F.when(cond, F.col("end"))).over(before), F.min(F.when(cond, F.col("start"))).over(after)
        return F.coalesce(F.col("start") - last <= reach, F.lit(False)) | F.coalesce(first - F.col("end") <= reach, F.lit(False))

    marked = parts.withColumns({
        "in_base": near(F.col("base"), -1),
        "by_id": near(F.col("role") == "id", scope),
    })
    # a secret counts beside logins and endpoints where it is itself reported: base, or opaque beside an identifier
    told = (F.col("role") == "secret") & (F.col("base") | (~F.col("in_base") & F.col("by_id")))
    marked = marked.withColumn("told", told)
    marked = marked.withColumn("by_secret", near(F.col("told"), scope))
    linked = (
        F.when(F.col("role") == "id", F.col("by_secret"))
        .when(F.col("role") == "secret", F.col("by_id"))
        .otherwise(F.col("by_id") & F.col("by_secret"))
    )
    marked = marked.filter(F.col("base") | (~F.col("in_base") & linked))
    span = F.struct("start", "k", "end", "kind", "base")
    by_row = marked.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias("s"))

    def joined(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    n = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    by_row = by_row.select(
        "rid", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(joined(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"),
        F.size(F.filter("s", lambda x: ~x["base"])).cast("long").alias("n_linked"),
    )
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", "rid").join(by_row, "rid", "left").select(
        "doc_id", *[F.coalesce(c, zero).alias(c) for c in ("n_assign", "n_access", "n_hex")],
        F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("n_linked", zero).alias("n_linked"),
    )


def _oracle(scope: int = 200) -> str:
    found = " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, '{role}' AS role, {base} AS base, e - l AS start, e AS "end" FROM (
  SELECT doc_id, l, z, sum(g + l) OVER (PARTITION BY doc_id ORDER BY pos) AS e FROM (
    SELECT doc_id, unnest(range(len(m))) AS pos, unnest(list_transform(m, lambda x: length(x))) AS l, unnest(list_transform(s, lambda x: length(x))) AS z,
      unnest(list_transform(g[1:len(m)], lambda x: length(x))) AS g
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS s, string_split_regex(t, '{p}') AS g FROM d))) WHERE z >= {least}"""
        for k, (kind, p, group, least, role, base) in enumerate((a, b.replace("'", "''"), *c) for a, b, *c in KINDS)
    )
    before, after = "OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)", "OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)"

    def near(cond: str, reach: int) -> str:
        return f"""(coalesce(start - max(CASE WHEN {cond} THEN "end" END) {before} <= {reach}, false) OR coalesce(min(CASE WHEN {cond} THEN start END) {after} - "end" <= {reach}, false))"""

    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), p AS ({found}),
n AS (SELECT *, {near("base", -1)} AS in_base, {near("role = 'id'", scope)} AS by_id FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", k)),
m AS (SELECT *, role = 'secret' AND (base OR (NOT in_base AND by_id)) AS told FROM n),
q AS (SELECT *, {near("told", scope)} AS by_secret FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY start, "end", k)),
r AS (SELECT *, kind || ':' || CAST(start AS BIGINT) || ':' || CAST("end" AS BIGINT) AS s FROM q
  WHERE base OR (NOT in_base AND CASE role WHEN 'id' THEN by_secret WHEN 'secret' THEN by_id ELSE by_id AND by_secret END)),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(s, ',' ORDER BY start, k) FILTER (base) AS b, string_agg(s, ',' ORDER BY start, k) AS spans, count(*) FILTER (NOT base) AS n_linked FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, CAST(coalesce(n_linked, 0) AS BIGINT) AS n_linked FROM d LEFT JOIN a USING (doc_id)"""


ORACLE = _oracle()
