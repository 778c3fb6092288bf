"""Exact near-duplicate vectors by dual traversal of cover trees."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Work, connected_components, join_hot

LEAF = 24
#: Pivots of all labels together, at about 8 * dimension bytes each: what the driver and each worker hold of them.
PIVOTS = 8192


class CoverTree:
    """Nested covers of unit vectors: a node's children are points at least half its radius apart that cover its points, level by
    level with halving radii; `reach` is the true largest distance from a node's point to those below it."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.point, self.reach, self.kids, self.under = [], [], [], []
        if len(x):
            self._build(np.arange(len(x)))

    def _node(self, at: int, under: np.ndarray, reach: float) -> int:
        self.point.append(at)
        self.reach.append(reach)
        self.under.append(under)
        self.kids.append([])
        return len(self.point) - 1

    def _build(self, members: np.ndarray) -> None:
        todo = [(self._root(members), 2.0)]
        while todo:
            node, radius = todo.pop()
            under = self.under[node]
            if len(under) <= LEAF:
                continue
            radius = min(radius, 2.0 ** math.ceil(math.log2(self.reach[node] + 1e-300))) / 2
            left = under
            if self.reach[node] < 1e-6:
                continue  # equal up to rounding: a leaf, however many
            while len(left):
                # candidates of a chunk are measured at once; the node's own point comes first, so covers are nested
                some = np.r_[self.point[node], left[:255]] if left is under else left[:256]
                d = distance(self.x[some], self.x[left])
                inside, open_ = d <= radius, np.ones(len(left), bool)
                place = np.searchsorted(left, some)
                for i, center in enumerate(some.tolist()):
                    if not open_[place[i]]:
                        continue
                    own = inside[i] & open_
                    own[place[i]] = True
                    open_ &= ~own
                    kid = self._node(center, left[own], float(d[i][own].max()))
                    self.kids[node].append(kid)
                    todo.append((kid, radius))
                left = left[open_]

    def _root(self, members: np.ndarray) -> int:
        d = distance(self.x[members], self.x[members[0]])
        return self._node(int(members[0]), members, float(d.max()))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of unit vectors, from their cosines (so never far off where it matters; bounds are widened by SLACK)."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


#: Distances from cosines err by up to about sqrt(1e-15); every bound allows for this.
SLACK = 1e-6


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = a = self.up[self.up[a]]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def dual(a: CoverTree, b: CoverTree, weight_a: np.ndarray, weight_b: np.ndarray, least: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of a's points with b's: summed weights of partners for either side, and a forest of links as (row of a, row of b).

    Node pairs whose points are all farther than the threshold are dropped, those whose points are all nearer are counted whole.
    same: a is b; each pair of points counts once for either.
    """
    radius = math.sqrt(2.0 - 2.0 * least)
    na, nb = np.zeros(len(a.x), np.int64), np.zeros(len(b.x), np.int64)
    union, edges = _Union(len(a.x) + (0 if same else len(b.x))), []
    shift = 0 if same else len(a.x)

    def join(i: int, j: int) -> None:
        if union.join(i, j + shift):
            edges.append((i, j))

    def block(i: np.ndarray, j: np.ndarray, diagonal: bool) -> None:
        for k in range(0, len(i), 1024):
            part = i[k : k + 1024]
            hit = a.x[part] @ b.x[j].T >= least
            if diagonal:
                hit[np.arange(len(part)), np.arange(k, k + len(part))] = False
            na[part] += hit @ weight_b[j]
            if not diagonal:
                nb[j] += weight_a[part] @ hit
            for r in np.flatnonzero(hit.any(axis=1)).tolist():
                for c in np.flatnonzero(hit[r]).tolist():
                    join(int(part[r]), int(j[c]))

    if not len(a.x) or not len(b.x):
        return na, nb, edges
    stack = [(0, 0)]
    while stack:
        p, q = stack.pop()
        own = same and p == q
        up, uq = a.under[p], b.under[q]
        if own and len(up) == 1:
            continue
        if not own:
            d = float(distance(a.x[a.point[p]], b.x[b.point[q]]))
            if d - a.reach[p] - b.reach[q] > radius + SLACK:
                continue
            if d + a.reach[p] + b.reach[q] < radius - SLACK:
                na[up] += int(weight_b[uq].sum())
                nb[uq] += int(weight_a[up].sum())
                for i in up.tolist():
                    join(i, int(uq[0]))
                for j in uq.tolist():
                    join(int(up[0]), j)
                continue
        elif 2 * a.reach[p] < radius - SLACK:
            na[up] += int(weight_a[up].sum()) - weight_a[up]
            for i in up.tolist():
                join(i, int(up[0]))
            continue
        kp, kq = a.kids[p], b.kids[q]
        if not kp and not kq:
            block(up, uq, own)
        elif own:
            _pairs(a, b, kp, kp, radius, stack, True)
        elif not kq or (kp and a.reach[p] >= b.reach[q]):
            _pairs(a, b, kp, [q], radius, stack, False)
        else:
            _pairs(a, b, [p], kq, radius, stack, False)
    return (na + nb, na + nb, edges) if same else (na, nb, edges)


def _pairs(a: CoverTree, b: CoverTree, kp: list[int], kq: list[int], radius: float, stack: list, own: bool) -> None:
    """Push the pairs of children that the covering radii can't rule out."""
    pq = np.array([b.point[q] for q in kq])
    rq = np.array([b.reach[q] for q in kq])
    rp = np.array([a.reach[p] for p in kp])
    pp = np.array([a.point[p] for p in kp])
    for k in range(0, len(kp), 512):
        near = distance(a.x[pp[k : k + 512]], b.x[pq]) - rp[k : k + 512, None] - rq[None, :] <= radius + SLACK
        for i, j in zip(*np.nonzero(near), strict=True):
            if not own or kp[k + i] <= kq[j]:
                stack.append((kp[k + i], kq[j]))


def _units(v: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of `dim` numbers as vectors of length 1, in double precision."""
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _balls(batches, pivots: dict, reach: dict | None, radius: float):
    """Rows with their ball, that of the nearest pivot of their group, and `far`, the distance to it. With reach, also a row
    (guest) for each ball of a lower number that may hold a link of theirs.

    A vector v of ball q and a point of ball p lie (v.q - v.p) / |p - q| apart or more, as far as v is from the plane between
    the pivots; and v lies at most the link's length beyond p's reach.
    """
    for batch in batches:
        t = pa.Table.from_batches([batch])
        groups = list(zip(t.column("label").to_pylist(), t.column("dim").to_pylist(), strict=True))
        by: dict = {}
        for i, g in enumerate(groups):
            by.setdefault(g, []).append(i)
        for g, at in by.items():
            rows = t.take(pa.array(at))
            if g not in pivots:
                yield from _with(rows, np.arange(len(at)), np.zeros(len(at), np.int32), np.zeros(len(at), bool), np.zeros(len(at)))
                continue
            p = pivots[g]
            for first in range(0, len(at), 1024):
                part = rows.slice(first, 1024)
                cos = _units(part.column("v"), g[1]) @ p.T
                home = cos.argmax(axis=1).astype(np.int32)
                best = cos[np.arange(len(home)), home]
                yield from _with(part, np.arange(len(home)), home, np.zeros(len(home), bool), np.sqrt(np.maximum(0.0, 2 - 2 * best)))
                if reach is not None:
                    between = distance(p, p)[home]
                    near = (best[:, None] - cos <= (radius + SLACK) * between + 1e-9) & (np.sqrt(np.maximum(0.0, 2 - 2 * cos)) <= reach[g] + radius + SLACK)
                    row, ball = np.nonzero(near & (np.arange(len(p))[None, :] < home[:, None]))
                    yield from _with(part, row, ball.astype(np.int32), np.ones(len(row), bool), np.zeros(len(row)))


def _with(rows: pa.Table, at: np.ndarray, ball: np.ndarray, guest: np.ndarray, far: np.ndarray):
    for first in range(0, len(at), 4096):
        k = slice(first, first + 4096)
        out = rows.select(["label", "dim", "node", "weight", "v"]).take(pa.array(at[k]))
        for name, x in (("ball", ball), ("guest", guest), ("far", far)):
            out = out.append_column(name, pa.array(x[k]))
        yield from out.combine_chunks().to_batches()


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", least: float = 0.98, block: int = 4096, pivots: int = PIVOTS) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine in double precision is `least` or more. Null, zero
    and non-finite vectors, null labels and vectors of another length link with nothing; repeated rows, and rows of one id with
    other vectors or labels, are vectors of their own, each with its own links and component. Rows with a null id link with
    nothing and are kept. Other columns are ignored, whatever their names; an empty table gives no rows.

    Plan: equal vectors of a label collapse by a partial aggregate (with their number), so copies are never paired. A label of
    over `block` distinct vectors gets a pivot for each `block` of them, drawn by their hash; a vector lies in the ball of its
    nearest pivot, and visits a ball of a lower number only if a vector there may link with it, so balls too far apart are ruled
    out before anything moves. Pivots are `pivots` at most in expectation, over all labels together (figures of the balls come
    to the driver, too); balls of over `block` vectors or visitors are split and their blocks meet in pairs, so a task holds two
    blocks. It builds cover trees over them, traverses these together, and returns a count per vector and a forest of links.
    Vectors of high intrinsic dimension let few balls be ruled out: the work is then quadratic in a label's distinct vectors.
    """
    work, spark = Work(), vectors.sparkSession
    radius = math.sqrt(2.0 - 2.0 * least)
    finite = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("v"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("key", F.when(ok, F.sha2(F.concat_ws(",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256)))
    rows = work.save(rows, "vec-rows")
    total = rows.count()
    reps = rows.filter("key IS NOT NULL").groupBy("key").agg(F.first("label").alias("label"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    reps = work.save(reps.withColumns({"dim": F.size("v"), "node": F.monotonically_increasing_id()}), "vec-reps")

    group = ["label", "dim"]
    large = reps.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    large = work.save(large.withColumn("share", F.least(F.lit(1.0 / block), F.lit(float(pivots)) / F.sum("n").over(Window.partitionBy()))), "vec-large")
    drawn = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0 < F.col("share")
    chosen = reps.join(F.broadcast(large) if large.count() <= BROADCAST_ROWS // 10 else large, group).filter(drawn).select(*group, "v").collect()  # `pivots` rows
    points: dict = {}
    for r in chosen:
        points.setdefault((r["label"], r["dim"]), []).append(r["v"])
    points = {g: _units(pa.array(x, pa.list_(pa.float64())), g[1]) for g, x in points.items() if len(x) > 1}
    plain = reps.select(*group, "node", "weight", "v")
    if points:
        schema = T.StructType([*plain.schema.fields, T.StructField("ball", T.IntegerType()), T.StructField("guest", T.BooleanType()), T.StructField("far", T.DoubleType())])
        far = plain.mapInArrow(lambda b: _balls(b, points, None, radius), schema).groupBy(*group, "ball").agg(F.max("far").alias("reach")).join(spark.createDataFrame([*points], schema=T.StructType([schema["label"], schema["dim"]])), group, "left_semi").collect()
        reach = {g: np.zeros(len(p)) for g, p in points.items()}
        for r in far:
            reach[r["label"], r["dim"]][r["ball"]] = r["reach"]
        dealt = plain.mapInArrow(lambda b: _balls(b, points, reach, radius), schema).drop("far")
    else:
        dealt = plain.withColumns({"ball": F.lit(0), "guest": F.lit(False)})

    n_blocks = lambda cond: F.ceil(F.count(F.when(cond, 1)) / block).cast("int")
    balls = work.save(dealt.groupBy(*group, "ball").agg(n_blocks(~F.col("guest")).alias("homes"), n_blocks(F.col("guest")).alias("guests")), "vec-balls")
    dealt = dealt.join(F.broadcast(balls) if balls.count() <= BROADCAST_ROWS // 10 else balls, [*group, "ball"])
    own = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("homes"))).cast("int")
    entry = lambda a, b, side: F.struct(a.alias("a"), b.alias("b"), side.cast("int").alias("side"))
    inner = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda x: entry(F.least(x, F.col("own")), F.greatest(x, F.col("own")), F.col("own") > x))
    outer = F.when(F.col("guests") > 0, F.transform(F.sequence(F.col("homes"), F.col("homes") + F.col("guests") - 1), lambda x: entry(F.col("own"), x, F.lit(0)))).otherwise(F.array().cast("array<struct<a:int,b:int,side:int>>"))
    visit = F.transform(F.sequence(F.lit(0), F.col("homes") - 1), lambda x: entry(x, F.col("homes") + F.col("own"), F.lit(1)))
    sent = dealt.withColumn("own", own).filter("homes > 0").select(*group, "ball", "node", "weight", "v", F.explode(F.when(F.col("guest"), visit).otherwise(F.concat(inner, outer))).alias("p")).select(*group, "ball", "node", "weight", "v", "p.*")

    def links(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        side, node, weight = (t.column(c).to_numpy() for c in ("side", "node", "weight"))
        x = _units(t.column("v"), t.column("dim")[0].as_py())
        if side.any():
            ia, ib = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            na, nb, edges = dual(CoverTree(x[ia]), CoverTree(x[ib]), weight[ia], weight[ib], least, False)
            ids, n = np.r_[node[ia], node[ib]], np.r_[na, nb]
            src, dst = node[ia[[a for a, _ in edges]]] if edges else [], node[ib[[b for _, b in edges]]] if edges else []
        else:
            tree = CoverTree(x)
            n, _, edges = dual(tree, tree, weight, weight, least, True)
            ids = node
            src, dst = node[[a for a, _ in edges]] if edges else [], node[[b for _, b in edges]] if edges else []
        some = n > 0
        k, m = int(some.sum()), len(edges)
        return pa.table({
            "src": pa.array(np.r_[ids[some], np.array(src, np.int64)], pa.int64()), "dst": pa.array([*[None] * k, *np.array(dst, np.int64).tolist()], pa.int64()), "n": pa.array(np.r_[n[some], np.zeros(m, np.int64)], pa.int64()),
        })

    found = work.save(sent.groupBy(*group, "ball", "a", "b").applyInArrow(links, "src long, dst long, n long"), "vec-links")
    label = connected_components(found.filter("dst IS NOT NULL").select("src", "dst"), work)
    n = found.filter("dst IS NULL").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    to = reps.select("key", "node", "rep", "weight").join(n, "node", "left").join(label, "node", "left")
    to = work.save(to.select("key", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"), "rep", F.col("weight").alias("rows")), "vec-to")
    least_id = to.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("rows"))
    named = join_hot(to.withColumnRenamed("rows", "copies"), least_id, "component", total).select("key", "n_links", "component_id", F.col("copies").alias("rows"))
    out = join_hot(rows.filter("key IS NOT NULL").select("vec_id", "key"), named, "key", total).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return work.done(out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")), "vec")


ORACLE = """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
n AS (SELECT vec_id, label, v FROM e WHERE len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND list_dot_product(v, v) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (WITH RECURSIVE c(id, via) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT c.id, p.b FROM c JOIN p ON c.via = p.a) SELECT id, min(via) AS component_id FROM c GROUP BY id),
k AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN r ON e.vec_id = r.id LEFT JOIN k ON e.vec_id = k.a
"""
