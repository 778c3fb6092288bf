"""Near-duplicate documents by Order MinHash, verified by banded alignment."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import Work, connected_components, few, join_hot, small_batches, with_row_key

#: Words per shingle, least similarity, sketches per text, and minimum shingles per sketch.
K, SIMILARITY, SKETCHES, PICKED = 5, 0.8, 64, 2
#: Texts of so many shingles or fewer also get keys that no pair of them at CLOSE can miss.
SHORT, CLOSE = 40, 0.9
#: Shingles that are brought into all orders at once.
SLICE = 2048
#: Texts, and words of texts, that one task aligns with a center.
BLOCK, WORDS = 1024, 2_000_000
#: A block of a bucket holds so many times BLOCK texts, and WORDS words (a task twice as many where two blocks meet): rare words
#: lead a text to its candidates there, so a task's work needs no smaller blocks, and fewer blocks move fewer texts.
WIDER = 4
_MIX = np.random.default_rng(20190703).integers(1, 1 << 63, SKETCHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word(w: str) -> int:
    return xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))


def occurrences(h: np.ndarray) -> np.ndarray:
    """0 for the first of equal values, 1 for the second, and so on."""
    out = np.zeros(len(h), np.int64)
    order = np.argsort(h, kind="stable")
    s = h[order]
    start = np.r_[True, s[1:] != s[:-1]]
    if not start.all():
        at = np.flatnonzero(start)
        out[order] = np.arange(len(h)) - np.repeat(at, np.diff(np.r_[at, len(h)]))
    return out


def shingles(words: np.ndarray, k: int = K) -> np.ndarray:
    """Hashes of the k-word shingles in text order, each labelled with its occurrence; shorter texts are one shingle."""
    if not len(words):
        return words
    n = max(1, len(words) - k + 1)
    h = np.full(n, np.uint64(min(k, len(words))))
    for i in range(min(k, len(words))):
        h = _scramble(h * _P + words[i : i + n])
    label = occurrences(h).astype(np.uint64)
    return np.where(label > 0, _scramble(h + label * _P), h)


def sketch(h: np.ndarray) -> np.ndarray:
    """For each of SKETCHES orders, a hash of the order's number and the PICKED least shingles, read in text order.

    Shingles are ordered a slice at a time, so that a very long text needs no table of all its shingles under every order.
    """
    picked, every = min(PICKED, len(h)), np.arange(SKETCHES)
    least, at = [], []
    for first in range(0, len(h), SLICE):
        r = _scramble(h[None, first : first + SLICE] * _MIX[:, None])
        for _ in range(min(picked, r.shape[1])):  # least by least: there are few
            here = r.argmin(axis=1)
            least.append(r[every, here])
            at.append(here + first)
            r[every, here] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at = np.stack(at, axis=1)
    if at.shape[1] > picked:
        at = np.take_along_axis(at, np.argsort(np.stack(least, axis=1), axis=1, kind="stable")[:, :picked], axis=1)
    at.sort(axis=1)
    out = _MIX + np.uint64(picked)
    for i in range(picked):
        out = _scramble(out * _P + h[at[:, i]])
    return out


def prefix(h: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """The least shingles of a short text, so many that a text alike by CLOSE in words, or by `least` in shingles, has one of
    them among its own: an edited word changes K shingles at most."""
    n = len(h)
    if n > SHORT:
        return h[:0]
    edits = math.floor((n + K - 1) * (1 - CLOSE) / CLOSE + 1e-9)
    return np.sort(h)[: max(K * edits + 1, n - math.ceil(least * n - 1e-9) + 1)]


def allowed(n: int, m: int, least: float = SIMILARITY) -> int:
    """Word edits between texts of n and m words that leave them alike by `least`: 1 - edits / the longer one's words."""
    return math.floor((1 - least) * max(n, m) + 1e-9)


def distance(a: list[int], b: list[int], most: int) -> int:
    """The edit distance of two word sequences if it is `most` or less, else most + 1.

    Aligned in a band of `most` cells on either side of the diagonal, a column at a time: a column's vertical steps of the
    band are the bits of two integers (+1 and -1), and the band moves down a bit per column.
    """
    lead, short = 0, min(len(a), len(b))
    while lead < short and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < short - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    a, b = a[lead : len(a) - tail], b[lead : len(b) - tail]
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return most + 1
    if not n or not m:
        return max(n, m)
    t = min(most, max(n, m))
    where: dict[int, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    width = 2 * t + 1
    mask, last = (1 << width) - 1, 1 << (width - 1)
    # bit k of column j is row j - t + k; rows of 0 or less rise by one per column
    up, down = mask & ~((1 << t) - 1), 0
    score = t if n >= t else n
    for j in range(1, m + 1):
        eq, shift = where.get(b[j - 1], 0), j - t - 1
        eq = (eq >> shift if shift >= 0 else eq << -shift) & mask
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = (down | ~(diagonal | up)) & mask, diagonal & up
        if j + t <= n:
            score += not diagonal & last
        else:
            k = n - j + t
            score += (rise >> k & 1) - (fall >> k & 1)
        up = (fall | ~((diagonal >> 1) | rise)) & mask
        down = (diagonal >> 1) & rise & mask
        if j + t >= n and score - (m - j) > most:
            return most + 1
    return min(score, most + 1)


def alike(a: list[int], b: list[int], least: float = SIMILARITY) -> bool:
    most = allowed(len(a), len(b), least)
    return distance(a, b, most) <= most


def _sketches(batches):
    for b in batches:
        for first in range(0, len(b), 512):
            yield _sketched(b.slice(first, 512))


def _sketched(b: pa.RecordBatch) -> pa.RecordBatch:
    n, size, keys, out = [], [], [], []
    for t in b.column("text"):
        words = (t.as_py() or "").split()
        w = np.fromiter(map(_word, words), np.uint64, len(words))
        h = shingles(w)
        n.append(len(h))
        size.append(len(w))
        x = _scramble(w + np.arange(len(w), dtype=np.uint64) * _P)
        keys.append(f"{len(w):x}:{int(x.sum(dtype=np.uint64)):016x}{int(np.bitwise_xor.reduce(_scramble(x + _P))) if len(x) else 0:016x}")
        out.append(np.unique(np.r_[sketch(h), _scramble(prefix(h) + _P)]).view(np.int64) if len(h) else np.zeros(0, np.int64))
    flat = np.concatenate(out) if out else np.zeros(0, np.int64)
    offsets = np.r_[0, np.cumsum([len(o) for o in out])].astype(np.int32)
    return pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array(keys), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["id", "n", "words", "key", "sk"])


def _numbered(texts: list[str | None]) -> tuple[list[list[int]], list[np.ndarray]]:
    """The texts as numbers of their words, and the same labelled by occurrence, so that a common value is a common word."""
    number: dict[str, int] = {}
    lists = [[number.setdefault(w, len(number)) for w in (t or "").split()] for t in texts]
    out = []
    for x in lists:
        a = np.array(x, np.int64)
        out.append(a + occurrences(a) * len(number))
    return lists, out


def _star(t: pa.Table) -> pa.Table:
    """Links of members with the center of their bucket; an id may come with several texts."""
    ids, side = t.column("id").to_pylist(), t.column("side").to_pylist()
    lists, bags = _numbered(t.column("text").to_pylist())
    found = set()
    for c in [i for i, s in enumerate(side) if s == 0]:
        bag = np.sort(bags[c])
        for x in [i for i, s in enumerate(side) if s == 1]:
            n, m = len(lists[c]), len(lists[x])
            most = allowed(n, m)
            if abs(n - m) > most or not m or ids[x] in found:
                continue
            at = np.minimum(np.searchsorted(bag, bags[x]), n - 1)
            if int((bag[at] == bags[x]).sum()) >= max(n, m) - most and distance(lists[c], lists[x], most) <= most:
                found.add(ids[x])
    center = t.column("center")[0].as_py()
    return pa.table({"src": pa.array(sorted(found), pa.int64()), "dst": pa.array([center] * len(found), pa.int64())})


def _postings(rank: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in order of their sizes n, whose labelled words (rarest 0) are `rank`: texts by word, for the words that lead to
    others; where a text's own entries are among them; and where those of each entry's word end.

    Texts that have all but `most` of the longer one's words in common share one of their most + 1 rarest: each leads by those.
    """
    row = np.repeat(np.arange(len(n)), n)
    word = np.sort(row * (int(rank.max()) + 1) + rank) - row * (int(rank.max()) + 1)
    leads = np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n) <= np.repeat(np.floor((1 - SIMILARITY) * n + 1e-9).astype(np.int64), n)
    word, row = word[leads], row[leads]
    by = np.argsort(word, kind="stable")
    end = np.searchsorted(word[by], word[by], "right")
    return row[by], np.argsort(row[by], kind="stable"), end


def _bucket(t: pa.Table) -> pa.Table:
    """Links between labels of one bucket, or of two blocks of it: pairs that other links join aren't looked at.

    Texts are taken by size; a text's candidates are the longer ones of fitting size with which it shares one of its rarest
    words, or all of fitting size where these words are common.
    """
    lists, bags = _numbered(t.column("text").to_pylist())
    n = np.array([len(x) for x in lists])
    order = np.lexsort((t.column("id").to_numpy(), t.column("side").to_numpy(), n))
    order = order[n[order] > 0]
    n, lists, bags = n[order], [lists[i] for i in order], [bags[i] for i in order]
    side, label = t.column("side").to_numpy()[order], t.column("label").to_numpy()[order]
    comp, found = np.unique(label, return_inverse=True)[1], []
    if len(n):
        values, flat, times = np.unique(np.concatenate(bags), return_inverse=True, return_counts=True)
        rank = np.empty(len(values), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(values))
        flat = rank[flat]
        text, own_at, end = _postings(flat, n)
        leads = np.r_[0, np.cumsum(np.floor((1 - SIMILARITY) * n + 1e-9).astype(np.int64) + 1)]
        start, mark, common = np.r_[0, np.cumsum(n)], np.zeros(len(values), bool), n - np.floor((1 - SIMILARITY) * n + 1e-9)
        fits = np.searchsorted(common, n, "right")  # from there on texts are too long
    for x in range(len(n)):
        at = own_at[leads[x] : leads[x + 1]]
        more = end[at] - at - 1
        if more.sum() < fits[x] - x - 1:
            first = np.cumsum(more) - more
            c = np.unique(text[np.repeat(at + 1 - first, more) + np.arange(more.sum())])
            c = c[c < fits[x]]
        else:
            c = np.arange(x + 1, fits[x])
        if side.any():  # blocks a and b: links within a block are found elsewhere
            c = c[side[c] != side[x]]
        c = c[comp[c] != comp[x]]
        if not len(c):
            continue
        own, sizes = flat[start[x] : start[x + 1]], n[c]
        mark[own] = True
        first = np.cumsum(sizes) - sizes
        both = np.add.reduceat(mark[flat[np.repeat(start[c] - first, sizes) + np.arange(sizes.sum())]].astype(np.int64), first)
        mark[own] = False
        for y in c[both >= common[c]].tolist():
            if comp[x] != comp[y] and alike(lists[x], lists[y]):
                found.append((int(label[x]), int(label[y])))
                comp[comp == comp[y]] = comp[x]
    return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})


def _dealt(labelled: DataFrame, total: int) -> DataFrame:
    """Rows of buckets, dealt to the tasks that compare them: (value, id, label, a, b, side), a row per block that its own meets.

    labelled: (value, center, id, words, label). Centers aren't dealt, because each was aligned with all of its bucket; nor are
    buckets whose others have one label, nor all but one of buckets of the same ids (their number and two 64-bit hashes).
    """
    others = labelled.filter("id != center").select("value", "id", "words", "label")
    hashed = [F.sum(F.xxhash64("id", F.lit(i)).cast("decimal(20,0)")).alias(f"ids{i}") for i in range(2)]
    open_ = others.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high"), _blocks(WIDER * BLOCK).alias("blocks"), F.count(F.lit(1)).alias("rows"), *hashed).filter("low != high")
    open_ = open_.groupBy("rows", "ids0", "ids1").agg(F.min(F.struct("value", "blocks")).alias("one")).select("one.*", "rows")
    inside = join_hot(others, open_, "value", total)
    inside = inside.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pair = F.explode(
        F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("side")))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("a"), F.greatest(x, F.col("own")).alias("b"), (F.col("own") > x).cast("int").alias("side")))
        )
    )
    return inside.select("value", "id", "label", pair.alias("p")).select("value", "id", "label", "p.*")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (smallest id reachable by links), kept (doc_id = class_id), shingles.

    Two texts link when one of their sketches (or short keys) agrees and their word sequences, aligned in a band, are alike by
    0.8 or more: one less the edited words over the longer text's words. Words are what white space parts. Texts with the same
    words are copies: one class whatever their length; a text without words (or null) is alone in its class. Null ids are given
    class null and stay; rows of one id are one document, linked where any of its texts is. An empty table gives no rows; other
    columns are ignored, whatever their names.

    A sketch is the two least of a text's five-word shingles under one of 64 orders, in the order of the text; it agrees with
    probability s**2 for a share s of common shingles. Of pairs with 10 % of their words replaced (s = 0.42) 0.99999 meet in one
    of 64, with 20 % (s = 0.2) 0.92; texts of at most SHORT shingles have keys that miss no pair at 0.9 or more.
    There is no cap on candidates.

    Plan: one pass makes (id, counts, key, sketches); equal keys collapse, so copies are never paired. The smallest id of each
    bucket is its center; members are aligned with their centers first, in groups of at most BLOCK texts, and the links'
    components label them. Only buckets whose others then still hold two labels are compared within, between texts of unlike
    labels, in blocks (and pairs of blocks) of at most WIDER * BLOCK texts; of buckets of the same ids, one. Texts that share no bucket never move, if the others' ids are few
    enough to be broadcast; else each text moves once.
    """
    work = Work()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        sk = work.save(texts.mapInArrow(_sketches, "id long, n int, words int, key string, sk array<long>"), "omh-sketch")
    copies = sk.filter("id IS NOT NULL AND n > 0").groupBy("key").agg(F.min(F.struct("id", "n", "words", "sk")).alias("r"), F.count(F.lit(1)).alias("rows"))
    rep = work.save(copies.select("key", "rows", "r.*"), "omh-reps")
    bands = rep.select("id", "words", F.explode("sk").alias("value"))
    stars = work.save(bands.groupBy("value").agg(F.min("id").alias("center"), F.count(F.lit(1)).alias("rows")).filter("rows > 1"), "omh-stars")
    member = work.save(join_hot(bands, stars, "value", (SKETCHES + SHORT) * rep.count()), "omh-members")
    held = work.save(texts.join(few(work.save(member.select("id").distinct(), "omh-ids")), "id", "left_semi"), "omh-texts")

    pairs = member.filter("id != center").select("center", "id", "words").distinct()
    sizes = pairs.groupBy("center").agg(_blocks(BLOCK).alias("salts"))
    leaves = pairs.join(sizes, "center").select("id", "center", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
    roots = sizes.select(F.col("center").alias("id"), "center", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("side"))
    sent = leaves.unionByName(roots).join(held, "id")
    with small_batches(docs.sparkSession):
        links = work.save(sent.groupBy("center", "salt").applyInArrow(_star, "src long, dst long"), "omh-links")
    label = work.save(connected_components(links, work), "omh-labels").withColumnRenamed("node", "id")

    labelled = work.save(member.join(label, "id", "left").select("value", "center", "id", "words", F.coalesce("component", "id").alias("label")), "omh-labelled")
    dealt = _dealt(labelled, labelled.count()).join(held, "id")
    with small_batches(docs.sparkSession):
        joined = work.save(dealt.groupBy("value", "a", "b").applyInArrow(_bucket, "src long, dst long"), "omh-joined")
    upper = work.save(connected_components(joined, work), "omh-upper").select(F.col("node").alias("component"), F.col("component").alias("class"))

    to = rep.select("key", "rows", "id").join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    to = to.join(few(upper), "component", "left").select("key", "rows", F.coalesce("class", "component").alias("class_id"))
    named = sk.filter("id IS NOT NULL AND n > 0").select("id", "n", "key")
    alone = sk.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("class_id"))
    out = join_hot(named, to, "key", sk.count()).select("id", "n", "class_id").unionByName(alone)
    return work.done(out.select(F.col("id").alias("doc_id"), "class_id", F.coalesce(F.col("id") == F.col("class_id"), F.lit(True)).alias("kept"), F.col("n").cast("long").alias("shingles")), "omh")


def _blocks(most: int):
    """Blocks of a group of at most so many rows, by its rows and their words."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / most), F.ceil(F.sum("words") / WORDS)).cast("int")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all columns: the one of the smallest id (null last), then any one.

    Rows are compared and dropped by a key of their own, so null and repeated ids are rows like others.
    """
    work = Work()
    keyed, row = with_row_key(docs, "omh-keyed")
    out = work.save(near_duplicates(keyed, row, text_col).select(F.col("doc_id").alias("row"), "class_id", "kept"), "omh-rows")
    shared = out.filter("NOT kept").groupBy("class_id").agg((F.count(F.lit(1)) + 1).alias("rows"))
    ids = keyed.select(F.col(row).alias("row"), F.col(id_col).alias("id"))
    member = join_hot(out, shared, "class_id", out.count()).join(ids, "row")
    first = member.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull().alias("null"), "id", "row")).alias("first"), F.count(F.lit(1)).alias("rows"))
    gone = work.done(join_hot(member, first, "class_id", out.count()).filter(F.col("row") != F.col("first.row")).select(F.col("row").alias(row)), "omh-gone")
    return keyed.join(few(gone), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
