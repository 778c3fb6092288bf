"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TwoGenerations, remove, save, small_batches

#: Character n-grams of a word between marks, hashed into so many vectors.
GRAMS, BUCKETS, DIM = (3, 4, 5), 1 << 17, 8
#: Words that are averaged together; a document scores as the smooth maximum of its windows.
WINDOW, SHARP = 5, 3.0
#: Words are runs of letters and digits, so that marks stuck to them don't matter.
words_of = re.compile(r"\w+").findall


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def subwords(word: str) -> list[int]:
    """Buckets of the n-grams of a word (in lower case) between marks."""
    w = f"<{word}>"
    raw = w.encode("utf-8", "surrogatepass") if w.isascii() else None
    crc = zlib.crc32
    if raw is not None:
        grams = [raw[i : i + n] for n in GRAMS for i in range(len(raw) - n + 1)]
    else:
        grams = [w[i : i + n].encode("utf-8", "surrogatepass") for n in GRAMS for i in range(len(w) - n + 1)]
    return [crc(g) & (BUCKETS - 1) for g in grams] or [crc(w.encode("utf-8", "surrogatepass")) & (BUCKETS - 1)]


def _softplus_pool(z: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per document log(mean(exp(SHARP*z)))/SHARP made a maximum (the mean's count is left out), and each window's share."""
    top = np.maximum.reduceat(z, starts)
    e = np.exp(SHARP * (z - np.repeat(top, lengths)))
    total = np.add.reduceat(e, starts)
    return top + np.log(total) / SHARP, e / np.repeat(total, lengths)


class ToxicityModel:
    """weights[bucket] = embedding . (w1 - w0): the linear softmax's logit of an average is the average of these."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)

    @classmethod
    def train(cls, rows: Iterable[tuple[str | None, int]], epochs: int = 50, rate: float = 0.05, decay: float = 2e-5, least: int = 5, seed: int = 3) -> ToxicityModel:
        """Full-batch Adam on embeddings and softmax together; classes are weighted alike. Without both classes: score 0 or 1's share.

        rows of (text, label) are taken one by one and kept as numbers of words only; texts without words teach nothing.
        """
        ids: dict[str, int] = {}
        packed, counts, labels = array("i"), [], []
        for text, label in rows:
            labels.append(label)
            words = words_of((text or "").lower())
            packed.extend([ids.setdefault(w, len(ids)) for w in words])
            counts.append(len(words))
        tokens, dlen, y = np.array(packed, np.int32), np.array(counts, np.int64), np.array(labels, float)
        if (dlen > 0).any():
            y, dlen = y[dlen > 0], dlen[dlen > 0]
        if not len(y) or y.min() == y.max() or not len(tokens):
            return cls(np.zeros(BUCKETS), 8.0 if len(y) and y.min() > 0 else -8.0)
        packed, sizes = array("i"), array("i")
        for word in ids:
            g = subwords(word)
            packed.extend(g)
            sizes.append(len(g))
        flat, glen = np.array(packed, np.int32), np.array(sizes, np.int64)
        del packed, sizes, ids
        of = np.repeat(np.arange(len(glen), dtype=np.int32), glen)
        often = np.bincount(flat, np.bincount(tokens, minlength=len(glen))[of], BUCKETS) >= max(least, len(y) // 400)
        flat, of = flat[often[flat]], of[often[flat]]  # n-grams seen less often keep the weight 0: they would only learn single documents
        wcount = -(-dlen // WINDOW)
        wlen = np.concatenate([np.r_[np.full(c - 1, WINDOW), n - (c - 1) * WINDOW] for n, c in zip(dlen, wcount, strict=True)])
        wstart, dstart = np.concatenate([[0], np.cumsum(wlen)[:-1]]), np.concatenate([[0], np.cumsum(wcount)[:-1]])
        share = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y == 0).sum())
        rng = np.random.default_rng(seed)
        e, w, bias = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 0.5, (2, DIM)).astype(np.float32), np.array([1.0, -1.0], np.float32)
        params = [e, w, bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        per_token, per_gram = np.repeat((1.0 / np.maximum(wlen, 4)).astype(np.float32), wlen), (1.0 / glen).astype(np.float32)
        for step in range(1, epochs + 1):
            diff = w[1] - w[0]
            word = np.bincount(of, (e @ diff)[flat], len(glen)) * per_gram
            z = np.add.reduceat(word[tokens] * per_token, wstart) + (bias[1] - bias[0])
            pooled, part = _softplus_pool(z, dstart, wcount)
            g = (1 / (1 + np.exp(-pooled)) - y) * share
            gz = np.repeat(g, wcount) * part
            gword = np.bincount(tokens, np.repeat(gz, wlen) * per_token, len(glen))
            gp = np.bincount(flat, (gword * per_gram)[of], BUCKETS).astype(np.float32)
            gw = gp @ e
            grads = [gp[:, None] * diff + decay * e, np.stack([-gw, gw]), np.array([-gz.sum(), gz.sum()], np.float32)]
            for i, (p, d) in enumerate(zip(params, grads, strict=True)):
                m[i] = 0.9 * m[i] + 0.1 * d
                v[i] = 0.99 * v[i] + 0.01 * d * d
                p -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
        return cls(np.where(often, e @ (w[1] - w[0]), 0), float(bias[1] - bias[0]))

    def scorer(self):
        weights, bias = self.weights, self.bias

        def value(word: str) -> float:
            g = subwords(word)
            return float(weights[g].sum()) / len(g)

        memo = TwoGenerations(value)

        def score(text: str | None) -> float:
            words = words_of((text or "").lower())
            if not words:
                return 1 / (1 + math.exp(-bias))
            values = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
            at = np.arange(0, len(values), WINDOW)
            sizes = np.minimum(len(values) - at, WINDOW)
            z = np.add.reduceat(values, at) / np.maximum(sizes, 4) + bias
            top = z.max()
            x = top + math.log(np.exp(SHARP * (z - top)).sum()) / SHARP
            return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))

        return score


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = 1500) -> ToxicityModel:
    """Train on at most `most` rows labelled 1 and twice as many labelled 0 (those with the smallest hash of their id), never held-out ones.

    Labels other than 0 and 1 are left out; of ids labelled twice the larger label counts; of an id with several texts the
    least one teaches. So 3*most texts at most meet in one task, in the order of their ids, which keeps word numbers only; the
    driver gets the weights (half a megabyte). Empty tables give a model that scores near 0.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    known = known.filter(~held_out("id")).groupBy("id").agg(F.max("y").alias("y"))
    order = [F.md5(F.concat(F.lit("fit"), F.col("id").cast("string"))), F.col("id")]
    some = known.filter("y = 1").orderBy(*order).limit(most).unionByName(known.filter("y = 0").orderBy(*order).limit(2 * most))
    some = docs.sparkSession.createDataFrame(some.collect(), some.schema)  # at most 3 * most rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    sample = save(rows.groupBy("id", "y").agg(F.min("text").alias("text")), "toxicity-sample")

    def fit(batches):
        model = ToxicityModel.train((t.as_py(), y.as_py()) for b in batches for t, y in zip(b.column("text"), b.column("y"), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])

    found = sample.repartition(1).sortWithinPartitions("id").mapInArrow(fit, "weights binary, bias double").collect()
    remove(sample)
    return ToxicityModel(np.frombuffer(found[0]["weights"], np.float32), found[0]["bias"]) if found else ToxicityModel.train([])


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score in 0..1, in place of one of that name: every whole text, however long; null and empty texts
    get the model's bias alone; repeated rows are scored alike."""
    from pyspark.sql import types as T

    docs = docs.drop(score_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches):
        score = model.scorer()
        for b in batches:
            texts = b.column(text_col)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([score(t.as_py()) for t in texts], pa.float64())], [*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per row of docs, repeated and null ids included: doc_id, held_out, score, predicted. Other columns are ignored,
    an empty table gives no rows."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    with small_batches(docs.sparkSession):
        scored = save(score_toxicity(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model).select("doc_id", "score"), "toxicity")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
