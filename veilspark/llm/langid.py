"""Language identification with a byte convolutional network trained in numpy.

Bytes (A-Z lower-cased) are embedded; filters of several widths slide over
windows of ``LENGTH`` bytes; each filter's maximum over the window goes through
one softmax layer. A text is cut into windows from end to end, and its class
probabilities are the mean over its windows by their length, so the whole text
counts.

Training takes only text and lang of rows whose crc32 of the doc_id as text is
not 0 modulo 5, a sample of about ``MAX_WINDOWS`` windows over all languages
(the documented bound), chosen by hash so that reruns agree. Every language is learned. The model
(about 50 KB) travels with the function.

Edge cases: null text, or text without a letter, is ``und`` with score 0; null
lang is never learned; a null doc_id is held out; repeated rows are predicted
alike; without any row to learn from every row is ``und``; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .workspace import pick

LENGTH = 128
WIDTHS = (2, 3, 4, 5)
PER_WIDTH = 8
EMBED = 8
MAX_WINDOWS = 24_000
PER_DOCUMENT = 6
EPOCHS = 4
UNKNOWN = "und"
_BLOCK, _SOME = 512, 16_384


@dataclass
class Model:
    classes: list[str]
    embed: np.ndarray  # (256, EMBED)
    conv: np.ndarray  # (widest, EMBED, filters), zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> np.ndarray:
        """What a byte adds to every filter at every tap: (widest, 256, filters)."""
        return np.einsum("be,kef->kbf", self.embed, self.conv).astype(np.float32)


def _mask() -> np.ndarray:
    keep = np.zeros((max(WIDTHS), len(WIDTHS) * PER_WIDTH), np.float32)
    for i, w in enumerate(WIDTHS):
        keep[:w, i * PER_WIDTH : (i + 1) * PER_WIDTH] = 1
    return keep


def _convolve(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(windows, positions, filters) before the bias."""
    widest = len(tables)
    n = x.shape[1] - widest + 1
    out = np.take(tables[0], x[:, :n], axis=0)
    for k in range(1, widest):
        skip = sum(PER_WIDTH for w in WIDTHS if w <= k)
        out[:, :, skip:] += np.take(np.ascontiguousarray(tables[k][:, skip:]), x[:, k : k + n], axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(model: Model, tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(x), len(model.classes)), np.float32)
    for i in range(0, len(x), _BLOCK):
        peak = _convolve(tables, x[i : i + _BLOCK]).max(1)
        out[i : i + _BLOCK] = _softmax(np.maximum(peak + model.bias, 0) @ model.out + model.out_bias)
    return out


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy, by parameter; they flow only through each filter's best position."""
    widest = max(WIDTHS)
    act = _convolve(Model([], **p).tables(), x)
    best = act.argmax(1)  # (rows, filters)
    raw = np.take_along_axis(act, best[:, None, :], 1)[:, 0] + p["bias"]
    hidden = np.maximum(raw, 0)
    prob = _softmax(hidden @ p["out"] + p["out_bias"])
    prob[np.arange(len(y)), y] -= 1
    prob /= len(y)
    back = (prob @ p["out"].T) * (raw > 0)
    taps = np.take_along_axis(x[:, :, None], best[:, None, :] + np.arange(widest)[None, :, None], 1)  # bytes (rows, taps, filters)
    embed = np.zeros_like(p["embed"])
    np.add.at(embed, taps.ravel(), np.einsum("rf,kef->rkfe", back, p["conv"]).reshape(-1, EMBED))
    conv = np.einsum("rf,rkfe->kef", back, p["embed"][taps]) * _mask()[:, None, :]
    return {"embed": embed, "conv": conv, "bias": back.sum(0), "out": hidden.T @ prob, "out_bias": prob.sum(0)}


def start(classes: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    filters, widest = len(WIDTHS) * PER_WIDTH, max(WIDTHS)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)), "conv": rng.normal(0, 0.3, (widest, EMBED, filters)) * _mask()[:, None, :], "bias": np.zeros(filters),
        "out": rng.normal(0, 0.2, (filters, classes)), "out_bias": np.zeros(classes),
    }
    return {k: v.astype(np.float32) for k, v in p.items()}


def train(x: np.ndarray, y: np.ndarray, classes: list[str], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Adam on cross-entropy."""
    rng = np.random.default_rng(seed)
    p = start(len(classes), rng)
    m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
    batch, step, rate = 128, 0, 0.01
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            g = gradients(p, x[rows], y[rows])
            step += 1
            for k, a in p.items():
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                a -= (rate / (1 + epoch) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(classes, **p)


def _windows(c: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and true length of every window of a chunk."""
    n = (np.diff(c.off) + LENGTH - 1) // LENGTH
    doc = np.repeat(np.arange(c.n), n)
    start = c.off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * LENGTH
    return doc, start, np.minimum(c.off[doc + 1] - start, LENGTH)


def _bytes(c: tv.Chunk, start: np.ndarray, real: np.ndarray) -> np.ndarray:
    """The bytes of some windows, padded with 0."""
    if not len(start):
        return np.zeros((0, LENGTH), np.uint8)
    at = start[:, None] + np.arange(LENGTH)
    x = tv.LOWER[c.data[np.minimum(at, len(c.data) - 1)]]
    x[np.arange(LENGTH)[None, :] >= real[:, None]] = 0
    return x


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to PER_DOCUMENT windows, evenly spaced over each whole text."""
    for batch in batches:
        for c in tv.chunks(batch.column(1)):
            doc, start, real = _windows(c)
            first = np.searchsorted(doc, np.arange(c.n + 1))
            rows = [np.unique(np.linspace(a, b - 1, min(PER_DOCUMENT, b - a)).astype(np.int64)) for a, b in zip(first[:-1], first[1:]) if b > a]
            if rows:
                rows = np.concatenate(rows)
                of = pa.array(doc[rows] + c.lo)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(2).take(of), pa.array([r.tobytes() for r in _bytes(c, start[rows], real[rows])], pa.binary())], names=["lang", "pick", "bytes"])


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, max_windows: int = MAX_WINDOWS) -> Model | None:
    """Train on a sample of the rows that are not held out."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out()).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("pick"))
    # One row for each language, the classes of the model, comes to the driver and is broadcast.
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, max_windows // (PER_DOCUMENT * len(counts)))
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], "lang string, rate double")
    share = F.pmod(F.col("pick"), F.lit(1 << 40)) / float(1 << 40)
    got = rows.join(F.broadcast(rates), "lang").where(share < F.col("rate")).select("lang", "text", "pick").mapInArrow(_sample, "lang string, pick long, bytes binary").orderBy("pick", "bytes").limit(2 * max_windows).toPandas()
    if not len(got):
        return None
    classes = sorted(counts)
    x = np.frombuffer(b"".join(got["bytes"]), np.uint8).reshape(-1, LENGTH).copy()
    y = got["lang"].map({c: i for i, c in enumerate(classes)}).to_numpy(np.int64)
    # Some windows are shortened, so that short texts are met in training.
    rng = np.random.default_rng(5)
    cut = np.where(rng.random(len(x)) < 0.3, rng.integers(12, LENGTH, len(x)), LENGTH)
    x[np.arange(LENGTH)[None, :] >= cut[:, None]] = 0
    return train(x, y, classes)


def _predictor(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables() if model else None
        for batch in batches:
            ids, held, letters = batch.column(0), batch.column(1), batch.column(3).to_numpy(zero_copy_only=False)
            for c in tv.chunks(batch.column(2)):
                lang, score = np.full(c.n, UNKNOWN, object), np.zeros(c.n)
                if model:
                    doc, start, real = _windows(c)
                    total = np.zeros((c.n, len(model.classes)))
                    for lo in range(0, len(doc), _SOME):
                        part = slice(lo, lo + _SOME)
                        prob = probabilities(model, tables, _bytes(c, start[part], real[part])) * real[part, None]
                        for k in range(len(model.classes)):
                            total[:, k] += np.bincount(doc[part], prob[:, k], c.n)
                    total /= np.maximum(np.diff(c.off), 1)[:, None]
                    best = total.argmax(1)
                    known = letters[c.lo : c.hi].astype(bool)
                    lang[known] = np.array(model.classes, object)[best[known]]
                    score[known] = np.clip(total[np.arange(c.n), best], 0, 1)[known]
                yield pa.RecordBatch.from_arrays([ids.slice(c.lo, c.n), held.slice(c.lo, c.n), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; reads doc_id only for held_out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return rows.mapInArrow(_predictor(model), "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    return predict(docs, fit(docs))
