"""Byte-level convolutional quality classifier in numpy.

A text is its UTF-8 bytes. Every byte has a small learned vector; learned filters run over
overlapping chunks of `WIDTH` bytes that begin every `STRIDE` bytes and so cover the whole
text; each filter's largest response over the document, rectified, is combined by one
logistic unit into a probability. Only the text enters a score.

The model is fitted on the driver on a bounded sample: per label the `PER_LABEL` rows whose
hashed id is smallest, with texts of at most `FIT_BYTES` bytes. Both classes weigh the same
in the fit; the intercept is then shifted to the proportion of all labelled rows. Scoring
reads all texts whole, in pieces of bounded size.

Defined cases: null text is empty; an empty text is one chunk of padding and gets that
chunk's score; repeated rows get equal scores; without a labelled row of each class the model
scores the share of label 1 (0.5 when there are no labels).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from harvestline.llm.support import bound_batches, table, texts_of

WIDTH, STRIDE, CHANNELS, FILTERS = 16, 4, 6, 32
PER_LABEL = 1_500          # labelled rows of each class in the fit at most
FIT_BYTES = 32_768         # longer texts are left out of the fit, never of the scoring
STEPS, EPOCHS, BATCH, RATE = 2_600, 60, 16, 4e-3  # small samples are seen more often
KEEP_FROM = 0.7
BLOCK = 1 << 18            # bytes scored at once


class Model(NamedTuple):
    vectors: np.ndarray    # 256 x CHANNELS
    filters: np.ndarray    # WIDTH * CHANNELS x FILTERS
    offsets: np.ndarray    # FILTERS
    weights: np.ndarray    # FILTERS
    intercept: float


def _padded(raw: bytes) -> np.ndarray:
    """Bytes with zeros behind them so that chunks cover the last byte."""
    chunks = max(1, -(-max(len(raw) - WIDTH, 0) // STRIDE) + 1)
    out = np.zeros((chunks - 1) * STRIDE + WIDTH, np.uint8)
    out[:len(raw)] = np.frombuffer(raw, np.uint8)
    return out


def _chunks(model: Model, codes: np.ndarray) -> np.ndarray:
    flat = model.vectors[codes].ravel()
    views = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * CHANNELS)[::STRIDE * CHANNELS]
    return np.ascontiguousarray(views)


def pooled(model: Model, raw: bytes) -> np.ndarray:
    """Largest response of every filter over the whole text."""
    codes = _padded(raw)
    best = np.full(FILTERS, -np.inf, np.float32)
    for at in range(0, len(codes) - WIDTH + 1, BLOCK):
        best = np.maximum(best, (_chunks(model, codes[at:at + BLOCK + WIDTH - STRIDE]) @ model.filters).max(0))
    return best + model.offsets


def score(model: Model, text: str) -> float:
    z = float(np.maximum(pooled(model, text.encode("utf-8", "surrogatepass")), 0) @ model.weights) + model.intercept
    return 1 / (1 + math.exp(-z)) if z > -500 else 0.0


def fit(texts: list[str], labels: list[int], share: float) -> Model:
    """Adam on the logistic loss; the gradient of a maximum flows to its chunk alone."""
    rng = np.random.default_rng(11)
    model = Model(rng.normal(0, 0.5, (256, CHANNELS)).astype(np.float32),
                  rng.normal(0, 1 / math.sqrt(WIDTH * CHANNELS), (WIDTH * CHANNELS, FILTERS)).astype(np.float32),
                  np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)
    y = np.array(labels)
    share = min(max(share, 1e-3), 1 - 1e-3)
    prior = math.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        return model._replace(weights=np.zeros(FILTERS, np.float32), intercept=prior)
    importance = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    codes = [_padded(t.encode("utf-8", "surrogatepass")) for t in texts]
    values = [*model[:4], np.zeros(1, np.float32)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    rounds = -(-len(y) // BATCH)
    epochs = min(EPOCHS, -(-STEPS // rounds))
    steps, total = 0, epochs * rounds
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            current = Model(*values[:4], float(values[4][0]))
            grads = [np.zeros_like(v) for v in values]
            for d in order[at:at + BATCH]:
                x = _chunks(current, codes[d])
                response = x @ current.filters
                top = response.argmax(0)
                peak = response[top, np.arange(FILTERS)] + current.offsets
                live = np.maximum(peak, 0)
                z = float(live @ current.weights) + current.intercept
                slope = (1 / (1 + math.exp(-max(min(z, 30), -30))) - y[d]) * importance[d] / BATCH
                back = np.where(peak > 0, slope * current.weights, 0).astype(np.float32)
                grads[3] += slope * live
                grads[4] += slope
                grads[2] += back
                grads[1] += x[top].T * back
                spread = (current.filters * back).T.reshape(FILTERS * WIDTH, CHANNELS)
                where = codes[d][(top[:, None] * STRIDE + np.arange(WIDTH)).ravel()]
                np.add.at(grads[0], where, spread)
            grads[3] += 1e-4 * values[3]
            steps += 1
            rate = RATE * min(1, 2 * (1 - steps / (total + 1)))
            for v, g, m, s in zip(values, grads, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= (rate * (m / (1 - 0.9 ** steps)) / (np.sqrt(s / (1 - 0.999 ** steps)) + 1e-8)).astype(np.float32)
    return Model(*values[:4], float(values[4][0]) + prior)


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """Fit on labelled documents that are not held out."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(
        "doc_id IS NOT NULL AND quality IN (0, 1)").where(~_held_out())
    sizes = {r[0]: r[1] for r in marked.groupBy("quality").count().collect()}
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))
    short = marked.join(sized.where(F.col("size") <= FIT_BYTES).select("doc_id").distinct(), "doc_id")
    chosen = []
    for label in (0, 1):  # ids alone are ordered; only the chosen texts come to the driver
        chosen += (short.where(F.col("quality") == label).orderBy(F.xxhash64("doc_id"), "doc_id")
                   .limit(per_label).collect())
    ids = docs.sparkSession.createDataFrame(chosen, "doc_id long, quality int")
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
             .join(F.broadcast(ids), "doc_id").where(F.octet_length("text") <= FIT_BYTES)
             .groupBy("doc_id", "quality").agg(F.min("text").alias("text")))
    rows = [(r.text, r.quality) for r in sorted(texts.collect(), key=lambda r: (r.quality, r.doc_id))]
    count = sum(sizes.values())
    return fit([r[0] for r in rows], [r[1] for r in rows], sizes.get(1, 0) / count if count else 0.5)


def _scores(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [score(model, t) for t in texts_of(batch["text"])]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                         names=[*batch.schema.names, "score"])


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of `docs` (text among them) and `score`, the probability of label 1; a column
    `score` of the input is replaced."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about 20 kB
    kept = docs.drop("score")
    schema = StructType([*kept.schema.fields, StructField("score", DoubleType())])
    return kept.mapInArrow(lambda b: _scores(b, shared.value), schema)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select("doc_id", _held_out().alias("held_out"), "score",
                         (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))
