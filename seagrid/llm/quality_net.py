"""Document quality by a byte-level convolutional network in numpy.

Bytes are embedded and filtered in windows of WIDTH bytes at every second byte;
the responses are averaged over overlapping chunks of 2 * HOP bytes that cover
the whole document, filtered again per chunk, max-pooled over all chunks, and
combined into one probability. All filters and embeddings are learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import plainly_named

DIMS, WIDTH, FILTERS, UNITS, HOP = 8, 4, 16, 48, 64
STEPS = HOP // 2

#: The sample the network is fitted on: at most so many documents per class, none longer than so many bytes.
SAMPLE, LONGEST = 1000, 1 << 16
ROUNDS, BATCH, RATE = 400, 32, 0.006
#: Documents below this probability are rejected.
LEAST = 0.3


class Net(NamedTuple):
    embed: np.ndarray  # 256 x DIMS
    narrow: np.ndarray  # WIDTH * DIMS x FILTERS
    narrow_bias: np.ndarray
    wide: np.ndarray  # FILTERS x UNITS
    wide_bias: np.ndarray
    out: np.ndarray  # UNITS
    out_bias: np.ndarray  # 1


def fresh(seed: int) -> Net:
    rng = np.random.default_rng(seed)

    def normal(*shape: int) -> np.ndarray:
        return (rng.normal(size=shape) * np.sqrt(2 / shape[0])).astype(np.float32)

    return Net(
        rng.normal(size=(256, DIMS)).astype(np.float32) * np.float32(0.7), normal(WIDTH * DIMS, FILTERS), np.zeros(FILTERS, np.float32),
        normal(FILTERS, UNITS) * np.float32(3), np.zeros(UNITS, np.float32), normal(UNITS) * np.float32(0.3), np.zeros(1, np.float32),
    )


def padded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes, each filled up with zeros to whole hops and one more, and the hops of each row (two at least)."""
    size = ends - starts
    hops = np.maximum(2, -(-size // HOP) + 1)
    to = (np.cumsum(hops) - hops) * HOP
    out = np.zeros(int(hops.sum()) * HOP, np.uint8)
    out[np.arange(len(data)) + np.repeat(to - starts, size)] = data
    return out, hops


def pooled(narrow: np.ndarray, hops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Averages over chunks of two hops; also the first hop of every chunk, and the first chunk of every row."""
    hop = narrow.reshape(-1, STEPS, narrow.shape[1]).mean(1)
    last = np.cumsum(hops) - 1
    at = np.delete(np.arange(len(hop)), last)
    return (hop[at] + hop[at + 1]) / 2, at, np.cumsum(hops - 1) - (hops - 1)


def tables(net: Net) -> tuple[np.ndarray, np.ndarray]:
    """Responses of the first and second half of a window by its pair of bytes:
    the narrow filters over all 65,536 pairs, so that scoring only looks up."""
    part = [net.embed @ net.narrow[k * DIMS:(k + 1) * DIMS] for k in range(WIDTH)]
    low, high = np.arange(65536) & 255, np.arange(65536) >> 8
    return part[0][low] + part[1][high] + net.narrow_bias, part[2][low] + part[3][high]


def following(pairs: np.ndarray, hops: np.ndarray) -> np.ndarray:
    """The pair after each; padding at the end of a row, so that rows do not mix."""
    after = np.append(pairs[1:], np.uint16(0))
    after[np.cumsum(hops) * STEPS - 1] = 0
    return after


def score_rows(net: Net, halves, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    rows, hops = padded(data, starts, ends)
    pairs = rows.view("<u2")
    narrow = halves[0][pairs]
    narrow += halves[1][following(pairs, hops)]
    np.maximum(narrow, 0, out=narrow)
    chunk, _, first = pooled(narrow, hops)
    wide = np.maximum(chunk @ net.wide + net.wide_bias, 0)
    z = np.maximum.reduceat(wide, first) @ net.out + net.out_bias
    return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))


def train(texts: list[bytes], labels: np.ndarray, seed: int = 7) -> Net:
    """Adam on the cross-entropy; every batch has as many documents of either class."""
    net = fresh(seed)
    rng = np.random.default_rng(seed)
    classes = [np.flatnonzero(labels == q) for q in (0, 1)]
    m, v = [np.zeros_like(p) for p in net], [np.zeros_like(p) for p in net]
    for step in range(1, ROUNDS + 1):
        own = np.concatenate([rng.choice(c, BATCH // 2) for c in classes])
        size = np.array([len(texts[k]) for k in own])
        data = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
        grads = _gradients(net, data, np.cumsum(size) - size, np.cumsum(size), labels[own])
        rate = RATE * min(1, step / 50) * (0.5 + 0.5 * np.cos(np.pi * step / ROUNDS))
        for k, g in enumerate(grads):
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            net[k][...] -= rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-8)
    return net


def _gradients(net: Net, data, starts, ends, labels) -> list[np.ndarray]:
    rows, hops = padded(data, starts, ends)
    pairs = rows.view("<u2")
    after = following(pairs, hops)
    window = np.stack([pairs & 255, pairs >> 8, after & 255, after >> 8], 1).astype(np.int64)
    inputs = net.embed[window].reshape(len(pairs), -1)
    narrow = np.maximum(inputs @ net.narrow + net.narrow_bias, 0)
    chunk, hop, first = pooled(narrow, hops)
    wide = np.maximum(chunk @ net.wide + net.wide_bias, 0)
    top = np.maximum.reduceat(wide, first)
    p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias, -30, 30)))
    dz = ((p - labels) / len(labels)).astype(np.float32)
    row = np.repeat(np.arange(len(hops)), hops - 1)
    dwide = (dz[:, None] * net.out)[row] * ((wide == top[row]) & (wide > 0))
    dchunk = dwide @ net.wide.T / (2 * STEPS)
    dhop = np.zeros((len(rows) // HOP, FILTERS), np.float32)
    dhop[hop] += dchunk
    dhop[hop + 1] += dchunk
    dnarrow = np.repeat(dhop, STEPS, 0) * (narrow > 0)
    dinputs = (dnarrow @ net.narrow.T).reshape(-1, WIDTH, DIMS)
    flat = window.ravel()
    dembed = np.stack([np.bincount(flat, dinputs[:, :, k].ravel(), 256) for k in range(DIMS)], 1)
    return [
        dembed.astype(np.float32), inputs.T @ dnarrow, dnarrow.sum(0), chunk.T @ dwide, dwide.sum(0),
        top.T @ dz, dz.sum(keepdims=True),
    ]


def fold(of: Column, folds: int) -> Column:
    """Remainder of crc32 of an id written in decimal."""
    return F.crc32(of.cast("string").cast("binary")) % folds


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Net | None:
    """Fit on a sample of labelled documents: per class the `sample` with the
    smallest hashed ids among those of at most `longest` bytes. That bounds what
    the driver gets (2 * sample * longest bytes) at any corpus size. Of several
    labels for one id the smallest counts, of several texts the first in byte
    order. None if a class is missing."""
    marks = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.select(F.col("doc_id").cast("long").alias("_id"), "quality").hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = rows.where(f"_id is not null and text is not null and length(text) <= {longest}")
    # ids first: the texts of the sample alone are fetched afterwards
    ids = rows.select("_id").join(marks, "_id")
    order = (F.xxhash64(F.col("_id"), F.lit(11)), F.col("_id"))
    chosen = [ids.where(f"quality = {q}").distinct().orderBy(*order).limit(sample) for q in (0, 1)]
    chosen = chosen[0].union(chosen[1])
    got = rows.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))
    got = got.toArrow().sort_by([("_id", "ascending")])
    y = got["quality"].to_numpy()
    return train(got["text"].to_pylist(), y) if len(np.unique(y)) == 2 else None


_ready: dict[bytes, tuple] = {}


def _halves(net: Net):
    """Tables of the network at hand, made once per worker process."""
    key = net.narrow.tobytes()
    if key not in _ready:
        _ready.clear()
        _ready[key] = tables(net)
    return _ready[key]


def _score(net: Net | None, least: float | None):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.full(batch.num_rows, 0.5)
            for block in tx.blocks(batch, size=1 << 19):
                if net is not None:
                    found[block.first:block.first + len(block.starts)] = score_rows(net, _halves(net), block.data, block.starts, block.ends)
            kept = batch if least is None else batch.filter(pa.array(found >= least))
            scores = found if least is None else found[found >= least]
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(scores)], [*kept.schema.names, "_score"])
    return score


def scored(docs: DataFrame, net: Net | None, least: float | None = None) -> DataFrame:
    """`docs` with `_score`, the probability of label 1; with `least` only the
    rows that reach it. Null and empty texts are scored as one chunk of padding.
    Without a network (no labels to learn from) every score is 0.5. Nothing but
    the text is read, so other columns, repeated rows and missing ids do not
    matter; a column `_score` gives way."""
    docs = docs.drop("_score")
    rows = plainly_named(docs, "text")
    schema = ", ".join([*(f"{c} {t}" for c, t in rows.dtypes), "_score double"])
    return rows.mapInArrow(_score(net, least), schema).toDF(*docs.columns, "_score")
