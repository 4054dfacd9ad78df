"""Languages of a document as a mixture, by expectation-maximisation.

Each language has a trigram model over bytes. The words of a document are draws
from a mixture of languages; a word's likelihood under a language is the product
of its trigrams' probabilities. Expectation-maximisation estimates the
proportions, once over all languages and then over the likeliest one, two and so
on up to all; the language set with the best penalised likelihood is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx

#: Trigrams are hashed into so many counts per language.
BUCKETS = 1 << 16
#: Pseudo-count of every bucket.
PRIOR = 0.1
#: Rounds of expectation-maximisation per language set.
ROUNDS = 6
#: Log-likelihood that a further language must bring, per logarithm of the number of words.
PENALTY = 3.0
UNDETERMINED = "und"


class Model(NamedTuple):
    """Languages in order, and log-probabilities by bucket and language."""

    languages: tuple[str, ...]
    log: np.ndarray


_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[b for b in range(128) if not chr(b).isalpha()]] = 0x20
_PLAIN[65:91] += 32


def trigrams(block: tx.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The trigram bucket around every byte, and the words: row, start, end.
    ASCII counts as lower-case letters and blanks; rows begin and end blank."""
    data = _PLAIN[block.data]
    found = tx.words(block._replace(data=data))
    before = np.append(np.uint8(0x20), data[:-1])
    after = np.append(data[1:], np.uint8(0x20))
    some = block.ends > block.starts
    before[block.starts[some]] = 0x20
    after[block.ends[some] - 1] = 0x20
    packed = before.astype(np.uint32) << 16 | data.astype(np.uint32) << 8 | after
    return (packed * np.uint32(0x9E3779B1)) >> np.uint32(16), *found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigram counts by language of all rows of a task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column(1).to_pylist(), object)
        for block in tx.blocks(batch):
            buckets, row, start, end = trigrams(block)
            inside = np.zeros(len(buckets) + 1, np.int8)
            inside[start] += 1
            inside[end] -= 1
            at = np.flatnonzero(np.cumsum(inside[:-1]))
            own = languages[block.first + np.searchsorted(block.starts, at, "right") - 1]
            for language in set(languages[block.first:block.first + len(block.starts)]):
                more = np.bincount(buckets[at[own == language]], minlength=BUCKETS)
                counts[language] = counts.get(language, 0) + more
    for language, values in counts.items():
        at = np.flatnonzero(values)
        yield pa.RecordBatch.from_arrays(
            [pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(values[at].astype(np.int64))],
            ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> Model:
    """Models from all rows of `docs` with a text and a lang. The driver gets one
    number per language and bucket, whatever the size of the corpus."""
    rows = docs.where("lang is not null and text is not null")
    rows = rows.select(F.col("text").cast("string"), F.col("lang").cast("string"))
    counted = rows.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counted.toArrow()
    languages = tuple(sorted(set(got["lang"].to_pylist())))
    n = np.full((BUCKETS, len(languages)), PRIOR)
    which = {name: k for k, name in enumerate(languages)}
    np.add.at(n, (got["bucket"].to_numpy(), np.array([which[x] for x in got["lang"].to_pylist()], int)), got["n"].to_numpy())
    return Model(languages, np.log(n / n.sum(0)).astype(np.float32))


def mixtures(likely: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of the chosen languages per document (0 for others), and the
    proportions over all languages. `likely` has log-likelihoods by word and
    language, the words of document k being first[k] and the next n[k] - 1."""
    docs, langs = len(first), likely.shape[1]
    top = likely.max(1)
    odds = np.exp(likely - top[:, None]).astype(np.float32)
    owner = np.repeat(np.arange(docs), n)
    ones = np.ones(langs, np.float32)

    def run(share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(ROUNDS):
            part = odds * share.astype(np.float32)[owner]
            part /= np.maximum(part @ ones, np.float32(1e-37))[:, None]
            share = np.add.reduceat(part, first) / n[:, None]
        total = (odds * share.astype(np.float32)[owner]) @ ones
        fit_ = np.add.reduceat(np.log(np.maximum(total, np.float32(1e-37))).astype(np.float64) + top, first)
        return share, fit_

    every, _ = run(np.full((docs, langs), 1 / langs))
    order = np.argsort(-every, axis=1, kind="stable")
    best, best_score = np.zeros_like(every), np.full(docs, -np.inf)
    for size in range(1, langs + 1):
        allowed = np.zeros((docs, langs), bool)
        np.put_along_axis(allowed, order[:, :size], True, 1)
        start = np.where(allowed, np.maximum(every, 1e-3), 0)
        share, fit_ = run(start / start.sum(1, keepdims=True))
        score = fit_ - PENALTY * (size - 1) * np.log(n + 1)
        better = score > best_score
        best[better], best_score[better] = share[better], score[better]
    return best, every


def _predict(model: Model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            for block in tx.blocks(batch):
                rows = len(block.starts)
                buckets, row, start, end = trigrams(block)
                n = np.bincount(row, minlength=rows)
                some = np.flatnonzero(n)
                letters = (block.data >= 65) & (block.data <= 122) & (_PLAIN[block.data] != 0x20)
                sure = np.append(0, np.cumsum(letters))
                sure = sure[block.ends] > sure[block.starts]
                for k in np.flatnonzero(~sure & (n > 0)):  # letters outside ASCII, or none
                    sure[k] = any(c.isalpha() for c in block.text(k).decode())
                pick = np.full(rows, len(model.languages))
                score = np.zeros(rows)
                mix = np.zeros((rows, len(model.languages)))
                if len(some) and model.languages:
                    likely = np.empty((len(start), len(model.languages)))
                    for k in range(len(model.languages)):
                        sums = np.append(0, np.cumsum(model.log[buckets, k], dtype=np.float64))
                        likely[:, k] = sums[end] - sums[start]
                    first = (np.cumsum(n) - n)[some]
                    mix[some], every = mixtures(likely, first, n[some])
                    chosen = mix[some].argmax(1)
                    pick[some] = chosen
                    score[some] = every[np.arange(len(some)), chosen]
                pick[~sure], score[~sure], mix[~sure] = len(model.languages), 0, 0
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, rows), tx.strings(names[pick]), pa.array(np.clip(score, 0, 1)),
                    pa.array(mix.tolist(), pa.list_(pa.float64())),
                ], ["doc_id", "lang_pred", "score", "proportions"])
    return predict


def predicted(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, proportions) for every row of `docs`: the
    language with the largest share of the chosen set, its share when all
    languages compete, and the shares of the chosen set in the order of
    `model.languages`. A text that is null or has no letter is undetermined with
    score 0, and so is everything under a model without languages. A text of any
    length is read whole in one task; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_predict(model), "doc_id long, lang_pred string, score double, proportions array<double>")


def fold(of: Column, folds: int) -> Column:
    """Remainder of crc32 of an id written in decimal."""
    return F.crc32(of.cast("string").cast("binary")) % folds
