"""Interaction of document filters, over all orders in which they may be applied.

A document is reduced to the mask of filters it fails, and the corpus to counts per
part, mask and label, which Spark aggregates. The audit itself is a min-plus product:
a mask's row holds 0 where it fails a filter and infinity elsewhere, an order's row
holds the place of every filter (its inverse permutation), and the least sum over the
filters is the step that removes the mask's documents in that order. Removed documents
are those steps' weights scattered over (order, step); redundant ones fail a step's
filter at a later place than they were removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm import text as tx

FILTERS = "ABCDE"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#$%&*|")] = True
NEVER = 1 << 20

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def failed(block: tx.Block) -> np.ndarray:
    """Bits of the filters that judge a text alone: A few words, B repeated
    words, C capitals, D symbols."""
    data, n = block.data, len(block.starts)
    found = tx.words(block)
    keys = tx.word_keys(data, found) if len(data) else np.zeros(0, tx.U)

    def within(marks: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(marks))
        return upto[block.ends] - upto[block.starts]

    words = np.bincount(found.row, minlength=n)
    unlike = np.bincount(tx.distinct(keys, found.row)[1], minlength=n)
    points, capitals = within((data & 0xC0) != 0x80), within((data >= 65) & (data <= 90))
    fails = (words < 200, 100 * unlike < 50 * words, 100 * capitals > 3 * points, within(SYMBOLS[data]) > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tx.blocks(batch):
            rows = batch.slice(block.first, len(block.starts))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), rows.column(2), pa.array(failed(block).astype(np.int32))],
                ["doc_id", "part", "key", "mask"])


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): documents by language, failed filters and labels.

    A null text is empty, a null language the part ''. Filter E fails where a smaller
    doc_id has the same text (by SHA-256); rows without a doc_id, and the rows with the
    smallest one, never fail it. A document is good or toxic if any of its label rows says 1.

    Only ids, keys and masks are shuffled. Copies fold into one row per task, text key
    and label before they meet, so a text held by a third of all rows is a few rows; the
    window over one text's rows has one per language and label.
    """
    rows = docs.select(
        F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("key"), "text")
    found = rows.mapInArrow(_failed, "doc_id long, part string, key binary, mask int")
    folded = found.groupBy("doc_id", "part", "key", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = folded.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    # a doc_id stands at most once in each of these groups
    groups = marked.groupBy("key", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless"))
    first = F.min("first").over(Window.partitionBy("key"))
    unlike = F.col("n_nameless") + F.when(F.col("first") == first, F.col("n_first")).otherwise(0)
    split = groups.withColumn("unlike", unlike).select("part", "good", "toxic", F.explode(F.array(
        F.struct("mask", F.col("unlike").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << FILTERS.index("E"))).alias("mask"), (F.col("n") - F.col("unlike")).alias("n")),
    )).alias("m"))
    counts = split.select("part", "good", "toxic", "m.mask", "m.n").where("n > 0")
    return counts.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def orders(n: int) -> np.ndarray:
    """All orders of n filters, one row each."""
    return np.array(list(permutations(range(n))), np.int64).reshape(-1, n)


def removal_steps(masks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Min-plus product of (masks x filters) with (filters x orders): the place at
    which an order removes each mask, NEVER or more where no filter fails.

    masks: (M, n) of 0 where the filter fails and NEVER elsewhere; places: (O, n).
    """
    return (masks[:, None, :] + places[None, :, :]).min(2)


def interactions(weights: np.ndarray, n: int = len(FILTERS)) -> dict[str, np.ndarray]:
    """COUNTS, each (orders x steps), from weights (2**n masks x 3): all, good and toxic documents."""
    fails = (np.arange(1 << n)[:, None] >> np.arange(n) & 1).astype(bool)
    applied = orders(n)
    places = np.argsort(applied, 1)
    steps = removal_steps(np.where(fails, 0, NEVER), places)
    mask, order = np.nonzero(steps < NEVER)
    at = (order, steps[mask, order])
    removed = np.zeros((3, len(applied), n), np.int64)
    for k in range(3):
        np.add.at(removed[k], at, weights[mask, k])
    earlier = steps[:, :, None] < np.arange(n)  # masks x orders x steps
    redundant = np.einsum("mos,mos,m->os", fails[:, applied], earlier, weights[:, 0])
    by_filter = np.take_along_axis(removed[0], places, 1).sum(0)
    return {
        "kept": weights[:, 0].sum() - np.cumsum(removed[0], 1), "removed": removed[0], "redundant": redundant,
        "unique_fails": weights[1 << applied, 0], "good_lost": removed[1], "toxic_lost": removed[2],
        "shapley": by_filter[applied],
    }


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["".join(FILTERS[f] for f in o) for o in orders(len(FILTERS))]
    n = len(FILTERS)
    for batch in batches:
        for row in batch.to_pylist():
            weights = np.zeros((1 << n, 3), np.int64)
            for c in row["counts"]:
                weights[c["mask"]] += np.array([1, c["good"], c["toxic"]]) * c["n"]
            found = interactions(weights)
            size = len(names) * n
            columns = [pa.array([row["part"]] * size), pa.array(np.repeat(names, n).tolist()),
                       pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names)))]
            yield pa.RecordBatch.from_arrays(
                [*columns, *(pa.array(found[c].astype(np.int64).ravel()) for c in COUNTS)], ["part", "filter_order", "step", *COUNTS])


def audit(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from what `mask_counts` returns.
    A part's counts are at most 128 rows. No documents give no rows."""
    one = F.collect_list(F.struct("mask", "good", "toxic", "n")).alias("counts")
    schema = ", ".join(["part string, filter_order string, step int", *(f"{c} long" for c in COUNTS)])
    return counts.groupBy("part").agg(one).mapInArrow(_audit, schema)


ORACLE = """
WITH marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         min(doc_id) OVER (PARTITION BY text) AS first FROM d
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, map {
    'A': len(words) < 200,
    'B': 100 * len(list_distinct(words)) < 50 * len(words),
    'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'),
    'E': coalesce(doc_id > first, false)} AS fails
  FROM w LEFT JOIN marks USING (doc_id)
), g AS (
  SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest(range(1, 6)) AS step)
), e AS (
  SELECT s.*, part, good, toxic, n, fails[own] AS here,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: contains(before, x) AND fails[x])) > 0 AS gone,
         len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: fails[x])) AS n_fails
  FROM s, g
), t AS (
  SELECT part, filter_order, step, own,
    coalesce(sum(n) FILTER (NOT gone AND NOT here), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND here), 0) AS removed,
    coalesce(sum(n) FILTER (gone AND here), 0) AS redundant, coalesce(sum(n) FILTER (here AND n_fails = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (NOT gone AND here AND good = 1), 0) AS good_lost,
    coalesce(sum(n) FILTER (NOT gone AND here AND toxic = 1), 0) AS toxic_lost
  FROM e GROUP BY ALL
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM t
"""
