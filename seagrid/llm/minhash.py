"""Near-duplicate documents by b-bit MinHash with exact confirmation.

Words are `[^\\x20\\x09-\\x0D]+` after A-Z became a-z. A document's set holds its
distinct runs of `width` words; with fewer words the whole sequence is its one
shingle; without words the set is empty and linked with nothing. Documents are
linked when their sets' similarity is at least `percent` per cent.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import components, edges_of, linked_within, roots, whole_groups, written

U = np.uint64
#: Minima per document, minima per band, and low bits kept of each minimum.
#: Two sets of similarity 0.8 share none of the 32 bands once in 2e7 pairs.
MINIMA, PER_BAND, BITS = 128, 4, 4
#: Estimates may fall short of the similarity by this much; five standard
#: deviations of an estimate from 128 minima at similarity 0.8.
MARGIN = 0.18
#: Members compared with one another in one task.
CELL = 1024

SIGNED = "doc_id long, n_shingles long, print_a long, print_b long, sketch binary, bands array<long>"


def shingles(block: tx.Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle keys of all rows of a block, sorted by row and key."""
    low = tx.lower(block.data)
    found = tx.words(block)
    keys = tx.word_keys(low, found)
    at, grams = tx.runs(keys, found.row, width)
    gram_row = found.row[at]
    if width > 1:  # rows with fewer words than a shingle has
        count = np.bincount(found.row, minlength=len(block.starts))
        for short in range(1, width):
            at, more = tx.runs(keys, found.row, short)
            fits = (count[found.row[at]] == short) if len(at) else np.zeros(0, bool)
            grams = np.concatenate([grams, tx.mixed(more[fits] ^ U(short))])
            gram_row = np.concatenate([gram_row, found.row[at][fits]])
    return tx.distinct(grams, gram_row)


def _factors() -> np.ndarray:
    return tx.mixed(np.arange(1, MINIMA + 1, dtype=U) * U(tx.BASE)) | U(1)


def _sign(width: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors()
        for batch in batches:
            for block in tx.blocks(batch):
                n = len(block.starts)
                keys, row = shingles(block, width)
                count = np.bincount(row, minlength=n)
                first = np.cumsum(count) - count
                full = np.flatnonzero(count)
                minima = np.zeros((MINIMA, n), U)
                prints = np.zeros((2, n), U)
                if len(full):
                    at = first[full]
                    for k, f in enumerate(factors):
                        minima[k, full] = np.minimum.reduceat(keys * f, at)
                    for k in (0, 1):
                        prints[k, full] = np.add.reduceat(tx.mixed(keys + U(k + 1)), at)
                mixed = tx.mixed(minima)
                bands = np.zeros((MINIMA // PER_BAND, n), U)
                for k in range(len(bands)):
                    one = np.full(n, k, U)
                    for m in range(PER_BAND):
                        one = tx.mixed(one + mixed[k * PER_BAND + m])
                    bands[k] = one
                low = (mixed & U((1 << BITS) - 1)).astype(np.uint8).T
                packed = (low[:, 0::2] | (low[:, 1::2] << 4)).astype(np.uint8)
                size = packed.shape[1]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(block.first, n), pa.array(count.astype(np.int64)),
                    pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [
                        None, pa.py_buffer((np.arange(n + 1) * size).astype(np.int32)),
                        pa.py_buffer(np.ascontiguousarray(packed))]),
                    pa.ListArray.from_arrays(
                        pa.array((np.arange(n + 1) * len(bands)).astype(np.int32)),
                        pa.array(np.ascontiguousarray(bands.T).ravel().view(np.int64))),
                ], ["doc_id", "n_shingles", "print_a", "print_b", "sketch", "bands"])
    return sign


def signed(docs: DataFrame, width: int) -> DataFrame:
    """Set size, set fingerprint, packed low bits of the minima, and band keys."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_sign(width), SIGNED)


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed sketches (rows of 64-bit words), corrected
    for the minima whose low bits agree by chance."""
    x = a ^ b
    x |= x >> U(2)
    x |= x >> U(1)
    differ = np.bitwise_count(x & U(0x1111111111111111)).sum(-1, dtype=np.int64)
    chance = 2.0 ** -BITS
    return ((MINIMA - differ) / MINIMA - chance) / (1 - chance)


def _bands_link(least: float):
    """Within each cell, connect members whose sketches look similar enough."""
    def link(batches):
        for rows in whole_groups(batches, ["key", "cell"]):
            ids = rows["id"].to_numpy()
            cut = edges_of(rows["key"].to_numpy(), rows["cell"].to_numpy())
            sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), U).reshape(len(ids), -1)
            i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            sizes = np.diff(cut)
            for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
                x, y = np.triu_indices(size, 1)
                at = cut[:-1][sizes == size][:, None]
                x, y = (at + x).ravel(), (at + y).ravel()
                near = similarity(sketch[x], sketch[y]) >= least
                i.append(x[near])
                j.append(y[near])
            for k in np.flatnonzero(sizes > 32):
                own = sketch[cut[k]:cut[k + 1]]
                for m in range(len(own) - 1):
                    near = np.flatnonzero(similarity(own[m + 1:], own[m]) >= least)
                    i.append(np.full(len(near), cut[k] + m))
                    j.append(cut[k] + m + 1 + near)
            yield _forest(ids, np.concatenate(i), np.concatenate(j))
    return link


def _forest(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """Links from every member to the first of its part."""
    root = roots(i, j, len(ids))
    own = np.flatnonzero(root != np.arange(len(ids)))
    return pa.RecordBatch.from_arrays([pa.array(ids[root[own]]), pa.array(ids[own])], ["a", "b"])


def _sets_link(percent: int):
    """Within each cell, connect members whose full sets are similar enough."""
    def link(batches):
        for rows in whole_groups(batches, ["key", "cell"]):
            ids = rows["id"].to_numpy()
            cut = edges_of(rows["key"].to_numpy(), rows["cell"].to_numpy())
            sets = [np.frombuffer(s, U) for s in rows["shingles"].to_pylist()]
            i, j = [], []
            for a, b in zip(cut[:-1], cut[1:]):
                for x, y in _similar(sets[a:b], percent):
                    i.append(a + x)
                    j.append(a + y)
            yield _forest(ids, np.array(i, np.int64), np.array(j, np.int64))
    return link


def _similar(sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= percent * union, exactly."""
    n = len(sets)
    if n <= 8:
        for x in range(n):
            for y in range(x + 1, n):
                small, large = sorted((len(sets[x]), len(sets[y])))
                if 100 * small >= percent * large:  # else not even containment is enough
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (small + large - both):
                        yield x, y
        return
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, column, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = uses[column] > 1
    owner, column = owner[shared], column[shared]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)  # counts stay far below 2**24 a step
    total = np.zeros((n, n), np.int64)
    step = max(256, (1 << 23) // n)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((n, step), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        np.matmul(part, part.T, out=both)
        total += both.astype(np.int64)
    x, y = np.nonzero(np.triu(100 * total >= percent * (sizes[:, None] + sizes - total), 1))
    yield from zip(x.tolist(), y.tolist())


def _sets(width: int):
    """The text column becomes the row's shingles, as sorted 64-bit keys."""
    def sets(batches):
        for batch in batches:
            others = [c for c in batch.schema.names if c != "text"]
            for block in tx.blocks(batch):
                n = len(block.starts)
                keys, row = shingles(block, width)
                ends = (np.searchsorted(row, np.arange(n + 1)) * 8).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(batch.schema.get_field_index(c)).slice(block.first, n) for c in others),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(keys)]),
                ], [*others, "shingles"])
    return sets


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of `docs`.

    component_id is the smallest doc_id reachable over links, kept whether that
    is the row's own. Equal sets are first folded into their smallest doc_id, in
    shares whose number is the square root of that of the documents, so no task
    meets all copies of one set. Candidates come from bands of
    minima; packed low bits then estimate the similarity, and what stays
    connected forms candidate clusters, inside which full sets are compared.
    A null or blank text has an empty set. Rows without a doc_id are linked with
    nothing: component_id null, kept true. Rows that share a doc_id are one
    document, linked by any of its texts; each row is returned. A text of any
    length is read whole in one task. An empty table gives no rows.
    """
    sign = written(signed(docs, width), "signed")
    named = sign.where("doc_id is not null and n_shingles > 0")
    same = ["n_shingles", "print_a", "print_b"]
    # a set's copies are dealt out in shares; each links to the first of its share, and these to the first of all
    shares = math.isqrt(sign.count()) + 1
    dealt = named.select("doc_id", *same, F.pmod(F.xxhash64("doc_id"), F.lit(shares)).alias("share"))
    near = written(dealt.groupBy(*same, "share").agg(F.min("doc_id").alias("near")), "near")
    first = written(near.groupBy(*same).agg(F.min("near").alias("rep")), "first")
    copies = dealt.join(near, [*same, "share"]).select(F.col("near").alias("a"), F.col("doc_id").alias("b")).union(
        near.join(first, same).select(F.col("rep").alias("a"), F.col("near").alias("b"))
    )
    reps = named.join(first.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    reps = reps.dropDuplicates(["doc_id", *same])
    pairs = reps.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    pairs = written(pairs.distinct(), "bands")
    repeated = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    sketches = reps.select(F.col("doc_id").alias("id"), "sketch")
    buckets = pairs.join(repeated, "key", "left_semi").select("key", "id")
    least = percent / 100 - MARGIN
    candidates = components(linked_within(buckets, lambda m: m.join(sketches, "id"), _bands_link(least), CELL))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).where("id is not null")

    def with_sets(members: DataFrame) -> DataFrame:
        # Dealt out by id at every size; members grow with the corpus and are never broadcast.
        rows = texts.join(members.hint("shuffle_hash"), "id")
        schema = ", ".join(f"{c} {t}" for c, t in rows.drop("text").dtypes) + ", shingles binary"
        return rows.mapInArrow(_sets(width), schema)

    clusters = candidates.select(F.col("component").alias("key"), "id")
    confirmed = linked_within(clusters, with_sets, _sets_link(percent), CELL)
    links = confirmed.union(copies.where("a < b"))
    found = components(links)
    return (
        sign.select("doc_id", "n_shingles")
        .join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
            F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
        )
    )
