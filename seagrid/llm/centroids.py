"""Centroid clustering of whole-number vectors over subvector dictionaries.

Vectors are dictionary-encoded once, without loss, in chunks: a chunk cuts the
dimensions into blocks, keeps the distinct subvectors of every block and one code
per vector and block. Blocks are as wide as pays: neighbouring blocks become one
while their distinct subvectors stay below a quarter of the chunk's vectors, so
tables of copies get wide blocks and scattered ones narrow blocks.

A round works out the exact squared distance of every distinct subvector to every
centroid once, and a vector's distances are sums of those partial distances, looked
up by its codes. Sums for new centroids come from counts per code. A task returns
one row per number it adds up, so a round moves only centroids, whatever the input.
Whole numbers throughout: results do not depend on how rows are dealt out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm.store import written

SCALE = 1024
#: A block of several dimensions has at least this many vectors per distinct subvector.
SHARE = 4
#: Up to this size, squared distances of 64 components fit 64 bits.
PLAIN = 1 << 27
#: Sums travel as parts of so many bits, which add up without loss.
PART = 40
MOST = (1 << 63) - 1

CHUNK = "ids array<long>, widths array<int>, sizes array<int>, entries binary, codes binary"
NUMBERS = "cluster int, at int, part int, total long"
RESULT = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


class Block(NamedTuple):
    """Distinct subvectors of some neighbouring dimensions, and each vector's code."""

    entries: np.ndarray
    codes: np.ndarray


def blocks_of(values: np.ndarray, low: int = 0, high: int | None = None) -> list[Block]:
    """The dictionary blocks of rows of numbers, for dimensions [low, high)."""
    high = values.shape[1] if high is None else high
    if high - low == 1:
        entries, codes = np.unique(values[:, low], return_inverse=True)
        return [Block(entries[:, None], codes)]
    middle = (low + high) // 2
    left, right = blocks_of(values, low, middle), blocks_of(values, middle, high)
    if len(left) == len(right) == 1:
        n = len(right[0].entries)
        pairs, codes = np.unique(left[0].codes * n + right[0].codes, return_inverse=True)
        if len(pairs) * SHARE <= len(values) or len(pairs) == 1:
            return [Block(np.hstack([left[0].entries[pairs // n], right[0].entries[pairs % n]]), codes)]
    return left + right


def values_of(blocks: list[Block]) -> np.ndarray:
    """The rows that `blocks_of` encoded."""
    return np.hstack([b.entries[b.codes] for b in blocks])


def exact(values: np.ndarray) -> np.ndarray:
    """Whole numbers held as floats, as integers: 64 bits where their distances fit, else of any size."""
    if not values.size or np.abs(values).max() <= PLAIN:
        return values.astype(np.int64)
    return np.array([int(v) for v in values.ravel()], object).reshape(values.shape)


def distances(blocks: list[Block], centroids: list[list[int]]) -> np.ndarray:
    """Squared distances of all vectors of a chunk to all centroids."""
    ends = np.cumsum([b.entries.shape[1] for b in blocks])
    whole = [exact(b.entries) for b in blocks]
    small = all(abs(x) <= PLAIN for c in centroids for x in c) and all(e.dtype != object for e in whole)
    centres = np.array(centroids, np.int64 if small else object)
    out = 0
    for block, entries, end in zip(blocks, whole, ends):
        apart = entries[:, None, :] - centres[None, :, end - entries.shape[1]:end]
        out = out + (apart * apart).sum(2)[block.codes]
    return out


def sums(blocks: list[Block], clusters: np.ndarray, k: int) -> np.ndarray:
    """Component sums of the vectors in each of k clusters, from counts per code."""
    out = []
    for block in blocks:
        n = len(block.entries)
        counts = np.bincount(block.codes * k + clusters, minlength=n * k).reshape(n, k)
        entries = exact(block.entries)
        out.append(counts.T.astype(entries.dtype) @ entries)
    return np.hstack(out).astype(object)


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        values = pc.list_flatten(batch.column(1)).to_numpy(zero_copy_only=False).reshape(n, -1)
        blocks = blocks_of(np.floor(values * SCALE))
        kind = np.uint16 if n <= 1 << 16 else np.uint32
        row = {
            "ids": batch.column(0).to_pylist(),
            "widths": [b.entries.shape[1] for b in blocks], "sizes": [len(b.entries) for b in blocks],
            "entries": b"".join(b.entries.astype(np.float64).tobytes() for b in blocks),
            "codes": b"".join(b.codes.astype(kind).tobytes() for b in blocks),
        }
        schema = pa.schema([
            ("ids", pa.list_(pa.int64())), ("widths", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())),
            ("entries", pa.binary()), ("codes", pa.binary()),
        ])
        yield pa.RecordBatch.from_pylist([row], schema)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[Block]]]:
    """Ids and dictionary blocks of one chunk at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, widths, sizes, entries, codes = (batch.column(j)[i] for j in range(5))
            n = len(ids.values)
            kind = np.uint16 if n <= 1 << 16 else np.uint32
            entries, codes = np.frombuffer(entries.as_buffer(), np.float64), np.frombuffer(codes.as_buffer(), kind)
            blocks, at = [], 0
            for j, (width, size) in enumerate(zip(widths.as_py(), sizes.as_py())):
                blocks.append(Block(entries[at:at + width * size].reshape(size, width), codes[j * n:(j + 1) * n].astype(np.int64)))
                at += width * size
            yield ids.values, blocks


def _parts(total: int) -> Iterator[tuple[int, int]]:
    """A whole number as signed parts of PART bits, without those that are 0."""
    sign, total, k = (-1 if total < 0 else 1), abs(total), 0
    while total:
        if part := total & ((1 << PART) - 1):
            yield k, sign * part
        total, k = total >> PART, k + 1


def _totals(chunks: DataFrame, centroids: list[list[int]]) -> np.ndarray:
    """For every centroid, over the vectors nearest to it: the sum of each
    component, then their number, then their distances. One row per number
    leaves a task; the driver gets as many as centroids have components."""
    k, dims = len(centroids), len(centroids[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((k, dims + 2), object)
        for _, blocks in _chunks(batches):
            apart = distances(blocks, centroids)
            near = apart.argmin(1)
            out[:, :dims] += sums(blocks, near, k)
            out[:, dims] += np.bincount(near, minlength=k).astype(object)
            np.add.at(out[:, dims + 1], near, apart[np.arange(len(near)), near].astype(object))
        rows = [(c, at, *p) for c in range(k) for at in range(dims + 2) for p in _parts(int(out[c, at]))]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64())
        columns = [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "at", "part", "total"])

    out = np.zeros((k, dims + 2), object)
    for r in chunks.mapInArrow(add, NUMBERS).groupBy("cluster", "at", "part").agg(F.sum("total").alias("total")).collect():
        out[r.cluster, r.at] += int(r.total) << (PART * r.part) if r.total >= 0 else -(int(-r.total) << (PART * r.part))
    return out


def _assigned(chunks: DataFrame, centroids: list[list[int]]) -> DataFrame:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, blocks in _chunks(batches):
            apart = distances(blocks, centroids)
            near = apart.argmin(1)
            least = np.minimum(apart[np.arange(len(near)), near], MOST).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(least)], ["vec_id", "cluster", "distance"])

    return chunks.mapInArrow(assign, "vec_id long, cluster int, distance long")


def _whole(dims: int) -> Column:
    """Whether a vector has `dims` components, none null or non-finite (nor beyond a double when scaled)."""
    return (F.size("embedding") == dims) & F.forall("embedding", lambda x: F.abs(x * SCALE) < float("inf"))


def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> DataFrame:
    """RESULT for every row of `vectors` (vec_id, embedding) with `dims` finite components.

    Components are taken as floor(1024 * x). Centroids start as the k vectors with
    the smallest SHA-256 of `seed:vec_id` (equal ones by their components; rows
    without an id last) and move `rounds` times to the floor of their vectors' mean;
    a centroid without vectors stays. Ties go to the lower number. Fewer than k
    vectors give as many centroids; none gives no rows. Repeated rows each count.
    Components of any finite size are computed exactly; distances and their sums
    beyond a long are returned as the largest long. Other columns are not read.

    Written once: the encoded chunks, one per Arrow batch. The driver holds the
    centroids (k * dims numbers) and nothing that grows with the input.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where(_whole(dims))
    chunks = written(rows.mapInArrow(_encode, CHUNK), "chunks")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.orderBy(name.asc_nulls_last(), "embedding").limit(k).collect()
    centroids = [[int(v) for v in np.floor(np.array(r.embedding) * SCALE)] for r in first]
    if not centroids:
        return _assigned(chunks, centroids).select(
            "vec_id", "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"),
            F.lit("").alias("centroid_sha256"))
    for _ in range(rounds):
        totals = _totals(chunks, centroids)
        centroids = [[int(x) // int(t[dims]) for x in t[:dims]] if t[dims] else c for t, c in zip(totals, centroids)]
    inertias = [int(t[dims + 1]) for t in _totals(chunks, centroids)]
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def of_cluster(values: list, kind: str) -> Column:
        return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("cluster") + 1)

    return _assigned(chunks, centroids).select(
        "vec_id", "cluster", "distance", of_cluster([min(x, MOST) for x in inertias], "long").alias("cluster_inertia"),
        F.lit(min(sum(inertias), MOST)).cast("long").alias("inertia"), of_cluster(prints, "string").alias("centroid_sha256"),
    )


def oracle(k: int = 8, rounds: int = 10, seed: int = 3, dims: int = 64) -> str:
    """The same in SQL, round by round."""
    near = """
a%(r)d AS MATERIALIZED (
  SELECT n, v, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance FROM (
    SELECT n, v, c.cluster, CAST(list_sum(list_transform(list_zip(v, c.centre), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d
    FROM kept, c%(r)d AS c) GROUP BY n, v
)"""
    move = """,
c%(next)d AS MATERIALIZED (
  SELECT cluster, coalesce(new, c%(r)d.centre) AS centre FROM c%(r)d LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS new FROM (
      SELECT cluster, i, CAST((sum(x) - ((sum(x) %% count(*)) + count(*)) %% count(*)) // count(*) AS BIGINT) AS x FROM (
        SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a%(r)d)
      GROUP BY cluster, i) GROUP BY cluster) USING (cluster)
)"""
    steps = [near % {"r": r} + (move % {"r": r, "next": r + 1} if r < rounds else "") for r in range(rounds + 1)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: isfinite(x))) = {dims}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY name) - 1 AS INTEGER) AS cluster, v AS centre FROM (
    SELECT v, sha256('{seed}:' || CAST(vec_id AS VARCHAR)) AS name FROM kept ORDER BY name LIMIT {k})
), {",".join(steps)}
SELECT k.vec_id, a.cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c.centre, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN kept AS k ON k.n = a.n JOIN c{rounds} AS c ON c.cluster = a.cluster
"""
