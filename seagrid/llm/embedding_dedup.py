"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are compared tile by tile. In the basis of principal components, largest
variance first, the product of two unit vectors is accumulated over leading
dimensions; what the remaining ones can add is at most the product of the two
suffix norms. A pair is given up as soon as that bound stays below the
threshold. Pairs that remain are decided by the cosine of the vectors as given,
in double precision.

The same order deals vectors out: shares are cut at medians of the leading
components, and shares whose boxes lie too far apart never meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm.store import components, dropped, roots, whole_groups, written

#: Vectors dealt to one share, and the tile compared at once.
SHARE, TILE = 8192, 1024
#: Leading components by which shares are cut and boxed.
LEAD = 8
#: Cuts of a level that are broadcast, of some 40 bytes each; more are joined.
CUTS = 1 << 15
#: Shares of the dimensions after which the bound is looked at.
STEPS = (0.25, 0.5, 1.0)
#: Room for rounding in bounds; decisions do not depend on it.
SLACK = 1e-9


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Second moments of the unit vectors of a task, by dimension."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, unit in _units(batch.column(0)):
            d = unit.shape[1]
            total[d] = total.get(d, 0) + unit.T @ unit
    for d, m in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([d] * d * d, pa.int32()), pa.array(np.arange(d * d)), pa.array(m.ravel())], ["d", "at", "sum"])


def _units(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per dimension: which vectors have it, and these scaled to length one."""
    size = np.asarray(pc.list_value_length(vectors))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    first = np.cumsum(size) - size
    for d in np.unique(size):
        own = np.flatnonzero(size == d)
        x = flat[first[own][:, None] + np.arange(d)]
        x /= np.abs(x).max(1, keepdims=True)  # keeps squares of tiny and huge values finite
        yield own, x / np.sqrt((x * x).sum(1, keepdims=True))


def bases(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Principal axes as columns, largest variance first, by dimension. The
    driver gets the second moments: the square of the dimension in numbers."""
    sums = vectors.select("embedding").mapInArrow(_sums, "d int, at long, sum double")
    got = sums.groupBy("d", "at").agg(F.sum("sum").alias("sum")).toArrow().to_pandas()
    out = {}
    for d, own in got.groupby("d"):
        m = np.zeros(d * d)
        m[own["at"]] = own["sum"]
        out[int(d)] = np.linalg.eigh(m.reshape(d, d))[1][:, ::-1].copy()
    return out


def close_pairs(x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y with cosine >= least; px and py are the same rows
    in the basis of principal components."""
    d = x.shape[1]
    ends = sorted({max(1, int(np.ceil(d * s))) for s in STEPS})
    rest = [[np.sqrt(np.maximum((p[:, e:] ** 2).sum(1), 0)) for e in ends] for p in (px, py)]
    e = ends[0]
    bound = np.hstack([px[:, :e], rest[0][0][:, None]]) @ np.hstack([py[:, :e], rest[1][0][:, None]]).T
    i, j = np.nonzero(bound >= least - SLACK)
    done = bound[i, j] - rest[0][0][i] * rest[1][0][j]
    for k in range(1, len(ends) - 1):
        a, b = ends[k - 1], ends[k]
        done = done + np.einsum("ij,ij->i", px[i, a:b], py[j, a:b])
        stay = done + rest[0][k][i] * rest[1][k][j] >= least - SLACK
        i, j, done = i[stay], j[stay], done[stay]
    keep = np.empty(len(i), bool)
    for at in range(0, len(i), 1 << 16):
        part = slice(at, at + (1 << 16))
        keep[part] = np.einsum("ij,ij->i", x[i[part]], y[j[part]]) >= least
    return i[keep], j[keep]


def _compare(basis: dict[int, np.ndarray], least: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["a", "b"]):
            rows = rows.combine_chunks()
            cut = np.flatnonzero(np.append(True, (np.diff(rows["a"].to_numpy()) != 0) | (np.diff(rows["b"].to_numpy()) != 0)))
            for lo, hi in zip(cut, [*cut[1:], rows.num_rows]):
                yield _cell(rows.slice(lo, hi - lo), basis, least)
    return compare


def _cell(rows: pa.Table, basis: dict[int, np.ndarray], least: float) -> pa.RecordBatch:
    """Links inside one share, or between two: per vector the number of linked
    vectors, and the first vector of its connected part."""
    ids, share, copies = (rows[c].to_numpy() for c in ("id", "share", "copies"))
    inner = rows["a"][0].as_py() == rows["b"][0].as_py()
    n = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for own, unit in _units(rows["embedding"].combine_chunks()):
        turned = unit @ basis[unit.shape[1]]
        parts = [own] if inner else [own[share[own] == s] for s in (rows["a"][0].as_py(), rows["b"][0].as_py())]
        at = {k: p for p, k in enumerate(own)}
        local = [np.array([at[k] for k in p], int) for p in parts]
        for s in range(0, len(local[0]), TILE):
            one = local[0][s:s + TILE]
            for t in range(s if inner else 0, len(local[-1]), TILE):
                two = local[-1][t:t + TILE]
                i, j = close_pairs(unit[one], unit[two], turned[one], turned[two], least)
                i, j = own[one[i]], own[two[j]]
                if inner and s == t:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                n += np.bincount(i, copies[j], len(n)).astype(np.int64) + np.bincount(j, copies[i], len(n)).astype(np.int64)
                root = roots(np.concatenate([i, root]), np.concatenate([j, np.arange(len(root))]), len(root))
    hit = np.flatnonzero(n)
    return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(n[hit]), pa.array(ids[root[hit]])], ["id", "n", "root"])


def _leading(basis: dict[int, np.ndarray]):
    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.zeros(batch.num_rows, np.int32)
            out = np.zeros((batch.num_rows, LEAD))
            for own, unit in _units(batch.column(1)):
                d = unit.shape[1]
                size[own], out[own, :min(d, LEAD)] = d, unit @ basis[d][:, :LEAD]
            lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, LEAD, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), lists], ["no", "d", "lead"])
    return lead


def in_boxes(first: DataFrame, basis: dict[int, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Shares of about SHARE vectors of one dimension: (no, share) for the rows
    (no, embedding), and per share (share, d, low, high), the box around its
    leading components.

    A cell of more than SHARE vectors is cut at its median along one leading
    component after another, by one aggregation over all cells a level. What
    many equal components keep together is dealt out by hash in the end.
    """
    cells = first.select("no", "embedding").mapInArrow(_leading(basis), "no long, d int, lead array<double>")
    cells = written(cells.withColumn("cell", F.lit(1).cast("long")), "cells")
    largest = cells.groupBy("d").count().agg(F.max("count")).first()[0] or 0
    for level in range(int(np.ceil(np.log2(max(1.0, largest / SHARE))))):
        along = F.col("lead")[level % LEAD]
        cut = cells.groupBy("d", "cell").agg(F.count("*").alias("n"), F.percentile_approx(along, 0.5).alias("mid")).where(F.col("n") > SHARE)
        if len(basis) << level <= CUTS:
            cut = F.broadcast(cut)
        side = F.col("cell") * 2 + (along > F.col("mid")).cast("long")
        new = cells.join(cut, ["d", "cell"], "left").withColumn("to", F.coalesce(side, "cell"))
        new = written(new.select("no", "d", "lead", F.col("to").alias("cell")), "cells")
        dropped(cells)
        cells = new
    counts = cells.groupBy("d", "cell").agg(F.ceil(F.count("*") / SHARE).alias("parts"))
    cells = cells.join(counts, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("no"), F.col("parts")))
    key = ["d", "cell", "part"]
    ends = [f(F.col("lead")[k]).alias(f"{name}{k}") for name, f in (("low", F.min), ("high", F.max)) for k in range(LEAD)]
    boxes = cells.groupBy(*key).agg(*ends).withColumn("share", F.monotonically_increasing_id())
    low, high = (F.array(*[f"{name}{k}" for k in range(LEAD)]).alias(name) for name in ("low", "high"))
    boxes = written(boxes.select(*key, "share", low, high), "boxes")
    return written(cells.join(boxes, key).select("no", "share"), "shares"), boxes.select("share", "d", "low", "high")


def meeting(boxes: DataFrame, least: float) -> DataFrame:
    """Pairs of shares (a, b), a <= b, that may hold a cosine of `least`.

    Unit vectors of that cosine are at most sqrt(2 - 2 * least) apart, and their
    leading components no more, so boxes further apart need not meet. Boxes find
    each other by stretches of the first component; only boxes move."""
    apart = 2 - 2 * least + 1e-6
    width = max(float(np.sqrt(max(apart, 0.0))), 0.05)
    a = boxes.select("d", *[F.col(c).alias(f"a_{c}") for c in ("share", "low", "high")])
    b = boxes.select("d", *[F.col(c).alias(f"b_{c}") for c in ("share", "low", "high")])
    place = lambda x: F.floor(x / width)
    a = a.withColumn("at", F.explode(F.sequence(place(F.col("a_low")[0]), place(F.col("a_high")[0]))))
    b = b.withColumn("at", F.explode(F.sequence(place(F.col("b_low")[0] - width), place(F.col("b_high")[0] + width))))
    gaps = [F.greatest(F.lit(0.0), F.col("b_low")[k] - F.col("a_high")[k], F.col("a_low")[k] - F.col("b_high")[k]) for k in range(LEAD)]
    met = a.join(b, ["d", "at"]).where("a_share <= b_share").where(sum(g * g for g in gaps) <= apart)
    return met.select(F.col("a_share").alias("a"), F.col("b_share").alias("b")).distinct()


def near_vectors(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors` (vec_id, embedding).

    Rows are linked when their cosine is at least `least`. Null or zero vectors
    and those with null, NaN or infinite components link with nothing, nor do
    vectors of different dimension with each other. Equal vectors are compared
    once and counted as often as they occur. Rows without a vec_id link with
    nothing, component_id null and kept true. Rows that share a vec_id are
    vectors of their own in n_links, and one vertex in components. An empty table
    gives no rows.

    Shares of a fixed size meet in pairs, each pair in one task; a task returns
    counts and a forest, never pairs. A vector is sent once for every share that
    its own share's box comes near enough to.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = "embedding is not null and size(embedding) > 0 and id is not null"
    finite = ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    some = rows.where(sound).where(finite & F.exists("embedding", lambda v: v != 0))
    first = some.groupBy("embedding").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    first = written(first.withColumn("no", F.monotonically_increasing_id()), "vectors")
    member = some.join(first, "embedding").select("id", "rep", "copies")
    basis = bases(first)
    share_of, boxes = in_boxes(first, basis)
    pairs = written(meeting(boxes, least), "pairs")
    sides = pairs.withColumn("share", F.col("a")).union(pairs.where("a < b").withColumn("share", F.col("b")))
    met = first.join(share_of, "no").join(sides, "share").select("a", "b", F.col("rep").alias("id"), "share", "copies", "embedding")
    met = met.repartition("a", "b").sortWithinPartitions("a", "b", "id")
    found = written(met.mapInArrow(_compare(basis, least), "id long, n long, root long"), "links")
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("n").alias("n"))
    links = found.select(F.col("root").alias("a"), F.col("id").alias("b")).union(
        member.select(F.col("rep").alias("a"), F.col("id").alias("b"))
    )
    whole = components(links)
    per_row = member.join(counts, "rep", "left").groupBy("id", "rep").agg(
        (F.first(F.coalesce("n", F.lit(0))) + F.first("copies") - 1).alias("n_links"), F.count("*").alias("times")
    )
    return _every_row(rows, per_row, whole)


def _every_row(rows: DataFrame, per_row: DataFrame, whole: DataFrame) -> DataFrame:
    """Counts of the sound vectors beside all rows; a repeated vec_id has one count per vector."""
    counts = per_row.groupBy("id").agg(F.max("n_links").alias("n_links"))
    return rows.select("id").join(counts, "id", "left").join(whole, "id", "left").select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
    )
