"""Tables that cut lineage, and rows dealt out to tasks of bounded size."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seagrid.session import shared_folder


def written(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared checkpoint folder and read it from there.

    Whatever reads the result neither runs the upstream again nor loses it with
    an executor.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    spark = df.sparkSession
    folder = shared_folder(spark).rstrip("/")
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(parent)
        if parent.split(":")[-1].lstrip("/").startswith(folder.split(":")[-1].lstrip("/")):
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plainly_named(docs: DataFrame, *own: str) -> DataFrame:
    """`docs` with every column but `own` renamed by its position, so that no
    column an operator adds on the way can clash with it."""
    return docs.toDF(*(c if c in own else f"c{k}" for k, c in enumerate(docs.columns)))


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut sorted batches so that all rows of a key come together; what is held
    back is one batch and the rows of one key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = batch.num_rows - 1
        here = [batch.column(batch.schema.get_field_index(k)) for k in keys]
        same = np.ones(batch.num_rows, bool)
        for values in here:
            same &= values.to_numpy(zero_copy_only=False) == values[last].as_py()
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        if cut == 0 and held and all(
            held[-1].column(batch.schema.get_field_index(k))[held[-1].num_rows - 1].as_py() == v[last].as_py()
            for k, v in zip(keys, here)
        ):
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, cut)]
        if sum(b.num_rows for b in ready):
            yield pa.Table.from_batches(ready)
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def edges_of(*columns: np.ndarray) -> np.ndarray:
    """Positions at which a run of equal rows begins, and the length at the end."""
    if not len(columns[0]):
        return np.zeros(1, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.append(np.flatnonzero(new), len(new))


def roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The lowest index reachable from each of n nodes over the links (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b): one row (id, component) for
    every id in a link, component being the smallest id reachable.

    Each round every id takes its smallest neighbour as parent, and the links
    are redrawn between parents, until none is left. All joins and aggregates
    are distributed; an id with a third of all links is one group with partial
    aggregation, and its side of the joins may be split.
    """
    links = written(_between(edges, "a", "b"), "links")
    labels = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p"))
        above = first.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parent = written(
            first.join(above, "p", "left").select(F.col("a").alias("id"), F.coalesce("pp", "p").alias("p")), "parents"
        )
        if labels is None:
            new = parent.select("id", F.col("p").alias("component"))
        else:
            up = parent.select(F.col("id").alias("component"), "p")
            new = labels.join(up, "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        new = written(new, "labels")
        of = [parent.select(F.col("id").alias(c), F.col("p").alias(f"p{c}")) for c in "ab"]
        left = written(_between(links.join(of[0], "a").join(of[1], "b"), "pa", "pb"), "links")
        for old in (links, parent, labels):
            if old is not None:
                dropped(old)
        links, labels = left, new
    if labels is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false")
    return labels


def _between(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()


def linked_within(
    members: DataFrame,
    attach: Callable[[DataFrame], DataFrame],
    link: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    size: int,
) -> DataFrame:
    """Links (a, b) that connect, within each group, the members `link` connects.

    `members` has (key, id). `attach` adds to such rows what is compared and
    keeps all other columns. `link` gets batches sorted by (key, cell) and
    returns for every cell a forest over its linked members. Groups of up to
    `size` members are one cell. Larger ones are dealt out by hash: first each
    share meets itself and the first share; then members outside the largest
    part found so far meet everyone. Two members are thus compared unless
    already known to be connected, and no cell has more than 2 * `size` or so
    members.
    """
    counts = members.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shares = F.ceil(F.col("members") / size).cast("int")
    share = F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / size)).cast("int")
    sized = members.join(counts, "key").select("key", "id", shares.alias("shares"), share.alias("share"))
    sized = written(attach(sized), "groups")
    columns = [c for c in sized.columns if c not in ("key", "shares", "share")]
    pivots = F.when((F.col("share") == 0) & (F.col("shares") > 1), F.sequence(F.lit(0), F.col("shares") - 1))
    cells = sized.select("key", *columns, F.explode(pivots.otherwise(F.array("share"))).alias("cell"))
    cells = cells.withColumn("cell", F.col("cell").cast("long"))
    found = written(_linked(cells, link), "found")
    large = sized.where("shares > 1")
    if large.isEmpty():
        return found
    labels = components(found)
    own = large.join(labels, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    own = written(own, "parts")
    parts = own.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("m")).select("key", F.col("m.part").alias("main"))
    strays = own.join(main, "key").where("part != main")
    left = strays.groupBy("key").agg(F.ceil(F.count("*") / size).cast("int").alias("stray_shares"))
    everyone = own.join(left, "key").select(
        "key", *columns, "share", F.explode(F.sequence(F.lit(0), F.col("stray_shares") - 1)).alias("at")
    )
    strays = strays.join(left, "key").select(
        "key", *columns, F.pmod(F.xxhash64("id", F.lit(1)), F.col("stray_shares")).cast("int").alias("at"),
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
    )
    cell = F.col("at").cast("long") * (1 << 31) + F.col("share")
    again = everyone.unionByName(strays).select("key", *columns, cell.alias("cell")).distinct()
    return found.union(written(_linked(again, link), "found"))


def _linked(cells: DataFrame, link) -> DataFrame:
    dealt = cells.repartition("key", "cell").sortWithinPartitions("key", "cell", "id")
    return dealt.mapInArrow(link, "a long, b long").distinct()
