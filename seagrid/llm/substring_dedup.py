"""Repeated passages across documents by seed and extend.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A window is `length` consecutive words
of one document. A word is removed when a window that covers it has a word
sequence that also starts earlier: in a smaller doc_id, or earlier in the same
document. What remains of several copies of a passage is thus its first.

Seeds are winnowed: of all runs of SEED words in a window, the one with the
smallest key (the leftmost of equals) is the window's anchor. Equal windows have
equal anchors at equal places, so documents need only be joined on anchors, and
windows of an anchor that occurs once in the corpus need not move at all.
Around each anchor the match is extended both ways: an anchor carries a
fingerprint of every window it stands for, from the one that ends with it to the
one that begins with it, and the joined occurrences agree on a stretch of them.
Stretches that touch are merged into maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import edges_of, plainly_named

U = np.uint64
SEED = 8
#: Bytes of a window's fingerprint; the anchor's 64 bits come on top.
PRINT = 8
#: A task that joins the occurrences of an anchor holds no more of them; beyond,
#: windows are compared by key, in sorted order, and none is held.
LIMIT = 1 << 14


def anchors(keys: np.ndarray, row: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """All windows (first word, fingerprint) and the anchor of each (first word, key)."""
    seeds = min(SEED, length)
    at, window = tx.runs(keys, row, length)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, window, none, window
    begin, seed = tx.runs(keys, row, seeds)
    by_word = np.zeros(len(keys), U)
    by_word[begin] = seed
    best, where = by_word[at], at.copy()
    for k in range(1, length - seeds + 1):
        here = by_word[at + k]
        less = here < best
        best[less] = here[less]
        where[less] = at[less] + k
    return at, window, where, best


def _repeats(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which windows equal one that starts earlier; they come in order of document and start."""
    order = np.lexsort((window, anchor))  # stable, so the first of equals is the earliest
    cut = edges_of(anchor[order], window[order])
    first = order[np.repeat(cut[:-1], np.diff(cut))]
    again = np.empty(len(order), bool)
    again[order] = (doc[order] != doc[first]) | (start[order] != start[first])
    return again


def _stretches(doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """Windows merged into stretches [start, end) of words of a document."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(first) else first
    return [doc[first], start[first], start[last] + length]


FOUND = "key long, anchor long, doc_id long, known boolean"
SEEDS = "anchor long, doc_id long, place int, first int, prints binary"
PARTS = "key long, window long, doc_id long, start int, end int, alone boolean"


def _find(length: int):
    """Anchors of all documents. One that occurs twice in a block is known to repeat and
    its documents go anywhere, but for the first, which others may still need; of the
    rest each goes to its key. So however hot an anchor is, a block sends it once."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = tx.plain(batch, "_at")
            for block in tx.blocks(batch):
                found = tx.words(block)
                at, _, where, anchor = anchors(tx.word_keys(block.data, found), found.row, length)
                if not len(at):
                    continue
                _, one = np.unique(where, return_index=True)  # occurrences
                anchor, doc = anchor[one], docs[block.first + found.row[at[one]]]
                order = np.lexsort((doc, anchor))
                anchor, doc = anchor[order], doc[order]
                cut = edges_of(anchor)
                size = np.diff(cut)
                known = np.repeat(size > 1, size)
                first = np.zeros(len(doc), bool)
                first[cut[:-1]] = True
                new = np.ones(len(doc), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
                key = np.where(known & ~first, tx.mixed(anchor + tx.mixed(doc.astype(U))), anchor)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[new].view(np.int64)), pa.array(anchor[new].view(np.int64)), pa.array(doc[new]), pa.array(known[new])],
                    ["key", "anchor", "doc_id", "known"])
    return find


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows known to repeat or with another row of their key; sorted by key. Holds one row."""
    held, matched = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = tx.plain(batch, "key")
        keep = np.array(batch.column(3).to_numpy(zero_copy_only=False), bool)
        same = key[1:] == key[:-1]
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= matched
        rows = batch.select(["doc_id", "anchor"])
        yield rows.slice(0, len(key) - 1).filter(pa.array(keep[:-1]))
        held, matched = batch.slice(len(key) - 1), bool(keep[-1])
    if held is not None and matched:
        yield held.select(["doc_id", "anchor"])


def _seed(length: int):
    """The anchors listed for each document, each with the fingerprints of consecutive
    windows; `first` is where the first of these starts, relative to the anchor.

    Windows that repeat an earlier one of the same block of documents are found
    at once and leave as a stretch (prints null, words [place, first)): however
    hot a passage is, a block sends each of its windows once."""
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("_listed"))
            batch = batch.select(["_at", "text", "_listed"]).filter(lists.is_valid())
            docs = tx.plain(batch, "_at")
            lists = batch.column(2)
            owner = np.repeat(docs, pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)) if len(docs) else docs
            listed = np.unique(tx.mixed(lists.flatten().to_numpy().view(U) + tx.mixed(owner.astype(U))))
            for block in tx.blocks(batch):
                found = tx.words(block)
                at, window, where, anchor = anchors(tx.word_keys(block.data, found), found.row, length)
                if not len(at):
                    continue
                row = found.row[at]
                doc = docs[block.first + row]
                mine = tx.mixed(anchor + tx.mixed(doc.astype(U)))
                here = np.minimum(np.searchsorted(listed, mine), len(listed) - 1)
                mine = listed[here] == mine
                opens = np.searchsorted(found.row, np.arange(len(block.starts)))[row[mine]]
                doc, start, place, window, anchor = doc[mine], at[mine] - opens, where[mine] - opens, window[mine], anchor[mine]
                if (doc[1:] < doc[:-1]).any():
                    order = np.lexsort((start, doc))
                    doc, start, place = doc[order], start[order], place[order]
                    window, anchor = window[order], anchor[order]
                again = _repeats(anchor, window, doc, start)
                gone = _stretches(doc[again], start[again], length)
                new = ~again
                doc, start, place, window, anchor = doc[new], start[new], place[new], window[new], anchor[new]
                cut = edges_of(doc, place, start - np.arange(len(start)), anchor)
                begin = cut[:-1]
                prints = pa.Array.from_buffers(
                    pa.binary(), len(begin), [None, pa.py_buffer((cut * PRINT).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(window))])
                some = tx.mixed(gone[0].astype(U) + tx.mixed(gone[1].astype(U)))  # deals them out
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([anchor[begin], some]).view(np.int64)),
                    pa.array(np.concatenate([doc[begin], gone[0]])),
                    pa.array(np.concatenate([place[begin], gone[1]]).astype(np.int32)),
                    pa.array(np.concatenate([start[begin] - place[begin], gone[2]]).astype(np.int32)),
                    pa.concat_arrays([prints, pa.nulls(len(some), pa.binary())]),
                ], ["anchor", "doc_id", "place", "first", "prints"])
    return seed


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Table, bool]]:
    """Rows sorted by anchor, all of an anchor together (True); an anchor with more than
    `most` rows comes in pieces (False). What is held back is one batch and `most` rows."""
    held: list[pa.RecordBatch] = []
    holds, large = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = tx.plain(batch, "anchor")
        if large is not None:
            more = int(np.searchsorted(key, large, "right"))
            if more:
                yield pa.Table.from_batches([batch.slice(0, more)]), False
            batch, key = batch.slice(more), key[more:]
            if not len(key):
                continue
            large = None
        last, mine = int(np.searchsorted(key, key[-1], "left")), 0
        if held and holds == key[0]:
            mine = int(np.searchsorted(key, key[0], "right"))
            held.append(batch.slice(0, mine))
        if mine < len(key):
            if held:
                yield pa.Table.from_batches(held), True
            if last > mine:
                yield pa.Table.from_batches([batch.slice(mine, last - mine)]), True
            held = [batch.slice(last)]
        holds = key[-1]
        if sum(b.num_rows for b in held) > most:
            yield pa.Table.from_batches(held), False
            held, large, holds = [], key[-1], None
    if held:
        yield pa.Table.from_batches(held), True


def _extend(length: int, most: int):
    """Compare the windows of joined anchors; rows sorted by anchor, doc_id, place. The
    windows of an anchor with more than `most` rows go on alone, under a key of anchor
    and window, so that only equal ones meet."""
    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, whole in _groups(batches, most):
            rows = rows.combine_chunks()
            prints = rows["prints"].combine_chunks()
            ready = np.asarray(prints.is_null())
            anchor = rows["anchor"].to_numpy()
            doc, place, first = (rows[c].to_numpy().astype(np.int64) for c in ("doc_id", "place", "first"))
            size = np.diff(edges_of(anchor))
            joined = np.flatnonzero(~ready & (np.repeat(size > 1, size) if whole else True))
            taken = prints.take(pa.array(joined))
            _, offsets, raw = taken.buffers()
            ends = np.frombuffer(offsets, np.int32, len(joined) + 1, taken.offset * 4).astype(np.int64)
            n = int(ends[-1] - ends[0]) // PRINT
            window = np.frombuffer(raw, np.uint8)[ends[0]:ends[-1]].copy().view(U) if n else np.zeros(0, U)
            count = np.diff(ends) // PRINT
            begin = np.cumsum(count) - count
            of = np.repeat(joined, count)
            start = place[of] + first[of] + np.arange(n) - np.repeat(begin, count)
            yield _parts(tx.mixed(doc[ready].astype(U) + tx.mixed(place[ready].astype(U))), np.zeros(int(ready.sum()), U), doc[ready], place[ready], first[ready], False)
            if whole:
                again = _repeats(anchor[of], window, doc[of], start)
                found = _stretches(doc[of][again], start[again], length)
                yield _parts(tx.mixed(found[0].astype(U) + tx.mixed(found[1].astype(U))), np.zeros(len(found[0]), U), *found, False)
            else:
                yield _parts(tx.mixed(anchor[of].view(U) + tx.mixed(window)), window, doc[of], start, start + length, True)
    return extend


def _parts(key, window, doc, start, end, alone: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(window.view(np.int64)), pa.array(doc), pa.array(start.astype(np.int32)),
         pa.array(end.astype(np.int32)), pa.array(np.full(len(doc), alone))],
        ["key", "window", "doc_id", "start", "end", "alone"])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches as they are, and of windows that came alone all but the first of equals;
    rows sorted by alone, key, window, doc_id, start. Holds the first of the last window seen."""
    first = None
    for batch in batches:
        key, window, doc, start, alone = (tx.plain(batch, c) for c in ("key", "window", "doc_id", "start", "alone"))
        keep = ~alone.astype(bool)
        own = np.flatnonzero(alone)
        if len(own):
            k, w, d, s = key[own], window[own], doc[own], start[own]
            new = np.ones(len(own), bool)
            new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
            new[0] = first is None or (k[0], w[0]) != first[:2]
            at = np.maximum.accumulate(np.where(new, np.arange(len(own)), -1))
            fd, fs = np.where(at < 0, first[2] if first else 0, d[at]), np.where(at < 0, first[3] if first else 0, s[at])
            keep[own] = (d != fd) | (s != fs)
            first = (k[-1], w[-1], fd[-1], fs[-1])
        yield batch.select(["doc_id", "start", "end"]).filter(pa.array(keep))


def _with(rows: DataFrame, more: DataFrame, value: str) -> DataFrame:
    """`rows` (with `_at`) and a column `value` of `more` (doc_id, value). Rows are dealt
    out by `_at` alone, so that several such joins move the texts once."""
    more = more.select(F.col("doc_id").alias("_id"), value)
    return rows.join(more.hint("shuffle_hash"), F.col("_at") == F.col("_id"), "left").drop("_id")


def repeats(rows: DataFrame, length: int) -> DataFrame:
    """(doc_id, spans): all stretches of words [start, end) of a document whose
    windows start earlier elsewhere; `rows` has (_at, text) among its columns.
    Stretches may touch or overlap.

    First only anchors move, to find those that occur twice; then windows move, of
    these anchors only.
    """
    texts = rows.select("_at", F.col("text").cast("string")).where("_at is not null")
    found = texts.mapInArrow(_find(length), FOUND).repartition("key").sortWithinPartitions("key")
    listed = found.mapInArrow(_paired, "doc_id long, anchor long").groupBy("doc_id").agg(F.collect_list("anchor").alias("_listed"))
    seeds = _with(rows, listed, "_listed").mapInArrow(_seed(length), SEEDS)
    dealt = seeds.repartition("anchor").sortWithinPartitions("anchor", "doc_id", "place")
    parts = dealt.mapInArrow(_extend(length, LIMIT), PARTS)
    dealt = parts.repartition("key", "window").sortWithinPartitions("alone", "key", "window", "doc_id", "start")
    found = dealt.mapInArrow(_settle, "doc_id long, start int, end int")
    return found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def kept_words(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those outside all spans."""
    found = text.split()
    if not len(starts):
        return len(found), found
    inside = np.zeros(len(found) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    keep = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    return len(found), [found[k] for k in keep]


def _cut(with_text: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [c for c in batch.schema.names if c not in ("text", "_spans")]
            at = batch.schema.get_field_index("_spans")
            spans = batch.column(at)
            flat = spans.flatten()
            starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            bounds = np.append(0, np.cumsum(np.nan_to_num(pc.list_value_length(spans).to_numpy(zero_copy_only=False)))).astype(np.int64)
            data, offsets = tx.column(batch, "text")
            data = data.tobytes() if len(data) else b""
            total, removed, out = [], [], []
            old = batch.column(batch.schema.get_field_index("text"))
            for k in range(batch.num_rows):
                text = data[offsets[k]:offsets[k + 1]]
                a, b = bounds[k], bounds[k + 1]
                n, kept = kept_words(text, starts[a:b], ends[a:b])
                total.append(n)
                removed.append(n - len(kept))
                if not with_text:
                    out.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                elif len(kept) < n:
                    out.append(b" ".join(kept).decode())
                else:
                    out.append(old[k].as_py())
            yield pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(c)) for c in names),
                pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()),
            ], [*names, "_words", "_removed", "_kept"])
    return cut


def without_repeats(docs: DataFrame, length: int = 20, with_text: bool = True) -> DataFrame:
    """All rows and columns of `docs` but for text, and `_words`, `_removed`
    (numbers of words) and `_kept`: the kept words joined by one space, or the
    text as it was if nothing is removed; without `with_text` the SHA-256 of the
    kept words joined by one space.

    Null and empty texts have no words. Rows without a doc_id stay whole and
    remove nothing elsewhere. Rows that share a doc_id are read as one document:
    equal windows at the same place of them do not remove each other, and what
    is removed from one is removed at the same places of the others. Columns
    with the name of a result give way. A text of any length is read whole in one
    task. An empty table gives no rows.
    """
    results = ("_words", "_removed", "_kept")
    docs = docs.drop(*results)
    names = [c for c in docs.columns if c != "text"]
    docs = plainly_named(docs, "doc_id", "text")
    rows = docs.withColumn("_at", F.col("doc_id").cast("long"))
    spans = repeats(rows, length).withColumnRenamed("spans", "_spans")
    rows = _with(rows, spans, "_spans").drop("_at")
    others = [f"{c} {t}" for c, t in rows.dtypes if c not in ("text", "_spans")]
    cut = rows.mapInArrow(_cut(with_text), ", ".join([*others, "_words long, _removed long, _kept string"]))
    return cut.toDF(*names, *results)
