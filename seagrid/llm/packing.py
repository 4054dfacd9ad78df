"""Best-fit packing of tokenized documents by exact-complement hashing.

A document is its ids and one closing id 0. Documents longer than `size` are cut
into pieces of `size`; the first piece takes what is left over and may be
shorter. Sequences are planned on the histogram of piece lengths alone, which
has at most `size` entries however many pieces there are: lengths are tables
indexed by length, so single, pair and triple sums that fill a gap exactly are
looked up under the numbers still available, and one step places as many equal
sequences as those numbers allow. What has no exact complement is filled best
fit. Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seagrid.llm.pieces import Memo, pieces
from seagrid.llm.store import written

SIZE = 2048


def _byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary spells each byte: printable
    bytes stand for themselves, the others follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Encoder:
    """Little-endian unsigned 32-bit ids of texts, encoded piece by piece.

    A text that holds an added token of the file, which the library matches before
    it splits anything, is left to the library as a whole."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = dict(enumerate(_byte_letters()))
        self.memo = Memo(self._piece)

    def _piece(self, piece: str) -> bytes:
        spelled = piece.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        memo = self.memo
        return b"".join([memo[p] for p in pieces(text)])


_encoders: dict[str, Encoder] = {}


def encoder(file: str) -> Encoder:
    """One encoder per worker process."""
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


CUT = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _cut(file: str, size: int, with_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(file)
        part = TaskContext.get().partitionId()
        used = np.zeros(size + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            tokens: list[bytes] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = own.ids(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                first = n % size or size
                ends = range(first, n + 1, size)
                for k, end in enumerate(ends):
                    start = end - (first if k == 0 else size)
                    own_ids = ids[4 * start:4 * end]
                    rows.append((doc, k, start, end - start, zlib.crc32(own_ids), part, used[end - start]))
                    used[end - start] += 1
                    if with_ids:
                        tokens.append(own_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*rows)) or [[]] * len(types)
            arrays = [pa.array(c, t) for c, t in zip(columns, types)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
            if with_ids:
                flat = np.frombuffer(b"".join(tokens), "<u4").astype(np.int32)
                ends = np.cumsum([0, *(len(t) // 4 for t in tokens)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
    return cut


def _exact(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """Up to three available lengths that sum to `gap`; the largest first."""
    if gap <= 0:
        return None
    if left[gap]:
        return (gap,)
    two = _two(left, gap, gap)
    if two:
        return two
    for a in np.flatnonzero(left[:gap])[::-1]:
        if 3 * a < gap:
            break
        left[a] -= 1
        two = _two(left, gap - a, a)
        left[a] += 1
        if two:
            return (int(a), *two)
    return None


def _two(left: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths a >= b with sum `total` and a <= most; the largest a."""
    low, high = (total + 1) // 2, min(most, total - 1)
    if high < low:
        return None
    have = (left[low:high + 1] > 0) & (left[total - high:total - low + 1][::-1] > 0)
    if 2 * low == total and have.size:
        have[0] = left[low] > 1
    if not have.any():
        return None
    a = low + int(np.flatnonzero(have)[-1])
    return a, total - a


def plan(counts: np.ndarray, size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, number of such sequences) that use up `counts`, the
    number of pieces by length. Every step uses up a length or leaves fewer of
    it than the sequence needs, so there are a few steps per length at most."""
    left = counts.copy()
    out: list[tuple[tuple[int, ...], int]] = []
    for first in range(size, 0, -1):
        while left[first]:
            left[first] -= 1
            lengths = [first]
            gap = size - first
            while gap:
                rest = _exact(left, gap)
                if rest is None:
                    fits = np.flatnonzero(left[:gap + 1])
                    if not len(fits):
                        break
                    rest = (int(fits[-1]),)
                for a in rest:
                    left[a] -= 1
                lengths += rest
                gap = size - sum(lengths)
            need, uses = np.unique(lengths, return_counts=True)
            more = int((left[need] // uses).min())  # as often again
            left[need] -= more * uses
            out.append((tuple(lengths), more + 1))
    return out


def _places(counts: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """For every run of ranks of one length: its key, first sequence and offset."""
    used = np.zeros(size + 1, np.int64)
    rows, sequence = [], 0
    for lengths, n in plan(counts, size):
        offset = 0
        for a in lengths:
            rows.append((a, used[a], sequence, offset))
            used[a] += n
            offset += a
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return table[:, 0] << 44 | table[:, 1], table[:, 2], table[:, 3]


def _assign(places):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sequence, offset = places
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            own = length << 44 | rank
            at = np.searchsorted(key, own, "right") - 1
            others = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([
                *(batch.column(batch.schema.get_field_index(c)) for c in others),
                pa.array(sequence[at] + own - key[at]), pa.array(offset[at]),
            ], [*others, "sequence_id", "offset"])
    return assign


def packed(docs: DataFrame, size: int = SIZE, file: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset, and with `with_ids` the piece's ids.

    A null or empty text is the closing id alone. Every row of `docs` is packed,
    whatever its doc_id. The driver holds the histogram (`size` numbers) and the
    plan made from it; ranks are counted per task and completed by running sums
    over tasks, so a length that a third of all pieces share is no hot spot.
    A text of any length is encoded whole in one task. Pieces of equal length
    are ranked by task and order of reading, so which of them takes which of
    their places may differ between runs. Of no rows there are no pieces.
    """
    file = file or public_tokenizers.path("byte_bpe_50k.json")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = CUT + (", ids array<int>" if with_ids else "")
    cut = written(rows.mapInArrow(_cut(file, size, with_ids), schema), "pieces")
    own = written(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = np.zeros(size + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most `size` rows
        counts[r["length"]] = r["count"]
    ranked = cut.join(own, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = ranked.select(*columns, "rank")
    schema = ", ".join(f"{c} {t}" for c, t in ranked.drop("rank").dtypes) + ", sequence_id long, offset long"
    return ranked.mapInArrow(_assign(_places(counts, size)), schema)


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences themselves, each at most
    `size` ids; doc_ids names the document of each piece in order."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids")
    )
