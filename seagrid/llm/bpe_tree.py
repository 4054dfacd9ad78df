"""Byte-level BPE as a reduction over a tree.

The encodings of byte strings form a monoid: the encoding of a joined string
follows from those of its halves. A string is halved until one byte is left;
two neighbours are joined by encoding anew a window of tokens around the seam,
which grows until the tokens outside it cannot change.

Why that is exact: merges go by rank and every token encodes as itself. A
sequence of tokens is the encoding of its bytes if and only if each adjacent
pair is the encoding of that pair's bytes, because the first merge across a seam
would also happen with the two tokens at that seam alone. Inside the window and
inside either remainder all pairs hold already, so only the two pairs at the
window's ends need a look.

Decoding is the other way round: the bytes of the halves are concatenated.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.pieces import Memo, pieces
from seagrid.llm.store import plainly_named

Ids = tuple[int, ...]


class Tree:
    """Encoder and decoder for one rank file."""

    def __init__(self, file: str):
        with open(file, "rb") as lines:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.token = {b: a for a, b in self.rank.items()}
        self.known: Memo = Memo(self._halved, longest=16)
        self.window: Memo = Memo(self._merged, longest=32)
        self.stays: Memo = Memo(self._stays, longest=2)

    def encode(self, text: bytes) -> Ids:
        return self.known[text] if text else ()

    def _halved(self, text: bytes) -> Ids:
        if len(text) == 1:
            return (self.rank[text],)
        half = len(text) // 2
        return self.join(self.known[text[:half]], self.known[text[half:]])

    def join(self, left: Ids, right: Ids) -> Ids:
        """The encoding of the bytes of `left` followed by those of `right`."""
        i = j = 1
        while True:
            middle = self.window[b"".join(map(self.token.__getitem__, left[-i:] + right[:j]))]
            left_holds = i >= len(left) or self.stays[left[-i - 1], middle[0]]
            right_holds = j >= len(right) or self.stays[middle[-1], right[j]]
            if left_holds and right_holds:
                return left[:-i] + middle + right[j:]
            i, j = i if left_holds else 2 * i, j if right_holds else 2 * j

    def _stays(self, pair: tuple[int, int]) -> bool:
        return self.window[self.token[pair[0]] + self.token[pair[1]]] == pair

    def _merged(self, text: bytes) -> Ids:
        """A window from its bytes: join the adjacent pair of lowest rank, the leftmost of equals, until none is left."""
        parts = [text[k:k + 1] for k in range(len(text))]
        none = len(self.rank)
        rank = self.rank.get
        ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            if len(parts) > 64:  # all pairs of this rank in one pass; they make no pair of a lower one
                done, k = [], 0
                while k < len(parts):
                    two = k < len(ranks) and ranks[k] == best
                    done.append(parts[k] + parts[k + 1] if two else parts[k])
                    k += 1 + two
                parts = done
                ranks = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
                continue
            k = ranks.index(best)
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], none)
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], none)
        return tuple(map(self.rank.__getitem__, parts))

    def decode(self, ids: Ids) -> bytes:
        if len(ids) < 3:
            return b"".join(map(self.token.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


_trees: dict[str, Tree] = {}


def tree(file: str) -> Tree:
    """One tree per worker process."""
    if file not in _trees:
        _trees[file] = Tree(file)
    return _trees[file]


def _encode(file: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(file)
        memo = Memo(lambda piece: own.encode(piece.encode()))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            others = [c for c in batch.schema.names if c != "text"]
            ids = [[x for p in pieces(t or "") for x in memo[p]] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(ids, pa.list_(pa.int32()))],
                [*others, "ids"])
    return encode


def encoded(docs: DataFrame, file: str | None = None) -> DataFrame:
    """`docs` with `ids` (array of int) in place of text. Null and empty texts
    have no ids. All other columns and all rows stay as they are; a column `ids`
    gives way. A text of any length is encoded whole in one task; an empty table
    gives no rows."""
    file = file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [c for c in docs.drop("ids").columns if c != "text"]
    rows = plainly_named(docs.drop("ids"), "text")
    others = [f"{c} {t}" for c, t in rows.dtypes if c != "text"]
    rows = rows.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(_encode(file), ", ".join([*others, "ids array<int>"])).toDF(*names, "ids")


def _decode(file: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(file)
        for batch in batches:
            others = [c for c in batch.schema.names if c != "ids"]
            texts = [own.decode(tuple(x)) if x is not None else None for x in batch.column(batch.schema.get_field_index("ids")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(batch.schema.get_field_index(c)) for c in others), pa.array(texts, pa.binary())],
                [*others, "bytes"])
    return decode


def decoded(rows: DataFrame, file: str | None = None) -> DataFrame:
    """`rows` with `bytes` in place of `ids`; null ids give null. A column
    `bytes` gives way."""
    file = file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    names = [c for c in rows.drop("bytes").columns if c != "ids"]
    rows = plainly_named(rows.drop("bytes"), "ids")
    others = [f"{c} {t}" for c, t in rows.dtypes if c != "ids"]
    return rows.mapInArrow(_decode(file), ", ".join([*others, "bytes binary"])).toDF(*names, "bytes")


def _digest(file: str):
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tree(file)

        def work(piece: str) -> tuple[int, str, bytes]:
            ids = own.encode(piece.encode())
            return len(ids), " ".join(map(str, ids)), own.decode(ids)

        memo = Memo(work, most=200_000)
        for batch in batches:
            count, ids, back = [], [], []
            for text in batch.column(1):
                found = [memo[p] for p in pieces(text.as_py() or "")]
                count.append(sum(f[0] for f in found))
                ids.append(hashlib.sha256(" ".join([f[1] for f in found]).encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([f[2] for f in found])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), tx.strings(ids), tx.strings(back)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return digest


def digests(docs: DataFrame, file: str | None = None) -> DataFrame:
    """Per row the number of ids, and SHA-256 of the decimal ids joined by one
    space and of the bytes decoded from them."""
    file = file or public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_digest(file), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
