"""Cross-entropy difference of two matched language models.

The target model is counted on the documents of a chosen set, the background
model on all documents. Both are bigram models over one vocabulary, all words of
the whole corpus (a word outside it is unknown), with the same interpolation, and
the background counts are scaled to the target's number of tokens, so smoothing
weighs alike. A document's score is the mean over its tokens of the difference
of the two losses: the higher, the likelier the document is under the target.

A word is frequent if it makes up one in FREQUENT tokens or more, so there are at
most FREQUENT of them, and every task gets their counts. Pairs of the most
frequent ones are counted in one square. All other tokens are dealt out with
their history, those of a rare word by the word and those of a frequent word by
both, so a task has all there is to count of its words and pairs. It sums their
losses per document; the sums go back to the block of texts they came from.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import dropped, edges_of, whole_groups, written

U = np.uint64
#: A frequent word is one in so many tokens or more.
FREQUENT = 1 << 19
#: The most frequent words, whose pairs are counted in one square.
WORDS = 1024
#: Tokens that a task holds together, on average, and slices in which it counts them.
SHARE = 1 << 21
SLICES = 8
#: Tasks that parts are dealt to, at most.
TASKS = 1 << 15
#: Weight, in tokens, of the lower order in a smoothed estimate.
BACK = 16.0
#: What is known of a document: counted in the target, counted, to be scored.
TARGET, COUNTED, ASKED = 1, 2, 4


class Frequent(NamedTuple):
    """Sorted keys of the frequent words. `inner` has the place in the square of each and
    of any other word, which is `size` outside the square. The index of a rare word is
    len(keys), the history of a first word len(keys) + 1; in the square `size` + 1."""

    keys: np.ndarray
    inner: np.ndarray
    size: int

    def cells(self, history: np.ndarray, word: np.ndarray) -> np.ndarray:
        first = history > len(self.keys)
        return np.where(first, self.size + 1, self.inner[np.where(first, 0, history)]) * (self.size + 1) + self.inner[word]


class Corpus(NamedTuple):
    """Models over all words: the counted rows (uid, doc_id, text, flags) of `docs`, the
    frequent words, in the target and the background the counts of the square's pairs, of
    words and of histories, the number of words and one unknown, and what the counts of
    the two models are multiplied with."""

    docs: DataFrame
    rows: DataFrame
    frequent: Frequent
    square: np.ndarray
    words: np.ndarray
    histories: np.ndarray
    classes: int
    scales: tuple[float, float]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([h[1] for h in held]), len(keys)).astype(np.int64)

    for batch in batches:
        for block in tx.blocks(batch):
            found = tx.words(block)
            held.append(np.unique(tx.word_keys(block.data, found), return_counts=True))
            if len(held) == 16:
                held[:] = [merged()]
        if held and len(held[0][0]) > 1 << 21:  # bounds what a task holds
            keys, n = merged()
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])
    if held:
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of all words of all documents."""
    counts = docs.select(F.col("text").cast("string")).mapInArrow(_count_words, "key long, n long")
    return counts.groupBy("key").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, tokens: int) -> Frequent:
    """The words that make up one in FREQUENT of `tokens` or more, and the WORDS most
    frequent of them; of equally frequent ones those with smaller keys."""
    got = counts.where(F.col("n") * FREQUENT >= tokens).toArrow()
    signed, n = got["key"].to_numpy(), got["n"].to_numpy()
    top = np.lexsort((signed, -n))[:WORDS]
    keys = np.sort(signed.view(U))
    inner = np.full(len(keys) + 1, len(top))
    inner[np.searchsorted(keys, np.sort(signed[top].view(U)))] = np.arange(len(top))
    return Frequent(keys, inner, len(top))


def _known(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Where each word is in `keys`, or len(keys)."""
    if not len(keys):
        return np.zeros(len(own), int)
    at = np.searchsorted(keys, own)
    return np.where((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == own), at, len(keys))


class _Tokens(NamedTuple):
    """Words of a block in order: row, key, index, index of the history, whether it is the last of its row."""

    row: np.ndarray
    own: np.ndarray
    word: np.ndarray
    history: np.ndarray
    last: np.ndarray


def _tokens(keys: np.ndarray, block: tx.Block) -> _Tokens:
    found = tx.words(block)
    own = tx.word_keys(block.data, found)
    word = _known(keys, own)
    last = np.append(found.row[1:] != found.row[:-1], True)[:len(word)]
    history = np.append(np.int64(0), word[:-1])[:len(word)]
    history[np.append(True, last[:-1])[:len(word)]] = len(keys) + 1
    return _Tokens(found.row, own, word, history, last)


def _count_pairs(frequent: Frequent):
    """Counts by cell of the square, then of frequent words, then of frequent histories."""
    square, n = (frequent.size + 2) * (frequent.size + 1), len(frequent.keys)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, square + 2 * n), np.int64)
        for batch in batches:
            wanted = tx.plain(batch, "wanted")
            for block in tx.blocks(batch):
                t = _tokens(frequent.keys, block)
                cell, mine = frequent.cells(t.history, t.word), wanted[block.first + t.row]
                for m, on in ((1, np.ones(len(mine), bool)), (0, mine)):
                    total[m, :square] += np.bincount(cell[on], minlength=square)
                    total[m, square:square + n] += np.bincount(t.word[on], minlength=n + 1)[:n]
                    total[m, square + n:] += np.bincount(t.word[on & ~t.last], minlength=n + 1)[:n]
        at = np.flatnonzero(total[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], ["cell", "target", "background"])
    return count


def _with_target(docs: DataFrame, target: DataFrame) -> DataFrame:
    wanted = target.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct()
    wanted = wanted.withColumn("wanted", F.lit(True)).hint("shuffle_hash")
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string"))
    return rows.join(wanted, "_id", "left").withColumn("wanted", F.coalesce("wanted", F.lit(False)))


def fit(docs: DataFrame, target: DataFrame) -> Corpus:
    """Both models, counted over all of `docs`; `target` has the doc_id of the
    documents wanted. Every word is one of the vocabulary. The driver gets the counts
    of at most FREQUENT words and of the pairs of WORDS of them. Texts of any length
    count whole; of equally frequent words at the square's edge those with smaller
    keys are in it, which changes where pairs are counted and no loss. Without
    documents all counts are 0."""
    counts = written(word_counts(docs), "words")
    known = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequent = frequent_words(counts, known[1])
    dropped(counts)
    rows = _with_target(docs, target)
    rows = written(rows.select("uid", F.col("_id").alias("doc_id"), "text", "wanted"), "texts")
    counted = rows.select("text", "wanted").mapInArrow(_count_pairs(frequent), "cell long, target long, background long")
    got = counted.groupBy("cell").agg(F.sum("target").alias("target"), F.sum("background").alias("background")).toArrow()
    square, n = (frequent.size + 2) * (frequent.size + 1), len(frequent.keys)
    found = np.zeros((2, square + 2 * n))
    for m, name in enumerate(("target", "background")):
        found[m, got["cell"].to_numpy()] = got[name].to_numpy()
    pairs = found[:, :square].reshape(2, frequent.size + 2, frequent.size + 1)
    tokens = pairs.sum((1, 2))
    scale = tokens[0] / tokens[1] if tokens[1] else 0.0
    rows = rows.select("uid", "doc_id", "text", F.when(F.col("wanted"), TARGET | COUNTED).otherwise(COUNTED).alias("flags"))
    return Corpus(docs, rows, frequent, pairs, found[:, square:square + n], found[:, square + n:], known[0] + 1, (1.0, scale))


class _Terms:
    """The parts of both losses: a token's loss is that of its pair under its word's
    lower order, and the weight of its history."""

    def __init__(self, corpus: Corpus):
        self.scales, self.classes, self.words = corpus.scales, corpus.classes, corpus.words
        self.tokens = corpus.square.sum((1, 2))
        firsts = corpus.square[:, -1].sum(1)
        #: Of frequent words, of none, and of what stands before a first word.
        self.histories = np.column_stack([corpus.histories, np.zeros(2), firsts])
        inside, heads = corpus.square.sum(1), corpus.square.sum(2)
        self.square = [(self.pair(m, corpus.square[m], inside[m]) + self.history(m, heads[m])[:, None]).ravel() for m in (0, 1)]

    def pair(self, model: int, n: np.ndarray, of_word: np.ndarray) -> np.ndarray:
        scale = self.scales[model]
        lower = (of_word * scale + BACK / self.classes) / (self.tokens[model] * scale + BACK)
        return -np.log(n * scale + BACK * lower)

    def history(self, model: int, n: np.ndarray) -> np.ndarray:
        return np.log(n * self.scales[model] + BACK)


def _narrow(values: np.ndarray, below: int) -> bytes:
    """Numbers less than `below` in as few bytes as hold them all."""
    return values.astype(np.uint16 if below <= 1 << 16 else np.uint32).tobytes()


def _wide(values: bytes, n: int) -> np.ndarray:
    """What `_narrow` made of n numbers."""
    return np.frombuffer(values, f"u{len(values) // max(1, n)}", n).astype(np.int64) if n else np.zeros(0, np.int64)


#: What comes back: rows of the block, and their sums of losses in single precision. The block's own row has them of all
#: rows, and ids, whether they are null, whether they are to be scored, and numbers of tokens.
SUMS = "block long, row binary, target binary, background binary, id binary, none binary, asked binary, n binary"
#: What a block sends to a part: runs of equal words (index, keys of rare ones, lengths), and of every
#: token its history (index, keys of rare ones), its row in the block, and three bits. Its own row goes to any part.
SENT = SUMS + ", part long, word binary, word_key binary, run binary, before binary, before_key binary, bits binary"


def _batch(rows: list[list], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds[k]) for v, (_, k) in zip(zip(*rows), columns)], [c for c, _ in columns])


def _spread(corpus: Corpus, terms: _Terms, parts: int):
    """The tokens of every block by part, and what a block knows by itself as one row without `bits`."""
    frequent, rare = corpus.frequent, len(corpus.frequent.keys)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, flags = tx.plain(batch, "uid"), tx.plain(batch, "flags")
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            none, ids = ids.is_null().to_numpy(False), ids.fill_null(0).to_numpy()
            for block in tx.blocks(batch):
                rows, name = len(block.starts), int(uid[block.first])
                here = slice(block.first, block.first + rows)
                t = _tokens(frequent.keys, block)
                first = t.history > rare
                square = (frequent.inner[t.word] < frequent.size) & (first | (frequent.inner[np.where(first, 0, t.history)] < frequent.size))
                cell = frequent.cells(t.history, t.word)
                known = ~square & (t.history != rare)
                sums = [
                    np.bincount(t.row[square], terms.square[m][cell[square]], rows)
                    + np.bincount(t.row[known], terms.history(m, terms.histories[m][t.history[known]]), rows) for m in (0, 1)
                ]
                asked, n = (flags[here] & ASKED) > 0, np.bincount(t.row, minlength=rows)
                own = [np.arange(rows, dtype=np.uint32), *(x.astype(np.float32) for x in sums), ids[here].astype(np.int64), none[here], asked, n.astype(np.int64)]
                sent = [[name, *(np.ascontiguousarray(x).tobytes() for x in own), name % parts, *[None] * 6]]
                at = np.flatnonzero(~square)
                before = np.append(U(0), t.own[:-1])[:len(t.own)]
                before[first] = 0
                spot = np.where(t.word == rare, t.own, tx.mixed(t.own + tx.mixed(before)))
                part = (spot[at] % U(parts)).astype(np.int64)
                order = np.lexsort((t.own[at], part))
                at, part = at[order], part[order]
                cut = edges_of(part)
                for a, b in zip(cut[:-1], cut[1:]):
                    mine = at[a:b]
                    run = edges_of(t.own[mine])
                    head = mine[run[:-1]]
                    mark = flags[block.first + t.row[mine]]
                    sent.append([
                        name, _narrow(t.row[mine], rows), *[None] * 6, int(part[a]),
                        _narrow(t.word[head], rare + 2), t.own[head[t.word[head] == rare]].tobytes(), _narrow(np.diff(run), b - a + 1),
                        _narrow(t.history[mine], rare + 2), before[mine[t.history[mine] == rare]].tobytes(),
                        np.packbits([(mark & TARGET) > 0, (mark & COUNTED) > 0, t.last[mine]]).tobytes(),
                    ])
                yield _batch(sent, SENT)
    return spread


def _keyed(keys: np.ndarray, index: np.ndarray, rare: bytes) -> np.ndarray:
    """Word keys from indices; a first word's history has the key 0."""
    out = np.append(keys, np.zeros(2, U))[index]
    out[index == len(keys)] = np.frombuffer(rare, U)
    return out


def _gather(corpus: Corpus, terms: _Terms):
    """Losses of the tokens of a part, by block and row; input sorted by part."""
    keys = corpus.frequent.keys
    own = [c.split()[0] for c in SUMS.split(", ")]

    def add(word, before, run, mark, loss: list[np.ndarray]) -> None:
        """Add the losses of all tokens of some words, of which `run` is the document."""
        order = np.lexsort((before, word))
        word, before, run, mark = word[order], before[order], run[order], mark[:, order]
        pair, group = edges_of(word, before), edges_of(word)
        of_pair, of_group = (np.repeat(np.arange(len(c) - 1), np.diff(c)) for c in (pair, group))
        index = _known(keys, word[group[:-1]])
        rare, follows = index == len(keys), ~mark[2]
        for m in (0, 1):
            counted = mark[m].astype(np.int64)
            n = np.add.reduceat(counted, group[:-1]).astype(float)
            n[~rare] = terms.words[m][index[~rare]]
            each = terms.pair(m, np.add.reduceat(counted, pair[:-1]), n[of_group[pair[:-1]]])[of_pair]
            weight = terms.history(m, np.add.reduceat(counted * follows, group[:-1]))[of_group]
            loss[m] += np.bincount(run, each + np.where(rare[of_group] & follows, weight, 0.0), len(loss[m]))

    def read(m: dict) -> tuple[np.ndarray, ...]:
        """Word, history, row and bits of the tokens of a message."""
        n_runs = len(m["word"]) // (2 if len(keys) + 2 <= 1 << 16 else 4)
        run = _wide(m["run"], n_runs)
        n = int(run.sum())
        word = np.repeat(_keyed(keys, _wide(m["word"], n_runs), m["word_key"]), run)
        before = _keyed(keys, _wide(m["before"], n), m["before_key"])
        bits = np.unpackbits(np.frombuffer(m["bits"], np.uint8), count=3 * n).reshape(3, n).astype(bool)
        return word, before, _wide(m["row"], n), bits

    def losses(sent: list[dict]) -> Iterator[list]:
        tokens = [read(m) for m in sent]
        found = [np.unique(t[2], return_inverse=True) for t in tokens]
        cut = np.cumsum([0, *(len(f[0]) for f in found)])
        word, before = (np.concatenate([t[k] for t in tokens]) for k in (0, 1))
        mark = np.concatenate([t[3] for t in tokens], axis=1)
        run = np.concatenate([f[1] + c for f, c in zip(found, cut)])
        del tokens
        loss = [np.zeros(cut[-1]), np.zeros(cut[-1])]
        slices = (word >> U(32)).astype(np.uint32) % SLICES
        for k in range(SLICES):
            at = np.flatnonzero(slices == k)
            if len(at):
                add(word[at], before[at], run[at], mark[:, at], loss)
        for m, f, a, b in zip(sent, found, cut[:-1], cut[1:]):
            yield [m["block"], _narrow(f[0], 1 + int(f[0][-1])), *(x[a:b].astype(np.float32).tobytes() for x in loss), None, None, None, None]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["part"]):
            for p in np.unique(rows["part"].to_numpy()):
                mine = rows.take(np.flatnonzero(rows["part"].to_numpy() == p)).to_pylist()
                out = [[m[c] for c in own] for m in mine if m["bits"] is None]
                sent = [m for m in mine if m["bits"] is not None]
                if sent:
                    out.extend(losses(sent))
                yield _batch(out, SUMS)
    return gather


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean losses of the rows asked for from all sums of a block; input sorted by block."""
    for rows in whole_groups(batches, ["block"]):
        blocks: dict[int, list[dict]] = {}
        for m in rows.to_pylist():
            blocks.setdefault(m["block"], []).append(m)
        for sums in blocks.values():
            own = next(m for m in sums if m["id"] is not None)
            n = np.frombuffer(own["n"], np.int64)
            loss = np.zeros((2, len(n)))
            for m in sums:
                row = _wide(m["row"], len(m["target"]) // 4)
                for k, c in enumerate(("target", "background")):
                    loss[k, row] += np.frombuffer(m[c], np.float32)  # a row occurs once in a message
            loss /= np.maximum(n, 1)
            asked, none = (np.frombuffer(own[c], bool) for c in ("asked", "none"))
            ids = pa.array(np.frombuffer(own["id"], np.int64)[asked], mask=none[asked])
            loss = loss[:, asked]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n[asked]), pa.array(loss[0]), pa.array(loss[1]), pa.array(loss[1] - loss[0])],
                ["doc_id", "n_tokens", "target_loss", "background_loss", "score"])


def scored(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, score) for every row of
    `docs`. Null and empty texts have no tokens, losses 0 and score 0. Rows are
    scored one by one, with or without a doc_id, repeated or not, and texts of any
    length whole; of no rows there are no scores. The documents that `fit` was given
    are read once for counts and scores, others beside them."""
    rows = corpus.rows
    if docs is corpus.docs:
        rows = rows.withColumn("flags", F.col("flags").bitwiseOR(F.lit(ASKED)))
    else:
        new = docs.select(
            (-1 - F.monotonically_increasing_id()).alias("uid"), F.col("doc_id").cast("long"), F.col("text").cast("string"), F.lit(ASKED).alias("flags"))
        rows = rows.unionByName(written(new, "texts"))
    terms = _Terms(corpus)
    parts = max(12, -int(-terms.tokens[1] // SHARE))
    sent = rows.select("uid", "doc_id", "text", "flags").mapInArrow(_spread(corpus, terms, parts), SENT)
    tasks = min(parts, TASKS)
    dealt = sent.repartitionById(tasks, (F.col("part") % tasks).cast("int")).sortWithinPartitions("part")
    sums = dealt.mapInArrow(_gather(corpus, terms), SUMS)
    return sums.repartition("block").sortWithinPartitions("block").mapInArrow(
        _finish, "doc_id long, n_tokens long, target_loss double, background_loss double, score double")
