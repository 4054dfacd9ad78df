"""Near duplicates, repeated passages and near vectors against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seagrid.llm import minhash, store
from seagrid.llm import text as tx
from seagrid.llm.embedding_dedup import close_pairs, near_vectors
from seagrid.llm.minhash import near_duplicates
from seagrid.llm.substring_dedup import without_repeats

from corpus import documents, made, nothing, odd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def parts(ids, links):
    own = {i: i for i in ids}

    def top(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        own[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def word_sets(rows, width):
    out = {}
    for i, t in rows:
        ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        out[i] = {tuple(ws[k:k + width]) for k in range(len(ws) - width + 1)} or ({tuple(ws)} if ws else set())
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    rows = made()
    sets = word_sets(rows, width)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(links) > 10
    want = parts(ids, links)
    got = {r.doc_id: r for r in near_duplicates(documents(spark, rows), width).collect()}
    assert {i: (len(sets[i]), want[i], want[i] == i) for i in ids} == {
        i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()
    }


def test_groups_above_a_cell_are_compared_in_shares(spark, monkeypatch):
    """A chain in which each text is near its neighbours only, so no star around one member finds it."""
    monkeypatch.setattr(minhash, "CELL", 4)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(24):
        rows.append((i, " ".join(words)))
        words[rng.randrange(60)] = f"n{i}"
    sets = word_sets(rows, 1)
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = parts(sets, links)
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), 1).collect()}
    assert got == want


def test_near_duplicates_of_odd_rows(spark):
    got = near_duplicates(odd(spark), 2).collect()
    assert len(got) == 16
    of = {r.doc_id: r for r in got if r.doc_id is not None}
    assert of[6].component_id == 5 and not of[6].kept and of[5].kept and of[12].component_id == 4
    assert of[1].n_shingles == of[2].n_shingles == of[8].n_shingles == 0 and of[8].component_id == 8
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)] * 2
    assert all(r.component_id == 7 for r in got if r.doc_id == 7)
    assert near_duplicates(nothing(spark), 2).collect() == []


def test_sketch_estimates(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        k = int(2000 * 2 * share / (1 + share))
        other = np.concatenate([base[:k], rng.integers(0, 2**63, 2000 - k, dtype=np.uint64)])
        low = []
        for keys in (base, other):
            m = np.array([np.min(keys * f) for f in minhash._factors()])
            bits = (tx.mixed(m) & np.uint64(15)).astype(np.uint8)
            low.append((bits[0::2] | bits[1::2] << 4).astype(np.uint8).view(np.uint64))
        assert abs(minhash.similarity(low[0][None], low[1][None])[0] - share) < minhash.MARGIN


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500, k) for k in range(501, 560)]
    want = parts({x for l in links for x in l}, links)
    got = {r.id: r.component for r in store.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: c for i, c in want.items() if any(i in l and l[0] != l[1] for l in links)}


def passages(rows, length):
    first, words = {}, {}
    for i, t in sorted(rows):
        words[i] = WORD.findall(t)
        for k in range(len(words[i]) - length + 1):
            first.setdefault(tuple(words[i][k:k + length]), (i, k))
    out = {}
    for i, ws in words.items():
        gone = {k + m for k in range(len(ws) - length + 1) if first[tuple(ws[k:k + length])] != (i, k) for m in range(length)}
        out[i] = (len(ws), len(gone), [w for k, w in enumerate(ws) if k not in gone])
    return out


@pytest.mark.parametrize("length", [5, 20, 50])
def test_repeated_passages_equal_brute_force(spark, length):
    rows = made()
    want = passages(rows, length)
    assert sum(w[1] for w in want.values()) > 100
    got = without_repeats(documents(spark, rows), length, with_text=False).collect()
    assert {r.doc_id: (r._words, r._removed, r._kept) for r in got} == {
        i: (n, m, hashlib.sha256(" ".join(ws).encode()).hexdigest()) for i, (n, m, ws) in want.items()
    }
    texts = {r.doc_id: r for r in without_repeats(documents(spark, rows), length).collect()}
    for i, t in rows:
        assert texts[i]._kept == (" ".join(want[i][2]) if want[i][1] else t) and texts[i].source == "s"


def test_windows_are_told_apart_by_all_bits_of_their_keys():
    """Windows of one anchor whose keys differ in any one byte are not equal."""
    from seagrid.llm import substring_dedup

    for byte in range(8):
        prints = [bytes(8), bytes(k == byte for k in range(8))]
        rows = [(5, doc, 0, 0, p) for doc, p in ((1, prints[0]), (2, prints[1]), (3, prints[0]))]
        names = ["anchor", "doc_id", "place", "first", "prints"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        for most in (0, 2, 3):  # joined, or each window alone
            parts = pa.Table.from_batches(list(substring_dedup._extend(20, most)(iter([batch]))))
            order = [(c, "ascending") for c in ("alone", "key", "window", "doc_id", "start")]
            got = [r for b in substring_dedup._settle(iter(parts.sort_by(order).to_batches())) for r in b.to_pylist()]
            assert got == [{"doc_id": 3, "start": 0, "end": 20}]


@pytest.mark.parametrize("limit", [0, 3])
def test_large_anchors_are_compared_window_by_window(spark, monkeypatch, limit):
    from seagrid.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "LIMIT", limit)
    test_repeated_passages_equal_brute_force(spark, 20)


def table_of(rows, **types):
    return [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types.values())], list(types)) for part in rows if part]


def cut_up(rng, rows):
    """Rows in order, in batches of any size."""
    at = sorted(rng.sample(range(len(rows) + 1), min(6, len(rows))))
    return [rows[a:b] for a, b in zip([0, *at], [*at, len(rows)])]


def test_no_task_holds_more_of_an_anchor_than_the_limit():
    from seagrid.llm import substring_dedup

    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.choices(range(6), k=rng.randrange(1, 40)))
        batches = table_of(cut_up(rng, [(k, n) for n, k in enumerate(keys)]), anchor=pa.int64(), n=pa.int64())
        most = rng.choice([0, 3, 100])
        seen, whole_keys = [], set()
        for rows, whole in substring_dedup._groups(iter(batches), most):
            own = rows["anchor"].to_pylist()
            seen += rows["n"].to_pylist()
            if whole:
                assert not whole_keys & set(own) and all(own.count(k) == keys.count(k) for k in set(own))
                whole_keys |= set(own)
            else:
                assert len(set(own)) == 1 and keys.count(own[0]) > most
        assert seen == list(range(len(keys)))


def test_anchors_pass_that_are_known_or_met_twice():
    from seagrid.llm import substring_dedup

    rng = random.Random(2)
    for _ in range(200):
        keys = sorted(rng.choices(range(12), k=rng.randrange(1, 20)))
        rows = [(k, k, n, rng.random() < 0.2) for n, k in enumerate(keys)]
        batches = table_of(cut_up(rng, rows), key=pa.int64(), anchor=pa.int64(), doc_id=pa.int64(), known=pa.bool_())
        got = [r["doc_id"] for b in substring_dedup._paired(iter(batches)) for r in b.to_pylist()]
        assert got == [n for k, _, n, known in rows if known or keys.count(k) > 1]


def test_all_but_the_first_of_equal_windows_go():
    from seagrid.llm import substring_dedup

    rng = random.Random(3)
    names = {"key": pa.int64(), "window": pa.int64(), "doc_id": pa.int64(), "start": pa.int32(), "end": pa.int32(), "alone": pa.bool_()}
    for _ in range(200):
        rows = [(rng.randrange(3), rng.randrange(2), rng.randrange(3), rng.randrange(3), 9, rng.random() < 0.8) for _ in range(rng.randrange(1, 30))]
        rows.sort(key=lambda r: (r[5], *r[:4]))
        got = [tuple(r.values()) for b in substring_dedup._settle(iter(table_of(cut_up(rng, rows), **names))) for r in b.to_pylist()]
        first = {}
        for k, w, d, s, _, alone in rows:
            if alone:
                first[k, w] = min(first.get((k, w), (d, s)), (d, s))
        assert got == [(d, s, e) for k, w, d, s, e, alone in rows if not alone or (d, s) != first[k, w]]


def test_a_passage_in_every_document_and_lines_around_it(spark, monkeypatch):
    """One window in all documents, and an anchor whose windows all differ."""
    from seagrid.llm import substring_dedup

    monkeypatch.setattr(substring_dedup, "LIMIT", 4)
    rng = random.Random(4)
    passage, line = [f"p{k}" for k in range(24)], [f"line{k}" for k in range(19)]
    rows = []
    for i in range(40):
        own = [f"a{i}w{k}" for k in range(30)]
        rows.append((i, " ".join([*own[:10], *passage, *own[10:20], *line, *own[20:], *(passage if i % 7 == 0 else [])])))
    rng.shuffle(rows)
    got = {r.doc_id: (r._words, r._removed) for r in without_repeats(documents(spark, rows, 7), 20, with_text=False).collect()}
    assert got == {i: (n, m) for i, (n, m, _) in passages(rows, 20).items()} and sum(m for _, m in got.values()) == 39 * 24 + 6 * 24


def test_texts_move_once(spark):
    """Both joins of the texts read one exchange."""
    found = without_repeats(documents(spark, made()), 20)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_repeated_passages_of_odd_rows(spark):
    got = without_repeats(odd(spark), 20).collect()
    assert len(got) == 16
    of = {}
    for r in got:
        of.setdefault(r.doc_id, []).append(r)
    assert of[6][0]._removed == 60 and of[6][0]._kept == "" and of[5][0]._removed > 0
    assert of[2][0]._kept is None and of[2][0]._words == 0 and of[12][0]._removed == of[12][0]._words
    assert all(r._removed == 0 for r in of[None] + of[7])
    assert without_repeats(nothing(spark), 20).collect() == []


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)


def test_near_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 12))
    x[100:] = x[rng.integers(0, 20, 50)] + rng.normal(size=(50, 12)) * 0.25
    x[140:] = x[0]
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    want = parts(range(150), [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if a < b])
    rows = [(k, [float(v) for v in x[k]], None) for k in range(150)]
    got = {r.vec_id: r for r in near_vectors(vectors(spark, rows)).collect()}
    assert {k: (int(near[k].sum()), want[k], want[k] == k) for k in range(150)} == {
        k: (r.n_links, r.component_id, r.kept) for k, r in got.items()
    }


def test_near_vectors_over_several_shares(spark, monkeypatch):
    from seagrid.llm import embedding_dedup

    monkeypatch.setattr(embedding_dedup, "SHARE", 16)
    monkeypatch.setattr(embedding_dedup, "TILE", 4)
    test_near_vectors_equal_brute_force(spark)


def test_shares_far_apart_do_not_meet(spark, monkeypatch):
    """Four tight bundles and a cell of equal leading components: every close pair's shares meet, others do not."""
    from seagrid.llm import embedding_dedup as ed

    monkeypatch.setattr(ed, "SHARE", 8)
    rng = np.random.default_rng(6)
    x = np.repeat(np.eye(12)[:4], 20, 0) + rng.normal(size=(80, 12)) * 0.05
    x[:20] = np.eye(12)[0] + np.pad(np.eye(10)[rng.integers(0, 10, 20)], ((0, 0), (2, 0))) * rng.normal(size=(20, 1)) * 1e-9
    rows = [(k, [float(v) for v in x[k]]) for k in range(80)]
    first = spark.createDataFrame(rows, "no long, embedding array<double>")
    share_of, boxes = ed.in_boxes(first, ed.bases(first))
    share = {r.no: r.share for r in share_of.collect()}
    met = {(r.a, r.b) for r in ed.meeting(boxes, 0.9).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = {tuple(sorted((share[i], share[j]))) for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9))}
    n = len(set(share.values()))
    assert set(share) == set(range(80)) and near <= met and all(a <= b for a, b in met)
    assert n >= 10 and len(met) < n * (n + 1) / 2
    assert ed.meeting(boxes.limit(0), 0.9).collect() == []


def test_unsound_vectors_link_with_nothing(spark):
    one = [1.0, 0.0, 0.0]
    rows = [
        (1, one, 1), (2, [2.0, 0.0, 0.0], None), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, None, 0.0], 1), (6, [math.nan, 1.0, 1.0], 1),
        (7, [math.inf, 0.0, 0.0], 1), (8, [], 1), (9, [1.0, 0.0], 1), (10, one, 1), (None, one, 1), (11, [1e-30, 0.0, 0.0], 1),
    ]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(vectors(spark, rows)).collect()}
    assert {k: got[k] for k in (1, 2, 10, 11)} == {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False)}
    assert all(got[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9)) and got[None] == (0, None, True)
    assert near_vectors(vectors(spark, [])).collect() == []


def test_suffix_norms_lose_no_pair():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 16))
    x[150:] = x[:150] + rng.normal(size=(150, 16)) * 0.3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    i, j = close_pairs(x, x, x @ turn, x @ turn, 0.9)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(k.tolist() for k in np.nonzero(x @ x.T >= 0.9))))


def test_word_keys_do_not_depend_on_place(spark):
    import pyarrow as pa

    texts = ["", "a b a", None, "ab", "  a\x0b", "b", "a"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for size in (1, 4, 1 << 20):
        seen = {}
        for block in tx.blocks(batch, size=size):
            found = tx.words(block)
            for row, s, e, key in zip(*found, tx.word_keys(block.data, found)):
                assert block.starts[row] <= s < e <= block.ends[row]
                seen.setdefault(block.data[s:e].tobytes(), []).append(key)
        assert {w: len(k) for w, k in seen.items()} == {b"a": 4, b"b": 2, b"ab": 1}
        assert all(len(set(k)) == 1 for k in seen.values()) and len({k[0] for k in seen.values()}) == 3
