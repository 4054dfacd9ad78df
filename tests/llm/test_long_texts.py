"""Texts larger than one block, and packing against the fewest sequences there can be."""

import functools
import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from seagrid.llm import bpe_tree, packing, rule_ledger, secret_scan
from seagrid.llm import text as tx
from seagrid.llm.minhash import near_duplicates
from seagrid.llm.substring_dedup import without_repeats

from corpus import documents
from test_texts import check_packing, plain_measures, plain_spans

LINE = "token = abcdef0123456789\n"


@pytest.fixture(scope="module")
def rows():
    """A text of more than two blocks, a near copy of it, and short ones around them."""
    rng = random.Random(12)
    words = [f"w{rng.randrange(60000)}é" for _ in range(300000)]
    for at in range(0, len(words), 30000):
        words[at] = LINE
    near = list(words)
    for at in range(0, len(words), 6000):
        near[at + 7] = "changed"
    out = [(1, "short one"), (2, " ".join(words)), (3, "short two"), (4, " ".join(near)), (5, "")]
    assert len(out[1][1].encode()) > 2 * tx.BLOCK
    return out


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_measures_and_secrets_of_long_texts(spark, rows):
    docs = documents(spark, rows, 2)
    measured = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rule_ledger.ledger(docs).collect()}
    want = {i: plain_measures(t) for i, t in rows}
    assert measured == {i: (*m[:3], *m[4:]) for i, m in want.items()}
    found = {r.doc_id: (r.n_assign, r.base_sha256) for r in secret_scan.digests(docs).collect()}
    spans = {i: plain_spans(t) for i, t in rows}
    assert found == {i: (sum(k == "assign" for _, _, k in s), secret_scan.digest_of(s)) for i, s in spans.items()}
    assert found[2][0] == 10


def test_tokens_of_long_texts(spark, rows):
    docs = documents(spark, rows, 2)
    tree = bpe_tree.Tree(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tree.rank, special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe_tree.digests(docs).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    check_packing(rows, packing.packed(docs).collect(), 2048)


def test_near_copies_and_repeats_of_long_texts(spark, rows):
    docs = documents(spark, rows, 2)
    sets = {}
    for i, t in rows:
        ws = plain_words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = set(zip(ws, ws[1:]))
    assert len(sets[2] & sets[4]) >= 0.8 * len(sets[2] | sets[4])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(docs, width=2, percent=80).collect()}
    assert got == {i: (len(s), 2 if i == 4 else i) for i, s in sets.items()}
    seen, gone = set(), Counter()
    for i, t in rows:
        ws = plain_words(t)
        cut = np.zeros(len(ws), bool)
        for k in range(len(ws) - 19):
            window = tuple(ws[k:k + 20])
            cut[k:k + 20] |= window in seen
            seen.add(window)
        gone[i] = int(cut.sum())
    assert {r.doc_id: r._removed for r in without_repeats(docs, 20).collect()} == dict(gone) and gone[4] > 250000


def fewest(lengths, size):
    """The least number of sequences, by trying all ways: the longest piece left meets every set that fits beside it."""
    @functools.cache
    def of(left):
        if not left:
            return 0
        first, others = left[0], range(1, len(left))
        beside = (c for n in range(len(left)) for c in itertools.combinations(others, n) if first + sum(left[k] for k in c) <= size)
        return 1 + min(of(tuple(left[k] for k in others if k not in c)) for c in beside)

    return of(tuple(sorted(lengths, reverse=True)))


def test_plans_are_at_most_one_sequence_above_the_fewest():
    rng = random.Random(5)
    assert fewest([6, 5, 4, 3, 2], 10) == 2 and fewest([7, 7, 4], 10) == 3
    more = 0
    for _ in range(150):
        size = rng.choice([10, 17, 30])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(1, 9))]
        n = sum(times for _, times in packing.plan(np.bincount(lengths, minlength=size + 1), size))
        best = fewest(lengths, size)
        assert best <= n <= best + 1, (lengths, size)
        more += n - best
    assert more <= 8  # of 150 plans
