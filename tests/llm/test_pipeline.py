"""The pipeline stage by stage against plain versions, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from seagrid.llm import bpe_tree, quality_net, secret_scan
from seagrid.llm.store import table, written
from seagrid.llm.substring_dedup import without_repeats

from corpus import nothing, odd
from test_dedup import parts, passages, word_sets

FOLDER = os.environ.get("SEAGRID_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_follow_each_other(spark, monkeypatch):
    monkeypatch.setattr(quality_net, "ROUNDS", 60)
    docs = table(spark, FOLDER, "documents")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(written(stage(spark, seen[-1], FOLDER), name))
    assert all(df.dtypes == docs.dtypes for df in seen[1:-1])
    whole, good, single, cut, clean, packed = seen
    assert set(texts(good)) <= set(texts(whole)) and good.count() > 0.7 * whole.count()

    before = texts(good)
    sets = word_sets(before.items(), 5)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert texts(single) == {i: before[i] for i, c in parts(sets, links).items() if i == c}

    before = texts(single)
    want = {i: " ".join(ws) if gone else before[i] for i, (n, gone, ws) in passages(before.items(), 50).items() if not gone or gone < n}
    assert texts(cut) == want

    after = texts(clean)
    assert set(after) == set(want)
    for i, t in want.items():
        if not secret_scan.base_spans(t) and not secret_scan.weak_spans(t):
            assert after[i] == t
        assert not secret_scan.base_spans(after[i])
    assert all(r.n_chars == len(r.text) for r in clean.collect())
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_odd_and_empty_tables_pass_every_stage(spark):
    for docs, name in ((odd(spark), "odd"), (nothing(spark), "nothing")):
        for step, stage in corpus_pipeline.STAGES[1:]:
            new = written(stage(spark, docs, FOLDER), step)
            if step != "packing":
                assert new.dtypes == docs.dtypes
                docs = new
        assert (new.count() > 0) == (name == "odd")
        assert corpus_pipeline.STAGES[0][1](spark, docs, FOLDER).dtypes == docs.dtypes


#: Names that operators use on the way or give their results, and one that needs quoting.
INNER = ["_score", "_words", "_removed", "_kept", "_spans", "_gone", "_id", "_at", "_key", "_row_key", "_SCORE2", "c0", "c7", "a.b"]


def test_columns_named_like_inner_ones_stay_as_they_are(spark, monkeypatch):
    monkeypatch.setattr(quality_net, "ROUNDS", 20)
    docs = table(spark, FOLDER, "documents").withColumns({c: F.concat(F.lit(c), "doc_id") for c in INNER})
    for step, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), step)
    rows = docs.collect()
    assert docs.columns == [*table(spark, FOLDER, "documents").columns, *INNER] and rows
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in INNER)


def test_columns_named_like_results_give_way(spark):
    docs = odd(spark).withColumns({c: F.lit("old") for c in ("_score", "_words", "_removed", "_kept", "bytes", "ids", "a.b")})
    found = without_repeats(docs)
    assert {r._removed for r in found.collect()} > {0} and found.columns.count("_kept") == 1
    assert {r._score for r in quality_net.scored(docs, None).collect()} == {0.5}
    back = bpe_tree.decoded(bpe_tree.encoded(docs)).collect()
    want = sorted((t or "").encode() for t in (r.text for r in docs.collect()))
    assert sorted(bytes(r.bytes) for r in back) == want and all(r["a.b"] == "old" for r in back)


def test_registered():
    names = list(queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and {"op9_rule_ledger", "op12_centroids", "op13_filter_audit"} <= set(oracle_sql())
