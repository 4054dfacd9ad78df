"""URL rules and words, clustering by subvector dictionaries, and the filter audit, against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from seagrid.llm import centroids, filter_audit, url_filter
from seagrid.llm.url_filter import UNWANTED

from corpus import documents, made, nothing, odd

PAGES = "page_id long, url string, html string, host string, path string, rule string, score int, token string, n string"


def pages_of(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "h", "p", "r", 1, "t", "n") for r in rows], PAGES).repartition(parts)


# ------------------------------------------------------------ urls


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c in url_filter.CAPITALS else c for c in host), path


def plain_rule(host, path, rules=url_filter.RULES):
    fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda r: len(r[0]), default=(None, None))


def plain_words(html):
    outside = re.sub(r"<[^<>]*(?:>|(?=<)|$)", "<", html or "")
    words = re.findall(r"[A-Za-z\u0080-\U0010ffff]+", outside)
    return Counter(w.lower() for w in words if w.isascii() and len(w) <= url_filter.WORD)


def plain_split(run, words, total):
    """Every split of a run, the likeliest first; exponential, for short runs."""
    def cost(w):
        return math.log(words[w] / total) if w in words else math.log(url_filter.UNKNOWN / total) - len(w) * math.log(10)

    splits = []
    for mask in range(1 << (len(run) - 1)):
        cuts = [0, *(k + 1 for k in range(len(run) - 1) if mask >> k & 1), len(run)]
        splits.append([run[a:b] for a, b in zip(cuts, cuts[1:])])
    return max(sum(map(cost, s)) for s in splits), lambda s: sum(map(cost, s))


def plain_tokens(path):
    return [t for t in re.split(r"[^a-z0-9\u0080-\U0010ffff]+", re.sub("[0-9]", "0", path.lower())) if t]


@pytest.fixture(scope="module")
def site():
    """Names run together from words; names with a listed word share others that no list has."""
    rng = random.Random(5)
    good = ["river", "stone", "garden", "paper", "music", "window", "north", "table", "bread", "cloud"]
    bad = ["casino", "winner", "jackpot", "bonus"]
    rows = []
    for i in range(300):
        names = rng.sample([bad[0], rng.choice(bad[1:])], 2) if i % 5 == 0 else rng.sample(good, 2)
        joined = rng.choice(["", "-"]).join(names)
        top = rng.choice(["Example.org", "example.com", "example.net", "com", "net"])
        path = rng.choice(["/en/1", "/es/", "/fr/x?y=/de/", "/de/a.html#/fr/", "", "/", "/a b/7", "/En/22/Play"])
        text = " ".join(rng.choices(good + bad, k=30))
        rows.append((i, f"https://{rng.choice(['', 'www.', 'M.'])}{joined}.{top}{path}", f"<p class='ab'>{text}</p> Él naïve {text.upper()}"))
    rows += [(900, None, None), (None, "no scheme/x", ""), (901, "://", "<"), (902, "ftp://a@B.org:21?q", "a>b"), (902, "ftp://a@B.org:21?q", "a>b"),
             (903, "http://org/x://y/de/", "é"), (904, "http://xorg/es/", None), (905, "http://" + "abc" * 9000 + ".com/de/x", None),
             (906, "x" * 50000, "word " * 9000), (907, "http://example.org/en/1", "<<b> c"), (908, "http://.com/fr/\n", ""), (909, "http://É.org/", None)]
    return rows


def test_hosts_paths_and_rules(spark, site):
    rows = url_filter.parsed(pages_of(spark, site), "page_id").withColumn("rule", url_filter.rule())
    got = sorted(((r.page_id, r.host, r.path, r.rule) for r in rows.collect()), key=str)
    want = sorted(((i, *plain_url(u), plain_rule(*plain_url(u))[0]) for i, u, _ in site), key=str)
    assert got == want and len({r[3] for r in want}) == 6


def test_words_of_pages(spark, site):
    found, total = url_filter.word_counts(pages_of(spark, site), unwanted=())
    want = sum((plain_words(h) for _, _, h in site), Counter())
    assert {r.word: r.n for r in found.collect()} == want and total == sum(want.values())
    listed, _ = url_filter.word_counts(pages_of(spark, site), unwanted=("zzz", "river"))
    assert {r.word: r.n for r in listed.collect()} == {"zzz": 1, **want}


def test_runs_are_split_as_by_trying_every_split(spark):
    rng = random.Random(2)
    words = {"a": 5, "an": 30, "ana": 2, "na": 9, "nab": 4, "ban": 8, "b": 3, "banana": 1}
    runs = ["".join(rng.choices("abn", k=rng.randrange(1, 11))) for _ in range(60)] + ["zzz", "banxyzana"]
    total = sum(words.values())
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.run: r.tokens for r in url_filter.segmented(spark.createDataFrame([(r,) for r in runs], "run string"), table, total).collect()}
    assert set(got) == set(runs)
    for run, tokens in got.items():
        best, cost = plain_split(run, words, total)
        assert "".join(tokens) == run and math.isclose(cost(tokens), best)


def test_scores_equal_plain_naive_bayes(spark, site):
    pages = pages_of(spark, site)
    model, hosts = url_filter.fit(pages)
    words = {r.word: r.n for r in model.words.collect()}
    examples = []
    for i, u, _ in site:
        host, path = plain_url(u)
        runs = [r[k:k + url_filter.RUN] for r in re.findall("[a-z]+", host) for k in range(0, len(r), url_filter.RUN)]
        tokens = [t for r in runs for t in url_filter.split_words(r, {w: words[w] for w in words if w in r}, model.n_words)]
        tokens += plain_tokens(path)
        rule, verdict = plain_rule(host, path)
        examples.append((i, host, path, rule, verdict, tokens, verdict == "block" or bool(set(tokens) & set(UNWANTED))))
    block, allow = (Counter(t for e in examples if e[6] == c for t in e[5]) for c in (True, False))
    size = len(set(block) | set(allow))
    base = math.log((sum(allow.values()) + size + 1) / (sum(block.values()) + size + 1))
    prior = math.log((sum(e[6] for e in examples) + 1) / (sum(not e[6] for e in examples) + 1))
    want = []
    for i, host, path, rule, verdict, tokens, _ in examples:
        score = prior + sum(math.log((block[t] + 1) / (allow[t] + 1)) + base for t in tokens)
        want.append((i, host, path, rule, verdict or ("block" if score > 0 else "allow"), score))
    for given in (hosts, None):
        rows = url_filter.judged(pages, model, hosts=given).collect()
        got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict, r.score) for r in rows), key=lambda r: str(r[:3]))
        want.sort(key=lambda r: str(r[:3]))
        assert [r[:5] for r in got] == [r[:5] for r in want]
        assert np.allclose([r[5] for r in got], [r[5] for r in want], atol=1e-5)


def test_unlisted_names_are_blocked_by_what_they_share(spark, site):
    """Fitted on some pages, it blocks names of the same kind that hold no listed word, and leaves others."""
    model, _ = url_filter.fit(pages_of(spark, site))
    new = [(1, "http://winnerjackpot.example.net/x", None), (2, "http://bonuswinner.net/", None), (3, "http://riverstone.example.net/x", None),
           (4, "http://papergarden.net/", None)]
    assert {r.page_id: r.verdict for r in url_filter.judged(pages_of(spark, new), model).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}


def test_no_pages(spark):
    pages = pages_of(spark, [])
    model, hosts = url_filter.fit(pages)
    assert url_filter.judged(pages, model, hosts=hosts).count() == 0
    some = pages_of(spark, [(1, "http://a.net/", None), (2, None, None)])
    assert {r.verdict for r in url_filter.judged(some, model).collect()} == {"allow"}


# ------------------------------------------------------------ clusters


def plain_clusters(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(int(x) * 1024 if abs(x) > 2**53 else x * 1024) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x * 1024) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *near(v)) for i, v in kept]
    sums = Counter()
    for _, d, j in found:
        sums[j] += d
    most = 2**63 - 1
    return sorted(((i, j, min(d, most), min(sums[j], most), min(sum(sums.values()), most),
                    hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found), key=str)


def vectors_of(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows],
                                 f"vec_id long, embedding array<{kind}>, cluster int, distance int, inertia int").repartition(4)


def clustered(spark, rows, kind="float", **options):
    df = centroids.clusters(vectors_of(spark, rows, kind), **options)
    assert df.columns == list(centroids.RESULT)
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(rng, n, dims=64, scale=0.125):
    return [[float(np.float32(x)) for x in row] for row in rng.normal(0, scale, (n, dims))]


def test_clusters_equal_plain_ones(spark):
    rng = np.random.default_rng(1)
    few = cloud(rng, 5)
    rows = list(enumerate(cloud(rng, 120) + [few[i % 5] for i in range(80)]))  # copies make wide blocks
    rows += [(7, few[0]), (7, few[0]), (500, None), (501, few[0][:63]), (502, few[0] + [0.0]), (503, [None] + few[0][1:]),
             (504, [float("nan")] + few[0][1:]), (505, [float("inf")] + few[0][1:]), (None, few[1]), (506, [0.0] * 64), (507, []), (508, [-0.0] * 64)]
    assert clustered(spark, rows) == plain_clusters(rows)


def test_ties_go_to_the_lower_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 3)] * 64) for i in range(40)]  # equal centroids: all but the first stay empty
    assert clustered(spark, rows) == plain_clusters(rows)
    assert len({r[1] for r in clustered(spark, rows)}) <= 3


def test_few_and_no_vectors(spark):
    rng = np.random.default_rng(2)
    rows = list(enumerate(cloud(rng, 3)))
    assert clustered(spark, rows) == plain_clusters(rows) and clustered(spark, []) == [] and clustered(spark, [(1, None)]) == []
    narrow = list(enumerate(cloud(rng, 30, 5)))
    assert clustered(spark, narrow, k=3, rounds=2, dims=5) == plain_clusters(narrow, 3, 2, 5)


def test_components_of_any_finite_size_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = list(enumerate(cloud(rng, 30) + cloud(rng, 6, scale=1e6) + cloud(rng, 6, scale=1e30)))
    assert clustered(spark, rows) == plain_clusters(rows)
    rows += [(99, [1e300] + [0.0] * 63), (100, [1.7e308] * 64), (101, [-5e-324] * 64)]
    assert clustered(spark, rows, "double") == plain_clusters(rows)


def test_dictionaries_lose_nothing_and_widen_over_copies():
    rng = np.random.default_rng(3)
    spread = np.floor(rng.normal(0, 128, (500, 64)))
    copies = spread[rng.integers(0, 20, 500)]
    for values in (spread, copies, spread[:1], np.zeros((9, 64))):
        blocks = centroids.blocks_of(values)
        assert (centroids.values_of(blocks) == values).all() and sum(b.entries.shape[1] for b in blocks) == 64
        assert all(len(b.entries) * centroids.SHARE <= len(values) or b.entries.shape[1] == 1 or len(b.entries) == 1 for b in blocks)
    assert len(centroids.blocks_of(copies)) == 1 and len(centroids.blocks_of(spread)) > 32


# ------------------------------------------------------------ audit


def plain_audit(rows, labels):
    """Every order applied to every document."""
    out = Counter()
    parts = {}
    good, toxic = ({i for i, *m in labels if m[k] == 1} for k in (0, 1))
    for i, text, lang in rows:
        text = text or ""
        ws = [w for w in re.split(r"[ \t-\r]+", text) if w]
        smaller = any(j is not None and i is not None and j < i and (t or "") == text for j, t, _ in rows)
        fails = {f for f, bad in zip("ABCDE", (
            len(ws) < 200, 100 * len(set(ws)) < 50 * len(ws), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            bool(re.search("[#$%&*|]", text)), smaller)) if bad}
        part = lang or ""
        parts[part] = parts.get(part, 0) + 1
        for order in permutations("ABCDE"):
            first = next((f for f in order if f in fails), None)
            for step, f in enumerate(order):
                gone = first is not None and order.index(first) < step
                key = (part, "".join(order), step + 1)
                out[*key, "kept"] += first is None or order.index(first) > step
                out[*key, "removed"] += f == first
                out[*key, "redundant"] += gone and f in fails
                out[*key, "unique_fails"] += fails == {f}
                out[*key, "good_lost"] += f == first and i in good
                out[*key, "toxic_lost"] += f == first and i in toxic
                if f == first:
                    out[part, f, "shapley"] += 1
    return sorted((p, "".join(o), s, *(out[p, "".join(o), s, c] for c in filter_audit.COUNTS[:-1]), out[p, o[s - 1], "shapley"])
                  for p in parts for o in permutations("ABCDE") for s in range(1, 6))


def audited(docs, labels):
    got = filter_audit.audit(filter_audit.mask_counts(docs, labels))
    assert got.columns == ["part", "filter_order", "step", *filter_audit.COUNTS]
    return sorted(tuple(r) for r in got.collect())


def marks(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, quality int, toxic int, part string, n int")


def with_lang(docs):
    return [(r.doc_id, r.text, r.lang) for r in docs.collect()]


def test_audit_equals_applying_every_order(spark):
    rng = random.Random(8)
    noise = [" ".join(rng.choices(["Word", "a", "b", "c", "LOUD", "x#", "é"], k=rng.choice([5, 150, 260]))) for _ in range(50)]
    many = " ".join(f"w{k}" for k in range(300))
    rows = made(n=60) + [(1000 + i, t) for i, t in enumerate(noise + noise[:15] + [many, many, many + " #"])]
    docs = documents(spark, rows).selectExpr("doc_id", "text", "case doc_id % 3 when 0 then 'en' when 1 then 'de' end as lang", "source", "n_chars")
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i, _ in rows[::2]] + [(rows[0][0], 1, 1), (rows[0][0], 0, 0), (None, 1, 1), (99999, 1, 1)]
    got = audited(docs, marks(spark, labels))
    assert got == plain_audit(with_lang(docs), labels) and len(got) == 3 * 600
    assert all(any(r[k] for r in got) for k in range(3, 10))


def test_audit_of_odd_and_no_documents(spark):
    labels = [(1, 1, 0), (7, 1, 1)]
    assert audited(odd(spark), marks(spark, labels)) == plain_audit(with_lang(odd(spark)), labels)
    assert audited(nothing(spark), marks(spark, labels)) == []
    assert audited(odd(spark), marks(spark, [])) == plain_audit(with_lang(odd(spark)), [])


def test_copies_of_one_text_fold_before_they_meet(spark):
    """A text held by most rows, some of them repeated, some without an id."""
    rows = [(i, "copy " * 250) for i in range(400)] + [(0, "copy " * 250)] * 3 + [(None, "copy " * 250)] * 5 + [(-4, "other")]
    docs = documents(spark, rows)
    counts = {r["mask"]: r["n"] for r in filter_audit.mask_counts(docs, marks(spark, [])).collect()}
    assert counts == {2: 4 + 5, 2 | 16: 399, 1: 1}


def test_min_plus_product_is_the_first_failing_place():
    n = 4
    fails = np.arange(1 << n)[:, None] >> np.arange(n) & 1
    applied = filter_audit.orders(n)
    steps = filter_audit.removal_steps(np.where(fails, 0, filter_audit.NEVER), np.argsort(applied, 1))
    for m in range(1 << n):
        for o, order in enumerate(applied):
            want = next((k for k, f in enumerate(order) if m >> f & 1), None)
            assert steps[m, o] == want or (want is None and steps[m, o] >= filter_audit.NEVER)
