"""URL filter: host and path rules, then naive Bayes over segmented names.

A rule names a host and the beginning of a path; the longest that fits decides.
Other urls are judged by a multinomial naive Bayes model over words. Host names run
words together, so each run of letters in a host is split by a unigram Viterbi search;
path words stand as they are.

The dictionary is every word of the pages' own text. It is never sent to tasks:
the distinct runs of letters offer their substrings, a join keeps those that are words,
and a run's candidates come back to it as one short row. Likewise scores are worked out
per distinct host and per distinct path shape and joined to the pages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import written

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Host, beginning of the path, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: Words that mark a page of the training set as unwanted, whatever its rule.
UNWANTED = (
    "spam", "pills", "pill", "viagra", "casino", "poker", "bets", "bet", "betting", "adult", "porn", "sex", "xxx",
    "ads", "track", "tracker", "malware", "phishing", "warez", "loans",
)

#: Longest run of letters segmented at once; a longer one (no host name may have it) is cut into such.
RUN = 63
#: Longest word of the dictionary.
WORD = 32
#: Every unwanted word counts as at least one in so many words of the dictionary.
RARE = 100_000
#: An unknown word of n letters counts as 10 / 10**n of a word.
UNKNOWN = 10.0

LETTERS = np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Model(NamedTuple):
    """Words with their counts, weights of tokens (block against allow), and the prior log odds of block."""

    words: DataFrame
    n_words: int
    weights: DataFrame
    prior: float
    unseen: float


def parsed(pages: DataFrame, *keep: str) -> DataFrame:
    """(keep..., host, path) of every row of `pages`, from its column `url`.

    The host stands after the first '://' and ends before the first '/', '?', '#',
    or with the url; the path goes on to the first '?' or '#'. A url that is null or
    has no '://' has neither: both are ''.
    """
    url = F.col("url").cast("string")
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(cast(url AS string), instr(cast(url AS string), '://') + 3)")).otherwise(F.lit(""))
    rows = pages.select(*keep, rest.alias("_rest"))
    host = F.regexp_extract("_rest", "^[^/?#]*", 0)
    path = F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return rows.select(*keep, F.translate(host, CAPITALS, SMALL).alias("host"), path.alias("path"))


def _decided(rules, values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for host, path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, values[host + path]).otherwise(out)
    return out


def rule(rules=RULES) -> Column:
    """The longest of a short list of rules that fits (host, path), as host and path joined; null if none does."""
    return _decided(rules, {h + p: F.lit(h + p) for h, p, _ in rules})


def rule_verdict(rules=RULES) -> Column:
    return _decided(rules, {h + p: F.lit(v) for h, p, v in rules})


def letter_runs() -> Column:
    """Runs of letters of `host` in order, cut to RUN letters."""
    return F.regexp_extract_all("host", F.lit(f"[a-z]{{1,{RUN}}}"), F.lit(0))


def path_tokens() -> Column:
    """Words of `path` in small letters; of a number only how long it is."""
    words = F.split(F.regexp_replace(F.lower("path"), "[0-9]", "0"), "[^a-z0-9\\x{80}-\\x{10FFFF}]+")
    return F.filter(words, lambda x: x != "")


# ------------------------------------------------------------ words


def _text_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each block of pages: runs of a-z between characters that are no letters, outside tags."""
    for batch in batches:
        for block in tx.blocks(batch, "html"):
            data, n = block.data, len(block.data)
            if not n:
                continue
            # inside a tag: the last bracket opens one; every page begins outside
            mark = np.where((data == 0x3C) | (data == 0x3E), np.arange(n), -1)
            mark[block.starts[block.ends > block.starts]] = block.starts[block.ends > block.starts]
            last = np.maximum.accumulate(mark)
            inside = LETTERS[data] & (data[last] != 0x3C)
            edge = np.zeros(n + 1, bool)
            edge[block.starts] = True
            opens, closes = inside.copy(), inside.copy()
            opens[1:] &= ~inside[:-1] | edge[1:-1]
            closes[:-1] &= ~inside[1:] | edge[1:-1]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            foreign = np.append(0, np.cumsum(data >= 128))
            own = (end - start <= WORD) & (foreign[end] == foreign[start])
            found = tx.Words(np.zeros(int(own.sum()), np.int64), start[own], end[own])
            small = tx.lower(data)
            keys = tx.word_keys(small, found)
            _, first, counts = np.unique(keys, return_index=True, return_counts=True)
            words = [small[a:b].tobytes().decode() for a, b in zip(found.start[first], found.end[first])]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts.astype(np.int64))], ["word", "n"])


def word_counts(pages: DataFrame, unwanted=UNWANTED) -> tuple[DataFrame, int]:
    """(word, n) of all text of `pages` (column `html`; null is empty), and the sum of n over the text.

    The text's words are counted whole; `unwanted` words get at least one part in RARE,
    so that names made of them can be split.
    """
    found = pages.select(F.col("html").cast("string").alias("html")).mapInArrow(_text_words, "word string, n long")
    words = written(found.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = max(1, words.agg(F.sum("n")).first()[0] or 0)
    least = max(1, math.ceil(total / RARE))
    extra = words.sparkSession.createDataFrame([(w, least) for w in unwanted], "word string, n long")
    return words.unionByName(extra).groupBy("word").agg(F.max("n").alias("n")), total


def split_words(run: str, words: dict[str, int], total: int) -> list[str]:
    """The likeliest split of `run` into words of the dictionary and unknown ones.

    A split's likelihood is the product of its words' shares of all words. Of equal
    splits of the same beginning, the one with the longer last word is taken.
    """
    best, back = [0.0], [0]
    logs = {w: math.log(n / total) for w, n in words.items()}
    for end in range(1, len(run) + 1):
        top, at = -math.inf, 0
        for start in range(end):
            word = run[start:end]
            p = logs.get(word)
            if p is None:
                p = math.log(UNKNOWN / total) - len(word) * math.log(10)
            if best[start] + p > top:
                top, at = best[start] + p, start
        best.append(top)
        back.append(at)
    out, end = [], len(run)
    while end:
        out.append(run[back[end]:end])
        end = back[end]
    return out[::-1]


def segmented(runs: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(run, tokens) for every distinct `run` of letters, at most RUN of them long.

    Substrings of the runs meet the dictionary in a join; what is a word returns to its
    run. A run has at most RUN * WORD substrings.
    """
    def offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                pairs = [(r, w) for r in batch.column(0).slice(at, 256).to_pylist()
                         for w in {r[i:j] for i in range(len(r)) for j in range(i + 1, min(len(r), i + WORD) + 1)}]
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["run", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            tokens = [split_words(r["run"], {w["word"]: w["n"] for w in r["words"] or ()}, total) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.list_(pa.string()))], ["run", "tokens"])

    runs = runs.select("run").distinct()
    known = runs.mapInArrow(offer, "run string, word string").join(words, "word")
    known = known.groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return runs.join(known, "run", "left").select("run", "words").mapInArrow(cut, "run string, tokens array<string>")


def host_tokens(hosts: DataFrame, words: DataFrame, total: int) -> DataFrame:
    """(host, tokens) for every distinct `host`: the words of all its runs of letters, in order."""
    hosts = written(hosts.select("host").distinct(), "hosts")
    runs = hosts.select("host", F.posexplode(letter_runs()).alias("at", "run"))
    cut = segmented(runs, words, total)
    joined = runs.join(cut, "run").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "tokens"))).alias("all"))
    rows = hosts.join(joined, "host", "left")
    tokens = F.flatten(F.transform("all", lambda x: x["tokens"]))
    return rows.select("host", F.coalesce(tokens, F.array().cast("array<string>")).alias("tokens"))


# ------------------------------------------------------------ naive Bayes


def _shape() -> Column:
    """A path by its words alone: what naive Bayes sees of it."""
    return F.concat_ws("/", path_tokens())


def _exploded(table: DataFrame, key: str) -> DataFrame:
    return table.select(key, F.explode("tokens").alias("token"))


def fit(pages: DataFrame, rules=RULES, unwanted=UNWANTED) -> tuple[Model, DataFrame]:
    """A model of `pages` (url, html), and (host, tokens) of their hosts.

    Learnt from all pages: those that a rule blocks, or with an unwanted word among their
    tokens, are examples to block, all others examples to allow. Token counts are sums
    over all pages, smoothed by 1; a token never seen weighs `unseen`. No pages give a
    model that allows.
    """
    words, total = word_counts(pages, unwanted)
    rows = parsed(pages).select("host", _shape().alias("shape"), rule_verdict(rules).alias("ruled"))
    counts = written(rows.groupBy("host", "shape", "ruled").agg(F.count("*").alias("n")), "urls")
    hosts = written(host_tokens(counts, words, total), "host_tokens")
    listed = F.array(*(F.lit(w) for w in unwanted)) if unwanted else F.array().cast("array<string>")
    bad = hosts.select("host", F.arrays_overlap("tokens", listed).alias("bad"))
    marked = counts.join(bad, "host").withColumn("tokens", F.split("shape", "/"))
    unfit = F.col("bad") | F.arrays_overlap("tokens", listed)
    label = F.when(unfit | (F.col("ruled") == "block"), 1).otherwise(0)
    marked = written(marked.select("host", "shape", "n", label.alias("label")), "marked")
    sums = [F.sum(F.when(F.col("label") == c, F.col("n")).otherwise(0)).alias(name) for c, name in ((1, "block"), (0, "allow"))]
    by_host = marked.groupBy("host").agg(*sums).join(hosts, "host")
    by_shape = marked.groupBy("shape").agg(*sums).withColumn("tokens", F.filter(F.split("shape", "/"), lambda x: x != ""))
    tokens = by_host.drop("host").unionByName(by_shape.drop("shape")).select("block", "allow", F.explode("tokens").alias("token"))
    tokens = written(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")), "tokens")
    n = tokens.agg(F.count("*"), F.sum("block"), F.sum("allow")).first()
    size, block, allow = (int(x or 0) for x in n)
    documents = marked.agg(*sums).first()
    prior = math.log(((documents[0] or 0) + 1) / ((documents[1] or 0) + 1))
    base = math.log((allow + size + 1) / (block + size + 1))
    weight = F.log((F.col("block") + 1) / (F.col("allow") + 1)) + F.lit(base)
    return Model(words, total, tokens.select("token", weight.alias("weight")), prior, base), hosts


def scores(table: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, score): the sum of the weights of `tokens`, for every row of `table` that has any."""
    found = _exploded(table, key).join(model.weights, "token", "left")
    # sums of numbers cut to 2**-30 do not depend on their order
    weight = F.coalesce("weight", F.lit(model.unseen))
    return found.groupBy(key).agg(F.sum(F.round(weight * (1 << 30)).cast("long")).alias("score"))


def judged(pages: DataFrame, model: Model, rules=RULES, hosts: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row of `pages` (page_id, url).

    The verdict is the longest fitting rule's; without one it is 'block' where the log
    odds `score` are above 0, else 'allow'. A url without host and path has the prior
    odds. Rows are judged one by one, with or without page_id; repeated rows stay.
    `hosts`, if given, has the tokens of all hosts of `pages`.
    """
    rows = parsed(pages, F.col("page_id").cast("long").alias("page_id"))
    rows = rows.withColumn("_shape", _shape())
    if hosts is None:
        hosts = written(host_tokens(rows, model.words, model.n_words), "host_tokens")
    # Written, so that both sides of the joins are plain exchanges and a hot host or path can be split.
    by_host = written(scores(hosts, "host", model).withColumnRenamed("score", "_host"), "host_scores")
    shapes = rows.select("_shape").distinct().withColumn("tokens", F.filter(F.split("_shape", "/"), lambda x: x != ""))
    by_shape = written(scores(shapes, "_shape", model).withColumnRenamed("score", "_path"), "path_scores")
    both = rows.join(by_host, "host", "left").join(by_shape, "_shape", "left")
    zero = F.lit(0).cast("long")
    odds = F.lit(round(model.prior * (1 << 30))).cast("long") + F.coalesce("_host", zero) + F.coalesce("_path", zero)
    own = F.when(odds > 0, "block").otherwise("allow")
    return both.select(
        "page_id", "host", "path", rule(rules).alias("rule"), F.coalesce(rule_verdict(rules), own).alias("verdict"),
        (odds / (1 << 30)).alias("score"))
