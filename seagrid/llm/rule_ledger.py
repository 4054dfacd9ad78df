"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document; the ledger keeps the measurements and
one bit per failed rule. A policy is a named version: the set of rules whose
failure rejects a document. Applying another policy, or asking what each rule
does on its own, is bit arithmetic over the ledger; no text is read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx

U = np.uint64
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
RUN = 8

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: Rules in order of their bits: a document fails where the condition holds.
#: Whole numbers only, so every engine agrees.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_runs": "100 * n_repeat_words > 30 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "repeated_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "short_words": "n_words >= 20 and word_chars < 2 * n_words",
    "long_words": "n_words >= 20 and word_chars > 25 * n_words",
    "repeated_runs_strict": "100 * n_repeat_words > 15 * n_words",
}

#: Rules whose failure rejects, by version.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_runs"),
    "v1": ("few_words", "repeated_runs", "symbols", "repeated_lines", "short_words", "long_words"),
    "strict": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    return sum(1 << k for k, name in enumerate(RULES) if name in rules)


def measure(block: tx.Block) -> list[np.ndarray]:
    """MEASURES of all rows of a block."""
    data, n = block.data, len(block.starts)
    found = tx.words(block)

    def per_row(at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(block.starts, at, "right") - 1, minlength=n)

    inside = np.append(0, np.cumsum(((data & 0xC0) != 0x80) & ~tx.SPACE[data]))
    symbols = np.append(0, np.cumsum(SYMBOLS[data]))
    keys = tx.word_keys(data, found)

    # lines that hold a word, by key of all their bytes
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.sort(np.concatenate([block.starts[block.ends > block.starts], breaks + 1]))
    edge = np.unique(np.append(begin, len(data)))
    begin = edge[:-1]
    end = edge[1:] - np.isin(edge[1:] - 1, breaks, assume_unique=True)
    holds = np.searchsorted(found.start, end) > np.searchsorted(found.start, begin)
    begin, end = begin[holds], end[holds]
    lines = tx.Words(np.searchsorted(block.starts, begin, "right") - 1, begin, end)
    line_keys = tx.word_keys(data, lines) if len(data) else np.zeros(0, U)
    n_lines = np.bincount(lines.row, minlength=n)
    unlike = np.bincount(tx.distinct(line_keys, lines.row)[1], minlength=n)

    # words inside runs that the text holds twice or more
    at, runs = tx.runs(keys, found.row, RUN)
    order = np.lexsort((runs, found.row[at]))
    key, row = runs[order], found.row[at][order]
    same = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    twice = at[order][np.append(same, False) | np.append(False, same)] if len(at) else at
    cover = np.zeros(len(keys) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + RUN, -1)
    repeated = np.bincount(found.row[np.cumsum(cover[:-1]) > 0], minlength=n)

    return [
        np.bincount(found.row, minlength=n), inside[block.ends] - inside[block.starts],
        symbols[block.ends] - symbols[block.starts], n_lines, n_lines - unlike, repeated,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in tx.blocks(batch):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(block.first, len(block.starts)), *(pa.array(m.astype(np.int64)) for m in measure(block))],
                ["doc_id", *MEASURES])


def ledger(docs: DataFrame) -> DataFrame:
    """(doc_id, measurements, failures) for every row of `docs`; bit k of
    `failures` is set where the k-th of RULES fails. A null text is empty and
    measures 0 throughout. Rows are judged one by one, with or without doc_id,
    and texts of any length whole; an empty table gives no rows."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    found = rows.mapInArrow(_measure, ", ".join(["doc_id long", *(f"{m} long" for m in MEASURES)]))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)) for k, rule in enumerate(RULES.values())]
    failures = bits[0]
    for bit in bits[1:]:
        failures = failures.bitwiseOR(bit)
    return found.withColumn("failures", failures.cast("long"))


def rejected(policy: str) -> Column:
    """Whether a row of the ledger fails any rule of a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) != 0


def ablation(rows: DataFrame) -> DataFrame:
    """For every policy and each of its rules: documents that fail the rule, and
    those that fail it alone and would be kept without it; per policy also all
    rejected documents and all documents. One aggregate over the ledger."""
    counts = [F.count("*").alias("n_docs")]
    for name, rules in POLICIES.items():
        counts.append(F.count_if(rejected(name)).alias(f"{name}:"))
        own = F.col("failures").bitwiseAND(F.lit(mask(POLICIES[name])).cast("long"))
        for rule in rules:
            bit = F.lit(mask((rule,))).cast("long")
            counts.append(F.count_if(own.bitwiseAND(bit) != 0).alias(f"{name}:{rule}"))
            counts.append(F.count_if(own == bit).alias(f"{name}:{rule}:alone"))
    one = rows.agg(*counts)
    lines = [
        F.struct(
            F.lit(name).alias("policy"), F.lit(rule).alias("rule"), F.col("n_docs"),
            F.col(f"`{name}:`").alias("n_rejected"), F.col(f"`{name}:{rule}`").alias("n_failed"),
            F.col(f"`{name}:{rule}:alone`").alias("n_alone"),
        )
        for name, rules in POLICIES.items() for rule in rules
    ]
    return one.select(F.explode(F.array(*lines)).alias("line")).select("line.*")


ORACLE = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS lines
  FROM d
), t AS (
  SELECT doc_id, unnest(words) AS x, generate_subscripts(words, 1) AS i FROM w
), places AS (
  SELECT doc_id, i, lead(x, 7) OVER p AS last, concat_ws(' ', x, lead(x, 1) OVER p, lead(x, 2) OVER p, lead(x, 3) OVER p,
         lead(x, 4) OVER p, lead(x, 5) OVER p, lead(x, 6) OVER p, lead(x, 7) OVER p) AS run
  FROM t WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), runs AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS times FROM places WHERE last IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM runs, (SELECT unnest(range(8)) AS k) WHERE times > 1 GROUP BY doc_id
), m AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%%&|<>]', '', 'g')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (doc_id)
), f AS (
  SELECT *, %s AS failures FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       (failures & %d) <> 0 AS base_failed, (failures & %d) = 0 AS kept, CAST(failures AS BIGINT) AS failures
FROM f
""" % (
    " + ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES.values())),
    mask(POLICIES["base"]), mask(POLICIES["v1"]),
)
