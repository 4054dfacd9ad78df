"""Small corpora for the tests."""

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", kept boolean, score double, component_id string, n_words int, ids string, spans string, piece int, key int, row int, lower string"


def prose(rng, n, pool=400):
    return [f"w{rng.randrange(pool)}" for _ in range(n)]


def made(seed=3, n=90):
    """Documents with copies, near copies, shared passages, odd spacing and short texts."""
    rng = random.Random(seed)
    rows = []
    passage = prose(rng, 60, 4000)
    for i in range(n):
        kind = i % 9
        ws = prose(rng, rng.choice([0, 1, 5, 19, 20, 21, 80, 200]), 4000)
        if kind == 1 and rows:
            ws = rows[rng.randrange(len(rows))][1].split()
        elif kind in (2, 3) and rows:
            ws = rows[rng.randrange(len(rows))][1].split()
            for _ in range(1 + len(ws) // 40):
                if ws:
                    ws[rng.randrange(len(ws))] = "changed"
        elif kind == 4:
            at = rng.randrange(len(ws) + 1)
            ws[at:at] = passage[rng.randrange(30):]
        elif kind == 5:
            ws = ws + ws[: rng.randrange(len(ws) + 1)]
        text = rng.choice([" ", "  ", "\n", "\t "]).join(w.upper() if rng.random() < 0.02 else w for w in ws)
        rows.append((i * 3, text))
    rng.shuffle(rows)
    return rows


def documents(spark, rows, parts=4):
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS).repartition(parts)


def odd(spark):
    """Nulls everywhere, empty and long texts, repeated rows, and columns whose names clash."""
    long = "x" * 30000 + " " + "word " * 20000 + "é" * 500
    rows = [
        (1, ""), (2, None), (3, "a b"), (None, "some words without an id " * 8), (None, None), (4, long), (5, "same text " * 30),
        (6, "same text " * 30), (7, "repeated row"), (7, "repeated row"), (8, "  \n\t "), (9, "١٢٣ 中文 \x00 ž"), (7, "another text"),
        (10, "AKIA" + "A" * 20), (11, "''" * 9), (12, long),
    ]
    full = [(i, t, None, None, None, True, 0.5, "c", 1, "i", "s", 2, 3, 4, "x") for i, t in rows]
    return spark.createDataFrame(full, DOCUMENTS + CLASHING).repartition(3)


def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
