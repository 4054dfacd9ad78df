"""Secrets in texts: plain patterns, and multipart credentials linked by place.

Base spans are reported wherever they match: assignments of a value to a secret
name, access identifiers, long hex strings. Weak candidates mean little alone:
names of an account, values that only look random, addresses of a service. They
are reported when complementary parts co-occur: an identifier, a secret and, for
short secrets, an endpoint within one scope of SCOPE code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seagrid.llm import text as tx
from seagrid.llm.store import plainly_named, written

#: Longest distance between the starts of parts that belong together.
SCOPE = 300

BASE = ("assign", "access", "hex")


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{16,}")  # maximal runs, so shorter ones need not be matched first

#: Weak parts: kind, role, pattern. The span is group 1 where there is one.
_WEAK = (
    ("account", "identifier", re.compile(rf"""(?:{"|".join(_either(w) for w in ("username", "user_id", "client_id", "login", "account"))})["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{{3,}})""")),
    ("short_value", "secret", re.compile(rf"""(?:{_NAMES}|[Pp][Ww][Dd])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{{6,11}})(?![A-Za-z0-9+/_.=-])""")),
    ("random", "secret", re.compile(r"(?<![A-Za-z0-9+/=])(?=[A-Za-z+/]*[0-9])(?=[a-z0-9+/]*[A-Z])(?=[A-Z0-9+/]*[a-z])[A-Za-z0-9+/]{20,}={0,2}(?![A-Za-z0-9+/=])")),
    ("endpoint", "endpoint", re.compile(r"[a-z][a-z0-9+]{2,9}://[^\s\"'<>]{4,}")),
)
#: What a text must hold somewhere for a weak pattern to match, so most skip them.
_HINT = {"account": re.compile("[:=]"), "short_value": re.compile("[:=]"), "random": re.compile("[A-Za-z0-9+/]{20}"), "endpoint": re.compile("://")}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start, then kind as listed in BASE."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 12] if ":" in text or "=" in text else []
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return [(a, b, BASE[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2]))]


def weak_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, role) of parts that are reported only together."""
    found = []
    for kind, role, pattern in _WEAK:
        if not _HINT[kind].search(text):
            continue
        for m in pattern.finditer(text):
            found.append((*m.span(m.lastindex or 0), kind, role))
    return found


_SPAN = "struct<start:long,end:long,kind:string>"
_PART = "struct<start:long,end:long,kind:string,role:string>"
SCANNED = f"base array<{_SPAN}>, weak array<{_PART}>"


def scan_text(text: str) -> tuple[list[dict], list[dict]]:
    base = [{"start": a, "end": b, "kind": k} for a, b, k in base_spans(text)]
    weak = [{"start": a, "end": b, "kind": k, "role": r} for a, b, k, r in weak_spans(text)]
    return base, weak


def _types() -> tuple[pa.DataType, pa.DataType]:
    span = [("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]
    return pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("role", pa.string())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = _types()
    for batch in batches:
        found = [scan_text(t.as_py() or "") for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), *(pa.array([f[k] for f in found], kinds[k]) for k in (0, 1))],
            ["doc_id", "row_key", "base", "weak"])


#: The role of a base span as a part of a credential.
_ROLE = {"assign": "secret", "access": "identifier", "hex": "secret"}


def linked(scanned: DataFrame) -> DataFrame:
    """(row, start, end, kind) of the weak parts of `scanned` (row, base, weak)
    whose complements lie in scope.

    An interval join: parts meet in the scope-wide cells of the text that they
    and their neighbours fall into, and each joins the nearest complements by
    start. A part counts once per role, so a cell with many parts costs no pairs.
    """
    role = F.create_map(*[F.lit(x) for kv in _ROLE.items() for x in kv])
    some = scanned.where(F.size("weak") > 0)
    parts = some.select("row", F.explode("weak").alias("s")).select("row", "s.*").unionByName(
        some.select("row", F.explode("base").alias("s")).select("row", "s.*").withColumn("role", role[F.col("kind")])
    )
    cell = F.floor(F.col("start") / SCOPE)
    # of each role in a cell, the earliest and latest start decide which cells beside it they reach
    ends = parts.groupBy("row", cell.alias("cell"), "role").agg(F.collect_set("start").alias("starts"))
    near = ends.select("row", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"), "role", "starts")
    near = near.groupBy("row", "cell").pivot("role", ["identifier", "secret", "endpoint"]).agg(
        F.array_sort(F.flatten(F.collect_list("starts")))
    )
    weak = parts.where(~F.col("kind").isin(*BASE)).withColumn("cell", cell)
    met = weak.join(near, ["row", "cell"])

    def close(role: str):
        return F.coalesce(F.exists(role, lambda x: F.abs(x - F.col("start")) <= SCOPE), F.lit(False))

    ok = (
        F.when(F.col("kind") == "account", close("secret"))
        .when(F.col("kind") == "random", close("identifier"))
        .when(F.col("kind") == "short_value", close("identifier") & close("endpoint"))
        .otherwise(close("identifier") & close("secret"))
    )
    return met.where(ok).select("row", "start", "end", "kind").distinct()


def _order(kind):
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(k) for k in BASE]), kind), F.lit(0)), F.lit(len(BASE) + 1))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def row_key(docs: DataFrame):
    """Equal for rows with the same doc_id and text, which have the same spans."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, base, spans) for every row of `docs`: base spans, and those with
    the linked weak parts, each array ordered by start, then kind. Positions are
    code points, end exclusive. A null text is empty and has no spans; rows are
    scanned one by one, so repeated rows and rows without a doc_id are no case
    of their own. A text of any length is scanned whole in one task; of no rows
    there are no spans."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), row_key(docs).alias("row_key"))
    found = rows.mapInArrow(_scan, "doc_id long, row_key long, " + SCANNED)
    # an id of its own for every row; it is stored with the row, hence stable
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "scanned")
    more = linked(found).groupBy("row").agg(F.collect_list(F.struct("start", "end", "kind")).alias("more"))
    every = F.concat("base", F.coalesce("more", F.array().cast(f"array<{_SPAN}>")))
    keyed = F.array_sort(F.transform(every, lambda s: F.struct(
        s["start"].alias("start"), _order(s["kind"]).alias("order"), s["kind"].alias("kind"), s["end"].alias("end"))))
    spans = F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.join(more, "row", "left").select("doc_id", "row_key", "base", spans.alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of the spans of every row."""
    found = secrets(docs)

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
    )


def digest_of(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()


#: What stands in a text in place of a secret.
MARK = "[secret]"


def masked(text: str, spans: list[tuple[int, int]], mark: str = MARK) -> str:
    """The text with every span, and spans that touch each other, replaced."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("text")
        spans = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        new = [t if not s else masked(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(batch.column(at).to_pylist(), spans)]
        names = [c for c in batch.schema.names if c not in ("text", "_spans")]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(batch.schema.get_field_index(c)) for c in names), tx.strings(new)], [*names, "text"])


def without_secrets(docs: DataFrame) -> DataFrame:
    """`docs` with every reported span masked in text; all rows and other columns stay."""
    names, docs = docs.columns, plainly_named(docs, "doc_id", "text")
    columns = docs.columns
    found = secrets(docs).where(F.size("spans") > 0).dropDuplicates(["row_key"])
    found = found.select(F.col("row_key").alias("_row_key"), F.col("spans").alias("_spans"))
    rows = docs.withColumn("_key", row_key(docs)).join(found.hint("shuffle_hash"), F.col("_key") == F.col("_row_key"), "left")
    rows = rows.drop("_key", "_row_key")
    others = [f"{c} {t}" for c, t in rows.dtypes if c not in ("text", "_spans")]
    return rows.mapInArrow(_mask, ", ".join([*others, "text string"])).select(*columns).toDF(*names)
