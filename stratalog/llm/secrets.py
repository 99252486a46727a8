"""Secret scans with multipart credential linking.

Strong kinds stand alone: assign (a keyword set to a value), access (cloud access ids) and hex (long hex runs). Weak ones
(account names, pass phrases and keys under weak keywords, long mixed strings, endpoints) are only candidates: within a
scope (text without a blank line, parts at most `reach` characters apart) an interval join over the sorted parts reports
a weak identifier beside a secret, a weak secret beside an identifier, and an endpoint beside both. Weak spans never
overlap strong ones, and strong ones are never changed.

Null and empty texts have no spans; texts of any length are scanned whole, and parts of any length link. Repeated rows are
scanned each, several secrets in one place are spans of their own. Spans are in code points, end exclusive. A map over Arrow
batches: no shuffle. Other columns pass through under any names; one named `spans`, in any case, is replaced."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.llm.common import freeing, fresh, same_name, slices, table

STRONG = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
REACH = 240

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_WEAK_ID = re.compile(r"""\b(?:user(?:_?name)?|login|client_?id|account(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})""", re.I | re.A)
_WEAK_KEY = re.compile(r"""\b(?:pwd|pass|key|credentials?|auth|bearer)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{8,})""", re.I | re.A)
_MIXED = re.compile(r"(?<![A-Za-z0-9+/=_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{24,}={0,2}")
_ENDPOINT = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s\"'<>]+", re.I | re.A)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    """The stand-alone spans as (start, end, kind). A run of AKIA or hex letters that is too short can't hold a longer
    match, so the lengths are in those patterns; a keyword's short value may hold a keyword, so it is dropped afterwards."""
    out = []
    if "=" in text or ":" in text:
        out += [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in _ACCESS.finditer(text)]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return out


def _by_scope(parts: list[tuple[int, int, int]]) -> dict[int, tuple[list[int], list[list[tuple[int, int]]]]]:
    """For each scope of the parts (start, end, scope): their starts in order, and with each the two parts, as (end, start),
    that reach farthest among those up to there."""
    out: dict = {}
    for s, e, k in sorted(set(parts)):
        starts, far = out.setdefault(k, ([], []))
        starts.append(s)
        far.append(sorted([*(far[-1] if far else ()), (e, s)])[-2:])
    return out


def _near(parts: dict, start: int, end: int, scope: int, reach: int) -> bool:
    """Whether a part other than the span itself lies in the scope within reach, however long the part is."""
    starts, far = parts.get(scope, ((), ()))
    i = bisect_right(starts, end + reach)
    return i > 0 and any(e >= start - reach and (e, s) != (end, start) for e, s in far[i - 1])


def all_spans(text: str, reach: int = REACH) -> list[tuple[int, int, str]]:
    """Strong spans and linked weak ones, by start, then kind in the order STRONG + WEAK."""
    strong = strong_spans(text)
    weak: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        weak += [(*m.span(1), "weak_id") for m in _WEAK_ID.finditer(text)]
        weak += [(*m.span(1), "weak_secret") for m in _WEAK_KEY.finditer(text)]
    identified = any(k == "access" for _, _, k in strong) or any(k == "weak_id" for _, _, k in weak)
    if identified:
        weak += [(*m.span(), "weak_secret") for m in _MIXED.finditer(text)]
    if identified and "://" in text:
        weak += [(*m.span(), "endpoint") for m in _ENDPOINT.finditer(text)]
    if weak and (strong or identified):
        taken = sorted(strong)
        begins = [s for s, _, _ in taken]
        ends, most = [], 0
        for _, e, _ in taken:
            ends.append(most := max(most, e))
        free = lambda s, e: (i := bisect_left(begins, e)) == 0 or ends[i - 1] <= s
        weak = [w for w in weak if free(w[0], w[1])]
        blanks = [m.start() for m in _BLANK.finditer(text)]
        scope = lambda s: bisect_right(blanks, s)
        with_scope = lambda kinds: _by_scope([(s, e, scope(s)) for s, e, k in strong + weak if k in kinds])
        ids, secrets = with_scope(("access", "weak_id")), with_scope(("assign", "hex", "weak_secret"))
        linked = set()
        for s, e, k in weak:
            beside_id = _near(ids, s, e, scope(s), reach)
            beside_secret = _near(secrets, s, e, scope(s), reach)
            if beside_secret if k == "weak_id" else beside_id if k == "weak_secret" else beside_id and beside_secret:
                linked.add((s, e, k))
        strong += linked
    order = STRONG + WEAK
    return sorted(strong, key=lambda x: (x[0], order.index(x[2]), x[1]))


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _mapped(df: DataFrame, text: str, keep: list[str], out: T.StructField, made: Callable[[str], object], kind: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([made(t.decode()) for t in texts], kind)], names=[*keep, out.name])

    return df.select(*dict.fromkeys([*keep, text])).mapInArrow(freeing(run), T.StructType([*(df.schema[c] for c in keep), out]))


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """The kept columns (all, if not given) and `spans`, an array of (kind, start, end); an input column `spans` is replaced."""
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != "spans"]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return _mapped(df, text, keep, T.StructField("spans", _SPANS), lambda t: [(k, s, e) for s, e, k in all_spans(t, reach)], kind)


def redacted(text: str, mark: str = "[secret]", reach: int = REACH) -> str:
    out, at = [], 0
    for s, e, _ in all_spans(text, reach):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(df: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """df with every span replaced by the mark, in the same columns; null texts stay null."""
    text = same_name(df.columns, text) or text
    keep = [c for c in df.columns if c != text]
    null = fresh(df, "_null")
    out = _mapped(df.withColumn(null, F.col(text).isNull()), text, [*keep, null], T.StructField(text, T.StringType()), lambda t: redacted(t, mark), pa.string())
    return out.withColumn(text, F.when(~F.col(null), F.col(text))).select(*df.columns)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans, of every row of documents."""
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(table(spark, sf_dir, "documents"), keep=["doc_id"]).select(
        "doc_id",
        *map(count, STRONG),
        F.sha2(_joined(F.filter(spans, lambda x: x["kind"].isin(*STRONG))), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )
