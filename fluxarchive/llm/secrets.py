"""Secret scans with multipart credential linking.

Assignments, access ids and hex keys are reported wherever they stand. Weaker candidates (bare high-entropy strings,
endpoints, short ids) are reported only where complementary parts meet: a scope is any SCOPE_LINES lines in a row of a block
between blank lines, so that scopes overlap, and its weak candidates count if it holds a secret-like part together with an
access id, or with an endpoint.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, table

# The base patterns of the contract. The length limits stand in the patterns where a shorter run cannot
# hide a longer match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
# Weak parts of a credential.
KEY_ID = re.compile(r"\b(?:client_?id|access_?key_?id|account|user(?:name)?|login)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?([A-Za-z0-9+/_.@-]{4,})", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(r"\b(?:[a-z][a-z0-9+]{1,12}://[^\s\"'<>]{4,}|(?:endpoint|host(?:name)?|server|region)[\"']?\x20{0,8}[:=]\x20{0,8}[\"']?[A-Za-z0-9_.:/-]{4,})", re.IGNORECASE | re.ASCII)
BARE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
MIN_ENTROPY = 3.6
SCOPE_LINES = 40
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key_id", "endpoint", "bare")
#: The others are ids and endpoints.
SECRETS = frozenset(("assign", "hex", "bare"))

Span = tuple[int, int, str, str]  # start, end, kind, text


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[Span]:
    out = [(*m.span(), "assign", m[0]) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    out += [(*m.span(), "access", m[0]) for m in ACCESS.finditer(text)]
    return out + [(*m.span(), "hex", m[0]) for m in HEX.finditer(text)]


def weak_spans(text: str) -> list[Span]:
    out = [(*m.span(), "key_id", m[0]) for m in KEY_ID.finditer(text)]
    out += [(*m.span(), "endpoint", m[0]) for m in ENDPOINT.finditer(text)]
    for m in BARE.finditer(text):
        if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and entropy(m[0]) >= MIN_ENTROPY:
            out.append((*m.span(), "bare", m[0]))
    return out


def line_starts(text: str) -> tuple[list[int], list[int]]:
    """Starts of the lines, and for each the block that it stands in; a blank line ends its block."""
    starts, blocks, block, blank = [], [], 0, False
    for m in re.finditer(r"[^\n]*\n|[^\n]+$", text):
        said = bool(m[0].strip())
        block += blank and said
        blank = not said
        starts.append(m.start())
        blocks.append(block)
    return starts, blocks


def meeting(parts: list[tuple[int, int, bool]]) -> list[bool]:
    """parts: block, line, whether a secret. Whether some SCOPE_LINES lines in a row of its block hold the part, a secret and
    an id or endpoint. The closest pairs of both sorts stand side by side in the order of lines."""
    order = sorted(set(parts))
    pairs: dict[int, list[tuple[int, int]]] = {}
    for (k, p, a), (j, q, b) in pairwise(order):
        if k == j and a != b and q - p < SCOPE_LINES:
            pairs.setdefault(k, []).append((p, q))
    out = []
    for k, line, _ in parts:
        met = pairs.get(k, [])
        i = bisect_left(met, line, key=lambda x: x[0])  # the first pair that starts here or later
        j = bisect_right(met, line, key=lambda x: x[1])  # after the last one that ends here or earlier
        out.append(i < len(met) and met[i][1] - line < SCOPE_LINES or j > 0 and line - met[j - 1][0] < SCOPE_LINES)
    return out


def linked_spans(text: str) -> list[Span]:
    """All spans of a text: the base ones, and weak ones of which a scope holds complementary parts. A weak span that overlaps a
    base span of the same text is part of it and not reported again."""
    strong = base_spans(text)
    weak = weak_spans(text) if strong or "://" in text or "=" in text or ":" in text else []
    if not weak:
        return strong
    taken = sorted((s, e) for s, e, *_ in strong)
    ends, top = [], 0
    for _, e in taken:
        ends.append(top := max(top, e))
    free = [x for x in weak if not (i := bisect_right(taken, (x[1] - 1, math.inf))) or ends[i - 1] <= x[0]]
    starts, blocks = line_starts(text)
    parts = []
    for x in strong + free:
        line = bisect_right(starts, x[0]) - 1
        parts.append((blocks[line], line, x[2] in SECRETS))
    return strong + [x for x, met in zip(free, meeting(parts)[len(strong) :], strict=True) if met]


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def scan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, spans array of (kind, start, end, value), in the order of start
    and kind; offsets are code points, end exclusive.

    Null and empty texts have no spans; repeated rows and null ids are scanned like others; spans that start together are
    ordered by kind as listed, then by end; extra columns are not carried; whole texts of any length are scanned in one pass
    that needs no shuffle; an empty table gives an empty result.
    """
    kind = "array<struct<kind string, start int, end int, value string>>".replace(" string", ":string").replace(" int", ":int")
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "value": v} for s, e, k, v in _ordered(linked_spans(t))] if t else [] for t in (x.as_py() for x in b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], ["doc_id", "spans"])

    docs = docs.select(docs["doc_id"].cast("bigint"), docs["text"].cast("string"))
    return spread(docs).mapInArrow(run, f"doc_id bigint, spans {kind}")


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and digests of the spans that scan() found, in its own pass."""
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return scanned.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(said(base), 256).alias("base_sha256"), said("spans").alias("spans"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan(table(spark, sf_dir, "documents")))
