"""Secret scans with multipart credential linking."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are taken whole, so a shorter one can't hide a longer one
BASE = ("assign", "access", "hex")

#: Weak parts, reported only in company. An identifier names an account or key; its value has no shape of its own.
#: Its name may have a prefix (DB_USER), but one that says secret (aws_secret_access_key) names no identifier.
WEAK_ID = re.compile(r"""\b(?:(?!\w*secret)[A-Za-z0-9_]*[_-])?(?:access[_-]?key(?:[_-]?id)?|key[_-]?id|client[_-]?id|account(?:[_-]?id)?|user(?:[_-]?(?:name|id))?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@+-]{3,})""", re.I | re.A)
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=@-])")
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]*://[^\s"'<>]+|\b(?:\d{1,3}\.){3}\d{1,3}:\d{2,5}\b|\b[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+:\d{2,5}\b)""")
#: Parts belong together within so many characters and one paragraph.
REACH = 256
#: Bits a character that a weak secret has at least.
ENTROPY = 3.0
KINDS = (*BASE, "part_id", "part_secret", "part_endpoint")
Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """The base matches that pass their length, unordered."""
    low, found = text.lower(), []
    if (":" in text or "=" in text) and any(k in low for k in ("password", "passwd", "secret", "token", "api")):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _strong(value: str) -> bool:
    """A value that looks drawn at random: letters and digits, many different."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= ENTROPY


def _paragraphs(text: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer(r"\n[ \t\r]*\n", text))]


def _near(spans: list[Span], starts: list[int], longest: int, a: int, b: int) -> list[Span]:
    """Of spans, sorted by start, those that start before b and do not end before a."""
    return [s for s in spans[bisect_left(starts, a - longest) : bisect_left(starts, b)] if s[1] >= a]


def linked_spans(text: str, base: list[Span], reach: int = REACH) -> list[Span]:
    """Weak parts that complement another: an interval join of identifiers, secrets and endpoints.

    Each identifier opens an interval of `reach` characters around it, clipped to its paragraph; parts that meet it belong to it, and are
    reported whole. A weak identifier is reported if a secret lies there, a weak secret if an identifier's interval meets it, an endpoint if
    one interval holds it beside such a pair, or beside an assign or hex match. A weak secret and an endpoint alone are none: paths and digests
    look like that. Base matches count as parts (access as an identifier, assign and hex as secrets) and are not reported twice.
    """
    ids, secrets = [s for s in base if s[2] == "access"], sorted(s for s in base if s[2] != "access")
    taken = sorted((a, b) for a, b, _ in base)
    tops = list(accumulate((b for _, b in taken), max))
    free = lambda a, b: (k := bisect_left(taken, (b, -1))) == 0 or tops[k - 1] <= a
    if ":" in text or "=" in text:
        ids += [(m.start(), m.end(), "part_id") for m in WEAK_ID.finditer(text) if free(m.start(), m.end())]
    if not ids and not secrets:
        return []
    edges = _paragraphs(text)
    ends = [(m.start(), m.end(), "part_endpoint") for m in ENDPOINT.finditer(text)]
    weak = [(m.start(), m.end(), "part_secret") for m in WEAK_SECRET.finditer(text) if free(m.start(), m.end()) and _strong(m[0])] if ids else []
    at = [e[0] for e in ends]
    weak = [w for w in weak if (k := bisect_right(at, w[0])) == 0 or ends[k - 1][1] <= w[0]]
    sides = [(spans, [s[0] for s in spans], max((b - a for a, b, _ in spans), default=0)) for spans in (secrets, weak, ends)]
    found: set[Span] = set()
    for i in ids + secrets:
        k = bisect_right(edges, i[0])
        low, high = max(i[0] - reach, edges[k - 1]), min(i[1] + reach + 1, edges[k] if k < len(edges) else len(text))
        strong, near, at_hand = (_near(*side, low, high) for side in sides)
        near = [w for w in near if w[1] <= i[0] or w[0] >= i[1]]
        at_hand = [e for e in at_hand if free(e[0], e[1])]
        if i[2] in ("assign", "hex"):
            found.update(at_hand)
        elif strong or near:
            found.update(near, at_hand, [i] if i[2] == "part_id" else [])
    return list(found)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs.

    spans lists kind:start:end, code points with the end exclusive, by start and then kind: base matches, then
    linked weak parts. Null and empty texts have none. Rows are scanned one by one, whole, without a
    shuffle: parts never link across texts. Ids pass through, nulls and repeats too; an empty table gives an empty result.
    """
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(f"n_{k}", T.LongType()) for k in BASE),
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = ([], [], []), [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                base = base_spans(text)
                for k, column in zip(BASE, counts, strict=True):
                    column.append(sum(s[2] == k for s in base))
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(base + linked_spans(text, base, reach)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans, pa.string())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)
