"""Spans that must survive untouched are replaced by tokens, and put back with a report."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The families in the order in which they are masked, with what they match.
FAMILIES = {
    "EMAIL": r"(?:https?|ftp)://[^\s<>\"⟦⟧]+[^\s<>\"⟦⟧.,;:!?)\]'’”]|mailto:[^\s<>⟦⟧]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "CODE": r"```.*?```|~~~.*?~~~|`[^`\n]+`",
    "MATH": r"\\begin\{(?P<env>[a-z*]+)\}.*?\\end\{(?P=env)\}|\$\$.+?\$\$|\\\(.+?\\\)|\\\[.+?\\\]|(?<![\\$\w])\$(?![\s$])[^$\n]*?[^\s$\\]\$(?![\d$])",
    "CITE": r"\[\d{1,3}(?:\s*[-–,]\s*\d{1,3})*\]|\((?:[A-Z][\w'-]+(?: et al\.| (?:and|&) [A-Z][\w'-]+)?,? \d{4}[a-z]?(?:; )?)+\)",
}
TOKEN = re.compile(r"⟦([A-Z]+)_MASK_(\d{4,})-([0-9a-f]{3})⟧")


def is_mathematics(body: str) -> bool:
    """Whether what stands between dollar signs is a formula rather than amounts of money."""
    inner = body.strip("$").strip()
    if re.fullmatch(r"[\d.,]+\s*(?:million|billion|k|m|bn)?(?:\s+[a-z]+)*", inner, re.I):
        return False
    return bool(re.search(r"[\\^_=+<>{}|]|^[A-Za-z]$|\d\s*[-*/]\s*\d", inner)) or not re.search(r"[a-z]{3,}\s+[a-z]{3,}", inner)


def checksum(index: int, original: str) -> str:
    """Three hex digits that tie a token to its span."""
    return hashlib.blake2s(f"{index}\0{original}".encode(), digest_size=2).hexdigest()[:3]


@dataclass
class Masked:
    text: str
    spans: list[tuple[str, str, str]] = field(default_factory=list)  # token, family, original


def mask(text: str) -> Masked:
    """Families one after the other; later ones see earlier tokens as opaque."""
    out = Masked(text)
    for family, pattern in FAMILIES.items():
        n = 0

        def put(m: re.Match) -> str:
            nonlocal n
            whole = m[0]
            if "⟦" in whole and family != "CODE" or family == "MATH" and whole[0] == "$" and whole[1] != "$" and not is_mathematics(whole):
                return whole
            n += 1
            token = f"⟦{family}_MASK_{n:04d}-{checksum(n, whole)}⟧"
            out.spans.append((token, family, whole))
            return token

        out.text = re.sub(pattern, put, out.text, flags=re.S)
    return out


@dataclass
class Restored:
    text: str
    missing: list[str]
    duplicated: list[str]
    mutated: list[str]
    reordered: list[str]


def reordered(order: list[str], wanted: list[str]) -> list[str]:
    """Tokens that stand before one that should come first."""
    place = {t: k for k, t in enumerate(wanted)}
    ranks = [place[t] for t in order]
    most, least = list(accumulate(ranks, max)), list(accumulate(reversed(ranks), min))[::-1]
    return [t for t, r, top, low in zip(order, ranks, most, least, strict=True) if top > r or low < r]


def restore(text: str, masked: Masked) -> Restored:
    """Tokens back to their spans, in reverse order of masking; tokens that were lost, doubled, altered or moved are listed."""
    known = {t: o for t, _, o in masked.spans}
    found = [m[0] for m in TOKEN.finditer(text)]
    counts = Counter(found)
    inside = {t for _, _, o in masked.spans for t in known if t in o}
    missing = [t for t in known if not counts[t] and t not in inside]
    top = [t for t in dict.fromkeys(found) if t in known]
    wanted = [m[0] for m in TOKEN.finditer(masked.text)]
    out = text
    for t, _, o in reversed(masked.spans):
        out = out.replace(t, o)
    return Restored(out, missing, [t for t, n in counts.items() if n > 1 and t in known], [t for t in counts if t not in known], reordered(top, [t for t in wanted if t in top]))


def lost_literals(source: str, target: str) -> list[str]:
    """Masked literals that the source has more often than the target."""
    have = lambda t: Counter(o for _, f, o in mask(t).spans if f != "CITE")
    return sorted((have(source) - have(target)).elements())


def mask_udf():
    """mask as a column function: struct(text, spans)."""
    kind = T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("token", "family", "original")])))])

    def run(texts: pd.Series) -> pd.DataFrame:
        done = [mask(t or "") for t in texts]
        return pd.DataFrame({"text": [m.text for m in done], "spans": [[{"token": a, "family": b, "original": c} for a, b, c in m.spans] for m in done]})

    return F.pandas_udf(run, kind)
