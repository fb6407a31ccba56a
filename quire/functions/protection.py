"""Spans that no term may be looked for or rewritten in, and terms outside them."""

from __future__ import annotations

import re
from bisect import bisect_right

import pandas as pd
from pyspark.sql import functions as F

# What is code, mathematics, markup, an address or a mask, and what stands in quotes.
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af"
CODE_LIKE = (
    r"<[^>]+>", r"```[\s\S]*?```", r"~~~[\s\S]*?~~~", r"`[^`\n]+`", r"https?://[^\s<>'\"\)\]" + CJK + r"]+", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}", r"\$\$[\s\S]*?\$\$",
    r"\\\[[\s\S]*?\\\]", r"\\\([\s\S]*?\\\)", r"\\begin\{[a-zA-Z*]+\}[\s\S]*?\\end\{[a-zA-Z*]+\}", r"\]\([^\)\n]+\)", r"⟦[^⟧]*⟧",
)
QUOTED = (r"“[^“”\n]{1,200}”", r"‘[^‘’\n]{1,200}’", r"「[^「」\n]{1,200}」", r"『[^『』\n]{1,200}』", r"«[^«»\n]{1,200}»", r'(?<![A-Za-z0-9])"[^"\n]{1,200}"')
INLINE_MATH = r"(?<![\\$\w])\$(?![\s$])[^$\n]*?[^\s$\\]\$(?![\d$])"
ACRONYM_CHARS = 5

_SPANS = [re.compile(p) for p in (*CODE_LIKE, *QUOTED)]
_MATH = re.compile(INLINE_MATH)


def protected(text: str) -> list[tuple[int, int]]:
    """Merged intervals of protected text; amounts of money between dollar signs are no mathematics."""
    from quire.functions.masking import is_mathematics

    found = sorted([m.span() for p in _SPANS for m in p.finditer(text)] + [m.span() for m in _MATH.finditer(text) if is_mathematics(m[0])])
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def term_pattern(term: str, any_case: bool = True) -> re.Pattern:
    """A term as a pattern: whole words where it begins or ends with one, CJK anywhere, and a blank or none where Latin meets CJK."""
    is_cjk = lambda c: re.match(f"[{CJK}]", c) is not None
    parts, last = [], ""
    for piece in re.findall(rf"[ \t]+|[{CJK}]+|[^ \t{CJK}]+", term.strip()):
        if not piece.strip():
            parts.append(r"[ \t]+")
            continue
        if last and is_cjk(piece[0]) != is_cjk(last[-1]):
            parts[-1:] = [r"[ \t]*"] if parts[-1] == r"[ \t]+" else [parts[-1], r"[ \t]*"]
        parts.append(re.escape(piece))
        last = piece
    inner = "".join(parts)
    head = "" if not term or is_cjk(term[0]) or not re.match(r"\w", term[0]) else rf"(?<![^\W{CJK}])"
    tail = "" if not term or is_cjk(term[-1]) or not re.match(r"\w", term[-1]) else rf"(?![^\W{CJK}])"
    return re.compile(head + inner + tail, re.I if any_case else 0)


def occurrences(text: str, term: str, shield: list[tuple[int, int]], any_case: bool = True) -> list[tuple[int, int]]:
    """Where a term stands outside the protected intervals."""
    if not term.strip():
        return []
    starts = [a for a, _ in shield]

    def free(a: int, b: int) -> bool:
        k = bisect_right(starts, b - 1) - 1
        return k < 0 or shield[k][1] <= a

    return [m.span() for m in term_pattern(term, any_case).finditer(text) if free(*m.span())]


def drift(source: str, target: str, surfaces: list[str], expected: list[str]) -> str:
    """absent, rendered, protected or drifted: whether the source has one of a term's surfaces (short capitals in their case) and the target one of
    its renderings, at least inside a quotation or label."""
    shield = protected(source)
    if not any(occurrences(source, s, shield, not (s.isupper() and len(s) <= ACRONYM_CHARS)) for s in surfaces):
        return "absent"
    shield = protected(target)
    if any(occurrences(target, e, shield) for e in expected):
        return "rendered"
    return "protected" if any(occurrences(target, e, []) for e in expected) else "drifted"


def enforce(text: str, rules: list[tuple[str, str]]) -> tuple[str, list[tuple[str, str]]]:
    """The text with surfaces rewritten to their canonical terms, and what was applied. Longer surfaces go first and none overlap; a
    surface that is part of the canonical term standing there is left, so a second run changes nothing."""
    shield, taken = protected(text), []
    for surface, canonical in sorted(rules, key=lambda r: (-len(r[0]), r)):
        whole = occurrences(text, canonical, shield)
        for a, b in occurrences(text, surface, shield):
            if surface != canonical and all(b <= x or a >= y for x, y, *_ in taken) and all(b <= x or a >= y for x, y in whole):
                taken.append((a, b, surface, canonical))
    out = text
    for a, b, _, canonical in sorted(taken, reverse=True):
        out = out[:a] + canonical + out[b:]
    return out, [(s, c) for _, _, s, c in sorted(taken)]


def drift_udf():
    def run(source: pd.Series, target: pd.Series, surfaces: pd.Series, expected: pd.Series) -> pd.Series:
        return pd.Series([drift(s or "", t or "", list(x), list(e)) for s, t, x, e in zip(source, target, surfaces, expected, strict=True)])

    return F.pandas_udf(run, "string")


def enforce_udf():
    def run(text: pd.Series, rules: pd.Series) -> pd.DataFrame:
        done = [enforce(t or "", [(r["surface"], r["canonical"]) for r in (() if rs is None else rs)]) for t, rs in zip(text, rules, strict=True)]
        return pd.DataFrame({"text": [d[0] for d in done], "applied": [[{"surface": s, "canonical": c} for s, c in d[1]] for d in done]})

    return F.pandas_udf(run, "text string, applied array<struct<surface:string,canonical:string>>")


def protected_udf():
    return F.pandas_udf(lambda texts: texts.map(lambda t: [{"start": a, "end": b} for a, b in protected(t or "")]), "array<struct<start:int,end:int>>")
