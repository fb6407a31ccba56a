"""Numbers in texts: canonical forms, CJK numerals, magnitudes, ranges."""

from __future__ import annotations

import re
from decimal import Decimal, InvalidOperation

# Numerals and magnitudes.
DIGITS = dict(zip("〇零一二两三四五六七八九", (0, 0, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9), strict=True))
TENS = {"十": 10, "百": 100, "千": 1000}
LARGE = {"万": 10**4, "萬": 10**4, "亿": 10**8, "億": 10**8}
WORDS = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}
WIDE = str.maketrans("０１２３４５６７８９．，％－", "0123456789.,%-")
RAISED = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉", "01234567890123456789")
NUMBER = re.compile(r"[-−]?\d+(?:[.,]\d+)*")


def canonical(token: str) -> str:
    """Without thousands separators and trailing zeros, a point for decimals: 1,250.50 and 1.250,50 are 1250.5."""
    t = token.translate(WIDE).replace("−", "-")
    sign, t = ("-", t[1:]) if t.startswith("-") else ("", t)
    if "," in t and "." in t:
        point = max(t.rfind(","), t.rfind("."))
        t = re.sub(r"[.,]", "", t[:point]) + "." + t[point + 1 :]
    elif t.count(",") > 1 or re.fullmatch(r"\d{1,3}(?:,\d{3})+", t):
        t = t.replace(",", "")
    elif t.count(".") > 1:
        t = t.replace(".", "")
    else:
        t = t.replace(",", ".")
    try:
        d = Decimal(t)
    except InvalidOperation:
        return token
    s = format(d.normalize(), "f")
    return sign + s if d else "0"


def cjk_value(text: str) -> int | None:
    """The value of a CJK numeral such as 三千二百万; null for other text."""
    if not text or any(c not in DIGITS and c not in TENS and c not in LARGE for c in text):
        return None
    total = section = digit = 0
    for c in text:
        if c in DIGITS:
            digit = digit * 10 + DIGITS[c] if digit and section == 0 and len(text) == sum(x in DIGITS for x in text) else DIGITS[c]
        elif c in TENS:
            section, digit = section + (digit or 1) * TENS[c], 0
        else:
            total, section, digit = (total + section + digit) * LARGE[c] if total + section + digit else LARGE[c], 0, 0
    return total + section + digit


def values(text: str) -> list[str]:
    """Every number that a text states, canonical, magnitudes applied: 12.5 million and 1250万 are 12500000."""
    t = text.translate(WIDE).translate(RAISED)
    out = []
    pattern = re.compile(rf"({NUMBER.pattern})\s*(thousand|million|billion|trillion|[万萬亿億])?|([〇零一二两三四五六七八九十百千万萬亿億]{{2,}})", re.I)
    for m in pattern.finditer(t):
        if m[3]:
            v = cjk_value(m[3])
            out += [str(v)] if v is not None else []
        else:
            scale = LARGE.get(m[2] or "") or WORDS.get((m[2] or "").lower(), 1)
            c = canonical(m[1])
            out.append(format((Decimal(c) * scale).normalize(), "f") if scale > 1 else c)
    return out


def lost_and_invented(source: str, target: str) -> tuple[list[str], list[str]]:
    """Numbers of the source that the target lacks, and those it has of its own."""
    a, b = set(values(source)), set(values(target))
    return sorted(a - b), sorted(b - a)


def page_ranges(text: str) -> set[int]:
    """1-3,5 as a set; a bad part is an error."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", part)
        if not m or m[2] and int(m[2]) < int(m[1]):
            raise ValueError(f"no page range: {part}")
        out.update(range(int(m[1]), int(m[2] or m[1]) + 1))
    return out
