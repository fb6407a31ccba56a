"""Blocks that ship as they are: handles, bibliography, bylines, affiliations and debris, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.names import contains_cjk

# What entries of a bibliography, names, affiliations and running prose look like, and the reasons that are given.
HANDLE, ARXIV = r"(?U)^@[\w.\-]+", r"(?iU)arXiv:\d{4}\.\d+"
BRACKET_REF, ONLINE = r"(?U)^\[\d+\]\s+[A-Z“\"‘'《]", r"(?iU)\[Online\]\.?\s*Available:\s*https?://"
ET_AL, AUTHOR, YEAR = r"(?U)\bet\.?\s+al\.", r"(?U)(?<![A-Za-z0-9/])[A-Z]\.-?[A-Z]?\s*[A-Z][a-z]+", r"(?U)\b(19|20)\d{2}\b"
PUBLISHERS = r"Pearson|Prentice|Elsevier|Wiley|Springer"
VENUE = (
    r"(?iU)Technical Digest|Trans\.|Symposium|Conference|Manual|Chapter \d|pp?\.\s*\d|doi\.org|\bdoi:\s*10\.|University|" + PUBLISHERS + r"|SISPAD|IEDM|VLSI|IEEE Access|IEEE\b|Journal\b|"
    r"Solid-State|Electron Device|Lett\.|Semicond\.|Nanotech|Microelectron|Appl\. Phys|Proc\.|Proceedings of\b|CoRR\b|\bvol\.\s*(?:\d+|abs/)|"
    r"Neural Information Processing|Learning Representations|Machine Learning|Computational Linguistics|Natural Language Processing|Artificial Intelligence|"
    r"Association for Computing|ACM\b|PMLR|NeurIPS|ICML|ICLR|ACL\b|EMNLP|Technical Report|Preprint"
)
BOOK = (
    r"(?iU)Chapter \d|" + PUBLISHERS + r"|Manual\b|University of California|Inc\b|Publishers?\b|Publishing\b|McGraw|MIT Press|Addison[- ]?Wesley|O['’]Reilly|Cambridge University Press|"
    r"Oxford University Press|Academic Press|Manning\b|Morgan Kaufmann|CRC Press|Princeton University Press|\b\d+(?:st|nd|rd|th)\s+ed\."
)
SHORT_ARTICLE = r"(?U)^[A-Z]\.\s*(?:[A-Z]\.\s*)?[A-Z][A-Za-z'’\-]+,\s*['\"“‘][^'\"”’]{3,120}['\"”’]\.?\s*(?:19|20)\d{2}\.?\s*$"
JOURNAL_VOLUME, PAGE_TAIL = r"(?U)\b[A-Z][A-Za-z]{2,}\.?\s+\d{1,4}\s*\(\s*\d{1,3}\s*\)", r"(?U)\b\d{1,4}\s*[-–—]\s*\d{1,4}\s*\.?\s*$"
IN_VENUE = (
    r"(?U)\bIn\s+(?:the\s+)?(?:\d{4}\s+)?(?:[A-Z][A-Za-z0-9]*\s+)*(?:Proceedings|Proc\.|Conference|Conf\.|Symposium|Symp\.|Workshop|Transactions|Trans\.|Journal|Advances|ACM|IEEE|USENIX|NeurIPS|ICML|ICLR|"
    r"CVPR|ECCV|ICCV|AAAI|IJCAI|ACL|EMNLP|NAACL|COLING|KDD|WWW|SIGMOD|VLDB|OSDI|SOSP|NSDI|EuroSys|FAST|ASPLOS|MICRO|ISCA|HPCA|ATC)\b"
)
PAGES, VOLUME, PAGE_RANGE = r"(?iU)\bpages?\s+[\d,]+(?:\s*[-–—]\s*[\d,]+)?", r"(?iU)\bvolume\s+\d+", r"(?U)\b\d{2,6}\s*[-–—]\s*\d{2,6}\b"
NAME_LIST, SURNAME_FIRST = r"(?U)^[A-Z][A-Za-z'’\-]+\s+[A-Z][A-Za-z'’\-]+\s*[,.]", r"(?U)^[A-Z][A-Za-z'’\-]+,\s*(?:[A-Z]\.\s*){1,3}"
DOC_CITATION = r"(?isU)\b(?:documentation|manual|whitepaper|specification|user\s+guide)\b.*\b(?:consulted|accessed|retrieved)\s+(?:[A-Za-z]+\.?\s+)?(?:19|20)\d{2}\b"
NARRATIVE = (
    r"(?iU)\b(?:according to|we (?:extend|propose|show|evaluate|present|describe|find|observe|use|introduce)|our (?:approach|method|model|dataset|benchmark|results|work)|"
    r"this (?:paper|section|work|study|chapter)|as (?:shown|demonstrated|noted|described)|can be (?:found|downloaded|seen) at|relies on|is available at|was released at)\b"
)
FULL_NAME, INITIAL, SUPERSCRIPTS = r"[A-Z][a-z'’\-]+", r"[A-Z]\.", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾˒"
BYLINE_PART = r"(?U)^(?:and\s+|&\s+)?(?:[A-Z][A-Za-z'’\-]+|(?:[A-Z]\.)+)(?:[\s,]+(?:[A-Z][A-Za-z'’\-]+|Jr\.?|Sr\.?|(?:[A-Z]\.)+))*[\s,0-9ⁿ∗*†‡§¶" + SUPERSCRIPTS + "]*$"
MARKER, EMAIL = r"[∗†‡§¶]|(?<![A-Za-z0-9*])\*(?![A-Za-z0-9*])", r"(?U)[\w.+-]+@[\w-]+\.[\w.-]+"
INSTITUTION = r"(?iU)\b(?:Universit(?:y|ies|ät|é|e)|Institute|Institut|Academy|Laboratory|Laboratoire|College|School|Labs?)\b"
IDENTITY_WORDS, WORD = 40, r"\p{L}{2,}"
REASONS = {
    "handle": "social-handle watermark / running-head chrome", "bibliography": "bibliography entry (kept verbatim for retrievability)",
    "byline": "author byline (foreign names kept in romanization per GB/T 7714)", "identity": "bibliographic identity (affiliation/legend kept verbatim)",
    "debris": "pure symbol/numeric debris (no translatable words)",
}


def _n(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _words(text: Column) -> Column:
    return _n(text, r"(?U)\S+")


def is_bibliography_entry(text: Column) -> Column:
    """Whether a text reads as a reference: by its form alone, or by a year with signs of authors and of where it appeared."""
    outside = F.regexp_replace(text, r"\([^)]*\)", "")
    et_al, named = _n(outside, ET_AL), _n(outside, AUTHOR)
    authors = et_al + named
    has = text.rlike
    prose = has(NARRATIVE) | ((F.size(F.filter(F.split(text, r"(?U)[.!?]\s+[A-Z]"), lambda s: F.trim(s) != "")) >= 3) & (_words(text) > 35))
    located = has(PAGES) | has(VOLUME)
    by_venue = has(VENUE) & (((authors >= 1) | has(NAME_LIST)) & (located | has(PAGE_RANGE)) | (authors >= 2) | ((authors >= 1) & (has(r"(?iU)\b(?:in\s+Proceedings|doi:|vol\.\s*abs/)") | has(PAGE_TAIL))))
    by_authors = (et_al >= 1) & (has(VENUE) | has(IN_VENUE) | (named >= 1)) | (authors >= 1) & (has(JOURNAL_VOLUME) | has(BOOK))
    by_link = has("(?i)https?://") & ((authors >= 1) | has(NAME_LIST) | has(SURNAME_FIRST) | has(IN_VENUE) | has(r"(?i)(?:Retrieved from|\[Online\])"))
    return ~prose & (has(ONLINE) | has(SHORT_ARTICLE) | has(DOC_CITATION) | has(YEAR) & ((has(IN_VENUE) & located) | by_venue | by_authors | by_link))


def is_byline(text: Column) -> Column:
    """Whether a text is a list of authors: two names at least, each of two parts, no year and no CJK."""
    parts = F.filter(F.transform(F.split(F.translate(text, SUPERSCRIPTS, " " * len(SUPERSCRIPTS)), r",| and "), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: s != "")
    whole = lambda s: _n(s, FULL_NAME) >= 2
    name = lambda s: s.rlike(BYLINE_PART) & (whole(s) | (s.rlike(INITIAL) & s.rlike(FULL_NAME)))
    return ~text.rlike(YEAR) & ~contains_cjk(text) & (F.size(parts) >= 2) & F.forall(parts, name) & F.when(F.size(parts) < 3, F.forall(parts, whole)).otherwise(F.exists(parts, whole))


def is_identity(text: Column) -> Column:
    """Whether a short text ties names to institutions: marks of reference with an institution or address, two marks, or both of those."""
    marks, address, place = _n(text, MARKER), text.rlike(EMAIL), text.rlike(INSTITUTION)
    return ~contains_cjk(text) & (_words(text) <= IDENTITY_WORDS) & ((marks >= 2) | ((marks >= 1) & (address | place)) | (address & place))


def skip_kind(source: Column, heading: Column | None = None, in_bibliography: Column | None = None) -> Column:
    """The key in REASONS of why a block is not translated, or null. A heading is never a byline or an affiliation."""
    no = F.lit(False)
    head, inside = (F.coalesce(x, no) if x is not None else no for x in (heading, in_bibliography))
    t = F.regexp_replace(F.regexp_replace(F.coalesce(source, F.lit("")), r"(?U)\x{AD}\s*", ""), r"(?U)^\s+|\s+$", "")
    listed = (inside & ~head & ~t.rlike(NARRATIVE)) | t.rlike(ARXIV) | (t.rlike(BRACKET_REF) & t.rlike(YEAR) & ~t.rlike(NARRATIVE)) | is_bibliography_entry(t)
    return (
        F.when(t == "", None).when(t.rlike(HANDLE), "handle").when(listed, "bibliography").when(~head & is_byline(t), "byline").when(~head & is_identity(t), "identity")
        .when(~contains_cjk(t) & ~t.rlike(WORD), "debris")
    )
