"""Text functions as Column expressions, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C

WORD = r"[\p{L}\p{N}_]"
TOKEN = rf"{WORD}+(?:-{WORD}+)*"
BOUNDARY = r"(?<=[.!?])(?U:\s+)(?=[A-Z\"(\[])"
_DOT = "\u0001"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """Join words that a line break hyphenated, make every gap one blank, strip."""
    return strip(F.regexp_replace(F.regexp_replace(text, rf"(?U)({WORD})-\s+({WORD})", "$1$2"), r"(?U)\s+", " "))


def _mask(text: Column) -> Column:
    """Hide the dots of abbreviations; patterns begin with the dot, so that nothing is tried at other characters."""
    one = "|".join(x for x in C.ABBREVIATIONS if "." not in x)
    for x in (x for x in C.ABBREVIATIONS if "." in x):
        a, b = x.split(".")
        text = F.regexp_replace(text, rf"(?iU)\.(?<=\b{a}\.)({b})\.", f"{_DOT}$1{_DOT}")
    return F.regexp_replace(text, rf"(?iU)\.(?<=\b(?:{one})\.)", _DOT)


def sentences(text: Column) -> Column:
    """Array of sentences longer than 12 characters; the whole text if there is none, nothing for a blank text."""
    parts = F.transform(F.split(_mask(text), BOUNDARY), lambda x: strip(F.translate(x, _DOT, ".")))
    found = F.filter(parts, lambda x: F.length(x) > C.SENTENCE_MORE_THAN)
    whole = strip(text)
    or_whole = lambda x: F.when(F.size(x) > 0, x).when(F.length(whole) > 0, F.array(whole)).otherwise(F.array().cast("array<string>"))
    return F.get(F.transform(F.array(found), or_whole), 0)  # the parts are bound, and so found once


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords(text: Column) -> Column:
    """Distinct tokens of two characters or more that are no stop words."""
    return F.array_except(F.array_distinct(F.filter(tokens(text), lambda t: F.length(t) > 1)), F.array(*[F.lit(w) for w in C.KEYWORD_STOPWORDS]))


def keyword_ids(text: Column) -> Column:
    """The keywords by 64 bits each, which are compared faster than words."""
    return F.transform(keywords(text), lambda t: F.xxhash64(t))


def keyword_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct keywords; 0 if both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared).cast("double")), F.lit(0.0))


def is_negation(text: Column) -> Column:
    return F.coalesce(text.rlike("(?iU)" + "|".join(C.NEGATION_TRIGGERS)), F.lit(False))


def is_reference_heading(text: Column) -> Column:
    return F.coalesce(text.rlike(rf"(?iU)^\s*({'|'.join(C.REFERENCE_HEADINGS)})\s*$"), F.lit(False))


def claims(text: Column) -> Column:
    """Sentences of an answer; a part after an abbreviation that begins with a capital or digit joins the part before.

    The abbreviation is looked for at the end of the part before alone, so a fold over the parts is one pass.
    """
    tail = rf"(?iU)\b(?:{'|'.join(C.CLAIM_ABBREVIATIONS)})\.?\s*$"
    parts = F.split(strip(text), BOUNDARY)

    def step(acc: Column, part: Column) -> Column:
        last = F.element_at(acc, -1)
        goes_on = (F.size(acc) > 0) & last.rlike(tail) & part.rlike(r"^[\p{Lu}\p{Nd}]")
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws(" ", F.regexp_replace(last, r"(?U)\s+$", ""), part)))
        return F.when(goes_on, joined).otherwise(F.concat(acc, F.array(part)))

    merged = F.aggregate(F.slice(parts, 2, 1_000_000_000), F.slice(parts, 1, 1), step)
    return F.filter(F.transform(merged, strip), lambda x: F.length(x) > 0)


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def highlight_terms(text: Column, most: int = 12) -> Column:
    """The first distinct terms of three characters or more that are no stop words, in their order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[A-Za-z0-9\-_/]+"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in C.HIGHLIGHT_STOPWORDS])
    return F.slice(F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))), 1, most)


def highlight_phrases(sentence: Column) -> Column:
    """The first three words of five characters or more; none for a sentence under ten characters."""
    found = F.slice(F.regexp_extract_all(sentence, F.lit(rf"{WORD}{{5,}}"), F.lit(0)), 1, 3)
    return F.when(F.length(sentence) >= 10, found).otherwise(F.array().cast("array<string>"))


def link_citations(text: Column) -> Column:
    """Turn ``[p. N]`` into an anchor."""
    return F.regexp_replace(text, r"\[p\.\s*(\d+)\]", '<a href="page:$1">[p. $1]</a>')


def preview(text: Column, limit: int, tail: str = "...") -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - len(tail)), F.lit(tail))).otherwise(text)


def parse_link(link: Column) -> Column:
    """scheme, page and section of ``scheme:page?section=...``."""
    return F.struct(
        F.regexp_extract(link, r"^([a-z]+):", 1).alias("scheme"),
        F.regexp_extract(link, r"^[a-z]+:(\d+)", 1).try_cast("int").alias("page"),
        F.url_decode(F.replace(F.regexp_extract(link, r"[?&]section=([^&]*)", 1), F.lit("+"), F.lit("%2B"))).alias("section"),
    )


def link(page: Column, section: Column) -> Column:
    return F.concat(F.lit("page:"), page.cast("string"), F.lit("?section="), F.replace(F.url_encode(section), F.lit("+"), F.lit("%20")))
