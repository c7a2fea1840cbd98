"""Marking of matches in HTML-escaped text, and snippets around the first one."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.classify import pinyin_matches
from ..functions.text import escape_html, unique_in_order

WINDOW = 160
_META = re.compile(r"[\\^$.|?*+()\[\]{}]")


def pattern(terms: Sequence[str]) -> str:
    """One alternation of all terms, longest first, ignoring case; '' without terms."""
    unique = sorted(unique_in_order(terms), key=len, reverse=True)
    return "(?iu)(" + "|".join(_META.sub(r"\\\g<0>", t) for t in unique) + ")" if unique else ""


def mark(text: Column, terms: Sequence[str]) -> Column:
    """Escaped text with every match wrapped. Matching follows escaping, so a term with & or < finds nothing."""
    found = pattern(terms)
    return F.regexp_replace(escape_html(text), found, "<mark>$1</mark>") if found else escape_html(text)


def snippet(text: Column, terms: Sequence[str], window: int = WINDOW) -> Column:
    """``window`` characters centred on the first match, with an ellipsis where text is cut; null without a match."""
    body, found = F.trim(F.coalesce(text, F.lit(""))), pattern(terms)
    dots = F.lit("…")
    if not found:
        return F.when(body != "", F.concat(escape_html(F.substring(body, 1, window)), F.when(F.length(body) > window, dots).otherwise("")))
    at = F.regexp_instr(body, F.lit(found)) - 1
    size = F.length(F.regexp_extract(body, found, 1))
    start = F.greatest(F.lit(0), at - F.floor((F.lit(window) - size) / 2).cast("int"))
    stop = F.least(F.length(body), start + window)
    cut = F.substring(body, start + 1, stop - start)
    return F.when((body != "") & (at >= 0), F.concat(F.when(start > 0, dots).otherwise(""), mark(cut, terms), F.when(stop < F.length(body), dots).otherwise("")))


def effective_terms(terms: Sequence[str], name: Column, full: Column, initials: Column) -> Column:
    """The terms, and the name itself if one of them matches it by pinyin."""
    out = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")
    hit = F.lit(False)
    for t in terms:
        hit = hit | F.coalesce(pinyin_matches(full, initials, t), F.lit(False))
    return F.when(hit, F.array_union(out, F.array(name))).otherwise(out)


def build(fields: Mapping[str, Column], body: Column, terms: Sequence[str]) -> Column:
    """struct(html by field, matched_fields in the order given, snippet, matched_terms)."""
    found = pattern(terms)
    html = F.create_map(*[x for k, c in fields.items() for x in (F.lit(k), mark(c, terms))])
    hits = F.filter(F.array(*[F.when(escape_html(c).rlike(found), F.lit(k)) for k, c in fields.items()]), lambda x: x.isNotNull()) if found else F.array().cast("array<string>")
    everything = F.lower(F.concat_ws("\n", *[c.cast("string") for c in fields.values()], body))
    matched = F.filter(F.array(*[F.when(F.contains(everything, F.lit(t.lower())), F.lit(t)) for t in terms]), lambda x: x.isNotNull()) if terms else F.array().cast("array<string>")
    return F.struct(html.alias("html"), hits.alias("matched_fields"), snippet(body, terms).alias("snippet"), matched.alias("matched_terms"))
