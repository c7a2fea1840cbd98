"""What a relation offers to search, and how a request becomes sorting and paging."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE_SIZE, MOST_PAGE_SIZE = 20, 100


@dataclass(frozen=True)
class SearchConfig:
    """Names of a relation's columns by role; the defaults are those of the record table."""

    id: str = "id"
    name: str = "name"
    year: str = "cohort_year"
    confidence: str = "confidence"
    sort_name: str = "name_pinyin"
    dimensions: Mapping[str, str] = field(default_factory=lambda: {d: d for d in ("province", "city", "college", "cohort_year", "position_category", "degree_level", "major")})
    numeric: Sequence[str] = ("cohort_year",)
    text_columns: Sequence[str] = ("name", "cohort", "college", "major", "destination_org", "city", "province", "position", "degree", "raw_text")
    phrase_columns: Sequence[str] = ("name", "cohort", "college", "major", "destination_org", "city", "province", "position", "degree", "raw_text", "notice_title")
    pinyin: tuple[str, str] | None = ("name_pinyin", "name_initials")
    #: The long text that snippets come from; it isn't marked as a whole.
    body: str | None = "raw_text"


def page_of(page: object, size: object) -> tuple[int, int]:
    """Page from 1 and size from 1 to its limit; what isn't a number counts as the default."""

    def number(x: object, default: int) -> int:
        try:
            return int(x)  # type: ignore[call-overload]
        except (TypeError, ValueError):
            return default

    return max(1, number(page, 1)), min(MOST_PAGE_SIZE, max(1, number(size, PAGE_SIZE)))


def n_pages(total: int, size: int) -> int:
    return math.ceil(total / size) if total else 0


def resolve_sort(sort: str | None, has_terms: bool) -> str:
    """A blank sort is relevance for a search and the default order without one; unknown ones are kept."""
    return (sort or "").strip() or ("relevance" if has_terms else "cohort_desc")


def order_by(config: SearchConfig, sort: str, score: str | None = None) -> list[Column]:
    """Sort keys, ties broken by id. Relevance without a score, and unknown sorts, go by confidence."""
    year, confidence, ident = F.col(config.year), F.col(config.confidence), F.col(config.id).asc()
    if sort == "cohort_desc":
        return [year.desc_nulls_last(), confidence.desc_nulls_last(), ident]
    if sort == "cohort_asc":
        return [year.asc_nulls_first(), confidence.desc_nulls_last(), ident]
    if sort == "name_pinyin":
        return [F.col(config.sort_name).asc_nulls_first(), F.col(config.name).asc_nulls_first(), ident]
    if sort == "relevance" and score:
        return [F.col(score).asc_nulls_last(), confidence.desc_nulls_last(), ident]
    return [confidence.desc_nulls_last(), year.desc_nulls_last(), ident]
