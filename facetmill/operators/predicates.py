"""Filters and keyword predicates as Columns."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_latin_text, unique_in_order
from ..plans.spec import SearchConfig


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, list(conditions), F.lit(True))


def nonblank(c: Column) -> Column:
    """Neither null nor '' (numbers: not null), without a cast that ANSI mode would refuse."""
    return c.isNotNull() & (c.cast("string") != "")


def like(c: Column, keyword: str) -> Column:
    """``LIKE '%keyword%'`` with wildcards escaped, folding A-Z only: Java's plain (?i), which makes no copy of the text."""
    return c.cast("string").rlike("(?i)" + re.sub(r"[\\^$.|?*+()\[\]{}]", r"\\\g<0>", keyword))


def like_any(columns: Sequence[str], keyword: str) -> Column:
    return any_of(like(F.col(c), keyword) for c in columns)


def phrase(columns: Sequence[str], keyword: str) -> Column:
    """Substring of any column with Unicode case folding, as a trigram index matches a phrase."""
    return any_of(F.contains(F.lower(F.col(c)), F.lit(keyword.lower())) for c in columns)


def pinyin(full: str, initials: str, keyword: str) -> Column:
    """Up to two letters begin the initials; longer ones lie in the spelling or are the initials."""
    q = re.sub("[^a-z0-9]+", "", keyword.lower())
    if not q:
        return F.lit(False)
    if len(q) <= 2:
        return F.coalesce(F.startswith(F.col(initials), F.lit(q)), F.lit(False))
    return any_of([F.contains(F.col(full), F.lit(q)), F.col(initials) == q])


def keyword_mode(keyword: str) -> str:
    keyword = keyword.strip()
    if not keyword:
        return "all"
    if is_latin_text(keyword):
        return "pinyin"
    return "fts" if len(keyword) >= 3 else "like"


def keyword(config: SearchConfig, text: str) -> Column:
    """Routes a keyword: phrase match from three characters on unless it is Latin, else LIKE, and pinyin if Latin."""
    text, mode = (text or "").strip(), keyword_mode(text or "")
    if mode == "all":
        return F.lit(True)
    if mode == "fts":
        return phrase(config.phrase_columns, text)
    found = like_any(config.text_columns, text)
    if mode == "pinyin" and config.pinyin:
        return found | pinyin(*config.pinyin, text)
    return found


def parse_filters(config: SearchConfig, filters: Mapping[str, object] | None) -> dict[str, list[str]]:
    """Scalars as lists; unknown dimensions, blanks and repeats dropped."""
    out = {}
    for dim in config.dimensions:
        value = (filters or {}).get(dim)
        many = unique_in_order(value if isinstance(value, (list, tuple, set)) else [value])
        if many:
            out[dim] = many
    return out


def merge_legacy(filters: Mapping[str, object] | None, **single: object) -> dict[str, list[str]]:
    """Filters joined with single-valued arguments; a scalar stays one value."""
    out = {k: [*v] if isinstance(v, (list, tuple, set)) else [v] for k, v in (filters or {}).items()}
    for dim, value in single.items():
        if value is not None and str(value).strip():
            out.setdefault(dim, []).append(value)
    return {k: unique_in_order(v) for k, v in out.items()}


def dimension(config: SearchConfig, dim: str, values: Sequence[str]) -> Column | None:
    """Values of one dimension, OR-ed. Numeric ones that aren't numbers are dropped; none left: no clause."""
    column = F.col(config.dimensions[dim])
    if dim in config.numeric:
        numbers = [int(v) for v in values if re.fullmatch(r"\s*[+-]?\d+\s*", str(v))]
        return column.isin(numbers) if numbers else None
    return column.isin(list(values)) if values else None


def clauses(config: SearchConfig, filters: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """A clause for each filtered dimension; null is false."""
    found = {d: dimension(config, d, v) for d, v in filters.items()}
    return {d: F.coalesce(c, F.lit(False)) for d, c in found.items() if c is not None}


def filtered(df: DataFrame, config: SearchConfig, filters: Mapping[str, Sequence[str]], skip: str | None = None) -> DataFrame:
    """All dimensions AND-ed, but for one that can be skipped."""
    return df.filter(all_of(c for d, c in clauses(config, filters).items() if d != skip))


def confident(df: DataFrame, config: SearchConfig, least: float) -> DataFrame:
    """Rows with a confidence from ``least`` on."""
    return df.filter(F.col(config.confidence) >= least)


def in_ids(df: DataFrame, ids: DataFrame | Sequence[object], id_col: str) -> DataFrame:
    """Rows whose id is in a set; values that aren't whole numbers are dropped; an empty set keeps nothing."""
    if not isinstance(ids, DataFrame):
        good = sorted({int(i) for i in ids if re.fullmatch(r"[+-]?\d+", str(i).strip())})
        return df.filter(F.col(id_col).isin(good)) if good else df.filter(F.lit(False))
    return df.join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], id_col).distinct(), id_col, "left_semi")


def manual_source(image: Column) -> Column:
    return F.coalesce(F.startswith(image, F.lit("manual:")), F.lit(False))


def placeholder_url(url: Column, markers: Sequence[str] = ("spacer.gif", "blank.gif", "placeholder", "loading")) -> Column:
    url = F.coalesce(F.trim(url), F.lit(""))
    return (url == "") | F.startswith(url, F.lit("data:")) | any_of(F.contains(url, F.lit(m)) for m in markers)


def empty_record(*columns: Column) -> Column:
    return all_of(~nonblank(c) for c in columns)


def header_row(cells: Column, name: Column, tokens: Sequence[str], like_cells: int = 3) -> Column:
    """A repeated header: no name, a name that is a header word, or several cells that are."""
    words = F.array(*map(F.lit, tokens))
    hits = F.size(F.filter(cells, lambda c: F.array_contains(words, F.lower(F.trim(c)))))
    return ~nonblank(name) | F.array_contains(words, F.lower(F.trim(name))) | (hits >= like_cells)
