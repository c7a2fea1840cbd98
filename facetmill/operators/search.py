"""Keyword search: BM25, alias expansion, AND with OR as a fallback, pages, groups and tags.

A request becomes one DataFrame of hits; total, page, facets and groups derive from it. Nothing is
collected: where the plan depends on data (does any row match all terms?) a one-row aggregate is
joined back.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import alias_key, let, parse_query, unique_in_order
from ..plans.spec import MOST_PAGE_SIZE, PAGE_SIZE, SearchConfig, order_by, page_of, resolve_sort
from . import facets as facet_ops
from . import highlight
from .predicates import empty_record, filtered, keyword, keyword_mode, manual_source, parse_filters, phrase

MOST_ALIASES = 20


def bm25(df: DataFrame, columns: Sequence[str], term: str, k1: float = 1.2, b: float = 0.75, keep_all: bool = False) -> DataFrame:
    """Rows that contain the term with ``score``, negative so that smaller is better; all rows, others' score null, with ``keep_all``.

    Lengths and occurrences count trigrams as an index does: a text of n characters has n - 2 of
    them, and occurrences may overlap. Corpus statistics cover the whole table, not the matches.
    """
    needle = F.lit(term.lower())
    texts = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    # A look-ahead matches nothing itself, so its matches count overlapping occurrences.
    ahead = F.lit("(?=" + re.sub(r"[\\^$.|?*+()\[\]{}]", r"\\\g<0>", term.lower()) + ")")
    tf = reduce(lambda x, y: x + y, [let(t, lambda x: F.when(F.contains(x, needle), F.regexp_count(x, ahead)).otherwise(0)) for t in texts])
    dl = reduce(lambda x, y: x + y, [F.greatest(F.length(F.coalesce(F.col(c).cast("string"), F.lit(""))) - 2, F.lit(0)) for c in columns])
    scored = df.withColumn("_tf", tf).withColumn("_dl", dl)
    stats = scored.agg(F.count(F.lit(1)).alias("_n"), F.avg("_dl").alias("_avg"), F.count_if(F.col("_tf") > 0).alias("_hit"))
    # The statistics are one row, whatever the table's size.
    joined = (scored if keep_all else scored.filter(F.col("_tf") > 0)).join(F.broadcast(stats))
    idf = F.log((F.col("_n") - F.col("_hit") + 0.5) / (F.col("_hit") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    weight = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    return joined.withColumn("score", F.when(F.col("_tf") > 0, -idf * weight)).drop("_tf", "_dl", "_n", "_avg", "_hit")


# Index ----------------------------------------------------------------------------------------


def write_postings(df: DataFrame, config: SearchConfig, path: str, buckets: int = 64) -> None:
    """An index of trigrams: (gram, id) for each distinct trigram of the phrase columns' lower case, in files by bucket of the gram."""
    grams = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("(?s)(?=(.{3}))"), 1)
    rows = df.select(F.col(config.id).alias("id"), F.explode(F.array_distinct(F.concat(*map(grams, config.phrase_columns)))).alias("gram"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("gram"), F.lit(buckets)).cast("int"))
    rows.repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def indexed(df: DataFrame, config: SearchConfig, postings: DataFrame, term: str, buckets: int = 64) -> DataFrame:
    """Rows of ``df`` with the term in a phrase column: ids from the files of its trigrams alone, then the exact test.

    ``postings`` is what ``write_postings`` wrote. A term under three characters has no trigram; it is looked for in all rows.
    """
    test = phrase(config.phrase_columns, term)
    grams = sorted({term.lower()[i : i + 3] for i in range(len(term) - 2)})
    if not grams:
        return df.filter(test)
    spark = df.sparkSession
    # The buckets of a few trigrams, by the same hash: one row.
    own = {r[0] for r in spark.range(1).select(F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(g)), F.lit(buckets)).cast("int") for g in grams]))).collect()}
    hits = postings.filter(F.col("bucket").isin(sorted(own)) & F.col("gram").isin(grams)).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    ids = hits.filter(F.col("n") == len(grams)).select(F.col("id").alias(config.id))
    return df.join(ids, config.id, "left_semi").filter(test)


# Aliases --------------------------------------------------------------------------------------


def alias_groups(document: Mapping[str, object]) -> list[tuple[str, list[str]]]:
    """Canonical term and all terms of each group, from any of the accepted shapes.

    ``groups`` holds {canonical, aliases}, {term, variants} or a plain list; ``aliases`` maps an alias
    to one or several main terms. Groups with less than two terms are dropped, longer ones cut.
    """
    out: list[tuple[str, list[str]]] = []
    for g in document.get("groups") or []:  # type: ignore[attr-defined]
        if isinstance(g, Mapping):
            main = g.get("canonical") or g.get("term")
            terms = [main, *(g.get("aliases") or g.get("variants") or [])]
        else:
            terms = list(g)
        out.append((str(terms[0]), unique_in_order(terms)[:MOST_ALIASES]))
    for alias, mains in (document.get("aliases") or {}).items():  # type: ignore[attr-defined]
        out += [(str(m), unique_in_order([m, alias])) for m in (mains if isinstance(mains, (list, tuple)) else [mains])]
    return [(c, t) for c, t in out if len(t) > 1]


def expand_terms(terms: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, list[str]]]:
    """Each term with its variants, itself first, then those of all groups it is in."""
    by_key: dict[str, list[str]] = {}
    for _, members in groups:
        for m in members:
            by_key.setdefault(alias_key(m), []).extend(members)
    out = []
    for term in terms:
        seen, variants = set(), []
        for v in [term, *by_key.get(alias_key(term), [])]:
            if alias_key(v) not in seen:
                seen.add(alias_key(v))
                variants.append(v)
        out.append((term, variants))
    return out


def expand_column(df: DataFrame, term: str, aliases: DataFrame) -> DataFrame:
    """``df`` with ``variants``, by joining a table of (term_norm, group_terms)."""
    merged = aliases.groupBy("term_norm").agg(F.flatten(F.collect_list("group_terms")).alias("more"))
    out = df.join(merged, F.lower(F.regexp_replace(df[term], r"(?U)\s+", "")) == merged["term_norm"], "left")
    return out.withColumn("variants", F.array_distinct(F.concat(F.array(term), F.coalesce("more", F.array().cast("array<string>"))))).drop("more", "term_norm")


# Terms ----------------------------------------------------------------------------------------


def term_hits(config: SearchConfig, expanded: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Positions (from 0) of the terms that a row matches in any variant."""
    found = [F.when(reduce(lambda a, b: a | b, [keyword(config, v) for v in variants]), F.lit(i)) for i, (_, variants) in enumerate(expanded)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def and_or(df: DataFrame, config: SearchConfig, expanded: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Rows that match all terms; if there are none, those that match any. With ``hits`` and ``mode``."""
    rows = df.withColumn("_terms", term_hits(config, expanded)).withColumn("hits", F.size("_terms")).filter("hits > 0")
    most = rows.agg(F.max("hits").alias("_most"))  # one row
    k = len(expanded)
    return rows.join(F.broadcast(most)).filter((F.col("_most") < k) | (F.col("hits") == k)).withColumn("mode", F.when(F.col("_most") == k, "and").otherwise("or")).drop("_most")


def group_totals(df: DataFrame, config: SearchConfig, expanded: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """term and how many rows match it, terms without matches included."""
    spark = df.sparkSession
    terms = spark.range(len(expanded)).select(F.col("id").cast("int").alias("position"), F.element_at(F.array(*[F.lit(t) for t, _ in expanded]), F.col("id").cast("int") + 1).alias("term"))
    counts = df.select(F.explode(term_hits(config, expanded)).alias("position")).groupBy("position").agg(F.count(F.lit(1)).alias("n"))
    return terms.join(counts, "position", "left").select("term", F.coalesce("n", F.lit(0)).alias("total"))


def fuzzy_union(df: DataFrame, config: SearchConfig, variants: Sequence[str]) -> DataFrame:
    """Rows by the first variant that they match (``variant``), and whether any row needs an alias (``by_alias``).

    ``fuzzy_order`` sorts them; no task holds a variant's rows.
    """
    first = F.coalesce(*[F.when(keyword(config, v), F.lit(i)) for i, v in enumerate(variants)])
    rows = df.withColumn("variant", first).filter(F.col("variant").isNotNull())
    return rows.join(F.broadcast(rows.agg((F.coalesce(F.max("variant"), F.lit(0)) > 0).alias("by_alias"))))  # one row


def fuzzy_order(config: SearchConfig, sort: str = "relevance", score: str | None = None) -> list[Column]:
    """Exact hits before alias hits, each in its order; where no row needs an alias, by relevance as in a plain search."""
    plain = [F.when(~F.col("by_alias"), F.col(score)).asc_nulls_last()] if score and sort == "relevance" else []
    return [F.col("variant"), *plain, *order_by(config, sort)]


# Requests -------------------------------------------------------------------------------------


@dataclass
class SearchResult:
    """Lazy sections of one answer."""

    terms: list[str]
    sort: str
    mode: str
    matched: DataFrame
    page: DataFrame
    envelope: DataFrame
    facets: DataFrame | None
    groups: DataFrame | None
    tags: list[tuple[str, str]]
    highlight: DataFrame


def search(df: DataFrame, config: SearchConfig, q: str = "", filters: Mapping[str, object] | None = None, sort: str | None = None, page: object = 1, size: object = None, groups: Sequence[tuple[str, Sequence[str]]] = (), with_facets: bool = True, most_candidates: int | None = None) -> SearchResult:
    """A request's sections. One term is a plain or, with aliases that add rows, an ordered fuzzy search;
    several terms are AND with OR as the fallback. ``most_candidates`` keeps the best rows of a match
    only, as an index with a limit does; without it all count.
    """
    terms, wanted = parse_query(q), parse_filters(config, filters)
    sort = resolve_sort(sort, bool(terms))
    number, n = page_of(page, size)
    expanded = expand_terms(terms, groups)
    facets = None
    if len(terms) > 1:
        matched, mode = and_or(filtered(df, config, wanted), config, expanded), "and/or"
        order = [F.when(F.col("mode") == "or", -F.col("hits")).otherwise(0), F.when(F.col("mode") == "or", F.col(config.id)), *order_by(config, sort)]
        facet_rows, facet_filters = matched, {}
    elif terms and len(expanded[0][1]) > 1:
        phrases = keyword_mode(terms[0]) == "fts" and sort == "relevance"
        base = bm25(df, config.phrase_columns, terms[0], keep_all=True) if phrases else df
        matched, mode = fuzzy_union(filtered(base, config, wanted), config, expanded[0][1]), "fuzzy"
        order = fuzzy_order(config, sort, "score" if phrases else None)
        facet_rows, facet_filters = matched, {}
    else:
        term = terms[0] if terms else ""
        mode = keyword_mode(term)
        hits = df.filter(keyword(config, term))
        facet_rows, facet_filters = hits, wanted
        score = "score" if mode == "fts" and sort == "relevance" else None
        base = bm25(df, config.phrase_columns, term) if score else hits
        matched = filtered(base, config, wanted)
        order = order_by(config, sort, score)
    if most_candidates is not None:
        matched = matched.orderBy(*order).limit(most_candidates)
        facet_rows = facet_rows.join(matched.select(config.id), config.id, "left_semi") if not facet_filters else facet_rows
    if with_facets:
        facets = facet_ops.marked(facet_ops.exclude_self(facet_rows, config, facet_filters), wanted)
    shown = matched.orderBy(*order).offset((number - 1) * n).limit(n)
    variants = unique_in_order(v for _, vs in expanded for v in vs)
    return SearchResult(
        terms, sort, mode, matched, shown, envelope(matched, number, n), facets,
        group_totals(filtered(df, config, wanted), config, expanded) if len(terms) > 1 else None,
        [(d, v) for d, vs in wanted.items() for v in vs], highlighted(shown, config, variants),
    )


def highlighted(rows: DataFrame, config: SearchConfig, terms: Sequence[str]) -> DataFrame:
    """id and ``highlight``: marked fields, which of them match, a snippet of the body, and the terms found."""
    fields = {c: F.col(c).cast("string") for c in config.text_columns if c != config.body}
    body = F.col(config.body).cast("string") if config.body and config.body in rows.columns else F.lit(None).cast("string")
    return rows.select(config.id, highlight.build(fields, body, terms).alias("highlight"))


def envelope(matched: DataFrame, page: int, size: int) -> DataFrame:
    """total, page, page_size, pages, has_prev, has_next as one row."""
    pages = F.ceil(F.col("total") / size).cast("long")
    return matched.agg(F.count(F.lit(1)).alias("total")).select("total", F.lit(page).cast("long").alias("page"), F.lit(size).cast("long").alias("page_size"), pages.alias("pages"), F.lit(page > 1).alias("has_prev"), (F.lit(page) < pages).alias("has_next"))


def detail(df: DataFrame, config: SearchConfig, ident: int) -> DataFrame:
    return df.filter(F.col(config.id) == ident)


def detail_page(df: DataFrame, config: SearchConfig, ident: int, texts: DataFrame | None = None, stem: str = "stem") -> DataFrame:
    """One record with its escaped fields and, if there is a table of them (``stem``, source_text), its source's whole text."""
    one = detail(df, config, ident)
    out = one.join(highlighted(one, config, ()), config.id)
    return out.join(texts, stem, "left") if texts is not None else out


# Overviews ------------------------------------------------------------------------------------


def health(df: DataFrame, config: SearchConfig, image: str | None = None, released: str | None = None, empty: Sequence[str] = ()) -> DataFrame:
    """One row: records, images (manual sources aren't any), latest release, records without any of the ``empty`` columns."""
    null = F.lit(None)
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        (F.count_distinct(F.when(~manual_source(F.col(image)), F.col(image))) if image else null.cast("long")).alias("images"),
        (F.max(F.when(F.col(released) != "", F.col(released))) if released else null.cast("string")).alias("latest_release_time"),
        (F.count_if(empty_record(*map(F.col, empty))) if empty else F.lit(0)).cast("long").alias("empty_records"),
    )


def overview(df: DataFrame, config: SearchConfig, top: int = 15, by_value: Sequence[str] = (), whole: Sequence[str] = ()) -> DataFrame:
    """dim, value, n, rank of each dimension: most frequent first, or by value for ``by_value``; ``top`` of each but ``whole`` ones."""
    counts = facet_ops.counted(df, config.dimensions)
    ascending = F.col("dim").isin(*by_value) if by_value else F.lit(False)
    order = Window.partitionBy("dim").orderBy(F.when(ascending, F.lit(0)).otherwise(-F.col("n")), "value")
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.filter((F.col("rank") <= top) | F.col("dim").isin(*by_value, *whole)) if by_value or whole else ranked.filter(F.col("rank") <= top)


def alias_pairs(groups: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, str]]:
    """(alias, canonical term) of all groups."""
    return [(t, c) for c, terms in groups for t in terms if t != c]


def service_config(config: SearchConfig, groups: Sequence[tuple[str, Sequence[str]]] = (), source: str = "") -> dict:
    """What a client needs to build requests: dimensions, sorts, page sizes and the alias table's state."""
    return {
        "dimensions": list(config.dimensions), "numeric": list(config.numeric), "sorts": ["relevance", "cohort_desc", "cohort_asc", "name_pinyin", "confidence_desc"],
        "page_size": PAGE_SIZE, "most_page_size": MOST_PAGE_SIZE, "pinyin": config.pinyin is not None,
        "fuzzy": {"path": source, "groups": len(groups), "aliases": len(alias_pairs(groups)), "available": bool(groups)},
    }


def completions(df: DataFrame, config: SearchConfig, dims: Sequence[str], groups: Sequence[tuple[str, Sequence[str]]] = (), needle: str = "", limit: int = 300) -> DataFrame:
    """kind, value, target for a search box: values of dimensions, most frequent first, then aliases with their canonical term."""
    found = facet_ops.distributions(df, {d: config.dimensions[d] for d in dims}, limit)
    values = found.select(F.col("dim").alias("kind"), "value", F.lit(None).cast("string").alias("target"), F.col("rank").alias("at"))
    rows = [("alias", a, c, i) for i, (a, c) in enumerate(alias_pairs(groups), 1)]
    both = values.unionByName(df.sparkSession.createDataFrame(rows, "kind string, value string, target string, at int"))
    near = both if not needle else both.filter(F.contains(F.lower("value"), F.lit(needle.lower())))
    place = F.array_position(F.array(*map(F.lit, [*dims, "alias"])), F.col("kind"))
    return near.orderBy(place, "at").select("kind", "value", "target")
