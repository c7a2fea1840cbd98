"""Keyed loads, ordered windows, layout clustering, rule application and gazetteer joins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Keyed loads ----------------------------------------------------------------------------------


def upsert(stored: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored rows whose key isn't in ``new``, and all of ``new``; missing columns become null."""
    return stored.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def replace_group(stored: DataFrame, new: DataFrame, key: str, ordinal: str, order: Sequence[str]) -> DataFrame:
    """All rows of the keys in ``new`` give way to it; missing ordinals follow ``order`` from 0."""
    number = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    new = new.withColumn(ordinal, F.coalesce(F.col(ordinal), number) if ordinal in new.columns else number)
    return upsert(stored, new, [key])


def overlay(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``right``'s values where it has the key, nulls included, else ``left``'s."""
    other = right.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in columns])
    out = left.join(other, key, "left")
    return out.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in left.columns])


def latest(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_rank = 1").drop("_rank")


def stable_ids(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids from 1 in a total order. Partition counts are summed first, so no task holds all rows.

    Rows are dealt into ranges of the order; a row's id is the number of rows in earlier ranges
    plus its number within its own.
    """
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    numbered = ranged.withColumn("_within", within)
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return numbered.join(sizes.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_within", "_before")


# Ordered windows ------------------------------------------------------------------------------


def ordinals(df: DataFrame, key: str, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def blocks(df: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """``block`` from 1 at each start. Rows before a key's first start go; a key without start is block 0."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(upto)).withColumn("_any", F.max(F.when(starts, 1).otherwise(0)).over(Window.partitionBy(key)))
    return out.filter((F.col("block") > 0) | (F.col("_any") == 0)).drop("_any")


def cut_after(df: DataFrame, key: str, order: str, stop: Column) -> DataFrame:
    """Rows before a key's first stop."""
    first = F.min(F.when(stop, F.col(order))).over(Window.partitionBy(key))
    return df.withColumn("_stop", first).filter(F.col("_stop").isNull() | (F.col(order) < F.col("_stop"))).drop("_stop")


def with_next(df: DataFrame, key: str, order: str, column: str, name: str = "next") -> DataFrame:
    return df.withColumn(name, F.lead(column).over(Window.partitionBy(key).orderBy(order)))


def upper_median(df: DataFrame, key: str, value: str, ties: Sequence[str] = ()) -> DataFrame:
    """``sorted[n // 2]`` of each key. Values are counted first, so a hot key is a histogram, not its rows."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(key).orderBy(value)
    ranked = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("_all", F.sum("_c").over(Window.partitionBy(key)))
    return ranked.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(key).agg(F.min(value).alias("median"))


# Layout ---------------------------------------------------------------------------------------


def running_clusters(values: Column, gap: Column) -> Column:
    """Cluster numbers of sorted values: a value joins the current cluster within ``gap`` of its mean so far."""
    start = F.struct(F.lit(None).cast("double").alias("mean"), F.lit(0).alias("n"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        joins = acc["mean"].isNotNull() & (F.abs(x - acc["mean"]) <= gap)
        ident = F.when(joins, F.element_at(acc["ids"], -1)).otherwise(F.when(F.size(acc["ids"]) == 0, 0).otherwise(F.element_at(acc["ids"], -1) + 1))
        return F.struct(
            F.when(joins, (acc["mean"] * acc["n"] + x) / (acc["n"] + 1)).otherwise(x).alias("mean"),
            F.when(joins, acc["n"] + 1).otherwise(1).alias("n"),
            F.concat(acc["ids"], F.array(ident.cast("int"))).alias("ids"),
        )

    return F.aggregate(values, start, step, lambda acc: acc["ids"])


def box_frame(box: Column) -> Column:
    """struct(left, top, right, bottom, cx, cy, width, height) of an array of [x, y] points; null without points."""
    xs, ys = F.transform(box, lambda p: p[0]), F.transform(box, lambda p: p[1])
    left, right, top, bottom = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    frame = F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"), ((left + right) / 2).alias("cx"), ((top + bottom) / 2).alias("cy"), (right - left).alias("width"), (bottom - top).alias("height"))
    return F.when(F.size(box) > 0, frame)


def reading_order(lines: Column) -> Column:
    """Rows of texts of an array<struct<text, box>>: top to bottom, in a row left to right.

    A line joins the current row if its centre is within max(4, 0.6 median height) of the row's mean;
    lines without a box follow as rows of their own.
    """
    framed = F.transform(lines, lambda x: F.struct(x["text"].alias("text"), box_frame(x["box"]).alias("f")))
    placed = F.array_sort(F.transform(F.filter(framed, lambda x: x["f"].isNotNull()), lambda x, i: F.struct(x["f"]["cy"].alias("cy"), x["f"]["left"].alias("left"), i.alias("i"), x["f"]["height"].alias("height"), x["text"].alias("text"))))
    heights = F.array_sort(F.transform(placed, lambda x: x["height"]))
    middle = F.get(heights, F.floor(F.size(heights) / 2).cast("int"))
    ids = running_clusters(F.transform(placed, lambda x: x["cy"]), F.greatest(F.lit(4.0), middle * 0.6))
    keyed = F.array_sort(F.transform(placed, lambda x, i: F.struct(F.get(ids, i).alias("row"), x["left"].alias("left"), i.alias("i"), x["text"].alias("text"))))
    rows = F.transform(F.array_distinct(ids), lambda r: F.transform(F.filter(keyed, lambda x: x["row"] == r), lambda x: x["text"]))
    loose = F.transform(F.filter(framed, lambda x: x["f"].isNull()), lambda x: F.array(x["text"]))
    return F.concat(rows, loose)


def rows_as_text(rows: Column, between: str = " ") -> Column:
    return F.transform(rows, lambda r: F.array_join(r, between))


def two_columns(frames: Column, gap: float) -> Column:
    """0 or 1 for each positioned line: side of the widest horizontal gap, if it is at least ``gap``."""
    centres = F.array_sort(F.transform(frames, lambda f: f["cx"]))
    gaps = F.transform(F.slice(centres, 2, F.greatest(F.size(centres) - 1, F.lit(0))), lambda x, i: F.struct((x - F.get(centres, i)).alias("gap"), ((x + F.get(centres, i)) / 2).alias("at")))
    widest = F.array_max(gaps)
    return F.transform(frames, lambda f: F.when((widest["gap"] >= gap) & (f["cx"] > widest["at"]), 1).otherwise(0))


def mean_of(values: Column) -> Column:
    """Mean of an array, in its order; 0.0 if empty."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values)).otherwise(0.0)


# Rules ----------------------------------------------------------------------------------------


def rule_hits(df: DataFrame, column: str, rules: Sequence[str]) -> DataFrame:
    """rule and occurrences over the whole table, rules without any included: one row, unpivoted."""
    count = lambda r: F.coalesce(F.sum(((F.length(column) - F.length(F.replace(F.col(column), F.lit(r), F.lit("")))) / len(r)).cast("long")), F.lit(0))
    one = df.agg(*[count(r).alias(f"r{i}") for i, r in enumerate(rules)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r{i}").alias("hits")) for i, r in enumerate(rules)])))


def override_fields(df: DataFrame, rules: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Field values replaced by rules (key, field, value, ord), the last rule of a field deciding."""
    last = rules.groupBy(key).agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("ord"))).alias(f"_{f}") for f in fields])
    return df.join(last, key, "left").select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in fields else c for c in df.columns])


def duplicate_rules(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rules.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


# Gazetteers -----------------------------------------------------------------------------------


def longest_terms(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of terms as (start, term), longer terms first and without overlaps, for a short driver-side list.

    Ties of equal length go to the leftmost place, then to the order of the list.
    """
    ordered = sorted(dict.fromkeys(t for t in terms if t), key=len, reverse=True)
    empty = F.array().cast("array<struct<start:int,term:string>>")
    return reduce(lambda taken, term: _with_term(text, taken, term), ordered, empty)


def _with_term(text: Column, taken: Column, term: str) -> Column:
    n = len(term)
    starts = F.when(F.contains(text, F.lit(term)), F.filter(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)) == term)).otherwise(F.array().cast("array<int>"))
    free = F.filter(starts, lambda i: ~F.exists(taken, lambda t: (t["start"] < i + n) & (i < t["start"] + F.length(t["term"]))))
    return F.concat(taken, F.transform(free, lambda i: F.struct(i.cast("int").alias("start"), F.lit(term).alias("term"))))


#: Characters of a needle's key. Needles and characters up to which all go to every worker.
GRAM, MOST_NEEDLES, MOST_CHARACTERS = 8, 50_000, 16_000_000


def containing(texts: DataFrame, key: str, text: str, needles: DataFrame, needle_key: str, needle: str, gram: int = GRAM, most: int = MOST_NEEDLES) -> DataFrame:
    """(key, needle_key) of the texts that contain each needle, without a product of the two.

    Needles are measured first. Up to ``most`` of them go to the workers, where one scan of a text finds
    all. More are joined by key, their first ``gram`` characters: texts give their distinct pieces of that
    length, and where one is a key the whole needle decides. Shorter needles have their own length as
    piece length, so every length up to ``gram`` is one such join.
    """
    full = needles.filter(F.length(needle) > 0).select(needle_key, F.col(needle).alias("_needle"))
    n, size = full.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_needle")), F.lit(0))).first()
    if n <= most and size <= MOST_CHARACTERS:
        kinds = {c: d.schema[c].dataType.simpleString() for d, c in ((texts, key), (needles, needle_key))}
        return texts.select(key, text).mapInPandas(_finder(full.collect(), key, needle_key), f"{key} {kinds[key]}, {needle_key} {kinds[needle_key]}")
    known = full.withColumn("_size", F.least(F.length("_needle"), F.lit(gram)))
    parts = []
    for size in sorted(r[0] for r in known.select("_size").distinct().collect()):  # at most ``gram`` numbers
        keys = known.filter(F.col("_size") == size).withColumn("_gram", F.substring("_needle", 1, size))
        # A look-ahead takes nothing, so its matches are all pieces, in one scan.
        pieces = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"(?s)(?=(.{{{size}}}))"), 1))
        parts.append(texts.filter(F.length(text) >= size).select(key, F.explode(pieces).alias("_gram")).join(keys, "_gram").select(key, needle_key, "_needle"))
    # A text meets only needles whose key it has.
    return reduce(DataFrame.unionByName, parts).join(texts.select(key, text), key).filter(F.contains(F.col(text), F.col("_needle"))).select(key, needle_key)


def _finder(known: Sequence[tuple[object, str]], key: str, needle_key: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    by_needle: dict[str, list] = {}
    for ident, words in known:
        by_needle.setdefault(words, []).append(ident)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for words in by_needle:
                automaton.add_word(words, words)
            automaton.make_automaton()
            find = lambda t: {w for _, w in automaton.iter(t)} if by_needle else set()
        except ImportError:
            # By first characters, so that a place in the text is held against few needles.
            heads: dict[str, list[str]] = {}
            for words in by_needle:
                heads.setdefault(words[:3], []).append(words)
            find = lambda t: {w for i in range(len(t)) for k in (1, 2, 3) if len(t) - i >= k for w in heads.get(t[i : i + k], ()) if t.startswith(w, i)}
        for batch in batches:
            rows = [(k, ident) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1]) if t for w in find(t) for ident in by_needle[w]]
            yield pd.DataFrame(rows, columns=[key, needle_key])

    return run


def unique_edit_match(words: DataFrame, word: str, vocabulary: DataFrame, known: str) -> DataFrame:
    """Each word's only vocabulary entry within one edit; words with none or several have none.

    Both sides are keyed by what is left when one character is deleted, or none: words within one
    edit share such a key, so the join is an equality.
    """
    cuts = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    keyed = lambda d, c: d.select(c).distinct().filter(F.length(c) > 0).withColumn("_key", F.explode(cuts(F.col(c))))
    close = F.levenshtein(F.col(word), F.col(known), 1)
    pairs = keyed(words, word).join(keyed(vocabulary, known), "_key").select(word, known).distinct().filter(close.between(0, 1))
    return pairs.groupBy(word).agg(F.count(F.lit(1)).alias("n"), F.min(known).alias("match")).filter("n = 1").drop("n")
