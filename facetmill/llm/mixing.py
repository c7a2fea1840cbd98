"""Mixing sources to target weights by entropy balancing.

Each source has a token constraint: the sizes of its documents, times their rates, sum to its
target. Of all rates between 0 and 2 the balanced ones have the largest entropy over documents;
with the multiplier L of a source's constraint they are 2 / (1 + exp(-L * size)), the exponential
tilt of a rate of 1. Newton's method solves the convex dual for all sources at once: an iteration
sums, over counts of equal sizes, each source's residual and slope; a bracket keeps it safe.

Rates become copies by order sampling: a document has the whole part of its rate for certain, and
documents in the order of a priority (drawn from a hash of the document, by the odds of the
fractional part) get one more, until the source is within half a document of its target.

Edge cases: null text has size 0; a null source is a source of its own, the last; a source without
words takes none; repeated rows are documents of their own, and as they can stand for each other they
are counted, not sorted: only where a source's target falls among them are they numbered, by
partition; an empty table gives an empty table; other columns are ignored. Everything is drawn from
hashes, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

WORD = r"[^\x20\x09-\x0D]+"
_BINS = 4096
#: Newton steps end long before; more mean that something is wrong.
_MOST_STEPS = 500


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: float) -> DataFrame:
    """``sizes`` (source_key, source_size) with rank, weight and target.

    Targets are filled up to one level of words for each unit of weight; ``cap`` times its size stops
    a source. In the order of the level at which they stop, a source stops if the level without it
    and those after it would be above its own.
    """
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("source_key")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.lit(cap) * F.col("source_size"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("most") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    words = F.lit(share) * F.sum("source_size").over(everything)
    ranked = ranked.withColumn("words", words).withColumn("weights", F.sum("weight").over(everything))
    level = (F.col("words") - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))) / (F.col("weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
    ranked = ranked.withColumn("stops", level * F.col("weight") >= F.col("most"))
    rest = F.col("words") - F.coalesce(F.sum(F.when(F.col("stops"), F.col("most"))).over(everything), F.lit(0.0))
    share_of = F.col("weight") / F.coalesce(F.sum(F.when(~F.col("stops"), F.col("weight"))).over(everything), F.lit(1.0))
    return ranked.select("source_key", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(rest * share_of).alias("target"), "stops")


def _rate(multiplier: Column, scaled: Column, cap: float) -> Column:
    return F.lit(cap) / (F.lit(1.0) + F.exp(-multiplier * scaled))


def solve_dual(counts: DataFrame, sources: DataFrame, cap: float, exact: float = 1e-9) -> DataFrame:
    """``sources`` with ``mean`` and ``multiplier``, by safeguarded Newton steps until every source is at its target.

    ``counts`` has (source_key, size, n). A source that stops at its cap has every rate at it. A step is
    at most 4 and the multiplier's size, and stays inside the bracket of multipliers that gave too
    little and too much. A source is done when its residual is within ``exact`` of its target, or
    when doubles hold no multiplier between the two.
    """
    means = counts.groupBy("source_key").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    state = sources.join(means, "source_key").withColumns({"multiplier": F.lit(0.0), "low": F.lit(float("-inf")), "high": F.lit(float("inf")), "off": F.lit(1.0)})
    fixed = F.col("stops") | (F.col("mean") <= 0)
    for k in range(_MOST_STEPS):
        scaled = F.col("size") / F.col("mean")
        rate = _rate(F.col("multiplier"), scaled, cap)
        sums = (
            counts.join(state.filter(~fixed & (F.col("off") > exact)), "source_key").groupBy("source_key")
            .agg(F.sum(F.col("n") * F.col("size") * rate).alias("got"), F.sum(F.col("n") * F.col("size") * scaled * rate * (F.lit(1.0) - rate / F.lit(cap))).alias("slope"))
        )
        now = state.join(sums, "source_key", "left")
        at, residual = F.col("multiplier"), F.col("got") - F.col("target")
        low, high = F.when(residual < 0, at).otherwise(F.col("low")), F.when(residual >= 0, at).otherwise(F.col("high"))
        far = F.abs(at) + 4
        step = F.when(F.col("slope") > 0, F.least(F.greatest(residual / F.col("slope"), -far), far)).otherwise(F.signum(residual) * far)
        new = F.when((at - step > low) & (at - step < high), at - step).otherwise((low + high) / 2)
        off = F.when((new <= low) | (new >= high), F.lit(0.0)).otherwise(F.abs(residual) / F.greatest(F.col("target"), F.lit(1.0)))
        idle = residual.isNull()
        state = written(
            now.select(
                "source_key", "source_size", "target", "stops", "mean", F.when(idle | (off <= exact), at).otherwise(new).alias("multiplier"),
                F.when(idle, F.col("low")).otherwise(low).alias("low"), F.when(idle, F.col("high")).otherwise(high).alias("high"), F.when(idle, F.lit(0.0)).otherwise(off).alias("off"),
            ), f"dual{k}",
        )
        worst = state.agg(F.max("off")).first()[0]
        if worst is None or worst <= exact:
            # Sums of doubles depend on the order of partitions in their last digits, which must not decide on copies.
            return state.select("source_key", "source_size", "target", "stops", "mean", F.round("multiplier", 7).alias("multiplier"))
    raise RuntimeError(f"the dual isn't solved after {_MOST_STEPS} steps: {worst} off")


def source_key(source: Column) -> Column:
    """Sorts as sources do, by code point and null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def drawn(docs: DataFrame) -> Column:
    return F.xxhash64(docs["doc_id"].cast("long"), docs["text"].cast("string"))


def copied(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` in as many copies as ``mixed`` (from ``mix_sources``) gives them."""
    keys = ["doc_key", "draw", "source_key"]
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("doc_key")
    times = mixed.filter("copies > 0").groupBy(key, "draw", "source_key").agg(F.sum("copies").cast("int").alias("times"))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    rows = docs.select(key, drawn(docs).alias("draw"), source_key(docs["source"]).alias("source_key"), row).dropDuplicates(keys)
    return rows.join(times, keys).select("row", F.explode(F.sequence(F.lit(1), "times"))).select("row.*")


def mix_sources(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2) -> DataFrame:
    """doc_id, size, source_size, target, rate, copies and taken (copies times size) of each document.

    Also ``source_key`` and ``draw``, which with doc_id tell rows apart unless they repeat each other.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), source_key(docs["source"]).alias("source_key"), n_words(docs["text"].cast("string")).alias("size"), drawn(docs).alias("draw"), F.spark_partition_id().alias("part"))
    rows = written(rows, "sizes")
    counts = written(rows.groupBy("source_key", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sizes = counts.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = solve_dual(counts, written(source_targets(sizes, weights, share, cap), "targets"), cap)

    whole = lambda: F.floor(F.col("rate")).cast("long")
    scaled = F.col("size") / F.col("mean")
    rate = F.when(F.col("stops"), F.lit(float(cap))).when(F.col("mean") <= 0, F.lit(0.0)).otherwise(_rate(F.col("multiplier"), scaled, cap))
    certain = counts.join(sources, "source_key").withColumn("rate", rate).groupBy("source_key").agg(F.sum(F.col("n") * F.col("size") * whole()).alias("certain"))
    sources = written(sources.join(certain, "source_key").withColumn("missing", F.when(F.col("stops"), F.lit(0.0)).otherwise(F.col("target") - F.col("certain"))), "sources")

    part = F.col("rate") - F.floor("rate")
    uniform = (F.shiftrightunsigned("draw", 11).cast("double") + 0.5) / float(1 << 53)
    # Pareto order sampling: the odds of a uniform number by the odds of the rate's fraction, mapped to 0..1.
    odds = uniform * (F.lit(1.0) - part)
    priority = F.when(part > 0, odds / (odds + part * (F.lit(1.0) - uniform))).otherwise(F.lit(1.0))
    ranked = rows.join(sources, "source_key").withColumn("rate", rate).withColumn("priority", priority)
    ranked = ranked.withColumn("bin", F.least(F.floor(F.col("priority") * _BINS), F.lit(_BINS)).cast("int"))
    # The bin in which a source reaches its target, and its words before that bin.
    bins = ranked.filter((F.col("bin") < _BINS) & (F.col("size") > 0)).groupBy("source_key", "bin").agg(F.sum("size").alias("in_bin"), F.first("missing").alias("missing"))
    before = F.coalesce(F.sum("in_bin").over(Window.partitionBy("source_key").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = bins.withColumn("before", before).filter((F.col("before") < F.col("missing")) & (F.col("missing") <= F.col("before") + F.col("in_bin"))).select("source_key", F.col("bin").alias("edge"), "before")
    edge = written(edge, "edge")
    placed = ranked.join(edge, "source_key", "left").withColumn("side", F.when(F.col("edge").isNull(), F.when(F.col("missing") > 0, F.lit(-1)).otherwise(F.lit(1))).otherwise(F.signum(F.col("bin") - F.col("edge")).cast("int")))
    columns = ["doc_id", "source_key", "draw", "size", "source_size", "target", "rate"]
    one = F.when((F.col("side") < 0) & (F.col("bin") < _BINS), 1).otherwise(0)
    clear = placed.filter(F.col("side") != 0).select(*columns, (whole() + one).alias("copies"))
    close = placed.filter(F.col("side") == 0).withColumn("key", F.struct("priority", "draw", "doc_id", "size"))
    # Where a source reaches its target: rows before `cut` get one more, and `more` of those that equal it.
    alike = close.groupBy("source_key", "key").agg(F.count(F.lit(1)).alias("n"), F.first("before").alias("before"), F.first("missing").alias("missing"))
    within = Window.partitionBy("source_key").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("missing") - F.col("before") - F.coalesce(F.sum(F.col("n") * F.col("key.size")).over(within), F.lit(0))
    more = F.when(F.col("key.size") > 0, F.floor(left / F.nullif(F.col("key.size"), F.lit(0)) + 0.5)).otherwise(F.when(left >= 0, F.col("n")).otherwise(0))
    cuts = alike.withColumn("more", F.greatest(F.lit(0), more)).filter("more < n").groupBy("source_key").agg(F.min(F.struct("key", "more")).alias("c"))
    cuts = written(cuts.select("source_key", F.col("c.key").alias("cut"), F.col("c.more").alias("more")), "cuts")
    close = close.join(cuts, "source_key", "left")
    tied = F.coalesce(F.col("key") == F.col("cut"), F.lit(False))
    apart = close.filter(~tied).select(*columns, (whole() + F.when(F.col("cut").isNull() | (F.col("key") < F.col("cut")), 1).otherwise(0)).alias("copies"))
    equal = close.filter(tied)
    parts = equal.groupBy("source_key", "part").agg(F.count(F.lit(1)).alias("in_part"))
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = written(parts.select("source_key", "part", F.coalesce(F.sum("in_part").over(earlier), F.lit(0)).alias("earlier")), "tied")
    number = F.row_number().over(Window.partitionBy("source_key", "part").orderBy("draw")) + F.col("earlier")
    equal = equal.join(parts, ["source_key", "part"]).withColumn("number", number).select(*columns, (whole() + F.when(F.col("number") <= F.col("more"), 1).otherwise(0)).alias("copies"))
    out = clear.unionByName(apart).unionByName(equal)
    return out.select(*columns, F.col("copies").cast("int").alias("copies"), (F.col("copies") * F.col("size")).cast("long").alias("taken"))
