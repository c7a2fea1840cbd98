"""Shards of near equal bytes by histogram sort, with DataFrame functions only.

The global order is by a hash of the text, then by doc_id, then by a number that each row has of its
own, so equal texts lie side by side and rows that repeat each other can be parted. Each round counts
the exact bytes and rows below candidate key boundaries on all partitions and keeps, for every splitter
that isn't within tolerance yet, only the range between two boundaries; the next probes lie inside
it. Once all splitters stand, rows are exchanged once: into parts of shards, which have splitters too,
so a task sorts a bounded number of rows and a slot is the exact number of rows of the shard in
earlier parts plus the place in its own.

A group of equal texts is cut only where a splitter falls inside it (a group larger than a shard
has to be). The law ``bytes`` holds for rows that repeat text and doc_id as for all others.

Edge cases: null text counts 16 bytes and has the checksum of empty text; a null doc_id sorts as 0
and is returned as null; rows that repeat each other are interchangeable, so reruns agree; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import step_of, written

_ROW_BYTES = 16
_LOWEST = -(1 << 63)
_KEYS = ("key", "second", "third")
#: Counts that a round returns to the driver at most, give or take a factor of 4.
_PROBES = 1 << 18
#: Rows that one task sorts.
PART_ROWS = 8_000_000


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the three sort keys, all signed 64-bit."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + F.lit(_ROW_BYTES)).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("second"),
        F.monotonically_increasing_id().alias("third"),
    )


def _leading(col: Column, bits: int) -> Column:
    return F.shiftrightunsigned(col.bitwiseXOR(F.lit(_LOWEST)), 64 - bits) if bits else F.lit(0).cast("long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


@dataclass(frozen=True)
class _Range:
    """Keys that share ``whole`` leading columns and ``bits`` leading bits (``lead``, the others 0) of the next; all unsigned."""

    whole: tuple[int, ...] = ()
    lead: int = 0
    bits: int = 0

    @classmethod
    def around(cls, low: list[int], high: list[int]) -> _Range:
        """The smallest range that holds columns between these bounds."""
        n = next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), len(low) - 1)
        bits = 64 - (low[n] ^ high[n]).bit_length()
        return cls(tuple(low[:n]), low[n] >> (64 - bits) << (64 - bits) if bits else 0, bits)

    def bound(self, slot: int = 0, n: int = 0) -> tuple[int, ...]:
        """Where a slot of the next ``n`` bits begins; a column of 2**64 lies above all of its prefix."""
        at = self.lead + (slot << (64 - self.bits - n))
        return (*self.whole, at, *[0] * (len(_KEYS) - len(self.whole) - 1))

    def holds(self) -> Column:
        same = F.lit(True)
        for name, value in zip(_KEYS, self.whole):
            same = same & (F.col(name) == F.lit(value + _LOWEST))
        column = F.col(_KEYS[len(self.whole)])
        return same & (_leading(column, self.bits) == F.lit(_signed(self.lead >> (64 - self.bits)))) if self.bits else same

    def slot(self, n: int) -> Column:
        """The next ``n`` bits of the key."""
        column = F.col(_KEYS[len(self.whole)]).bitwiseXOR(F.lit(_LOWEST))
        return F.shiftrightunsigned(column, 64 - self.bits - n).bitwiseAND(F.lit((1 << n) - 1))


def _before(bound: tuple[int, ...], k: int = 0) -> Column:
    """Whether a row's keys from the ``k``-th on lie below the bound's."""
    if bound[k] >= 1 << 64:
        return F.lit(True)
    value = F.lit(bound[k] + _LOWEST)
    if not any(bound[k + 1 :]):
        return F.col(_KEYS[k]) < value
    return (F.col(_KEYS[k]) < value) | ((F.col(_KEYS[k]) == value) & _before(bound, k + 1))


@dataclass(frozen=True)
class Splitter:
    """Where a part begins, and the exact number of rows before it."""

    bound: tuple[int, ...]
    rows: int


def splitters(rows: DataFrame, parts: int, total: int, tolerance: float) -> list[Splitter]:
    """Where parts 1, 2, ... begin: within ``tolerance`` of a part's share of ``total`` bytes, or at the nearest row."""
    found: dict[int, Splitter] = {}
    open_: list[tuple[_Range, int, int, list[int]]] = [(_Range(), 0, 0, list(range(1, parts)))]
    share = total / parts
    while open_ and parts > 1:
        # Counts go to the driver; the more ranges are open, the fewer probes each has.
        bits = max(2, min(12, int(math.log2(_PROBES / len(open_)))))
        width = [min(bits, 64 - r.bits) for r, *_ in open_]
        # Open ranges lie apart and in order: a binary search finds the only one that may hold a row.
        own = step_of([r.bound() for r, *_ in open_], _before, lambda i: F.when(open_[i - 1][0].holds(), F.struct(F.lit(i - 1).alias("range"), open_[i - 1][0].slot(width[i - 1]).alias("slot"))) if i else F.lit(None))
        sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"), *[f(k).alias(f"{f.__name__}_{k}") for k in _KEYS for f in (F.min, F.max)]]
        counted = rows.withColumn("own", own).filter("own IS NOT NULL").groupBy("own.range", "own.slot").agg(*sums).collect()
        by_range: dict[int, list] = {}
        for x in sorted(counted, key=lambda x: (x["range"], x["slot"])):
            by_range.setdefault(x["range"], []).append(x)
        again = []
        for i, (r, at, n, left) in enumerate(open_):
            for x in by_range.get(i, []):
                low, high = ([x[f"{f}_{k}"] - _LOWEST for k in _KEYS] for f in ("min", "max"))
                inside = []
                while left and at + x["bytes"] >= left[0] * share:
                    j, left = left[0], left[1:]
                    below, above = j * share - at, at + x["bytes"] - j * share
                    if min(below, above) <= tolerance * share or low == high:
                        first = below <= above
                        found[j] = Splitter(r.bound(x["slot"] + (not first), width[i]), n + (0 if first else x["rows"]))
                    else:
                        inside.append(j)
                if inside:
                    again.append((_Range.around(low, high), at, n, inside))
                at, n = at + x["bytes"], n + x["rows"]
        open_ = again
    return [found[j] for j in range(1, parts)]


def shard_by_bytes(docs: DataFrame, shards: int, tolerance: float = 0.001, part_rows: int = PART_ROWS) -> DataFrame:
    """Each document's size, checksum, shard (0 to shards - 1) and slot, its place in the shard.

    Shards' bytes differ from an equal share by ``tolerance`` of it or half a document.
    """
    rows = written(sized(docs), "sized")
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    per_shard = max(1, -(-n // (shards * part_rows)))
    bounds = splitters(rows, shards * per_shard, total, tolerance) if n else []
    before = [0, *[b.rows for b in bounds]]
    # Rows of the shard before each part.
    base = [before[k] - before[k // per_shard * per_shard] for k in range(len(before))]
    at = step_of([b.bound for b in bounds], _before, lambda k: F.struct(F.lit(k).alias("part"), F.lit(k // per_shard).alias("shard"), F.lit(base[k]).cast("long").alias("base")))
    placed = rows.withColumn("at", at).select("*", "at.part", "at.shard", "at.base")
    order = Window.partitionBy("part").orderBy(*_KEYS)
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.row_number().over(order) - 1 + F.col("base")).cast("long").alias("slot"))
