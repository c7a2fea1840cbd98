"""Best-fit packing with certified bin counts.

Documents become token pieces of at most ``capacity`` ids. Each partition packs its pieces by
best-fit decreasing, and dual feasible functions bound its number of sequences from below: a partition
that meets its own bound is certified. Partitions above theirs give up the pieces of their unfilled
sequences; these meet in fewer partitions and are packed again, as long as that saves sequences.
A bound is rounded up, so the emptiest sequence of each certified partition goes along.

Edge cases: null text is empty text, whose piece is the end id alone; an empty table gives an
empty table; repeated rows are packed one by one, each with its own place, and dealt to partitions
one by one, also those of one doc_id or none; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import encoder, with_end
from .shared import written
from .worker import lean

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", row long, part int, sequence long, offset long, filled long, bound long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first can be shorter than the others."""
    first = n % capacity or min(n, capacity)
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """A row for each piece: its place in the document's ids, and their checksum."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, keeps_space=True)
        for batch in batches:
            doc_ids = batch.column(0)
            for first, ids, counts in enc.slices(batch.column(1)):
                ids, bounds = with_end(ids, counts, end_id)
                raw, row, piece, start, length, crc = memoryview(ids).cast("B"), [], [], [], [], []
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    for k, (at, n) in enumerate(cut(hi - lo, capacity)):
                        row.append(first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(raw[4 * (lo + at) : 4 * (lo + at + n)]))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(pieces), PIECES)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that items need at least. ``counts[l]``: items of length ``l``, up to the capacity.

    The largest of three families of dual feasible functions, in whole numbers: the identity,
    u_k (lengths rounded towards multiples of 1/k) and U_e (large items count as whole bins, those
    under e as nothing), the latter also after u_k. For U_e, e up to half the capacity counts.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.flatnonzero(counts)
    if not len(lengths):
        return 0
    many, k, best = counts[lengths], np.arange(1, 21)[:, None], 0
    for e in [0, *lengths[2 * lengths <= capacity].tolist()]:
        shrunk = np.where(lengths > capacity - e, capacity, np.where(lengths < e, 0, lengths)) if e else lengths
        best = max(best, -(-int(shrunk @ many) // capacity))
        scaled = (k + 1) * shrunk
        value = np.where(scaled % capacity == 0, k * shrunk, scaled // capacity * capacity)
        best = max(best, int((-(-(value @ many) // (capacity * k[:, 0]))).max()))
    return best


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, placed in the given order into the fullest bin that has room; the bins' fill.

    The free space of open bins is a bit set, so a placement is a shift and the lowest set bit.
    """
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, fill, bins, offsets = 0, [], [], []
    for n in lengths:
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        bins.append(b)
        offsets.append(fill[b])
        fill[b] += n
        left = room - n
        if left:
            if not open_by_room[left]:
                rooms |= 1 << left
            open_by_room[left].append(b)
    return bins, offsets, fill


def _pack_partition(capacity: int):
    def pack(rows: pa.Table) -> pa.Table:
        rows = rows.select(["doc_id", "piece", "start", "length", "ids_crc32", "row", "part"])
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("row", "ascending")])
        bound = lower_bound(np.bincount(rows["length"].to_numpy(), minlength=capacity + 1), capacity)
        bins, offsets, fill = best_fit(rows["length"].to_pylist(), capacity)
        at = np.array(bins, np.int64)
        for name, values in (("sequence", at), ("offset", np.array(offsets, np.int64)), ("filled", np.array(fill, np.int64)[at]), ("bound", np.full(len(at), bound, np.int64))):
            rows = rows.append_column(name, pa.array(values))
        return rows

    return pack


def pack_pieces(pieces: DataFrame, capacity: int = 1024, per_partition: int = 60_000) -> tuple[DataFrame, list[dict]]:
    """Packs the pieces; also a report of each round.

    ``pieces`` has the columns of PIECES. The result has in addition ``part`` and ``sequence``
    (together a sequence), ``offset``, ``filled`` (the ids in the sequence) and ``bound`` (sequences that the
    partition needs at least). A round's report: all sequences so far, the bound of the whole,
    partitions, and how many of them are certified.
    """
    pieces = written(pieces.withColumn("row", F.monotonically_increasing_id()), "pieces")
    by_length = np.zeros(capacity + 1, np.int64)
    for length, many in pieces.groupBy("length").count().collect():  # at most a row for each length up to the capacity
        by_length[length] = many
    bound, n = lower_bound(by_length, capacity), int(by_length.sum())
    settled: list[DataFrame] = []
    report: list[dict] = []
    waiting, first_part, settled_bins, reopened = pieces, 0, 0, None
    while True:
        parts = max(1, -(-n // per_partition))
        # Dealt by row: the pieces of one doc_id are no group.
        part = (F.lit(first_part) + F.pmod(F.xxhash64(F.lit(len(report)), "row"), F.lit(parts))).cast("int")
        packed = written(waiting.withColumn("part", part).groupBy("part").applyInArrow(_pack_partition(capacity), PACKED), f"packed{len(report)}")
        heads = packed.filter("offset = 0")
        own = heads.groupBy("part").agg(F.count(F.lit(1)).alias("bins"), F.max("bound").alias("own_bound"), F.min(F.struct("filled", "sequence")).alias("emptiest"))
        own = written(own.withColumn("certified", F.col("bins") <= F.col("own_bound")), "partitions")
        seen = own.agg(F.sum("bins"), F.count_if("certified"), F.count(F.lit(1))).first()
        bins, certified, many = (x or 0 for x in seen)
        report.append({"round": len(report), "sequences": settled_bins + bins, "bound": bound, "partitions": many, "certified": certified})
        # ``reopened`` sequences went into this round.
        if settled_bins + bins <= bound or many <= 1 or reopened is not None and bins >= reopened:
            settled.append(packed)
            break
        emptiest = F.col("certified") & (F.col("emptiest.sequence") == F.col("sequence"))
        opened = (F.col("filled") < capacity) & (~F.col("certified") | emptiest)
        both = packed.join(own.select("part", "certified", "emptiest"), "part").withColumn("opened", opened)
        n, reopened = both.filter("opened").agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        settled.append(both.filter("NOT opened").select(*packed.columns))
        settled_bins += bins - reopened
        first_part += parts
        waiting = both.filter("opened").select(*pieces.columns)
        if not n:
            break
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out, report


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> tuple[DataFrame, list[dict]]:
    """Documents cut into pieces and packed into sequences of at most ``capacity`` ids."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, capacity), capacity)
