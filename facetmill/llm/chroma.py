"""Chroma audio fingerprints of a media column, and alignment of recordings.

Samples are cut into overlapping frames. A frame's spectrum is summed into 12 pitch classes, smoothed
and scaled. Sixteen filters compare sums of rectangles in the image of pitch classes over frames,
which an integral image gives in four reads each; each result becomes two bits (a Gray code), so a
position has a packed 32-bit number.

For alignment a recording's positions vote for (recording, offset) over all recordings with a smaller
id and all positions there that hold their number and the next one (single numbers agree by chance);
most votes win, ties going to the smaller id, then the smaller offset. An alignment takes LEAST_VOTES
votes, or all of an exact copy. The share of differing bits over the overlap tells how well the two agree.

The result is that of trying every pair and offset. Recordings with the same numbers are one class. The
first holder of most of a class's pairs of neighbouring numbers is compared with it. A better one has
to hold more of its pairs than the commonest ones, as many as are too few for that, so only holders of
the others are compared. So neither pairs that a third of all recordings share nor large groups of near
copies, whose first one holds what they have in common, make pairs of recordings. Many different
recordings that share several common pairs, and no first holder that has as many of them, remain
quadratic in their number.

Media is raw PCM: unsigned 8-bit or little-endian signed 16-bit, one channel. Edge cases: null or
empty media has no fingerprint and no alignment; media shorter than a frame is padded with silence;
media with fewer frames than the widest filter repeats its last frame; rows with one id are
fingerprinted one by one, and the best alignment of any of them with any row of a smaller id counts; a
null id doesn't take part in alignment; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written
from .worker import lean

RATE, FRAME, HOP = 8000, 512, 128
LOWEST_HZ, HIGHEST_HZ = 55.0, 3520.0
#: Filters: kind, first pitch class, height in pitch classes, width in frames, by a rule over 16 numbers.
FILTERS = [(i % 4, (5 * i) % 12, 4 + 2 * (i // 4 % 2), (2, 4, 6, 8)[(i + i // 4) % 4]) for i in range(16)]
WIDEST = max(w for *_, w in FILTERS)
#: A filter's logarithm of ratios is cut here into four steps.
STEP = 0.12
UNIT = 1 << 12
_FRAMES_AT_ONCE = 4096
#: Holders of a number that meet in one task.
SLICE = 4096
#: Votes that an alignment takes.
LEAST_VOTES = 3
_VOTES_AT_ONCE = 4 << 20


def pitch_matrix(rate: int, frame: int) -> np.ndarray:
    """Weight of each spectral bin in each pitch class: shares between the two nearest semitones."""
    hz = np.fft.rfftfreq(frame, 1 / rate)
    out = np.zeros((len(hz), 12))
    for i in np.flatnonzero((hz >= LOWEST_HZ) & (hz <= HIGHEST_HZ)):
        tone = 12 * np.log2(hz[i] / 440.0)
        low = int(np.floor(tone))
        out[i, low % 12] += 1 - (tone - low)
        out[i, (low + 1) % 12] += tone - low
    return out


def samples_of(raw: memoryview | bytes, bits: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(raw, np.uint8).astype(np.float32) / 128 - 1
    return np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.float32) / 32768


def chroma_frames(samples: np.ndarray, starts: np.ndarray, matrix: np.ndarray, frame: int) -> np.ndarray:
    """Pitch classes of the frames that begin at ``starts``, each scaled to length UNIT, as whole numbers.

    Whole numbers have exact sums, so a recording's fingerprint doesn't depend on what it shares a batch with.
    """
    window = np.hanning(frame)
    out = np.empty((len(starts), 12))
    view = np.lib.stride_tricks.sliding_window_view(samples, frame)
    for lo in range(0, len(starts), _FRAMES_AT_ONCE):
        part = view[starts[lo : lo + _FRAMES_AT_ONCE]]
        part = (part - part.mean(axis=1, keepdims=True)) * window
        spectrum = np.fft.rfft(part, axis=1)
        out[lo : lo + len(part)] = (spectrum.real**2 + spectrum.imag**2) @ matrix
    return np.rint(out * UNIT / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-6)).astype(np.int64)


def packed_numbers(chroma: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 32-bit number at each frame position; filters span WIDEST frames from there."""
    wide = np.concatenate([chroma, chroma], axis=1)  # pitch classes are a circle
    integral = np.zeros((len(wide) + 1, 25), np.int64)
    np.cumsum(np.cumsum(wide, axis=0), axis=1, out=integral[1:, 1:])

    def area(t0: np.ndarray, t1: np.ndarray, p0: int, p1: int) -> np.ndarray:
        return integral[t1, p1] - integral[t0, p1] - integral[t1, p0] + integral[t0, p0]

    out = np.zeros(len(at), np.uint32)
    for kind, p, h, w in FILTERS:
        begin, middle, end, ph = at, at + w // 2, at + w, p + h // 2
        if kind == 0:  # upper against lower pitches
            a, b = area(begin, end, ph, p + h), area(begin, end, p, ph)
        elif kind == 1:  # later against earlier
            a, b = area(middle, end, p, p + h), area(begin, middle, p, p + h)
        elif kind == 2:  # the two diagonals
            a = area(begin, middle, p, ph) + area(middle, end, ph, p + h)
            b = area(begin, middle, ph, p + h) + area(middle, end, p, ph)
        else:  # a band of pitches against those around it
            inner = area(begin, end, p + h // 4, p + h - h // 4)
            a, b = inner, area(begin, end, p, p + h) - inner
        value = np.log((UNIT + a) / (UNIT + b))
        step = (value > -STEP).astype(np.uint32) + (value > 0) + (value > STEP)
        out = (out << np.uint32(2)) | (step ^ (step >> np.uint32(1)))
    return out


def fingerprints(media: list[memoryview | bytes | None], bits: int = 8, rate: int = RATE, frame: int = FRAME, hop: int = HOP) -> list[np.ndarray]:
    """The packed numbers of each recording."""
    matrix = pitch_matrix(rate, frame)
    parts, starts, owners, offset = [], [], [], 0
    for i, raw in enumerate(media):
        samples = samples_of(raw, bits) if raw is not None else np.empty(0, np.float32)
        if not len(samples):
            continue
        if len(samples) < frame:
            samples = np.concatenate([samples, np.zeros(frame - len(samples), np.float32)])
        own = np.arange(0, len(samples) - frame + 1, hop)
        own = np.concatenate([own, np.repeat(own[-1:], max(0, WIDEST - len(own)))])
        starts.append(offset + own)
        owners.append((i, len(own)))
        parts.append(samples)
        offset += len(samples)
    out = [np.empty(0, np.uint32) for _ in media]
    if not parts:
        return out
    chroma = chroma_frames(np.concatenate(parts), np.concatenate(starts), matrix, frame)
    first, at = 0, []
    for _, n in owners:
        at.append(np.arange(first, first + n - WIDEST + 1))
        first += n
    numbers = packed_numbers(chroma, np.concatenate(at))
    begin = 0
    for (i, _), positions in zip(owners, at):
        out[i] = numbers[begin : begin + len(positions)]
        begin += len(positions)
    return out


def fingerprint_table(rows: DataFrame, media: Column, id_col: str, bits: int = 8, hop: int = HOP, bytes_at_once: int = 4 << 20) -> DataFrame:
    """rec_id, seconds, numbers (signed 32-bit) and their checksum for each row."""
    schema = "rec_id long, seconds double, numbers array<int>, numbers_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            lo = 0
            while lo < len(column):
                media, size, hi = [], 0, lo
                while hi < len(column) and (hi == lo or size < bytes_at_once):
                    raw = column[hi].as_buffer() if column[hi].is_valid else None
                    media.append(memoryview(raw) if raw is not None else None)
                    size += len(media[-1] or b"")
                    hi += 1
                prints = fingerprints(media, bits, hop=hop)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array([len(m) * 8 // bits / RATE if m is not None else None for m in media], pa.float64()),
                        pa.array([p.view(np.int32) for p in prints], pa.list_(pa.int32())),
                        pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in prints], pa.int64()),
                    ],
                    names=["rec_id", "seconds", "numbers", "numbers_crc32"],
                )
                lo = hi

    return rows.select(F.col(id_col).cast("long"), media.cast("binary")).mapInArrow(lean(run), schema)


def in_pairs(numbers: np.ndarray) -> np.ndarray:
    """Each number with the next, as one 64-bit number."""
    return (numbers[:-1].astype(np.int64) << 32) | (numbers[1:].astype(np.int64) & 0xFFFFFFFF)


def best_offset(own: np.ndarray, other: np.ndarray) -> tuple[int, int, int, float]:
    """Most votes of all offsets, the smallest such offset, its overlap and the share of differing bits there.

    Position p of ``own`` lies at position p + offset of ``other``; a position votes for each that
    holds its number and the next one. Both have two numbers at least.
    """
    asks, holds = in_pairs(own), in_pairs(other)
    order = np.argsort(holds, kind="stable")
    ranked = holds[order]
    low, high = np.searchsorted(ranked, asks, "left"), np.searchsorted(ranked, asks, "right")
    upto = np.concatenate([[0], np.cumsum(high - low)])
    votes = np.zeros(len(own) + len(other) - 1, np.int64)
    at = 0
    while at < len(asks):  # a bounded number of votes at once
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + _VOTES_AT_ONCE, "right")) - 1)
        many = high[at:to] - low[at:to]
        position = np.repeat(np.arange(at, to), many)
        there = order[np.repeat(low[at:to], many) + np.arange(len(position)) - np.repeat(upto[at:to] - upto[at], many)]
        votes += np.bincount(there - position + len(own) - 1, minlength=len(votes))
        at = to
    best = int(votes.argmax())
    offset = best - len(own) + 1
    begin, end = max(0, -offset), min(len(own), len(other) - offset)
    wrong = np.bitwise_count(own[begin:end].view(np.uint32) ^ other[begin + offset : end + offset].view(np.uint32)).sum(dtype=np.int64)
    return int(votes[best]), offset, end - begin, float(wrong) / (32 * (end - begin))


FOUND = "k long, votes long, aligned_to long, offset int, overlap int, bit_error_rate double"


def compared(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """FOUND for each pair of classes (k, other)."""
    other = classes.select(F.col("k").alias("other"), F.col("least").alias("aligned_to"), F.col("numbers").alias("theirs"))
    both = pairs.join(classes.select("k", "numbers"), "k").join(other, "other").select("k", "numbers", "aligned_to", "theirs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for column in (batch.column(1), batch.column(3)):
                flat, bounds = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
                sides.append([flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
            found = [best_offset(a, b) for a, b in zip(*sides)]
            votes, offset, overlap, wrong = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(votes, pa.int64()), batch.column(2), pa.array(offset, pa.int32()), pa.array(overlap, pa.int32()), pa.array(wrong, pa.float64())],
                names=["k", "votes", "aligned_to", "offset", "overlap", "bit_error_rate"],
            )

    return both.mapInArrow(lean(run), FOUND)


def _best(found: DataFrame, key: str) -> DataFrame:
    """Of each key the row with most votes, then the smaller id, then the smaller offset."""
    order = F.struct("votes", (-F.col("aligned_to")).alias("id"), (-F.col("offset")).alias("at"), "overlap", "bit_error_rate")
    best = found.groupBy(key).agg(F.max(order).alias("b"))
    return best.select(key, "b.votes", (-F.col("b.id")).alias("aligned_to"), (-F.col("b.at")).alias("offset"), "b.overlap", "b.bit_error_rate")


def _numbers(classes: DataFrame) -> DataFrame:
    """k, least, n, pair and how many positions hold it, for each distinct pair of neighbouring numbers of a class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, bounds = batch.column(2).flatten().to_numpy(), batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
            made = [np.unique(in_pairs(flat[a:b]), return_counts=True) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            row = pa.array(np.repeat(np.arange(len(made)), [len(x) for x, _ in made]))
            number, times = (np.concatenate([m[i] for m in made]) if made else np.empty(0, np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(np.diff(bounds) - 1, pa.int32()).take(row), pa.array(number, pa.int64()), pa.array(times, pa.int32())],
                names=["k", "least", "n", "pair", "times"],
            )

    return classes.select("k", "least", "numbers").mapInArrow(lean(run), "k long, least long, n int, pair long, times int")


def best_partners(classes: DataFrame, least_votes: int) -> DataFrame:
    """FOUND of each class: the best of all classes with a smaller id and all offsets, with ``least_votes`` at least."""
    entries = written(_numbers(classes), "entries")
    known = entries.groupBy("pair").agg(F.count(F.lit(1)).alias("held"), F.min("least").alias("first"), F.max("least").alias("last")).filter("first < last")
    shared = written(entries.join(written(known.drop("last"), "known"), "pair"), "shared")
    voting = shared.filter("first < least")
    # The class that comes first with most of a class's pairs is compared at once: what it gets bounds all others.
    guess = voting.groupBy("k", "first").agg(F.sum("times").alias("most")).groupBy("k").agg(F.max(F.struct("most", (-F.col("first")).alias("first"))).alias("g"))
    pairs = guess.select("k", (-F.col("g.first")).alias("least")).join(classes.select(F.col("k").alias("other"), "least"), "least").select("k", "other")
    guessed = written(_best(compared(pairs, classes), "k"), "guessed")
    # A better class has more votes, or as many and a smaller id. So it holds more of the class's pairs than
    # the commonest ones that together are too few for that; those aren't asked for.
    have = F.col("votes")
    more = F.greatest(have + 1, F.lit(least_votes).cast("long"))
    ranked = voting.join(guessed.select("k", "votes", "aligned_to"), "k").withColumn("smaller", F.col("first") < F.col("aligned_to"))
    commonest = Window.partitionBy("k").orderBy(F.desc("held"), "pair")
    upto = ranked.withColumn("upto", F.sum("times").over(commonest.rowsBetween(Window.unboundedPreceding, 0)))
    early = F.when(F.col("smaller"), F.col("times")).otherwise(0)
    upto = upto.withColumn("early", F.sum(early).over(commonest.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all_early", F.sum(early).over(Window.partitionBy("k")))
    by_votes = F.col("upto") >= more
    by_id = F.col("smaller") & (have >= least_votes) & (F.col("all_early") >= have) & (F.col("early") >= have)
    slices = F.ceil(F.col("held") / SLICE).cast("int")
    asked = upto.filter(by_votes | by_id).select("k", "pair", "held", "n", F.when(by_votes, F.col("least")).otherwise(F.col("aligned_to")).alias("below"), F.when(by_id, have).otherwise(more).alias("need"))
    # Holders of a common number are dealt into slices, so that none is one task's work.
    asked = asked.filter(F.col("n") >= F.col("need")).withColumn("slice", F.explode(F.sequence(F.lit(0), slices - 1)))
    holders = shared.select("pair", F.col("k").alias("other"), F.col("least").alias("other_least"), F.col("n").alias("other_n"), F.pmod(F.xxhash64("k"), slices).cast("int").alias("slice"))
    close = asked.select("k", "pair", "slice", "below", "need").join(holders, ["pair", "slice"]).filter((F.col("other_least") < F.col("below")) & (F.col("other_n") >= F.col("need")))
    pairs = written(close.select("k", "other").distinct(), "pairs")
    return _best(guessed.unionByName(compared(pairs, classes)).filter(F.col("votes") >= least_votes), "k")


def align(prints: DataFrame, least_votes: int = LEAST_VOTES) -> DataFrame:
    """rec_id, aligned_to, offset, votes, overlap and bit_error_rate for each recording that aligns with one of a smaller id.

    Position p of the recording lies at position p + offset of ``aligned_to``.
    """
    recordings = prints.filter(F.col("rec_id").isNotNull() & (F.size("numbers") > 0)).select("rec_id", "numbers", F.sha2(F.col("numbers").cast("string").cast("binary"), 256).alias("key"))
    # Equal numbers are one class, known by its smallest id.
    classes = recordings.groupBy("key").agg(F.min("rec_id").alias("least"), F.first("numbers").alias("numbers"))
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    members = written(recordings.select("rec_id", "key").distinct().join(classes.select("key", "k", "least", F.greatest(F.size("numbers") - 1, F.lit(1)).alias("n"), F.size("numbers").alias("whole")), "key").drop("key"), "members")
    best = written(best_partners(classes, least_votes), "best")
    found = members.join(best, "k").select("rec_id", *best.columns[1:])
    # A copy agrees with its class at all positions; nothing has more votes, and no id between has as many and comes first.
    copies = members.filter("rec_id > least").select("rec_id", F.col("n").cast("long").alias("votes"), F.col("least").alias("aligned_to"), F.lit(0).alias("offset"), F.col("whole").alias("overlap"), F.lit(0.0).alias("bit_error_rate"))
    return _best(found.unionByName(copies), "rec_id").select("rec_id", "aligned_to", "offset", "votes", "overlap", "bit_error_rate")
