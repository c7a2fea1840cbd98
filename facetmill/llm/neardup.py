"""MinHash near-duplicates: fast similarity sketches, banding, and exact verification of links.

1. Each text becomes the set of its word shingles and a sketch of it; bands of the sketch are keys.
2. Rows with equal sets form a class, and one of the rows stands for it.
3. Classes that share a band key are in one bucket. A bucket's members are joined to loose groups
   where sizes and sketches allow a link at all; a bucket gives a spanning forest of them, never its
   pairs. Forests of all buckets make the loose components.
4. In each loose component the full sets of the whole texts are compared, pairs of the most similar
   sketches first, except pairs that links connect already. The links found, and one between classes
   that share a doc_id, make the components.

Members of a large bucket or loose component are dealt into blocks, and a task compares two blocks,
so no task holds an unbounded group and no pair is left out; its output is again a forest. With 42
bands of 6 coordinates a pair at a similarity of 0.85 shares no bucket with a probability of 2e-9
(0.80: 3e-6); sketches rule a pair out at more than five standard deviations below the threshold.

Edge cases: null or wordless text has the empty set and links with nothing; rows with one doc_id are
one document for links, also where their texts differ, and each returns that document's component; a
null doc_id links with nothing, has a null component and is kept; an empty table gives an empty
table; other columns are ignored. Repeated rows have equal sets, so they are always in one component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .shingles import band_keys, sets, sketches
from .worker import lean

SKETCHED = "doc_id long, n_shingles long, print0 long, print1 long, bands array<long>, sketch binary"
#: Members of a block of a bucket (sketches) and of a loose component (texts); two blocks meet in a task.
_SKETCH_BLOCK, _TEXT_BLOCK = 2048, 256


def fingerprint(group: np.ndarray) -> list[int | None]:
    """128 bits that tell sets apart; none for the empty set."""
    return np.frombuffer(xxhash.xxh3_128_digest(group.tobytes()), np.int64).tolist() if len(group) else [None, None]


def sketched(docs: DataFrame, width: int, size: int, rows: int) -> DataFrame:
    """Size, 128-bit fingerprint, band keys and one byte of each sketch coordinate of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, groups in sets(batch.column(1), width):
                full = [g for g in groups if len(g)]
                made = sketches(full, size) if full else np.empty((0, size), np.uint64)
                keys, low = iter(band_keys(made, rows)), iter((made & np.uint64(0xFF)).astype(np.uint8))
                prints = [fingerprint(g) for g in groups]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, len(groups)),
                        pa.array([len(g) for g in groups], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.array([next(keys) if len(g) else None for g in groups], pa.list_(pa.int64())),
                        pa.array([next(low).tobytes() if len(g) else None for g in groups], pa.binary()),
                    ],
                    names=["doc_id", "n_shingles", "print0", "print1", "bands", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), SKETCHED)


def least_agreement(percent: int, size: int) -> float:
    """Share of equal sketch bytes below which a pair at the threshold practically never falls (5.4 deviations)."""
    j = percent / 100
    p = j + (1 - j) / 256
    return p - 5.4 * (p * (1 - p) / size) ** 0.5


def in_block_pairs(rows: DataFrame, group: str, n: str, member: str, block: int) -> DataFrame:
    """``rows`` with block pairs (b0 <= b1): a group of up to ``block`` members is one pair, a larger one all pairs of its blocks.

    ``second`` tells members of b1 from those of b0: where the two differ only members of both meet.
    """
    blocks = (F.floor((F.col(n) - 1) / block) + 1).cast("int")
    own = F.pmod(F.xxhash64(group, member), blocks).cast("int")
    out = rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    out = out.withColumn("b0", F.least("_own", "_other")).withColumn("b1", F.greatest("_own", "_other"))
    return out.withColumn("second", (F.col("_own") == F.col("b1")) & (F.col("b0") < F.col("b1"))).drop("_own", "_other")


def by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows of each run of equal values in the first ``keys`` columns, over sorted batches."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(n, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), n]
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(c[lo] for c in columns)
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _pairs_out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["pivot", "doc"])


def forest(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Edges that span the components of a graph; ``near(i, rest)`` says which of ``rest`` adjoin ``i``."""
    rest, edges = np.arange(n), []
    while len(rest):
        queue, rest = [int(rest[0])], rest[1:]
        while queue and len(rest):
            i = queue.pop()
            hit = near(i, rest)
            found = rest[hit]
            edges += [(i, int(j)) for j in found]
            queue += found.tolist()
            rest = rest[~hit]
    return edges


def loose_links(buckets: DataFrame, percent: int, agreement: float) -> DataFrame:
    """Forests of the pairs in a bucket that sizes and sketches allow. ``buckets``: key, id, n, members, sketch."""
    rows = in_block_pairs(buckets, "key", "members", "id", _SKETCH_BLOCK).select("key", "b0", "b1", "id", "second", "n", "sketch")
    rows = rows.repartition("key", "b0", "b1").sortWithinPartitions("key", "b0", "b1", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in by_group(batches, 3):
            ids, n, second = table["id"].to_numpy(), table["n"].to_numpy(), table["second"].to_numpy()
            alone = not second.any()
            made = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
            least = agreement * made.shape[1]

            def near(i: int, rest: np.ndarray) -> np.ndarray:
                fits = (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])) & (alone | (second[rest] != second[i]))
                fits[fits] = np.count_nonzero(made[rest[fits]] == made[i], axis=1) >= least
                return fits

            out += [(int(ids[a]), int(ids[b])) for a, b in forest(len(ids), near)]
            if len(out) > 50_000:
                yield _pairs_out(out)
                out = []
        yield _pairs_out(out)

    return rows.mapInArrow(lean(run), "pivot long, doc long")


def exact_links(members: DataFrame, texts: DataFrame, width: int, percent: int, size: int, agreement: float) -> DataFrame:
    """Links that span the components of the exact graph. ``members``: comp, id, members (the component's size)."""
    rows = in_block_pairs(members, "comp", "members", "id", _TEXT_BLOCK).join(texts, "id").select("comp", "b0", "b1", "id", "second", "text")
    rows = rows.repartition("comp", "b0", "b1").sortWithinPartitions("comp", "b0", "b1", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for table in by_group(batches, 3):
            ids, group = table["id"].to_pylist(), [g for _, part in sets(table["text"], width) for g in part]
            n, second = np.array([len(g) for g in group]), table["second"].to_numpy()
            made, alone = sketches(group, size), not second.any()
            root = list(range(len(ids)))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            pairs = []
            for i in range(len(ids) - 1):
                rest = np.arange(i + 1, len(ids))
                rest = rest[(100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])) & (alone | (second[rest] != second[i]))]
                same = np.count_nonzero(made[rest] == made[i], axis=1)
                pairs += [(-s, i, int(j)) for s, j in zip(same.tolist(), rest) if s >= (agreement - 1 / 256) * size]
            for _, i, j in sorted(pairs):
                a, b = find(i), find(j)
                if a != b:
                    both = np.concatenate([group[i], group[j]])
                    both.sort()
                    shared = int(np.count_nonzero(both[1:] == both[:-1]))
                    if 100 * shared >= percent * (len(both) - shared):
                        root[max(a, b)] = min(a, b)
                        out.append((ids[i], ids[j]))
        yield _pairs_out(out)

    return rows.mapInArrow(lean(run), "pivot long, doc long")


def merged(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp) of ``ids``: the smallest id that ``links`` (pivot, doc) reach.

    Each vertex hooks onto its smallest neighbour if that is smaller, and the graph is contracted,
    until no edge is left. The smallest id of a component always stays.
    """
    labels = ids.select("id", F.col("id").alias("comp"))
    edges = links.select(F.col("pivot").alias("a"), F.col("doc").alias("b"))
    for k in range(1000):
        edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges{k}")
        if edges.isEmpty():
            return written(labels, "labels")
        hook = written(edges.groupBy("a").agg(F.min("b").alias("to")), f"hook{k}")
        labels = labels.join(hook, labels["comp"] == hook["a"], "left").select("id", F.coalesce("to", "comp").alias("comp"))
        if k % 4 == 3:
            labels = written(labels, f"labels{k}")
        to = lambda c: hook.select(F.col("a").alias(c), F.col("to").alias(f"{c}_to"))
        edges = edges.join(to("a"), "a").join(to("b"), "b", "left").select(F.col("a_to").alias("a"), F.coalesce("b_to", "b").alias("b"))
    raise AssertionError("contraction didn't end")


def texts_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(id, text) of classes. ``wanted``: id, least (a doc_id of the class), print0, print1.

    A doc_id may stand for several texts, so the text's own fingerprint decides.
    """
    some = docs.select(F.col("doc_id").cast("long").alias("least"), F.col("text").cast("string").alias("text")).join(wanted.select("least"), "least", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(g) for _, groups in sets(batch.column(1), width) for g in groups]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([p[k] for p in prints], pa.int64()) for k in (0, 1))], names=["least", "text", "print0", "print1"])

    keyed = some.mapInArrow(lean(run), "least long, text string, print0 long, print1 long")
    return keyed.join(wanted, ["least", "print0", "print1"]).select("id", "text").dropDuplicates(["id"])


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 5, size: int = 256, rows: int = 6) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, for each row.

    Documents link where 100 * intersection >= ``percent`` * union of their sets.
    """
    agreement = least_agreement(percent, size)
    all_ = written(sketched(docs, width, size, rows).withColumn("row", F.monotonically_increasing_id()), "sketched")
    some = all_.filter(F.col("print0").isNotNull() & F.col("doc_id").isNotNull())
    # Written, so that the join on it has two plain sides, of which a hot print's can be split.
    classes = written(some.groupBy("print0", "print1").agg(F.min("row").alias("id"), F.min("doc_id").alias("least")), "classes")
    grouped = written(some.select("doc_id", "n_shingles", "print0", "print1").join(classes, ["print0", "print1"]).select("doc_id", "n_shingles", "id", "least"), "grouped")

    keyed = some.select(F.col("row").alias("id"), "bands").join(classes.select("id"), "id", "left_semi").select("id", F.explode("bands").alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").select("key", "members")
    entries = written(keyed.join(shared, "key"), "buckets")
    made = some.select(F.col("row").alias("id"), F.col("n_shingles").alias("n"), "sketch")
    made = written(made.join(entries.select("id").distinct(), "id", "left_semi"), "candidates")
    loose = merged(made.select("id"), loose_links(entries.join(made, "id"), percent, agreement))

    sizes = loose.groupBy("comp").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    members = written(loose.join(sizes, "comp"), "loose")
    texts = written(texts_of(docs, classes.join(members.select("id"), "id"), width), "texts")
    # Classes that share a doc_id are one document.
    several = grouped.groupBy("doc_id").agg(F.min("id").alias("pivot"), F.max("id").alias("most")).filter("pivot < most").select("doc_id", "pivot")
    same = written(several.join(grouped.select("doc_id", "id"), "doc_id").filter("id <> pivot").select("pivot", F.col("id").alias("doc")).distinct(), "same")
    ids = members.select("id").unionByName(same.select(F.col("pivot").alias("id"))).unionByName(same.select(F.col("doc").alias("id"))).distinct()
    labels = merged(ids, exact_links(members, texts, width, percent, size, agreement).unionByName(same))

    smallest = labels.join(classes.select("id", "least"), "id").groupBy("comp").agg(F.min("least").alias("found"))
    labels = written(labels.join(smallest, "comp").select("id", "found"), "found")
    named = grouped.join(labels, "id", "left").select("doc_id", "n_shingles", F.coalesce("found", "least").alias("component_id"))
    # Rows without a set belong to their doc_id's other rows.
    rest = all_.filter(F.col("print0").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles")
    other = named.join(rest.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component_id").alias("found"))
    rest = rest.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("found", "doc_id").alias("component_id"))
    return named.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
