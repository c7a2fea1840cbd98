"""Token ids in files of Re-Pair blocks, decodable at any document and any id.

Documents are dealt into shards by ranges of doc_id and encoded in that order. A shard is a run of
blocks of a bounded number of ids, each with a grammar of its own, so that memory is bounded and a
reader needs no more than one block. In a block frequent pairs of neighbouring symbols become
nonterminals, the most frequent ones first, round after round, until no pair occurs often enough to
save what its rule takes, or symbols run out; a pair never spans two documents. A block stores its
rules, the length of each rule's expansion, and where each document's symbols begin.

Block layout, little-endian: magic; version, end id, first nonterminal, symbol width (2 or 4);
numbers of documents, rules and symbols; validity and value of each doc_id; rules (two symbols
each); expansion lengths (4 bytes each); first symbol of each document and their end; symbols.

Edge cases: null text is empty text and has the end id alone; null doc_ids come first; rows of one
doc_id are in the order of their text's hash; an empty table gives no blocks and an empty result;
other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pieces import encoder, with_end
from .shared import written
from .worker import lean, release

_MAGIC, _VERSION = b"RPRB", 1
_HEAD = struct.Struct("<4s4I3Q")
BLOCK = "shard int, block int, n_docs long, n_tokens long, payload binary"
DECODED = "doc_id long, shard int, block int, within long, n_tokens long, ids_crc32 long"
#: A round replaces pairs down to this share of the most frequent one.
_SHARE = 16
_SLOTS = 20


def _frequent(keys: np.ndarray, least: int, most: int) -> np.ndarray:
    """The most frequent keys: no less than a _SHARE-th as often as the first, ``least`` times and up to ``most`` keys; ties to smaller ones."""
    if not len(keys) or most <= 0:
        return keys[:0]
    keys = np.sort(keys)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    count = np.diff(np.concatenate([begin, [len(keys)]]))
    often = np.flatnonzero(count >= max(least, int(count.max()) // _SHARE))
    keys, count = keys[begin[often]], count[often]
    return keys[np.lexsort((keys, -count))[:most]]


def compress(ids: np.ndarray, bounds: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where each document's begin, rules and expansion lengths.

    ``first`` is the first nonterminal; with ids below 65,536 all symbols stay below it too.
    """
    narrow = first < 1 << 16
    shift, kind, width = (16, np.uint32, 2) if narrow else (32, np.uint64, 4)
    room = (1 << 8 * width) - first
    least = (2 * width + 4) // width + 1  # a rule takes two symbols and a length, an occurrence saves a symbol
    symbols, last = ids.astype(kind), np.zeros(len(ids), bool)
    last[bounds[1:] - 1] = True
    rules, lengths = [np.empty((0, 2), np.uint32)], [np.ones(first, np.uint32)]
    slots = np.full(1 << _SLOTS, -1, np.int32)
    slot_of = lambda x: ((x * kind(0x9E3779B1)) >> kind(12 if narrow else 24)) & kind((1 << _SLOTS) - 1)
    made = 0
    while True:
        keys = (symbols[:-1] << kind(shift)) | symbols[1:]
        chosen = _frequent(keys[~last[:-1]], least, room - made)
        # A table of hash slots finds the chosen pairs; of two in a slot the less frequent one waits for a later round.
        _, keep = np.unique(slot_of(chosen), return_index=True)
        chosen = chosen[np.sort(keep)]
        if not len(chosen):
            break
        slots[slot_of(chosen)] = np.arange(len(chosen))
        rule = slots[slot_of(keys)]
        slots[slot_of(chosen)] = -1
        at = np.flatnonzero((rule >= 0) & ~last[:-1])
        at = at[chosen[rule[at]] == keys[at]]
        # Of overlapping occurrences, every other one from the left.
        alone = np.concatenate([[True], np.diff(at) > 1])
        run = np.maximum.accumulate(np.where(alone, at, 0))
        at = at[(at - run) % 2 == 0]
        # Rules for pairs of which an occurrence is left; the others' were overlapped.
        used = np.bincount(rule[at], minlength=len(chosen)) > 0
        number = np.cumsum(used) - 1
        chosen = chosen[used]
        symbols[at] = (first + made + number[rule[at]]).astype(kind)
        last[at] = last[at + 1]
        stay = np.ones(len(symbols), bool)
        stay[at + 1] = False
        symbols, last = symbols[stay], last[stay]
        pair = np.stack([chosen >> kind(shift), chosen & kind((1 << shift) - 1)], 1).astype(np.uint32)
        rules.append(pair)
        known = np.concatenate(lengths)
        lengths.append(known[pair[:, 0]] + known[pair[:, 1]])
        made += len(chosen)
    starts = np.concatenate([[0], np.flatnonzero(last) + 1]).astype(np.uint64)
    return symbols, starts, np.concatenate(rules), np.concatenate(lengths)[first:]


def pack_block(doc_ids: list[int | None], ids: np.ndarray, bounds: np.ndarray, end_id: int, first: int) -> bytes:
    symbols, starts, rules, lengths = compress(ids, bounds, first)
    width = 2 if first < 1 << 16 else 4
    kind = "<u2" if width == 2 else "<u4"
    valid = np.array([x is not None for x in doc_ids], np.uint8)
    values = np.array([x or 0 for x in doc_ids], "<i8")
    head = _HEAD.pack(_MAGIC, _VERSION, end_id, first, width, len(doc_ids), len(rules), len(symbols))
    return b"".join([head, valid.tobytes(), values.tobytes(), rules.astype(kind).tobytes(), lengths.astype("<u4").tobytes(), starts.astype("<u8").tobytes(), symbols.astype(kind).tobytes()])


@dataclass
class Block:
    """A block's parts as views of its bytes."""

    doc_ids: list[int | None]
    first: int
    rules: np.ndarray
    lengths: np.ndarray
    starts: np.ndarray
    symbols: np.ndarray

    @classmethod
    def read(cls, raw: bytes) -> Block:
        magic, version, _, first, width, n_docs, n_rules, n_symbols = _HEAD.unpack_from(raw)
        if magic != _MAGIC or version != _VERSION:
            raise ValueError("not a Re-Pair block of this version")
        kind, at = "<u2" if width == 2 else "<u4", _HEAD.size

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            part = np.frombuffer(raw, dtype, n, at)
            at += part.nbytes
            return part

        valid, values = take("u1", n_docs), take("<i8", n_docs)
        ids = [v if ok else None for v, ok in zip(values.tolist(), valid.tolist())]
        return cls(ids, first, take(kind, 2 * n_rules).reshape(-1, 2), take("<u4", n_rules), take("<u8", n_docs + 1), take(kind, n_symbols))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols; each pass undoes a step of replacement."""
        symbols = symbols.astype(np.uint32)
        while True:
            made = symbols >= self.first
            if not made.any():
                return symbols
            at = np.cumsum(1 + made) - 1 - made
            out = np.empty(int(at[-1] + 1 + made[-1]), np.uint32)
            out[at[~made]] = symbols[~made]
            pair = self.rules[symbols[made] - self.first]
            out[at[made]], out[at[made] + 1] = pair[:, 0], pair[:, 1]
            symbols = out

    def _spans(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol expands to."""
        out = np.ones(len(symbols), np.int64)
        made = symbols >= self.first
        out[made] = self.lengths[symbols[made].astype(np.int64) - self.first]
        return out

    def counts(self) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(self._spans(self.symbols))])
        return np.diff(upto[self.starts.astype(np.int64)])

    def ids(self) -> np.ndarray:
        return self._expand(self.symbols)

    def document(self, i: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of document ``i``; only symbols that reach into them are expanded."""
        symbols = self.symbols[int(self.starts[i]) : int(self.starts[i + 1])]
        upto = np.concatenate([[0], np.cumsum(self._spans(symbols))])
        stop = int(upto[-1]) if stop is None else min(stop, int(upto[-1]))
        if start >= stop:
            return np.empty(0, np.uint32)
        lo, hi = int(np.searchsorted(upto, start, "right")) - 1, int(np.searchsorted(upto, stop, "left"))
        return self._expand(symbols[lo:hi])[start - int(upto[lo]) : stop - int(upto[lo])]


def write_ids(docs: DataFrame, tokenizer: str, keeps_space: bool, end_id: int, vocabulary: int, block_ids: int = 2_000_000) -> DataFrame:
    """Blocks of all documents, in ascending doc_id order by shard and block, as a written table."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard, block = encoder(tokenizer, keeps_space, roomy=True), TaskContext.get().partitionId(), 0
        names: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block
            ids, bounds = np.concatenate(held), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            row = [[shard], [block], [len(names)], [len(ids)], [pack_block(names, ids, bounds, end_id, vocabulary)]]
            block += 1
            names.clear(), held.clear(), sizes.clear()
            del ids, bounds
            release()  # what a block took goes back before the next one is gathered
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for lo, ids, counts in enc.slices(batch.column(1)):
                ids, bounds = with_end(ids, counts, end_id)
                at = 0
                while at < len(counts):
                    # Whole documents up to the block's room, but one at least.
                    room = block_ids - sum(map(len, held))
                    to = max(int(np.searchsorted(bounds, bounds[at] + max(room, 0), "right")) - 1, at + (not held))
                    if to > at:
                        names += doc_ids[lo + at : lo + to]
                        held.append(ids[bounds[at] : bounds[to]])
                        sizes.append(np.diff(bounds[at : to + 1]))
                        at = to
                    if at < len(counts):
                        yield close()
        if names:
            yield close()

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return written(ordered.mapInArrow(lean(encode, tuned=False), BLOCK), "blocks")


def read_ids(blocks: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the blocks."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                block = Block.read(raw.as_py())
                counts, ids = block.counts(), block.ids()
                bounds = np.concatenate([[0], np.cumsum(counts)])
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block.doc_ids, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([number] * n, pa.int32()), pa.array(bounds[:-1]), pa.array(counts), pa.array(crc, pa.int64())],
                    names=["doc_id", "shard", "block", "within", "n_tokens", "ids_crc32"],
                )

    # Ids before each block: by shard first, so that the running sum over all has a row for each shard only.
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("shard", "block", F.col("n_tokens").alias("n"))
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("in_shard")).withColumn("before", F.coalesce(F.sum("in_shard").over(earlier(Window.orderBy("shard"))), F.lit(0)))
    inner = F.coalesce(F.sum("n").over(earlier(Window.partitionBy("shard").orderBy("block"))), F.lit(0))
    base = sizes.withColumn("inner", inner).join(shards, "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("base"))
    rows = blocks.select("shard", "block", "payload").mapInArrow(lean(decode, tuned=False), DECODED)
    return rows.join(base, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")
