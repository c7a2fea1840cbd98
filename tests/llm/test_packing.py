import itertools
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetmill.llm.packing import best_fit, cut, lower_bound, pack_pieces
from facetmill.llm.pieces import PieceEncoder
from facetmill.llm.queries import QUERIES, vocabulary

ODD = ["", " a", "a ", "a  b", "a\n\nb", "a \n b", "x\ty", "\n", "a\nb c  d", "it's 'S don't\n'll x's", "É é ΑΣ ΑΣ.", "<|endoftext|> a", "a\x1eb c", "\x1e", " ", "a　b", "﻿a b", "a\r\nb  c",
       "x,. y", "x., y, z. A", "İ. ß, Σ. ", "it's. don't, x", "3. 4, 5", "a.\nb,\nC", " . a , b", "é. x", "क़. x", "...", "?!. x", "word " * 3000]


@pytest.mark.parametrize(("name", "keeps_space"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_have_the_ids_of_whole_texts(name, keeps_space):
    import pyarrow as pa

    enc = PieceEncoder(vocabulary(name), keeps_space)
    whole = lambda t: enc.tokenizer.encode(t or "", add_special_tokens=False).ids

    def same(texts):
        for lo, ids, counts in enc.slices(pa.array(texts, pa.string())):
            for t, run in zip(texts[lo:], np.split(ids, np.cumsum(counts))):
                assert list(run) == whole(t), repr(t)

    same([None, *ODD])

    @settings(max_examples=150, deadline=None)
    @given(st.lists(st.text(alphabet=st.sampled_from("ab'sT .,\n\t!?1é́İ 　\x1e"), max_size=25), min_size=1, max_size=5))
    def random_texts(texts):
        same(texts)

    random_texts()


@pytest.mark.parametrize("n", [1, 7, 8, 9, 16, 17])
def test_only_the_first_piece_is_shorter(n):
    pieces = list(cut(n, 8))
    assert sum(size for _, size in pieces) == n
    assert all(size == 8 for _, size in pieces[1:])
    assert [start for start, _ in pieces] == [sum(size for _, size in pieces[:k]) for k in range(len(pieces))]


def _optimum(lengths, capacity):
    """Fewest bins by trying all assignments in order."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bounds_lie_below_the_optimum_and_best_fit_above(lengths):
    lengths = sorted(lengths, reverse=True)
    counts = np.bincount(lengths, minlength=21)
    optimum = _optimum(lengths, 20)
    bins, offsets, fill = best_fit(lengths, 20)
    assert lower_bound(counts, 20) <= optimum <= len(fill)
    assert all(f <= 20 for f in fill)
    for b in range(len(fill)):
        inside = sorted((o, n) for o, n, k in zip(offsets, lengths, bins) if k == b)
        assert [o for o, _ in inside] == list(itertools.accumulate([0, *[n for _, n in inside]]))[:-1]


def test_dual_feasible_functions_beat_the_sum():
    counts = np.zeros(11, int)
    counts[6] = 4  # four items over half a bin
    assert lower_bound(counts, 10) == 4


def slow_bound(lengths, capacity):
    """The same bound item by item."""
    def whole(x, e):
        return capacity if e and x > capacity - e else 0 if e and x < e else x

    best = -(-sum(lengths) // capacity)
    for e in [0, *[x for x in lengths if 2 * x <= capacity]]:
        for k in range(1, 21):
            u = [k * y if (k + 1) * y % capacity == 0 else (k + 1) * y // capacity * capacity for y in (whole(x, e) for x in lengths)]
            best = max(best, -(-sum(u) // (capacity * k)), -(-sum(whole(x, e) for x in lengths) // capacity))
    return best


def test_bound_over_many_distinct_lengths():
    rng = np.random.default_rng(1)
    for _ in range(3):
        lengths = rng.integers(1, 301, 120).tolist()
        assert lower_bound(np.bincount(lengths, minlength=301), 300) == slow_bound(lengths, 300)


def packed_rows(spark, lengths, per_partition, ids=None):
    rows = [(ids[i] if ids else i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    packed, report = pack_pieces(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), capacity=10, per_partition=per_partition)
    got = packed.collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == sorted((r[0] or -1, r[3]) for r in rows)
    used = {}
    for r in got:
        used.setdefault((r.part, r.sequence), []).append((r.offset, r.length))
    for inside in used.values():
        assert [o for o, _ in sorted(inside)] == [0, *itertools.accumulate(n for _, n in sorted(inside))][:-1] and sum(n for _, n in inside) <= 10
    assert report[-1]["sequences"] == len(used) <= report[0]["sequences"]
    return got, report


def test_partitions_exchange_documents(spark):
    _, report = packed_rows(spark, [6, 4] * 50 + [3, 7] * 50, 20)
    assert len(report) > 1 and report[-1]["sequences"] < report[0]["sequences"]
    assert report[-1]["sequences"] >= report[-1]["bound"] == 100


def test_certified_by_own_bound_where_the_sum_is_loose(spark):
    got, report = packed_rows(spark, [6] * 60, 20)
    assert all(r.bound * 10 > 6 * r.bound for r in got) and len(report) == 1
    assert report[0]["certified"] == report[0]["partitions"] > 1 and report[0]["sequences"] == report[0]["bound"] == 60


def test_rows_of_one_id_are_dealt_apart(spark):
    got, report = packed_rows(spark, [3, 5, 8, 2] * 30, 20, [None] * 60 + [7] * 60)
    assert report[0]["partitions"] == 6 and report[-1]["sequences"] <= report[-1]["bound"] + 2


def test_query_against_brute_force(spark, docs_of, sf_dir):
    texts = [None, "", "one two", "one two", "word " * 5000, "Ünï \n\n cödé  x"]
    path = sf_dir(documents=docs_of(list(enumerate(texts)) + [(0, None)]))
    got = QUERIES["op1_best_fit_packing"](spark, path).collect()
    enc = PieceEncoder(vocabulary("byte_bpe_50k.json"), True).tokenizer
    want = {}
    for i, t in enumerate(texts):
        ids = np.array([*enc.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        for k, (a, n) in enumerate(cut(len(ids), 1024)):
            want[i, k] = (a, n, zlib.crc32(ids[a : a + n].tobytes()))
    assert sorted({(r.doc_id, r.piece) for r in got}) == sorted(want) and len(got) == len(want) + 1
    assert all((r.start, r.length, r.ids_crc32) == want[r.doc_id, r.piece] for r in got)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in by_sequence.values():
        inside.sort()
        assert [o for o, _ in inside] == list(itertools.accumulate([0, *[n for _, n in inside]]))[:-1] and sum(n for _, n in inside) <= 1024


def test_empty_table(spark, docs_of, sf_dir):
    assert QUERIES["op1_best_fit_packing"](spark, sf_dir(documents=docs_of([]))).count() == 0
