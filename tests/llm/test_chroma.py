import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from facetmill.llm.chroma import HOP, RATE, WIDEST, align, fingerprint_table, fingerprints, packed_numbers, pitch_matrix
from facetmill.llm.queries import QUERIES


def tone(seconds, seed, noise=0.0):
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * RATE)) / RATE
    steps = rng.integers(0, 24, int(seconds * 8) + 1)
    x = np.sin(2 * np.pi * np.cumsum(110 * 2 ** (steps[(t * 8).astype(int)] / 12)) / RATE)
    return ((x * 0.7 + noise * np.random.default_rng(99).standard_normal(len(x))).clip(-1, 1) * 127 + 128).astype(np.uint8).tobytes()


def test_pitch_classes_of_pure_tones():
    matrix = pitch_matrix(8000, 2048)
    for hz, note in ((440.0, 0), (880.0, 0), (523.25, 3), (329.63, 7)):
        bin_ = int(round(hz * 2048 / 8000))
        assert matrix[bin_].argmax() == note


def test_filters_against_direct_sums():
    rng = np.random.default_rng(0)
    from facetmill.llm import chroma as c

    chroma = rng.integers(0, c.UNIT, (20, 12))

    got = packed_numbers(chroma, np.array([0, 5]))
    wide = np.concatenate([chroma, chroma], 1)
    for at, number in zip((0, 5), got.tolist()):
        for k, (kind, p, h, w) in enumerate(c.FILTERS):
            block = wide[at : at + w, p : p + h]
            low, high, early, late = block[:, : h // 2], block[:, h // 2 :], block[: w // 2], block[w // 2 :]
            a, b = {
                0: (high.sum(), low.sum()),
                1: (late.sum(), early.sum()),
                2: (early[:, : h // 2].sum() + late[:, h // 2 :].sum(), early[:, h // 2 :].sum() + late[:, : h // 2].sum()),
                3: (block[:, h // 4 : h - h // 4].sum(), block.sum() - block[:, h // 4 : h - h // 4].sum()),
            }[kind]
            value = np.log((c.UNIT + a) / (c.UNIT + b))
            step = int(value > -c.STEP) + int(value > 0) + int(value > c.STEP)
            assert (number >> (30 - 2 * k)) & 3 == step ^ (step >> 1)


def test_media_in_one_call_or_alone_agree():
    media = [tone(1.0, 1), None, b"", b"short", tone(0.3, 2)]
    together = fingerprints(media)
    alone = [fingerprints([m])[0] for m in media]
    assert all((a == b).all() for a, b in zip(together, alone))
    assert [len(x) for x in together][1:4] == [0, 0, 1]


def test_excerpts_align_with_recordings(spark):
    song = tone(4.0, 5)
    rows = [(1, song), (2, song[40 * HOP :]), (3, tone(4.0, 6)), (4, song), (5, None), (None, song), (6, tone(4.0, 5, 0.02)[20 * HOP :])]
    prints = fingerprint_table(spark.createDataFrame(rows, "id long, audio binary"), F.col("audio"), "id").cache()
    got = {r.rec_id: r for r in align(prints).collect()}
    assert (got[2].aligned_to, got[2].offset, got[2].bit_error_rate) == (1, 40, 0.0)
    assert (got[4].aligned_to, got[4].offset, got[4].bit_error_rate) == (1, 0, 0.0)
    assert got[6].aligned_to == 1 and got[6].offset == 20 and got[6].bit_error_rate < 0.25
    assert 5 not in got and 1 not in got


def brute_align(rows, least_votes=3):
    """The best of all rows of smaller ids and all offsets for each id; ``rows`` has (id, numbers)."""
    out = {}
    for i, own in rows:
        for j, other in rows:
            votes = {}
            for p, x in enumerate(zip(own, own[1:])) if j < i else ():
                for q, y in enumerate(zip(other, other[1:])):
                    if x == y:
                        votes[q - p] = votes.get(q - p, 0) + 1
            if own == other and j < i:
                votes.setdefault(0, 1)
            for off, v in votes.items():
                if v >= least_votes or own == other and off == 0:
                    pairs = [(a, other[p + off]) for p, a in enumerate(own) if 0 <= p + off < len(other)]
                    wrong = sum(((int(a) ^ int(b)) & 0xFFFFFFFF).bit_count() for a, b in pairs) / (32 * len(pairs))
                    out[i] = min(out.get(i, (1,)), (-v, j, off, len(pairs), wrong))
    return {i: (j, off, -v, n, wrong) for i, (v, j, off, n, wrong) in out.items()}


def test_query_against_brute_force(spark, docs_of, sf_dir):
    base = ["some longer text that goes on and on " * 40, "other words are here, and more of them " * 30]
    texts = {i: base[i % 2][i * 13 :] + f" tail {i}" for i in range(12)} | {20: None, 21: "", 22: "x", 23: base[0], 24: base[0]}
    got = {r.doc_id: r for r in QUERIES["op7_chroma_fingerprints"](spark, sf_dir(documents=docs_of(list(texts.items())))).collect()}
    prints = {i: fingerprints([t.encode() if t is not None else None])[0] for i, t in texts.items()}
    want = brute_align([(i, p.tolist()) for i, p in prints.items() if len(p)])
    assert sorted(got) == sorted(texts)
    for i, r in got.items():
        assert (r.n_numbers, r.numbers_crc32) == (len(prints[i]), zlib.crc32(prints[i].astype("<u4").tobytes()))
        if i in want:
            assert (r.aligned_to, r.offset, r.votes, r.overlap) == want[i][:4] and r.bit_error_rate == pytest.approx(want[i][4])
        else:
            assert r.aligned_to is None


def test_short_media_has_one_number_and_empty_table_none(spark, docs_of, sf_dir):
    assert len(fingerprints([b"ab" * (HOP * WIDEST)])[0]) >= 1
    assert QUERIES["op7_chroma_fingerprints"](spark, sf_dir(documents=docs_of([]))).count() == 0


def aligned(spark, rows, **more):
    made = align(spark.createDataFrame(rows, "rec_id long, numbers array<int>"), **more).collect()
    assert all(r.overlap >= r.votes for r in made)
    return {r.rec_id: (r.aligned_to, r.offset, r.votes, r.overlap, r.bit_error_rate) for r in made}


def test_copies_made_of_others_passages_and_repetitive_copies(spark):
    a, b, loop = list(range(10, 16)), list(range(20, 25)), [31, 32, 33] * 4
    rows = [(1, [*a, 1]), (2, [2, *b]), (8, a + b), (9, a + b), (10, [*a, *b, 3]), (20, loop), (21, loop), (22, [5, *loop]), (30, [1, 2]), (31, [1, 2]), (32, [1, 2, 9])]
    got = aligned(spark, rows)
    assert [got[i][:3] for i in (9, 10, 21, 22, 31)] == [(8, 0, 10), (8, 0, 10), (20, 0, 11), (20, -1, 11), (30, 0, 1)] and 32 not in got
    assert got == brute_align(rows)


def test_alignments_against_every_pair_and_offset(spark, monkeypatch):
    monkeypatch.setattr("facetmill.llm.chroma.SLICE", 5)
    monkeypatch.setattr("facetmill.llm.chroma._VOTES_AT_ONCE", 7)
    rng = np.random.default_rng(3)
    rows = [(i, rng.choice(9, int(rng.integers(1, 14)), p=np.arange(9, 0, -1) / 45).tolist()) for i in range(60)]
    rows += [(100 + i, rows[i][1][1:] + [7, 7, 7]) for i in range(20)] + [(200 + i, rows[i % 8][1]) for i in range(20)]
    rows += [(i, rng.integers(0, 9, 5).tolist()) for i in (3, 3, 205, 300, 301)] + [(301, [8]), (401, [99])]
    shared = rng.integers(0, 1 << 30, 12).tolist()
    rows += [(500 + i, [*shared[: 6 + i % 7], 1000 + i, *shared[6 + i % 7 :], i % 3]) for i in range(25)]
    for least in (1, 3):
        want, got = brute_align(rows, least), aligned(spark, [*rows, (400, [])], least_votes=least)
        # Rows of one id may agree equally well; which of them counts for overlap and bits is open.
        assert {i: x[:3] for i, x in got.items()} == {i: x[:3] for i, x in want.items()}
